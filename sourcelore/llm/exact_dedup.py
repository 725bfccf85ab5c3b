"""Exact duplicates by Patricia tries over whole texts.

Rows are dealt by length and content hash; each partition inserts full byte strings into compressed
radix tries whose terminal nodes hold the owner of the text and how often it came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelore.llm.common import column, packed, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Bytes of text a trie holds before its finished subtrees are written out.
TRIE_BYTES = 32 << 20


class _Node:
    """The label of a node is ``key[start:end]``; positions count from the start of the whole string."""

    __slots__ = ("end", "key", "kids", "owner", "start")

    def __init__(self, key: bytes, start: int, end: int):
        self.key, self.start, self.end = key, start, end
        self.kids: dict[int, _Node] = {}
        self.owner: list | None = None


def _shared(a: bytes, b: bytes, start: int, end: int) -> int:
    """Up to where a and b agree from start on; they agree before it."""
    end = min(end, len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    while end - start > 1:
        middle = (start + end) // 2
        if a[start:middle] == b[start:middle]:
            start = middle
        else:
            end = middle
    return start if a[start] != b[start] else end


class PatriciaTrie:
    """A compressed radix trie; nodes refer to the strings they came from and copy nothing."""

    def __init__(self):
        self.root = _Node(b"", 0, 0)
        self.terminals: list[_Node] = []
        self.held = 0

    def terminal(self, key: bytes) -> _Node:
        """The node that ends this string, made if it is new (its ``owner`` is then None)."""
        node = self.root
        while node.end < len(key):
            at = node.end
            child = node.kids.get(key[at])
            if child is None:
                leaf = node.kids[key[at]] = _Node(key, at, len(key))
                node = leaf
                break
            agree = _shared(key, child.key, at, child.end)
            if agree < child.end:
                fork = node.kids[key[at]] = _Node(child.key, at, agree)
                fork.kids[child.key[agree]] = child
                child.start = agree
                child = fork
            node = child
        if node.owner is None:
            self.terminals.append(node)
            self.held += len(key)
        return node


def normalised(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, UPPER, LOWER)


def _largest(a: int | None, b: int | None) -> bool:
    return a is not None and (b is None or a > b)


def _merge(batches: Iterator[pa.RecordBatch], id_name: str, text_name: str, counted: bool) -> Iterator[pa.RecordBatch]:
    """One row for each text of each stretch of rows that a trie holds.

    Of copies only the owner's row is held, so memory follows the distinct texts however many copies there are.
    With ``counted`` the rows are sorted by length and hash, so at each change of these all subtrees
    in memory are complete; before it (map side) a text may come again in a later stretch.
    """
    trie, waiting = PatriciaTrie(), []
    held = bound = 0

    def owners_only() -> list[pa.RecordBatch]:
        """The rows of owners in one batch; those of other copies are let go."""
        nodes = sorted(trie.terminals, key=lambda node: node.owner[2:])
        rows: list[list[int]] = [[] for _ in waiting]
        for place, node in enumerate(nodes):
            batch_no, row = node.owner[2:]
            rows[batch_no].append(row)
            node.owner[2:] = 0, place
        parts = [batch.take(pa.array(r, pa.int64())) for batch, r in zip(waiting, rows, strict=True) if r]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()

    def flush() -> Iterator[pa.RecordBatch]:
        taken: list[list[tuple[int, int]]] = [[] for _ in waiting]
        for node in trie.terminals:
            _, count, batch_no, row = node.owner
            taken[batch_no].append((row, count))
        for batch, rows in zip(waiting, taken, strict=True):
            if rows:
                rows.sort()
                part = batch.take(pa.array([r for r, _ in rows], pa.int64()))
                counts = pa.array([n for _, n in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("length"), part.column("text_sha256"), counts],
                    names=["row", "length", "text_sha256", "group_size"],
                )

    last = None
    for batch in batches:
        rows = batch.column("row")
        ids, texts = rows.field(id_name).to_pylist(), rows.field(text_name).to_pylist()
        lengths, hashes = batch.column("length").to_pylist(), batch.column("text_sha256").to_pylist()
        counts = batch.column("group_size").to_pylist()
        waiting.append(batch)
        held += batch.nbytes
        for i, text in enumerate(texts):
            place = (lengths[i], hashes[i])
            if trie.held > TRIE_BYTES and (not counted or place != last):
                yield from flush()
                trie, waiting, bound = PatriciaTrie(), [batch], 0
                held = batch.nbytes
            last = place
            node = trie.terminal((text or "").encode().translate(_FOLD))
            if node.owner is None:
                node.owner = [ids[i], counts[i], len(waiting) - 1, i]
            else:
                node.owner[1] += counts[i]
                if _largest(ids[i], node.owner[0]):
                    node.owner[0], node.owner[2:] = ids[i], [len(waiting) - 1, i]
        if held > 2 * bound + TRIE_BYTES:
            waiting = owners_only()
            held = bound = sum(part.nbytes for part in waiting)
    yield from flush()


def owners(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """The row that stays for each text, whole (``row``), with length, text_sha256 and group_size.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the
    row with the largest id stays (a null id is the smallest; of wholly equal ids any one). An empty table
    gives an empty result; other columns ride along inside ``row`` under any name.

    A trie of each map task first merges the copies it sees, so a text with very many copies is sent once
    per task. The reducing side sorts its rows by length and hash (Spark's sort spills when needed), which
    brings the trie one subtree after the other: finished ones are written out and freed.
    """
    text = normalised(text_of(text_name))
    rows = docs.select(
        packed(docs).alias("row"),
        F.octet_length(text).cast("long").alias("length"),
        F.sha2(text, 256).alias("text_sha256"),
        F.lit(1).cast("long").alias("group_size"),
    )
    schema = T.StructType(list(rows.schema.fields))
    local = rows.mapInArrow(lambda batches: _merge(batches, id_name, text_name, False), schema)
    dealt = local.repartition("length", "text_sha256").sortWithinPartitions("length", "text_sha256")
    return dealt.mapInArrow(lambda batches: _merge(batches, id_name, text_name, True), schema)


def deduplicated(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    return owners(docs, id_name, text_name).select("row.*")


def duplicate_groups(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """One row per document, dropped ones too: its id, keep_id, group_size, kept, text_sha256.

    Of rows that repeat both id and text, exactly one is marked as kept.
    """
    text = normalised(text_of(text_name))
    members = (
        docs.select(
            column(id_name).alias("doc_id"),
            F.octet_length(text).cast("long").alias("length"),
            F.sha2(text, 256).alias("text_sha256"),
        )
        .groupBy("doc_id", "length", "text_sha256")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    kept = owners(docs, id_name, text_name).select(
        "length", "text_sha256", "group_size", F.col("row").getField(id_name).alias("keep_id")
    )
    joined = members.join(kept, ["length", "text_sha256"])
    each = joined.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("time") == 1)
    return each.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")


DUPLICATES_SQL = f"""
with texts as (
    select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256 from documents
), groups as (
    select text_sha256, max(doc_id) as keep_id, count(*) as group_size from texts group by text_sha256
)
select t.doc_id, g.keep_id, g.group_size,
       t.doc_id is not distinct from g.keep_id and row_number() over (partition by t.doc_id, t.text_sha256) = 1 as kept,
       t.text_sha256
from texts t join groups g on t.text_sha256 = g.text_sha256
"""
