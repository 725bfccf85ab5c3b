"""Near-duplicates by a chosen-path join over sets of word n-grams.

Every set follows a few of its own sampled tokens; sets that share such a path meet in a bucket. Buckets that are
too large are split by further tokens, small ones are compared in full. Enough independent runs bring the chance to
miss a pair at the threshold below one minus the target recall.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelore.llm.common import column, packed, settle

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Expected number of tokens that a pair at the threshold samples together in one run.
SHARED_A_RUN = 3.0
#: Sets that one task compares with each other, and how often a larger bucket is split before it is cut into blocks.
BUCKET, DEPTH = 500, 2
#: Leaves of up to so many sets are compared together, in pieces of so many rows.
SMALL, PIECE = 32, 4000
#: Smallest hashes of a set, by which a pair is judged before whole sets are moved; and four deviations of it.
SKETCH = 64
SKETCH_SLACK = 0.25
_WORD = re.compile(r"\w+")
_MASK = (1 << 64) - 1
_STEP = np.uint64(0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_for(recall: float, threshold: float) -> int:
    """Runs until a pair at the threshold is missed rarely enough.

    Such a pair shares a Poisson number of sampled tokens a run, and each split of a bucket keeps it together with a
    chance of its similarity, being made by the whole sets; a path that survives all splits in any run is enough.
    """
    return max(1, math.ceil(math.log(1 / (1 - recall)) / (SHARED_A_RUN * threshold**DEPTH)))


class _Hashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        made = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return made


class Shingler:
    """Sets of word n-grams as sorted 32-bit hashes."""

    def __init__(self, words: int):
        self.words, self.known = words, _Hashes()

    def set_of(self, text: str | None) -> np.ndarray:
        """Words are runs of letters and digits, case set aside. A text with fewer words is one n-gram; without any, none."""
        found = _WORD.findall((text or "").lower())
        if not found:
            return np.zeros(0, np.uint32)
        hashes = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        n = min(self.words, len(found))
        total = np.full(len(found) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                total = total * _STEP + hashes[i : len(found) - n + 1 + i]
        return np.unique((_mix(total) >> np.uint64(32)).astype(np.uint32))


def _paths(tokens: np.ndarray, threshold: float, runs: int) -> list[int]:
    """First step of every run: the tokens whose hash is small enough for a set of this size."""
    out: list[int] = []
    if not len(tokens):
        return out
    limit = min(1.0, SHARED_A_RUN / (threshold * len(tokens)))
    for run in range(runs):
        with np.errstate(over="ignore"):
            hashes = _mix(tokens.astype(np.uint64) + np.uint64((run + 1) * 0x9E3779B97F4A7C15 & _MASK))
        out += hashes[hashes <= np.uint64(int(limit * _MASK) if limit < 1 else _MASK)].view(np.int64).tolist()
    return out


def _steps(tokens: np.ndarray, paths: list[int]) -> list[int]:
    """The further steps of each path, in order.

    A step follows the token of the whole set that a hash of the path so far puts first, so two sets on one path stay
    together with a chance of exactly their similarity, contained ones too. Steps are made here, where the set is at
    hand: splitting a bucket later moves numbers only.
    """
    if not paths:
        return []
    wide, at = tokens.astype(np.uint64), np.array(paths, np.int64).view(np.uint64)
    out = np.empty((len(paths), DEPTH), np.uint64)
    side = max(1, (1 << 17) // len(wide))
    with np.errstate(over="ignore"):
        for step in range(DEPTH):
            lowest = [_mix(wide + at[i : i + side, None]).min(axis=1) for i in range(0, len(at), side)]
            at = out[:, step] = _mix(np.concatenate(lowest) ^ (at * _STEP))
    return out.view(np.int64).ravel().tolist()


def shingle_sets(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, sig, size, tokens, paths, steps): the set of each document, a digest of it, where its runs begin and how
    each goes on, ``DEPTH`` steps a path."""
    runs = runs_for(recall, threshold)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingler.set_of(text) for text in part.column("text").to_pylist()]
                raw = [s.tobytes() for s in sets]
                paths = [_paths(s, threshold, runs) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(raw, pa.binary()),
                        pa.array(paths, pa.list_(pa.int64())),
                        pa.array([_steps(s, p) for s, p in zip(sets, paths)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "sig", "size", "tokens", "paths", "steps"],
                )

    rows = docs.select(column(id_name).cast("long").alias("doc_id"), column(text_name).alias("text"))
    return rows.mapInArrow(convert, "doc_id long, sig binary, size int, tokens binary, paths array<long>, steps array<long>")


def leaves(sets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(sig, path, left, right, block, blocks): the buckets in which a set is compared.

    Buckets with more than ``bucket`` sets are split by the next step of their paths, up to ``DEPTH`` times. One that is
    still too large holds sets which are alike or share most of what they have; it is cut into blocks of twice that
    size, and every two blocks make one leaf (left, right), so that no pair of it is left out and no task gets it whole.
    """
    steps = [f"step{i}" for i in range(DEPTH)]
    rows = sets.where(F.col("size") > 0).select("sig", "steps", F.posexplode("paths").alias("at", "path"))
    rows = rows.select("sig", "path", *[F.col("steps")[F.col("at") * DEPTH + i].alias(name) for i, name in enumerate(steps)])
    done = []
    for depth in range(DEPTH + 1):
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        counts = counts.withColumnRenamed("path", "bucket")
        counted = settle(rows.join(counts, F.col("path").eqNullSafe(F.col("bucket"))).drop("bucket"))
        whole = [*[F.lit(0).alias(name) for name in ("left", "right", "block")], F.lit(1).alias("blocks")]
        done.append(counted.where(F.col("n") <= bucket).select("sig", "path", *whole))
        large = counted.where(F.col("n") > bucket)
        if large.isEmpty():
            break
        if depth < DEPTH:
            rows = large.select("sig", F.col(steps[depth]).alias("path"), *steps[depth + 1 :])
            continue
        blocks = F.ceil(F.col("n") / (2 * bucket)).cast("int")
        placed = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sig", "path"), blocks).cast("int"))
        every = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = (F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
        done.append(every.select("sig", "path", *pair, "block", "blocks"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def distinct_leaves(met: DataFrame) -> DataFrame:
    """Of whole leaves with the very same sets only the one with the smallest path.

    Two near copies meet on most of their paths; comparing them once is enough. Leaves are equal if number and two
    hashes of their sets are.
    """
    whole = met.where(F.col("blocks") == 1)
    prints = whole.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sig")).alias("y")
    )
    first = prints.groupBy("n", "x", "y").agg(F.min("path").alias("path")).select("path")
    return whole.join(first, "path").unionByName(met.where(F.col("blocks") > 1)).select("sig", "path", "left", "right", "block")


def _own(paths: list[np.ndarray], here: int) -> np.ndarray:
    """Pairs that belong to this bucket: of the paths two sets share, it is the smallest."""
    smaller: dict[int, list[int]] = {}
    for i, mine in enumerate(paths):
        for path in mine:
            if path < here:
                smaller.setdefault(int(path), []).append(i)
    own = np.ones((len(paths), len(paths)), bool)
    for members in smaller.values():
        if len(members) > 1:
            own[np.ix_(members, members)] = False
    return own


def _whole_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by leaf, in pieces of whole leaves with their bounds: one large leaf, or many small ones together."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        bounds = _bounds(rows)
        yield from _pieces(rows, bounds[:-1])
        rest = rows.slice(int(bounds[-2]))
    if rest is not None:
        yield from _pieces(rest, _bounds(rest))


def _bounds(rows: pa.Table) -> np.ndarray:
    """Where leaves start, and the end."""
    keys = np.stack([rows.column(name).to_numpy() for name in ("path", "left", "right")])
    changes = np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1
    return np.concatenate([[0], changes, [rows.num_rows]])


def _pieces(rows: pa.Table, bounds: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
    start = 0
    while start < len(bounds) - 1:
        end = start + 1
        if bounds[end] - bounds[start] <= SMALL:
            while end < len(bounds) - 1 and bounds[end + 1] - bounds[end] <= SMALL and bounds[end + 1] - bounds[start] <= PIECE:
                end += 1
        yield rows.slice(int(bounds[start]), int(bounds[end] - bounds[start])).combine_chunks(), bounds[start : end + 1] - bounds[start]
        start = end


def _open_pairs(rows: pa.Table, bounds: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows to be looked at: of one leaf that is their own, of different blocks unless it is one block, of like size."""
    size, block, here = (rows.column(name).to_numpy() for name in ("size", "block", "path"))
    several = rows.column("left").to_numpy() != rows.column("right").to_numpy()
    paths = rows.column("paths").combine_chunks()
    ends, values = paths.offsets.to_numpy() - paths.offsets[0].as_py(), paths.flatten().to_numpy()
    if len(bounds) == 2:
        i, j = np.nonzero(np.triu(_own(np.split(values, ends[1:-1]), int(here[0])), 1))
    else:
        counts = np.diff(bounds)
        made = [(np.triu_indices(n, 1), bounds[:-1][counts == n, None]) for n in np.unique(counts)]
        i, j = (np.concatenate([(starts + pair[side]).ravel() for pair, starts in made]) for side in (0, 1))
    keep = (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])) & (~several[i] | (block[i] != block[j]))
    i, j = i[keep], j[keep]
    if len(bounds) > 2 and len(i):
        counts = np.diff(ends)
        table = np.full((len(counts), counts.max()), np.iinfo(np.int64).max)
        table[np.arange(table.shape[1]) < counts[:, None]] = values
        other = np.zeros(len(i), bool)
        for column_ in table.T:
            theirs = column_[j]
            other |= (theirs < here[i]) & (table[i] == theirs[:, None]).any(axis=1)
        i, j = i[~other], j[~other]
    return i, j


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections within a leaf, from the tokens that at least two sets have."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[token] > 1
    owner, token = owner[shared], token[shared]
    out = np.zeros((n, n), np.float32)
    if not len(token):
        return out
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    step = max(1, (8 << 20) // n)
    for start in range(0, int(token[-1]) + 1, step):
        a, b = np.searchsorted(token, [start, start + step])
        part = np.zeros((n, min(step, int(token[-1]) + 1 - start)), np.float32)
        part[owner[a:b], token[a:b] - start] = 1
        out += part @ part.T
    return out


def _sketch_overlaps(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Numbers of hashes that rows i and j of a padded table of sketches share."""
    out = np.empty(len(i), np.int64)
    for start in range(0, len(i), PIECE):
        part = slice(start, start + PIECE)
        both = np.sort(np.concatenate([sketches[i[part]], sketches[j[part]]], axis=1), axis=1)
        out[part] = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)).sum(axis=1)
    return out


def _hopeful(threshold: float):
    """The sets of a leaf that have a partner there, judged by their smallest hashes."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_leaves(batches):
            i, j = _open_pairs(rows, bounds, threshold)
            if not len(i):
                continue
            sketches = [np.frombuffer(s, np.uint32) for s in rows.column("sketch").to_pylist()]
            lengths = np.array([len(s) for s in sketches])
            table = np.full((len(sketches), SKETCH), _PAD, np.int64)
            table[np.arange(SKETCH) < lengths[:, None]] = np.concatenate(sketches)
            inside = _overlaps(sketches)[i, j] if len(bounds) == 2 else _sketch_overlaps(table, i, j)
            # Of a larger set the sketch is a part; what lies below both ends is comparable, and so is all that is shared.
            full = lengths == SKETCH
            ends = np.where(full, table[:, -1], _PAD - 1)
            union = np.empty(len(i))
            for start in range(0, len(i), PIECE):
                part = slice(start, start + PIECE)
                lowest = np.minimum(ends[i[part]], ends[j[part]])[:, None]
                union[part] = (table[i[part]] <= lowest).sum(axis=1) + (table[j[part]] <= lowest).sum(axis=1)
            union -= inside
            like = inside >= np.where(full[i] | full[j], threshold - SKETCH_SLACK, threshold) * union - 1e-6
            keep = np.zeros(rows.num_rows, bool)
            keep[i[like]] = keep[j[like]] = True
            yield from rows.select(["sig", "path", "left", "right", "block"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return judge


#: Above all 32-bit hashes.
_PAD = 1 << 32


def _verified(threshold: float):
    """Links that each set of a leaf has there (documents, not pairs), and the first set it hangs together with."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_leaves(batches):
            i, j = _open_pairs(rows, bounds, threshold)
            if not len(i):
                continue
            sets = [np.frombuffer(s, np.uint32) for s in rows.column("tokens").to_pylist()]
            size, copies = (rows.column(name).to_numpy() for name in ("size", "copies"))
            if len(bounds) == 2:
                shared = _overlaps(sets)[i, j]
            else:
                shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())])
            linked = shared >= threshold * (size[i].astype(float) + size[j] - shared) - 1e-6
            i, j = i[linked], j[linked]
            links = np.zeros(rows.num_rows, np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            # Labels spread along the links of the leaf until each part has its first member's.
            root = np.arange(rows.num_rows)
            while (root[i] != root[j]).any():
                lower = np.minimum(root[i], root[j])
                np.minimum.at(root, i, lower)
                np.minimum.at(root, j, lower)
            touched = np.nonzero(links)[0]
            sigs = rows.column("sig")
            yield pa.RecordBatch.from_arrays(
                [sigs.take(touched).combine_chunks(), sigs.take(root[touched]).combine_chunks(), pa.array(links[touched])], names=["sig", "root", "links"]
            )

    return verify


def _by_leaf(rows: DataFrame) -> DataFrame:
    """Each leaf in one task, as neighbouring rows."""
    return rows.repartition("path", "left", "right").sortWithinPartitions("path", "left", "right")


def components(edges: DataFrame) -> DataFrame:
    """(sig, label): the smallest member of each connected part, by rounds of taking over neighbours' labels.

    Each round also follows the labels themselves, which halves long chains; rounds end when nothing changes.
    """
    both = edges.where(F.col("sig") != F.col("root")).select(F.col("sig").alias("a"), F.col("root").alias("b"))
    both = settle(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "sig"))
    while True:
        offered = both.join(labels, F.col("b") == F.col("sig")).select(F.col("a").alias("sig"), "label")
        jumped = labels.select("sig", F.col("label").alias("via")).join(labels.select(F.col("sig").alias("via"), "label"), "via").select("sig", "label")
        best = labels.unionByName(offered).unionByName(jumped).groupBy("sig").agg(F.min("label").alias("label"))
        changed = settle(best.join(labels.withColumnRenamed("label", "old"), "sig").withColumn("moved", F.col("label") != F.col("old")))
        labels = changed.select("sig", "label")
        if changed.where("moved").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame,
    id_name: str = "doc_id",
    text_name: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies.

    Two documents are linked if their sets of ``words``-grams have a Jaccard similarity of ``threshold`` or more; equal
    sets count as copies (n_copies of them, the document itself included) and each as a link. A class is what links hold together;
    its id is the smallest id in it (null if there is none). Texts without words, null ones too, have no links and are
    a class of their own, by their id. Texts of fewer words are one n-gram. Repeated rows are copies of each other.
    An empty table gives an empty result. Tokens are 32-bit hashes: that two different n-grams of a pair of sets of n tokens
    count as one has a chance of n * n / 2**32.
    """
    sets = settle(shingle_sets(docs, id_name, text_name, words, threshold, recall))
    some = sets.where(F.col("size") > 0)
    # One row for each distinct set; of equal rows any one will do.
    once = some.select("sig", "size", "paths", "steps", F.substring("tokens", 1, 4 * SKETCH).alias("sketch")).groupBy("sig")
    reps = settle(once.agg(F.count(F.lit(1)).alias("copies"), *[F.first(name).alias(name) for name in ("size", "paths", "steps", "sketch")]))
    texts = some.select("sig", "tokens")
    meeting = settle(distinct_leaves(leaves(reps, bucket)))
    own_paths = meeting.groupBy("sig").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    members = settle(reps.drop("paths", "steps").join(own_paths, "sig"))
    hopeful = settle(_by_leaf(meeting.join(members, "sig")).mapInArrow(_hopeful(threshold), meeting.schema))
    whole = texts.join(hopeful.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.first("tokens").alias("tokens"))
    compared = hopeful.join(members.drop("sketch"), "sig").join(whole, "sig")
    found = settle(_by_leaf(compared).mapInArrow(_verified(threshold), "sig binary, root binary, links long"))
    labels = components(found)
    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    # Sets with a label or links are few beside the documents; the table of classes stays narrow.
    classes = reps.select("sig", "copies").join(labels, "sig", "left").join(links, "sig", "left")
    classes = classes.withColumn("label", F.coalesce("label", "sig"))
    members_of = sets.select("doc_id", "sig", "size").join(classes, "sig", "left")
    firsts = members_of.where(F.col("size") > 0).groupBy("label").agg(F.min("doc_id").alias("first"))
    named = members_of.join(firsts, "label", "left")
    return named.select(
        "doc_id",
        F.when(F.col("size") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def without_near_duplicates(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", **options) -> DataFrame:
    """The documents with their own columns, one of each class: the one with the smallest id.

    Rows without an id stay (nothing tells which of a class they are); of rows that repeat an id, all stay or none.
    """
    classes = near_duplicates(docs, id_name, text_name, **options)
    gone = classes.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(packed(docs).alias("row"), column(id_name).cast("long").alias("key"))
    return rows.join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")
