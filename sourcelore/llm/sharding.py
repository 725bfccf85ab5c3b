"""K-d tree sharding: leaves of near equal bytes, cut at distributed weighted quantiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelore.llm.common import column, settle
from sourcelore.operators.joins import attach

SHARDS = 24
#: Metadata a cut may follow. The id comes last, so that other dimensions win ties.
DIMENSIONS = ("source", "lang", "size", "id")
#: A place along a dimension has so many bits, the same number again break ties; each pass over the rows settles STEP_BITS.
PLACE_BITS = 24
STEP_BITS = 12
#: Rows of a shard are numbered in groups of about this many.
GROUP_ROWS = 100_000


@dataclass(frozen=True)
class _Node:
    """A region of space that becomes so many shards, beginning with shard ``first``."""

    first: int
    shards: int


def _prefix_number(name: str) -> Column:
    """Order-preserving number of the first six bytes of a text; null sorts first."""
    padded = F.rpad(F.substring(F.hex(F.encode(column(name).cast("string"), "utf-8")), 1, 12), 12, "0")
    return F.coalesce(F.conv(padded, 16, 10).cast("double") + 1, F.lit(0.0))


def _measured(docs: DataFrame, id_name: str, text_name: str, source_name: str, lang_name: str) -> DataFrame:
    text, key = column(text_name), column(id_name)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    return docs.select(
        key.alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        _prefix_number(source_name).alias("d_source"),
        _prefix_number(lang_name).alias("d_lang"),
        F.log2(size.cast("double")).alias("d_size"),
        F.coalesce(key.cast("double"), F.lit(-1.0)).alias("d_id"),
        F.xxhash64(key, text).alias("tie"),
        F.monotonically_increasing_id().alias("number"),
    )


def _told_apart(rows: DataFrame) -> DataFrame:
    """Rows that repeat an id and a text get ties of their own, from the numbers that a checkpoint has fixed."""
    repeated = rows.groupBy("tie").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    own = F.when(F.col("copies").isNotNull(), F.xxhash64("tie", "number")).otherwise(F.col("tie"))
    return attach(rows, repeated, ["tie"], "left").withColumn("tie", own).drop("number", "copies")


def _halves(node: _Node) -> tuple[_Node, _Node]:
    left = node.shards // 2
    return _Node(node.first, left), _Node(node.first + left, node.shards - left)


def _places(rows: DataFrame) -> DataFrame:
    """Each dimension scaled to whole numbers over its range, with the tie breaker in the lower bits."""
    ends = rows.agg(*[f(f"d_{d}").alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]).first()
    top = (1 << PLACE_BITS) - 1
    low_bits = F.col("tie").bitwiseAND((1 << PLACE_BITS) - 1)
    places = {}
    for d in DIMENSIONS:
        low, high = ends[f"min_{d}"] or 0.0, ends[f"max_{d}"] or 0.0
        scaled = F.floor((F.col(f"d_{d}") - low) / (high - low) * top) if high > low else F.lit(0).cast("long")
        places[f"p_{d}"] = F.shiftleft(scaled, PLACE_BITS) + low_bits
    return _told_apart(rows).select("doc_id", "size", "text_crc32", "tie", *[c.alias(name) for name, c in places.items()])


def _cut_level(rows: DataFrame, level: list[_Node]) -> dict[_Node, tuple[str, int]]:
    """For each node of a level the dimension and the place of its cut.

    Where a cut falls is found exactly: sums of bytes over 2**STEP_BITS steps of the place show in which step
    the wanted share is reached, and the next pass looks into that step only. The driver sees, per node of a
    level, no more than those sums.
    """
    here = rows.where(F.col("node").isin([n.first for n in level]))
    widths = [(F.max(f"p_{d}") - F.min(f"p_{d}")).alias(d) for d in DIMENSIONS]
    facts = {r["node"]: r for r in here.groupBy("node").agg(F.sum("size").alias("bytes"), *widths).collect()}
    known = [n for n in level if n.first in facts]
    if not known:
        return {}
    widest = {n.first: max(DIMENSIONS, key=lambda d, n=n: facts[n.first][d]) for n in known}
    wanted = {n.first: facts[n.first]["bytes"] * (n.shards // 2) / n.shards for n in known}
    below, found = dict.fromkeys(widest, 0), dict.fromkeys(widest, 0)
    along = F.coalesce(*[F.when(F.col("node") == n, F.col(f"p_{d}")) for n, d in widest.items()])
    placed = here.select("node", "size", along.alias("place"))
    for shift in range(2 * PLACE_BITS - STEP_BITS, -1, -STEP_BITS):
        prefix = F.shiftright("place", shift + STEP_BITS)
        inside = F.coalesce(*[F.when(F.col("node") == n, prefix == at) for n, at in found.items()])
        step = F.shiftright("place", shift).bitwiseAND((1 << STEP_BITS) - 1)
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in placed.where(inside).groupBy("node", step.alias("step")).agg(F.sum("size").alias("bytes")).collect():
            sums.setdefault(r["node"], []).append((r["step"], r["bytes"]))
        for node, steps in sums.items():
            steps.sort()
            for at, (s, b) in enumerate(steps):
                if below[node] + b >= wanted[node] or at == len(steps) - 1:
                    found[node] = (found[node] << STEP_BITS) + s
                    # At the last pass a step is one place; it goes to the nearer side.
                    if shift == 0 and below[node] + b / 2 > wanted[node]:
                        found[node] -= 1
                    break
                below[node] += b
    return {n: (widest[n.first], found[n.first]) for n in known}


def _with_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Cut level by level; the nodes of a level are worked on together. ``node`` ends as the number of the shard."""
    rows = settle(rows.withColumn("node", F.lit(0)))
    level = [_Node(0, shards)]
    while level := [n for n in level if n.shards > 1]:
        cuts = _cut_level(rows, level)
        moved = [F.when((F.col("node") == n.first) & (F.col(f"p_{d}") > place), _halves(n)[1].first) for n, (d, place) in cuts.items()]
        rows = settle(rows.withColumn("node", F.coalesce(*moved, "node")))
        level = [half for n in cuts for half in _halves(n)]
    return rows


def sharded(
    docs: DataFrame,
    shards: int = SHARDS,
    id_name: str = "doc_id",
    text_name: str = "text",
    source_name: str = "source",
    lang_name: str = "lang",
) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the bytes of its shard.

    Every node of the tree is cut along the dimension (source, language, size, id) in which its rows lie farthest
    apart, where the bytes on both sides are as its numbers of shards. Equal places are told apart by a hash of id
    and text, and rows that repeat both by their number, so any one value or row may hold most of the table.
    The law is ``bytes``: shards differ by about one document. Slots number the rows of a shard without gaps, in
    groups whose sizes are summed up first. Null texts have 8 bytes; null ids are placed like others; a text of any
    length counts with all its bytes, and one longer than a shard leaves others short; an empty table gives an empty result.
    """
    rows = _with_shards(_places(settle(_measured(docs, id_name, text_name, source_name, lang_name))), shards)
    total = rows.count()
    placed = rows.select("doc_id", "size", "text_crc32", "tie", F.col("node").alias("shard"))
    groups = max(1, total // (shards * GROUP_ROWS))
    part = F.pmod(F.shiftright("tie", PLACE_BITS), F.lit(groups)).cast("int")
    placed = settle(placed.withColumn("part", part))
    sizes = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    upto = Window.partitionBy("shard").orderBy("part")
    starts = sizes.select(
        "shard",
        "part",
        (F.sum("rows").over(upto) - F.col("rows")).alias("start"),
        F.sum("bytes").over(Window.partitionBy("shard")).alias("shard_bytes"),
    )
    inside = Window.partitionBy("shard", "part").orderBy("tie", F.asc_nulls_first("doc_id"), "size")
    numbered = placed.withColumn("place", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("place") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "shard_bytes",
    )
