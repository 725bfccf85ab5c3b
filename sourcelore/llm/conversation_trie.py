"""Prefix trie of conversations: whole sequences collapse first, then the prefixes of those that are left are weighed.

A prefix is known by its depth and two 64-bit words, the exclusive or of one hash per (turn, place): prefixes of one depth
that differ share them with a chance of 2^-128. The exclusive or of a prefix without its last turn is the parent's, and that
of all turns names the whole sequence, in whatever order the turns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelore.llm.common import column, settle
from sourcelore.operators.joins import attach

#: Turns of a conversation that are summed up in one task; what lies before them comes from the sums of such stretches.
STRETCH = 1024
#: Conversations of a family share up to REACH - 1 turns of the one whose id is divisible by FAMILY.
FAMILY, REACH = 5, 9
NODE = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, place from 0, turn_hash, bytes) of conversations with an id; null role or text is empty.

    Order: turn (null first), then role, then text, so that rows that are equal in all of these are interchangeable.
    A conversation may be dealt over many tasks: places are counted within sorted ranges of rows and what lies in the
    ranges before is added.
    """
    role, text = (F.coalesce(column(name), F.lit("")) for name in ("role", "text"))
    turns = conversations.where(column("conv_id").isNotNull()).select(
        column("conv_id").alias("conv_id"), column("turn").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row")
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    spread = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = settle(
        spread.select(
            "conv_id",
            F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).alias("turn_hash"),
            F.octet_length("text").cast("long").alias("bytes"),
            F.spark_partition_id().alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    within = Window.partitionBy("conv_id", "block").orderBy("row")
    blocks = spread.groupBy("conv_id", "block").count()
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("conv_id", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    places = spread.withColumn("place", F.row_number().over(within) - 1)
    return attach(places, offsets, ["conv_id", "block"]).select("conv_id", (F.col("place") + F.col("offset")).alias("place"), "turn_hash", "bytes")


def reach(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % REACH


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations: the first h of the family's first conversation, then the own ones after the first h."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    members = sizes.select("conv_id", base.alias("base"), reach(F.col("conv_id")).alias("reach"))
    bases = sizes.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), "size")
    shifts = attach(members, bases, ["base"], "left").select(
        "conv_id", "reach", F.least("reach", F.coalesce("size", F.lit(0))).alias("shared")
    )
    own = attach(turns, shifts, ["conv_id"]).where(F.col("place") >= F.col("reach"))
    own = own.select("conv_id", (F.col("place") - F.col("reach") + F.col("shared")).alias("place"), "turn_hash", "bytes")
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < REACH - 1)).withColumnRenamed("conv_id", "base")
    # A family has at most five conversations and a head at most eight turns.
    given = heads.join(members, "base").where(F.col("place") < F.col("reach")).select("conv_id", "place", "turn_hash", "bytes")
    return own.unionByName(given)


def _digests(members: DataFrame) -> DataFrame:
    """Members (depth, k1, k2, conv_id) with equal keys as one row: smallest conv_id, their number and the digest of their ids.

    Rows are sorted by Spark, which spills, and read as they come: a digest is made step by step, and however many members
    a sequence has, no list of them is held.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, smallest, weight, state = None, None, 0, None
        done: list[tuple] = []

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(values), kind) for values, kind in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done.clear()
            return out

        for batch in batches:
            depths, k1, k2, ids = (batch.column(i).to_pylist() for i in range(4))
            for found, conv_id in zip(zip(depths, k1, k2, strict=True), ids, strict=True):
                if found != key:
                    if key is not None:
                        done.append((*key, smallest, weight, state.hexdigest()))
                    key, smallest, weight, state = found, conv_id, 1, hashlib.sha256(b"%d" % conv_id)
                else:
                    weight += 1
                    state.update(b",%d" % conv_id)
            if done:
                yield emit()
        if key is not None:
            done.append((*key, smallest, weight, state.hexdigest()))
            yield emit()

    names = [*NODE, "conv_id", "weight", "ends_sha256"]
    kinds = [pa.int64()] * 5 + [pa.string()]
    schema = T.StructType([T.StructField(name, T.StringType() if name == "ends_sha256" else T.LongType()) for name in names])
    by_key = members.select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    return by_key.mapInArrow(convert, schema)


def _words(*parts) -> tuple[Column, Column]:
    """Two independent 64-bit hashes."""
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def _before(rows: DataFrame, key: str, values: list[str], merge, first: bool) -> DataFrame:
    """Per row what ``merge`` makes of the values of its key up to this place (``first``) or from it on, in columns ``so_far_…``.

    Each stretch of a key is a window of its own, and what lies beyond it comes from the totals of the stretches.
    """
    cut = rows.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    turned = (lambda name: F.col(name)) if first else (lambda name: -F.col(name))
    within = Window.partitionBy(key, "stretch").orderBy(turned("depth")).rowsBetween(Window.unboundedPreceding, 0)
    others = Window.partitionBy(key).orderBy(turned("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(key, "stretch").agg(*[merge(F.col(v)).alias(v) for v in values])
    beyond = totals.select(key, "stretch", *[F.coalesce(merge(F.col(v)).over(others), F.lit(0)).alias(f"beyond_{v}") for v in values])
    local = cut.select("*", *[merge(F.col(v)).over(within).alias(f"local_{v}") for v in values])
    together = attach(local, beyond, [key, "stretch"])
    both = (lambda v: F.col(f"local_{v}").bitwiseXOR(F.col(f"beyond_{v}"))) if merge is F.bit_xor else (lambda v: F.col(f"local_{v}") + F.col(f"beyond_{v}"))
    return together.select(*rows.columns, *[both(v).alias(f"so_far_{v}") for v in values])


def prefix_trie(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The nodes of the trie over sequences of turns given as (conv_id, place, turn_hash, bytes).

    ``ids`` (conv_id) names all conversations, so that those without a turn are members of the root too. Per node: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No conversations, no node.

    A node is owned by its smallest member, so a conversation owns a chain of nodes down to its end, and the nodes below a
    node are the rest of its owner's chain and all chains of the other sequences that run through it. Sums over subtrees are
    therefore sums over the sequences of a node, not over pairs of nodes.
    """
    ids = (ids if ids is not None else conversations).select("conv_id").distinct()
    t1, t2 = _words("turn_hash", "place")
    terms = conversations.select("conv_id", (F.col("place") + 1).alias("depth"), t1.alias("t1"), t2.alias("t2"), "bytes")
    whole = terms.groupBy("conv_id").agg(F.count("*").alias("depth"), F.bit_xor("t1").alias("k1"), F.bit_xor("t2").alias("k2"))
    none = F.lit(0).cast("long")
    members = attach(ids, whole, ["conv_id"], "left").select("conv_id", *[F.coalesce(name, none).alias(name) for name in NODE])
    sequences = settle(_digests(members))

    # Only one conversation of each sequence goes on, with the number of its copies.
    kept = attach(terms, sequences.select("conv_id", "weight"), ["conv_id"])
    deep = _before(kept, "conv_id", ["t1", "t2"], F.bit_xor, first=True).select(
        "conv_id",
        "weight",
        "depth",
        F.col("so_far_t1").alias("k1"),
        F.col("so_far_t2").alias("k2"),
        F.col("so_far_t1").bitwiseXOR(F.col("t1")).alias("p1"),
        F.col("so_far_t2").bitwiseXOR(F.col("t2")).alias("p2"),
        "bytes",
    )
    root = sequences.select("conv_id", "weight", none.alias("depth"), none.alias("k1"), none.alias("k2"), *[F.lit(None).cast("long").alias(p) for p in ("p1", "p2")], none.alias("bytes"))
    prefixes = settle(deep.unionByName(root))

    nodes = prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
    )
    nodes = settle(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")))
    parents = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    parents = parents.agg(F.count("*").alias("n_children"))

    # Sequences that are no proper prefix of another one are the leaves.
    leaves = sequences.join(parents, NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    chains = nodes.groupBy("conv_id").agg(F.sum("saved").alias("chain"))
    rests = _before(nodes.select("conv_id", "depth", "saved"), "conv_id", ["saved"], F.sum, first=False)
    per_sequence = attach(attach(sequences.select("conv_id"), leaves, ["conv_id"], "left"), chains, ["conv_id"], "left")
    through = attach(prefixes.select("conv_id", *NODE), per_sequence, ["conv_id"])
    sums = through.groupBy(*NODE).agg(F.coalesce(F.sum("leaf"), none).alias("n_leaves"), F.coalesce(F.sum("chain"), none).alias("chains"))

    own = attach(rests.withColumnRenamed("so_far_saved", "rest").drop("saved"), chains, ["conv_id"])
    found = nodes.join(sums, NODE).join(parents, NODE, "left").join(sequences.select(*NODE, "ends_sha256"), NODE, "left")
    found = attach(found, own, ["conv_id", "depth"])
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return attach(found, above, ["depth", "p1", "p2"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", none).alias("n_children"),
        "n_leaves",
        (F.col("chains") - F.col("chain") + F.col("rest")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie over the rebuilt conversations; rows without conv_id take no part, whatever columns else there are."""
    turns = numbered(conversations)
    turns = settle(turns)
    return prefix_trie(rebuilt(turns), turns)


TRIE_SQL = """
WITH given AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
    md5(concat(cast(strlen(coalesce(role, '')) AS varchar), ':', coalesce(role, ''), coalesce(text, ''))) AS t, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, n, ((4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda a, d: list_reduce(list_prepend(xor(a, d), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 9) AS h
  FROM (SELECT c, count(*) AS n FROM given GROUP BY c)),
rebuilt AS (
  SELECT k.c, g.i, g.t, g.b FROM ids k JOIN given g ON g.c = k.c - k.c % 5 AND g.i < k.h
  UNION ALL
  SELECT k.c, g.i - k.h + least(k.h, coalesce(f.n, 0)), g.t, g.b FROM ids k JOIN given g ON g.c = k.c AND g.i >= k.h LEFT JOIN ids f ON f.c = k.c - k.c % 5),
paths AS (
  SELECT c, i + 1 AS d, string_agg(t, '') OVER (PARTITION BY c ORDER BY i) AS path, b FROM rebuilt
  UNION ALL SELECT c, 0, '', 0 FROM ids),
nodes AS (
  SELECT d, path, min(c) AS c, count(*) AS n, (count(*) - 1) * min(b) AS saved, left(path, greatest(strlen(path) - 32, 0)) AS parent FROM paths GROUP BY d, path),
childless AS (SELECT path FROM nodes a WHERE NOT EXISTS (SELECT 1 FROM nodes b WHERE b.d = a.d + 1 AND b.parent = a.path)),
below AS (
  SELECT DISTINCT a.path AS top, b.path AS path FROM paths a JOIN paths b ON a.c = b.c AND b.d >= a.d),
sums AS (
  SELECT top, sum(n.saved) AS saved, count(l.path) AS leaves FROM below JOIN nodes n USING (path) LEFT JOIN childless l USING (path) GROUP BY top),
ends AS (
  SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, max_by(path, d) AS path FROM paths GROUP BY c) GROUP BY path)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs,
  (SELECT count(*) FROM nodes x WHERE x.d = n.d + 1 AND x.parent = n.path) AS n_children, s.leaves AS n_leaves,
  cast(s.saved AS bigint) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.top = n.path LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.parent LEFT JOIN ends e ON e.path = n.path
"""
