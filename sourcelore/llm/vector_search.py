"""Exact top-k by inner product with a vector-approximation file.

A scan of one-byte cells bounds every score from both sides; exact vectors are then read in the order of
their bounds until no other vector can reach the k best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelore.llm.common import column, settle

SCALE = 1024
K = 10
QUERY_EVERY = 100
CELLS = 256
#: Blocks that meet in one task: so many distinct vectors' cells, so many queries.
VECTOR_BLOCK, QUERY_BLOCK = 1 << 15, 1 << 11
#: Exact vectors read first, as a multiple of k.
FIRST_READ = 3


def scaled(vector: Column) -> Column:
    """Whole-number components, or null where a component is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return F.when(vector.isNotNull() & ~bad, numbers)


def _score(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda total, x: total + x)


def _bounds(k: int, low: float, width: float):
    """Candidates of one block of queries in one block of cells."""

    def scan(queries: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "rep", "upper", "floor"]
        if queries.empty or cells.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64" if n in ("query", "rep") else "float64") for n in names})
        codes = np.stack(cells["cells"].to_numpy()).astype(np.float64)
        least = low + codes * width
        most = least + (width - 1)
        reps, ids, alone = cells["rep"].to_numpy(), cells["least_id"].to_numpy(), cells["copies"].to_numpy() == 1
        out = []
        for start in range(0, len(queries), 64):
            part = queries.iloc[start : start + 64]
            q = np.stack(part["numbers"].to_numpy()).astype(np.float64)
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            upper = most @ up.T + least @ down.T
            lower = least @ up.T + most @ down.T
            # For rounding; a query of zeros has no other score than 0.
            slack = (1e-9 * (np.abs(most) @ up.T - np.abs(least) @ down.T) + 1) * q.any(axis=1)
            for j, query in enumerate(part["query"]):
                # A vector that only the query itself has is no candidate.
                open_ = ~(alone & (reps == query))
                high, sure, who = upper[open_, j] + slack[open_, j], lower[open_, j] - slack[open_, j], reps[open_]
                if not len(who):
                    continue
                floor = np.partition(sure, -k)[-k] if len(sure) >= k else -np.inf
                keep = high >= floor
                # Who can do no more than equal the floor needs one of the smallest ids; one of them may be the query's own.
                rivals = np.sort(ids[open_][sure >= floor])
                if len(rivals) > k:
                    keep &= (high > floor) | (ids[open_] <= rivals[k])
                out.append(pd.DataFrame({"query": query, "rep": who[keep], "upper": high[keep], "floor": floor}))
        return pd.concat(out)[names] if out else scan(queries.iloc[:0], cells)

    return lambda _, queries, cells: scan(queries, cells)


def top_k(
    vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, id_name: str = "vec_id", vector_name: str = "embedding"
) -> DataFrame:
    """For each row whose id is divisible by ``query_every`` its k best other rows: query_id, rank, vec_id, score.

    Scores are inner products of components floor(1024 * x); ties go to the smaller id. Rows with a null id, a null
    vector or a null or non-finite component take no part; vectors are compared with those of their own length
    (the empty one with empty ones, at score 0). Rows that share an id are rows of their own, as queries and as
    candidates: each is a candidate of the other, and a repeated query id has as many results as rows.
    Scores beyond a 64-bit number are an error. An empty table gives an empty result.

    Equal vectors are looked at once: they have equal scores, so only their k + 1 smallest ids can be in a result.
    Cells and queries meet in blocks, so that no task holds a part of the table that grows with it.
    """
    named = vectors.select(column(id_name).cast("long").alias("vec_id"), scaled(column(vector_name)).alias("numbers"))
    rows = named.where(F.col("vec_id").isNotNull() & F.col("numbers").isNotNull())
    rows = settle(rows.select("*", F.size("numbers").alias("width"), F.monotonically_increasing_id().alias("row")))
    queries = rows.where(F.col("vec_id") % query_every == 0).withColumnsRenamed({"vec_id": "query_id", "row": "query"})

    by_vector = Window.partitionBy("numbers").orderBy("vec_id", "row")
    firsts = rows.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    classes = settle(
        firsts.groupBy("numbers", "width")
        .agg(F.count(F.lit(1)).alias("copies"), F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("members"))
        .select("*", F.get("members", F.lit(0))["row"].alias("rep"), F.get("members", F.lit(0))["vec_id"].alias("least_id"))
    )
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min("numbers")).alias("low"), F.max(F.array_max("numbers")).alias("high")).first()
    low, high = facts["low"] or 0, facts["high"] or 0
    width = (high - low) // CELLS + 1
    vector_blocks = facts["n"] // VECTOR_BLOCK + 1
    query_blocks = queries.count() // QUERY_BLOCK + 1

    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = classes.select(
        "rep", "least_id", "copies", "width", F.transform("numbers", lambda x: F.floor((x - low) / width).cast("short")).alias("cells"), block("rep", vector_blocks).alias("vb")
    ).withColumn("qb", every(query_blocks))
    asked = queries.select("query", "numbers", "width", block("query", query_blocks).alias("qb")).withColumn("vb", every(vector_blocks))
    keys = ["width", "vb", "qb"]
    bounded = (
        asked.groupBy(*keys)
        .cogroup(cells.groupBy(*keys))
        .applyInPandas(_bounds(k, float(low), float(width)), "query long, rep long, upper double, floor double")
    )
    bounded = settle(bounded)
    floors = bounded.groupBy("query").agg(F.max("floor").alias("floor"))
    hopeful = bounded.drop("floor").join(floors, "query").where(F.col("upper") >= F.col("floor"))
    best_first = Window.partitionBy("query").orderBy(F.desc("upper"), "rep")
    hopeful = hopeful.select("query", "rep", "upper", F.row_number().over(best_first).alias("turn"))

    def exact(candidates: DataFrame) -> DataFrame:
        with_query = candidates.join(queries.select("query", "query_id", F.col("numbers").alias("q")), "query")
        read = with_query.join(classes.select("rep", "members", F.col("numbers").alias("v")), "rep")
        return read.select("query", "query_id", "members", "turn", _score(F.col("q"), F.col("v")).alias("score"))

    first = settle(exact(hopeful.where(F.col("turn") <= FIRST_READ * k)))
    # The query's own row is one candidate too many of one class at most, so k + 1 classes have k candidates.
    by_score = Window.partitionBy("query").orderBy(F.desc("score"))
    certain = first.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k + 1).select("query", F.col("score").alias("kth"))
    rest = hopeful.where(F.col("turn") > FIRST_READ * k).join(certain, "query", "left")
    second = exact(rest.where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))))
    found = first.unionByName(second).select("query", "query_id", "score", F.inline("members")).where(F.col("row") != F.col("query"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
with vectors as (
    select vec_id, row_number() over () as place, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as numbers from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
    select q.vec_id as query_id, q.place, v.vec_id as vec_id,
           list_sum(list_transform(range(1, len(q.numbers) + 1), lambda i: q.numbers[i] * v.numbers[i]))::bigint as score
    from vectors q join vectors v on q.vec_id % 100 = 0 and q.place <> v.place and len(q.numbers) = len(v.numbers)
)
select query_id, (row_number() over (partition by place order by score desc, vec_id))::int as rank, vec_id, score
from scores
qualify rank <= 10
"""
