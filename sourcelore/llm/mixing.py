"""Mix sources to target weights by Pareto order sampling, with built-in functions only.

Every document is taken floor(rate) times for certain, rate being its source's target over its size. The rest
of the target is filled by a sample with odds in proportion to size, where documents whose share would be one or
more come first: documents are ranked by the odds of a random number divided by their inclusion odds, and taken in
that order until the words wanted would be passed. Then the order is followed on, past documents that are too long
for what is left, and at last the one document that fits best closes the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelore.llm.common import column, packed, settle
from sourcelore.operators.joins import attach

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
#: Ranks are cut into this many even steps, to find where a source's sample ends.
STEPS = 4096
#: So often the order is followed until the words left would be passed.
FILLS = 3
#: Facts of sources are sent to every executor while they are known to have no more bytes than this.
BROADCAST_BYTES = 16 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def random_of(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on seed and key alone."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10)
    return (drawn.cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) with target: shares of the total by weight, stopped at max_repeats sizes.

    Weights repeat along the sources in order of their names, null last. What a stopped source leaves over goes
    to the others by weight until none is above: sources are filled in order of cap over weight, and the level
    at which the first one no longer stops holds for all that follow.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    capped = weighed.withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, whole = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = capped.select(
        "source",
        "source_size",
        "weight",
        "cap",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    level = F.col("left") / F.col("weight_left")
    levels = sums.withColumn("level", F.max(F.when(F.col("cap") >= F.col("weight") * level, level)).over(whole))
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with the facts of their source. ``facts`` has been written, so that its size can be asked."""
    held = facts.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 256)).first()[0] or 0
    if held > BROADCAST_BYTES:
        return attach(rows, facts, ["source"])
    named = F.broadcast(facts.withColumnRenamed("source", "_source"))
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def _wanted() -> Column:
    """Words that the sample of a source is to have."""
    return F.col("target") - F.floor(_rate()) * F.col("source_size")


def _pareto() -> Column:
    """Rank in [0, 1]: q / (1 + q), where q is the odds of the random number over the inclusion odds."""
    p = F.least(F.lit(1.0), F.col("factor") * F.col("size"))
    u = F.col("random")
    return F.when(p > 0, u * (1 - p) / (u * (1 - p) + (1 - u) * p)).otherwise(F.lit(1.0))


def _step() -> Column:
    return F.least(F.floor(F.col("rank") * STEPS), F.lit(STEPS - 1)).cast("int")


_ORDER = ("rank", "id", "digest")


def _measured(docs: DataFrame, id_name: str, text_name: str, source_name: str) -> list[Column]:
    text, key = column(text_name), column(id_name)
    return [
        column(source_name).alias("source"),
        F.coalesce(key.cast("long"), F.lit(-1)).alias("id"),
        F.md5(F.coalesce(text, F.lit(""))).alias("digest"),
        word_count(text).alias("size"),
        random_of(key).alias("random"),
    ]


def odds_factors(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, factor): inclusion odds are the lesser of 1 and factor times size, and sum up to the words wanted.

    From the largest size down, sizes whose share would be one or more are certain; the first that is not
    gives the factor. Only the numbers of documents by size are looked at. No factor where no sample is wanted.
    """
    sampled = targets.where(_rate() > F.floor(_rate())).select("source", _wanted().alias("wanted"))
    by_size = measured.where(F.col("size") > 0).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    sums = attach(by_size, sampled, ["source"]).select(
        "source",
        "size",
        (F.col("wanted") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger), F.lit(0))).alias("left"),
        F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")).over(up_to).alias("squares"),
    )
    uncertain = sums.where(F.col("left") * F.col("size") < F.col("squares"))
    return uncertain.groupBy("source").agg(F.max_by(F.col("left") / F.col("squares"), "size").alias("factor"))


def _order() -> Column:
    return F.struct(*_ORDER)


def _open() -> Column:
    """Whether a document comes after the place reached and is not too long for what is left."""
    return (F.col("after").isNull() | (_order() > F.col("after"))) & (F.col("size") <= F.col("gap"))


def _filled(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """Follow the order until the words left would be passed; ``state`` is (source, after, gap, fills).

    Sums per step of the rank show in which step that happens; only the documents of that one step are put in order.
    """
    open_ = _with_facts(ranked, state.drop("fills")).where(_open())
    upto = Window.partitionBy("source").orderBy("step")
    steps = open_.groupBy("source", "step", "gap").agg(F.sum("size").alias("words"))
    steps = steps.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    last = steps.where(F.col("before") < F.col("gap")).groupBy("source").agg(F.max("before").alias("before"), F.max("step").alias("last_step"))
    last = settle(last)
    inside = _with_facts(open_, last).where(F.col("step") == F.col("last_step"))
    units = inside.groupBy("source", "gap", "before", *_ORDER).agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy(*_ORDER)
    taken = units.withColumn("reached", F.col("before") + F.sum("words").over(so_far)).where(F.col("reached") <= F.col("gap"))
    ends = taken.groupBy("source").agg(F.max(_order()).alias("end"), F.max("reached").alias("reached"))
    known = attach(attach(state, last, ["source"], "left"), ends, ["source"], "left")
    # Where no document of the last step is taken, the end lies at its beginning.
    begin = F.struct((F.col("last_step") / STEPS).alias("rank"), F.lit(-(1 << 63)).cast("long").alias("id"), F.lit("").alias("digest"))
    end = F.coalesce("end", F.when(F.col("last_step").isNotNull(), begin))
    fill = F.struct("after", "gap", end.alias("end"))
    return settle(
        known.select(
            "source",
            F.coalesce(end, "after").alias("after"),
            (F.col("gap") - F.coalesce("reached", "before", F.lit(0))).alias("gap"),
            F.concat("fills", F.array(fill)).alias("fills"),
        )
    )


def _in_order() -> Column:
    """Whether one of the fills of its source takes a document."""
    inside = lambda f: (f["after"].isNull() | (_order() > f["after"])) & (F.col("size") <= f["gap"]) & (_order() <= f["end"])
    return F.coalesce(F.exists("fills", inside), F.lit(False)) & (F.col("size") > 0)


def sample_ends(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: source_size, target, factor, the fills (from which place, for how many words, to which place its
    sample takes documents) and the place of the one that it takes besides (null: none).

    Of the documents left the one is added that leaves the smallest miss.
    """
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(sizes, weights, max_repeats))
    facts = settle(attach(targets, odds_factors(measured, targets), ["source"], "left"))
    # A source without a remainder has no sample.
    sampled = facts.where(F.col("factor").isNotNull())
    ranked = _with_facts(measured.where(F.col("size") > 0), settle(sampled)).withColumn("rank", _pareto())
    ranked = settle(ranked.select("source", "size", _step().alias("step"), *_ORDER))
    nowhere = F.lit(None).cast("struct<rank: double, id: long, digest: string>")
    fills = F.array().cast("array<struct<after: struct<rank: double, id: long, digest: string>, gap: double, end: struct<rank: double, id: long, digest: string>>>")
    state = settle(sampled.select("source", nowhere.alias("after"), _wanted().alias("gap"), fills.alias("fills")))
    for _ in range(FILLS):
        state = _filled(ranked, state)

    left = _with_facts(ranked, state).where(~_in_order() & (F.col("size") < 2 * F.col("gap")))
    others = left.groupBy("source", "gap", *_ORDER).agg(F.sum("size").alias("words")).where(F.col("words") < 2 * F.col("gap"))
    best = others.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("words")).alias("miss"), *_ORDER)).alias("best"))
    besides = best.select("source", F.struct(*[F.col("best")[name].alias(name) for name in _ORDER]).alias("besides"))
    whole = attach(facts, state.select("source", "fills"), ["source"], "left")
    return settle(attach(whole, besides, ["source"], "left"))


def _copies() -> Column:
    """Certain copies and the sampled one, for rows with the columns of ``sample_ends``."""
    besides = F.col("besides").isNotNull() & _order().eqNullSafe(F.col("besides"))
    sampled = F.col("factor").isNotNull() & (F.col("size") > 0) & (_in_order() | besides)
    return (F.floor(_rate()) + sampled.cast("int")).cast("int")


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    id_name: str = "doc_id",
    text_name: str = "text",
    source_name: str = "source",
    keep_rows: bool = True,
) -> DataFrame:
    """The documents with size, source_size, target and copies (how often the mix takes them, 0 too).

    With ``keep_rows`` the document is in the struct ``row``, else only its id is. Null texts and
    texts without words have size 0 and are in no sample; a null source is a source of its own; rows that repeat id
    and text share one fate; a text longer than the words wanted is left out if others come nearer to them.
    Reruns give the same mix. An empty table gives an empty result.
    """
    fields = _measured(docs, id_name, text_name, source_name)
    measured = settle(docs.select(column(id_name).alias("doc_id"), *fields))
    ends = sample_ends(measured.drop("doc_id"), weights, max_repeats)
    rows = docs.select(packed(docs).alias("row"), *fields) if keep_rows else measured
    placed = _with_facts(rows, ends).withColumn("rank", _pareto())
    return placed.select("row" if keep_rows else "doc_id", "size", "source_size", "target", _copies().alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: size, its source's size and target, and the words the mix takes from it."""
    return mixed(docs, keep_rows=False).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, each as often as the mix takes it, with their own columns.

    A document without words adds nothing to a target, so it is taken floor(rate) times only.
    """
    taken = mixed(docs, **options).where(F.col("copies") > 0)
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select("row.*")


def _fill_sql(k: int) -> str:
    return f"""
), run{k} as (
    select *, sum(size) over (partition by source order by rank, id, digest range between unbounded preceding and current row) as upto
    from open{k} where size <= gap
), gap{k + 1} as (
    select g.source, g.gap - coalesce(max(r.upto) filter (r.upto <= g.gap), 0) as gap
    from gap{k} g left join run{k} r on g.source is not distinct from r.source group by g.source, g.gap
), open{k + 1} as (
    select r.source, r.rank, r.id, r.digest, r.size, g.gap
    from run{k} r join gap{k + 1} g on r.source is not distinct from g.source where r.upto > r.gap"""


MIX_SQL = """
with measured as (
    select doc_id, source, coalesce(doc_id, -1) as id, md5(coalesce(text, '')) as digest,
           coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
           (('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as random
    from documents
), sizes as (
    select source, sum(size)::bigint as source_size from measured group by source
), weighed as (
    select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, 3 * source_size as cap from sizes
), sums as (
    select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as open_size,
           sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as open_weight
    from weighed
), levels as (
    select *, max(case when cap >= weight * (open_size::double / open_weight::double) then open_size::double / open_weight::double end) over () as level from sums
), targets as (
    select source, source_size, least(cap::double, weight * level) as target from levels
), rated as (
    select m.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate
    from measured m join targets t on m.source is not distinct from t.source
), parts as (
    select *, rate - floor(rate) as p, target - floor(rate) * source_size as wanted from rated
), by_size as (
    select source, wanted, size, count(*) as n from parts where p > 0 and size > 0 group by all
), shares as (
    select source, size, wanted - coalesce(sum(n * size) over (partition by source order by size desc rows between unbounded preceding and 1 preceding), 0)::double as words_left,
           sum(n * size::double * size) over (partition by source order by size rows between unbounded preceding and current row) as squares
    from by_size
), factors as (
    select source, max_by(words_left / squares, size) as factor from shares where words_left * size < squares group by source
), odds as (
    select p.*, f.factor, least(1.0, coalesce(f.factor * p.size, 0.0)) as inclusion
    from parts p left join factors f on p.source is not distinct from f.source
), ranked as (
    select *, case when inclusion > 0 then random * (1 - inclusion) / (random * (1 - inclusion) + (1 - random) * inclusion) else 1.0 end as rank from odds
), gap0 as (
    select distinct source, wanted as gap from ranked where factor is not null
), open0 as (
    select source, rank, id, digest, size, wanted as gap from ranked where factor is not null and size > 0""" + "".join(map(_fill_sql, range(FILLS))) + """
), in_order as (
    """ + " union ".join(f"select source, rank, id, digest from run{k} where upto <= gap" for k in range(FILLS)) + """
), others as (
    select r.source, r.rank, r.id, r.digest, sum(r.size) as words
    from ranked r anti join in_order t on r.source is not distinct from t.source and r.rank = t.rank and r.id = t.id and r.digest = t.digest
    where r.factor is not null and r.size > 0 group by all
), besides as (
    select o.source, o.rank, o.id, o.digest
    from others o join gap""" + str(FILLS) + """ g on o.source is not distinct from g.source
    where o.words < 2 * g.gap
    qualify row_number() over (partition by o.source order by abs(g.gap - o.words), o.rank, o.id, o.digest) = 1
), sample as (
    select * from in_order union select * from besides
)
select doc_id, r.size, source_size, target, (r.size * (floor(rate) + case when s.id is not null then 1 else 0 end))::bigint as taken
from ranked r left join sample s on r.source is not distinct from s.source and r.rank = s.rank and r.id = s.id and r.digest = s.digest
"""
