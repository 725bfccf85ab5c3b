"""Secrets in texts, told apart by how many repositories and owners share them; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelore.llm.common import column, settle, text_of

#: Fixed values, in order: kind, pattern, group that holds the value, smallest length of that group.
ASSIGN = """(?i)(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
#: What else may be a credential: long mixed tokens. They become spans only if they belong to one owner.
TOKEN = ("owned", "[A-Za-z0-9+/_-]{20,}", 0, 20)
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
#: A value found in so many repositories is an example that was copied.
WIDE = 3
KINDS = tuple(kind for kind, *_ in (*BASE_KINDS, TOKEN))


def _matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind with the lengths of what lies before each; their places follow by adding up.

    Lengths count code points. The pieces between matches come from the same leftmost scan as the matches. The two
    patterns with a least length match just the runs whose whole length suffices, so nothing fails afterwards.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.transform(
        F.arrays_zip(found.alias("found"), values.alias("value"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap")),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("place"),
            F.length(m["gap"]).cast("long").alias("gap"),
            F.length(m["found"]).cast("long").alias("length"),
            m["value"].alias("value"),
            (F.length(m["value"]) >= least).alias("long_enough"),
        ),
    )
    return F.when(text.rlike(pattern), rows).otherwise(F.array())


def candidates(docs: DataFrame, id_name: str, text_name: str, repository_name: str, owner_name: str) -> DataFrame:
    """Rows (row, doc_id, repository, owner, kind, start, stop, value); one with a null kind for each document."""
    text = text_of(text_name)
    kinds = [_matches(text, *kind) for kind in (*BASE_KINDS, TOKEN)]
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        column(id_name).alias("doc_id"),
        F.coalesce(column(repository_name).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(column(owner_name).cast("string"), F.lit("")).alias("owner"),
        F.concat(*kinds).alias("all"),
    )
    found = numbered.select("row", "doc_id", "repository", "owner", F.explode_outer("all").alias("m"))
    # Written once: the numbers of the rows must be the same wherever they are read.
    found = settle(found.select("row", "doc_id", "repository", "owner", "m.*"))
    upto = Window.partitionBy("row", "kind").orderBy("place")
    stop = F.sum(F.col("gap") + F.col("length")).over(upto)
    some = found.where(F.col("kind").isNotNull()).withColumn("stop", stop).where("long_enough")
    some = some.select("row", "doc_id", "repository", "owner", "kind", (F.col("stop") - F.col("length")).alias("start"), "stop", "value")
    mixed = F.lit(True)
    for pattern in MIXED:
        mixed = mixed & F.col("value").rlike(pattern)
    some = some.where((F.col("kind") != TOKEN[0]) | mixed)
    # Tokens that overlap a base span say nothing new.
    base = F.col("kind") != TOKEN[0]
    in_order = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("stop"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(in_order.rowsBetween(1, Window.unboundedFollowing))
    overlaps = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("stop"), F.lit(False))
    some = some.withColumn("clear", base | ~overlaps).where("clear").drop("clear")
    every = docs_of(found)
    return some.unionByName(every, allowMissingColumns=True)


def docs_of(found: DataFrame) -> DataFrame:
    """One row per document, whether something was found in it or not."""
    return found.where(F.col("kind").isNull() | (F.col("place") == 0)).select("row", "doc_id", "repository", "owner").distinct()


def ownership(found: DataFrame) -> DataFrame:
    """Per hash of a value: in how many distinct repositories and of how many distinct owners it is."""
    values = found.where(F.col("kind").isNotNull())
    pairs = values.groupBy("value_hash", "repository", "owner").agg(F.count(F.lit(1)).alias("times"))
    return pairs.groupBy("value_hash").agg(
        F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"), F.sum("times").alias("times")
    )


def _spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["stop"])), ",")


def secrets(
    docs: DataFrame,
    id_name: str = "doc_id",
    text_name: str = "text",
    repository_name: str = "source",
    owner_name: str = "source",
    wide: int = WIDE,
) -> DataFrame:
    """One row per document: numbers of base spans by kind, their digest, all spans, and how they were judged.

    ``spans`` holds the base spans and, as kind ``owned``, long mixed tokens that one owner alone has. Of all spans,
    ``n_owned`` are of one owner (live-looking), ``n_example`` are in ``wide`` repositories or more. Null texts count
    as empty; a null repository or owner counts as one of its own named ''; repeated rows give repeated results;
    an empty table gives none.
    """
    found = candidates(docs, id_name, text_name, repository_name, owner_name).withColumn("value_hash", F.sha2("value", 256)).drop("value")
    judged = found.join(ownership(found), "value_hash", "left")
    number = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(n)) for n, kind in enumerate(KINDS, 1)])
    base = F.col("kind").isin([kind for kind, *_ in BASE_KINDS])
    owned = F.col("owners") == 1
    span = F.struct("start", number.alias("kind"), "stop")
    count = lambda what: F.coalesce(F.sum(F.when(what, 1)), F.lit(0)).cast("long")
    # A row with a null kind stands for the document itself.
    per_row = judged.groupBy("row", "doc_id").agg(
        *[count(F.col("kind") == kind).alias(f"n_{kind}") for kind, *_ in BASE_KINDS],
        F.sort_array(F.collect_list(F.when(base, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(base | owned, span))).alias("all"),
        count(owned).alias("n_owned"),
        count(F.col("repositories") >= wide).alias("n_example"),
    )
    return per_row.select(
        "doc_id",
        *[f"n_{kind}" for kind, *_ in BASE_KINDS],
        F.sha2(_spans(F.col("base")), 256).alias("base_sha256"),
        _spans(F.col("all")).alias("spans"),
        "n_owned",
        "n_example",
    )


def _sql_kind(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    options = ", 'i'" if pattern.startswith("(?i)") else ""
    pattern = pattern.removeprefix("(?i)")
    split = f"string_split_regex(content, '{pattern}'{options})"
    return f"""
    select row, doc_id, source, {number} as kind, i, len(gaps[i]) as gap, len(found[i]) as length, value[i] as value, len(value[i]) >= {least} as long_enough
    from (select *, unnest(range(1, len(found) + 1)) as i from (
        select row, doc_id, source, {split} as gaps, regexp_extract_all(content, '{pattern}', 0{options}) as found,
               regexp_extract_all(content, '{pattern}', {group}{options}) as value from texts))"""


SECRETS_SQL = f"""
with texts as (
    select row_number() over () as row, doc_id, coalesce(source, '') as source, coalesce(text, '') as content from documents
), matches as ({" union all ".join(_sql_kind(n, *kind) for n, kind in enumerate((*BASE_KINDS, TOKEN), 1))}
), placed as (
    select *, sum(gap + length) over (partition by row, kind order by i)::bigint as stop from matches
), long_ones as (
    select row, doc_id, source, kind, stop - length as start, stop, value from placed
    where long_enough and (kind < 4 or (regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[a-z]')))
), spans as (
    select * from long_ones a where kind < 4 or not exists (
        select 1 from long_ones b where b.row = a.row and b.kind < 4 and b.start < a.stop and a.start < b.stop)
), owners as (
    select value, count(distinct source) as owners from spans group by value
), judged as (
    select s.*, o.owners, (['assign', 'access', 'hex', 'owned'])[kind] || ':' || start || ':' || stop as span
    from spans s join owners o on s.value = o.value
), per_row as (
    select row, count(*) filter (kind = 1) as n_assign, count(*) filter (kind = 2) as n_access, count(*) filter (kind = 3) as n_hex,
           string_agg(span, ',' order by start, kind) filter (kind < 4) as base,
           string_agg(span, ',' order by start, kind) filter (kind < 4 or owners = 1) as spans,
           count(*) filter (owners = 1) as n_owned, count(*) filter (owners >= {WIDE}) as n_example
    from judged group by row
)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       coalesce(n_owned, 0) as n_owned, coalesce(n_example, 0) as n_example
from texts t left join per_row p on t.row = p.row
"""
