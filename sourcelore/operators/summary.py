"""Per-file joins and repository-level aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.fixed import GENERIC_DIRECTORIES, RISK_STEPS


def _zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).cast("bigint").alias(name)


def enrich_files(
    facts: DataFrame,
    ownership: DataFrame,
    frequency: DataFrame | None,
    degrees: DataFrame,
    top_partners: DataFrame | None = None,
) -> DataFrame:
    """Facts with history, graph degrees and the strongest co-change partners of each file.

    Files without history are owned by ``Unknown`` and never change. Without ``frequency``
    it is taken from ``ownership``, as ``history.file_states`` gives both. Without
    ``top_partners`` (ranked, a few per file) every partner list is empty.
    """
    key = ["repo_id", "path"]
    joined = facts.join(ownership, key, "left")
    if frequency is not None:
        joined = joined.join(frequency.select(*key, "change_frequency"), key, "left")
    joined = joined.join(degrees, key, "left")
    enriched = joined.select(
        *facts.columns,
        F.coalesce("primary_author", F.lit("Unknown")).alias("primary_author"),
        _zero("total_commits"),
        _zero("contributor_count"),
        F.coalesce("change_frequency", F.lit(0.0)).alias("change_frequency"),
        _zero("incoming"),
        _zero("outgoing"),
    )
    return with_partners(enriched, top_partners)


def with_partners(enriched: DataFrame, top_partners: DataFrame | None = None) -> DataFrame:
    """Files with the list ``co_changed_files`` of their strongest partners (ranked, a few per file), instead of any they have."""
    key = ["repo_id", "path"]
    joined = enriched.drop("co_changed_files")
    partner = "array<struct<file:string,count:bigint,correlation:double>>"
    if top_partners is None:
        return joined.withColumn("co_changed_files", F.array().cast(partner))
    entry = F.struct("rank", "file", "count", "correlation")
    listed = top_partners.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("ranked"))
    listed = listed.select(
        *key,
        F.transform(
            "ranked",
            lambda p: F.struct(p["file"].alias("file"), p["count"].alias("count"), p["correlation"].alias("correlation")),
        ).alias("co_changed_files"),
    )
    return joined.join(listed, key, "left").withColumn(
        "co_changed_files", F.coalesce("co_changed_files", F.array().cast(partner))
    )


def on_every(repositories: DataFrame | None, table: DataFrame, counts: list[str]) -> DataFrame:
    """A table with one row per repository, with a row for each given repository that it lacks: ``counts`` are 0 there.

    Without ``repositories`` (repo_id) the table stays as it is.
    """
    if repositories is None:
        return table
    given = repositories.select("repo_id").distinct().join(table, "repo_id", "left")
    return given.select("repo_id", *[_zero(c) if c in counts else F.col(c) for c in table.columns if c != "repo_id"])


def total_files(files: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    return on_every(repositories, files.groupBy("repo_id").agg(F.count("*").alias("total_files")), ["total_files"])


def language_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id", "language").agg(
        F.count("*").alias("count"),
        F.sum("lines").cast("bigint").alias("total_lines"),
        F.sum("size").cast("bigint").alias("total_size"),
    )


def language_percentages(stats: DataFrame) -> DataFrame:
    """Share of each language in the lines of its repository, unrounded. One row per language goes in."""
    whole = F.sum("total_lines").over(Window.partitionBy("repo_id"))
    return stats.select(
        "repo_id", "language", "count", F.try_divide(F.col("total_lines") * 100.0, whole).alias("percentage")
    )


def contributor_stats(facts: DataFrame, authors: DataFrame) -> DataFrame:
    """Files owned and commits per author over the analysed files; a commit counts once per file."""
    analysed = authors.join(facts.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    return analysed.groupBy("repo_id", "author").agg(
        F.count_if((F.col("rank") == 1) & (F.col("author") != "Unknown")).alias("files_owned"),
        F.sum("commits").cast("bigint").alias("total_commits"),
    )


def risk_score(**measures: Column) -> Column:
    """Points of the five measures added up, 0 to 14. A missing measure gives none.

    Measures default to the columns of the same name.
    """
    total = F.lit(0)
    for name, steps in RISK_STEPS.items():
        value = measures.get(name, F.col(name))
        points = F.when(value > steps[0][0], steps[0][1])
        for above, score in steps[1:]:
            points = points.when(value > above, score)
        total = total + points.otherwise(0)
    return total.cast("bigint")


def with_risk(enriched: DataFrame) -> DataFrame:
    return enriched.withColumn("risk_score", risk_score())


def category(path: Column, incoming: Column) -> Column:
    """The first rule that fits the lowercased path; plain substrings, so ``latest.js`` is a test."""
    lowered = F.lower(path)
    name = paths.basename(lowered)

    def any_of(text: Column, *words: str) -> Column:
        return text.rlike("|".join(words))

    return (
        F.when(any_of(lowered, "test", "spec"), "tests")
        .when(name.contains("config") | name.isin("package.json", "tsconfig.json"), "config")
        .when(lowered.contains("readme") | name.endswith(".md"), "documentation")
        .when(any_of(name, "index", "main", "app"), "entryPoints")
        .when(any_of(name, "util", "helper") | any_of(lowered, "utils", "helpers"), "utilities")
        .when(incoming > 3, "core")
        .otherwise("utilities")
    )


def may_be(wanted: str) -> Column:
    """Whether a path alone leaves a category open. It follows from the category, and goes ahead of joins and texts."""
    return category(F.col("path"), F.lit(4 if wanted == "core" else 0)) == wanted


def categorize(files: DataFrame) -> DataFrame:
    return files.withColumn("category", category(F.col("path"), F.col("incoming")))


def category_counts(categorized: DataFrame) -> DataFrame:
    return categorized.groupBy("repo_id", "category").agg(F.count("*").alias("files"))


def feature_of(path: Column) -> Column:
    """First directory whose name says something about the content; null when there is none."""
    parts = F.split(path, "/")
    directories = F.slice(parts, F.lit(1), F.size(parts) - 1)
    telling = F.filter(directories, lambda s: (s != "") & ~F.lower(s).isin(GENERIC_DIRECTORIES))
    return F.get(telling, F.lit(0))


def feature_files(files: DataFrame) -> DataFrame:
    """One row per file that belongs to a feature."""
    return files.select("repo_id", feature_of(F.col("path")).alias("name"), "path").filter(F.col("name").isNotNull())


def features(files: DataFrame) -> DataFrame:
    """Features with their number of files; the files themselves are in ``feature_files``."""
    return feature_files(files).groupBy("repo_id", "name").agg(F.count("*").alias("file_count"))


def test_directories(categorized: DataFrame) -> DataFrame:
    """Directories that hold test files; ``.`` is the root."""
    folder = paths.dirname(F.col("path"))
    return (
        categorized.filter(may_be("tests") & (F.col("category") == "tests"))
        .select("repo_id", F.when(folder == "", ".").otherwise(folder).alias("directory"))
        .distinct()
    )


def config_files(categorized: DataFrame) -> DataFrame:
    return categorized.filter(F.col("category") == "config").select("repo_id", "path")


def overview(files: DataFrame, dead: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """Per repository: number of files, of unused files, and the languages in use (none where there is no file)."""
    # Languages are a handful per repository, so the set is small.
    per_repo = files.groupBy("repo_id").agg(
        F.count("*").alias("total_files"), F.array_sort(F.collect_set("language")).alias("languages")
    )
    unused = dead.groupBy("repo_id").agg(F.count("*").alias("dead_files"))
    rows = per_repo.join(unused, "repo_id", "left").select("repo_id", "total_files", _zero("dead_files"), "languages")
    no_languages = F.array().cast("array<string>")
    return on_every(repositories, rows, ["total_files", "dead_files"]).withColumn("languages", F.coalesce("languages", no_languages))


def risk_summary(scored: DataFrame, threshold: int = 5, repositories: DataFrame | None = None) -> DataFrame:
    """Number and mean score of the files at or above the threshold, and of the two worst bands.

    Given ``repositories`` without such a file have a row too, with no mean.
    """
    score = F.col("risk_score")
    rows = (
        scored.filter(score >= threshold)
        .groupBy("repo_id")
        .agg(
            F.count("*").alias("high_risk_files"),
            F.avg(score).alias("average_score"),
            F.count_if(score >= 10).alias("critical_files"),
            F.count_if((score >= 7) & (score < 10)).alias("high_files"),
        )
    )
    return on_every(repositories, rows, ["high_risk_files", "critical_files", "high_files"])
