"""From import strings to the files they name.

An import resolves to the first existing file among up to 23 spellings of its path. Those
spellings depend on the path only, so each distinct path is looked up once, however many
files import it; and instead of spelling every path 23 ways, each existing file lists the
(at most four) paths that it answers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.fixed import IMPORT_EXTENSIONS
from .joins import attach

INDEX_BASE = len(IMPORT_EXTENSIONS) + 1


def _extensions() -> Column:
    return F.array(*[F.lit(e) for e in IMPORT_EXTENSIONS])


def references(facts: DataFrame) -> DataFrame:
    """One row per file and import string."""
    return facts.select("repo_id", F.col("path").alias("src"), F.explode("imports").alias("import"))


def is_relative(reference: Column) -> Column:
    return reference.startswith(".")


def has_extension(base: Column) -> Column:
    return paths.extname(F.regexp_replace(base, "/+$", "")) != ""


def candidate_paths(base: Column) -> Column:
    """Every spelling of a path, in the order tried: itself, with an extension, as a folder's index."""
    extensions = _extensions()
    with_extension = F.transform(extensions, lambda e: F.concat(base, e))
    folder = F.when((base == "") | base.endswith("/"), base).otherwise(
        F.concat(base, F.lit("/"))
    )
    index = F.transform(extensions, lambda e: F.concat(folder, F.lit("index"), e))
    # The root has no name that an extension could follow.
    extended = F.when((base == "") | has_extension(base), F.array().cast("array<string>")).otherwise(with_extension)
    return F.array_distinct(F.concat(F.array(base), extended, index))


def expand_candidates(candidates: DataFrame) -> DataFrame:
    """One row per spelling of each candidate path, numbered in the order tried."""
    return candidates.select(
        "*", F.posexplode(candidate_paths(F.col("base"))).alias("expansion_ord", "candidate")
    )


def path_keys(repo_paths: DataFrame) -> DataFrame:
    """Per existing file, the paths it answers to and the place of that answer in the order tried."""
    path = F.col("path")
    extension, directory, name = paths.extname(path), paths.dirname(path), paths.basename(path)
    place = F.array_position(_extensions(), extension).cast("int")
    without = F.left(path, F.length(path) - F.length(extension))
    bare_place = F.array_position(_extensions(), name).cast("int")

    def answer(condition: Column, key: Column, order: Column) -> Column:
        return F.when(condition, F.struct(key.alias("base"), order.alias("expansion_ord")))

    index_file = (place > 0) & (paths.stem(path) == "index")
    answers = F.array(
        F.struct(path.alias("base"), F.lit(0).alias("expansion_ord")),
        answer((place > 0) & (paths.extname(without) == ""), without, place),
        answer(index_file, directory, place + F.lit(INDEX_BASE - 1)),
        answer(index_file, F.concat(directory, F.lit("/")), place + F.lit(INDEX_BASE - 1)),
        answer((bare_place > 0) & (paths.extname(directory) == ""), F.concat(directory, F.lit("/")), bare_place),
    )
    return repo_paths.select("repo_id", F.explode(F.filter(answers, lambda a: a.isNotNull())).alias("a")).select(
        "repo_id", "a.base", "a.expansion_ord"
    )


def _answering_path(base: Column, order: Column) -> Column:
    """The file behind a path, from the place of the answer."""
    extensions = _extensions()
    folder = F.when(base.isin("", "/"), F.lit("")).when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    return (
        F.when(order == 0, base)
        .when(order < INDEX_BASE, F.concat(base, F.get(extensions, order - 1)))
        .otherwise(F.concat(folder, F.lit("index"), F.get(extensions, order - INDEX_BASE)))
    )


def resolve_bases(bases: DataFrame, repo_paths: DataFrame) -> DataFrame:
    """First existing file for each distinct (repo_id, base)."""
    found = bases.select("repo_id", "base").distinct().join(path_keys(repo_paths), ["repo_id", "base"])
    best = found.groupBy("repo_id", "base").agg(F.min("expansion_ord").alias("expansion_ord"))
    return best.select("repo_id", "base", _answering_path(F.col("base"), F.col("expansion_ord")).alias("target"))


def alias_candidates(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Paths that the aliases of a repository give each distinct (repo_id, import).

    A wildcard alias matches every import that starts with its prefix (without the slash).
    An import is cut at the prefix lengths in use in its repository, which turns the prefix
    match into an equality join.
    """
    lengths = aliases.groupBy("repo_id").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    cut = attach(imports.select("repo_id", "import"), lengths, ["repo_id"]).select(
        "repo_id", "import", F.explode("lengths").alias("length")
    )
    cut = cut.filter(F.col("length") <= F.length("import")).withColumn("prefix", F.expr("left(import, length)"))
    exact = ~F.col("has_wildcard")
    suffix = F.expr("substring(import, length + 1)")
    prefix = F.col("target_prefix")
    # An empty target prefix is the repository root; only a slash may follow it.
    joined = F.when(prefix != "", F.concat(prefix, suffix)).when((suffix == "") | suffix.startswith("/"), suffix)
    raw = F.when(exact | ~F.col("target_has_wildcard"), prefix).otherwise(joined)
    clean = paths.collapse_dots(raw)
    return (
        cut.join(aliases, ["repo_id", "prefix"])
        .filter(F.col("has_wildcard") | (F.col("import") == F.col("pattern")))
        .select(
            "repo_id",
            "import",
            (F.col("alias_ord") * (1 << 20) + F.col("target_ord")).cast("bigint").alias("candidate_ord"),
            F.when(raw.endswith("/"), F.concat(clean, F.lit("/"))).otherwise(clean).alias("base"),
        )
    )


def configured_candidates(imports: DataFrame, config: DataFrame, aliases: DataFrame) -> DataFrame:
    """Paths of each distinct non-relative (repo_id, import): aliases, else the base URL, else none."""
    reference, base_url = F.col("import"), F.col("base_url")
    matched = alias_candidates(imports, aliases).withColumn("aliased", F.lit(True))
    project_like = (
        reference.contains("/") | reference.startswith("@") | reference.startswith("~") | (paths.extname(reference) != "")
    )
    below = F.when(project_like & ~reference.startswith("/"), paths.join_path(base_url, reference))
    return (
        attach(imports.select("repo_id", "import"), config.select("repo_id", "base_url"), ["repo_id"])
        .join(matched, ["repo_id", "import"], "left")
        .select(
            "repo_id",
            "import",
            F.coalesce("candidate_ord", F.lit(0)).cast("bigint").alias("candidate_ord"),
            F.when(F.col("aliased"), F.col("base")).otherwise(below).alias("base"),
        )
        .filter(F.col("base").isNotNull())
    )


def _relative_bases(refs: DataFrame) -> DataFrame:
    base = paths.join_path(paths.dirname(F.col("src")), F.col("import"))
    return refs.filter(is_relative(F.col("import"))).withColumn("base", base).filter(F.col("base").isNotNull())


def _other_imports(refs: DataFrame) -> DataFrame:
    return refs.filter(~is_relative(F.col("import")) & (F.col("import") != "")).select("repo_id", "import").distinct()


def import_candidates(
    facts: DataFrame, config: DataFrame | None = None, aliases: DataFrame | None = None
) -> DataFrame:
    """Candidate paths of every (file, import), in order. Imports of packages have none."""
    refs = references(facts)
    relative = _relative_bases(refs).withColumn("candidate_ord", F.lit(0).cast("bigint"))
    columns = ["repo_id", "src", "import", "candidate_ord", "base"]
    if config is None:
        return relative.select(*columns)
    other = configured_candidates(_other_imports(refs), config, aliases)
    return relative.select(*columns).unionByName(attach(refs, other, ["repo_id", "import"]).select(*columns))


def resolve_imports(
    facts: DataFrame,
    repo_paths: DataFrame,
    config: DataFrame | None = None,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """The existing file behind every (file, import) that has one.

    ``repo_paths`` lists all files of the repository, analysed or not: a file that is not
    analysed still shadows later candidates. Without ``config`` (and ``aliases``) only
    relative imports resolve.
    """
    refs = references(facts)
    relative = _relative_bases(refs)
    columns = ["repo_id", "src", "import", "target"]
    resolved = attach(relative, resolve_bases(relative, repo_paths), ["repo_id", "base"]).select(*columns)
    if config is None:
        return resolved
    candidates = configured_candidates(_other_imports(refs), config, aliases)
    targets = candidates.join(resolve_bases(candidates, repo_paths), ["repo_id", "base"])
    first = targets.groupBy("repo_id", "import").agg(F.min_by("target", "candidate_ord").alias("target"))
    return resolved.unionByName(attach(refs, first, ["repo_id", "import"]).select(*columns))


def import_edges(resolved: DataFrame, facts: DataFrame) -> DataFrame:
    """Resolved imports whose target was analysed; one row per (file, import string)."""
    analysed = facts.select("repo_id", F.col("path").alias("dst"))
    return resolved.withColumnRenamed("target", "dst").join(analysed, ["repo_id", "dst"], "left_semi").select(
        "repo_id", "src", "dst", "import"
    )
