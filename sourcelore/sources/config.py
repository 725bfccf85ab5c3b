"""Base URL and path aliases from ``tsconfig.json`` or ``jsconfig.json``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.files import language_of
from ..session import ensure_checkpoint_dir

ROOT_CONFIGS = ["tsconfig.json", "jsconfig.json"]
SCHEMA = "extends string, compilerOptions struct<baseUrl:string,paths:map<string,string>>, _broken string"
OPTIONS = {"allowComments": "true", "allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_broken"}
# A comma that only blanks and comments part from a closing bracket.
TRAILING_COMMA = r",(?=(?:\s|//[^\n]*+\n|/\*(?:[^*]|\*(?!/))*+\*/)*+[}\]])"


def _text_list(value: Column) -> Column:
    """A JSON string array, or a single string, as an array; anything else is null."""
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).when(value != "", F.array(value))


def _parsed(configs: DataFrame) -> DataFrame:
    """Configs whose text is a JSON object, with their fields."""
    text = F.regexp_replace("content", TRAILING_COMMA, "")
    return (
        configs.withColumn("json", F.from_json(text, SCHEMA, OPTIONS))
        .filter(F.col("json").isNotNull() & F.col("json._broken").isNull() & F.ltrim(text).rlike(r"^(?s)(?:/|\{)"))
        .select(
            *[c for c in configs.columns if c != "content"],
            _text_list(F.col("json.extends")).alias("extends"),
            F.col("json.compilerOptions.baseUrl").alias("base_url_raw"),
            F.col("json.compilerOptions.paths").alias("paths"),
        )
    )


def parsed_configs(files: DataFrame) -> DataFrame:
    """Every file that may be a path config with its fields: one pass over the texts.

    A text without any of the words that a config is read for has no effect as one, unless it is a root config, which
    hides the other one.
    """
    text = F.col("content")
    telling = text.contains("extends") | text.contains("compilerOptions") | text.contains("\\u")
    config_like = files.filter(language_of(F.col("path")).isNull() & (F.col("path").isin(ROOT_CONFIGS) | telling))
    return _parsed(config_like.select("repo_id", "path", "content"))


def config_chain(files: DataFrame, repo_paths: DataFrame | None = None) -> DataFrame:
    """Every config that applies to a repository, in the order in which they are laid over each other.

    ``files`` holds (repo_id, path, content) of all files, ``repo_paths`` the paths that
    exist. Inherited configs come first; a config reached twice counts once, where it is met
    first. Texts are read and parsed once; the loop over the small table of configs takes one
    step per level of inheritance, goes on from a config only where it is met earlier than
    before, and so ends in cycles too.
    """
    existing = (files if repo_paths is None else repo_paths).select("repo_id", "path")
    # One small row per config, written out, so that no step reads a text again or repeats the steps before.
    ensure_checkpoint_dir(files.sparkSession)
    configs = parsed_configs(files).checkpoint()

    roots = configs.filter(F.col("path").isin(ROOT_CONFIGS))
    # The first root config that can be read wins.
    chosen = roots.groupBy("repo_id").agg(F.max("path").alias("path"))
    level = chosen.withColumn("place", F.array().cast("array<int>")).checkpoint()
    found = level
    while True:
        folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
        links = level.join(configs, ["repo_id", "path"]).select(
            "repo_id", "path", "place", F.posexplode("extends").alias("ord", "value")
        )
        base = paths.join_path(folder, F.col("value"))
        below = F.when(base == "", "").otherwise(F.concat(base, F.lit("/")))
        spelled = links.filter(F.col("value").startswith(".")).withColumn("base", base).select(
            "repo_id",
            F.concat("place", F.array("ord")).alias("place"),
            F.posexplode(
                F.array(
                    base, F.concat(base, F.lit(".json")), *[F.concat(below, F.lit(name)) for name in ROOT_CONFIGS]
                )
            ).alias("spelling", "path"),
        )
        named = (
            spelled.join(existing, ["repo_id", "path"], "left_semi")
            .groupBy("repo_id", "place")
            .agg(F.min_by("path", "spelling").alias("path"))
        )
        first = named.join(configs.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
        first = first.groupBy("repo_id", "path").agg(F.min("place").alias("place"))
        known = found.groupBy("repo_id", "path").agg(F.min("place").alias("known"))
        earlier = first.join(known, ["repo_id", "path"], "left").filter(F.col("known").isNull() | (F.col("place") < F.col("known")))
        level = earlier.select("repo_id", "path", "place").checkpoint()
        if level.isEmpty():
            break
        found = found.unionByName(level)
    once = found.groupBy("repo_id", "path").agg(F.min("place").alias("place"))
    # Depth-first order with parents ahead of the config that extends them.
    after_parents = F.concat("place", F.array(F.lit(2**31 - 1)))
    return once.join(configs, ["repo_id", "path"]).select(
        "repo_id", "path", after_parents.alias("layer"), "base_url_raw", "paths"
    )


def path_config(chain: DataFrame) -> DataFrame:
    """Base URL of every repository that has a config; the root unless a config names one.

    The last layer that names a base URL wins and is read from its own folder. A base URL
    outside the repository is null: nothing below it can be found.
    """
    raw = F.col("base_url_raw")
    resolved = F.when(~raw.startswith("/"), paths.join_path(paths.dirname(F.col("path")), raw))
    last = chain.groupBy("repo_id").agg(
        F.max_by(F.struct(resolved.alias("value")), F.when(raw.isNotNull(), F.col("layer"))).alias("last")
    )
    return last.select("repo_id", F.when(F.col("last").isNull(), "").otherwise(F.col("last.value")).alias("base_url"))


def path_aliases(chain: DataFrame, config: DataFrame) -> DataFrame:
    """One row per alias and target, in order. A later layer replaces an alias as a whole."""
    entries = chain.select("repo_id", "layer", F.posexplode(F.map_entries("paths")).alias("pos", "entry"))
    merged = entries.groupBy("repo_id", F.col("entry.key").alias("pattern")).agg(
        F.min(F.struct("layer", "pos")).alias("first_place"), F.max_by("entry.value", "layer").alias("targets")
    )
    # A few aliases per repository.
    order = Window.partitionBy("repo_id").orderBy("first_place")
    listed = merged.withColumn("alias_ord", F.row_number().over(order) - 1).select(
        "repo_id",
        "alias_ord",
        "pattern",
        F.posexplode(F.when(F.col("targets").startswith("["), F.from_json("targets", "array<string>"))).alias(
            "target_ord", "target"
        ),
    )

    def cut(text: Column) -> Column:
        return F.when(text.endswith("/*"), F.left(text, F.length(text) - 2)).otherwise(text)

    pattern, target = F.col("pattern"), F.col("target")
    return (
        listed.filter(target != "")
        .join(config, "repo_id")
        .select(
            "repo_id",
            F.col("alias_ord").cast("int").alias("alias_ord"),
            "pattern",
            cut(pattern).alias("prefix"),
            pattern.endswith("/*").alias("has_wildcard"),
            F.col("target_ord").cast("int").alias("target_ord"),
            F.when(~cut(target).startswith("/"), paths.join_path(F.col("base_url"), cut(target))).alias("target_prefix"),
            target.endswith("/*").alias("target_has_wildcard"),
        )
    )
