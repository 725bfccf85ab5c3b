"""From source texts to one row of facts per file."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical_extract, paths, regex_extract, text
from ..functions.fixed import DEFAULT_IGNORE, LANGUAGES, LEXICAL_LANGUAGES
from ..functions.sqltext import NO_NAMES, case, literal


#: Plain TypeScript files hold no JSX; what looks like it there are type arguments.
NO_JSX = "not endswith(path, '.ts')"


def ignore_patterns(extra: str | None = None) -> list[str]:
    """Default patterns followed by the comma-separated extras, each once."""
    extras = [p.strip() for p in (extra or "").split(",")]
    return list(dict.fromkeys(DEFAULT_IGNORE + [p for p in extras if p]))


def _clean_pattern(pattern: str) -> str:
    cleaned = pattern.replace("\\", "/")
    if cleaned.startswith("./"):
        cleaned = cleaned[2:].lstrip("/")
    return cleaned.rstrip("/").lower()


def filter_ignored(files: DataFrame, patterns: Iterable[str] | None = None) -> DataFrame:
    """Drop files that a pattern names, or that lie in a directory it names.

    One-segment patterns match at any depth, longer ones from the root only.
    """
    wanted = [p for p in map(_clean_pattern, DEFAULT_IGNORE if patterns is None else patterns) if p]
    if not wanted:
        return files
    path = F.lower(F.col("path"))
    # With a slash on both ends a whole-segment match is a plain substring match.
    framed = F.concat(F.lit("/"), path, F.lit("/"))
    hits = [framed.startswith(f"/{p}/") if "/" in p else framed.contains(f"/{p}/") for p in wanted]
    return files.filter(~reduce(lambda a, b: a | b, hits))


def language_of(path: Column, languages: dict = LANGUAGES) -> Column:
    extension = paths.extname(path)
    return F.coalesce(*[F.when(extension.isin(spec["extensions"]), name) for name, spec in languages.items()])


def with_language(files: DataFrame, languages: dict = LANGUAGES) -> DataFrame:
    """Add ``language``; files of no known language are dropped."""
    return files.withColumn("language", language_of(F.col("path"), languages)).filter(F.col("language").isNotNull())


def file_facts(files: DataFrame, mode: str = "lexical", languages: dict = LANGUAGES) -> DataFrame:
    """One row per file in a known language: sizes, complexity and the names found in it.

    ``mode`` picks how JavaScript and TypeScript are read: ``lexical`` skips comments and
    strings, ``regex`` applies the plain patterns to the raw text. Other languages always
    use the plain patterns. The whole text is read and dropped in the same stage.
    """
    if mode not in ("lexical", "regex"):
        raise ValueError(f"mode must be 'lexical' or 'regex', not {mode!r}")
    lexical = [name for name in languages if mode == "lexical" and name in LEXICAL_LANGUAGES]

    known = with_language(files.select("repo_id", "path", "content"), languages)
    if lexical:
        is_lexical = f"language in ({', '.join(map(literal, lexical))})"
        known = known.withColumn("code", F.expr(case({is_lexical: lexical_extract.code_text("content", NO_JSX)}, "null")))
        known = known.withColumn("bare", F.expr(lexical_extract.bare_text("code")))
        known = known.withColumn("flat", F.expr(lexical_extract.flat_text("bare")))

    def fact(kind: str, otherwise: str = NO_NAMES) -> Column:
        """Names by language; ``otherwise`` for languages that do not list this kind."""
        branches = {
            f"language = {literal(name)}": lexical_extract.fact_names("code", "bare", "flat", kind)
            if name in lexical
            else regex_extract.fact_names("content", name, kind, languages)
            for name, spec in languages.items()
            if kind in spec
        }
        return F.expr(case(branches, otherwise)).alias(kind)

    content = F.col("content")
    return known.select(
        "repo_id",
        "path",
        "language",
        text.size_units(content).alias("size"),
        text.line_count(content).alias("lines"),
        text.complexity(content).alias("complexity"),
        fact("imports"),
        fact("functions"),
        fact("classes"),
        fact("exports"),
        fact("interfaces", "null"),
        fact("structs", "null"),
    )


def names_long(facts: DataFrame, kind: str) -> DataFrame:
    """One row per file and name of one kind (``imports``, ``functions``, …)."""
    return facts.select("repo_id", "path", F.explode(kind).alias("name"))
