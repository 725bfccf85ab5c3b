"""Facts found by plain text patterns, as SQL text per language and fact."""

from __future__ import annotations

from .fixed import LANGUAGES
from .sqltext import NO_NAMES, literal, regex_matches
from .sqltext import names as distinct_names

BRACE_NEXT = r"^\s*+\{"


def _pieces(text: str) -> str:
    """What stands between closing brackets. A pattern that runs up to the next one is looked for once in each
    piece; tried on the whole text, an unclosed bracket would send it to the end again and again."""
    return f"split({text}, {literal('[)]')})"


def _headers(text: str, pattern: str) -> str:
    """The first match of each piece that a brace follows."""
    pieces = _pieces(text)
    found = f"if(y rlike {literal(BRACE_NEXT)}, regexp_extract(x, {literal(pattern)}, 1), '')"
    return distinct_names(f"zip_with({pieces}, slice({pieces}, 2, size({pieces})), (x, y) -> {found})")


def names(text: str, spec: dict, fact: str) -> str:
    """Names of one kind of fact in one language; empty when the language has no pattern."""
    if fact not in spec:
        return NO_NAMES
    if fact == "functions" and "function_header" in spec:
        return _headers(text, spec["function_header"][0])
    pattern, groups = spec[fact]
    return regex_matches(text, pattern, groups)


def imports(text: str, spec: dict) -> str:
    """Import strings, with those of grouped import blocks appended."""
    single = names(text, spec, "imports")
    if "import_block" not in spec:
        return single
    block, item = spec["import_block"][0], spec["import_block_item"][0]
    closed = f"slice({_pieces(text)}, 1, size({_pieces(text)}) - 1)"
    items = f"transform({closed}, p -> regexp_extract_all(regexp_extract(p, {literal(block)}, 1), {literal(item)}, 1))"
    return f"array_distinct(concat({single}, flatten({items})))"


def fact_names(text: str, language: str, fact: str, languages: dict = LANGUAGES) -> str:
    spec = languages[language]
    return imports(text, spec) if fact == "imports" else names(text, spec, fact)
