"""SQL texts for name extraction.

A file's facts take several hundred expression nodes. Built node by node they would cost a
call to the JVM each; as text they are parsed there in one go.
"""

from __future__ import annotations

from functools import reduce

NO_NAMES = "cast(array() as array<string>)"


def literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def captures(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({text}, {literal(pattern)}, {group})"


def names(found: str) -> str:
    """Non-empty items, first occurrence kept."""
    return f"array_distinct(filter({found}, x -> x <> ''))"


def regex_matches(text: str, pattern: str, groups: int = 1) -> str:
    """Captured text of every match, in order, first occurrence kept, empty captures dropped.

    With several groups the pattern is an alternation in which a match fills one group.
    """
    merged = reduce(
        lambda left, right: f"zip_with({left}, {right}, (x, y) -> if(x <> '', x, y))",
        [captures(text, pattern, group) for group in range(1, groups + 1)],
    )
    return names(merged)


def case(branches: dict[str, str], otherwise: str) -> str:
    """The expression of the first condition that holds."""
    if not branches:
        return otherwise
    return f"case {' '.join(f'when {c} then {e}' for c, e in branches.items())} else {otherwise} end"
