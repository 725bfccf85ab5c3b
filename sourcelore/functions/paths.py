"""Column expressions over repository-relative paths (``/``-separated, no leading slash)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ENTRY_NAMES, TEST_SEGMENTS


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Directory of a path; the empty string for a file in the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extname(path: Column) -> Column:
    """From the last dot of the file name; empty when that dot comes first."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its extension."""
    name = basename(path)
    return F.left(name, F.length(name) - F.length(extname(path)))


def collapse_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments from the repository root.

    The root is the empty string. A path that climbs above the root is null.
    """

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment.isin("", "."), done)
            .when(segment != "..", F.concat(done, F.array(segment)))
            .when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1))
        )

    walked = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    # Most paths hold no dot segment and no empty segment; they need no walk.
    plain = ~path.rlike(r"(?:^|/)(?:\.{0,2})(?:/|$)")
    return F.when(plain, path).otherwise(F.array_join(walked, "/"))


def join_path(directory: Column, relative: Column) -> Column:
    """``relative`` seen from ``directory`` (repository-relative), dots collapsed."""
    return collapse_dots(F.when(directory == "", relative).otherwise(F.concat(directory, F.lit("/"), relative)))


def normalize_repo_path(path: Column, root: str) -> Column:
    """A user-supplied path, absolute or relative, as a repository-relative one.

    Blank paths and paths outside ``root`` become the empty string.
    """
    base = root.replace("\\", "/").rstrip("/")
    clean = F.replace(strip(path), F.lit("\\"), F.lit("/"))
    absolute = clean.startswith("/")
    anchored = F.when(absolute, clean).otherwise(F.concat(F.lit(base + "/"), clean))
    full = F.concat(F.lit("/"), collapse_dots(anchored))
    inside = full.startswith(base + "/")
    relative = F.substring(full, len(base) + 2, 1 << 30)
    return F.when((clean != "") & inside, relative).otherwise(F.lit(""))


def is_test_file(path: Column) -> Column:
    lowered = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    segments = F.split(lowered, "/")
    return F.arrays_overlap(segments, F.array(*[F.lit(s) for s in TEST_SEGMENTS])) | lowered.rlike(
        r"[.](?:test|spec)[.][^./]+$"
    )


def is_entry_point(path: Column) -> Column:
    return stem(path).isin(*ENTRY_NAMES)
