"""Runs of repeated words, found with a run-length grammar made by recompression.

The words of many texts lie one after the other, parted by symbols that occur once. Blocks of equal symbols and pairs of
neighbours are replaced in turn; which symbols are joined depends on these symbols alone, so equal stretches are cut alike
but for their borders, and walking up and down the levels of the grammar tells how far two places agree in a logarithmic
number of steps. Places that can lie in a run of period q are those of a grid with step q that agree with their next ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelore.llm.common import column, packed, text_of

#: A run is at least so many words long, and at least so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Bytes of text that share one grammar (a longer text has one of its own).
TOGETHER = 2 << 20
#: Grid places that are extended side by side.
ABREAST = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Grammar:
    """The levels of a run-length grammar over a sequence whose first and last symbols occur once.

    A node is a place of a level. Per node: its symbol, where it starts in the sequence, its parent, its first and last
    child, and how many equal symbols start with it or end at it. Levels follow each other in the same arrays.
    """

    def __init__(self, symbols: np.ndarray):
        symbol = symbols.astype(np.int64)
        start = np.arange(len(symbol) + 1)
        first = last = np.full(len(symbol), -1)
        known = int(symbol.max(initial=-1)) + 1
        levels: list[tuple[np.ndarray, ...]] = []
        parents: list[np.ndarray] = []
        offset, turn, repeats = 0, 0, len(np.unique(symbol)) < len(symbol)
        while True:
            size = len(symbol)
            equal = symbol[1:] == symbol[:-1]
            ahead, behind = _equal_ahead(equal), _equal_ahead(equal[::-1])[::-1]
            levels.append((symbol, np.diff(start), first, last, ahead, behind))
            if not repeats:
                # No symbol occurs twice, so nothing agrees from here on.
                parents.append(np.full(size, -1))
                break
            if equal.any():
                # Blocks: a longest stretch of one symbol becomes one symbol for (symbol, length).
                heads = np.flatnonzero(np.concatenate([[True], ~equal]))
                joined = ahead[heads] > 1
                keys = symbol[heads] * (size + 1) + ahead[heads]
            else:
                # Pairs: every symbol is a left or a right one, and each left one joins a right one behind it.
                turn += 1
                left = ((symbol + turn).astype(np.uint64) * _ODD) >> np.uint64(23 + turn % 31) & np.uint64(1) == 0
                pair = np.append(left[:-1] & ~left[1:], False)
                heads = np.flatnonzero(~np.concatenate([[False], pair[:-1]]))
                joined = pair[heads]
                keys = symbol[heads] * known + symbol[np.minimum(heads + 1, size - 1)]
            is_head = np.zeros(size, np.int64)
            is_head[heads] = 1
            parents.append(is_head.cumsum() - 1 + offset + size)
            distinct, number = np.unique(keys[joined], return_inverse=True)
            symbol = symbol[heads]
            symbol[joined] = known + number
            known += len(distinct)
            if len(distinct) == len(number) and len(number):
                repeats = len(np.unique(symbol)) < len(symbol)
            first, last = heads + offset, np.append(heads[1:], size) - 1 + offset
            start = np.append(start[heads], start[-1])
            offset += size
        self.symbol, self.length, self.first, self.last, self.ahead, self.behind = map(np.concatenate, zip(*levels, strict=True))
        self.parent = np.concatenate(parents)

    def agree(self, left: np.ndarray, right: np.ndarray, forward: bool) -> np.ndarray:
        """How many symbols from two places of the sequence on are equal, read forward or backward.

        The places must differ, so that the walk ends at a symbol that occurs once at the latest.
        """
        edge, equal, step = (self.first, self.ahead, 1) if forward else (self.last, self.behind, -1)
        agreed = np.zeros(len(left), np.int64)
        who, a, b = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
        while len(who):
            same = self.symbol[a] == self.symbol[b]
            up, other = self.parent[a], self.parent[b]
            climb = same & (up >= 0) & (other >= 0)
            climb &= (edge[up] == a) & (edge[other] == b) & (self.symbol[up] == self.symbol[other])
            walk = same & ~climb
            moved = np.where(walk, np.minimum(equal[a], equal[b]), 0)
            agreed[who] += moved * self.length[a]
            a, b = (np.where(climb, above, np.where(same, node + step * moved, edge[node])) for above, node in ((up, a), (other, b)))
            going = same | (a >= 0)
            who, a, b = who[going], a[going], b[going]
        return agreed


def _equal_ahead(equal: np.ndarray) -> np.ndarray:
    """How many equal neighbours start at each place, itself counted."""
    if not equal.any():
        return np.ones(len(equal) + 1, np.int64)
    ends = np.flatnonzero(np.append(~equal, True))
    places = np.arange(len(equal) + 1)
    return ends[ends.searchsorted(places)] - places + 1


def runs_of(texts: list[list]) -> list[np.ndarray]:
    """Per list of words its runs as rows (start, length, period), by start, then period."""
    sizes = np.array([len(words) for words in texts], np.int64)
    # Before each text and after the last one stands a symbol of its own.
    offsets = np.concatenate([[1], 1 + (sizes + 1).cumsum()])
    number_of: dict = {}
    sequence = np.empty(int(offsets[-1]), np.int64)
    for at, words in zip(offsets[:-1].tolist(), texts, strict=True):
        sequence[at : at + len(words)] = [number_of.setdefault(word, len(number_of)) for word in words]
    sequence[offsets - 1] = len(number_of) + np.arange(len(offsets))
    longest = int(sizes.max(initial=0))
    found = [np.zeros((0, 3), np.int64)]
    if longest >= MIN_WORDS:
        grammar = Grammar(sequence)
        for places, periods in _grid(sequence, longest):
            behind = grammar.agree(places - 1, places + periods - 1, forward=False)
            ahead = grammar.agree(places, places + periods, forward=True)
            length = behind + ahead + periods
            enough = length >= np.maximum(MIN_WORDS, MIN_PERIODS * periods)
            found.append(np.unique(np.stack([(places - behind)[enough], length[enough], periods[enough]], 1), axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    # A stretch that repeats with a period does so with its multiples too; the smallest counts.
    smallest = np.ones(len(runs), bool)
    smallest[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[smallest]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = offsets.searchsorted(runs[:, 0], side="right") - 1
    runs[:, 0] -= offsets[owner]
    return np.split(runs, owner.searchsorted(np.arange(1, len(texts)))) if texts else []


def _grid(sequence: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods that may lie in a run: multiples of a period which, like the next two, equal what lies a period on.

    A run of period q and at least 4 q words agrees with itself over 3 q words or more, which hold three such multiples.
    """
    waiting: list[tuple[np.ndarray, int]] = []
    count = 0
    for period in range(1, longest // MIN_PERIODS + 1):
        every = sequence[::period]
        equal = every[1:] == every[:-1]
        three = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:]) if len(equal) > 2 else equal[:0]
        if not len(three):
            continue
        waiting.append((three * period, period))
        count += len(three)
        if count >= ABREAST:
            yield _joined(waiting)
            waiting, count = [], 0
    if waiting:
        yield _joined(waiting)


def _joined(parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([p for p, _ in parts]), np.concatenate([np.full(len(p), q, np.int64) for p, q in parts])


def without_repeats(words: list, runs: np.ndarray) -> list:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(change[:-1].cumsum() == 0).tolist()]


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks and the control characters from tab to carriage return, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def periodic_runs(rows: DataFrame, text_name: str = "text", rewrite=None) -> DataFrame:
    """The rows (as struct ``row``, without the text) with ``runs``, an array of (start, length, period) by start, then period,
    and ``collapsed``, the text with each run cut down to its first period, its words joined by one space.

    A run is a longest stretch of at least 6 words and 4 times its smallest period in words. A null or empty text has no
    words and no runs; very long texts are worked on whole; repeated rows give repeated results; an empty table gives none.
    ``rewrite(row, words)``, where given, makes the words to look at from the other columns and the words of the text.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("given")).to_pylist()
            start = 0
            while start < batch.num_rows:
                stop, held = start + 1, sizes[start]
                while stop < batch.num_rows and held + sizes[stop] <= TOGETHER:
                    held += sizes[stop]
                    stop += 1
                part = batch.slice(start, stop - start)
                start = stop
                texts = [words_of(text) for text in part.column("given").to_pylist()]
                if rewrite:
                    texts = [rewrite(row, words) for row, words in zip(part.column("row").to_pylist(), texts, strict=True)]
                found = runs_of(texts)
                flat = np.concatenate(found)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
                ends = np.concatenate([[0], np.cumsum([len(r) for r in found])])
                collapsed = pa.array(
                    [b" ".join(without_repeats(words, runs)).decode("utf-8", "replace") for words, runs in zip(texts, found, strict=True)], pa.string()
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), collapsed], names=["row", "runs", "collapsed"]
                )

    taken = rows.select(packed(rows.drop(text_name)).alias("row"), text_of(text_name).alias("given"))
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    return taken.mapInArrow(convert, T.StructType([taken.schema["row"], T.StructField("runs", T.ArrayType(span)), T.StructField("collapsed", T.StringType())]))


def planted(row: dict, words: list) -> list:
    """The words of one document in ten, by a hash of its id, repeat from some place on; a row without id is left as it is."""
    if row["doc_id"] is None or not words:
        return words
    h = zlib.crc32(str(row["doc_id"]).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    repeated = words[a : a + p]
    return words[:a] + (repeated * ((n - a) // p + 1))[: n - a]


def run_report(docs: DataFrame) -> DataFrame:
    """Per document: the number of runs, the longest one (ties: smallest start, then period; nulls where there is none),
    and digests of all runs and of the collapsed text."""
    named = docs.select(column("doc_id").alias("doc_id"), column("text").alias("text"))
    found = periodic_runs(named, rewrite=planted)
    ranked = F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("shorter")))
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    out = found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.array_max(ranked).alias("longest"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    start, length, period = -F.col("longest.before"), F.col("longest.length"), -F.col("longest.shorter")
    return out.select(
        "doc_id",
        "n_runs",
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * longest.length div -longest.shorter").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )

