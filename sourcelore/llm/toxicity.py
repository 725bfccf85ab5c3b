"""Toxicity by a string-kernel support vector machine over subsequences, with Nyström landmarks.

Two words are alike by the subsequences of three letters that they share, each weighed down by the gaps it spans, so
letters put into an insult leave most of its likeness; signs or blanks between letters are passed over. The kernel is a Gaussian over that likeness; its
values against a few landmark words, made independent of each other (Nyström), are the features of a linear machine. Labels
belong to whole texts: a text is a bag of words, a word is learned from with the labels of all texts that hold it, and a text
is as toxic as its worst few words.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelore.llm.common import column, packed, settle, text_of

#: Bound of the training sample: so many labelled texts of each label, by hash of their id.
SAMPLE = 2000
#: Bound of the words that the machine is fitted on, a third each: most telling, most frequent, and by hash.
WORDS = 15_000
#: Landmarks: most telling words, most frequent ones, and some by hash.
LANDMARKS = (128, 16, 16)
#: So many of the most toxic words of a text decide its score; margins under the floor are all alike.
EVIDENCE, FLOOR = 4, -1.0
#: What the machine and the curve from margins to scores pay for large weights.
PENALTY, CURVE_PENALTY = 1e-3, 0.1
#: What a gap of one place in a subsequence costs, and how fast likeness fades.
DECAY, SHARPNESS = 0.6, 3.0
#: Words longer than this are cut into overlapping pieces.
PIECE = 24
#: Words scored together (pieces of 14 bits), and words whose scores a task remembers.
ABREAST, MEMORY = 8_000, 400_000
#: Letters are told apart by their code points modulo the largest prime of 15 bits.
LETTERS = 32_749
#: Texts read together.
TEXTS = 200
GAP, BEGIN, END = "\0", "\1", "\2"
#: Places behind the first letter at which a subsequence goes on; a subsequence spans five places at most.
SHAPES = [(a, b) for b in (2, 3, 4) for a in range(1, b)]
_PARTS = re.compile(r"[^\W_]+").findall
#: What stands between blanks, without signs at its ends.
_WORDS = re.compile(r"[^\W_](?:\S*[^\W_])?").findall
#: Single letters in a row, a few signs or blanks apart.
_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]{1,3}[^\W_](?![^\W_])){2,}").findall


def words_of(text: str | None) -> set[str]:
    """The different words of a text, in lower case, and stretches of letters that stand one by one."""
    low = (text or "").lower()
    return {*_WORDS(low), *_SPELLED(low)}


def pieces_of(word: str) -> list[str]:
    """The letters of a word without any signs between them, its ends marked."""
    whole = BEGIN + (word if word.isalnum() else "".join(_PARTS(word))) + END
    if len(whole) <= PIECE:
        return [whole]
    return [whole[at : at + PIECE] for at in range(0, max(1, len(whole) - PIECE // 2), PIECE // 2)]


def _subsequences(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, subsequence, weight), one row per piece and subsequence, sorted by piece and subsequence."""
    apart = GAP * SHAPES[-1][1]
    codes = np.frombuffer(apart.join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(codes > 0, codes % LETTERS + 1, 0)
    owner = np.repeat(np.arange(len(pieces)), np.array([len(p) for p in pieces], np.int64) + len(apart)) << 47
    found = []
    for a, b in SHAPES:
        first, second, third = codes[:-b], codes[a : len(codes) - b + a], codes[b:]
        at = np.flatnonzero((first > 0) & (second > 0) & (third > 0))
        found.append(owner[at] | first[at] << 32 | second[at] << 17 | third[at] << 2 | b - 2)
    # Piece, letters and gaps in one number, so that plain sorting puts equal ones together.
    keys = np.sort(np.concatenate(found))
    weight, keys = (DECAY ** np.arange(3))[keys & 3].astype(np.float32), keys >> 2
    # A subsequence that a piece holds more than once counts with all its weights.
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[heads] >> 45, keys[heads] & (1 << 45) - 1, np.add.reduceat(weight, heads) if len(heads) else weight


class Landmarks:
    """The kernel of pieces against some landmark pieces."""

    def __init__(self, pieces: list[str]):
        piece, code, weight = _subsequences(pieces)
        self.codes, place = np.unique(code, return_inverse=True)
        self.size = len(pieces)
        table = np.zeros((len(self.codes), len(pieces)), np.float32)
        table[place, piece] = weight
        self.table = table / np.maximum(np.sqrt((table**2).sum(0)), 1e-9)
        #: Which subsequences may be in the table, by some bits of them; nearly all others are sorted out by it.
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self._bits(self.codes)] = True

    @staticmethod
    def _bits(codes: np.ndarray) -> np.ndarray:
        return ((codes >> 17) * 0x9E3779B1 >> 7 ^ codes * 0x85EBCA6B >> 11) & 0xFFFF

    def kernel(self, pieces: list[str]) -> np.ndarray:
        piece, code, weight = _subsequences(pieces)
        norm = np.sqrt(np.bincount(piece, weight**2, len(pieces))).astype(np.float32)
        near = np.flatnonzero(self.maybe[self._bits(code)])
        at = np.minimum(self.codes.searchsorted(code[near]), len(self.codes) - 1)
        hit = self.codes[at] == code[near]
        near, at = near[hit], at[hit]
        alike = np.zeros((len(pieces), self.table.shape[1]), np.float32)
        # The first hit of each piece, then the second of those that have one, and so on.
        turn = np.arange(len(near)) - piece[near].searchsorted(piece[near])
        order = turn.argsort(kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
            alike[piece[near[some]]] += weight[near[some], None] * self.table[at[some]]
        alike /= np.maximum(norm, 1e-9)[:, None]
        return np.exp(SHARPNESS * (alike - 1))


@dataclass
class ToxicityModel:
    """Machine over Nyström features, folded into one weight per landmark, and how the largest margins of a text's words become its score."""

    landmarks: Landmarks | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    slopes: tuple[float, ...] = ()
    shift: float = 0.0

    def margins(self, words: list[str]) -> np.ndarray:
        """The largest margin of the pieces of each word."""
        cut = [pieces_of(word) for word in words]
        pieces = [p for some in cut for p in some]
        heads = np.cumsum([0, *map(len, cut)])[:-1]
        parts = [self.landmarks.kernel(pieces[at : at + ABREAST]) @ self.weights for at in range(0, len(pieces), ABREAST)]
        return np.maximum.reduceat(np.concatenate(parts), heads) + self.bias if pieces else np.zeros(0)


class _Remembered(dict):
    """Margins of words by a model, worked out for many words at a time."""

    def __init__(self, model: ToxicityModel):
        self.model = model

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > MEMORY:
            self.clear()
            new = list(words)
        for at in range(0, len(new), ABREAST):
            some = new[at : at + ABREAST]
            self.update(zip(some, self.model.margins(some).tolist(), strict=True))


def _worst(texts: list[str | None], known: _Remembered) -> Iterator[list[tuple[float, str]]]:
    """The words with the largest margins of each text, worst first."""
    bags = [words_of(text) for text in texts]
    known.learn(set().union(*bags))
    for bag in bags:
        yield heapq.nlargest(EVIDENCE, ((known[word], word) for word in bag))


def _margins(rows: DataFrame, model: ToxicityModel, text_name: str) -> DataFrame:
    """The rows (as struct ``row``, without the text) with the ``margins`` of their worst words, not under the floor, and these ``words``."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Remembered(model)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                found = list(_worst(part.column("given").to_pylist(), known))
                margins = [([max(m, FLOOR) for m, _ in some] + [FLOOR] * EVIDENCE)[:EVIDENCE] for some in found]
                words = [[w for _, w in some] for some in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(margins, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.string()))], names=["row", "margins", "words"]
                )

    taken = rows.select(packed(rows.drop(text_name)).alias("row"), text_of(text_name).alias("given"))
    made = [T.StructField("margins", T.ArrayType(T.DoubleType())), T.StructField("words", T.ArrayType(T.StringType()))]
    return taken.mapInArrow(convert, T.StructType([taken.schema["row"], *made]))


def held_out(key: Column) -> Column:
    """Rows that training must not see; a row without id is neither held out nor trained on."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, toxic, share, text) of at most SAMPLE ids of each label; share: the labelled rows that one of them stands for.

    An id with several labels is toxic if one of them says so; of several texts of an id the smallest is taken.
    """
    key = column("doc_id")
    known = labels.where(key.isNotNull() & ~held_out(key) & column("toxic").isNotNull())
    known = known.groupBy(key.alias("id")).agg(F.max(column("toxic").cast("int")).alias("toxic"))
    totals = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    parts = [
        known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).withColumn("share", F.lit(max(1.0, totals.get(label, 0) / SAMPLE)))
        for label in (0, 1)
    ]
    # At most two times SAMPLE rows.
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select(key.alias("id"), column("text").alias("text")).join(chosen, "id")
    return settle(texts.groupBy("id", "toxic", "share").agg(F.min("text").alias("text")))


def _word_counts(texts: DataFrame) -> DataFrame:
    """Per word the toxic and the clean texts that hold it, each counted with its share."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                bags = [sorted({"".join(_PARTS(w)) for w in words_of(text)}) for text in part.column("text").to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(bags)), [len(bag) for bag in bags]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for bag in bags for w in bag], pa.string()), part.column("toxic").take(rows), part.column("share").take(rows)],
                    names=["word", "toxic", "share"],
                )

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("toxic", T.IntegerType()), T.StructField("share", T.DoubleType())])
    words = texts.select("text", "toxic", "share").mapInArrow(convert, schema)
    return words.groupBy("word").agg(F.sum(F.col("share") * F.col("toxic")).alias("toxic"), F.sum(F.col("share") * (1 - F.col("toxic"))).alias("clean"))


def trained(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on a bounded sample of labelled texts that are not held out; without both labels nothing is learned."""
    texts = _sample(docs, labels)
    seen = {row["toxic"]: row["n"] for row in texts.groupBy("toxic").agg(F.sum("share").alias("n")).collect()}
    if not (seen.get(0) and seen.get(1)):
        return ToxicityModel()
    prior = seen[1] / (seen[0] + seen[1])
    counts = settle(_word_counts(texts))
    total = F.col("toxic") + F.col("clean")
    telling = (F.col("toxic") - total * prior) / F.sqrt(total * prior * (1 - prior))
    orders = [(telling.desc(), F.col("word")), (total.desc(), F.col("word")), (F.xxhash64("word"), F.col("word"))]
    # Bounded by WORDS, whatever the sample holds.
    ranked = [counts.orderBy(*order).limit(WORDS // 3).collect() for order in orders]
    words = sorted({row for rows in ranked for row in rows})
    pieces = [pieces_of(row["word"])[0] for row in words]
    toxic, clean = (np.array([row[name] for row in words]) for name in ("toxic", "clean"))
    chosen = list(dict.fromkeys(pieces_of(row["word"])[0] for rows, n in zip(ranked, LANDMARKS, strict=True) for row in rows[:n]))
    landmarks = Landmarks(chosen)
    values, vectors = np.linalg.eigh(landmarks.kernel(chosen).astype(np.float64))
    # Nyström: kernel values times the inverse root of the landmarks' own kernel.
    rooted = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    x = np.concatenate([landmarks.kernel(pieces[at : at + ABREAST]) for at in range(0, len(pieces), ABREAST)]).astype(np.float64) @ rooted
    cost = np.concatenate([toxic, clean])
    weights, bias = _machine(np.concatenate([x, x]), np.repeat([1.0, -1.0], len(pieces)), cost / cost.sum())
    model = ToxicityModel(landmarks, (rooted @ weights).astype(np.float32), bias)
    # One row per text of the sample.
    spread = texts.select("toxic", "share", "text").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    found = [(*r["margins"], r["row"]["toxic"], r["row"]["share"]) for r in _margins(spread, model, "text").collect()]
    *margins, labels_of, shares = np.array(found).T
    *slopes, model.shift = _curve(np.stack(margins, 1), labels_of, shares).tolist()
    model.slopes = tuple(slopes)
    return model


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear support vector machine with squared hinge loss, by Newton steps over its support."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    penalty = np.diag([PENALTY] * (x.shape[1] - 1) + [1e-9]) / x.shape[1]
    weights = np.zeros(x.shape[1])
    support = cost > 0
    for _ in range(50):
        some, pull = x[support], cost[support]
        weights = np.linalg.solve(penalty + some.T @ (some * pull[:, None]), some.T @ (pull * y[support]))
        now = (cost > 0) & (y * (x @ weights) < 1)
        if (now == support).all():
            break
        support = now
    return weights[:-1], float(weights[-1])


def _curve(margins: np.ndarray, toxic: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Slopes and shift of the logistic curve of a label over what margins are as odds, by Newton steps."""
    x = np.concatenate([np.exp(2 * margins), np.ones((len(margins), 1))], 1)
    weights, penalty = np.zeros(x.shape[1]), np.array([CURVE_PENALTY] * margins.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (share * (toxic - p)) - penalty * weights
        step = np.linalg.solve(x.T @ (x * (share * p * (1 - p))[:, None]) + np.diag(penalty), gradient)
        weights = weights + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return weights


def scored(docs: DataFrame, model: ToxicityModel, text_name: str = "text") -> DataFrame:
    """The rows (as struct ``row``, without the text) with ``score`` and ``words``, the worst words that decided it.

    The score depends on the whole text and on nothing else. A null or empty text, or one without letters, has the score of
    a text whose words are all as clean as can be; a model that has learned nothing scores all texts 0, with null words.
    """
    if model.landmarks is None:
        return docs.select(packed(docs.drop(text_name)).alias("row"), F.lit(0.0).alias("score"), F.lit(None).cast("array<string>").alias("words"))
    along = sum((F.exp(2 * F.col("margins")[i]) * slope for i, slope in enumerate(model.slopes)), F.lit(model.shift))
    return _margins(docs, model, text_name).select("row", (1 / (1 + F.exp(-along))).alias("score"), "words")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document, repeated rows included: doc_id, held_out, score, predicted, words."""
    model = trained(docs, labels)
    key = F.col("row.doc_id")
    found = scored(docs.select(column("doc_id").alias("doc_id"), column("text").alias("text")), model)
    return found.select(key.alias("doc_id"), held_out(key).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "words")
