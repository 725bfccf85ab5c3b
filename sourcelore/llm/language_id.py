"""Language identification in two steps: the family first, then the language within it.

Both steps let one-versus-one linear support vector machines over hashed character n-grams decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelore.llm.common import column, packed, settle

UNDETERMINED = "und"
DIMENSIONS = 4096
#: Bound of the training sample: so many labelled rows of each language, by hash of their id.
SAMPLE = 300
CHUNK = 1 << 20
#: Families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"),
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "indic": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "malayic": ("id", "jv", "ms", "su", "tl"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.split("-")[0].split("_")[0].lower(), language)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, 32, np.int64)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            table[point] = ord(char.lower()[0])
    return table


def features(text: str) -> np.ndarray | None:
    """Unit vector of the square roots of n-gram counts, n from 1 to 3; None for a text without letters."""
    counts = np.zeros(DIMENSIONS)
    carried = np.full(1, 32, np.int64)
    seen = False
    for start in range(0, len(text), CHUNK):
        raw = np.frombuffer(text[start : start + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = _letters()[raw]
        seen = seen or bool((codes != 32).any())
        codes = np.concatenate([carried, codes])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        if start + CHUNK >= len(text):
            codes = np.concatenate([codes, [32, 32]])
        mixed = codes * 0x9E3779B1
        for gram in (mixed[:-2], mixed[:-2] * 31 + mixed[1:-1], (mixed[:-2] * 31 + mixed[1:-1]) * 31 + mixed[2:]):
            counts += np.bincount(((gram ^ (gram >> 29)) * 0x85EBCA6B >> 13) & (DIMENSIONS - 1), minlength=DIMENSIONS)
        carried = codes[-2:]
    if not seen:
        return None
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


@dataclass
class Duels:
    """One-versus-one machines over some classes; the class that wins by most margin is chosen."""

    classes: list[str]
    weights: dict[tuple[int, int], tuple[np.ndarray, float]] = field(default_factory=dict)

    def choose(self, x: np.ndarray) -> tuple[str, float]:
        """The class and, from 0 to 1, how clearly it won (1 if there is no other)."""
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        won = np.zeros(len(self.classes))
        for (i, j), (w, b) in self.weights.items():
            share = 1 / (1 + np.exp(-4 * np.clip(x @ w + b, -50, 50)))
            won[i] += share
            won[j] += 1 - share
        best = int(won.argmax())
        return self.classes[best], float(won[best] / (len(self.classes) - 1))


@dataclass
class LanguageModel:
    families: Duels | None = None
    languages: dict[str, Duels] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if text and self.families else None
        if x is None:
            return UNDETERMINED, 0.0
        family, sure = self.families.choose(x)
        language, surer = self.languages[family].choose(x)
        return language, sure * surer


def _vectors(rows: DataFrame) -> DataFrame:
    """(lang, features) of rows (lang, text) with letters."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                made = [features(text or "") for text in part.column("text").to_pylist()]
                keep = [i for i, x in enumerate(made) if x is not None]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").take(pa.array(keep, pa.int64())), pa.array([made[i] for i in keep], pa.list_(pa.float64()))],
                    names=["lang", "x"],
                )

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(convert, schema).select("lang", array_to_vector("x").alias("features"))


def _duels(rows: DataFrame, name: str, classes: list[str]) -> Duels:
    out = Duels(classes)
    for i, j in combinations(range(len(classes)), 2):
        pair = rows.where(F.col(name).isin(classes[i], classes[j]))
        labelled = pair.select("features", (F.col(name) == classes[i]).cast("double").alias("label"))
        model = LinearSVC(maxIter=30, regParam=1e-3, standardization=False, aggregationDepth=2).fit(labelled)
        out.weights[i, j] = model.coefficients.toArray(), float(model.intercept)
    return out


def held_out(key: Column) -> Column:
    """Rows that training must not see; a row without id is neither held out nor trained on."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", lang_name: str = "lang", per_language: int = SAMPLE) -> LanguageModel:
    """Fit on at most ``per_language`` labelled rows of each language that are not held out.

    Without any labelled text the model knows no language and answers ``und`` to everything.
    """
    labelled = docs.where(column(id_name).isNotNull() & ~held_out(column(id_name)) & column(lang_name).isNotNull() & (column(lang_name) != UNDETERMINED))
    named = labelled.select(column(id_name).alias("id"), column(lang_name).alias("lang"), column(text_name).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = named.select("id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    # Bounded by per_language times the number of languages.
    texts = named.join(F.broadcast(chosen.select("id", "lang").distinct()), ["id", "lang"])
    known = settle(_vectors(texts))
    languages = sorted(row["lang"] for row in known.select("lang").distinct().collect())
    if not languages:
        return LanguageModel()
    pairs = [F.lit(x) for name in languages for x in (name, family_of(name))]
    known = known.withColumn("family", F.element_at(F.create_map(*pairs), F.col("lang"))).persist()
    by_family: dict[str, list[str]] = {}
    for language in languages:
        by_family.setdefault(family_of(language), []).append(language)
    try:
        families = _duels(known, "family", sorted(by_family))
        within = {family: _duels(known, "lang", names) for family, names in by_family.items()}
    finally:
        known.unpersist()
    return LanguageModel(families, within)


def identified(docs: DataFrame, model: LanguageModel, text_name: str = "text") -> DataFrame:
    """The rows (as struct ``row``) with lang_pred and score, from the whole text and nothing else.

    ``und`` with score 0 for a null text or one without letters.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.predict(text) for text in batch.column("row").field(text_name).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([a for a, _ in made], pa.string()), pa.array([b for _, b in made], pa.float64())],
                names=["row", "lang_pred", "score"],
            )

    rows = docs.select(packed(docs).alias("row"))
    return rows.mapInArrow(convert, T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_report(docs: DataFrame) -> DataFrame:
    """Per document, repeated rows included: doc_id, held_out, lang_pred, score."""
    model = trained(docs)
    named = docs.select(column("doc_id").alias("doc_id"), column("text").alias("text"))
    key = F.col("row.doc_id")
    return identified(named, model).select(key.alias("doc_id"), held_out(key).alias("held_out"), "lang_pred", "score")
