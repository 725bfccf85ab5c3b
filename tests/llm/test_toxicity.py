"""The subsequence kernel against its definition, held-out accuracy, and odd rows."""

from __future__ import annotations

import os
import random
import zlib
from itertools import combinations
from math import exp, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcelore.llm import toxicity
from sourcelore.llm.common import table

SF_DIR = "/root/testdata/sf0.01"


def _plain_features(piece: str) -> dict:
    out: dict = {}
    for places in combinations(range(len(piece)), 3):
        span = places[-1] - places[0]
        if span <= 4:
            key = tuple(piece[i] for i in places)
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (span - 2)
    return out


def _plain_kernel(a: str, b: str) -> float:
    x, y = _plain_features(a), _plain_features(b)
    size = lambda f: sqrt(sum(v * v for v in f.values()))
    dot = sum(v * y.get(k, 0.0) for k, v in x.items())
    return exp(toxicity.SHARPNESS * (dot / (size(x) * size(y)) - 1)) if dot else exp(-toxicity.SHARPNESS)


def test_kernel_is_the_gapped_subsequence_kernel():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 12))) for _ in range(60)] + ["hahahahaha", "aaaaaaaa", "日本語", "x"]
    pieces = [toxicity.pieces_of(w)[0] for w in words]
    landmarks = toxicity.Landmarks(pieces[:20])
    got = landmarks.kernel(pieces)
    for i, a in enumerate(pieces):
        for j, b in enumerate(pieces[:20]):
            assert got[i, j] == pytest.approx(_plain_kernel(a, b), abs=1e-5)
    assert np.linalg.eigvalsh(landmarks.kernel(pieces[:20]).astype(float)).min() > -1e-5


def test_signs_and_letters_put_in_leave_likeness():
    whole = toxicity.Landmarks(toxicity.pieces_of("idiot"))
    of = lambda word: whole.kernel([toxicity.pieces_of(word)[0]])[0, 0]
    assert of("idiot") == of("i.d.i-o_t") == pytest.approx(1)
    assert of("idiiot") > 0.5 and of("idxiot") > 0.25 and of("table") < 0.06
    assert "i d i o t" in toxicity.words_of("You are an i d i o t, sir") and "you" in toxicity.words_of("You!!")


def test_long_words_are_read_to_their_end():
    pieces = toxicity.pieces_of("x" * 500 + "idiot")
    assert "".join(p[: toxicity.PIECE // 2] for p in pieces).startswith(toxicity.BEGIN + "x" * 400) and any(p.endswith("idiot" + toxicity.END) for p in pieces)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables are not here")
def test_held_out_texts(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    model = toxicity.trained(docs, labels)
    spoiled = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    rows = toxicity.toxicity_report(docs, spoiled.repartition(3)).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    told = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    toxic, clean = [p for t, p in told if t], [p for t, p in told if not t]
    assert sum(toxic) >= 0.55 * len(toxic) and sum(clean) <= 0.04 * len(clean)
    # What is held out teaches nothing, and sources and languages are not looked at.
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")})
    again = toxicity.scored(other.select("doc_id", "text", "lang", "source"), model).collect()
    assert {r.row.doc_id: round(r.score, 6) for r in again} == {r.doc_id: round(r.score, 6) for r in rows}


def test_odd_rows(spark):
    insult = "a fine day to you grumblewort and more of it"
    rows = [(i, f"{insult} number{i}" if i % 4 == 0 else f"a fine day to you and more of it number{i}") for i in range(200)]
    rows += [(500, None), (None, insult), (501, ""), (502, "!!! ..."), (503, "word " * 50_000 + "grumblewort"), (504, "g r u m b l e w o r t"), (3, insult), (3, insult)]
    docs = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], "doc_id long, text string, row string, score int, margins double")
    known = [(i, int(i % 4 == 0), "y") for i in range(200)] + [(0, None, "y"), (4, 0, "y"), (None, 1, "y"), (999, 1, "y")]
    labels = spark.createDataFrame(known, "doc_id long, toxic int, words string")
    found = [(r.doc_id, r.predicted, r.score) for r in toxicity.toxicity_report(docs, labels).collect()]
    assert len(found) == len(rows)
    of = {}
    for doc, predicted, score in found:
        of.setdefault(doc, []).append((predicted, score))
    assert of[503][0][0] == of[504][0][0] == of[None][0][0] == 1 and [p for p, _ in of[3]] == [0, 1, 1]
    assert of[500] == of[501] == of[502] and of[500][0][0] == 0
    assert all(of[i][0][0] == (i % 4 == 0) for i in range(4, 200))
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert {(r.score, r.predicted) for r in toxicity.toxicity_report(docs, some).collect()} == {(0.0, 0)}
