from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_queries import _classes

SF_DIR = "/root/testdata/sf0.001"


def test_pipeline_keeps_one_of_equal_texts_and_encodes_whole_texts(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert rows and len(corpus_pipeline.STAGES) == 5
    for row in rows:
        assert row["ids"] == library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(row["ids"])
    kept = {row["doc_id"] for row in rows}
    assert len({texts[i] for i in kept}) == len(kept)
    assert all(any(c.isalpha() for c in texts[i]) for i in kept)


def _letters(rows):
    return [r for r in rows if any(c.isalpha() for c in r["text"] or "")]


def _one_of_equal(rows):
    """Of texts that differ in the case of A-Z at most, the largest id stays."""
    best = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        best[re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])] = r
    return list(best.values())


def _one_of_alike(rows):
    classes, _ = _classes({r["doc_id"]: r["text"] for r in rows})
    return [r for r in rows if classes[r["doc_id"]] == r["doc_id"]]


def _copies(rows):
    """How often the mix takes each document."""
    size = {r["doc_id"]: len(re.findall(r"[^ \t-\r]+", r["text"])) for r in rows}
    of = defaultdict(list)
    for r in rows:
        of[r["source"]].append(r["doc_id"])
    words = {s: sum(size[i] for i in ids) for s, ids in of.items()}
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    target, left, open_ = {}, sum(words.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * words[s] < weight[s] * level}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 3 * words[s] for s in full}
        left, open_ = left - sum(3 * words[s] for s in full), open_ - full
    copies = Counter()
    for s, ids in of.items():
        rate = target[s] / words[s]
        left = target[s] - math.floor(rate) * words[s]
        copies |= dict.fromkeys(ids, math.floor(rate))
        if rate == math.floor(rate):
            continue
        # Odds in proportion to size; from the largest down, those of one or more are certain.
        factor, rest = None, left
        for n, i in enumerate(by_size := sorted(ids, key=lambda i: -size[i])):
            factor = rest / sum(size[j] ** 2 for j in by_size[n:])
            if factor * size[i] < 1:
                break
            rest -= size[i]

        def rank(i):
            u = (int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            p = min(1, factor * size[i])
            return u * (1 - p) / (u * (1 - p) + (1 - u) * p), i

        order = sorted(ids, key=rank)
        for _ in range(3):
            order, taken, gap = [i for i in order if size[i] <= left], [], left
            while order and size[order[0]] <= gap:
                taken.append(order.pop(0))
                gap -= size[taken[-1]]
            left = gap
            copies.update(taken)
        spare = [i for i in ids if copies[i] == math.floor(rate) and size[i] < 2 * left]
        if spare:
            copies[min(spare, key=lambda i: (abs(left - size[i]), rank(i)))] += 1
    return copies


def test_every_stage_is_its_plain_version(spark, tmp_path):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [r.asDict() for r in given.collect()]
    long = sorted((r for r in rows if r["text"]), key=lambda r: (-len(r["text"]), r["doc_id"]))[:3]
    odd = ["12 34 !!", None, "", *(r["text"] + " one more" for r in long)]
    rows += [long[0] | {"doc_id": 10_000 + i, "text": text, "source": f"src{i % 3}"} for i, text in enumerate(odd)]
    rows += [long[0] | {"doc_id": 20_000, "text": re.sub("[a-z]", lambda m: m[0].upper(), long[1]["text"])}]
    spark.createDataFrame([tuple(r[c] for c in given.columns) for r in rows], given.schema).write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    for stage, plain in zip(stages[:3], (_letters, _one_of_equal, _one_of_alike)):
        kept = plain(rows)
        assert len(kept) < len(rows), f"nothing to do for {plain.__name__}"
        rows, frame = kept, stage(spark, frame, str(tmp_path))
        assert sorted(r.doc_id for r in frame.select("doc_id").collect()) == sorted(r["doc_id"] for r in rows), plain.__name__
    copies = _copies(rows)
    assert len(set(copies.values())) > 1
    frame = stages[3](spark, frame, str(tmp_path))
    assert Counter(r.doc_id for r in frame.select("doc_id").collect()) == +copies

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        back = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        expected[(r["doc_id"], r["source"], r["lang"], tuple(ids), len(ids), back)] += copies[r["doc_id"]]
    found = corpus_pipeline.run(spark, str(tmp_path))
    fields = ["doc_id", "source", "lang", "ids", "n_tokens", "decoded_sha256"]
    assert found.columns == fields
    assert Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in found.collect()) == +expected


def test_last_stage_encodes_and_decodes(spark):
    import hashlib

    texts = {1: "One more text, é 12", 2: "", 3: None}
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in texts.items()], "doc_id long, text string, source string, lang string")
    found = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}
    assert {i: r.decoded_sha256 for i, r in found.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}
