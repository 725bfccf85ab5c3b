"""The queries next to their SQL, and against plain versions where SQL cannot say the same."""

from __future__ import annotations

import hashlib
import os
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from checks.compare import _rows, connect
from sourcelore.llm import bpe, jaccard_join, language_id, queries
from sourcelore.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables are not here")


@pytest.mark.parametrize("name", list(queries.oracles()))
def test_matches_sql(spark, name):
    frame = queries.build()[name](spark, SF_DIR)
    cursor = connect(SF_DIR).execute(queries.oracles()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert _rows(frame.columns, frame.collect()) == _rows(columns, cursor.fetchall())


def test_language_on_held_out_rows(spark):
    rows = queries.build()["op5_language_id"](spark, SF_DIR)
    known = table(spark, SF_DIR, "documents").select("doc_id", "lang")
    told = rows.where("held_out and lang_pred <> 'und'").join(known.where("lang is not null"), "doc_id").select("lang", "lang_pred", "score").collect()
    assert len(told) > 30
    assert sum(r.lang == r.lang_pred for r in told) >= 0.95 * len(told)
    assert all(0 <= r.score <= 1 for r in told)
    marked = rows.select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in marked)


def test_pages_keep_their_article(spark):
    import html
    import re

    rows = queries.build()["op6_html_text"](spark, SF_DIR).select("page_id", "text", "n_chars")
    found = {r.page_id: r for r in rows.collect()}
    pages = table(spark, SF_DIR, "pages").collect()
    assert set(found) == {p.page_id for p in pages}
    for page in pages:
        inside = re.search(r"<article>(.*?)(</article>|$)", page.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", inside[1]) if inside else []
        plain = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", ""))).strip() for b in blocks]
        assert found[page.page_id].text == "\n\n".join(b for b in plain if b), page.page_id
        assert found[page.page_id].n_chars == len(found[page.page_id].text)


def test_shards(spark):
    rows = queries.build()["op7_sharding"](spark, SF_DIR).collect()
    docs = {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by_shard: dict[int, list] = {}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        by_shard.setdefault(r.shard, []).append(r)
    assert set(by_shard) <= set(range(24))
    for members in by_shard.values():
        assert sorted(m.slot for m in members) == list(range(len(members)))
    # A cut is off by half a document at most, and a shard lies behind five cuts.
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert max(abs(sum(m["size"] for m in members) - total / 24) for members in by_shard.values()) <= 2.5 * largest


def _classes(texts: dict[int, str | None], threshold: float = 0.8) -> tuple[dict, dict]:
    shingler = jaccard_join.Shingler(5)
    sets = {i: frozenset(shingler.set_of(t).tolist()) for i, t in texts.items()}
    links, parent = dict.fromkeys(texts, 0), {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= threshold * len(x | y):
            links[a] += 1
            links[b] += 1
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in texts}, links


def test_near_duplicates_against_all_pairs(spark):
    docs = table(spark, SF_DIR, "documents")
    classes, links = _classes({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    rows = queries.build()["op8_jaccard_join"](spark, SF_DIR).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes
    assert {r.doc_id: r.n_links for r in rows} == links


def test_near_duplicates_in_large_buckets(spark):
    """Hundreds of near copies in buckets of 16 sets: split, cut into blocks, and still no link lost."""
    import random

    random.seed(7)
    base = [f"w{random.randrange(500)}" for _ in range(120)]
    texts: dict[int, str | None] = {}
    for i in range(150):
        words = list(base)
        for _ in range(random.choice([1, 1, 2])):
            words[random.randrange(120)] = f"x{random.randrange(10**6)}"
        texts[i] = " ".join(words)
    passage = " ".join(base[:50])
    for i in range(150, 230):
        texts[i] = " ".join(f"y{random.randrange(10**6)}" for _ in range(200)) + " " + passage
    texts |= {300: "one two", 301: "One, two!", 302: None, 303: "", 304: "...", 305: base[0]}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = jaccard_join.near_duplicates(frame, bucket=16).collect()
    classes, links = _classes(texts)
    found = {r.doc_id: r.n_links for r in rows}
    assert {r.doc_id: r.class_id for r in rows} == classes
    assert sum(found.values()) >= 0.999 * sum(links.values())
    assert all(found[i] <= links[i] for i in links)


def test_contained_pairs_survive_splits_as_often_as_the_runs_count_on(spark):
    """Every pair of a text and its first four fifths (similarity 0.8) meets in buckets of more than one set, split twice."""
    import math
    import random

    rng = random.Random(11)
    texts = []
    for i in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(204)]
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:164]))]
    sets = jaccard_join.shingle_sets(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    assert {(r["size"]) for r in sets.select("size").collect()} == {200, 160}
    pair_of = {bytes(r.sig): r.doc_id // 2 for r in sets.select("sig", "doc_id").collect()}

    def shared(rows):
        met = {}
        for r in rows:
            met.setdefault((pair_of[bytes(r.sig)], r.path), set()).add(bytes(r.sig))
        return [pair for (pair, _), members in met.items() if len(members) == 2]

    before = shared(sets.select("sig", F.explode("paths").alias("path")).collect())
    after = shared(jaccard_join.leaves(sets, bucket=1).select("sig", "path").collect())
    kept = len(after) / len(before)
    assert len(before) / 400 >= 0.95 * jaccard_join.SHARED_A_RUN * jaccard_join.runs_for(jaccard_join.RECALL, 0.8)
    assert kept >= math.log(1 / (1 - jaccard_join.RECALL)) / (jaccard_join.SHARED_A_RUN * jaccard_join.runs_for(jaccard_join.RECALL, 0.8))


def test_bpe_is_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = bpe.ByteBPE(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    odd = ["", " ", "a" * 3000, "  x\n\n y\t", "I'll we've 'S don't", "日本語 テスト ñandú ß", "a b c\x1cd\x85e", "<|endoftext|>x <|endoftext|>", "😀👩‍👩‍👧 123abc456", "\r\n\r\n  \n", "ab" * 2000, "é" * 500]
    for text in odd:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rows = {r.doc_id: r for r in queries.build()["op9_bpe"](spark, SF_DIR).collect()}
    for doc in table(spark, SF_DIR, "documents").select("doc_id", "text").collect():
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        r = rows[doc.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_predictions_do_not_depend_on_labels(spark):
    docs = table(spark, SF_DIR, "documents")
    model = language_id.trained(docs)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    take = lambda frame: sorted((r.row.doc_id, r.lang_pred, r.score) for r in language_id.identified(frame, model).collect())
    assert take(docs) == take(other)
