"""Conversation tries and periodic runs against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sourcelore.llm import conversation_trie, periodic_runs

TURNS = "conv_id long, turn long, role string, text string, place int, size string, `a.b` int"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _plain_trie(rows) -> set[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 9
        rebuilt[c] = tuple(turns.get(c - c % 5, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        return [path] + [x for child in children[path] for x in below(child)]

    out = set()
    for path, some in members.items():
        tree = below(path)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in tree if x)
        ends = ",".join(str(c) for c in sorted(c for c, p in rebuilt.items() if p == path))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(some), len(path), parent, len(some), len(children[path]), sum(not children[x] for x in tree), saved, _sha(ends)))
    return out


def _conversations() -> list[tuple]:
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for turn in range(rng.randrange(1, 12)):
            rows.append((c, turn, rng.choice(["user", "user", "assistant"]), rng.choice(["a", "a", "a", "bé", "c" * 9])))
    rows += [r for r in rows if r[0] in (7, 20)]
    rows += [(100, None, None, None), (100, 1, "user", None), (100, None, "x", ""), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(c, t, "user", f"t{t % 3}") for c in (200, 201, 203) for t in range(90)]
    rows += [(303, t, "user", "a") for t in range(3)] + [(1000 + c, 0, "user", "a") for c in range(40)] + [(400, 0, "user", "long " * 50_000)]
    return rows


@pytest.mark.parametrize("stretch", [1024, 4])
def test_trie_against_a_plain_one(spark, monkeypatch, stretch):
    monkeypatch.setattr(conversation_trie, "STRETCH", stretch)
    rows = _conversations()
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS).repartition(5)
    got = conversation_trie.trie_report(frame).collect()
    want = _plain_trie(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([(None, 0, "user", "x", 1, "x", 2)], TURNS)
    assert conversation_trie.trie_report(frame).count() == 0
    assert conversation_trie.trie_report(frame.limit(0)).count() == 0


def _plain_runs(words: list) -> list[tuple]:
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                found[i, length] = min(q, found.get((i, length), q))
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    rng = random.Random(1)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 12)):
            letters, n = rng.choice([1, 2, 2, 3, 5]), rng.choice([0, 1, 5, 6, 30, 90])
            words = [rng.randrange(letters) for _ in range(n)]
            if rng.random() < 0.5 and n > 5:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 4))
                words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            texts.append(words)
        assert [list(map(tuple, r.tolist())) for r in periodic_runs.runs_of(texts)] == [_plain_runs(t) for t in texts]


def test_grammar_tells_how_far_places_agree():
    rng = random.Random(4)
    body = [rng.randrange(3) for _ in range(300)]
    body = body + body[:200] + [1] * 70 + body[50:120]
    sequence = [-1, *body, -2]
    import numpy as np

    grammar = periodic_runs.Grammar(np.array([x + 2 for x in sequence]))
    pairs = [(rng.randrange(1, 600), rng.randrange(1, 600)) for _ in range(2000)]
    pairs = [(a, b) for a, b in pairs if a != b]
    left, right = (np.array(x) for x in zip(*pairs))
    ahead, behind = grammar.agree(left, right, True), grammar.agree(left, right, False)
    for (a, b), f, g in zip(pairs, ahead.tolist(), behind.tolist()):
        n = 0
        while sequence[a + n] == sequence[b + n]:
            n += 1
        m = 0
        while sequence[a - m] == sequence[b - m]:
            m += 1
        assert (f, g) == (n, m)


def test_run_report(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(i, "  ".join(f"w{rng.randrange(900)}" for _ in range(300)) + "\n") for i in range(60, 90)]
    rows += [(500, None), (None, "x y " * 9), (501, ""), (501, ""), (502, "a\x1cb " * 7), (503, "  " * 7), (504, "é " * 100_000), (-5, "to be " * 4)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, runs string")
    got = sorted(map(tuple, periodic_runs.run_report(frame.repartition(3)).collect()), key=str)
    want = []
    for doc, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        h = zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = _plain_runs(words) if doc != 504 else [(0, 100_000, 1)]
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((doc, len(runs), *longest, _sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), _sha(kept)))
    assert got == sorted(want, key=str)
    assert periodic_runs.run_report(frame.limit(0)).count() == 0
