from __future__ import annotations

import gzip
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sourcelore.operators import cochange, history
from sourcelore.sources import commit_log

SCHEMA = "repo_id string, hash string, author string, ts timestamp, log_pos long, file string"
DAY = datetime(2024, 1, 1)


def log(spark, commits):
    """commits: newest first, (hash, author, day or None, [files])."""
    rows = [
        ("r", h, a, None if d is None else DAY + timedelta(days=d), i, f)
        for i, (h, a, d, files) in enumerate(commits)
        for f in files
    ]
    return spark.createDataFrame(rows, SCHEMA)


def random_log(spark, seed, commits=40, files=12, bulk=()):
    rng = random.Random(seed)
    names = [f"f{i:02}" for i in range(files)]
    rows = []
    for i in range(commits):
        size = rng.randint(1, 3)
        touched = rng.choices(names, k=size)
        if i in bulk:
            touched = rng.sample(names, rng.randint(files // 2, files))
        rows.append((f"c{i}", f"a{rng.randint(0, 3)}", rng.choice([None, rng.randint(0, 50)]), touched))
    return rows


def test_history_and_commit_files(spark):
    table = log(spark, [("c2", "Test User", 1, ["file.js"]), ("c1", "Test User", 0, ["file.js", "b.js", "b.js"])])
    assert [r["hash"] for r in history.file_history(table, "file.js").collect()] == ["c2", "c1"]
    assert history.file_history(table, "nope").collect() == []
    for asked in ("./file.js", " lib/../file.js ", ".\\file.js"):
        assert [r["hash"] for r in history.file_history(table, asked).collect()] == ["c2", "c1"]
    assert [r["hash"] for r in history.file_history(table, "/work/r/file.js", "/work/r").collect()] == ["c2", "c1"]
    assert history.file_history(table, "../file.js").collect() == history.file_history(table, "").collect() == []
    assert sorted(r["file"] for r in history.commit_file_list(table, "c1").collect()) == ["b.js", "file.js"]
    assert history.commit_file_list(table).count() == 3
    many = history.file_history(table, spark.createDataFrame([("r", "b.js")], "repo_id string, path string"))
    assert [r["hash"] for r in many.collect()] == ["c1", "c1"]


def test_ownership(spark):
    table = log(spark, [("c2", "Test User", 1, ["file.js"]), ("c1", "Test User", 0, ["file.js"])])
    wanted = spark.createDataFrame([("r", "file.js"), ("r", "none.js")], "repo_id string, path string")
    got = {r["path"]: tuple(r)[2:] for r in history.ownership_of(wanted, history.file_authors(table)).collect()}
    assert got == {"file.js": ("Test User", 2, 1), "none.js": ("Unknown", 0, 0)}


def test_recently_modified(spark):
    rows = [("new", 59), ("edge", 30), ("old", 29), ("odd", None), ("future", 400)]
    table = log(spark, [(h, "a", d, ["f", "f", h]) for h, d in rows])
    commits = table.select("repo_id", "hash", "author", "ts").distinct().withColumn("message", F.lit("m"))
    got = history.recently_modified(table, commits, 30, DAY + timedelta(days=60))
    assert sorted((r["file"], r["hash"]) for r in got.collect()) == sorted(
        [("f", h) for h in ("new", "edge", "odd", "future")] + [(h, h) for h in ("new", "edge", "odd", "future")]
    )


def test_change_frequency(spark):
    table = log(
        spark,
        [
            ("c5", "a", 10, ["two", "backwards", "odd"]),
            ("c4", "a", None, ["middle"]),
            ("c3", "a", 12, ["backwards", "same", "same"]),
            ("c2", "a", 6, ["two", "once", "middle"]),
            ("c1", "a", None, ["odd"]),
        ],
    )
    got = {r["path"]: r["change_frequency"] for r in history.change_frequency(table).collect()}
    assert got == {"two": 0.5, "backwards": 0.0, "odd": 0.0, "same": 0.0, "once": 0.0, "middle": 0.0}


def test_ownership_and_frequency_against_brute_force(spark):
    commits = random_log(spark, 3)
    table = log(spark, commits)
    by_file = defaultdict(list)
    for h, author, day, touched in commits:
        for f in touched:
            by_file[f].append((author, day))
    ranks, frequency = {}, {}
    for f, rows in by_file.items():
        counts = Counter(a for a, _ in rows)
        first = {a: next(i for i, (b, _) in enumerate(rows) if b == a) for a in counts}
        order = sorted(counts, key=lambda a: (-counts[a], first[a]))
        ranks.update({(f, a): (counts[a], i + 1) for i, a in enumerate(order)})
        newest, oldest = rows[0][1], rows[-1][1]
        span = 0 if newest is None or oldest is None else newest - oldest
        frequency[f] = len(rows) / span if len(rows) > 1 and span > 0 else 0.0
    got = {(r["path"], r["author"]): (r["commits"], r["rank"]) for r in history.file_authors(table).collect()}
    assert got == ranks
    got = {r["path"]: r["change_frequency"] for r in history.change_frequency(table).collect()}
    assert got == pytest.approx(frequency)


def brute_partners(commits, threshold):
    sets = [set(touched) for _, _, _, touched in commits]
    totals = Counter(f for s in sets for f in s)
    shared = Counter((f, g) for s in sets for f in s for g in s if f != g)
    return {(f, g): (n, n / totals[f]) for (f, g), n in shared.items() if n / totals[f] >= threshold}


def test_co_change_examples(spark):
    both = log(spark, [("c1", "a", 0, ["a.js", "b.js"])])
    assert sorted((r["path"], r["file"], r["correlation"]) for r in cochange.co_change(both).collect()) == [
        ("a.js", "b.js", 1.0),
        ("b.js", "a.js", 1.0),
    ]
    table = log(spark, [("c2", "a", 1, ["a.js"]), ("c1", "a", 0, ["a.js", "b.js"])])
    strict = cochange.co_change(table, 0.6).collect()
    assert [(r["path"], r["file"]) for r in strict] == [("b.js", "a.js")]


@pytest.mark.parametrize("bulk_size, threshold", [(1, 0.3), (3, 0.0001), (3, 0.3), (200, 0.3)])
def test_co_change_against_brute_force(spark, bulk_size, threshold):
    commits = random_log(spark, 11, commits=30, files=14, bulk=(4, 9, 20))
    table = log(spark, commits)
    expected = brute_partners(commits, threshold)
    got = cochange.co_change(table, threshold, bulk_size=bulk_size).collect()
    assert {(r["path"], r["file"]): (r["count"], r["correlation"]) for r in got} == expected
    assert len(got) == len(expected)

    targets = spark.createDataFrame([("r", f"f{i:02}") for i in range(5)], "repo_id string, path string")
    for top_n in (4,):
        ranked = defaultdict(list)
        for (f, g), (n, c) in expected.items():
            if f <= "f04":
                ranked[f].append((-c, g))
        top = {(f, g, i + 1) for f, rows in ranked.items() for i, (_, g) in enumerate(sorted(rows)[:top_n])}
        got = cochange.co_change(table, threshold, top_n, targets, bulk_size).collect()
        assert {(r["path"], r["file"], r["rank"]) for r in got} == top


def test_one_bulk_commit_is_not_paired_file_by_file(spark):
    """A commit that touches 20,000 files: the best partners of all of them, without 200 million pairs."""
    bulk = spark.range(20_000).select(
        F.lit("r").alias("repo_id"),
        F.lit("import").alias("hash"),
        F.lit("a").alias("author"),
        F.lit(DAY).alias("ts"),
        F.lit(9).cast("long").alias("log_pos"),
        F.format_string("f%05d", "id").alias("file"),
    )
    few = log(spark, [("c1", "a", 1, ["f00007", "f19999"]), ("c0", "a", 1, ["f19999", "new"])])
    top = cochange.top_co_change(bulk.unionByName(few)).cache()
    assert top.count() == 20_000 * 5 + 1
    rows = {r["path"]: [] for r in top.select("path").distinct().collect()}
    for r in top.filter(F.col("path").isin("f00000", "f00003", "f00007", "f19999", "new")).orderBy("rank").collect():
        rows[r["path"]].append((r["file"], round(r["correlation"], 3)))
    assert rows["f00000"] == [(f"f0000{i}", 1.0) for i in range(1, 6)]
    assert rows["f00003"] == [(f"f0000{i}", 1.0) for i in (0, 1, 2, 4, 5)]
    assert rows["f00007"] == [("f19999", 1.0)] + [(f"f0000{i}", 0.5) for i in range(4)]
    assert rows["f19999"] == [("f00007", 0.667)] + [(f"f0000{i}", 0.333) for i in range(4)]
    assert rows["new"] == [("f19999", 1.0)]
    top.unpersist()


def _many_bulk_commits(spark):
    """60 files, each in one commit of all and in ten of its own twenty of three."""
    rows = [("all", f"f{i:02}") for i in range(60)]
    rows += [(f"own{i // 20}-{k}", f"f{i:02}") for i in range(60) for k in range(10) if (i + k) % 5]
    return spark.createDataFrame([("r", h, f) for h, f in rows], "repo_id string, hash string, file string")


def test_groups_are_candidates_by_their_smallest_bulk_commits_only(spark):
    table = _many_bulk_commits(spark)
    touches = cochange._touches(table, 5)
    groups = cochange._groups(touches, cochange._per_file(touches, None), 0.6)
    # 15 different sets of bulk commits, all of which meet in the commit of all files.
    assert groups.count() == 15
    met = cochange._group_candidates(groups).collect()
    assert len(met) == 3 * 5 * 5
    got = cochange.co_change(table, 0.6, bulk_size=5)
    assert got.exceptAll(cochange.co_change(table, 0.6, bulk_size=1000)).count() == 0
    assert got.count() == cochange.co_change(table, 0.6, bulk_size=1000).count() > 0


def test_pairs_of_groups_are_counted_where_they_meet(spark):
    """Each pair comes once with its count, and no pair is shuffled to be counted or told from its repetitions."""
    table = _many_bulk_commits(spark)
    touches = cochange._touches(table, 5)
    groups = cochange._groups(touches, cochange._per_file(touches, None), 0.6)
    sets = {r["bulk_group"]: {c["commit"] for c in r["bulk"]} for r in groups.collect()}
    pairs = cochange._group_candidates(groups)
    got = {(r["path_group"], r["file_group"]): r["bulk_shared"] for r in pairs.collect()}
    assert len(got) == pairs.count() and got == {(a, b): len(sets[a] & sets[b]) for a, b in got}
    above = pairs._jdf.queryExecution().sparkPlan().toString().split("Join")[0]
    assert "Exchange" not in above and "Aggregate" not in above


def test_files_in_bulk_commits_only_and_in_both_kinds(spark):
    """The full list over two commits of 600 files, more than a row of a group brings along, and ordinary ones."""
    rows = [(f"q{k}", f"f{i:03}") for k in range(2) for i in range(600)] + [("c", "f000"), ("c", "f001"), ("d", "f000"), ("d", "f600")]
    table = spark.createDataFrame([("r", h, f) for h, f in rows], "repo_id string, hash string, file string")
    got = {(r["path"], r["file"]): r["count"] for r in cochange.co_change(table, 0.5).collect()}
    names = [f"f{i:03}" for i in range(600)]
    expected = {(a, b): 2 for a in names for b in names if a != b}
    expected |= {("f000", "f001"): 3, ("f001", "f000"): 3, ("f600", "f000"): 1}
    assert got == expected


def test_a_bulk_commit_beside_many_small_ones_yields_no_candidates(spark):
    rows = [("import", f"f{i:03}") for i in range(500)] + [(f"c{i}-{k}", f"f{i:03}") for i in range(500) for k in range(4)]
    table = spark.createDataFrame([("r", h, f) for h, f in rows], "repo_id string, hash string, file string")
    touches = cochange._touches(table, 100)
    groups = cochange._groups(touches, cochange._per_file(touches, None), 0.3)
    assert cochange._group_candidates(groups).count() == 0
    assert cochange.co_change(table, 0.3, bulk_size=100).count() == 0


LOG_TEXT = """stray file before any header
1111111aaaa\tAnn\t2024-03-02T10:00:00+02:00\tmerge, no files
2222222bbbb\tBob\t2024-03-01T09:00:00Z\tsubject\twith tab
src/a.js
 src\\b.js
src/a.js

3333333CCCC\tAnn\tnot a date\tfirst

"quoted \\303\\251.js"
1234567\tonly\tthree
xyz4567\tno\thash\there
"""


def test_commit_log(spark, tmp_path):
    file = tmp_path / "r1.log"
    file.write_text(LOG_TEXT)
    commits, touched = commit_log.load_commit_log(spark, str(file))
    got = [tuple(r) for r in commits.orderBy("log_pos").select("repo_id", "hash", "author", "message").collect()]
    assert got == [
        ("r1", "1111111aaaa", "Ann", "merge, no files"),
        ("r1", "2222222bbbb", "Bob", "subject\twith tab"),
        ("r1", "3333333CCCC", "Ann", "first"),
    ]
    stamps = {r["hash"][0]: r["ts"] for r in commits.collect()}
    assert stamps["1"] == datetime(2024, 3, 2, 8) and stamps["2"] == datetime(2024, 3, 1, 9) and stamps["3"] is None
    assert sorted((r["hash"][0], r["file"]) for r in touched.collect()) == [
        ("2", "src/a.js"), ("2", "src/a.js"), ("2", "src/b.js"),
        ("3", '"quoted /303/251.js"'), ("3", "1234567\tonly\tthree"), ("3", "xyz4567\tno\thash\there"),
    ]


def test_commit_log_over_many_splits(spark, tmp_path):
    """Splits that start anywhere: in a header, in a long file list, in blank lines."""
    rng = random.Random(5)
    expected, text = [], ""
    for i in range(300):
        digest = f"{i:07x}abc"
        text += f"{digest}\tauthor {i % 7}\t2024-01-01T00:00:00Z\tmessage {i}\n"
        for j in range(rng.choice([0, 1, 3, 200 if i % 50 == 0 else 2])):
            text += f"dir/file{rng.randint(0, 40)}.js\n"
            expected.append((digest, text.rsplit("\n", 2)[1]))
        text += rng.choice(["", "\n", "\n\n"])
    (tmp_path / "r1.log").write_text(text)
    (tmp_path / "r2.log").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        commits, touched = commit_log.load_commit_log(spark, str(tmp_path))
        for repo in ("r1", "r2"):
            rows = commits.filter(F.col("repo_id") == repo).orderBy("log_pos").collect()
            assert [r["hash"] for r in rows] == [f"{i:07x}abc" for i in range(300)]
            got = touched.filter(F.col("repo_id") == repo).collect()
            assert sorted((r["hash"], r["file"]) for r in got) == sorted(expected)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_compressed_log_is_cut_into_ranges(spark, tmp_path, monkeypatch):
    """One unsplittable file: no window holds more than a range, and positions are those of the plain text."""
    rng = random.Random(6)
    expected, positions, text = [], [], ""
    for i in range(120):
        positions.append(len(text.encode()))
        text += f"{i:07x}abc\tJörg {i % 7}\t2024-01-01T00:00:00Z\tmessage {i}\n"
        for j in range(rng.choice([0, 1, 3, 60 if i % 20 == 0 else 2])):
            text += f"dir/file{rng.randint(0, 40)}.js\n"
            expected.append((f"{i:07x}abc", text.rsplit("\n", 2)[1], positions[-1]))
        text += rng.choice(["", "\n", "\n\n\n"])
    with gzip.open(tmp_path / "r1.log.gz", "wt", encoding="utf-8") as file:
        file.write(text)
    (tmp_path / "r2.log").write_text(text, encoding="utf-8")
    monkeypatch.setattr(commit_log, "RANGE_BITS", 3)
    lines = commit_log.read_log_lines(spark, str(tmp_path))
    assert lines.filter("repo_id = 'r1'").select("block").distinct().count() == 1
    commits, touched = commit_log.load_commit_log(spark, str(tmp_path))
    for repo in ("r1", "r2"):
        rows = commits.filter(F.col("repo_id") == repo).orderBy("log_pos").collect()
        assert [(r["hash"], r["log_pos"]) for r in rows] == [(f"{i:07x}abc", at) for i, at in enumerate(positions)]
        got = touched.filter(F.col("repo_id") == repo).collect()
        assert sorted((r["hash"], r["file"], r["log_pos"]) for r in got) == sorted(expected)
