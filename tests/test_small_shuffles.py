"""What is shuffled and kept grows with what is shown, not with all that was read on the way."""

import re

from pyspark.sql import functions as F

from sourcelore import analyze
from sourcelore.operators import cochange


def log(spark):
    rows = [(repo, f"c{k}", f"f{(k * step) % 7}") for repo in ("a", "b") for k in range(20) for step in (1, 2, 3)]
    return spark.createDataFrame(rows, "repo_id string, hash string, file string")


def plan_of(table):
    return table._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_counted_by_numbers(spark):
    touches = cochange._touches(log(spark), 200)
    files = cochange._numbered(cochange._per_file(touches, None))
    # Numbers are of one file, or one commit, of one repository, and the same in each run.
    assert files.select("id").distinct().count() == files.count() == 14
    assert touches.select("commit").distinct().count() == 40
    assert sorted(files.collect()) == sorted(files.repartition(3).collect())
    assert re.search(r"Exchange hashpartitioning\(l#\d+L, r#\d+L,", plan_of(cochange._pairs_by_file(touches, files, 0.3)))


def test_pairs_that_share_too_little_get_no_paths(spark):
    touches = cochange._touches(log(spark), 200)
    files = cochange._numbered(cochange._per_file(touches, None))
    every = {(r["repo_id"], r["path"], r["file"]): r for r in cochange._pairs_by_file(touches, files, 0.0001).collect()}
    some = {(r["repo_id"], r["path"], r["file"]): r for r in cochange._pairs_by_file(touches, files, 0.5).collect()}
    assert 0 < len(some) < len(every)
    assert some == {k: r for k, r in every.items() if r["shared"] / r["commits"] >= 0.5}


def test_few_branches_read_the_log(spark):
    # 72 before: each of them is a shuffle of the log wherever Spark does not see that they are the same.
    assert 0 < plan_of(cochange.top_co_change(log(spark))).count("Scan ") <= 22


def test_log_is_not_persisted_without_a_workdir(spark, source_files, tmp_path):
    """Spark shuffles a persisted log anew for each branch of a plan."""
    commits = log(spark).select("*", F.lit("Ann").alias("author"), F.lit(None).cast("timestamp").alias("ts"), F.lit(0).cast("bigint").alias("log_pos"))
    code = source_files({f"f{i}": "" for i in range(7)}, "a")
    analysis = analyze(code, commits, use_config=False)
    assert not analysis["commit_files"].storageLevel.useMemory
    analysis.release()
    analyze(code, commits, use_config=False, workdir=str(tmp_path))
    assert (tmp_path / "commit_files" / "_SUCCESS").exists()


def test_unused_files_take_one_pass_over_the_texts(spark, source_files):
    commits = spark.createDataFrame([], "repo_id string, hash string, file string, author string, ts timestamp, log_pos long")
    analysis = analyze(source_files({"a.js": "export const a = 1;", "b.js": "import './a';\nexport const b = 1;"}), commits, use_config=False)
    assert analysis["exporting"].storageLevel.useMemory
    assert re.search(r"InMemoryTableScan \[repo_id#\d+, path#\d+, exports#\d+", plan_of(analysis["dead_code"]))
    assert [(r["path"], r["exports"]) for r in analysis["dead_code"].collect()] == [("b.js", ["b"])]
    analysis.release()


def test_paths_read_the_files_once(spark):
    rows = [("r", "a.js")] * 3 + [("r", "b.py"), (None, "a.js"), (None, "a.js"), ("r", "notes.txt"), ("r", None)]
    code = spark.createDataFrame(rows, "repo_id string, path string").withColumn("content", F.lit(""))
    commits = spark.createDataFrame([], "repo_id string, hash string, file string, author string, ts timestamp, log_pos long")
    analysis = analyze(code, commits, use_config=False, include_co_change=False)
    named = analysis["paths"]
    assert plan_of(named).count("Scan ") == 1
    # As a join of the files with themselves has them: equal files meet each other, and null meets nothing.
    assert sorted((r["repo_id"] or "", r["path"]) for r in named.collect()) == [("", "a.js")] * 2 + [("r", "a.js")] * 9 + [("r", "b.py")]
    analysis.release()
