from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sourcelore import analyze, architecture_map, onboarding, risk_report
from sourcelore.functions.fixed import LANGUAGES
from sourcelore.operators import listings, summary
from sourcelore.operators.files import ignore_patterns
from sourcelore.operators.joins import attach
from sourcelore.plans.reports import analysis_summary
from sourcelore.sources import files as file_sources
from sourcelore.sources import sinks
from tests.test_history import log


def test_language_stats(spark):
    rows = [("r", "javascript", 100, 1000), ("r", "javascript", 200, 2000), ("r", "python", 150, 1500)]
    table = spark.createDataFrame(rows, "repo_id string, language string, lines long, size long")
    stats = summary.language_stats(table)
    assert {tuple(r)[1:] for r in stats.collect()} == {("javascript", 2, 300, 3000), ("python", 1, 150, 1500)}
    shares = {r["language"]: r["percentage"] for r in summary.language_percentages(stats).collect()}
    assert shares == pytest.approx({"javascript": 200 / 3, "python": 100 / 3})


def test_risk_score(spark):
    rows = [
        (3, 50, 0.05, 1, 0, 0), (25, 600, 0.6, 12, 15, 14), (20, 500, 0.5, 10, 10, 9), (10, 300, 0.2, 5, 5, 4),
        (5, 150, 0.1, 5, 2, 0), (None, None, None, None, None, 0), (21, 151, 0.15, 6, 3, 7),
    ]
    schema = "complexity long, lines long, change_frequency double, contributor_count long, incoming long, expected long"
    got = spark.createDataFrame(rows, schema).select("expected", summary.risk_score().alias("score")).collect()
    assert [r["score"] for r in got] == [r["expected"] for r in got]


def test_categories(spark):
    rows = {
        ("src/index.js", 0): "entryPoints", ("src/utils/helper.js", 1): "utilities", ("test/app.test.js", 0): "tests",
        ("package.json", 0): "config", ("README.md", 0): "documentation", ("src/core.js", 4): "core",
        ("src/core2.js", 3): "utilities", ("latest.js", 9): "tests", ("mapper.js", 9): "entryPoints",
        ("a/webpack.config.js", 0): "config", ("config/x.js", 0): "utilities", ("readme/x.js", 0): "documentation",
        ("Inspect/x.js", 9): "tests", ("src/Utils/x.js", 9): "utilities",
    }
    table = spark.createDataFrame([("r", p, n) for p, n in rows], "repo_id string, path string, incoming long")
    got = {(r["path"], r["incoming"]): r["category"] for r in summary.categorize(table).collect()}
    assert got == rows
    counts = {r["category"]: r["files"] for r in summary.category_counts(summary.categorize(table)).collect()}
    assert counts["tests"] == 3 and sum(counts.values()) == len(rows)
    assert {r["directory"] for r in summary.test_directories(summary.categorize(table)).collect()} == {"test", ".", "Inspect"}


def test_features(spark):
    expected = {
        "auth/login.js": "auth", "src/commands/analyze.js": "commands", "src/Lib/analyzers/x/y.js": "analyzers",
        "tests/analyzers.test.js": None, "main.js": None, "Bin/utils/a.js": None, "payments//process.js": "payments",
    }
    table = spark.createDataFrame([("r", p) for p in expected], "repo_id string, path string")
    got = {r["path"]: r["name"] for r in summary.feature_files(table).collect()}
    assert got == {p: n for p, n in expected.items() if n}


def test_positions_over_many_partitions(spark):
    table = spark.range(5_000).select(
        F.when(F.col("id") % 7 == 0, "small").when(F.col("id") % 11 == 0, "tiny").otherwise("large").alias("repo_id"),
        F.format_string("p%05d", (F.col("id") * 7919) % 5_000).alias("path"),
        (F.col("id") % 5).alias("risk_score"),
    )
    got = listings.position_in_repo(table.repartition(13), [F.desc("risk_score"), F.asc("path")]).collect()
    assert len(got) == 5_000
    for repo in ("small", "tiny", "large"):
        rows = sorted((r for r in got if r["repo_id"] == repo), key=lambda r: (-r["risk_score"], r["path"]))
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_limits_and_remainders(spark):
    rows = [("r", f"p{i:02}", i % 3) for i in range(13)] + [("s", "p", 1)]
    table = spark.createDataFrame(rows, "repo_id string, path string, n long")
    got = listings.with_remainder(table, ["repo_id"], ["path"], 10).collect()
    assert {(r["repo_id"], r["remaining"]) for r in got} == {("r", 3), ("s", 0)} and len(got) == 11
    plan = listings.top_per(table, ["repo_id"], ["path"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    for option, value in {"7": 7, "7.9": 7, "abc": 5, "": 5, None: 5, "0": 5, 0: 5, 3: 3, " 8x": 8, "-2": -2}.items():
        assert listings.threshold_value(option) == value


def test_attach_splits_a_hot_key(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 200_000, 1, 8).select(
            F.lit("r").alias("repo_id"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("hash"),
            F.col("id").cast("string").alias("file"),
        )
        sizes = rows.groupBy("repo_id", "hash").agg(F.count("*").alias("n"))
        joined = attach(rows, sizes, ["repo_id", "hash"])
        assert joined.filter("n > 1").count() == 66_667
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


TREE = {
    "src/index.js": "import { a } from './core'; export const start = () => a;",
    "src/core.js": "export const a = 1; if (a) { }",
    "src/auth/login.js": "import { a } from '../core'; export function login() {}",
    "src/auth/unused.js": "export class Unused {}",
    "tests/core.test.js": "require('../src/core'); exports.t = 1;",
    "node_modules/x/index.js": "module.exports = 1;",
    "README.md": "# hi",
    "tool.py": "import os",
}


@pytest.fixture(scope="module")
def analysis(spark, source_files):
    commits = [
        ("c3", "Ann", 4, ["src/core.js", "src/index.js"]),
        ("c2", "Bob", 2, ["src/core.js", "src/auth/login.js", "gone.js"]),
        ("c1", "Ann", 0, ["src/core.js", "src/index.js", "README.md"]),
    ]
    result = analyze(source_files(TREE), log(spark, commits), ignore="tool.py")
    yield result
    result.release()


def test_analyze(analysis):
    rows = {r["path"]: r for r in analysis["files"].collect()}
    assert set(rows) == {"src/index.js", "src/core.js", "src/auth/login.js", "src/auth/unused.js", "tests/core.test.js"}
    core = rows["src/core.js"]
    assert (core["primary_author"], core["total_commits"], core["contributor_count"], core["change_frequency"]) == ("Ann", 3, 2, 0.75)
    assert (core["incoming"], core["outgoing"]) == (3, 0)
    assert [p["file"] for p in core["co_changed_files"]] == ["src/index.js", "README.md", "gone.js", "src/auth/login.js"]
    unused = rows["src/auth/unused.js"]
    assert (unused["primary_author"], unused["total_commits"], unused["change_frequency"], unused["co_changed_files"]) == ("Unknown", 0, 0.0, [])
    assert {r["path"] for r in analysis["dead_code"].collect()} == {"src/auth/login.js", "src/auth/unused.js"}
    assert {tuple(r)[1:] for r in analysis["contributors"].collect()} == {("Ann", 2, 4), ("Bob", 1, 2)}


def test_skip_co_change_and_empty_tree(spark, source_files):
    history = log(spark, [("c1", "a", 0, ["a.js", "b.js"])])
    result = analyze(source_files({"a.js": "", "b.js": ""}), history, include_co_change=False, use_config=False)
    assert all(r["co_changed_files"] == [] for r in result["files"].collect()) and "co_change" not in result
    empty = analyze(source_files({"a.md": ""}), history, use_config=False)
    assert empty["files"].count() == 0 and empty["dead_code"].count() == 0
    result.release(), empty.release()


def test_reports(analysis, tmp_path):
    overview = analysis_summary(analysis)["overview"].collect()[0]
    assert tuple(overview)[1:] == (5, 2, ["javascript"])
    areas = architecture_map(analysis)
    assert {(r["path"], r["incoming"]) for r in areas["key_dependencies"].collect()} == {("src/core.js", 3)}
    assert {(r["name"], r["file_count"]) for r in areas["features"].collect()} == {("auth", 2)}
    guide = onboarding(analysis)
    assert [r["path"] for r in guide["entry_points"].collect()] == ["src/index.js"]
    assert [r["directory"] for r in guide["test_directories"].collect()] == ["tests"]
    assert guide["test_files"].collect()[0]["test_files"] == 1
    report = risk_report(analysis, "1")
    ranked = report["high_risk_files"].orderBy("rank").collect()
    assert [(r["rank"], r["path"]) for r in ranked][0] == (1, "src/core.js")
    totals = report["summary"].collect()[0]
    assert totals["high_risk_files"] == len(ranked) and totals["critical_files"] == 0
    sinks.write_report_sections(report, str(tmp_path), "json")
    assert (tmp_path / "critical_files" / "_SUCCESS").exists()


def test_documents(spark, analysis, tmp_path):
    sinks.write_tables(analysis.documents(), str(tmp_path), "json")
    read = lambda name: [r.asDict(True) for r in spark.read.json(str(tmp_path / name)).collect()]
    files = {r["path"]: r for r in read("files")}
    assert files["src/core.js"]["ownership"] == {"primary": "Ann", "total_commits": 3}
    assert len(files) == 5 and "page" not in files["src/core.js"]
    of = lambda name, path: [r for r in read(name) if r["path"] == path]
    assert sorted((r["rank"], r["author"], r["commits"]) for r in of("contributors", "src/core.js")) == [(1, "Ann", 2), (2, "Bob", 1)]
    assert of("contributors", "src/auth/unused.js") == [] == of("contributors", "gone.js")
    assert sorted((r["direction"], r["other"]) for r in of("neighbours", "src/core.js")) == [
        ("calledBy", "src/auth/login.js"), ("calledBy", "src/index.js"), ("calledBy", "tests/core.test.js"),
    ]
    assert [(r["name"], r["file_count"]) for r in read("features")] == [("auth", 2)]
    assert sorted(r["path"] for r in read("feature_files")) == ["src/auth/login.js", "src/auth/unused.js"]


def test_repositories_without_files_have_rows(spark, source_files):
    given = spark.createDataFrame([("r",), ("bare",)], "repo_id string")
    history = log(spark, [("c1", "a", 0, ["a.md"])])
    result = analyze(source_files({"a.md": ""}), history, use_config=False, repositories=given)
    assert {tuple(r) for r in result["total_files"].collect()} == {("r", 0), ("bare", 0)}
    assert sorted(tuple(r) for r in analysis_summary(result)["overview"].collect()) == [("bare", 0, 0, []), ("r", 0, 0, [])]
    assert sorted(tuple(r) for r in risk_report(result)["summary"].collect()) == [("bare", 0, None, 0, 0), ("r", 0, None, 0, 0)]
    result.release()


def test_one_scan_of_the_log_for_owners_and_frequency(spark):
    from sourcelore.operators import history as history_ops

    table = log(spark, [("c3", "b", 4, ["x"]), ("c2", "a", 2, ["x", "y"]), ("c1", "a", 0, ["x"])])
    states = history_ops.file_states(history_ops.author_states(table))
    assert states._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    got = {r["path"]: tuple(r)[2:] for r in states.collect()}
    frequency = {r["path"]: r["change_frequency"] for r in history_ops.change_frequency(table).collect()}
    owners = {r["path"]: (r["primary_author"], r["total_commits"], r["contributor_count"]) for r in history_ops.ownership(history_ops.file_authors(table)).collect()}
    assert got == {p: (*owners[p], frequency[p]) for p in owners} and got["x"][:3] == ("a", 3, 2)


def test_workdir(spark, source_files, tmp_path):
    history = log(spark, [("c1", "a", 0, ["src/core.js", "src/index.js"])])
    result = analyze(source_files(TREE), history, workdir=str(tmp_path))
    assert (tmp_path / "file_facts" / "_SUCCESS").exists() and result["files"].count() == 6


def test_readers(spark, tmp_path):
    root = tmp_path / "tree"
    for name, data in {
        "src/a.js": b"const a = 1;", "b c+d.py": b"x", "bad.js": b"a\xffb", "__tests__/t.js": b"t", ".hidden.js": b"h",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    found = {r["path"]: r["content"] for r in file_sources.load_source_files(spark, str(root), "r").collect()}
    assert found == {"src/a.js": "const a = 1;", "b c+d.py": "x", "bad.js": "a�b"}
    only = file_sources.load_source_files(spark, str(root), "r", glob="*.js").select("path").collect()
    assert {r["path"] for r in only} == {"src/a.js", "bad.js"}

    listing = tmp_path / "paths.txt"
    listing.write_text("src/a.js\n\n  \n__tests__/t.js\n.hidden.js\nmissing.js\n")
    listed = file_sources.load_tracked_paths(spark, str(listing), "r")
    assert [r["path"] for r in listed.collect()] == ["src/a.js", "__tests__/t.js", ".hidden.js", "missing.js"]
    read = {r["path"]: r["content"] for r in file_sources.read_listed_files(listed, str(root)).collect()}
    assert read == {"src/a.js": "const a = 1;", "__tests__/t.js": "t", ".hidden.js": "h"}


def test_ignored_files_are_not_opened(spark, tmp_path):
    """Files over the reader's limit fail when they are opened, so none that is dropped can have been."""
    root = tmp_path / "tree+1"
    for name, size in {"src/a b.js": 5, "lib/c.py": 7, "node_modules/x/big.js": 5000, "docs/api/big.js": 5000, "src/big.bin": 5000, "docs/d.go": 3}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * size)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        files = file_sources.load_source_files(spark, str(root), "r", ignore=ignore_patterns("docs/api"), languages=LANGUAGES)
        assert {(r["path"], len(r["content"])) for r in files.collect()} == {("src/a b.js", 5), ("lib/c.py", 7), ("docs/d.go", 3)}
        assert files.columns == ["repo_id", "path", "content"]
        with pytest.raises(Exception, match="(?i)max.*length|length.*max|5000"):
            file_sources.load_source_files(spark, str(root), "r").collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_listed_files_come_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_sources, "BATCH_BYTES", 50)
    for i in range(40):
        (tmp_path / f"f{i}.js").write_text("x" * (i % 30))
    listed = spark.createDataFrame([("r", f"f{i}.js") for i in range(42)], "repo_id string, path string").coalesce(1)
    found = {r["path"]: r["content"] for r in file_sources.read_listed_files(listed, str(tmp_path)).collect()}
    assert found == {f"f{i}.js": "x" * (i % 30) for i in range(40)}


def test_reports_do_not_wait_for_partners(spark, source_files):
    rows = [("r", f"c{i}", f, "Ann", None, i) for i in range(4) for f in ("a.js", "b.js")]
    log = spark.createDataFrame(rows, "repo_id string, hash string, file string, author string, ts timestamp, log_pos long")
    analysis = analyze(source_files({"a.js": "export const a = 1;", "b.js": "if (x) {}"}), log, use_config=False)
    shown = [onboarding(analysis)["overview"], architecture_map(analysis)["core_files"], risk_report(analysis)["summary"]]
    for table in shown:
        # The persisted partners would stand in the plan.
        assert "co_changed_files" not in table._jdf.queryExecution().withCachedData().toString()
        assert "correlation" not in table._jdf.queryExecution().withCachedData().toString()
    assert {r.path: [p.file for p in r.co_changed_files] for r in analysis["files"].collect()} == {"a.js": ["b.js"], "b.js": ["a.js"]}
    analysis.release()
