"""Tables take from the texts only what they show: a text whose reading fails shows who reads it."""

from pyspark.sql import functions as F

from checks.registry import Tables, build
from sourcelore import analyze
from sourcelore.operators import files as file_ops
from sourcelore.operators import listings, summary
from sourcelore.plans import bridge, reports

PATHS = ["main_a.js", "lib/pay/b.ts", "tests/c.py", "lib/pay/d.go", "notes.txt", "lib/pay/b.ts"]


def tree(spark, readable="false"):
    """Files whose texts fail to be read, except where the condition holds."""
    rows = spark.createDataFrame([("r", p) for p in PATHS], "repo_id string, path string")
    return rows.withColumn("content", F.expr(f"if({readable}, 'import x', cast(raise_error(concat('read ', path)) as string))"))


def log(spark):
    return spark.createDataFrame([], "repo_id string, hash string, file string, author string, ts timestamp_ntz, log_pos bigint")


def test_features_need_no_text(spark):
    analysis = analyze(tree(spark), log(spark), use_config=False, include_co_change=False)
    # The enriched files hold a file that is given twice four times, and so does this list.
    wanted = [("pay", "lib/pay/b.ts")] * 4 + [("pay", "lib/pay/d.go")]
    tables = [analysis.documents()["feature_files"], reports.architecture_map(analysis)["feature_files"]]
    assert sorted((r["name"], r["path"]) for r in tables[0].collect()) == wanted
    assert [r["path"] for r in tables[1].orderBy("rank").collect()] == [path for _, path in wanted]
    analysis.release()


def test_graph_keeps_imports_only(spark):
    analysis = analyze(tree(spark, "true"), log(spark), use_config=False, include_co_change=False)
    assert analysis["imports"].columns == ["repo_id", "path", "imports"]
    assert analysis["imports"].storageLevel.useMemory
    assert not analysis["file_facts"].storageLevel.useMemory
    assert analysis["paths"].count() == analysis["measures"].count() == 7
    analysis.release()
    tables = Tables(spark, "")
    tables.known[("view", "layout_files")] = tree(spark, "true")
    assert tables.links().columns == ["repo_id", "path", "imports"]
    assert sorted(tables.links().collect()) == sorted(tables.facts().select("repo_id", "path", "imports").collect())
    tables.links().unpersist()


def categorized(spark, readable):
    facts = file_ops.file_facts(tree(spark, readable))
    owners = spark.createDataFrame([("r", PATHS[1], "Ann", 2, 1, 0.0)], "repo_id string, path string, primary_author string, total_commits long, contributor_count long, change_frequency double")
    degrees = spark.createDataFrame([("r", p, 4, 0) for p in PATHS[:4]], "repo_id string, path string, incoming long, outgoing long")
    return summary.categorize(summary.enrich_files(facts, owners, None, degrees))


def test_lists_read_the_texts_of_their_category(spark):
    entries = listings.entry_points(categorized(spark, "path like 'main%'"), 5).collect()
    assert [(r["path"], r["primary_author"], r["lines"]) for r in entries] == [("main_a.js", "Unknown", 1)]
    core = listings.core_files(categorized(spark, "path like 'lib%'")).orderBy("rank").collect()
    assert [(r["path"], r["primary_author"]) for r in core] == [("lib/pay/b.ts", "Ann")] * 2 + [("lib/pay/d.go", "Unknown")]


def test_tasks_grow_with_the_texts(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(bridge, "TEXTS_PER_TASK", 2)
    parts = spark.range(1000).selectExpr("id as p_partkey", "'a b' as p_name", "'Brand#11' as p_brand", "'TIN' as p_type", "1 as p_size", "1.0D as p_retailprice")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    bridge.layout_files(spark, str(tmp_path)).explain()
    assert "RoundRobinPartitioning(500)" in capsys.readouterr().out


def test_test_directories_need_no_text(spark, monkeypatch):
    monkeypatch.setattr(Tables, "view", lambda self, name: tree(spark))
    assert [tuple(r) for r in build()["test_directories"](spark, "").collect()] == [("r", "tests")]
