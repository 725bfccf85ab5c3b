from __future__ import annotations

import posixpath
import random

from pyspark.sql import functions as F

from sourcelore.functions.fixed import IMPORT_EXTENSIONS
from sourcelore.operators import files, graph, imports
from sourcelore.sources import config


def edges_of(source_files, tree: dict[str, str]):
    every = source_files(tree)
    facts = files.file_facts(every)
    chain = config.config_chain(every)
    settings = config.path_config(chain)
    aliases = config.path_aliases(chain, settings)
    resolved = imports.resolve_imports(facts, every, settings, aliases)
    return facts, imports.import_edges(resolved, facts), resolved


def pairs(edges):
    return sorted((r["src"], r["dst"]) for r in edges.collect())


def test_directory_index(source_files):
    _, edges, _ = edges_of(source_files, {"main.js": "const lib = require('./lib');", "lib/index.js": "module.exports = {};"})
    assert pairs(edges) == [("main.js", "lib/index.js")]


def test_aliases_direct_and_inherited(source_files):
    code = {"src/main.ts": "import { core } from '@/core';\nexport const main = core;", "src/core.ts": "export const core = 1;"}
    direct = {"tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}'}
    inherited = {
        "tsconfig.json": '{"extends": "./config/tsconfig.base.json"}',
        "config/tsconfig.base.json": '{"compilerOptions": {"baseUrl": "..", "paths": {"@/*": ["src/*"]}}}',
    }
    for settings in (direct, inherited):
        _, edges, _ = edges_of(source_files, {**code, **settings})
        assert pairs(edges) == [("src/main.ts", "src/core.ts")]


def test_config_layers(source_files):
    every = source_files(
        {
            "tsconfig.json": """{ // comment
  /* block */ "extends": ["./a", "./b.json"],
  "compilerOptions": {"paths": {"own/*": ["./o/*", 5, ""], "x": []},},
}""",
            "a.json": '{"extends": "./tsconfig.json", "compilerOptions": {"baseUrl": "lib", "paths": {"@/*": ["a/*"], "dup": ["first"]}}}',
            "b.json": '{"extends": "./deep", "compilerOptions": {"paths": {"dup": ["second", "third"]}}}',
            "deep/tsconfig.json": '{"compilerOptions": {"baseUrl": "../src"}}',
            "jsconfig.json": '{"compilerOptions": {"baseUrl": "never"}}',
        }
    )
    chain = config.config_chain(every)
    order = [r["path"] for r in chain.orderBy("layer").collect()]
    assert order == ["a.json", "deep/tsconfig.json", "b.json", "tsconfig.json"]
    settings = config.path_config(chain)
    assert [tuple(r) for r in settings.collect()] == [("r", "src")]
    aliases = config.path_aliases(chain, settings).orderBy("alias_ord", "target_ord").collect()
    got = [(r["pattern"], r["prefix"], r["has_wildcard"], r["target_ord"], r["target_prefix"]) for r in aliases]
    assert got[:4] == [
        ("@/*", "@", True, 0, "src/a"),
        ("dup", "dup", False, 0, "src/second"),
        ("dup", "dup", False, 1, "src/third"),
        ("own/*", "own", True, 0, "src/o"),
    ]


def test_broken_root_config_falls_back(source_files):
    every = source_files({"tsconfig.json": "{ nope", "jsconfig.json": '{"compilerOptions": {"baseUrl": "./src"}}'})
    assert [tuple(r) for r in config.path_config(config.config_chain(every)).collect()] == [("r", "src")]
    none = source_files({"tsconfig.json": "[1]", "a.js": ""})
    assert config.path_config(config.config_chain(none)).collect() == []


def test_alias_rules(source_files):
    _, _, resolved = edges_of(
        source_files,
        {
            "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "root/*": ["./*"], "one": ["src/one"], "fix/*": ["src/one"]}}}',
            "a.js": """import a from '@/one'; import b from '@scope/pkg'; import c from 'one'; import d from 'one/x';
import e from 'fix/anything'; import f from 'root/src/one'; import g from 'rootsrc/one'; import h from 'src/one';
import i from 'src.js'; import j from 'plain'; import k from '/src/one'; import l from '@/';""",
            "src/one.js": "",
            "src/index.js": "",
            "src.js": "",
            "scope/pkg.js": "",
            "plain.js": "",
        },
    )
    got = {r["import"]: r["target"] for r in resolved.collect()}
    assert got == {
        "@/one": "src/one.js", "one": "src/one.js", "fix/anything": "src/one.js", "root/src/one": "src/one.js",
        "src/one": "src/one.js", "src.js": "src.js", "@/": "src/index.js",
    }


def test_first_existing_file_wins_even_if_not_analysed(source_files):
    every = {
        "a.js": "import x from './x'; import y from './y.service'; import z from './z.js'; import self from './a'; import '../out';",
        "x.cjs": "", "x.ts": "", "y.service.ts": "", "z.ts": "", "y.service/index.ts": "",
    }
    _, edges, resolved = edges_of(source_files, every)
    assert {r["import"]: r["target"] for r in resolved.collect()} == {
        "./x": "x.cjs", "./y.service": "y.service/index.ts", "./a": "a.js",
    }
    assert pairs(edges) == [("a.js", "a.js"), ("a.js", "y.service/index.ts")]


def test_resolution_against_brute_force(spark, source_files):
    rng = random.Random(7)
    folders = ["", "a", "a/b", "index", "a.d", "lib"]
    names = ["x", "index", "y.z", "main", ".js", "x.d"]
    every = {posixpath.join(rng.choice(folders), rng.choice(names) + rng.choice(IMPORT_EXTENSIONS + ["", ".md"])) for _ in range(70)}
    wanted = ["./x", "../x", "./", ".", "..", "./a/b", "../a", "../../x", "./y.z", "./x.d", "./lib/index", "./a//x", "./index", "../a.d/x"]
    code = {
        path: "\n".join(f"import '{w}';" for w in rng.sample(wanted, 8)) if path.endswith((".js", ".ts")) else ""
        for path in sorted(every)
    }
    _, _, resolved = edges_of(source_files, code)
    got = {(r["src"], r["import"]): r["target"] for r in resolved.collect()}

    expected = {}
    for src, content in code.items():
        for line in content.splitlines():
            reference = line.split("'")[1]
            base = posixpath.normpath(posixpath.join("/root", posixpath.dirname(src), reference))
            tail = base.rsplit("/", 1)[1]
            has_extension = "." in tail[1:]
            spelled = [base] + ([] if has_extension else [base + e for e in IMPORT_EXTENSIONS])
            spelled += [f"{base}/index{e}" for e in IMPORT_EXTENSIONS]
            hit = next((s for s in spelled if s.startswith("/root/") and s[6:] in every), None)
            if hit and src.rsplit("/", 1)[-1] not in (".js", ".ts"):
                expected[src, reference] = hit[6:]
    assert got == expected and len(expected) > 20

    # The listed spellings and the inverse look-up agree.
    bases = spark.createDataFrame([("r", b) for b in ("", "a", "a.d", "a/x", "lib/", "index")], "repo_id string, base string")
    paths = spark.createDataFrame([("r", p) for p in every], "repo_id string, path string")
    listed = (
        imports.expand_candidates(bases)
        .join(paths.withColumnRenamed("path", "candidate"), ["repo_id", "candidate"])
        .groupBy("base")
        .agg(F.min_by("candidate", "expansion_ord").alias("target"))
    )
    looked_up = imports.resolve_bases(bases, paths).select("base", "target")
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, looked_up.collect()))


def test_graph_degrees_and_dead_code(spark, source_files):
    tree = {
        "src/main.js": "require('./used'); import x from './used.js'; export const a = 1;",
        "src/used.js": "export const used = 1;",
        "src/index.js": "export const b = 1;",
        "src/app.js": "export const c = 1;",
        "maintenance/helper.js": "export const help = 1;",
        "tests/example.test.js": "export const t = 1;",
        "src/silent.js": "const nothing = 1;",
        "tool.py": "def f(): pass",
    }
    facts, edges, _ = edges_of(source_files, tree)
    degree = {r["path"]: (r["incoming"], r["outgoing"]) for r in graph.degrees(facts, edges).collect()}
    assert degree["src/used.js"] == (2, 0) and degree["src/main.js"] == (0, 2) and degree["tool.py"] == (0, 0)
    assert [r["path"] for r in graph.dead_code(facts, edges).collect()] == ["maintenance/helper.js"]
    both = graph.dead_code(facts, edges, include_tests=True).collect()
    assert {r["path"] for r in both} == {"maintenance/helper.js", "tests/example.test.js"}
    assert {(r["confidence"], r["reason"]) for r in both} == {("medium", "No imports found from other files")}
    directions = {(r["path"], r["direction"], r["other"]) for r in graph.call_graph(edges).collect()}
    assert directions == {("src/main.js", "calls", "src/used.js"), ("src/used.js", "calledBy", "src/main.js")}
