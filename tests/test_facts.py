from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sourcelore.functions import lexical_extract, paths, text
from sourcelore.functions.fixed import LANGUAGES
from sourcelore.operators import files
from sourcelore.plans import bridge

BAKERY_JS = """
const flour = require('flour-mill');
import { oven as heat } from "./oven";

function knead(dough) {
  while (dough.sticky) { dough.fold(2); }
}

class Loaf { slice() {} }

module.exports = Loaf;
"""


@pytest.fixture(scope="module")
def facts_of(spark, source_files):
    def run(contents: dict[str, str], mode: str = "lexical"):
        return {r["path"]: r for r in files.file_facts(source_files(contents), mode).collect()}

    return run


def test_complexity_size_and_lines(spark):
    cases = {
        "const x = 1;": 1,
        "if (x) { doSomething(); }": 2,
        "const x = obj?.foo?.bar;": 1,
        "const x = a ?? b;": 1,
        "const x = condition ? a : b;": 2,
        "else if (a && b || c) { for (;;) while (1) switch (x) { case 1: } }": 9,
        "try { } catch (e) { }": 3,
        "éif x if": 3,
        "elif except ifx xif if_ _if": 1,
        "a ??? b": 1,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", text.complexity(F.col("c")).alias("v"))
    assert {r["c"]: r["v"] for r in rows.collect()} == cases
    sizes = spark.createDataFrame([("",), ("a\n",), ("a\nb",), ("é",), ("😀x",)], "c string")
    got = sizes.select(text.size_units(F.col("c")), text.line_count(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(0, 1), (2, 2), (3, 2), (1, 1), (3, 1)]
    labels = spark.range(5, 13).select(text.complexity_label(F.col("id")).alias("l")).collect()
    assert [r["l"] for r in labels] == ["Low"] + ["Medium"] * 5 + ["High"] * 2


def test_basic_javascript(facts_of):
    for mode in ("lexical", "regex"):
        row = facts_of({"a.js": BAKERY_JS}, mode)["a.js"]
        assert set(row["imports"]) == {"flour-mill", "./oven"}
        assert row["functions"] == ["knead"] and row["classes"] == ["Loaf"] and row["exports"] == ["Loaf"]
        assert row["language"] == "javascript" and row["lines"] == BAKERY_JS.count("\n") + 1 and row["complexity"] == 2
        assert row["interfaces"] is None and row["structs"] is None


def test_lexical_skips_comments_strings_templates_and_regexes(facts_of):
    row = facts_of(
        {
            "a.js": """
/** exports.rye = 1; */ // require('wheat');
const label = 'class Crumb {}', price = "import oats from 'oats';";
const sign = `
  export function bake() {}
  exports.spelt = 2;
`;
const quotes = /["'`] function burn() {}/u.test(label);
import yeast from 'yeast'; /* import salt from 'salt';
exports.salt = 3; */
function prove() { return label + price + sign + quotes; }
"""
        }
    )["a.js"]
    assert row["imports"] == ["yeast"] and row["classes"] == [] and row["exports"] == []
    assert row["functions"] == ["prove"]


def test_lexical_imports(facts_of):
    row = facts_of(
        {
            "a.ts": """
import type {T} from 'types-only';
import type from 'default-named-type';
import React, { type X } from 'react';
import * as ns from './ns';
import './side-effect';
export { a } from './a';
export type { U } from './u';
export * from './all';
const lazy = async () => await import('./lazy');
const lib = require( 'lib' );
const no = require(name);
const alsoNo = obj.require('x');
""",
        }
    )["a.ts"]
    assert set(row["imports"]) == {
        "default-named-type", "react", "./ns", "./side-effect", "./a", "./u", "./all", "./lazy", "lib",
    }


def test_lexical_functions_and_classes(facts_of):
    row = facts_of(
        {
            "a.ts": """
export interface FeatureConfig { enabled: boolean; }
export const runFeature = () => helper();
async function loadFeature() {}
function* gen() {}
const f1 = function inner() {};
let f2 = async (a, b = g(1)) => a;
var f3 = x => x;
const typed: (a: number) => void = (a) => {};
const generic = <T>(x: T): T => x;
const value = 5;
const called = make(() => 1);
export default class Main extends Base { method() {} handler = () => {}; }
abstract class Shape {}
const Anonymous = class Hidden {};
const o = { m() {}, n: function named() {} };
$el(function () {});
function $dollar() {}
"""
        }
    )["a.ts"]
    assert row["functions"] == [
        "runFeature", "loadFeature", "gen", "f1", "f2", "f3", "typed", "generic", "$dollar",
    ]
    assert row["classes"] == ["Main", "Shape"]
    assert row["interfaces"] == ["FeatureConfig"]
    assert set(row["exports"]) == {"FeatureConfig", "runFeature", "default"}


def test_lexical_es_exports(facts_of):
    row = facts_of(
        {
            "a.ts": """
export function one() {}
export async function two() {}
export class Three {}
export abstract class Four {}
export const five = 1, six = 2;
export let seven: number = 7
export type Eight = string;
export interface Nine {}
export { ten, b as eleven, type Twelve, default as thirteen } from './x';
export type { Fourteen } from './y';
export * as fifteen from './z';
export * from './all';
export default function hidden() {}
export enum NotListed { A }
export const { not, listed } = obj;
"""
        }
    )["a.ts"]
    assert set(row["exports"]) == {
        "one", "two", "Three", "Four", "five", "six", "seven", "Eight", "Nine", "ten", "eleven", "Twelve",
        "thirteen", "Fourteen", "fifteen", "*", "default",
    }
    assert "hidden" in row["functions"]


@pytest.mark.parametrize(
    "code, names",
    [
        ("module.exports = Foo;", {"Foo"}),
        ("module.exports = Foo", {"Foo"}),
        ("module.exports = function foo() {}", {"foo"}),
        ("module.exports = function () {}", {"default"}),
        ("module.exports = (a) => a", {"default"}),
        ("module.exports = class Foo extends Bar {}", {"Foo"}),
        ("module.exports = class extends Bar {}", {"default"}),
        ("module.exports = new Foo();", {"default"}),
        ("module.exports = require('x');", {"default"}),
        ("module.exports = 'text';", {"default"}),
        ("module.exports = {};", {"default"}),
        (
            "module.exports = { a, b: c, 'd': f(x, y), e() { return { z: 1 }; }, async g(h) {}, ...rest, [k]: 1, get m() {} };",
            {"a", "b", "d", "e", "g", "m"},
        ),
        ("exports.a = 1; exports.b.c = 2; module.exports.d = 3; exports.e == 4; exports.f;", {"a", "b", "d"}),
        ("exports = module.exports = Foo;", {"Foo"}),
        ("notmodule.exports = Foo; x.exports.y = 1;", set()),
        ("export = Foo;", {"Foo"}),
        ("// module.exports = A;\n'module.exports = B';", set()),
    ],
)
def test_lexical_commonjs_exports(facts_of, code, names):
    assert set(facts_of({"a.ts": code})["a.ts"]["exports"]) == names


def test_other_languages(facts_of):
    rows = facts_of(
        {
            "m.py": "import os\nfrom a.b import c\nimport x, y\nclass K:\n  def go (self): pass\n",
            "M.java": "import static a.b;\npublic class C { public int m(int x) { if (a) { } else if (b) { } } }",
            "m.go": 'package main\nimport "one"\nimport (\n  "fmt"\n  alias "os"\n)\ntype S struct {}\nfunc (r *R) Do(x int) {}\nfunc main() {}',
        }
    )
    assert rows["m.py"]["imports"] == ["os", "a.b", "x,"]
    assert rows["m.py"]["functions"] == ["go"] and rows["m.py"]["classes"] == ["K"] and rows["m.py"]["exports"] == []
    assert rows["M.java"]["imports"] == ["static a.b"] and rows["M.java"]["functions"] == ["m", "if"]
    assert rows["M.java"]["exports"] == [] and rows["M.java"]["structs"] is None
    assert set(rows["m.go"]["imports"]) >= {"one", "fmt", "os"}
    assert rows["m.go"]["functions"] == ["Do", "main"] and rows["m.go"]["structs"] == ["S"]
    assert rows["m.go"]["classes"] == [] and rows["m.go"]["interfaces"] is None


def test_long_texts_do_not_overflow(facts_of):
    words = "word " * 60_000
    rows = facts_of(
        {
            "A.java": words,
            "a.js": f"const s = '{'x' * 900_000}';\n/* {words} */ const q = `{words}`;\n" + "a(" * 20_000 + "function f() {}",
            "b.js": "module.exports = {" + ",".join(f"k{i}: {{ a: [1, (2)] }}" for i in range(5_000)) + "};",
            "c.ts": "export const " + ", ".join(f"v{i} = {i}" for i in range(5_000)) + ";",
            "d.js": "f".join(["0123456789abcdef" * 4_000]) + " : function",
        }
    )
    assert len(rows) == 5
    assert len(rows["b.js"]["exports"]) == 5_000
    assert len(rows["c.ts"]["exports"]) == 5_000


def test_language_and_ignore(spark, source_files):
    names = ["a.js", "b.jsx", "c.mjs", "d.ts", "e.tsx", "f.py", "g.java", "h.go", "i.cjs", "j.JS", ".py", "x/.js", "k.d.ts", "README.md"]
    got = files.with_language(source_files({n: "" for n in names})).select("path", "language").collect()
    assert {r["path"]: r["language"] for r in got} == {
        "a.js": "javascript", "b.jsx": "javascript", "c.mjs": "javascript", "d.ts": "typescript",
        "e.tsx": "typescript", "f.py": "python", "g.java": "java", "h.go": "go", "k.d.ts": "typescript",
    }

    tree = source_files({n: "" for n in [
        "main.js", "node_modules/dep.js", "src/index.js", "src/utils/helper.js", "lib/src/utils/x.js",
        "build-utils/helper.js", "a/Build/b.js", "src/custom", "x/custom/y.js",
    ]})
    kept = lambda patterns: {r["path"] for r in files.filter_ignored(tree, patterns).collect()}
    assert kept(None) == {
        "main.js", "src/index.js", "src/utils/helper.js", "lib/src/utils/x.js", "build-utils/helper.js", "src/custom",
        "x/custom/y.js",
    }
    assert kept(files.ignore_patterns(" ./src/utils/ , custom")) == {
        "main.js", "src/index.js", "lib/src/utils/x.js", "build-utils/helper.js",
    }
    assert files.ignore_patterns(None) == files.ignore_patterns("") == files.ignore_patterns("dist")
    assert files.ignore_patterns("custom,tmp")[-2:] == ["custom", "tmp"]


def test_path_functions(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "p string").select(column(F.col("p"))).collect()[0][0]

    for path, extension in {"a.js": ".js", "a.b.js": ".js", ".js": "", "x/.js": "", "a": "", "a.": ".", "x.d/a": "", "..js": ".js"}.items():
        assert one(paths.extname, path) == extension, path
    for path, clean in {
        "a/b": "a/b", "a/../b": "b", "./a//b/.": "a/b", "a/..": "", "..": None, "a/../../b": None, "": "", "a/...": "a/...", "/a": "a",
    }.items():
        assert one(paths.collapse_dots, path) == clean, path
    for path, is_test in {
        "tests/a.js": True, "a/test/b.js": True, "__tests__/a": True, "a.test.js": True, "a.SPEC.ts": True, "latest/a.js": False,
        "a.test.": False, "test.js": False, "a\\tests\\b.js": True, "a.test.b.js": False,
    }.items():
        assert one(paths.is_test_file, path) is is_test, path
    for path, entry in {"index.js": True, "x/main.py": True, "app": True, "index.d.ts": False, "Main.java": False, "appx.js": False}.items():
        assert one(paths.is_entry_point, path) is entry, path
    normal = lambda p: paths.normalize_repo_path(p, "/work/repo")
    for path, clean in {
        " src/a.js ": "src/a.js", "/work/repo/src/a.js": "src/a.js", "/work/other/a.js": "", "../x": "", "": "", "  ": "",
        "src\\b.js": "src/b.js", "./a/../b.js": "b.js", "/work/repo": "", "/work/repository/a": "",
    }.items():
        assert one(normal, path) == clean, path


def test_lexical_reading_has_no_caps(facts_of):
    deep = "{ l: " * 8 + "{ x: 1 }" + " }" * 8
    rows = facts_of(
        {
            "deep.js": f"if (ok) {{ module.exports = {{ a, b: {deep}, c, d: f([1, (2)]) }} }}",
            "member.js": "exports['one'] = 1; module[\"exports\"] = { two }; module.exports['three'] = 3; other['four'] = 4;",
            "indent.js": "setTimeout(\n            function tick() {});\nconst K =\n          class Hidden {};\n      function real() {}\n      class Seen {}",
            "regex.js": "function q(s) { return /`/.test(s); }\nconst lib = require('kept');\nconst t =\n\n      /'/;\nfunction after() {}\nconst u = `x`;",
            "equals.ts": "import x = require('declared');\nimport y from 'y';",
            "open.js": "import a from 'a';\n/* import b from 'b';",
        }
    )
    assert set(rows["deep.js"]["exports"]) == {"a", "b", "c", "d"}
    assert set(rows["member.js"]["exports"]) == {"one", "two", "three"}
    assert rows["indent.js"]["functions"] == ["real"] and rows["indent.js"]["classes"] == ["Seen"]
    assert rows["regex.js"]["functions"] == ["q", "after"] and rows["regex.js"]["imports"] == ["kept"]
    assert rows["equals.ts"]["imports"] == ["y"] and rows["open.js"]["imports"] == ["a"]


def test_unclosed_comments_take_linear_time(facts_of):
    rows = facts_of({"a.js": "/* " * 700_000, "b.js": "function f() {}\n" + "= /* x" * 300_000})
    assert rows["a.js"]["functions"] == [] and rows["b.js"]["functions"] == ["f"]


def test_java_and_go_patterns_equal_the_plain_ones(facts_of):
    rng = random.Random(5)
    java = ["int ", "f", "(", ")", " {", "}", "\n", "g ", "h(", "a b(", ")  {"]
    go = ["import (", ")", '"a"', '"b" ', "\n", "import", " ( ", "x", '"']
    texts = {f"{i}.java": "".join(rng.choices(java, k=rng.randint(0, 40))) for i in range(150)}
    texts |= {f"{i}.go": "".join(rng.choices(go, k=rng.randint(0, 40))) for i in range(150)}
    rows = facts_of(texts)
    header, single = LANGUAGES["java"]["functions"][0], LANGUAGES["go"]["imports"][0]
    for path, content in texts.items():
        if path.endswith("java"):
            assert rows[path]["functions"] == list(dict.fromkeys(re.findall(header, content, re.ASCII))), content
        else:
            found = [a or b for a, b in re.findall(single, content, re.ASCII)]
            for block in re.findall(r"import\s*\(\s*([\s\S]*?)\)", content, re.ASCII):
                found += re.findall(r'"(.+?)"', block)
            assert rows[path]["imports"] == list(dict.fromkeys(found)), content


def test_unclosed_brackets_take_linear_time(facts_of):
    start = time.time()
    rows = facts_of({"a.java": "a b( " * 400_000, "b.go": "import (\n" * 200_000})
    assert rows["a.java"]["functions"] == [] and rows["b.go"]["imports"] == []
    assert time.time() - start < 60


def test_lexical_reads_templates_and_tags_by_mode(facts_of):
    rows = facts_of(
        {
            "a.tsx": """
const t = `a ${require('one')} b ${`c ${import('two')} don't`} ' " // ${ok ? {x: `}`} : ''} x`;
function List() { return <p>Don't do <i>http://x</i> import y from 'y' {rows.map(r => <Row key={r} name="it's" />)} `tick </p> }
const inner = <><A.B on={() => { require('three') }}>text // none { /* class Gone {} */ } class Lost {}</A.B></>, after = () => <b/>;
const pick = <T,>(x: T) => x, most = a < b && c > d, re = /[`'"/]/g.test(x) / 2;
import four from 'four';
""",
            "b.ts": "const cast = <any>x; const less = a </re/.length; const up = <T>(x: T) => x;\nimport five from 'five';",
            "c.js": "const open = `never ${closed\nfunction in_template() {}",
        }
    )
    assert rows["a.tsx"]["imports"] == ["one", "two", "three", "four"] and rows["a.tsx"]["classes"] == []
    assert rows["a.tsx"]["functions"] == ["List", "after", "pick"]
    assert rows["b.ts"]["imports"] == ["five"] and rows["b.ts"]["functions"] == ["up"]
    assert rows["c.js"]["functions"] == ["in_template"]


def test_lexical_declarators_are_told_apart(facts_of):
    row = facts_of(
        {
            "a.ts": """
const one = 1, foo = () => {}, bar = async (x): Promise<Map<string, number>> => x;
const f = (x: number): { a: number, b: [string] } => ({ a: x }), g = function* () {};
const h1 = <T extends Map<string, Array<U>>>(a = (b) => ({ c: 1 })): T => a
let typed: Fn<A, B> = (q) => q
var
  four = async z => z
  , five = (
    a,
  ) =>
    a, six = f(x, y => 1)
const { a = () => 1 } = o, [b = x => x] = p, seven = (v): v is string => true;
export const { out } = o, eight = call(1, 2), nine: Map<string, () => void> = new Map(), ten = 10;
for (const eleven = () => 1; ;) { let twelve = () => { const thirteen = v => v } }
call(fourteen = () => 1);
"""
        }
    )["a.ts"]
    assert row["functions"] == ["foo", "bar", "f", "g", "h1", "typed", "four", "five", "seven", "eleven", "twelve", "thirteen"]
    assert row["exports"] == ["eight", "nine", "ten"]


def test_deep_brackets_take_little_longer_than_flat_ones(facts_of):
    deep = "module.exports = { a, " + "k: { " * 2000 + "x: 1" + " " * 30 + ("}" + " " * 60) * 2000 + ", last };"
    names = "".join(f"const f{i} = (a) => a, g{i} = 1;\n" for i in range(3000))
    facts_of({"w.js": "x"})
    start = time.time()
    rows = facts_of({"deep.js": deep, "open.js": "a(" * 20_000 + "function f() {}", "both.js": ")" * 20_000 + "(" * 20_000, "names.js": names})
    assert rows["deep.js"]["exports"] == ["a", "k", "last"] and len(rows["names.js"]["functions"]) == 3000
    assert time.time() - start < 20


def test_texts_with_few_levels_are_not_counted_bracket_by_bracket(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("(){}[]a,<>= \n", k=rng.randint(0, 60))) for _ in range(200)]
    texts += ["(" * n + ")" * n for n in range(20)] + [")" * 9 + "(()" * 3, "(" * 30]
    rows = spark.createDataFrame([(t,) for t in texts], "bare string")
    depths = [r[0] for r in rows.select(F.expr(lexical_extract.nesting("bare"))).collect()]
    assert depths[texts.index("()")] == lexical_extract.LEVELS and depths[texts.index("(" * 9 + ")" * 9)] == 9
    found = [r[0] for r in rows.select(F.expr(lexical_extract.flat_text("bare"))).collect()]
    brackets = f"regexp_replace(bare, {lexical_extract.literal(lexical_extract.NO_BRACKET)}, '')"
    monkeypatch.setattr(lexical_extract, "nesting", lambda _: lexical_extract._counted_levels(brackets))
    assert found == [r[0] for r in rows.select(F.expr(lexical_extract.flat_text("bare"))).collect()]


def test_texts_grow_in_many_tasks_where_the_join_is_shuffled(spark, tmp_path):
    fields = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    parts = [(i, f"name {i}", f"Brand#{i % 3 + 11}", "SMALL TIN", 2) for i in range(60)]
    spark.createDataFrame(parts, fields).write.parquet(f"{tmp_path}/part.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for size in ("-1", limit):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            for view in (bridge.layout_files, bridge.code_files, bridge.brand_files, bridge.single_files):
                files = view(spark, str(tmp_path))
                assert files.count() == 60 and files.rdd.getNumPartitions() >= 32
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
