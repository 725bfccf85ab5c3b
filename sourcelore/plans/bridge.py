"""The benchmark's star-schema tables seen as source trees and commit logs.

An order is a commit, its line items are the touched files and ``o_custkey % 25`` is the
author. A part is a file whose text is built from the part's columns. Each view exists as a
DataFrame here and as a SQL text (``ORACLE_VIEWS``) for checks in another engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

EXTENSION = """case when p_partkey % 12 = 0 then '.py' when p_partkey % 12 = 1 then '.java'
  when p_partkey % 12 = 2 then '.go' when p_partkey % 12 = 3 then '.md'
  when p_partkey % 3 = 1 then '.ts' else '.js' end"""
STEM = "concat(replace(p_name, ' ', '_'), '_', cast(p_partkey as varchar(20)))"
PATH = f"concat('src/', lower(p_type), '/', {STEM}, {EXTENSION})"
# Paths that reach every category: tests, utilities, config, documentation, entry points, plain, core.
CATEGORY_PATH = f"""concat(case p_partkey % 7 when 0 then 'tests/' when 1 then 'src/utils/' when 2 then 'config_'
  when 3 then 'readme/' when 4 then 'main_' when 5 then 'src/' else 'lib/core/' end, {STEM}, {EXTENSION})"""

IF_LINE = "concat('if (a && b) { c = d ? e : g?.h ?? i; } else { }', chr(10))"


def _code(target: str) -> str:
    """Text of part ``p`` importing part ``q``; ``target`` is the import string."""
    return f"""concat(
  case when p.ext = '.py' then concat('import m', p.k, chr(10), 'def f', p.k, '(x):', chr(10))
       when p.ext = '.java' then concat('import a.b', p.k, ';', chr(10), 'public class C', p.k,
            ' {{ public int m', p.k, '(int x) {{ return x; }} }}', chr(10))
       when p.ext = '.go' then concat('import (', chr(10), '"fmt"', chr(10), '"m', p.k, '"', chr(10), ')', chr(10),
            'type S', p.k, ' struct {{}}', chr(10), 'func F', p.k, '(x int) {{}}', chr(10))
       when p.ext = '.md' then concat('# notes', chr(10))
       else concat('const d = require(''', {target}, ''');', chr(10),
            'import x from ''pkg', p.k, ''';', chr(10), 'function f', p.k, '() {{}}', chr(10),
            'class C', p.k, ' {{}}', chr(10),
            case when p.pk % 5 = 0 then '' else concat('export const e', p.k, ' = 1;', chr(10)) end) end,
  repeat({IF_LINE}, p.p_size))"""


# The texts are built from one small file; spread its rows before they grow.
SPREAD = "/*+ REPARTITION(32) */"
#: Texts that one task makes and reads: more texts make more tasks, not longer ones. Whoever scans a kept table while its
#: last tasks run makes their rows again elsewhere, so these should be a small part of all; but each has a cost of its own.
TEXTS_PER_TASK = 20_000
PART_FIELDS = f"""p_partkey as pk, cast(p_partkey as varchar(20)) as k, p_size, p_brand as brand,
  lower(p_type) as dir, {STEM} as stem, {EXTENSION} as ext, {PATH} as path, {CATEGORY_PATH} as category_path"""

CODE_FILES = f"""
select 'r0' as repo_id, p.path, {_code("concat('../', q.dir, '/', q.stem, case when p.pk % 2 = 0 then q.ext else '' end)")} as content
from (select {SPREAD} {PART_FIELDS} from part) p
join (select {PART_FIELDS} from part) q on q.pk = cast(floor(p.pk / 8.0) as bigint)
"""

# The same parts laid out over all categories, with up to 20 importers per file.
UP = "case p.pk % 7 when 1 then '../../' when 2 then './' when 4 then './' when 6 then '../../' else '../' end"
LAYOUT_TARGET = f"""concat({UP}, case when p.pk % 2 = 0 then q.category_path
   else substr(q.category_path, 1, length(q.category_path) - length(q.ext)) end)"""
LAYOUT_FILES = f"""
select 'r0' as repo_id, p.category_path as path, {_code(LAYOUT_TARGET)} as content
from (select {SPREAD} {PART_FIELDS} from part) p
join (select {PART_FIELDS} from part) q on q.pk = cast(floor(p.pk / 20.0) as bigint)
"""

# One repository per brand. Files import '@/…' (alias), '~lib/…' (exact and wildcard alias with a second
# target) or a path below the base URL; the imported part is any earlier part, often of another brand.
BRAND_FILES = f"""
select concat('repo-', replace(p.brand, '#', '')) as repo_id, p.path, {_code('''case p.pk % 4
   when 0 then concat('@/', q.dir, '/', q.stem) when 1 then concat('~lib/', q.dir, '/', q.stem, q.ext)
   when 2 then concat('src/', q.dir, '/', q.stem) else concat('@', q.stem) end''')} as content
from (select {SPREAD} {PART_FIELDS} from part) p
join (select brand as qbrand, min(pk) as first_pk from (select {PART_FIELDS} from part) f
      where f.ext in ('.js', '.ts') group by brand) h on h.qbrand = p.brand
join (select {PART_FIELDS} from part) q on q.pk = h.first_pk
"""

# Root config of each brand: even brands extend a base file in config/, odd brands are self-contained.
BRANDS = """select distinct concat('repo-', replace(p_brand, '#', '')) as repo_id,
  cast(replace(p_brand, 'Brand#', '') as bigint) as n from part"""
BRAND_CONFIGS = f"""
select repo_id, 'tsconfig.json' as path, case when n % 2 = 0 then '{{"extends": "./config/tsconfig.base"}}'
  else '{{"compilerOptions": {{"baseUrl": "./", "paths": {{"@/*": ["./src/*"], "~lib/*": ["missing/*", "src/*"]}}}}}}' end as content
from ({BRANDS}) b
union all
select repo_id, 'config/tsconfig.base.json', concat('{{ // shared', chr(10),
  '"compilerOptions": {{"baseUrl": "..", "paths": {{"@/*": ["src/*"], "~lib/*": ["missing/*", "src/*"],}}}}}}')
from ({BRANDS}) b where n % 2 = 0
"""


def _log(days: str, ts: str) -> tuple[str, str, str]:
    position = f"-(cast({days} as bigint) * 10000000 + o_orderkey)"
    head = f"""'r0' as repo_id, concat('c', cast(o_orderkey as varchar(20))) as hash,
       concat('author_', cast(o_custkey % 25 as varchar(20))) as author, {ts} as ts, {position} as log_pos"""
    def touched(path: str) -> str:
        # One path per part, not per line item.
        return f"""select {head}, f.file from orders join lineitem on l_orderkey = o_orderkey
join (select p_partkey, {path} as file from part) f on f.p_partkey = l_partkey"""

    commit_files, layout_commit_files = touched(PATH), touched(CATEGORY_PATH)
    commits = f"""select {head}, concat('order ', cast(o_orderkey as varchar(20)), ' ', o_orderpriority) as message
from orders"""
    return commit_files, layout_commit_files, commits


SPARK_COMMIT_FILES, SPARK_LAYOUT_COMMIT_FILES, SPARK_COMMITS = _log(
    "datediff(o_orderdate, DATE'1995-01-01')",
    "cast(date_add(DATE'2024-01-01', cast(floor(datediff(o_orderdate, DATE'1995-01-01')/40.0) as int)) as timestamp_ntz)",
)
DUCK_DAYS = "date_diff('day', DATE '1995-01-01', cast(o_orderdate as date))"
DUCK_COMMIT_FILES, DUCK_LAYOUT_COMMIT_FILES, DUCK_COMMITS = _log(
    DUCK_DAYS, f"cast(DATE '2024-01-01' + cast(floor({DUCK_DAYS}/40.0) as integer) as timestamp)"
)

# A log with bulk commits: an order touches its parts and the neighbour of each (parts 8 and 9 of ten stay out), and
# each quarter one commit touches whatever a fifth of the customers ordered.
_NEIGHBOUR = "l_partkey + 1 - 2 * (l_partkey % 2)"
BULK_COMMIT_FILES = f"""
select 'r0' as repo_id, t.hash, f.file from (
  select concat('c', cast(o_orderkey as varchar(20))) as hash, l_partkey as pk
  from orders join lineitem on l_orderkey = o_orderkey where l_partkey % 10 < 8
  union all
  select concat('c', cast(o_orderkey as varchar(20))), {_NEIGHBOUR}
  from orders join lineitem on l_orderkey = o_orderkey where l_partkey % 10 < 8
  union all
  select concat('q', cast(extract(year from o_orderdate) * 4 + extract(quarter from o_orderdate) as varchar(20))), l_partkey
  from orders join lineitem on l_orderkey = o_orderkey where o_custkey % 5 = 0) t
join (select p_partkey, {PATH} as file from part) f on f.p_partkey = t.pk
"""

# Scripts that plain patterns read wrongly: code in templates, texts between tags, several declarators, typed functions.
def _script(text: str) -> str:
    """SQL for a text with ``%`` in the places of the part's key, line by line."""
    lines = ["'" + line.replace("'", "''").replace("%", "', p.k, '") + "'" for line in text.strip().split("\n")]
    return "concat(" + ", chr(10), ".join(lines) + ", chr(10))"


SCRIPT = _script("""
import lib% from 'lib%'; // import gone% from 'gone%';
interface Options% { depth: number; }
const first% = 1, later% = (x: number): { a: number } => ({ a: x }), plain% = call(1, y => 2);
const nested% = <T extends Map<string, Array<number>>>(a = (b) => ({ c: 1 })): T => a
const text% = `// ${require('in%')} and ${ready ? `deeper ${import('deep%')} don't` : ''} require('text%')`;
function after%() { const inner% = async z => z; return "function quoted%() {} class Quoted% {}"; }
class Kept% { method() {} }
export const { u, v } = o, out% = f(1, 2), map%: Map<string, number> = new Map();
""")
# What only files with tags hold.
TAGGED = _script("""
function View%() { return <p title="it's">Don't do <i>http://x</i> import z from 'shown%'; {items.map(i => <b key={i}/>)}</p>; }
var shown% = () => <View% then={() => require('attribute%')}>class Written% and // more</View%>, last% = function () {};
""")
SCRIPT_FILES = f"""
select 'r0' as repo_id, concat('web/', p.stem, case p.pk % 3 when 0 then '.jsx' when 1 then '.tsx' else '.ts' end) as path,
  case when p.pk % 3 = 2 then {SCRIPT} else concat({SCRIPT}, {TAGGED}) end as content
from (select {SPREAD} {PART_FIELDS} from part) p
"""

# Every part a repository of its own; those that hold a note only have nothing to analyse.
SINGLE_FILES = f"""
select concat('part-', p.k) as repo_id, p.category_path as path, {_code("concat('./', q.stem)")} as content
from (select {SPREAD} {PART_FIELDS} from part) p
join (select {PART_FIELDS} from part) q on q.pk = cast(floor(p.pk / 8.0) as bigint)
"""

ORACLE_VIEWS = {
    "single_files": SINGLE_FILES,
    "script_files": SCRIPT_FILES,
    "bulk_commit_files": BULK_COMMIT_FILES,
    "commit_files": DUCK_COMMIT_FILES,
    "commits": DUCK_COMMITS,
    "code_files": CODE_FILES,
    "brand_files": BRAND_FILES,
    "brand_configs": BRAND_CONFIGS,
    "layout_files": LAYOUT_FILES,
    "layout_commit_files": DUCK_LAYOUT_COMMIT_FILES,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Run a bridge query directly over the parquet files of its tables."""
    # A join of large tables deals the spread rows anew, to as few tasks as their own size asks for: they are spread once
    # more after all joins, as structs of the same names, before the texts grow from them.
    joined = r"\nfrom (\(select " + re.escape(SPREAD) + r".*? p\njoin .*)"
    structs = ", ".join(f"struct({side}.*) as {side}" for side in ("p", "q"))
    tasks = max(32, 4 * spark.sparkContext.defaultParallelism)
    if re.search(joined, query, re.S):
        tasks = max(tasks, -(-table(spark, sf_dir, "part").count() // TEXTS_PER_TASK))
    query = re.sub(joined, lambda m: f"\nfrom (select /*+ REPARTITION({tasks}) */ {structs} from {m[1]})", query, flags=re.S)
    return spark.sql(re.sub(r"\b(from|join) (part|orders|lineitem)\b", rf"\1 parquet.`{sf_dir}/\2.parquet` \2", query))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SPARK_COMMIT_FILES)


def bulk_commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, BULK_COMMIT_FILES)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SPARK_COMMITS)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CODE_FILES)


def brand_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, BRAND_FILES)


def brand_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, BRAND_CONFIGS)


def single_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SINGLE_FILES)


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SCRIPT_FILES)


def layout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, LAYOUT_FILES)


def layout_commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SPARK_LAYOUT_COMMIT_FILES)
