"""SQL counterparts of the queries, written for DuckDB over the same tables.

They share the bridge views with the Spark side and nothing else: names are taken from the
texts with plain patterns, imports are resolved by key joins, ranks by window functions.
"""

from __future__ import annotations

import re

from sourcelore.plans.bridge import ORACLE_VIEWS, STEM

LANGUAGE = """case when {p} similar to '.*[^/]\\.(js|jsx|mjs)' then 'javascript'
  when {p} similar to '.*[^/]\\.(ts|tsx)' then 'typescript' when {p} similar to '.*[^/]\\.py' then 'python'
  when {p} similar to '.*[^/]\\.java' then 'java' when {p} similar to '.*[^/]\\.go' then 'go' end"""
DIRNAME = "case when contains({p}, '/') then regexp_replace({p}, '/[^/]*$', '') else '' end"
BASENAME = "regexp_extract({p}, '[^/]*$')"
EXTNAME = "regexp_extract({p}, '[^/](\\.[^./]*)$', 1)"
WORDS = "if|else|for|while|switch|case|try|catch"
MARKS = "regexp_replace({c}, '\\?\\?+', '_', 'g')"
COMPLEXITY = f"""cast(1 + len(regexp_extract_all({{c}}, '\\b({WORDS})\\b')) + len(regexp_extract_all({{c}}, '&&'))
  + len(regexp_extract_all({{c}}, '\\|\\|')) + len(regexp_extract_all({MARKS}, '\\?'))
  - len(regexp_extract_all({MARKS}, '\\?\\.')) as bigint)"""
UNITS = "cast(length({c}) + length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) as bigint)"
LINES = "cast(length({c}) - length(replace({c}, chr(10), '')) + 1 as bigint)"
EXTENSION_LIST = "['.js','.jsx','.mjs','.cjs','.ts','.tsx','.mts','.cts','.py','.java','.go']"
TEST_FILE = "regexp_matches(lower({p}), '(^|[\\\\/])(__tests__|tests?)([\\\\/]|$)|\\.(test|spec)\\.[^./\\\\]+$')"
# Resolves '..' by taking out one "folder/.." at a time; three are enough for the bridge paths.
UP = "regexp_replace({p}, '(^|/)[^/.][^/]*/\\.\\.(/|$)', '\\1')"


def _up(p: str) -> str:
    for _ in range(3):
        p = UP.format(p=p)
    return f"regexp_replace(replace({p}, '//', '/'), '^/?(\\./)*', '')"


def _all(c: str, pattern: str, *groups: int) -> str:
    """Captures of the given groups; at most one of them is set per match."""
    lists = [f"regexp_extract_all({c}, '{pattern}', {g})" for g in (groups or (1,))]
    if len(lists) == 1:
        return lists[0]
    return f"list_transform(list_zip({', '.join(lists)}), lambda z: coalesce(nullif(z[1], ''), z[2]{', z[3]' if len(lists) > 2 else ''}))"


def _names(view: str, regex: bool) -> str:
    js = {
        "imports": _all("content", "from ''(.+?)''|require\\(''(.+?)''\\)", 1, 2),
        "functions": _all("content", "function (\\w+)"),
        "classes": _all("content", "class (\\w+)"),
        "exports": _all("content", "export const (\\w+)"),
    }
    other = {
        "python": {"imports": _all("content", "import\\s+(\\S+)"), "functions": _all("content", "def\\s+(\\w+)\\s*\\(")},
        "java": {
            "imports": _all("content", "import\\s+([^;]+);"),
            "functions": _all("content", "\\w\\s+(\\w+)\\s*\\([^)]*\\)\\s*\\{"),
            "classes": _all("content", "class\\s+(\\w+)"),
        },
        "go": {
            "imports": _all("content", "\\n\"(.+?)\""),
            "functions": _all("content", "func\\s+(\\w+)\\s*\\("),
            "structs": _all("content", "type\\s+(\\w+)\\s+struct"),
        },
    }
    parts = []
    for language, kinds in {"javascript": js, "typescript": js, **other}.items():
        for kind, names in kinds.items():
            parts.append(
                f"select repo_id, path, language, '{kind}' as kind, unnest(list_distinct({names})) as name "
                f"from known where language = '{language}'"
            )
    return " union all ".join(parts)


#: Names in the scripts by kind, with % for the part's key; those of the second entry are in files with tags only.
SCRIPT_NAMES = {
    "imports": ("lib% in% deep%", "attribute%"),
    "functions": ("later% nested% after% inner%", "View% shown% last%"),
    "classes": ("Kept%", ""),
    "exports": ("out% map%", ""),
    "interfaces": ("Options%", ""),
}


def _script_names() -> str:
    """What a reader of the scripts would list, spelled out from the key of each part."""
    parts = []
    for kind, (always, tagged) in SCRIPT_NAMES.items():
        for names, files in ((always, "true"), (tagged, "p_partkey % 3 < 2")):
            for name in names.split():
                kept = "and p_partkey % 3 > 0" if kind == "interfaces" else ""
                parts.append(f"""select 'r0' as repo_id, concat('web/', {STEM}, case p_partkey % 3 when 0 then '.jsx' when 1 then '.tsx' else '.ts' end) as path,
                  case p_partkey % 3 when 0 then 'javascript' else 'typescript' end as language, '{kind}' as kind,
                  replace('{name}', '%', cast(p_partkey as varchar)) as name from part where {files} {kept}""")
    return " union all ".join(parts)


def _script_patterns() -> str:
    """What plain patterns find in the scripts, comments and strings included."""
    imports = _all("content", "import\\s+.*?from\\s+[''\"](.+?)[''\"]|require\\s*\\(\\s*[''\"](.+?)[''\"]\\s*\\)", 1, 2)
    functions = _all("content", "function\\s+(\\w+)|const\\s+(\\w+)\\s*=\\s*(?:async\\s+)?\\([^)]*\\)\\s*=>", 1, 2)
    exports = _all("content", "export\\s+(?:default\\s+)?(?:class|function|const)\\s+(\\w+)")
    found = {"imports": imports, "functions": functions, "classes": _all("content", "class\\s+(\\w+)"), "exports": exports}
    found["interfaces"] = "case when language = 'typescript' then " + _all("content", "interface\\s+(\\w+)") + " end"
    return " union all ".join(
        f"select repo_id, path, language, '{kind}' as kind, unnest(list_distinct(list_filter({names}, lambda n: n <> ''))) as name from known" for kind, names in found.items()
    )


def _facts(view: str) -> str:
    return f"""select repo_id, path, {LANGUAGE.format(p='path')} as language, {UNITS.format(c='content')} as size,
  {LINES.format(c='content')} as lines, {COMPLEXITY.format(c='content')} as complexity, content from {view}
  where {LANGUAGE.format(p='path')} is not null"""


def _resolution(view: str) -> str:
    """Bases of relative imports, and the existing file behind each."""
    joined = f"concat({DIRNAME.format(p='path')}, '/', import)"
    return f"""refs as (select repo_id, path as src, unnest(list_distinct({_all('content', "from ''(.+?)''|require\\(''(.+?)''\\)", 1, 2)})) as import
    from {view} where {LANGUAGE.format(p='path')} in ('javascript', 'typescript')),
  relative as (select repo_id, src, import, {_up(joined.replace('path', 'src'))} as base
    from refs where import like '.%'),
  spelled as (select distinct repo_id, base, unnest(list_concat([{{'o': 0, 'p': base}}],
      case when {EXTNAME.format(p='base')} <> '' then [] else list_transform({EXTENSION_LIST}, lambda e, i: {{'o': i, 'p': base || e}}) end,
      list_transform({EXTENSION_LIST}, lambda e, i: {{'o': 11 + i, 'p': base || '/index' || e}}))) as s from relative),
  resolved as (select r.repo_id, r.src, r.import, arg_min(f.path, s.s.o) as target from relative r
    join spelled s on s.repo_id = r.repo_id and s.base = r.base join {view} f on f.repo_id = s.repo_id and f.path = s.s.p
    group by all),
  edges as (select repo_id, src, target as dst, import from resolved where {LANGUAGE.format(p='target')} is not null)"""


LAYOUT = f"""facts as ({_facts('layout_files')}), {_resolution('layout_files')},
  incoming as (select repo_id, dst as path, count(*) as n from edges group by all),
  outgoing as (select repo_id, src as path, count(*) as n from edges group by all),
  degrees as (select f.repo_id, f.path, coalesce(i.n, 0) as incoming, coalesce(o.n, 0) as outgoing from facts f
    left join incoming i using (repo_id, path) left join outgoing o using (repo_id, path)),
  exported as (select repo_id, path, unnest(regexp_extract_all(content, 'export const (\\w+)', 1)) as export from facts
    where language in ('javascript', 'typescript')),
  dead_all as (select distinct repo_id, path from exported anti join incoming using (repo_id, path)
    where not regexp_matches({BASENAME.format(p='path')}, '^(index|main|app)(\\.[^.]*)?$')),
  dead as (select * from dead_all where not {TEST_FILE.format(p='path')})"""

AUTHORS = """per_author as (select repo_id, file as path, author, count(*) as commits, min(log_pos) as first_pos
    from {log} group by all),
  authors as (select repo_id, path, author, commits,
    row_number() over (partition by repo_id, path order by commits desc, first_pos, author) as rank from per_author)"""

FREQUENCY = """ends as (select repo_id, file as path, count(*) as commits, arg_min(ts, log_pos) as newest,
    arg_max(ts, log_pos) as oldest from {log} group by all),
  frequency as (select repo_id, path, commits, case when commits >= 2 and newest > oldest
    then commits / ((epoch_us(newest) - epoch_us(oldest)) / 86400000000.0) else 0 end as change_frequency from ends)"""

ENRICHED = f"""{LAYOUT}, {AUTHORS.format(log='layout_commit_files')}, {FREQUENCY.format(log='layout_commit_files')},
  owners as (select repo_id, path, max(author) filter (rank = 1) as primary_author, cast(sum(commits) as bigint) as total_commits,
    count(*) as contributor_count from authors group by all),
  enriched as (select f.repo_id, f.path, f.language, f.size, f.lines, f.complexity,
    coalesce(o.primary_author, 'Unknown') as primary_author, coalesce(o.total_commits, 0) as total_commits,
    coalesce(o.contributor_count, 0) as contributor_count, coalesce(q.change_frequency, 0) as change_frequency,
    d.incoming, d.outgoing, f.content
    from facts f left join owners o using (repo_id, path) left join frequency q using (repo_id, path)
    join degrees d using (repo_id, path)),
  scored as (select *, cast(
      case when complexity > 20 then 3 when complexity > 10 then 2 when complexity > 5 then 1 else 0 end
    + case when lines > 500 then 3 when lines > 300 then 2 when lines > 150 then 1 else 0 end
    + case when change_frequency > 0.5 then 3 when change_frequency > 0.2 then 2 when change_frequency > 0.1 then 1 else 0 end
    + case when contributor_count > 10 then 2 when contributor_count > 5 then 1 else 0 end
    + case when incoming > 10 then 3 when incoming > 5 then 2 when incoming > 2 then 1 else 0 end as bigint) as risk_score
    from enriched)"""

CATEGORY = f"""case when lower(path) like '%test%' or lower(path) like '%spec%' then 'tests'
  when lower({BASENAME.format(p='path')}) like '%config%' or lower({BASENAME.format(p='path')}) in ('package.json', 'tsconfig.json') then 'config'
  when lower(path) like '%readme%' or lower({BASENAME.format(p='path')}) like '%.md' then 'documentation'
  when regexp_matches(lower({BASENAME.format(p='path')}), 'index|main|app') then 'entryPoints'
  when regexp_matches(lower({BASENAME.format(p='path')}), 'util|helper') or regexp_matches(lower(path), 'utils|helpers') then 'utilities'
  when incoming > 3 then 'core' else 'utilities' end"""
CATEGORIZED = f"{LAYOUT}, categorized as (select *, {CATEGORY} as category from degrees join facts using (repo_id, path))"
CATEGORIZED_FULL = f"{ENRICHED}, categorized as (select *, {CATEGORY} as category from enriched)"

SEGMENTS = "('src','lib','app','components','utils','helpers','test','tests','__tests__','bin')"


def _feature(view: str) -> str:
    return f"""feature_files as (select repo_id, name, path from (select repo_id, path,
      list_filter(string_split(path, '/')[:-2], lambda s: s <> '' and lower(s) not in {SEGMENTS})[1] as name from {view})
    where name is not null)"""


CO_CHANGE = """touches as (select distinct repo_id, hash, file from {log}),
  totals as (select repo_id, file, count(*) as commits from touches group by all),
  pairs as (select a.repo_id, a.file as path, b.file, count(*) as count from touches a
    join touches b on a.repo_id = b.repo_id and a.hash = b.hash and a.file <> b.file group by all),
  partners as (select p.repo_id, p.path, p.file, p.count, p.count / cast(t.commits as double) as correlation from pairs p
    join totals t on t.repo_id = p.repo_id and t.file = p.path where p.count / cast(t.commits as double) >= {threshold}),
  ranked as (select *, row_number() over (partition by repo_id, path order by correlation desc, file) as rank from partners)"""

# Aliases of the brand configs, read off their construction.
BRANDS = """brands as (select distinct concat('repo-', replace(p_brand, '#', '')) as repo_id from part),
  aliases as (select repo_id, a.* from brands cross join (values
      (0, '@/*', '@', true, 0, 'src', true), (1, '~lib/*', '~lib', true, 0, 'missing', true),
      (1, '~lib/*', '~lib', true, 1, 'src', true))
    a(alias_ord, pattern, prefix, has_wildcard, target_ord, target_prefix, target_has_wildcard)),
  imported as (select repo_id, path as src, unnest(list_distinct(regexp_extract_all(content, 'require\\(''(.+?)''\\)', 1)
      || regexp_extract_all(content, 'from ''(.+?)''', 1))) as import from brand_files
    where {js} union all
    select repo_id, path, unnest(regexp_extract_all(content, 'import (m\\d+)', 1)) from brand_files where path like '%.py'
    union all select repo_id, path, unnest(regexp_extract_all(content, 'import (a.b\\d+);', 1)) from brand_files where path like '%.java'
    union all select repo_id, path, unnest(regexp_extract_all(content, '\\n"(.+?)"', 1)) from brand_files where path like '%.go'),
  matched as (select distinct i.repo_id, i.import, alias_ord * 1048576 + target_ord as candidate_ord,
      target_prefix || substr(i.import, length(prefix) + 1) as base
    from imported i join aliases a on a.repo_id = i.repo_id and starts_with(i.import, a.prefix)),
  bases as (select * from matched union all
    select distinct repo_id, import, 0, import from imported i
    where (contains(import, '/') or import like '@%' or import like '~%' or {ext} <> '')
      and not exists (from matched m where m.repo_id = i.repo_id and m.import = i.import)),
  found as (select b.repo_id, b.import, arg_min(f.path, candidate_ord * 100 + e.o) as target from bases b
    cross join (select unnest(list_concat([{{'o': 0, 's': ''}}], list_transform({exts}, lambda e, i: {{'o': i, 's': e}}),
      list_transform({exts}, lambda e, i: {{'o': 11 + i, 's': '/index' || e}})), recursive := true)) e
    join (select repo_id, path from brand_files union all select repo_id, path from brand_configs) f
      on f.repo_id = b.repo_id and f.path = b.base || e.s group by all),
  resolved as (select i.repo_id, i.src, i.import, f.target from imported i join found f using (repo_id, import))"""
BRANDS = BRANDS.format(
    js=LANGUAGE.format(p="path") + " in ('javascript', 'typescript')", ext=EXTNAME.format(p="import"), exts=EXTENSION_LIST
)


def _limited(source: str, order: str, columns: str, limit: int, keys: str = "repo_id") -> str:
    return f"""select {columns}, rank, cast(greatest(n - {limit}, 0) as bigint) as remaining from (select *,
      row_number() over (partition by {keys} order by {order}) as rank, count(*) over (partition by {keys}) as n
      from {source}) where rank <= {limit}"""


PARTS = f"""select path, {DIRNAME.format(p='path')} as directory, {BASENAME.format(p='path')} as file_name,
  {EXTNAME.format(p='path')} as extension, regexp_replace({BASENAME.format(p='path')}, '(.)\\.[^.]*$', '\\1') as stem,
  {TEST_FILE.format(p='path')} as is_test,
  regexp_matches({BASENAME.format(p='path')}, '^(index|main|app)(\\.[^.]*)?$') as is_entry,
  {LANGUAGE.format(p='path')} as language,
  case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') || '/' else '' end || 'x/y' as collapsed,
  path as from_absolute, '' as from_outside from layout_files"""

# Per query: the common table expressions it needs and its final SELECT.
QUERIES: dict[str, tuple[str, str]] = {
    "text_metrics": (
        "texts as (select 'document' as kind, doc_id as id, text as c from documents union all select 'page', page_id, html from pages)",
        f"""select kind, id, {UNITS.format(c='c')} as size, {LINES.format(c='c')} as lines, complexity,
        case when complexity > 10 then 'High' when complexity > 5 then 'Medium' else 'Low' end as label
        from (select *, {COMPLEXITY.format(c='c')} as complexity from texts)""",
    ),
    "path_parts": ("", PARTS),
    "filter_ignored": (
        "",
        """select repo_id, path from layout_files where not starts_with(lower(path), 'src/utils/')
        and not list_has_any(string_split(lower(path), '/'), ['node_modules','.git','dist','build','coverage','readme'])""",
    ),
    "with_language": ("", f"select repo_id, path, {LANGUAGE.format(p='path')} as language from code_files where {LANGUAGE.format(p='path')} is not null"),
    "file_facts": (
        f"known as ({_facts('code_files')}), names as ({_names('code_files', True)})",
        """select repo_id, path, language, size, lines, complexity, (select count(*) from names n
        where n.kind = 'imports' and n.repo_id = k.repo_id and n.path = k.path) as import_count from known k""",
    ),
    "names_regex": (f"known as ({_facts('code_files')})", _names("code_files", True)),
    "names_lexical": (f"known as ({_facts('code_files')})", _names("code_files", False)),
    "names_regex_scripts": (f"known as ({_facts('script_files')})", _script_patterns()),
    "names_lexical_scripts": ("", _script_names()),
    "import_candidates": (_resolution("code_files"), "select repo_id, src, import, cast(0 as bigint) as candidate_ord, base from relative"),
    "expand_candidates": (
        _resolution("code_files"),
        """select repo_id, base, row_number() over (partition by repo_id, base order by s.o) - 1 as expansion_ord,
        s.p as candidate from spelled""",
    ),
    "resolve_imports": (_resolution("code_files"), "select repo_id, src, import, target from resolved"),
    "import_edges": (_resolution("code_files"), "select repo_id, src, dst, import from edges"),
    "call_graph": (
        _resolution("code_files"),
        """select repo_id, import, src as path, 'calls' as direction, dst as other from edges
        union all select repo_id, import, dst, 'calledBy', src from edges""",
    ),
    "degrees": (LAYOUT, "select repo_id, path, incoming, outgoing from degrees"),
    "dead_code": (
        LAYOUT,
        """select repo_id, path, 'No imports found from other files' as reason, 'medium' as confidence, export
        from dead join exported using (repo_id, path)""",
    ),
    "dead_code_with_tests": (LAYOUT, "select repo_id, path from dead_all"),
    "path_config": (BRANDS, "select repo_id, '' as base_url from brands"),
    "path_aliases": (
        BRANDS,
        """select repo_id, cast(alias_ord as integer) as alias_ord, pattern, prefix, has_wildcard,
        cast(target_ord as integer) as target_ord, target_prefix, target_has_wildcard from aliases""",
    ),
    "alias_candidates": (BRANDS, "select repo_id, import, cast(candidate_ord as bigint) as candidate_ord, base from matched"),
    "resolve_configured_imports": (BRANDS, "select repo_id, src, import, target from resolved"),
    "configured_import_edges": (
        BRANDS,
        f"select repo_id, src, target as dst, import from resolved where {LANGUAGE.format(p='target')} is not null",
    ),
    "parsed_commits": (
        "",
        """select repo_id, md5(hash) as hash, author, strftime(ts, '%Y-%m-%dT00:00:00+00:00') as date_raw, message,
        strftime(ts, '%Y-%m-%d') as day from commits""",
    ),
    "parsed_commit_files": ("", "select repo_id, md5(hash) as hash, author, file from commit_files"),
    "file_history": (
        "",
        f"""select repo_id, file as path, log_pos, hash, author, ts from commit_files
        where {LANGUAGE.format(p='file')} is not null""",
    ),
    "commit_file_list": ("", "select distinct repo_id, hash, file from commit_files"),
    "file_authors": (AUTHORS.format(log="commit_files"), "select repo_id, path, author, commits, rank from authors"),
    "file_ownership": (
        AUTHORS.format(log="commit_files"),
        """select f.repo_id, f.path, coalesce(max(a.author) filter (a.rank = 1), 'Unknown') as primary_author,
        cast(coalesce(sum(a.commits), 0) as bigint) as total_commits, count(a.author) as contributor_count
        from code_files f left join authors a using (repo_id, path) group by f.repo_id, f.path""",
    ),
    "recently_modified": (
        "",
        """select distinct f.repo_id, f.file, f.hash, c.author, c.ts, c.message from commit_files f
        join commits c on c.repo_id = f.repo_id and c.hash = f.hash where c.ts >= timestamp '2024-03-01' - interval 30 day""",
    ),
    "change_frequency": (
        FREQUENCY.format(log="commit_files"),
        "select repo_id, path, commits, round(change_frequency, 6) as change_frequency from frequency",
    ),
    "co_change": (
        CO_CHANGE.format(log="commit_files", threshold=0.06),
        "select repo_id, path, file, count, round(correlation, 6) as correlation from partners",
    ),
    "co_change_default": (
        CO_CHANGE.format(log="commit_files", threshold=0.3),
        "select repo_id, path, file, count, round(correlation, 6) as correlation from partners",
    ),
    "co_change_bulk": (
        CO_CHANGE.format(log="bulk_commit_files", threshold=0.5),
        "select repo_id, path, file, count, round(correlation, 6) as correlation from partners",
    ),
    "co_change_bulk_top": (
        CO_CHANGE.format(log="bulk_commit_files", threshold=0.5),
        "select repo_id, path, file, count, round(correlation, 6) as correlation, rank from ranked where rank <= 5",
    ),
    "co_change_top": (
        CO_CHANGE.format(log="commit_files", threshold=0.06),
        "select repo_id, path, file, count, round(correlation, 6) as correlation, rank from ranked where rank <= 5",
    ),
    "total_files": (LAYOUT, "select repo_id, count(*) as total_files from facts group by repo_id"),
    "language_stats": (
        LAYOUT,
        """select repo_id, language, count(*) as count, cast(sum(lines) as bigint) as total_lines,
        cast(sum(size) as bigint) as total_size from facts group by all""",
    ),
    "language_percentages": (
        LAYOUT,
        """select repo_id, language, count(*) as count,
        round(sum(lines) * 100.0 / cast(sum(sum(lines)) over (partition by repo_id) as double), 6) as percentage from facts group by repo_id, language""",
    ),
    "contributor_stats": (
        f"{LAYOUT}, {AUTHORS.format(log='layout_commit_files')}",
        """select a.repo_id, a.author, count(*) filter (a.rank = 1 and a.author <> 'Unknown') as files_owned,
        cast(sum(a.commits) as bigint) as total_commits from authors a semi join facts f using (repo_id, path) group by all""",
    ),
    "top_contributors": (
        f"{LAYOUT}, {AUTHORS.format(log='layout_commit_files')}",
        """select * from (select *, row_number() over (partition by repo_id order by total_commits desc, author) as rank from (
        select a.repo_id, a.author, count(*) filter (a.rank = 1 and a.author <> 'Unknown') as files_owned,
        cast(sum(a.commits) as bigint) as total_commits from authors a semi join facts f using (repo_id, path) group by all))
        where rank <= 10""",
    ),
    "enrich_files": (ENRICHED, "select * exclude (content) replace (round(change_frequency, 6) as change_frequency) from enriched"),
    "enriched_partners": (
        f"known as ({_facts('layout_files')}), {CO_CHANGE.format(log='layout_commit_files', threshold=0.06)}",
        """select r.repo_id, r.path, r.file, r.count, round(r.correlation, 6) as correlation, r.rank
        from ranked r semi join known k using (repo_id, path) where r.rank <= 5""",
    ),
    "risk_score": (ENRICHED, "select repo_id, path, risk_score from scored"),
    "categorize": (CATEGORIZED, "select repo_id, path, category from categorized"),
    "category_counts": (CATEGORIZED, "select repo_id, category, count(*) as files from categorized group by all"),
    "feature_files": (_feature("layout_files"), "select repo_id, name, path from feature_files"),
    "features": (_feature("code_files"), "select repo_id, name, count(*) as file_count from feature_files group by all"),
    "test_directories": (
        CATEGORIZED,
        f"""select distinct repo_id, coalesce(nullif({DIRNAME.format(p='path')}, ''), '.') as directory
        from categorized where category = 'tests'""",
    ),
    "config_files": (CATEGORIZED, "select repo_id, path from categorized where category = 'config'"),
    "overview": (
        LAYOUT,
        """select repo_id, count(*) as total_files, (select count(*) from dead d where d.repo_id = f.repo_id) as dead_files,
        array_to_string(list_sort(list(distinct language)), ',') as languages from facts f group by repo_id""",
    ),
    "risk_summary": (
        ENRICHED,
        """select repo_id, count(*) as high_risk_files, round(avg(risk_score), 6) as average_score,
        count(*) filter (risk_score >= 10) as critical_files,
        count(*) filter (risk_score between 7 and 9) as high_files from scored where risk_score >= 5 group by repo_id""",
    ),
    "high_risk_files": (
        ENRICHED,
        """select repo_id, path, risk_score, lines, complexity, incoming,
        row_number() over (partition by repo_id order by risk_score desc, path) as rank from scored where risk_score >= 5""",
    ),
    "top_risk_files": (
        ENRICHED,
        _limited("scored where risk_score >= 5", "risk_score desc, path", "repo_id, path, risk_score, lines, complexity, incoming", 20),
    ),
    "key_dependencies": (
        LAYOUT,
        """select * from (select repo_id, path, incoming, row_number() over (partition by repo_id order by incoming desc, path) as rank
        from degrees where incoming > 0) where rank <= 10""",
    ),
    "core_files": (
        CATEGORIZED_FULL,
        _limited(
            "categorized where category = 'core'",
            "path",
            "repo_id, path, incoming, primary_author, {f} as function_count, {c} as class_count",
            10,
        ),
    ),
    "entry_points": (
        CATEGORIZED_FULL,
        """select repo_id, path, language, lines, primary_author, case when complexity > 10 then 'High'
        when complexity > 5 then 'Medium' else 'Low' end as complexity_label from categorized where category = 'entryPoints'""",
    ),
    "first_entry_points": (
        CATEGORIZED_FULL,
        """select * from (select repo_id, path, language, lines, primary_author, case when complexity > 10 then 'High'
        when complexity > 5 then 'Medium' else 'Low' end as complexity_label,
        row_number() over (partition by repo_id order by path) as rank from categorized where category = 'entryPoints')
        where rank <= 5""",
    ),
    "feature_listing": (_feature("code_files"), _limited("feature_files", "path", "repo_id, name, path", 5, "repo_id, name")),
    "first_features": (
        _feature("code_files"),
        """select * from (select repo_id, name, count(*) as file_count,
        row_number() over (partition by repo_id order by name) as rank from feature_files group by repo_id, name) where rank <= 8""",
    ),
    "dead_code_listing": (
        LAYOUT,
        _limited("dead", "path", "repo_id, path, 'No imports found from other files' as reason", 10),
    ),
}
FUNCTION_COUNT = f"""cast(case language when 'python' then len(list_distinct({_all("content", "def (\\w+)")}))
  when 'java' then len(list_distinct({_all("content", "\\w (\\w+)\\([^)]*\\) \\{")}))
  when 'go' then len(list_distinct({_all("content", "func (\\w+)")}))
  else len(list_distinct({_all("content", "function (\\w+)")})) end as bigint)"""
CLASS_COUNT = f"""cast(case language when 'python' then 0 when 'go' then 0
  else len(list_distinct({_all("content", "class (\\w+)")})) end as bigint)"""
QUERIES["core_files"] = (
    QUERIES["core_files"][0],
    QUERIES["core_files"][1].replace("{f}", FUNCTION_COUNT).replace("{c}", CLASS_COUNT),
)
QUERIES["analyze_files"] = QUERIES["enrich_files"]
QUERIES["architecture_map_core"] = QUERIES["core_files"]
QUERIES["onboarding_overview"] = QUERIES["overview"]
QUERIES["risk_report"] = (
    QUERIES["high_risk_files"][0],
    QUERIES["high_risk_files"][1].replace("risk_score >= 5", "risk_score >= 4"),
)


# Whole jobs, table by table and section by section.
_FEATURES = f"{LAYOUT}, {_feature('facts')}"
_KNOWN = LANGUAGE.format(p="path") + " is not null"
_SCRIPTS = LANGUAGE.format(p="path") + " in ('javascript', 'typescript')"
_COMPLEXITY_POINTS = "case when complexity > 20 then 3 when complexity > 10 then 2 when complexity > 5 then 1 else 0 end"


def _first(query: str, limit: int, was: int = 10) -> tuple[str, str]:
    """A ranked list cut at another place."""
    expressions, select = QUERIES[query]
    return expressions, select.replace(f"rank <= {was}", f"rank <= {limit}").replace(f"n - {was}", f"n - {limit}")


QUERIES |= {
    "analyze_edges": QUERIES["configured_import_edges"],
    "analyze_partners": (
        "brand_log as (select b.repo_id, c.hash, c.file from bulk_commit_files c join brand_files b on b.path = c.file), "
        + CO_CHANGE.format(log="brand_log", threshold=0.3),
        f"""select repo_id, path, file, count, round(correlation, 6) as correlation, rank from ranked where rank <= 5 and {_KNOWN}""",
    ),
    "analyze_total_files": ("", f"select repo_id, count(*) filter ({_KNOWN}) as total_files from single_files group by repo_id"),
    "analysis_overview": (
        "",
        f"""select repo_id, count(*) filter ({_KNOWN}) as total_files,
        count(*) filter ({_SCRIPTS} and contains(content, 'export const') and not {TEST_FILE.format(p='path')}
          and not regexp_matches({BASENAME.format(p='path')}, '^(index|main|app)(\\.[^.]*)?$')) as dead_files,
        coalesce(string_agg({LANGUAGE.format(p='path')}, ','), '') as languages from single_files group by repo_id""",
    ),
    "risk_report_summary": (
        f"points as (select repo_id, {_COMPLEXITY_POINTS} as risk_score from (select repo_id, {COMPLEXITY.format(c='content')} as complexity from single_files where {_KNOWN}))",
        """select repo_id, count(p.risk_score) as high_risk_files, round(avg(p.risk_score), 6) as average_score, cast(0 as bigint) as critical_files,
        cast(0 as bigint) as high_files from (select distinct repo_id from single_files) r
        left join (select * from points where risk_score >= 3) p using (repo_id) group by repo_id""",
    ),
    "documents_contributors": (
        f"{LAYOUT}, {AUTHORS.format(log='layout_commit_files')}",
        "select a.repo_id, a.path, a.rank, a.author, a.commits from authors a semi join facts f using (repo_id, path)",
    ),
    "documents_neighbours": (_resolution("layout_files"), QUERIES["call_graph"][1]),
    "documents_feature_files": (_FEATURES, "select repo_id, name, path from feature_files"),
    "documents_files": (ENRICHED, "select repo_id, path, language, lines, primary_author as primary, total_commits from enriched"),
    "analysis_summary_languages": QUERIES["language_stats"],
    "analysis_summary_top_contributors": _first("top_contributors", 5),
    "analysis_summary_dead_code": QUERIES["dead_code_listing"],
    "architecture_map_category_counts": QUERIES["category_counts"],
    "architecture_map_entry_points": QUERIES["entry_points"],
    "architecture_map_features": (_FEATURES, QUERIES["features"][1]),
    "architecture_map_feature_files": (_FEATURES, QUERIES["feature_listing"][1]),
    "architecture_map_key_dependencies": QUERIES["key_dependencies"],
    "architecture_map_call_graph": (_resolution("layout_files"), QUERIES["call_graph"][1]),
    "onboarding_entry_points": QUERIES["first_entry_points"],
    "onboarding_core_files": _first("core_files", 5),
    "onboarding_features": (_FEATURES, QUERIES["first_features"][1]),
    "onboarding_test_files": (CATEGORIZED, "select repo_id, count(*) as test_files from categorized where category = 'tests' group by repo_id"),
    "onboarding_test_directories": QUERIES["test_directories"],
    "onboarding_config_files": QUERIES["config_files"],
    "risk_report_top_risk_files": QUERIES["top_risk_files"],
    "risk_report_critical_files": (QUERIES["high_risk_files"][0], f"select repo_id, path, risk_score, rank from ({QUERIES['high_risk_files'][1]}) where risk_score >= 10"),
}


def build() -> dict[str, str]:
    """Complete statements: the bridge views a query mentions, its own expressions, its SELECT."""
    statements = {}
    for name, (expressions, select) in QUERIES.items():
        used = [view for view in ORACLE_VIEWS if re.search(rf"\b{view}\b", f"{expressions} {select}")]
        views = [f"{view} as ({ORACLE_VIEWS[view]})" for view in used] + ([expressions] if expressions else [])
        statements[name] = (f"with {', '.join(views)} " if views else "") + select
    return statements
