"""Lines that recur across documents, found as templates by a tree of fixed depth; built-in functions only.

A line goes to the leaf of its number of tokens and its leading tokens, where tokens with digits count as variable.
Within a leaf, lines gather around the two tokens of theirs, each at its place, that most documents of the leaf have.
What less than half of the documents of such a group have at a place is variable, however many documents there are; a
line that has enough of the rest is of the group's template. Lines whose template enough documents share are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelore.llm.common import column, settle, text_of
from sourcelore.operators.joins import attach

LEADING = 3
MIN_DOCUMENTS = 5
#: Tokens around which a line joins a group.
ANCHORS = 2
#: Least share of a group's documents that have what is fixed at a place.
COMMON_SHARE = 0.5
#: Least share of the places after the leading ones where a line has what is fixed, two places at least; of all tokens
#: of a line that recurs as it is, the least share without digits.
FIXED_SHARE = 0.5
ANY = "<*>"


def spaced(line: Column) -> Column:
    """The tokens between blanks, one space apart."""
    uneven = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("  "))
    return F.trim(F.when(uneven, F.regexp_replace(line, "[ \\t]+", " ")).otherwise(line))


def masked(tokens: Column) -> Column:
    """Tokens with digits replaced."""
    return F.regexp_replace(tokens, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", ANY)


def _lines(docs: DataFrame, id_name: str, text_name: str) -> DataFrame:
    """(id, content, line_no, leaf, class, size, line) of the lines with tokens; equal lines are of one class."""
    text = text_of(text_name)
    lines = docs.select(
        F.coalesce(column(id_name).cast("string"), F.lit("")).alias("id"),
        F.xxhash64(text).alias("content"),
        F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"),
    )
    lines = lines.select("id", "content", "line_no", spaced(F.col("line")).alias("line")).where(F.col("line") != "")
    size = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    leaf = F.xxhash64(F.concat_ws(" ", size.cast("string"), masked(F.substring_index("line", " ", LEADING))))
    return lines.select("id", "content", "line_no", leaf.alias("leaf"), F.xxhash64("line").alias("class"), size.alias("size"), "line")


def _parts(classes: DataFrame) -> DataFrame:
    """The classes with one row for each later token that may be fixed: ``part`` tells its place and the token."""
    kept = [c for c in classes.columns if c != "norm"]
    tokens = classes.select(*kept, F.posexplode(F.split("norm", " ")).alias("place", "token"))
    tokens = tokens.where((F.col("place") >= LEADING) & (F.col("token") != ANY))
    return tokens.select(*kept, "place", F.xxhash64("place", "token").alias("part"))


def _part_documents(placed: DataFrame, texts: DataFrame, group: str) -> DataFrame:
    """(group, part, documents): how many documents of a group have a part.

    Documents with the same classes in a group are counted together, so copies cost nothing. A part that several
    classes of one document share counts once.
    """
    of_document = placed.groupBy(group, "id", "content").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    sets = of_document.groupBy(group, "classes").agg(F.count(F.lit(1)).alias("documents"))
    members = sets.select(group, F.xxhash64("classes").alias("set"), "documents", (F.size("classes") == 1).alias("alone"), F.explode("classes").alias("class"))
    parts = _parts(attach(members, texts.select(group, "class", "norm"), [group, "class"]))
    several = parts.where(~F.col("alone")).select(group, "set", "part", "documents").distinct()
    counted = parts.where("alone").select(group, "part", "documents").unionByName(several.select(group, "part", "documents"))
    return counted.groupBy(group, "part").agg(F.sum("documents").alias("documents"))


def _documents(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """The keys that enough documents have, and ``total``, their number."""
    return rows.select(*key, "id", "content").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= least)


def _groups(placed: DataFrame, texts: DataFrame, min_documents: int) -> DataFrame:
    """(leaf, class, group): the groups of a line, by those of its parts that most documents of the leaf have."""
    common = _part_documents(placed, texts, "leaf").where(F.col("documents") >= min_documents)
    known = attach(_parts(texts.select("leaf", "class", "norm")), common, ["leaf", "part"])
    ranked = known.groupBy("leaf", "class").agg(F.collect_list(F.struct((-F.col("documents")).alias("rank"), "place", "part")).alias("parts"))
    first = ranked.select("leaf", "class", F.explode(F.slice(F.sort_array("parts"), 1, ANCHORS)).alias("anchor"))
    return first.select("leaf", "class", F.xxhash64("leaf", "anchor.part").alias("group"))


def _similar(placed: DataFrame, texts: DataFrame, min_documents: int) -> DataFrame:
    """(leaf, class) of the lines that are of a group's template, where enough documents have such lines."""
    groups = settle(_groups(placed, texts, min_documents))
    members = settle(attach(placed.select("leaf", "class", "id", "content").distinct(), groups, ["leaf", "class"]))
    totals = settle(_documents(members, ["group"], min_documents))
    members = attach(members, totals.select("group"), ["group"])
    words = settle(attach(attach(texts, groups, ["leaf", "class"]), totals.select("group"), ["group"]))
    shares = attach(_part_documents(members, words, "group"), totals, ["group"])
    fixed = shares.where(F.col("documents") >= F.col("total") * COMMON_SHARE).select("group", "part")
    agreed = attach(_parts(words), fixed, ["group", "part"]).groupBy("group", "leaf", "class", "size").agg(F.count(F.lit(1)).alias("fixed"))
    alike = agreed.where((F.col("fixed") >= 2) & (F.col("fixed") >= (F.col("size") - LEADING) * FIXED_SHARE)).select("group", "class")
    joined = settle(attach(members, alike, ["group", "class"]))
    return attach(joined, _documents(joined, ["group"], min_documents).select("group"), ["group"]).select("leaf", "class").distinct()


def recurring_lines(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(id, content, dropped): for a document, the numbers of its lines whose template recurs.

    Only hashes travel, but for the texts of lines in leaves that enough documents reach, one for each class. Lines that
    recur as they are, digits aside, are a template without variable places, short lines too.
    """
    lines = _lines(docs, id_name, text_name)
    document = ["id", "content"]
    numbers = settle(lines.drop("line"))
    busy = settle(_documents(numbers, ["leaf"], min_documents).select("leaf"))
    placed = settle(attach(numbers, busy, ["leaf"]).distinct())
    texts = attach(lines.select("leaf", "class", "size", "line"), busy, ["leaf"]).distinct()
    texts = settle(texts.select("leaf", "class", "size", masked(F.col("line")).alias("norm")))
    plain = F.size(F.filter(F.split("norm", " "), lambda token: token != ANY))
    same = texts.where(plain >= F.col("size") * FIXED_SHARE).select("leaf", "class", F.xxhash64("norm").alias("template"))
    same = settle(attach(placed.select("leaf", "class", *document), same, ["leaf", "class"]))
    again = attach(same, _documents(same, ["leaf", "template"], min_documents).drop("total"), ["leaf", "template"]).select("leaf", "class")
    gone = again.unionByName(_similar(placed, texts, min_documents)).distinct()
    return attach(placed, gone, ["leaf", "class"]).groupBy(*document).agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def without_recurring_lines(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Per document: doc_id, text without the lines that recur, n_lines, n_dropped.

    Documents are told apart by id and text, so rows that repeat both count once and get the same result. A null text
    counts as empty: one empty line, nothing dropped. Empty lines always stay. An empty table gives an empty result.
    """
    text = text_of(text_name)
    rows = docs.select(column(id_name).alias("doc_id"), F.coalesce(column(id_name).cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("content"), text.alias("text"))
    placed = attach(rows, recurring_lines(docs, id_name, text_name, min_documents), ["id", "content"], "left")
    lines = F.split("text", "\n", -1)
    gone = F.coalesce("dropped", F.array().cast("array<int>"))
    kept = F.filter(lines, lambda line, i: ~F.array_contains(gone, i))
    return placed.select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
    )


LINES_SQL = f"""
with rows as (
    select row_number() over () as row, doc_id, coalesce(doc_id::varchar, '') as id, coalesce(text, '') as content from documents
), lines as (
    select *, unnest(list) as line, unnest(range(0, len(list))) as line_no from (select id, content, string_split(content, chr(10)) as list from rows group by all)
), tokens as (
    select id, content, line_no, list_transform(list_filter(string_split_regex(line, '[ \\t]+'), lambda t: t <> ''),
           lambda t: case when regexp_matches(t, '[0-9]') then '{ANY}' else t end) as tokens from lines
), leaves as (
    select *, concat_ws(' ', len(tokens)::varchar, array_to_string(tokens[1:{LEADING}], ' ')) as leaf from tokens where len(tokens) > 0
), busy as (
    select leaf from (select distinct leaf, id, content from leaves) group by leaf having count(*) >= {MIN_DOCUMENTS}
), placed as (
    select *, array_to_string(tokens, ' ') as norm from leaves where leaf in (select leaf from busy)
), classes as (
    select distinct leaf, norm, tokens, id, content from placed
), parts as (
    select * from (select leaf, norm, id, content, len(tokens) as size, unnest(tokens) as token, unnest(range(0, len(tokens))) as place from classes)
    where place >= {LEADING} and token <> '{ANY}'
), common as (
    select leaf, place, token, count(*) as documents from (select distinct leaf, place, token, id, content from parts) group by all having count(*) >= {MIN_DOCUMENTS}
), anchors as (
    select leaf, norm, place as a_place, token as a_token from (select distinct leaf, norm, place, token, documents from parts join common using (leaf, place, token))
    qualify row_number() over (partition by leaf, norm order by documents desc, place) <= {ANCHORS}
), members as (
    select leaf, a_place, a_token, norm, id, content from classes join anchors using (leaf, norm)
), totals as (
    select leaf, a_place, a_token, count(*) as total from (select distinct leaf, a_place, a_token, id, content from members) group by all having count(*) >= {MIN_DOCUMENTS}
), shares as (
    select leaf, a_place, a_token, place, token, count(*) as documents
    from (select distinct leaf, a_place, a_token, place, token, id, content from members join parts using (leaf, norm, id, content)) group by all
), fixed as (
    select leaf, a_place, a_token, place, token from shares join totals using (leaf, a_place, a_token) where documents >= total * {COMMON_SHARE}
), alike as (
    select leaf, a_place, a_token, norm from (select distinct leaf, norm, size, place, token from parts) join anchors using (leaf, norm)
    join fixed using (leaf, a_place, a_token, place, token) group by leaf, a_place, a_token, norm, size
    having count(*) >= 2 and count(*) >= (size - {LEADING}) * {FIXED_SHARE}
), joined as (
    select * from members join alike using (leaf, a_place, a_token, norm)
), recurring as (
    select distinct leaf, norm from joined join (select leaf, a_place, a_token from (select distinct leaf, a_place, a_token, id, content from joined)
    group by all having count(*) >= {MIN_DOCUMENTS}) using (leaf, a_place, a_token)
    union
    select leaf, norm from classes where len(list_filter(tokens, lambda t: t <> '{ANY}')) >= len(tokens) * {FIXED_SHARE}
    group by leaf, norm having count(*) >= {MIN_DOCUMENTS}
), gone as (
    select id, content, list(distinct line_no) as dropped from placed join recurring using (leaf, norm) group by id, content
)
select doc_id, array_to_string(list_filter(string_split(r.content, chr(10)), lambda line, i: not list_contains(coalesce(dropped, []), i - 1)), chr(10)) as text,
       len(string_split(r.content, chr(10)))::bigint as n_lines, coalesce(len(dropped), 0)::bigint as n_dropped
from rows r left join gone g on r.id = g.id and r.content = g.content
"""
