"""The whole analysis of one or many repositories as a set of tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cochange, files as file_ops, graph, history, imports, summary
from ..sources import config as configs
from ..sources.sinks import document_tables


@dataclass(frozen=True)
class Analysis(Mapping):
    """Tables of an analysis by name; ``analysis["files"]`` is the enriched file table."""

    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)

    def release(self) -> None:
        """Drop what the analysis persisted."""
        for table in self.tables.values():
            table.unpersist()

    def documents(self) -> dict[str, DataFrame]:
        """The analysis as documents: files and features, and a table with one row per item for each of their lists."""
        return document_tables(self)


def _keep(table: DataFrame, workdir: str | None, name: str) -> DataFrame:
    """Hold a table that several others are made from, so that none computes it again."""
    if workdir is None:
        return table.persist(StorageLevel.MEMORY_AND_DISK)
    location = f"{workdir}/{name}"
    table.write.mode("overwrite").parquet(location)
    return table.sparkSession.read.parquet(location)


def analyze(
    files: DataFrame,
    commit_files: DataFrame,
    ignore: str | None = None,
    include_tests: bool = False,
    include_co_change: bool = True,
    mode: str = "lexical",
    repo_paths: DataFrame | None = None,
    use_config: bool = True,
    workdir: str | None = None,
    repositories: DataFrame | None = None,
) -> Analysis:
    """Analyse source texts (repo_id, path, content) and their commit log together.

    ``repo_paths`` lists all existing paths when ``files`` is not the whole tree. With
    ``use_config`` the path configs among ``files`` resolve aliases; finding inherited
    configs takes one small job per level.

    ``repositories`` (repo_id) lists those that reports speak of even when nothing in them is
    analysed; without it these are the repositories of ``files``. With a ``workdir`` the log is read once.

    Facts, edges, the log's columns, authors, partners and enriched files, which the other tables are made from, are
    written to ``workdir``, a folder the whole cluster reaches. Without one they are
    persisted when first used, until ``Analysis.release``; but the log is not, and of the facts only imports are (with
    exports, where unused files are shown), and each table takes the others that it shows from the texts, so that one
    table costs no more than it needs. Give a ``workdir`` to read all.
    """
    analysed = file_ops.filter_ignored(files, file_ops.ignore_patterns(ignore))
    facts = file_ops.file_facts(analysed, mode)
    if workdir is not None:
        facts = _keep(facts, workdir, "file_facts")
    links = facts.select("repo_id", "path", "imports")
    if workdir is None:
        links = _keep(links, workdir, "imports")
    existing = files.select("repo_id", "path") if repo_paths is None else repo_paths
    config = aliases = None
    if use_config:
        chain = configs.config_chain(files, existing)
        config = configs.path_config(chain)
        aliases = configs.path_aliases(chain, config)
    edges = imports.import_edges(imports.resolve_imports(links, existing, config, aliases), links)
    edges = _keep(edges, workdir, "edges")
    exporting, named_in = facts, edges
    if workdir is None:
        # Unused files take imports and exports from one pass over the texts, and then need neither table above.
        exporting = _keep(facts.select("repo_id", "path", "imports", "exports"), workdir, "exporting")
        named_in = imports.import_edges(imports.resolve_imports(exporting, existing, config, aliases), exporting)
    # With a workdir, whatever parses the log does so once: all that is made from it starts at these columns. A persisted
    # log is another matter, as Spark shuffles it anew for each branch of the plans above it.
    log = commit_files.select("repo_id", "hash", "file", "author", "ts", "log_pos")
    if include_co_change and workdir is not None:
        log = _keep(log, workdir, "commit_files")
    states = _keep(history.author_states(log), workdir, "author_states")
    authors = history.ranked_authors(states)

    degrees = graph.degrees(facts, edges)
    partners = None
    measures = enriched = summary.enrich_files(facts, history.file_states(states), None, degrees)
    if include_co_change:
        partners = _keep(cochange.top_co_change(log, targets=facts), workdir, "co_change")
        if workdir is None:
            # Kept apart, so that what shows no partners never waits for them.
            measures = _keep(enriched.drop("co_changed_files"), workdir, "measures")
        enriched = summary.with_partners(measures, partners)
    enriched = _keep(enriched, workdir, "files")
    if partners is None or workdir is not None:
        measures = enriched.drop("co_changed_files")
    # Files as often as they are in `files`, for what shows paths and languages only and needs no text, log or graph.
    key = ["repo_id", "path"]
    paths = measures.select(*key, "language")
    if workdir is None:
        # Each of n equal files meets n of them, as in a join of the files with themselves, where no null meets any.
        paths = file_ops.with_language(analysed).groupBy(*key, "language").agg(F.count("*").alias("n"))
        times = F.when(F.col("repo_id").isNull(), F.col("n")).otherwise(F.col("n") * F.col("n"))
        paths = paths.select(*key, "language", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("at")).drop("at")
    known = files.select("repo_id") if repositories is None else repositories.select("repo_id")
    tables = {
        "repositories": known.distinct(),
        "files": enriched,
        # The same files without partners, for what shows none.
        "measures": measures,
        "paths": paths,
        "imports": links,
        "file_facts": facts,
        "edges": edges,
        "call_graph": graph.call_graph(edges),
        "degrees": degrees,
        "exporting": exporting,
        "dead_code": graph.dead_code(exporting, named_in, include_tests),
        "file_authors": authors,
        "ownership": history.ownership_of(facts, authors),
        "languages": summary.language_stats(facts),
        "contributors": summary.contributor_stats(facts, authors),
        "total_files": summary.total_files(facts, known),
    }
    if partners is not None:
        tables |= {"co_change": partners, "commit_files": log}
    tables["author_states"] = states
    return Analysis(tables)
