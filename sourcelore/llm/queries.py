"""The operators as queries over the benchmark tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sourcelore.llm import (
    bpe,
    conversation_trie,
    exact_dedup,
    html_text,
    jaccard_join,
    language_id,
    line_templates,
    mixing,
    periodic_runs,
    secret_scan,
    sharding,
    toxicity,
    vector_search,
)
from sourcelore.llm.common import table


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plans: dict[str, tuple] = {
        "op1_exact_dedup": (exact_dedup.duplicate_groups, "documents"),
        "op2_line_dedup": (line_templates.without_recurring_lines, "documents"),
        "op3_top_k_search": (vector_search.top_k, "embeddings"),
        "op4_secret_scan": (secret_scan.secrets, "documents"),
        "op5_language_id": (language_id.language_report, "documents"),
        "op6_html_text": (html_text.article_report, "pages"),
        "op7_sharding": (sharding.sharded, "documents"),
        "op8_jaccard_join": (jaccard_join.near_duplicates, "documents"),
        "op9_bpe": (bpe.token_digests, "documents"),
        "op10_mixing": (mixing.mix_report, "documents"),
        "op11_toxicity": (toxicity.toxicity_report, "documents", "labels"),
        "op12_conversation_trie": (conversation_trie.trie_report, "conversations"),
        "op13_periodic_runs": (periodic_runs.run_report, "documents"),
    }
    return {
        name: (lambda spark, sf_dir, plan=plan, of=of: plan(*[table(spark, sf_dir, one) for one in of])) for name, (plan, *of) in plans.items()
    }


def oracles() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.DUPLICATES_SQL,
        "op2_line_dedup": line_templates.LINES_SQL,
        "op3_top_k_search": vector_search.TOP_K_SQL,
        "op4_secret_scan": secret_scan.SECRETS_SQL,
        "op10_mixing": mixing.MIX_SQL,
        "op12_conversation_trie": conversation_trie.TRIE_SQL,
    }
