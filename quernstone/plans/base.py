"""The query registry: a function and, where SQL can say the same, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
DIGITS = 6  # sums of doubles depend on their order beyond that
# double columns of the results that are compared with SQL; both sides are rounded
FLOATS = {
    "stratum_fracs": "fraction",
    "fuzzy_ratio": "ratio",
    "span_prf_strict": "precision recall f1",
    "span_prf_lenient": "precision recall f1",
    "span_prf_attribute": "precision recall f1",
    "coarse_gain": "fine_precision fine_recall fine_f1 coarse_precision coarse_recall coarse_f1 precision_gain recall_gain f1_gain",
    "macro_weighted_avg": "macro_precision macro_recall macro_f1 weighted_precision weighted_recall weighted_f1",
    "tag_confusion_norm": "value",
    "prf_by_length_bin": "precision recall f1",
    "multi_attribute_split": "precision recall f1",
    "color_ambiguity": "precision recall f1",
    "hier_sparsity": "precision recall f1",
    "slot_prf": "precision recall f1",
    "query_exact_partial": "exact_rate partial_rate",
    "attribute_coverage": "coverage",
    "cohen_kappa": "accuracy kappa",
    "qa_report": "entity_ratio",
    "silver_accuracy_by_type": "accuracy",
    "tag_distribution": "fraction",
    "describe_lengths": "mean std p25 p50 p75",
    "reformulation_rate": "rate",
    "bm25_topk": "score",
    "attr_rerank": "score boost",
    "ranking_metrics": "ndcg recall mrr",
    "weight_grid_search": "w_brand w_product_type w_color ndcg recall mrr",
    "multi_seed_agg": "mean std",
    "latency_stats": "mean_ms std_ms min_ms max_ms throughput",
    "coarse_consistency": "mismatch",
    "rarity_gain": "fine_precision fine_recall fine_f1 coarse_precision coarse_recall coarse_f1 precision_gain recall_gain f1_gain",
    "sparsity_summary": "avg_rare_f1 avg_common_f1 coarse_f1",
    "error_buckets": "rate",
    "best_model": "f1",
    "metrics_unpivot": "value",
    "efficiency_table": "total_params_millions trainable_params_millions training_time_seconds training_time_minutes avg_latency_ms std_latency_ms throughput_queries_per_sec",
    "error_report": "value",
    "class_imbalance": "imbalance",
    "entities_per_query": "mean median",
    "dataset_summary": "avg_tokens_per_query avg_entities_per_query",
    "length_spread": "mean median",
    "retrieval_comparison": "ndcg recall mrr",
    "best_weights": "w_brand w_product_type w_color ndcg recall mrr",
    "annotate_splits": "percent",
    "correction_rate": "rate kappa",
    "type_confusion_corrected": "value",
}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        cols = FLOATS.get(f.__name__, "").split()

        @wraps(f)
        def rounded(spark, sf_dir):
            return f(spark, sf_dir).withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in cols}) if cols else f(spark, sf_dir)

        QUERIES[f.__name__] = rounded
        if sql:
            # a zero may come out signed on one side only
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}::DOUBLE, {DIGITS}) + 0.0 AS {c}' for c in cols)}) FROM ({sql})" if cols else sql
        return rounded

    return add
