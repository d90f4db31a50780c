"""BM25 retrieval, attribute-aware reranking and ranking metrics, for all queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product as combos

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import bm25_tokens
from quernstone.operators.metrics import ratio
from quernstone.session import materialize, spread

# fixed values: the parameters of the score, the weights of matched types and those that the grid search tries
K1, B = 1.5, 0.75
WEIGHTS = {"BRAND": 2.0, "PRODUCT_TYPE": 1.5, "COLOR": 1.2, "MATERIAL": 1.2}
GRID = {"BRAND": (1.5, 2.0, 2.5, 3.0), "PRODUCT_TYPE": (1.2, 1.5, 2.0), "COLOR": (1.0, 1.2, 1.5)}


def index(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, w, dl), (terms: term, df), (corpus: one row n, avgdl), written once and read by whoever scores."""
    t, _ = materialize(docs.select("doc_id", bm25_tokens(F.col(text)).alias("w")).withColumn("dl", F.size("w")), "index")
    terms = t.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    corpus = t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return spread(t), terms, corpus


def idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.ln((n - df + 0.5) / (df + 0.5) + 1)).otherwise(0.0)


BLOCK, DOCS = 4_096, 1_024  # queries that a task scores at a time, documents that it scores together


def _scored(held, k: int, k1: float, b: float):
    """Best k documents of each query of a block over the documents of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, by_term, avgdl = held.value
        best: list[list[tuple[float, object]]] = [[] for _ in ids]  # (-score, document), the best first
        least = np.full(len(ids), 1e-12)  # what a document must reach to get in
        for pdf in batches:
            for i in range(0, len(pdf), DOCS):
                part = pdf.iloc[i : i + DOCS]
                docs, scores = part["doc_id"].to_list(), np.zeros((len(ids), len(part)))
                dl = part["dl"].to_numpy(dtype=float)
                places: dict[str, list[int]] = {}
                for at, words in enumerate(part["w"]):
                    for w in words:
                        if w in by_term:
                            places.setdefault(w, []).append(at)
                for w, held_by in places.items():
                    at, tf = np.unique(held_by, return_counts=True)
                    queries, weights = by_term[w]
                    scores[np.ix_(queries, at)] += np.outer(weights, tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[at] / avgdl)))
                np.round(scores, 9, out=scores)
                for q in np.flatnonzero(scores.max(axis=1) >= least).tolist():
                    own = scores[q]
                    at = np.flatnonzero(own >= least[q])
                    if len(at) > k:  # those that equal the k-th stay in until ties are settled
                        at = at[own[at] >= np.partition(own[at], -k)[-k]]
                    best[q] = sorted([*best[q], *((-own[j], docs[j]) for j in at.tolist())])[:k]
                    if len(best[q]) == k:
                        least[q] = -best[q][-1][0]
        for i in range(0, len(ids), 1_000):
            rows = [(q, d, -s) for q, held_by in zip(ids[i : i + 1_000], best[i : i + 1_000]) for s, d in held_by]
            yield pd.DataFrame(rows, columns=["query_id", "doc_id", "score"])

    return run


def bm25(queries: DataFrame, idx: tuple[DataFrame, DataFrame, DataFrame], k: int, k1: float = K1, b: float = B, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k documents of each query among those with a query term; repeated query terms
    count again.

    Documents stay where they are, and a document's terms in its row. Query terms are weighed first and go to the tasks in
    blocks of at most ``block`` queries; a task sums its documents' scores and hands on its best k of each query. So a term
    that most documents hold shuffles nothing, and what is ranked in the end is bounded by tasks times queries times k. Each
    block reads the index again.
    """
    docs, terms, corpus = idx
    spark = queries.sparkSession
    n, avgdl = corpus.first()
    q = queries.select("query_id", F.explode(bm25_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weighted, _ = materialize(q.join(terms, "term").select("query_id", "term", (idf(F.lit(n), F.col("df")) * F.col("qtf")).alias("w")), "query-weights")
    numbered = weighted.select("query_id").distinct()
    blocks = max(1, -(-numbered.count() // block))
    out = None
    for i in range(blocks):
        rows = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas()  # about ``block`` queries
        number, ids = pd.factorize(rows["query_id"], sort=True)
        term, terms_held = pd.factorize(rows["term"])
        at = np.argsort(term, kind="stable")
        ends = np.flatnonzero(np.diff(term[at])) + 1
        by_term = dict(zip(terms_held.tolist(), zip(np.split(number[at], ends), np.split(rows["w"].to_numpy()[at], ends))))
        ids = ids.tolist()
        held = spark.sparkContext.broadcast((ids, by_term, float(avgdl or 1.0)))
        best = docs.mapInPandas(_scored(held, k, k1, b), f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(docs.dtypes)['doc_id']}, score double")
        out = best if out is None else out.unionByName(best)
    return materialize(top_k(out, k), "ranking")[0]  # at most k rows a query, which rerankers read more than once


def top_k(scores: DataFrame, k: int | None, score: str = "score") -> DataFrame:
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")).cast("long"))
    return ranked.where(F.col("rank") <= k) if k else ranked


# fixed values: names of product attributes and the entity types they stand for; others stand for themselves in capitals
ATTRIBUTES = {"brand": "BRAND", "product_type": "PRODUCT_TYPE", "color": "COLOR", "material": "MATERIAL", "size": "SIZE_MEASURE"}


def attribute_index(docs: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """(doc_id, entity_type, value): distinct lower-case trimmed values of attribute columns, text, arrays or numbers; null and
    empty ones are no attributes. A column's name says its type."""
    kinds, none = dict(docs.dtypes), F.array().cast("array<struct<entity_type:string,value:string>>")

    def of(c: str) -> Column:
        values = F.col(c).cast("array<string>") if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
        held = F.filter(values, lambda v: v.isNotNull() & (v != ""))
        return F.coalesce(F.transform(held, lambda v: F.struct(F.lit(ATTRIBUTES.get(c.lower(), c.upper())).alias("entity_type"), F.lower(F.trim(v)).alias("value"))), none)

    return docs.select(key, F.explode(F.concat(*[of(c) for c in columns])).alias("x")).select(key, "x.*").distinct()


def matches(ranked: DataFrame, query_attrs: DataFrame, doc_attrs: DataFrame) -> DataFrame:
    """Per ranked pair and query value whether the document has it: its attribute of the type equals or contains the value.
    ``query_attrs`` is (query_id, entity_type, value), ``doc_attrs`` (doc_id, entity_type, value), both lower case."""
    pairs = ranked.select("query_id", "doc_id").join(query_attrs.distinct(), "query_id").join(doc_attrs.distinct().withColumnRenamed("value", "has"), ["doc_id", "entity_type"])
    return pairs.where(F.contains("has", F.col("value"))).select("query_id", "doc_id", "entity_type", "value").distinct()


def rerank(ranked: DataFrame, query_attrs: DataFrame, doc_attrs: DataFrame, k: int, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Scores times the weight of every matched value, ranked again and cut to k; other types weigh 1."""
    weight = F.coalesce(*[F.when(F.col("entity_type") == t, F.lit(w)) for t, w in weights.items()], F.lit(1.0))
    boost = matches(ranked, query_attrs, doc_attrs).groupBy("query_id", "doc_id").agg(F.product(weight).alias("boost"))
    scored = ranked.drop("rank").join(boost, ["query_id", "doc_id"], "left").withColumn("boost", F.coalesce("boost", F.lit(1.0)))
    return top_k(scored.withColumn("score", F.round(F.col("score") * F.col("boost"), 9)), k)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """Mean nDCG, recall and MRR at k over ``queries`` (query_id); the ideal order is that of the retrieved hits."""
    by = by or []
    hit = ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").na.fill(0, ["rel"])
    ideal = Window.partitionBy(*by, "query_id").orderBy(F.desc("rel"), "rank")
    hit = hit.withColumn("best", F.row_number().over(ideal))
    gain = lambda place: F.sum(F.col("rel") / F.log2(F.col(place) + 1.0))
    each = hit.groupBy(*by, "query_id").agg(gain("rank").alias("dcg"), gain("best").alias("idcg"), F.sum("rel").alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    n_rel = relevant.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_rel"))
    groups = queries.select("query_id") if not by else queries.select("query_id").crossJoin(F.broadcast(ranked.select(*by).distinct()))  # a group is a weight set
    full = groups.join(each, [*by, "query_id"], "left").join(n_rel, "query_id", "left")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return full.groupBy(*by).agg(F.count("*").alias("queries"), mean(ratio(F.col("dcg"), F.col("idcg"))).alias("ndcg"), mean(ratio(F.col("hits"), F.col("n_rel"))).alias("recall"), mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def grid_search(ranked: DataFrame, query_attrs: DataFrame, doc_attrs: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """nDCG, recall and MRR of every weight combination. Matches are found once; a combination only weighs their counts."""
    spark = ranked.sparkSession
    grid = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(combos(*GRID.values()))], "combo int, " + ", ".join(f"w_{t.lower()} double" for t in GRID))
    found = matches(ranked, query_attrs, doc_attrs).groupBy("query_id", "doc_id").agg(*[F.count_if(F.col("entity_type") == t).alias(f"n_{t.lower()}") for t in (*GRID, "MATERIAL")])
    counted = ranked.drop("rank").join(found, ["query_id", "doc_id"], "left").na.fill(0)
    boost = F.pow(F.lit(WEIGHTS["MATERIAL"]), F.col("n_material"))
    for t in GRID:
        boost = boost * F.pow(F.col(f"w_{t.lower()}"), F.col(f"n_{t.lower()}"))
    scored = counted.crossJoin(F.broadcast(grid)).withColumn("score", F.round(F.col("score") * boost, 9))  # 36 combinations
    w = Window.partitionBy("combo", "query_id").orderBy(F.desc("score"), "doc_id")
    metrics = ranking_metrics(scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), relevant, queries, k, ["combo"])
    return grid.join(metrics, "combo")


def best_weights(grid: DataFrame, by: str = "ndcg") -> DataFrame:
    """The first combination of a grid search that none exceeds."""
    return grid.orderBy(F.desc(by), "combo").limit(1)


def evaluate_retrieval(ranked: DataFrame, query_attrs: DataFrame, doc_attrs: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(system, queries, ndcg, recall, mrr) of the ranking as it is, cut to k, and of it reranked by attributes. A query
    without attributes keeps its order in both."""
    two = top_k(ranked.drop("rank"), k).withColumn("system", F.lit("baseline")).unionByName(rerank(ranked, query_attrs, doc_attrs, k).drop("boost").withColumn("system", F.lit("rerank")))
    return ranking_metrics(two, relevant, queries, k, ["system"])
