"""Queries over retrieval and reporting operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import extrinsic as X
from quernstone.operators import metrics as M
from quernstone.operators import predict
from quernstone.operators import retrieval as R
from quernstone.plans.base import query
from quernstone.plans.tag_queries import SPANS, TOK, pairs
from quernstone.session import table
from quernstone.sources import files

EX, PR = "shopping_queries_dataset_examples", "shopping_queries_dataset_products"
TOP = 20

# the catalogue is the corpus, the cleaned queries of val are the queries, products judged E are relevant
_RET = rf"""docs AS (SELECT product_id AS doc_id, min(product_title) AS text, min(lower(trim(product_brand))) AS brand, min(lower(trim(product_color))) AS color, min(lower(trim(product_category))) AS product_type FROM {PR} WHERE product_title IS NOT NULL GROUP BY 1),
dt AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM docs), dl AS (SELECT doc_id, count(*) AS dl FROM dt GROUP BY 1), avgdl AS (SELECT sum(dl) / (SELECT count(*) FROM docs) AS avgdl, (SELECT count(*) FROM docs) AS n FROM dl),
po AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(query_clean), '\s+'), lambda x: x <> '')) AS term FROM val) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN df USING (term) JOIN po USING (term) JOIN dl USING (doc_id), avgdl GROUP BY ALL),
r40 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {2 * TOP}),
rel AS (SELECT DISTINCT query_id, product_id AS doc_id FROM {EX} WHERE esci_label = 'E' AND query_id IN (SELECT query_id FROM val) AND product_id IS NOT NULL)"""
_ATT = f"""tok AS (SELECT query_id AS id, i - 1 AS p, w AS token, CASE WHEN t LIKE 'B-%' OR t LIKE 'I-%' THEN t ELSE 'O' END AS gold, 'O' AS pred FROM (SELECT query_id, unnest(query_tokens[1:least(len(query_tokens), len(ner_tags))]) AS w, unnest(ner_tags[1:least(len(query_tokens), len(ner_tags))]) AS t, unnest(range(1, least(len(query_tokens), len(ner_tags)) + 1)) AS i FROM val WHERE query_tokens IS NOT NULL AND ner_tags IS NOT NULL)),
{SPANS}, qa AS (SELECT DISTINCT id AS query_id, entity_type, lower(trim(txt)) AS value FROM spans WHERE side = 'g' AND rb AND trim(txt) <> ''), da AS (SELECT doc_id, 'BRAND' AS entity_type, brand AS has FROM docs WHERE brand <> '' UNION SELECT doc_id, 'COLOR', color FROM docs WHERE color <> '' UNION SELECT doc_id, 'PRODUCT_TYPE', product_type FROM docs WHERE product_type <> ''),
mt AS (SELECT DISTINCT r.query_id, r.doc_id, qa.entity_type, qa.value FROM r40 r JOIN qa USING (query_id) JOIN da ON da.doc_id = r.doc_id AND da.entity_type = qa.entity_type WHERE contains(has, value))"""
_METRICS = """hm AS (SELECT {by} q.query_id, rank, (rel.doc_id IS NOT NULL)::INT AS rel FROM {ranked} q LEFT JOIN rel ON rel.query_id = q.query_id AND rel.doc_id = q.doc_id WHERE rank <= 10),
hm2 AS (SELECT *, row_number() OVER (PARTITION BY {by} query_id ORDER BY rel DESC, rank) AS best FROM hm),
e AS (SELECT {by} query_id, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(best + 1)) AS idcg, sum(rel) AS hits, min(rank) FILTER (rel = 1) AS first_ FROM hm2 GROUP BY ALL), nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1)"""
_MEANS = "count(*) AS queries, coalesce(avg(coalesce(dcg / nullif(idcg, 0), 0)), 0) AS ndcg, coalesce(avg(coalesce(hits / nullif(n, 0), 0)), 0) AS recall, coalesce(avg(coalesce(1 / first_, 0)), 0) AS mrr"


def _retrieval(spark, d, k=2 * TOP):
    docs = table(spark, d, PR).where("product_title is not null").groupBy(F.col("product_id").alias("doc_id")).agg(F.min("product_title").alias("text"), F.min(F.lower(F.trim("product_brand"))).alias("brand"), F.min(F.lower(F.trim("product_color"))).alias("color"), F.min(F.lower(F.trim("product_category"))).alias("product_type"))
    queries = table(spark, d, "val").select("query_id", F.col("query_clean").alias("query"))
    ranked = R.bm25(queries, R.index(docs), k)
    relevant = table(spark, d, EX).where("esci_label = 'E' and product_id is not null").select("query_id", F.col("product_id").alias("doc_id")).join(queries.select("query_id"), "query_id", "left_semi").distinct()
    return docs, queries, ranked, relevant


def _attributes(spark, d, docs):
    t = table(spark, d, "val").where("query_tokens is not null and ner_tags is not null").select("query_id", F.col("query_tokens").alias("tokens"), F.col("ner_tags").alias("gold_tags"))
    q = t.select("query_id", F.explode(X.slots(X.attributes("gold_tags"))).alias("s")).select("query_id", F.col("s.t").alias("entity_type"), F.col("s.v").alias("value")).where("value <> ''")
    return q, R.attribute_index(docs, ["brand", "color", "product_type"]).where("value <> ''")


@query(f"WITH {_RET} SELECT query_id, doc_id, score, rank FROM r40 WHERE rank <= {TOP}")
def bm25_topk(spark, d):
    return _retrieval(spark, d, TOP)[2]


@query(f"WITH {_RET}, {_ATT}, b AS (SELECT query_id, doc_id, product(CASE entity_type WHEN 'BRAND' THEN 2.0 WHEN 'PRODUCT_TYPE' THEN 1.5 WHEN 'COLOR' THEN 1.2 WHEN 'MATERIAL' THEN 1.2 ELSE 1.0 END) AS boost FROM mt GROUP BY ALL), z AS (SELECT query_id, doc_id, round(score * coalesce(boost, 1), 9) AS score, coalesce(boost, 1.0)::DOUBLE AS boost FROM r40 LEFT JOIN b USING (query_id, doc_id)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM z QUALIFY rank <= {TOP}")
def attr_rerank(spark, d):
    docs, _, ranked, _ = _retrieval(spark, d)
    q, doc = _attributes(spark, d, docs)
    return R.rerank(ranked, q, doc, TOP)


@query(f"WITH {_RET}, {_METRICS.format(by='', ranked='r40')} SELECT {_MEANS} FROM val LEFT JOIN e USING (query_id) LEFT JOIN nr USING (query_id)")
def ranking_metrics(spark, d):
    _, queries, ranked, relevant = _retrieval(spark, d)
    return R.ranking_metrics(ranked, relevant, queries)


@query(
    f"WITH {_RET}, {_ATT}, gb AS (SELECT * FROM (VALUES (0, 1.5::DOUBLE), (1, 2.0), (2, 2.5), (3, 3.0)) t(i, w_brand)), gp AS (SELECT * FROM (VALUES (0, 1.2::DOUBLE), (1, 1.5), (2, 2.0)) t(j, w_product_type)), gc AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 1.2), (2, 1.5)) t(k, w_color)), grid AS (SELECT i * 9 + j * 3 + k AS combo, w_brand, w_product_type, w_color FROM gb, gp, gc), "
    "n AS (SELECT query_id, doc_id, count(*) FILTER (entity_type = 'BRAND') AS nb, count(*) FILTER (entity_type = 'PRODUCT_TYPE') AS np, count(*) FILTER (entity_type = 'COLOR') AS nc, count(*) FILTER (entity_type = 'MATERIAL') AS nm FROM mt GROUP BY ALL), "
    "z AS (SELECT combo, query_id, doc_id, round(score * pow(1.2, coalesce(nm, 0)) * pow(w_brand, coalesce(nb, 0)) * pow(w_product_type, coalesce(np, 0)) * pow(w_color, coalesce(nc, 0)), 9) AS score FROM r40 LEFT JOIN n USING (query_id, doc_id), grid), zr AS (SELECT *, row_number() OVER (PARTITION BY combo, query_id ORDER BY score DESC, doc_id) AS rank FROM z), "
    + _METRICS.format(by="combo,", ranked="zr").replace("SELECT combo, q.query_id", "SELECT q.combo, q.query_id")
    + f", gq AS (SELECT combo, query_id FROM grid, val) SELECT grid.combo, w_brand, w_product_type, w_color, m.queries, m.ndcg, m.recall, m.mrr FROM grid JOIN (SELECT combo, {_MEANS} FROM gq LEFT JOIN e USING (combo, query_id) LEFT JOIN nr USING (query_id) GROUP BY combo) m USING (combo)"
)
def weight_grid_search(spark, d):
    docs, queries, ranked, relevant = _retrieval(spark, d)
    q, doc = _attributes(spark, d, docs)
    return R.grid_search(ranked, q, doc, relevant, queries)


_SEEDS = "WITH r AS (SELECT o_orderstatus AS model, o_orderpriority AS seed, avg(o_totalprice) / 1000000 AS v FROM orders GROUP BY ALL) "


@query(_SEEDS + "SELECT model, avg(v) AS mean, stddev_pop(v) AS std, printf('%.4f ± %.4f', avg(v), stddev_pop(v)) AS mean_std, count(*) AS n_seeds, string_agg(printf('%.4f', v), '|' ORDER BY seed) AS values FROM r GROUP BY model")
def multi_seed_agg(spark, d):
    runs = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("seed")).agg((F.avg("o_totalprice") / 1000000).alias("v"))
    return M.seed_summary(runs, ["model"], "v", "seed")


@query("SELECT o_orderpriority AS metric, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def metric_pivot(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))
    return M.pivot(counts, ["metric"], "s", ["F", "O", "P"], "n").na.fill(0)


@query("WITH c AS (SELECT c_mktsegment AS model, avg(c_acctbal) / 10000 AS f1, count(*) AS queries FROM customer GROUP BY 1) SELECT model, printf('%.4f', f1) AS f1, queries, row_number() OVER (ORDER BY c.f1 DESC, model) AS rank, CASE row_number() OVER (ORDER BY c.f1 DESC, model) WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' ELSE (row_number() OVER (ORDER BY c.f1 DESC, model))::VARCHAR END AS medal FROM c")
def final_table_rank(spark, d):
    rows = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg((F.avg("c_acctbal") / 10000).alias("f1"), F.count("*").alias("queries"))
    medal = F.when(F.col("rank") == 1, "gold").when(F.col("rank") == 2, "silver").when(F.col("rank") == 3, "bronze").otherwise(F.col("rank").cast("string"))
    return M.ranked(rows, [F.desc("f1"), F.col("model")]).select("model", F.format_string("%.4f", "f1").alias("f1"), "queries", "rank", medal.alias("medal"))


@query("WITH r AS (SELECT event_type AS model, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS run FROM events) SELECT model, avg(value) AS mean_ms, stddev_pop(value) AS std_ms, min(value) AS min_ms, max(value) AS max_ms, count(*) AS runs, 1000 / avg(value) AS throughput FROM r WHERE run >= 10 GROUP BY model")
def latency_stats(spark, d):
    from pyspark.sql import Window

    runs = table(spark, d, "events").select(F.col("event_type").alias("model"), "value", (F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1).alias("run"))
    return M.latency(runs, ["model"], "value", "run")


@query("SELECT query_id, coalesce((SELECT string_agg(w || chr(9) || t, chr(10) ORDER BY i) FROM (SELECT unnest(query_tokens[1:least(len(query_tokens), len(ner_tags))]) AS w, unnest(ner_tags[1:least(len(query_tokens), len(ner_tags))]) AS t, unnest(range(1, least(len(query_tokens), len(ner_tags)) + 1)) AS i) WHERE w IS NOT NULL AND t IS NOT NULL), '') AS block FROM train WHERE query_tokens IS NOT NULL AND ner_tags IS NOT NULL")
def conll_lines(spark, d):
    t = table(spark, d, "train").where("query_tokens is not null and ner_tags is not null")
    return t.select("query_id", files.conll_block(F.col("query_tokens"), F.col("ner_tags")).alias("block"))


@query(f"WITH {TOK}, l AS (SELECT id, string_agg(gold, ' ' ORDER BY p) AS gold, string_agg(pred, ' ' ORDER BY p) AS pred FROM tok GROUP BY id) SELECT id AS query_id, 'changed' AS model, gold AS gold_tags, pred AS pred_tags FROM l UNION ALL SELECT id, 'none', gold, '' FROM l")
def predictions_long(spark, d):
    """One row per query and model; a model without a prediction has an empty one."""
    p = pairs(spark, d)
    got = p.select("query_id", F.lit("changed").alias("model"), F.col("pred_tags").alias("tags"))
    long = files.predictions(p.drop("pred_tags"), got, ["changed", "none"])
    return long.select("query_id", "model", F.array_join("gold_tags", " ").alias("gold_tags"), F.array_join("pred_tags", " ").alias("pred_tags"))


@query(f"WITH {TOK}, t AS (SELECT *, CASE lower(token) WHEN 'steel' THEN 'B-MATERIAL' WHEN 'white' THEN 'B-COLOR' ELSE 'O' END AS rule FROM tok) SELECT id AS query_id, string_agg(rule, ' ' ORDER BY p) AS tags FROM t GROUP BY id")
def predictor_udf(spark, d):
    """A registered predictor over token arrays; here a dictionary tagger."""
    p = pairs(spark, d).select("query_id", "tokens")
    tagger = predict.dictionary({"steel": "MATERIAL", "white": "COLOR"})
    return predict.apply(p, tagger, "tokens", "tags").select("query_id", F.array_join("tags", " ").alias("tags"))


@query(f"WITH {TOK} SELECT avg((CASE WHEN gold = 'O' THEN 'O' ELSE substr(gold, 1, 1) END <> CASE WHEN pred = 'O' THEN 'O' ELSE substr(pred, 1, 1) END)::INT) AS mismatch FROM tok")
def coarse_consistency(spark, d):
    return predict.consistency(pairs(spark, d), "gold_tags", "pred_tags")
