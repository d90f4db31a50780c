"""Queries that write a table in a format and read it back, so that a sink and its source are held against the table itself.
The files lie in the shared folder of the session and go when Python ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone import schema
from quernstone.functions import text
from quernstone.operators import ingest as I  # noqa: E741
from quernstone.operators import metrics as M
from quernstone.plans.base import query
from quernstone.plans.tag_queries import TOK, pairs
from quernstone.session import scratch_path, table
from quernstone.sources import files

_WORDS = "string_agg(token, ' ' ORDER BY p) AS tokens, string_agg(gold, ' ' ORDER BY p) AS tags"
_CLEAN = "trim(regexp_replace(replace(replace(token, chr(9), ' '), chr(10), ' '), '\\s+', ' ', 'g'))"


def _plain(spark, d):
    """Sequences whose tokens hold no white space, as the line formats ask for."""
    return pairs(spark, d).withColumn("tokens", F.transform("tokens", lambda x: F.when(text.squeeze(x) == "", "_").otherwise(F.regexp_replace(text.squeeze(x), " ", "_"))))


_PLAIN = f"WITH {TOK}, pt AS (SELECT id, p, CASE WHEN {_CLEAN} = '' THEN '_' ELSE replace({_CLEAN}, ' ', '_') END AS token, gold, pred FROM tok)"


@query(_PLAIN + f" SELECT tokens, tags, count(*) AS n FROM (SELECT {_WORDS} FROM pt GROUP BY id) GROUP BY ALL")
def conll_files(spark, d):
    path = scratch_path(spark, "conll")
    files.write_conll(_plain(spark, d), path, "query_id", "tokens", "gold_tags")
    back = files.read_conll(spark, path)
    return back.groupBy(F.array_join("query_tokens", " ").alias("tokens"), F.array_join("ner_tags", " ").alias("tags")).agg(F.count("*").alias("n"))


@query(_PLAIN + " SELECT id AS query_idx, string_agg(token, ' ' ORDER BY p) AS tokens, string_agg(pred, ' ' ORDER BY p) AS silver FROM pt GROUP BY id")
def review_files(spark, d):
    path = scratch_path(spark, "review")
    files.write_review(_plain(spark, d), path, "query_id", tokens="tokens", tags="pred_tags")
    rows = files.read_review(spark, path)
    lists = rows.groupBy("query_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "silver_tag"))).alias("l"))
    return lists.select("query_idx", F.array_join("l.token", " ").alias("tokens"), F.array_join("l.silver_tag", " ").alias("silver"))


@query(f"WITH {TOK}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS query_index FROM len) SELECT m AS model, query_index, string_agg(CASE m WHEN 'gold' THEN gold ELSE pred END, ' ' ORDER BY p) AS tags FROM tok JOIN o USING (id), (VALUES ('gold'), ('changed')) t(m) GROUP BY ALL")
def prediction_files(spark, d):
    path = scratch_path(spark, "predictions")
    p = M.ranked(pairs(spark, d).select("query_id", "gold_tags", "pred_tags"), [F.col("query_id")]).withColumn("query_index", F.col("rank") - 1)
    long = p.select(F.lit("gold").alias("model"), "query_index", F.col("gold_tags").alias("tags")).unionByName(p.select(F.lit("changed").alias("model"), "query_index", F.col("pred_tags").alias("tags")))
    files.write_predictions(long, path)
    return files.read_predictions(spark, path).select("model", F.col("query_index").cast("long").alias("query_index"), F.array_join("tags", " ").alias("tags"))


@query(f"WITH {TOK} SELECT id::VARCHAR AS query_id, string_agg(gold, ' ' ORDER BY p) AS gold_tags, string_agg(pred, ' ' ORDER BY p) AS pred_tags FROM tok GROUP BY id")
def jsonl_files(spark, d):
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(pairs(spark, d), path)
    back = spark.read.schema("query_id string, gold_tags array<string>, pred_tags array<string>").json(path)
    return back.select("query_id", F.array_join("gold_tags", " ").alias("gold_tags"), F.array_join("pred_tags", " ").alias("pred_tags"))


@query("SELECT query_id, query, array_to_string(query_tokens, ' ') AS tokens, num_tokens FROM train")
def parquet_files(spark, d):
    path = scratch_path(spark, "parquet")
    files.write_table(table(spark, d, "train").select("query_id", "query", "query_tokens", "num_tokens", F.pmod("query_id", F.lit(4)).alias("part")), path, ["part"])
    return spark.read.parquet(path).select("query_id", "query", F.array_join("query_tokens", " ").alias("tokens"), "num_tokens")


@query("SELECT c_mktsegment AS model, count(*)::INT AS customers, min(c_custkey)::INT AS first_key FROM customer GROUP BY 1")
def csv_files(spark, d):
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(F.count("*").alias("customers"), F.min("c_custkey").alias("first_key")), path, "model")
    return files.read_sources(spark, path)


@query("SELECT regexp_replace(product_title, '[\\r\\n]+', ' ', 'g') AS text, count(*) AS n FROM (SELECT * FROM shopping_queries_dataset_products WHERE product_title IS NOT NULL ORDER BY product_id, product_locale, product_title LIMIT 500) GROUP BY 1")
def corpus_files(spark, d):
    path = scratch_path(spark, "corpus")
    files.write_corpus(table(spark, d, "shopping_queries_dataset_products"), path, "product_title", ["product_id", "product_locale", "product_title"], 500)
    return files.read_corpus(spark, path).groupBy("text").agg(F.count("*").alias("n"))


_SEG = "SELECT c_mktsegment AS model, round(avg(c_acctbal) / 10000, 4)::DOUBLE AS precision, round(min(c_acctbal) / -1000, 4)::DOUBLE AS recall, round(max(c_acctbal) / 10000, 4)::DOUBLE AS f1 FROM customer GROUP BY 1"


def _segments(spark, d):
    c = F.col("c_acctbal").cast("double")
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(F.round(F.avg(c) / 10000, 4).alias("precision"), F.round(F.min(c) / -1000, 4).alias("recall"), F.round(F.max(c) / 10000, 4).alias("f1"))


NAMES = {"precision": "Precision", "recall": "Recall", "f1": "F1"}


@query(f"WITH s AS ({_SEG}), l AS (SELECT -1 AS line, rpad('Model', 30, ' ') || '  Precision     Recall         F1' AS value UNION ALL SELECT 0, repeat('-', 63) UNION ALL SELECT row_number() OVER (ORDER BY model), rpad(model, 30, ' ') || printf(' %10.4f %10.4f %10.4f', precision, recall, f1) FROM s) SELECT line::BIGINT AS line, value FROM l")
def fixed_width_lines(spark, d):
    return files.fixed_width(_segments(spark, d), "model", NAMES)


@query(_SEG)
def fixed_width_files(spark, d):
    path = scratch_path(spark, "table")
    files.write_fixed_width(_segments(spark, d), path, "model", NAMES)
    return files.read_fixed_width(spark, path, list(NAMES))


_RUNS = "(SELECT o_orderstatus AS model, (ascii(o_orderpriority) - 48)::INT AS seed, round(avg(o_totalprice) / 1000000, 6)::DOUBLE AS f1 FROM orders GROUP BY ALL)"


def _runs(spark, d):
    seed = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("model"), seed.alias("seed")).agg(F.round(F.avg("o_totalprice") / 1000000, 6).alias("f1"))


def _metric_files(spark, rows, folder):
    """A JSON file of figures a folder, as trainers leave them."""
    path = scratch_path(spark, "metrics")
    for r in rows.select(folder.alias("folder"), F.to_json(F.struct("f1")).alias("value")).collect():  # a row a run
        spark.createDataFrame([(r.value,)], "value string").coalesce(1).write.text(f"{path}/{r.folder}")
    return f"{path}/*"


@query(f"SELECT * FROM {_RUNS}")
def seed_metric_files(spark, d):
    path = _metric_files(spark, _runs(spark, d), F.concat("model", F.lit("_seed"), "seed"))
    return files.read_seed_metrics(spark, path).select("model", "seed", "f1")


_SIZES = {1: "1k", 2: "2.5k", 3: "5k", 4: "full", 5: "other"}


@query(f"SELECT model, CASE seed WHEN 1 THEN '1k' WHEN 2 THEN '2.5k' WHEN 3 THEN '5k' ELSE 'full' END AS size, CASE seed WHEN 1 THEN 1000 WHEN 2 THEN 2500 WHEN 3 THEN 5000 ELSE 52500 END::INT AS size_value, f1 FROM {_RUNS} WHERE seed <= 4")
def size_metric_files(spark, d):
    """Folders of known sizes are read, the one of another size is not."""
    size = F.coalesce(*[F.when(F.col("seed") == k, v) for k, v in _SIZES.items()])
    path = _metric_files(spark, _runs(spark, d), F.concat("model", F.lit("_"), size))
    return files.read_size_metrics(spark, path, M.SIZES).select("model", "size", F.col("size_value").cast("int").alias("size_value"), "f1")


@query(f"SELECT model, printf('%.4f', max(f1) FILTER (seed = 1)) AS \"1k\", printf('%.4f', max(f1) FILTER (seed = 2)) AS \"2.5k\", printf('%.4f', max(f1) FILTER (seed = 3)) AS \"5k\", printf('%.4f', max(f1) FILTER (seed = 4)) AS \"full\" FROM {_RUNS} GROUP BY 1")
def learning_curve(spark, d):
    curve = M.learning_curve(size_metric_files(spark, d))
    return M.formatted(curve, dict.fromkeys(M.SIZES, M.FOUR))


_LOGS = "('a', 'Training of bert completed in 34 seconds'), ('b', 'x\nTotal training time: 12.5 s'), ('c', '{''train_runtime'': 99.25}'), ('d', 'took 7 seconds in total'), ('e', 'TRAINING COMPLETED IN 5 SECONDS; Total training time: 9 s'), ('f', 'no time')"


@query(f"SELECT model, coalesce(nullif(regexp_extract(log, '(?i)Training.*completed in (\\d+\\.?\\d*)\\s*seconds', 1), ''), nullif(regexp_extract(log, '(?i)Total training time:\\s*(\\d+\\.?\\d*)\\s*s', 1), ''), nullif(regexp_extract(log, '(?i)train_runtime[''\"]?\\s*[:=]\\s*(\\d+\\.?\\d*)', 1), ''), nullif(regexp_extract(log, '(?i)(\\d+\\.?\\d*)\\s*seconds.*total', 1), ''))::DOUBLE AS seconds FROM (VALUES {_LOGS}) t(model, log)")
def log_times(spark, d):
    """Training times as logs state them."""
    rows = [("a", "Training of bert completed in 34 seconds"), ("b", "x\nTotal training time: 12.5 s"), ("c", "{'train_runtime': 99.25}"), ("d", "took 7 seconds in total"), ("e", "TRAINING COMPLETED IN 5 SECONDS; Total training time: 9 s"), ("f", "no time")]
    return spark.createDataFrame(rows, "model string, log string").select("model", files.training_time(F.col("log")).alias("seconds"))


@query("SELECT DISTINCT query_id, source FROM shopping_queries_dataset_sources WHERE source IS NOT NULL AND query_id IS NOT NULL AND NOT contains(source, '\"')")
def csv_sources(spark, d):
    path = scratch_path(spark, "sources")
    rows = table(spark, d, "shopping_queries_dataset_sources").where("source is not null and query_id is not null and not contains(source, '\"')")
    rows.write.option("quoteAll", True).csv(path, header=True)
    return files.read_sources(spark, path).select(F.col("query_id").cast("long").alias("query_id"), "source").distinct()


@query("SELECT count(*) AS rows FROM val")
def resolved_path(spark, d):
    """A table found in the flat layout of a folder."""
    return spark.read.parquet(I.resolve(d, "val.parquet")).agg(F.count("*").alias("rows"))


_IDS = "CASE tag " + " ".join(f"WHEN '{t}' THEN {i}" for t, i in schema.LABEL_IDS.items()) + " ELSE 0 END"


@query(f"WITH t AS (SELECT DISTINCT unnest(ner_tags) AS tag FROM train), e AS (SELECT tag, {_IDS} AS id FROM t) SELECT tag, id::INT AS id, CASE WHEN id = 0 THEN 'O' ELSE tag END AS back FROM e")
def label_ids(spark, d):
    t = table(spark, d, "train").select(F.explode("ner_tags").alias("tag")).distinct().withColumn("id", schema.encode_label(F.col("tag")))
    return t.withColumn("back", schema.decode_label(F.col("id")))
