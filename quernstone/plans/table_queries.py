"""Queries over result tables, bundles of analyses, data summaries and the predictor boundary."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import annotate as A
from quernstone.operators import errors as E
from quernstone.operators import extrinsic as X
from quernstone.operators import metrics as M
from quernstone.operators import predict
from quernstone.operators import retrieval as R
from quernstone.operators import spans as S
from quernstone.plans.base import SQL, query
from quernstone.plans.report_queries import _ATT, _MEANS, _METRICS, _RET, TOP, _attributes, _retrieval
from quernstone.plans.tag_queries import PRF, TOK, counted, counts_sql, pairs
from quernstone.session import scratch_path, spread, table

MODELS = ["m0", "m1", "m2", "m3"]
_MODEL = ", grp AS (SELECT id, 'm' || (id % 4) AS g FROM len)"


def _by_model(spark, d):
    return pairs(spark, d).withColumn("model", F.concat(F.lit("m"), (F.col("query_id") % 4).cast("string")))


_PER_TYPE = counts_sql("strict", "grp.g", _MODEL) + f"SELECT grp AS model, entity_type, gn AS support, {PRF} FROM c"


def _per_type(spark, d):
    return M.span_prf(_by_model(spark, d), ["model"], S.STRICT)


def _overall(spark, d):
    return _per_type(spark, d).where("entity_type = 'ALL'").select("model", "precision", "recall", "f1")


# whole-query figures of each model
_QUERIES = f"(WITH {TOK}, q AS (SELECT id, bool_and(gold = pred) AS ok, avg((gold = pred)::INT) AS a, sum((gold = pred AND gold <> 'O')::INT) AS hit, sum((gold <> 'O')::INT) AS entity FROM tok GROUP BY id) SELECT 'm' || (id % 4) AS model, avg(ok::INT) AS exact_match, 100.0 * sum(hit) / sum(entity) AS coverage, avg(a) AS slot_f1 FROM q WHERE id % 4 <> 3 GROUP BY 1)"


def _whole(spark, d):
    rows = E.token_rows(_by_model(spark, d), "model").where("model <> 'm3'")
    same, some = F.col("gold") == F.col("pred"), F.col("gold") != "O"
    each = rows.groupBy("model", "query_id").agg(F.min(same.cast("int")).alias("ok"), F.avg(same.cast("int")).alias("a"), F.count_if(same & some).alias("hit"), F.count_if(some).alias("some"))
    return each.groupBy("model").agg(F.avg("ok").alias("exact_match"), (F.lit(100.0) * F.sum("hit") / F.sum("some")).alias("coverage"), F.avg("a").alias("slot_f1"))


_FORM = lambda c, f="%.4f": f"printf('{f}', {c}) AS {c}"


@query(f"WITH o AS (SELECT * FROM ({_PER_TYPE}) WHERE entity_type = 'ALL'), r AS (SELECT row_number() OVER (ORDER BY o.f1 DESC, o.model) AS rank, o.model, precision, recall, f1, exact_match, coverage, slot_f1 FROM o LEFT JOIN {_QUERIES} q ON q.model = o.model) SELECT rank, model, {_FORM('precision')}, {_FORM('recall')}, {_FORM('f1')}, {_FORM('exact_match')}, {_FORM('coverage', '%.1f%%')}, {_FORM('slot_f1')} FROM r")
def model_comparison(spark, d):
    """Models by F1; the one without whole-query figures has none."""
    return M.comparison_table(_overall(spark, d), _whole(spark, d))


@query(f"SELECT entity_type, {', '.join(f'''printf('%.2f', coalesce(max(f1) FILTER (model = '{m}'), 0)) AS {m}''' for m in MODELS)} FROM ({_PER_TYPE}) WHERE entity_type <> 'ALL' GROUP BY 1")
def entity_summary(spark, d):
    return M.entity_summary(_per_type(spark, d), MODELS)


# recorded figures of four models: spans, retrieval and efficiency
RECORDED = {"bert_ner": (0.5544, 0.4718, 0.5098), "bilstm_crf": (0.6091, 0.3530, 0.4469), "cnn_bilstm": (0.6630, 0.2922, 0.4056), "roberta_ner": (0.5080, 0.4749, 0.4909), "other": (0.1, 0.2, 0.13)}
RETRIEVED = {"bert_ner_rerank": (0.4795, 0.4404), "bilstm_crf_rerank": (0.4822, 0.4435), "cnn_bilstm_rerank": (0.4818, 0.4408), "roberta_ner_rerank": (0.4851, 0.4459), "baseline": (0.4882, 0.4494)}
EFFICIENT = {"bert_ner": (108.90, 32.80), "bilstm_crf": (5.06, 4.21), "cnn_bilstm": (4.98, 3.91), "roberta_ner": (124.07, 33.67)}


def _values(rows: dict, names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in v)})" for k, v in rows.items()) + f") t({names}))"


def _frame(spark, rows: dict, names: str):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], ", ".join(f"{n} {'string' if not i else 'double'}" for i, n in enumerate(names.split(", "))))


@query(f"WITH o AS {_values(RECORDED, 'model, precision, recall, f1')}, r AS {_values(RETRIEVED, 'model, ndcg, mrr')}, e AS {_values(EFFICIENT, 'model, params_m, latency_ms')} SELECT row_number() OVER (ORDER BY f1 DESC, o.model) AS rank, o.model, {_FORM('precision')}, {_FORM('recall')}, {_FORM('f1')}, coalesce(printf('%.4f', ndcg), '-') AS ndcg, coalesce(printf('%.4f', mrr), '-') AS mrr, coalesce(printf('%.2f', params_m), '-') AS params_m, coalesce(printf('%.2f', latency_ms), '-') AS latency_ms FROM o LEFT JOIN r ON regexp_replace(r.model, '_rerank$', '') = o.model LEFT JOIN e ON e.model = o.model")
def final_comparison(spark, d):
    """The recorded figures of four models in one table, and a model that is in one of the tables only."""
    return M.final_table(_frame(spark, RECORDED, "model, precision, recall, f1"), _frame(spark, RETRIEVED, "model, ndcg, mrr"), _frame(spark, EFFICIENT, "model, params_m, latency_ms"))


_PAIRED = {"m0": "gold_m0", "m1": "gold_m1", "m9": "gold_m9"}


@query(f"WITH o AS (SELECT * FROM ({_PER_TYPE}) WHERE entity_type = 'ALL'), k AS (SELECT * FROM (VALUES {', '.join(f'''('{a}', '{b}')''' for a, b in _PAIRED.items())}) t(model, gold_model)), g AS (SELECT 'gold_' || model AS model, recall AS precision, f1 FROM o) SELECT k.model, printf('%.4f', coalesce(g.precision, 0)) AS gold_precision, printf('%.4f', coalesce(g.f1, 0)) AS gold_f1, printf('%.4f', coalesce(o.precision, 0)) AS silver_precision, printf('%.4f', coalesce(o.f1, 0)) AS silver_f1 FROM k LEFT JOIN g ON g.model = k.gold_model LEFT JOIN o ON o.model = k.model")
def gold_against_silver(spark, d):
    o = _overall(spark, d)
    gold = o.select(F.concat(F.lit("gold_"), "model").alias("model"), F.col("recall").alias("precision"), "f1")
    return M.trained_on(gold, o, _PAIRED)


@query(f"SELECT model, f1 FROM ({_PER_TYPE}) WHERE entity_type = 'ALL' ORDER BY f1 DESC, model LIMIT 1")
def best_model(spark, d):
    return M.best_model(_overall(spark, d))


@query(f"SELECT row_number() OVER (ORDER BY f1 DESC, model) AS rank, model, CASE row_number() OVER (ORDER BY f1 DESC, model) WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE (row_number() OVER (ORDER BY f1 DESC, model))::VARCHAR END AS place, true AS is_final FROM ({_PER_TYPE}) WHERE entity_type = 'ALL'")
def medals(spark, d):
    """Ranks with medals, flagged as final, the known columns first."""
    rows = M.ranked(_overall(spark, d), [F.desc("f1"), F.col("model")]).withColumn("place", M.medal(F.col("rank"))).withColumn("is_final", F.lit(True))
    return M.arranged(rows.drop("precision", "recall", "f1"), ["rank", "model", "place", "unknown"])


@query(f"SELECT model, 'precision' AS metric, precision AS value FROM ({_PER_TYPE}) WHERE entity_type = 'ALL' UNION ALL SELECT model, 'recall', recall FROM ({_PER_TYPE}) WHERE entity_type = 'ALL' UNION ALL SELECT model, 'f1', f1 FROM ({_PER_TYPE}) WHERE entity_type = 'ALL'")
def metrics_unpivot(spark, d):
    return M.unpivot_metrics(_overall(spark, d), ["model"], ["precision", "recall", "f1"])


@query("WITH r AS (SELECT event_type AS model, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS run FROM events WHERE event_type <> 'error'), l AS (SELECT model, avg(value) AS a, stddev_pop(value) AS s FROM r WHERE run >= 10 GROUP BY 1), m AS (SELECT event_type AS model, count(*) AS total, count(*) // 2 AS trainable FROM events GROUP BY 1) SELECT m.model, total AS total_params, total / 1000000 AS total_params_millions, trainable AS trainable_params, trainable / 1000000 AS trainable_params_millions, CASE WHEN m.model = 'view' THEN 34.0::DOUBLE ELSE -1 END AS training_time_seconds, CASE WHEN m.model = 'view' THEN 34.0::DOUBLE / 60 ELSE -1 END AS training_time_minutes, coalesce(a, -1) AS avg_latency_ms, coalesce(s, -1) AS std_latency_ms, coalesce(1000 / a, -1) AS throughput_queries_per_sec FROM m LEFT JOIN l USING (model)")
def efficiency_table(spark, d):
    """Parameters, latency and training time of models; -1 for what is not known."""
    from pyspark.sql import Window

    ev = table(spark, d, "events")
    runs = ev.where("event_type <> 'error'").select(F.col("event_type").alias("model"), F.col("value").alias("latency_ms"), (F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1).alias("run"))
    log = F.when(F.col("model") == "view", "Training of it completed in 34 seconds").otherwise("nothing said")
    models = ev.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("total_params")).withColumn("trainable_params", F.floor(F.col("total_params") / 2)).withColumn("log", log)
    return M.efficiency(runs, models)


# the bundle of analyses, each held against its own query's SQL
_SECTIONS = {
    "confusion_matrix": ("tag_confusion_norm", "gold pred", "n value"), "common_errors": ("common_errors_topn", "kind token gold pred", "n rank"), "by_query_length": ("prf_by_length_bin", "bin", "queries gold_spans pred_spans matched precision recall f1"),
    "by_entity_rarity": ("rarity_split", "entity_type class", "n"), "fp_fn_by_entity": ("fp_fn_by_type", "entity_type", "tp fp fn"), "multi_attribute_analysis": ("multi_attribute_split", "grp", "queries gold_spans pred_spans matched precision recall f1"),
    "color_ambiguity": ("color_ambiguity", "", "tp fp fn precision recall f1"), "color_lists": ("color_lists", "list token tag", "n rank"),
}


def _report_sql() -> str:
    parts = []
    for section, (name, keys, values) in _SECTIONS.items():
        key = f"concat_ws('|', {', '.join(keys.split())})" if keys else "''"
        parts += [f"SELECT '{section}' AS section, {key} AS name, '{v}' AS metric, {v}::DOUBLE AS value FROM ({SQL[name]})" for v in values.split()]
    return " UNION ALL ".join(parts)


@query(_report_sql())
def error_report(spark, d):
    return E.tall(E.error_report(pairs(spark, d)))


_B = "list_filter(coalesce(ner_tags, []), lambda t: t LIKE 'B-%')"


@query("SELECT count(*) FILTER (t = 'O') AS outside, count(*) FILTER (t <> 'O') AS entity, count(*) FILTER (t = 'O') / count(*) FILTER (t <> 'O') AS imbalance FROM (SELECT unnest(ner_tags) AS t FROM train)")
def class_imbalance(spark, d):
    return X.imbalance(table(spark, d, "train"), "ner_tags")


@query(f"SELECT avg(len({_B})) AS mean, quantile_cont(len({_B}), 0.5)::DOUBLE AS median, max(len({_B}))::INT AS max, count(*) FILTER (len({_B}) = 0) AS without, max(len(list_distinct(list_transform({_B}, lambda t: substr(t, 3)))))::INT AS most_types FROM train")
def entities_per_query(spark, d):
    return X.entities_per_query(table(spark, d, "train"), "ner_tags")


@query(f"SELECT query_id, len(list_distinct(list_transform({_B}, lambda t: substr(t, 3))))::INT AS types FROM train")
def distinct_types(spark, d):
    return table(spark, d, "train").select("query_id", X.distinct_types(F.col("ner_tags")).alias("types"))


@query("SELECT count(*) AS rows, count(query) - count(DISTINCT query) AS duplicates, count(*) FILTER (coalesce(len(query_tokens), 0) <> coalesce(len(ner_tags), 0)) AS misaligned FROM train")
def data_quality(spark, d):
    return X.data_quality(table(spark, d, "train"), "query", "query_tokens", "ner_tags")


_ALL = "(SELECT 'train' AS split, query_tokens, ner_tags FROM train UNION ALL SELECT 'val', query_tokens, ner_tags FROM val UNION ALL SELECT 'test', query_tokens, ner_tags FROM test)"


@query(f"SELECT count(*) AS total_samples, count(*) FILTER (split = 'train') AS train_samples, count(*) FILTER (split = 'val') AS val_samples, count(*) FILTER (split = 'test') AS test_samples, avg(coalesce(len(query_tokens), 0)) AS avg_tokens_per_query, avg(len({_B})) AS avg_entities_per_query, (SELECT string_agg(k || ':' || n, '|' ORDER BY k) FROM (SELECT substr(t, 3) AS k, count(*) AS n FROM (SELECT unnest(ner_tags) AS t FROM {_ALL}) WHERE t LIKE 'B-%' GROUP BY 1)) AS entity_span_counts FROM {_ALL}")
def dataset_summary(spark, d):
    s = X.dataset_summary({t: table(spark, d, t) for t in ("train", "val", "test")}, "query_tokens", "ner_tags")
    return s.withColumn("entity_span_counts", counted(F.col("entity_span_counts")))


@query("SELECT avg(num_tokens) AS mean, quantile_cont(num_tokens, 0.5)::DOUBLE AS median, max(num_tokens) AS max, count(*) FILTER (num_tokens = 0) AS zeros FROM train")
def length_spread(spark, d):
    return M.spread(table(spark, d, "train"), "num_tokens")


@query("SELECT count(DISTINCT _stratum) AS unique FROM train")
def unique_strata(spark, d):
    return M.unique_count(table(spark, d, "train"), "_stratum")


@query("SELECT _stratum, count(num_tokens) AS n, list_sort(list(num_tokens) FILTER (num_tokens IS NOT NULL))[count(num_tokens) // 2 + 1] AS upper_median FROM train WHERE _stratum IS NOT NULL GROUP BY 1")
def upper_medians(spark, d):
    t = table(spark, d, "train").where("_stratum is not null")
    return M.upper_median(t, "num_tokens", ["_stratum"]).join(t.groupBy("_stratum").agg(F.count("num_tokens").alias("n")), "_stratum")


@query(f"WITH {TOK}, c AS (SELECT id, p, unnest(string_split(token, '')) AS c, generate_subscripts(string_split(token, ''), 1) AS i FROM tok WHERE token <> ''), u AS (SELECT c AS token, min({{'id': id, 'p': p, 'i': i}}) AS seen FROM c GROUP BY 1) SELECT token, row_number() OVER (ORDER BY seen) + 1 AS id FROM u UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1")
def character_ids(spark, d):
    return X.characters(pairs(spark, d).select("query_id", "tokens"), "tokens", ["query_id"])


def _squeezed(c: str) -> str:
    for k, v in text.TYPOGRAPHIC.items():
        c = f"replace({c}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query(f"SELECT query_id, array_to_string(list_transform(product_title, lambda x: {_squeezed('x')}), '|') AS titles, {_squeezed('query_clean')} AS query FROM train WHERE regexp_matches(coalesce(array_to_string(product_title, ''), '') || coalesce(query_clean, ''), '^[\\x00-\\x7F‘’“”–—…×®™]*$')")
def metadata_clean(spark, d):
    """Product titles and queries in plain characters and single spaces, for rows that decomposition leaves as they are."""
    t = table(spark, d, "train").select("query_id", "product_title", "query_clean", F.coalesce(F.array_join("product_title", ""), F.lit("")).alias("_a"))
    t = t.where(F.concat("_a", F.coalesce("query_clean", F.lit(""))).rlike("^[\\x00-\\x7F‘’“”–—…×®™]*$"))
    return text.clean_metadata(t, ["product_title", "query_clean", "absent"]).select("query_id", F.array_join("product_title", "|").alias("titles"), F.col("query_clean").alias("query"))


@query(
    f"WITH {TOK}, f AS (SELECT *, sum(CASE WHEN gold LIKE 'I-%' THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY p) AS g FROM tok), "
    "h AS (SELECT id, g, min(p) AS p, min_by(gold, p) AS head, string_agg(token, ' ' ORDER BY p) AS txt, min_by(token, p) AS one FROM f GROUP BY id, g), "
    "x AS (SELECT id, p, CASE WHEN head LIKE 'B-%' THEN '[' || txt || '](' || substr(head, 3) || ')' WHEN head = 'O' THEN one END AS part FROM h) SELECT id AS query_id, coalesce(string_agg(part, ' ' ORDER BY p), '') AS markup FROM x GROUP BY id"
)
def query_markup(spark, d):
    """Queries with their entities marked; an I- tag after O vanishes, others join the open entity whatever its type."""
    p = pairs(spark, d)
    return p.select("query_id", text.markup_tags(F.col("tokens"), F.col("gold_tags")).alias("markup"))


@query(f"SELECT * REPLACE (round(precision::DOUBLE, 6) + 0.0 AS precision, round(recall::DOUBLE, 6) + 0.0 AS recall, round(f1::DOUBLE, 6) + 0.0 AS f1) FROM (" + counts_sql("strict").replace("tok AS (SELECT *, CASE WHEN id % 3", "tok AS (SELECT *, CASE WHEN lower(token) = 'steel' THEN 'B-MATERIAL' WHEN lower(token) = 'white' THEN 'B-COLOR' ELSE 'O' END AS pred FROM tok0), unused AS (SELECT *, CASE WHEN id % 3") + f"SELECT entity_type, gn::BIGINT AS gold_spans, pn::BIGINT AS pred_spans, m::BIGINT AS matched, {PRF} FROM c)")
def predict_and_score(spark, d):
    """A dictionary tagger applied and scored."""
    scored = predict.evaluate(pairs(spark, d), predict.dictionary({"steel": "MATERIAL", "white": "COLOR"}))
    return scored.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("precision", "recall", "f1")})


@query(f"WITH {TOK}, f AS (SELECT id, min(p) FILTER (token = 'steel') AS a, min(p) FILTER (token = 'set') AS b FROM tok GROUP BY id) SELECT id AS query_id, string_agg(CASE WHEN p = b THEN 'B-BRAND' WHEN p = a THEN 'B-SIZE_MEASURE' ELSE 'O' END, ' ' ORDER BY p) AS tags FROM tok JOIN f USING (id) GROUP BY id")
def external_tagger(spark, d):
    """Entities of a general recogniser on their first equal window; labels that stand for nothing here are left out."""

    def recognise(sentence: str) -> list[tuple[str, str]]:
        return [("steel", "QUANTITY"), ("set", "ORG"), ("white", "DATE")]

    return predict.apply(pairs(spark, d).select("query_id", "tokens"), predict.external(recognise), "tokens", "tags").select("query_id", F.array_join("tags", " ").alias("tags"))


@query(f"WITH {TOK}, c AS (SELECT id, p, gold, unnest(range(0, greatest(1, (length(token) + 3) // 4))) AS i FROM tok) SELECT id AS query_id, string_agg(CASE WHEN i = 0 THEN gold ELSE '-100' END, ' ' ORDER BY p, i) AS first_only, string_agg(gold, ' ' ORDER BY p, i) AS every FROM c GROUP BY id")
def piece_labels(spark, d):
    """Word labels on pieces of four letters."""
    ids = F.flatten(F.transform("tokens", lambda w, i: F.array_repeat(i, F.greatest(F.lit(1), F.ceil(F.length(w) / 4).cast("int")))))
    p = pairs(spark, d).withColumn("words", ids)
    some = lambda every: F.array_join(predict.align_pieces(F.col("words"), F.col("gold_tags"), every), " ")
    return p.select("query_id", some(False).alias("first_only"), some(True).alias("every"))


_ALL_DOCS = "docs AS (SELECT product_id AS doc_id, product_brand AS brand, product_color AS color, product_category AS product_type FROM shopping_queries_dataset_products)"


@query(f"WITH {_ALL_DOCS} SELECT DISTINCT * FROM (SELECT doc_id, 'BRAND' AS entity_type, lower(trim(brand)) AS value FROM docs WHERE brand <> '' UNION ALL SELECT doc_id, 'COLOR', lower(trim(color)) FROM docs WHERE color <> '' UNION ALL SELECT doc_id, 'PRODUCT_TYPE', lower(trim(product_type)) FROM docs WHERE product_type <> '')")
def attribute_index(spark, d):
    p = table(spark, d, "shopping_queries_dataset_products")
    docs = p.select(F.col("product_id").alias("doc_id"), F.col("product_brand").alias("brand"), F.col("product_color").alias("color"), F.col("product_category").alias("product_type"))
    return R.attribute_index(docs, ["brand", "color", "product_type"])


_BOOSTED = "b AS (SELECT query_id, doc_id, product(CASE entity_type WHEN 'BRAND' THEN 2.0 WHEN 'PRODUCT_TYPE' THEN 1.5 WHEN 'COLOR' THEN 1.2 WHEN 'MATERIAL' THEN 1.2 ELSE 1.0 END) AS boost FROM mt GROUP BY ALL), z AS (SELECT query_id, doc_id, round(score * coalesce(boost, 1), 9) AS score FROM r40 LEFT JOIN b USING (query_id, doc_id)), zr AS (SELECT 'rerank' AS combo, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM z UNION ALL SELECT 'baseline', query_id, doc_id, score, rank FROM r40)"


@query(
    f"WITH {_RET}, {_ATT}, {_BOOSTED}, " + _METRICS.format(by="combo,", ranked="zr").replace("SELECT combo, q.query_id", "SELECT q.combo, q.query_id")
    + f", gq AS (SELECT combo, query_id FROM (VALUES ('baseline'), ('rerank')) t(combo), val) SELECT combo AS system, {_MEANS} FROM gq LEFT JOIN e USING (combo, query_id) LEFT JOIN nr USING (query_id) GROUP BY combo"
)
def retrieval_comparison(spark, d):
    """The ranking as it is against the one that attributes rerank."""
    docs, queries, ranked, relevant = _retrieval(spark, d, 2 * TOP)
    q, doc = _attributes(spark, d, docs)
    return R.evaluate_retrieval(ranked, q, doc, relevant, queries)


@query(f"SELECT * FROM ({SQL['weight_grid_search']}) ORDER BY ndcg DESC, combo LIMIT 1")
def best_weights(spark, d):
    from quernstone.plans.report_queries import weight_grid_search

    return R.best_weights(weight_grid_search(spark, d))


# candidate phrases of each type by SQL, their best windows, and the greedy reading of these by priority
_N = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_LCS = "list_reduce(string_split(a, ''), lambda acc, x: list_reduce(range(1, length(b) + 1), lambda r, j: list_append(r, CASE WHEN string_split(b, '')[j] = x THEN acc[j] + 1 ELSE greatest(acc[j + 1], r[j]) END), [0::BIGINT]), list_resize([0::BIGINT], length(b) + 1, 0::BIGINT))[-1]"


def _words_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def annotate_sql(source: str = "train") -> str:
    text_of = _N.format("array_to_string(list_concat(coalesce(product_title, []), coalesce(product_bullet_point, [])), ' ')")
    titles = _N.format("coalesce(array_to_string(product_title, ' '), '')")
    sizes = " UNION ALL ".join(f"SELECT id, 5 AS pr, unnest(regexp_extract_all({titles}, '{p}', 0)) AS phrase FROM t" for p in A.SIZES)
    return (
        f"WITH t AS (SELECT query_id AS id, * FROM {source} WHERE query_tokens IS NOT NULL), ti AS (SELECT id, string_split({_N.format('x')}, ' ') AS w FROM (SELECT id, unnest(product_title) AS x FROM t) WHERE trim(x) <> ''), "
        f"c0 AS (SELECT id, 1 AS pr, unnest(list_filter([CASE WHEN len(w) >= 2 THEN array_to_string(w[-2:], ' ') END, CASE WHEN len(w) >= 3 THEN array_to_string(w[-3:], ' ') END, w[-1]], lambda x: x IS NOT NULL)) AS phrase FROM ti "
        f"UNION ALL SELECT id, 2, {_N.format('x')} FROM (SELECT id, unnest(product_brand) AS x FROM t) UNION ALL SELECT id, 4, {_N.format('x')} FROM (SELECT id, unnest(product_color) AS x FROM t) "
        f"UNION ALL SELECT id, 3, unnest(list_filter({_words_sql(A.MATERIALS)}, lambda k: contains({text_of}, k))) FROM t UNION ALL SELECT id, 6, unnest(list_filter({_words_sql(A.ATTRIBUTES)}, lambda k: contains({text_of}, k))) FROM t UNION ALL {sizes}), "
        f"c AS (SELECT DISTINCT id, pr, {_N.format('phrase')} AS phrase FROM c0 WHERE trim(phrase) <> ''), "
        "q AS (SELECT id, list_transform(query_tokens, lambda x: lower(coalesce(x, ''))) AS toks FROM t), "
        "w AS (SELECT id, pr, phrase, i, m, array_to_string(toks[i + 1:i + m], ' ') AS a, phrase AS b FROM (SELECT *, unnest(range(0, len(toks) - m + 1)) AS i FROM (SELECT c.*, len(string_split(phrase, ' ')) AS m, toks FROM c JOIN q USING (id)) WHERE m <= len(toks))), "
        "v AS (SELECT DISTINCT a, b FROM w WHERE a <> b AND 200.0 * least(length(a), length(b)) / (length(a) + length(b)) >= 85), "
        f"vs AS (SELECT a, b, 200.0 * {_LCS} / (length(a) + length(b)) AS r FROM v), "
        "best AS (SELECT w.id, pr, phrase, m, i FROM w LEFT JOIN vs ON vs.a = w.a AND vs.b = w.b WHERE w.a = w.b OR r >= 85 QUALIFY row_number() OVER (PARTITION BY w.id, pr, phrase ORDER BY CASE WHEN w.a = w.b THEN 1000.0 ELSE r END DESC, i) = 1), "
        "o AS (SELECT id, list({'pr': pr, 'i': i, 'm': m} ORDER BY pr, -m, phrase) AS l FROM best GROUP BY id), "
        f"k AS (SELECT q.id, len(toks) AS n, list_reduce(coalesce(l, []), lambda st, x: CASE WHEN len(list_filter(st[x.i + 1:x.i + x.m], lambda y: y <> 'O')) > 0 THEN st ELSE list_concat(st[1:x.i], list_concat(['B-' || {_words_sql(A.PRIORITY)}[x.pr]], list_concat(list_transform(range(1, x.m), lambda z: 'I-' || {_words_sql(A.PRIORITY)}[x.pr]), st[x.i + x.m + 1:]))) END, list_transform(toks, lambda x: 'O')) AS tags FROM q LEFT JOIN o USING (id)) "
        "SELECT id AS query_id, tags FROM k"
    )


@query(f"SELECT query_id, array_to_string(tags, ' ') AS silver FROM ({annotate_sql()})")
def annotate_priority(spark, d):
    """Weak tags of train from its product metadata."""
    t = spread(table(spark, d, "train").where("query_tokens is not null").select("query_id", "query_tokens", "product_title", "product_brand", "product_color", "product_bullet_point"))
    return A.annotate_table(t, out="silver").select("query_id", F.array_join("silver", " ").alias("silver"))


@query(" UNION ALL ".join(f"SELECT '{s}' AS split, count(*) AS queries, count(*) FILTER (len(list_filter(tags, lambda t: t <> 'O')) > 0) AS with_entity, 100.0 * count(*) FILTER (len(list_filter(tags, lambda t: t <> 'O')) > 0) / (SELECT count(*) FROM {s}) AS percent, (SELECT count(*) FROM {s} WHERE query_tokens IS NOT NULL) AS conll_blocks FROM (SELECT a.tags FROM {s} x LEFT JOIN ({annotate_sql(s)}) a USING (query_id))" for s in ("val", "test")))
def annotate_splits(spark, d):
    """Val and test annotated and written as tables and CoNLL; how many queries got an entity."""
    path, out = scratch_path(spark, "annotated"), None
    for name, df in A.annotate_splits(spark, d, path, ["val", "test"]).items():
        blocks = spark.read.text(f"{path}/{name}.conll").agg(F.count_if(F.col("value") == "").alias("conll_blocks"))
        part = A.annotation_summary(df).crossJoin(blocks).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
