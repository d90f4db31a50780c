"""Queries over tag sequences. Gold tags are those of train; predicted ones are made from them by changing every fifth tag
of two thirds of the queries. Some queries are repeated within a sequence, so that long ones occur, and some colours have
a type of their own, so that types of all frequencies do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators import errors as E
from quernstone.operators import extrinsic as X
from quernstone.operators import metrics as M
from quernstone.operators import spans as S
from quernstone.plans.base import query
from quernstone.session import table

NEXT = {"BRAND": "COLOR", "COLOR": "PRODUCT_TYPE", "PRODUCT_TYPE": "BRAND"}  # what a changed B- tag becomes; other types become BRAND


def pairs(spark, d) -> DataFrame:
    """(query_id, tokens, gold_tags, pred_tags), one row a sequence."""
    t = table(spark, d, "train").where("query_tokens is not null and ner_tags is not null")
    n, times = F.least(F.size("query_tokens"), F.size("ner_tags")), F.when(F.col("query_id") % 40 == 0, 3).when(F.col("query_id") % 40 == 20, 6).otherwise(1)
    whole = lambda c: F.flatten(F.array_repeat(F.slice(F.col(c), F.lit(1), n), times))
    plain = lambda x: F.when(x.rlike("^[BI]-[A-Z_]+$"), F.when(F.col("query_id") % 53 == 5, F.replace(x, F.lit("COLOR"), F.lit("SHADE"))).otherwise(x)).otherwise("O")
    t = t.where(n > 0).select("query_id", F.transform(whole("query_tokens"), lambda x: F.coalesce(x, F.lit(""))).alias("tokens"), F.transform(whole("ner_tags"), plain).alias("gold_tags"))
    nxt = lambda x: F.concat(F.lit("B-"), F.coalesce(*[F.when(F.substr(x, F.lit(3)) == k, v) for k, v in NEXT.items()], F.lit("BRAND")))
    changed = lambda x, i: F.when((F.col("query_id") % 3 == 0) | ((F.col("query_id") + i) % 5 != 0), x).when(x == "O", "B-BRAND").when(x.startswith("B-"), nxt(x)).otherwise("O")
    return t.withColumn("pred_tags", F.transform("gold_tags", changed))


TOK = f"""tok0 AS (SELECT id, p, coalesce(w[p % n + 1], '') AS token, CASE WHEN regexp_matches(t[p % n + 1], '^[BI]-[A-Z_]+$') THEN CASE WHEN id % 53 = 5 THEN replace(t[p % n + 1], 'COLOR', 'SHADE') ELSE t[p % n + 1] END ELSE 'O' END AS gold
 FROM (SELECT *, unnest(range(0, n * CASE id % 40 WHEN 0 THEN 3 WHEN 20 THEN 6 ELSE 1 END)) AS p FROM (SELECT query_id AS id, least(len(query_tokens), len(ner_tags)) AS n, query_tokens AS w, ner_tags AS t FROM train WHERE query_tokens IS NOT NULL AND ner_tags IS NOT NULL) WHERE n > 0)),
tok AS (SELECT *, CASE WHEN id % 3 = 0 OR (id + p) % 5 <> 0 THEN gold WHEN gold = 'O' THEN 'B-BRAND' WHEN gold LIKE 'B-%' THEN 'B-' || CASE substr(gold, 3) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in NEXT.items())} ELSE 'BRAND' END ELSE 'O' END AS pred FROM tok0),
len AS (SELECT id, count(*) AS n FROM tok GROUP BY id)"""
BINS = "CASE WHEN n BETWEEN 1 AND 2 THEN '1-2' WHEN n BETWEEN 3 AND 4 THEN '3-4' WHEN n BETWEEN 5 AND 7 THEN '5-7' WHEN n BETWEEN 8 AND 11 THEN '8-11' WHEN n BETWEEN 12 AND 19 THEN '12-19' ELSE '20+' END"
SPANS = """side AS (SELECT id, p, token, 'g' AS side, gold AS tag FROM tok UNION ALL SELECT id, p, token, 'p', pred FROM tok),
f AS (SELECT *, lag(tag) OVER (PARTITION BY side, id ORDER BY p) AS pt FROM side),
g AS (SELECT *, CASE WHEN tag = 'O' THEN 0 WHEN tag LIKE 'I-%' AND coalesce(pt, 'O') <> 'O' AND substr(pt, 3) = substr(tag, 3) THEN 0 ELSE 1 END AS st FROM f),
h AS (SELECT *, sum(st) OVER (PARTITION BY side, id ORDER BY p) AS isl, sum(CASE WHEN tag = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY side, id ORDER BY p) AS run FROM g),
k AS (SELECT *, max(CASE WHEN tag LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY side, id, run ORDER BY p) AS rb FROM h WHERE tag <> 'O'),
spans AS (SELECT side, id, isl, max(substr(tag, 3)) AS entity_type, min(p) AS s, max(p) AS e, min_by(tag, p) LIKE 'B-%' AS hb, min_by(rb, p) = 1 AS rb, string_agg(token, ' ' ORDER BY p) AS txt FROM k GROUP BY side, id, isl)"""
COARSE_SPANS = SPANS.replace("gold AS tag", "CASE WHEN gold = 'O' THEN 'O' ELSE substr(gold, 1, 1) || '-PRODUCT' END AS tag").replace("pred FROM tok", "CASE WHEN pred = 'O' THEN 'O' ELSE substr(pred, 1, 1) || '-PRODUCT' END FROM tok")
KEEP = {"strict": "hb", "lenient": "true", "attribute": "rb"}
PRF = "coalesce(m / nullif(pn, 0), 0)::DOUBLE AS precision, coalesce(m / nullif(gn, 0), 0)::DOUBLE AS recall, coalesce(2 * m / nullif(pn + gn, 0), 0)::DOUBLE AS f1"


def counts_sql(decoder: str, group: str = "'x'", extra: str = "", spans: str = SPANS) -> str:
    """CTEs up to ``c`` (grp, entity_type, gn, pn, m) with a row ALL; ``group`` may use id and the table ``grp``."""
    return f"""WITH {TOK}, {spans}{extra},
kept AS (SELECT {group} AS grp, q.* FROM spans q {'JOIN grp USING (id)' if extra else ''} WHERE {KEEP[decoder]}),
hit AS (SELECT a.grp, a.entity_type, count(*) AS m FROM kept a JOIN kept b ON a.side = 'g' AND b.side = 'p' AND a.grp = b.grp AND a.id = b.id AND a.entity_type = b.entity_type AND a.s = b.s AND a.e = b.e GROUP BY ALL),
c0 AS (SELECT grp, entity_type, count(*) FILTER (side = 'g') AS gn, count(*) FILTER (side = 'p') AS pn FROM kept GROUP BY ALL),
c1 AS (SELECT c0.*, coalesce(m, 0) AS m FROM c0 LEFT JOIN hit USING (grp, entity_type)),
c AS (SELECT * FROM c1 UNION ALL SELECT grp, 'ALL', sum(gn), sum(pn), sum(m) FROM c1 GROUP BY grp)
"""


def _prf_sql(decoder: str) -> str:
    return counts_sql(decoder) + f"SELECT entity_type, gn::BIGINT AS gold_spans, pn::BIGINT AS pred_spans, m::BIGINT AS matched, {PRF} FROM c"


def _spans_sql(decoder: str) -> str:
    return f"WITH {TOK}, {SPANS} SELECT id AS query_id, entity_type, s::INT AS start, e::INT AS \"end\", txt AS text FROM spans WHERE side = 'p' AND {KEEP[decoder]}"


def _spans(spark, d, decoder):
    return S.span_rows(pairs(spark, d), ["query_id"], "pred_tags", decoder, tokens="tokens")


@query(_spans_sql("strict"))
def spans_strict(spark, d):
    return _spans(spark, d, S.STRICT)


@query(_spans_sql("lenient"))
def spans_lenient(spark, d):
    return _spans(spark, d, S.LENIENT)


@query(_spans_sql("attribute"))
def spans_attribute(spark, d):
    return _spans(spark, d, S.ATTRIBUTE)


@query(_prf_sql("strict"))
def span_prf_strict(spark, d):
    return M.span_prf(pairs(spark, d), [], S.STRICT)


@query(_prf_sql("lenient"))
def span_prf_lenient(spark, d):
    return M.span_prf(pairs(spark, d), [], S.LENIENT)


@query(_prf_sql("attribute"))
def span_prf_attribute(spark, d):
    return M.span_prf(pairs(spark, d), [], S.ATTRIBUTE)


@query(
    "WITH fine AS (" + counts_sql("strict") + f"SELECT {PRF} FROM c WHERE entity_type = 'ALL'), coarse AS (" + counts_sql("strict", spans=COARSE_SPANS) + f"SELECT {PRF} FROM c WHERE entity_type = 'ALL') "
    "SELECT f.precision AS fine_precision, f.recall AS fine_recall, f.f1 AS fine_f1, c.precision AS coarse_precision, c.recall AS coarse_recall, c.f1 AS coarse_f1, "
    "c.precision - f.precision AS precision_gain, c.recall - f.recall AS recall_gain, c.f1 - f.f1 AS f1_gain FROM fine f, coarse c"
)
def coarse_gain(spark, d):
    return M.coarse_gain(pairs(spark, d), [])


@query("WITH t AS (" + counts_sql("strict") + f"SELECT entity_type, gn AS support, {PRF} FROM c WHERE entity_type <> 'ALL') SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1, sum(support)::BIGINT AS support FROM t")
def macro_weighted_avg(spark, d):
    per_type = M.span_prf(pairs(spark, d), [], S.STRICT).where("entity_type <> 'ALL'").withColumn("support", F.col("gold_spans"))
    return M.averages(per_type, [])


@query(f"WITH {TOK}, c AS (SELECT gold, pred, count(*) AS n FROM tok GROUP BY ALL), l AS (SELECT gold AS l FROM c UNION SELECT pred FROM c), full_ AS (SELECT a.l AS gold, b.l AS pred, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.gold = a.l AND c.pred = b.l) SELECT gold, pred, n::BIGINT AS n, coalesce(n / nullif(sum(n) OVER (PARTITION BY gold), 0), 0)::DOUBLE AS value FROM full_")
def tag_confusion_norm(spark, d):
    return E.confusion(E.token_rows(pairs(spark, d)), "true")


@query(f"WITH {TOK}, c AS (SELECT CASE WHEN gold = 'O' THEN 'fp' WHEN pred = 'O' THEN 'fn' ELSE 'confusion' END AS kind, token, gold, pred, count(*) AS n FROM tok WHERE gold <> pred GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, token, gold, pred) AS rank FROM c QUALIFY rank <= 20")
def common_errors_topn(spark, d):
    return E.common_errors(E.token_rows(pairs(spark, d)))


@query(f"WITH {TOK}, c AS (SELECT substr(gold, 3) || '->' || substr(pred, 3) AS pair, count(*) AS n FROM tok WHERE gold <> 'O' AND pred <> 'O' AND substr(gold, 3) <> substr(pred, 3) GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY n DESC, pair) AS rank FROM c QUALIFY rank <= 20")
def fine_type_confusion(spark, d):
    return E.type_confusion(E.token_rows(pairs(spark, d)))


def _grouped_sql(extra: str, name: str) -> str:
    return counts_sql("lenient", "grp.g", extra) + f", z AS (SELECT g, count(*) AS queries FROM grp GROUP BY g) SELECT g AS {name}, queries, coalesce(gn, 0)::BIGINT AS gold_spans, coalesce(pn, 0)::BIGINT AS pred_spans, coalesce(m, 0)::BIGINT AS matched, {PRF} FROM z LEFT JOIN c ON c.grp = z.g AND entity_type = 'ALL'"


@query(_grouped_sql(f", grp AS (SELECT id, {BINS} AS g FROM len)", "bin"))
def prf_by_length_bin(spark, d):
    return E.by_length(pairs(spark, d))


@query(_grouped_sql(", grp AS (SELECT id, CASE WHEN count(DISTINCT CASE WHEN gold LIKE 'B-%' THEN substr(gold, 3) END) > 1 THEN 'multi' ELSE 'single' END AS g FROM tok GROUP BY id)", "grp"))
def multi_attribute_split(spark, d):
    return E.multi_attribute(pairs(spark, d))


@query(f"WITH {TOK} SELECT substr(gold, 3) AS entity_type, count(*) AS n, CASE WHEN count(*) <= 5 THEN 'rare' WHEN count(*) >= 50 THEN 'common' ELSE 'neither' END AS class FROM tok WHERE gold LIKE 'B-%' GROUP BY 1")
def rarity_split(spark, d):
    return E.rarity(pairs(spark, d))


def _gain_sql(spans: str, name: str) -> str:
    return counts_sql("strict", "grp.g", ", t AS (SELECT substr(gold, 3) AS t, count(*) AS n FROM tok WHERE gold LIKE 'B-%' GROUP BY 1), cut AS (SELECT list_sort(list(n))[count(*) // 2 + 1] AS cut FROM t), grp AS (SELECT DISTINCT id, CASE WHEN n < cut THEN 'rare' ELSE 'common' END AS g FROM tok JOIN t ON gold LIKE 'B-%' AND substr(gold, 3) = t, cut)", spans) + f"SELECT grp, {', '.join(f'{c} AS {name}_{c}' for c in ('precision', 'recall', 'f1'))} FROM (SELECT grp, {PRF} FROM c WHERE entity_type = 'ALL')"


@query(f"SELECT f.*, c.coarse_precision, c.coarse_recall, c.coarse_f1, coarse_precision - fine_precision AS precision_gain, coarse_recall - fine_recall AS recall_gain, coarse_f1 - fine_f1 AS f1_gain FROM ({_gain_sql(SPANS, 'fine')}) f JOIN ({_gain_sql(COARSE_SPANS, 'coarse')}) c USING (grp)")
def rarity_gain(spark, d):
    """Coarse gain of queries with rare and with common types."""
    return E.rarity_gain(pairs(spark, d))


@query(f"WITH {TOK}, t AS (SELECT CASE WHEN gold = 'O' THEN '' ELSE substr(gold, 3) END AS g, CASE WHEN pred = 'O' THEN '' ELSE substr(pred, 3) END AS p FROM tok), u AS (SELECT g AS entity_type, (g = p)::INT AS tp, 0 AS fp, (g <> p)::INT AS fn FROM t UNION ALL SELECT p, 0, 1, 0 FROM t WHERE g <> p) SELECT entity_type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM u WHERE entity_type <> '' GROUP BY 1")
def fp_fn_by_type(spark, d):
    return E.fp_fn(E.token_rows(pairs(spark, d)))


@query(f"WITH {TOK}, x AS (SELECT count(*) FILTER (contains(gold, 'COLOR') AND contains(pred, 'COLOR')) AS tp, count(*) FILTER (NOT contains(gold, 'COLOR') AND contains(pred, 'COLOR')) AS fp, count(*) FILTER (contains(gold, 'COLOR') AND NOT contains(pred, 'COLOR')) AS fn FROM tok) SELECT tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1 FROM x")
def color_ambiguity(spark, d):
    return E.one_type(E.token_rows(pairs(spark, d)), "COLOR")


_KIND = "CASE WHEN {0} = 'O' THEN '' ELSE substr({0}, 3) END"


_SPARSE = (
    f"WITH {TOK}, t AS (SELECT {_KIND.format('gold')} AS g, {_KIND.format('pred')} AS p, gold = pred AS same, gold LIKE 'B-%' AS b, false AS coarse FROM tok UNION ALL SELECT CASE WHEN gold = 'O' THEN '' ELSE 'PRODUCT' END, CASE WHEN pred = 'O' THEN '' ELSE 'PRODUCT' END, substr(gold, 1, 1) = substr(pred, 1, 1), gold LIKE 'B-%', true FROM tok), "
    "u AS (SELECT coarse, g AS entity_type, b::INT AS b, same::INT AS tp, 0 AS predicted, 1 AS gold FROM t UNION ALL SELECT coarse, p, 0, 0, 1, 0 FROM t), v AS (SELECT coarse, entity_type, sum(b) AS b, sum(tp) AS m, sum(predicted) AS pn, sum(gold) AS gn FROM u WHERE entity_type <> '' GROUP BY ALL) "
    f"SELECT entity_type, b::BIGINT AS count, m::BIGINT AS tp, pn::BIGINT AS predicted, gn::BIGINT AS gold, {PRF}, NOT coarse AND b < 1000 AS is_rare FROM v WHERE coarse OR b > 0"
)


@query(_SPARSE)
def hier_sparsity(spark, d):
    return E.sparsity(E.token_rows(pairs(spark, d)))


@query(f"WITH s AS ({_SPARSE}) SELECT coalesce(avg(f1) FILTER (entity_type <> 'PRODUCT' AND is_rare), 0) AS avg_rare_f1, coalesce(avg(f1) FILTER (entity_type <> 'PRODUCT' AND NOT is_rare), 0) AS avg_common_f1, coalesce(avg(f1) FILTER (entity_type = 'PRODUCT'), 0) AS coarse_f1, coalesce(string_agg(entity_type, '|' ORDER BY entity_type) FILTER (entity_type <> 'PRODUCT' AND is_rare), '') AS rare_types, coalesce(string_agg(entity_type, '|' ORDER BY entity_type) FILTER (entity_type <> 'PRODUCT' AND NOT is_rare), '') AS common_types FROM s")
def sparsity_summary(spark, d):
    s = E.sparsity_summary(E.sparsity(E.token_rows(pairs(spark, d))))
    return s.withColumns({c: F.array_join(c, "|") for c in ("rare_types", "common_types")})


_LISTS = f"WITH {TOK}, x AS (SELECT CASE WHEN contains(gold, 'COLOR') AND NOT contains(pred, 'COLOR') THEN CASE WHEN pred = 'O' THEN 'missed' ELSE 'confusion' END WHEN contains(pred, 'COLOR') AND NOT contains(gold, 'COLOR') THEN 'hallucinated' END AS list, lower(token) AS token, gold, pred FROM tok), c AS (SELECT list, token, CASE list WHEN 'missed' THEN '' WHEN 'confusion' THEN pred ELSE gold END AS tag, count(*) AS n FROM x WHERE list IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY list ORDER BY n DESC, token, tag) AS rank FROM c QUALIFY rank <= 20"


@query(_LISTS)
def color_lists(spark, d):
    return E.one_type_lists(E.token_rows(pairs(spark, d)), "COLOR")


@query(f"WITH {TOK}, x AS (SELECT CASE WHEN gold = pred THEN NULL WHEN gold = 'O' THEN 'false_positive' WHEN pred = 'O' THEN 'false_negative' ELSE 'wrong_type' END AS t FROM tok), c AS (SELECT count(*) AS n, count(*) FILTER (t = 'false_positive') AS a, count(*) FILTER (t = 'false_negative') AS b, count(*) FILTER (t = 'wrong_type') AS c FROM x) SELECT 'false_positive' AS error_type, a AS n, 100.0 * a / n AS rate FROM c UNION ALL SELECT 'false_negative', b, 100.0 * b / n FROM c UNION ALL SELECT 'wrong_type', c, 100.0 * c / n FROM c UNION ALL SELECT 'total', a + b + c, 100.0 * (a + b + c) / n FROM c")
def error_buckets(spark, d):
    return E.error_buckets(E.token_rows(pairs(spark, d)))


@query(f"WITH {TOK}, l AS (SELECT id, string_agg(gold, ' ' ORDER BY p) AS gold, string_agg(pred, ' ' ORDER BY p) AS pred FROM tok GROUP BY id) SELECT id AS query_id, gold AS gold_tags, pred AS pred_tags FROM l WHERE gold <> pred ORDER BY id LIMIT 10")
def first_mismatches(spark, d):
    """The first ten queries that are not right, to look at."""
    return E.first_mismatches(pairs(spark, d)).select("query_id", F.array_join("gold_tags", " ").alias("gold_tags"), F.array_join("pred_tags", " ").alias("pred_tags"))


_FLAGS = f"WITH {TOK} SELECT id AS query_id, bool_or(gold = 'O' AND pred <> 'O') AS has_fp, bool_or(gold <> 'O' AND pred = 'O') AS has_fn, bool_or(gold <> pred AND gold <> 'O' AND pred <> 'O') AS has_confusion, bool_and(gold = pred) AS is_correct, concat_ws(',', CASE WHEN bool_or(gold = 'O' AND pred <> 'O') THEN 'FP' END, CASE WHEN bool_or(gold <> 'O' AND pred = 'O') THEN 'FN' END, CASE WHEN bool_or(gold <> pred AND gold <> 'O' AND pred <> 'O') THEN 'TYPE_CONFUSION' END) AS error_types FROM tok GROUP BY id"


@query(_FLAGS)
def error_type_flags(spark, d):
    return E.error_flags(pairs(spark, d)).drop("tokens", "gold_tags", "pred_tags")


_SLOTS = f"WITH {TOK}, {SPANS}, s AS (SELECT DISTINCT side, id, entity_type AS t, lower(trim(txt)) AS v FROM spans WHERE rb)"


@query(_SLOTS + f", c AS (SELECT (SELECT count(*) FROM s a JOIN s b USING (id, t, v) WHERE a.side = 'g' AND b.side = 'p') AS m, (SELECT count(*) FROM s WHERE side = 'p') AS pn, (SELECT count(*) FROM s WHERE side = 'g') AS gn) SELECT m AS matched, pn AS predicted, gn AS gold, {PRF} FROM c")
def slot_prf(spark, d):
    return X.slot_prf(pairs(spark, d))


@query(
    f"WITH {TOK}, {SPANS}, l AS (SELECT side, id, entity_type AS t, list(txt ORDER BY s) AS v, list_sort(list_distinct(list(txt))) AS ds FROM spans WHERE rb GROUP BY ALL), lg AS (SELECT * FROM l WHERE side = 'g'), lp AS (SELECT * FROM l WHERE side = 'p'), "
    "j AS (SELECT coalesce(lg.id, lp.id) AS id, coalesce(lg.v = lp.v, false) AS ex, coalesce(lg.ds = lp.ds, false) AS part FROM lg FULL JOIN lp ON lg.id = lp.id AND lg.t = lp.t), "
    "q AS (SELECT len.id, coalesce(bool_and(ex), true) AS ex, coalesce(bool_or(part), false) AS part FROM len LEFT JOIN j USING (id) GROUP BY len.id) "
    "SELECT count(*) AS queries, count(*) FILTER (ex) AS exact, count(*) FILTER (part) AS partial, count(*) FILTER (ex) / count(*) AS exact_rate, count(*) FILTER (part) / count(*) AS partial_rate FROM q"
)
def query_exact_partial(spark, d):
    return X.understanding(pairs(spark, d))


@query(_SLOTS + ", gg AS (SELECT id, entity_type AS t, lower(trim(txt)) AS v FROM spans WHERE side = 'g' AND rb), hh AS (SELECT gg.t AS entity_type, EXISTS (SELECT 1 FROM s WHERE s.side = 'p' AND s.id = gg.id AND s.t = gg.t AND s.v = gg.v) AS hit FROM gg), c AS (SELECT entity_type, count(*) AS total, count(*) FILTER (hit) AS covered FROM hh GROUP BY 1), u AS (SELECT * FROM c UNION ALL SELECT 'ALL', sum(total), sum(covered) FROM c) SELECT entity_type, total::BIGINT AS total, covered::BIGINT AS covered, 100.0 * covered / total AS coverage FROM u")
def attribute_coverage(spark, d):
    return X.coverage(pairs(spark, d))


@query(f"WITH {TOK}, c AS (SELECT gold, pred, count(*) AS n FROM tok GROUP BY ALL), t AS (SELECT sum(n) AS tokens, sum(n) FILTER (gold = pred) AS agreed, sum(n) FILTER (gold <> 'O') AS entity_a, sum(n) FILTER (pred <> 'O') AS entity_b FROM c), e AS (SELECT sum(a.n * b.n) AS pe FROM (SELECT gold AS l, sum(n)::DOUBLE AS n FROM c GROUP BY 1) a JOIN (SELECT pred AS l, sum(n)::DOUBLE AS n FROM c GROUP BY 1) b USING (l)) SELECT tokens::BIGINT AS tokens, agreed::BIGINT AS agreed, entity_a::BIGINT AS entity_a, entity_b::BIGINT AS entity_b, agreed / tokens AS accuracy, (agreed / tokens - pe / (tokens::DOUBLE * tokens)) / (1 - pe / (tokens::DOUBLE * tokens)) AS kappa FROM t, e")
def cohen_kappa(spark, d):
    return X.agreement(E.token_rows(pairs(spark, d)), "gold", "pred")


def counted(counts) -> Column:
    """A map of counts as text."""
    return F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), "|")


@query("SELECT count(*) AS queries, sum(len(coalesce(ner_tags, [])))::BIGINT AS tokens, sum(len(list_filter(coalesce(ner_tags, []), lambda x: x <> 'O')))::BIGINT AS entity_tokens, count(*) FILTER (len(list_filter(coalesce(ner_tags, []), lambda x: x <> 'O')) > 0) AS queries_with_entity, (sum(len(list_filter(coalesce(ner_tags, []), lambda x: x <> 'O'))) / sum(len(coalesce(ner_tags, []))))::DOUBLE AS entity_ratio, (SELECT string_agg(k || ':' || n, '|' ORDER BY k) FROM (SELECT substr(t, 3) AS k, count(*) AS n FROM (SELECT unnest(ner_tags) AS t FROM train) WHERE t LIKE 'B-%' GROUP BY 1)) AS entity_counts FROM train")
def qa_report(spark, d):
    r = X.qa_report(table(spark, d, "train").select("ner_tags"), "ner_tags")
    return r.withColumn("entity_counts", counted(F.col("entity_counts")))


@query(f"WITH {TOK}, c AS (SELECT count(*) AS tokens, count(*) FILTER (gold <> pred) AS corrections FROM tok), e AS (SELECT gold AS a, pred AS b, count(*)::DOUBLE AS n FROM tok GROUP BY ALL), pe AS (SELECT sum(x.n * y.n) AS pe FROM (SELECT a AS l, sum(n) AS n FROM e GROUP BY 1) x JOIN (SELECT b AS l, sum(n) AS n FROM e GROUP BY 1) y USING (l)), k AS (SELECT *, ((tokens - corrections) / tokens - pe / (tokens::DOUBLE * tokens)) / (1 - pe / (tokens::DOUBLE * tokens)) AS kappa FROM c, pe) SELECT tokens, corrections, 100.0 * corrections / tokens AS rate, kappa, CASE WHEN kappa >= 0.8 THEN 'Almost perfect agreement' WHEN kappa >= 0.6 THEN 'Substantial agreement' WHEN kappa >= 0.4 THEN 'Moderate agreement' ELSE 'Fair/Slight agreement' END AS interpretation FROM k")
def correction_rate(spark, d):
    return X.correction_rate(E.token_rows(pairs(spark, d)), "pred", "gold")


@query(f"WITH {TOK} SELECT pred AS silver_tag, gold AS corrected_tag, count(*) AS n FROM tok WHERE pred <> gold GROUP BY ALL ORDER BY n DESC, silver_tag, corrected_tag LIMIT 20")
def correction_patterns(spark, d):
    return X.correction_patterns(E.token_rows(pairs(spark, d)), "pred", "gold")


_TYPE = "CASE WHEN {0} = 'O' THEN 'O' ELSE substr({0}, 3) END"


@query(f"WITH {TOK}, c AS (SELECT {_TYPE.format('pred')} AS gold, {_TYPE.format('gold')} AS pred, count(*) AS n FROM tok GROUP BY ALL), l AS (SELECT gold AS l FROM c UNION SELECT pred FROM c), full_ AS (SELECT a.l AS gold, b.l AS pred, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.gold = a.l AND c.pred = b.l) SELECT gold AS silver, pred AS corrected, n::BIGINT AS n, coalesce(n / nullif(sum(n) OVER (PARTITION BY gold), 0), 0)::DOUBLE AS value FROM full_")
def type_confusion_corrected(spark, d):
    """Types of the silver tags against those of the corrected ones, by rows."""
    return E.confusion(X.types_of(E.token_rows(pairs(spark, d)), "pred", "gold"), "true").withColumnsRenamed({"gold": "silver", "pred": "corrected"})


@query(f"WITH {TOK} SELECT CASE WHEN pred = 'O' THEN 'O' ELSE substr(pred, 3) END AS entity_type, count(*) AS tokens, avg((gold = pred)::INT) AS accuracy FROM tok GROUP BY 1")
def silver_accuracy_by_type(spark, d):
    return X.accuracy_by_type(E.token_rows(pairs(spark, d)), "pred", "gold")


_FIX = f"WITH {TOK}, l AS (SELECT id, list(pred ORDER BY p) AS silver, list(gold ORDER BY p) AS fixed FROM tok GROUP BY id) "


@query(_FIX + "SELECT id AS query_idx, array_to_string(CASE WHEN id % 3 = 0 THEN fixed ELSE silver END, ' ') AS tags, id % 3 = 0 AND fixed <> silver AS was_corrected FROM l")
def merge_corrections(spark, d):
    """Every third sequence is reviewed: its rows say the gold tag where it differs and nothing where it does not."""
    p = pairs(spark, d)
    review = E.token_rows(p.where("query_id % 3 = 0")).select(F.col("query_id").alias("query_idx"), "pos", "token", F.col("pred").alias("silver_tag"), F.when(F.col("gold") != F.col("pred"), F.col("gold")).otherwise("").alias("corrected_tag"))
    merged = X.merge_corrections(p.select(F.col("query_id").alias("query_idx"), F.col("pred_tags").alias("tags")), X.corrections(review), "tags")
    return merged.select("query_idx", F.array_join("tags", " ").alias("tags"), "was_corrected")


@query("WITH t AS (SELECT unnest(ner_tags) AS tag FROM train), c AS (SELECT tag, count(*) AS n FROM t WHERE tag IS NOT NULL GROUP BY 1) SELECT tag, n, n / sum(n) OVER () AS fraction FROM c")
def tag_distribution(spark, d):
    return X.tag_distribution(table(spark, d, "train").select("ner_tags"), "ner_tags")


@query("SELECT count(n) AS count, avg(n) AS mean, stddev_samp(n) AS std, min(n) AS min, quantile_cont(n, .25) AS p25, quantile_cont(n, .5) AS p50, quantile_cont(n, .75) AS p75, max(n) AS max FROM (SELECT num_tokens AS n FROM train)")
def describe_lengths(spark, d):
    return M.describe(table(spark, d, "train"), "num_tokens")


@query("WITH z AS (SELECT unnest(query_tokens[1:least(len(query_tokens), len(ner_tags))]) AS tok, unnest(ner_tags[1:least(len(query_tokens), len(ner_tags))]) AS tag FROM train WHERE query_tokens IS NOT NULL AND ner_tags IS NOT NULL), c AS (SELECT substr(tag, 3) AS entity_type, lower(tok) AS token, count(*) AS n FROM z WHERE tok IS NOT NULL AND (tag LIKE 'B-%' OR tag LIKE 'I-%') GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY n DESC, token) AS rank FROM c QUALIFY rank <= 10")
def top_tokens_per_type(spark, d):
    t = table(spark, d, "train").where("query_tokens is not null and ner_tags is not null").select("query_id", F.col("query_tokens").alias("tokens"), F.col("ner_tags").alias("gold_tags"), F.col("ner_tags").alias("pred_tags"))
    rows = E.token_rows(t).where(F.col("token").isNotNull() & (F.col("gold").startswith("B-") | F.col("gold").startswith("I-")))
    return E.top(rows.groupBy(F.substr("gold", F.lit(3)).alias("entity_type"), F.lower("token").alias("token")).agg(F.count("*").alias("n")), ["entity_type"], 10, "token")


_META = "SELECT query_id AS id, lower(trim(product_brand[1])) AS v FROM train UNION SELECT query_id, lower(trim(product_color[1])) FROM train"


@query(f"WITH {TOK}, {SPANS}, p AS (SELECT id, lower(txt) AS v FROM spans WHERE side = 'p' AND rb), m AS (SELECT * FROM ({_META}) WHERE v <> '' AND id IN (SELECT id FROM len)), x AS (SELECT id, bool_or(NOT EXISTS (SELECT 1 FROM p WHERE p.id = m.id AND contains(p.v, m.v))) AS missed FROM m GROUP BY id) SELECT count(*) AS queries, count(*) FILTER (missed) AS reformulated, 100.0 * count(*) FILTER (missed) / count(*) AS rate FROM x")
def reformulation_rate(spark, d):
    """The first brand and colour of a query's products are its metadata."""
    meta = table(spark, d, "train").select("query_id", F.get("product_brand", F.lit(0)).alias("brand"), F.get("product_color", F.lit(0)).alias("color"))
    return X.reformulation(pairs(spark, d).join(meta, "query_id"), {"brand": "brand", "color": "color"})


def _picked_sql(n: int = 30) -> str:
    right, third = n // 5, (n - n // 5) // 3
    return (
        f"WITH fl AS ({_FLAGS}), h AS (SELECT *, md5('42|' || query_id) AS h FROM fl), "
        + ", ".join(f"k{i} AS (SELECT *, {i} AS o FROM h WHERE {c} ORDER BY h, query_id LIMIT {third})" for i, c in enumerate(("has_fp", "has_fn", "has_confusion")))
        + ", p AS (SELECT * FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o) = 1), "
        f"r AS (SELECT *, 3 AS o FROM h WHERE NOT is_correct AND query_id NOT IN (SELECT query_id FROM p) ORDER BY h, query_id LIMIT {n - right}), "
        f"w AS (SELECT * FROM (SELECT * FROM p UNION ALL SELECT * FROM r) ORDER BY o, h, query_id LIMIT {n - right}), c AS (SELECT *, 4 AS o FROM h WHERE is_correct ORDER BY h, query_id LIMIT {right}) "
        "SELECT query_id, is_correct, error_types FROM (SELECT * FROM w UNION ALL SELECT * FROM c)"
    )


@query(_picked_sql())
def qualitative_examples(spark, d):
    """Thirty queries to look at."""
    return E.qualitative(pairs(spark, d)).select("query_id", "is_correct", "error_types")


@query(f"WITH {TOK}, u AS (SELECT lower(token) AS token, min({{'id': id, 'p': p}}) AS seen FROM tok GROUP BY 1) SELECT token, row_number() OVER (ORDER BY seen) + 1 AS id FROM u UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1")
def vocab_ids(spark, d):
    return X.vocabulary(pairs(spark, d).select("query_id", "tokens"), "tokens", ["query_id"])
