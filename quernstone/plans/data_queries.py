"""Queries over ingest, text, sampling and annotation operators, on the judged query-product pairs, the catalogue and the
tagged splits."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import functions as F

from quernstone.functions import fuzzy, text
from quernstone.operators import annotate as A
from quernstone.operators import ingest as I  # noqa: E741
from quernstone.operators import sampling as P
from quernstone.plans.base import query
from quernstone.session import table

EX, PR = "shopping_queries_dataset_examples", "shopping_queries_dataset_products"
SAMPLE = 500
_TITLES = "SELECT product_id, product_locale, product_title AS t FROM shopping_queries_dataset_products"


def _products(spark, d):
    return table(spark, d, PR)


def _joined(spark, d):
    ex = table(spark, d, EX).select("example_id", "query", "product_id", "product_locale", "esci_label", "loaded_at")
    return I.join_products(ex, _products(spark, d).select("product_id", "product_locale", "product_title", "product_brand", "product_color"))


@query(f"SELECT example_id, query, e.product_id, e.product_locale, esci_label, product_title, product_brand FROM {EX} e LEFT JOIN {PR} p ON e.product_id = p.product_id AND e.product_locale = p.product_locale WHERE e.product_locale = 'us'")
def ingest_left_join(spark, d):
    ex = I.scan(spark, f"{d}/{EX}.parquet", ["example_id", "query", "product_id", "product_locale", "esci_label"], "us")
    pr = I.scan(spark, f"{d}/{PR}.parquet", ["product_id", "product_locale", "product_title", "product_brand"], "us")
    return I.join_products(ex, pr).select("example_id", "query", "product_id", "product_locale", "esci_label", "product_title", "product_brand")


@query(f"SELECT count(*) AS rows, count(*) FILTER (product_title IS NULL) AS unmatched FROM {EX} e LEFT JOIN {PR} p ON e.product_id = p.product_id AND e.product_locale = p.product_locale")
def ingest_unmatched_count(spark, d):
    return I.unmatched(_joined(spark, d))


_FIRST = "(SELECT query, {c} AS v, min({{'a': example_id, 'b': loaded_at}}) AS o FROM j WHERE query IS NOT NULL AND {c} IS NOT NULL GROUP BY ALL)"
_AGG = "(SELECT query, string_agg(v, '|' ORDER BY o, v) AS {c} FROM " + _FIRST + " GROUP BY query)"


@query(
    f"WITH j AS (SELECT e.query, e.esci_label, e.example_id, e.loaded_at, product_title, product_brand, product_color FROM {EX} e LEFT JOIN {PR} p ON e.product_id = p.product_id AND e.product_locale = p.product_locale), "
    "q AS (SELECT DISTINCT query FROM j WHERE query IS NOT NULL), l AS (SELECT query, string_agg(coalesce(esci_label, '-'), '|' ORDER BY example_id, loaded_at, esci_label NULLS FIRST) AS labels FROM j GROUP BY query) "
    "SELECT q.query, coalesce(product_title, '') AS product_title, coalesce(product_brand, '') AS product_brand, coalesce(product_color, '') AS product_color, labels FROM q JOIN l USING (query) "
    f"LEFT JOIN {_AGG.format(c='product_title')} a USING (query) LEFT JOIN {_AGG.format(c='product_brand')} b USING (query) LEFT JOIN {_AGG.format(c='product_color')} c USING (query)"
)
def query_list_agg(spark, d):
    cols = ["product_title", "product_brand", "product_color"]
    out = I.roll_up(_joined(spark, d), cols, [F.col("example_id"), F.col("loaded_at")])
    labels = F.array_join(F.transform("esci_label", lambda x: F.coalesce(x, F.lit("-"))), "|")
    return out.select("query", *[F.array_join(c, "|").alias(c) for c in cols], labels.alias("labels"))


@query(f"SELECT product_id, product_title FROM {PR} WHERE product_locale = 'es'")
def locale_filter(spark, d):
    return I.scan(spark, f"{d}/{PR}.parquet", ["product_id", "product_title"], "es")


def _abbrev_sql(col: str) -> str:
    for short, long in text.ABBREVIATIONS.items():
        for _ in range(2):  # neighbours share a boundary
            col = f"regexp_replace({col}, '(^|[^\\p{{L}}\\p{{N}}_])(?i:{short})($|[^\\p{{L}}\\p{{N}}_])', '\\1{long}\\2', 'g')"
    return col


def _decomposed() -> str:
    """What characters decompose to, as a map, where plain characters are in it."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))) for i in range(128, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and not 0xAC00 <= i < 0xD7A4]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{quoted(c)}: {quoted(k)}" for c, k in pairs if k != c and any(x < "\x80" for x in k)) + "}"


_DECOMPOSED = _decomposed()


def _clean_sql(col: str) -> str:
    for k, v in text.TYPOGRAPHIC.items():
        col = f"replace({col}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    # whatever decomposes into plain letters, digits or signs; the marks become spaces below
    col = f"CASE WHEN regexp_matches({col}, '^[\\x00-\\x7f]*$') THEN {col} ELSE array_to_string(list_transform(regexp_extract_all({col}, '(?s).'), lambda c: CASE WHEN c < chr(128) THEN c ELSE coalesce({_DECOMPOSED}[c], c) END), '') END"
    col = f"regexp_replace({_abbrev_sql(col)}, '[^a-zA-Z0-9\\s\\-./]', ' ', 'g')"
    return f"coalesce(lower(trim(regexp_replace({col}, '\\s+', ' ', 'g'))), '')"


@query(f"SELECT product_id, product_locale, {_clean_sql('product_title')} AS cleaned FROM {PR}")
def text_clean(spark, d):
    return _products(spark, d).select("product_id", "product_locale", text.clean_text(F.col("product_title")).alias("cleaned"))


@query(f"SELECT product_id, product_locale, {_abbrev_sql('product_title')} AS expanded FROM {PR}")
def text_abbrev(spark, d):
    return _products(spark, d).select("product_id", "product_locale", text.expand_abbreviations(F.col("product_title")).alias("expanded"))


_PREP = f"WITH c AS (SELECT product_id, product_title, {_clean_sql('product_title')} AS query_clean FROM {PR}), t AS (SELECT *, len(string_split(query_clean, ' ')) AS num_tokens FROM c WHERE query_clean <> '') "


@query(_PREP + "SELECT product_id, query_clean, num_tokens FROM t WHERE num_tokens BETWEEN 2 AND 8")
def text_tokenize_filter(spark, d):
    t = _products(spark, d).select("product_id", text.clean_text(F.col("product_title")).alias("query_clean")).where("query_clean <> ''")
    return t.withColumn("num_tokens", F.size(text.tokenize(F.col("query_clean"))).cast("long")).where(F.col("num_tokens").between(2, 8))


@query(_PREP + "SELECT query_clean, num_tokens, min(product_title) AS product_title FROM t WHERE num_tokens BETWEEN 2 AND 20 GROUP BY ALL")
def text_dedup_first(spark, d):
    t = text.preprocess(_products(spark, d).select("product_title"), "product_title")
    return t.select("query_clean", "num_tokens", "product_title")


@query(f"WITH u AS (SELECT 0 AS column_no, trim(product_title) AS text FROM {PR} UNION ALL SELECT 1, trim(product_description) FROM {PR} UNION ALL SELECT 2, trim(product_bullet_point) FROM {PR}) SELECT text, min(column_no) AS column_no FROM u WHERE text <> '' GROUP BY 1")
def corpus_union_dedup(spark, d):
    return I.corpus(_products(spark, d), ["product_title", "product_description", "product_bullet_point"], ["product_id", "product_locale"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(*) AS rows FROM {PR}" for c in ("product_id", "product_locale", "product_title", "product_brand", "product_color", "product_bullet_point", "product_description", "product_category")))
def null_profile(spark, d):
    return I.null_profile(_products(spark, d))


_DOM = "dom AS (SELECT query_id, coalesce((SELECT v FROM (SELECT v, count(*) AS n, min(i) AS f FROM (SELECT unnest(esci_label) AS v, generate_subscripts(esci_label, 1) AS i) WHERE v IS NOT NULL GROUP BY v) ORDER BY n DESC, f LIMIT 1), 'unknown') AS stratum FROM train)"


def _strata(spark, d):
    return table(spark, d, "train").select("query_id", P.dominant(F.col("esci_label")).alias("stratum"))


@query(f"WITH {_DOM} SELECT * FROM dom")
def dominant_value(spark, d):
    return _strata(spark, d)


@query(f"WITH {_DOM} SELECT stratum, count(*) AS rows, count(*) / sum(count(*)) OVER () AS fraction FROM dom GROUP BY stratum")
def stratum_fracs(spark, d):
    return P.fractions(_strata(spark, d), "stratum")


_RANK = f"{_DOM}, r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || query_id), query_id) AS rn, count(*) OVER (PARTITION BY stratum) AS cnt FROM dom)"
_QUOTA = "q{n} AS (SELECT stratum, cnt, CASE WHEN k = strata THEN least(cnt, greatest(0, size - coalesce(prior, 0))) ELSE share END AS quota FROM (SELECT *, sum(share) OVER (ORDER BY cnt DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (SELECT *, least(cnt, greatest(1, round_even(size * cnt / total, 0)::BIGINT)) AS share FROM (SELECT stratum, count(*) AS cnt, sum(count(*)) OVER () AS total, least({n}, sum(count(*)) OVER ()) AS size, row_number() OVER (ORDER BY count(*) DESC, stratum) AS k, count(*) OVER () AS strata FROM dom GROUP BY stratum))))"


@query(f"WITH {_RANK}, {_QUOTA.format(n=SAMPLE)} SELECT query_id, r.stratum FROM r JOIN q{SAMPLE} q ON r.stratum = q.stratum WHERE rn <= quota")
def stratified_sample(spark, d):
    return P.stratified_sample(_strata(spark, d), SAMPLE, "stratum", "query_id").select("query_id", "stratum")


@query(f"WITH {_RANK} SELECT query_id, stratum, CASE WHEN rn <= round(cnt * 0.7::DOUBLE) THEN 'train' WHEN rn <= round(cnt * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r")
def stratified_split(spark, d):
    return P.stratified_split(_strata(spark, d), "stratum", "query_id").select("query_id", "stratum", "split")


@query(f"WITH {_DOM}, f AS (SELECT query_id, CASE WHEN count(*) OVER (PARTITION BY stratum) < 100 THEN '_other' ELSE stratum END AS stratum FROM dom) SELECT query_id, CASE WHEN (SELECT count(DISTINCT stratum) FROM f) < 2 THEN '_other' ELSE stratum END AS stratum FROM f")
def tiny_strata_fold(spark, d):
    return P.fold_tiny(_strata(spark, d), "stratum", 100).select("query_id", "stratum")


@query(f"WITH {_RANK}, {', '.join(_QUOTA.format(n=n) for n in (100, 250, 500))} " + " UNION ALL ".join(f"SELECT query_id, '{n / 1000:g}k' AS subset FROM r JOIN q{n} q ON r.stratum = q.stratum WHERE rn <= quota" for n in (100, 250, 500)))
def low_resource_subsets(spark, d):
    return P.nested_subsets(_strata(spark, d), [100, 250, 500], "stratum", "query_id").select("query_id", "subset")


_HAS = "len(list_filter(coalesce(ner_tags, []), lambda x: x <> 'O')) > 0"


@query(f"WITH t AS (SELECT query_id, {_HAS} AS has, row_number() OVER (PARTITION BY {_HAS} ORDER BY md5('42|' || query_id), query_id) AS rn FROM train), p AS (SELECT * FROM t WHERE has AND rn <= 50) SELECT query_id, has FROM p UNION ALL SELECT query_id, has FROM t WHERE NOT has AND rn <= 100 - (SELECT count(*) FROM p)")
def balanced_review_sample(spark, d):
    s = P.review_sample(table(spark, d, "train").select("query_id", "ner_tags"), 100, "ner_tags", "query_id")
    return s.select("query_id", A.has_entity(F.col("ner_tags")).alias("has"))


# the longest common subsequence, a row of the table per character
_LCS = "list_reduce(string_split(a, ''), lambda acc, x: list_reduce(range(1, length(b) + 1), lambda r, j: list_append(r, CASE WHEN string_split(b, '')[j] = x THEN acc[j] + 1 ELSE greatest(acc[j + 1], r[j]) END), [0::BIGINT]), list_resize([0::BIGINT], length(b) + 1, 0::BIGINT))"


@query(f"WITH b AS (SELECT brand_id, lower(brand_name) AS a, lower(lead(brand_name) OVER (ORDER BY brand_id)) AS b FROM brand_reference) SELECT brand_id, round(200.0 * {_LCS}[-1] / (length(a) + length(b)), 6)::DOUBLE AS ratio FROM b WHERE b IS NOT NULL")
def fuzzy_ratio(spark, d):
    """Indel similarity of every brand in the reference with the one after it."""
    b = table(spark, d, "brand_reference").select("brand_id", F.lower("brand_name").alias("a"))
    pairs = b.join(b.select((F.col("brand_id") - 1).alias("brand_id"), F.col("a").alias("b")), "brand_id")
    return fuzzy.ratios(pairs, "a", "b").select("brand_id", F.round("ratio", 6).alias("ratio"))


@query(
    "WITH t AS (SELECT *, list_filter(regexp_split_to_array(phrase, '\\s+'), lambda x: x <> '') AS words FROM (SELECT query_id, list_transform(query_tokens, lambda x: coalesce(x, '')) AS toks, unnest(list_distinct(list_transform(product_brand, lambda x: lower(x)))) AS phrase FROM train WHERE query_tokens IS NOT NULL)), "
    "w AS (SELECT query_id, phrase, i, len(words) AS m, array_to_string(toks[i + 1:i + len(words)], ' ') AS a, array_to_string(words, ' ') AS b FROM (SELECT *, unnest(range(0, len(toks) - len(words) + 1)) AS i FROM t WHERE len(words) BETWEEN 1 AND len(toks))), "
    f"r AS (SELECT query_id, phrase, i, m, CASE WHEN a = b THEN 1000.0 WHEN 200.0 * least(length(a), length(b)) / (length(a) + length(b)) < 85 THEN 0 ELSE 200.0 * {_LCS}[-1] / (length(a) + length(b)) END AS r FROM w), "
    "best AS (SELECT * FROM r WHERE r >= 85 QUALIFY row_number() OVER (PARTITION BY query_id, phrase ORDER BY r DESC, i) = 1) "
    'SELECT t.query_id, t.phrase, i::INT AS "start", (i + m - 1)::INT AS "end" FROM t LEFT JOIN best USING (query_id, phrase)'
)
def fuzzy_span(spark, d):
    """Where each brand of its products lies in a query of train, in any close spelling."""
    brands = F.array_distinct(F.transform("product_brand", F.lower))
    t = table(spark, d, "train").where("query_tokens is not null").select("query_id", "query_tokens", F.explode(brands).alias("phrase"))
    return t.select("query_id", "phrase", fuzzy.window_udf("query_tokens", "phrase").alias("w")).select("query_id", "phrase", "w.start", "w.end")


_NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_JOINED = "(SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT unnest({0}) AS x, generate_subscripts({0}, 1) AS i))"


@query("WITH t AS (SELECT query_id, " + _NORM.format("coalesce(array_to_string(product_title, ' '), '')") + " AS txt FROM train), m AS (" + " UNION ALL ".join(f"SELECT query_id, unnest(regexp_extract_all(txt, '{p}', 0)) AS v FROM t" for p in A.SIZES) + ") SELECT DISTINCT query_id, v AS size FROM m WHERE v <> ''")
def size_regex_candidates(spark, d):
    t = table(spark, d, "train").select("query_id", F.explode(A.sizes(F.coalesce("product_title", F.array().cast("array<string>")))).alias("size"))
    return t.distinct()


def _words_sql(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("WITH t AS (SELECT query_id, " + _NORM.format("array_to_string(list_concat(coalesce(product_title, []), coalesce(product_bullet_point, [])), ' ')") + f" AS txt FROM train) SELECT query_id, array_to_string(list_filter({_words_sql(A.MATERIALS)}, lambda k: contains(txt, k)), '|') AS materials, array_to_string(list_filter({_words_sql(A.ATTRIBUTES)}, lambda k: contains(txt, k)), '|') AS attributes FROM t")
def keyword_candidates(spark, d):
    t = table(spark, d, "train").withColumn("txt", A.joined_text(F.col("product_title"), F.col("product_bullet_point")))
    return t.select("query_id", F.array_join(A.keywords(F.col("txt"), A.MATERIALS), "|").alias("materials"), F.array_join(A.keywords(F.col("txt"), A.ATTRIBUTES), "|").alias("attributes"))


@query("WITH t AS (SELECT query_id, unnest(product_title) AS x FROM train), w AS (SELECT query_id, string_split(" + _NORM.format("x") + ", ' ') AS w FROM t WHERE trim(x) <> '') SELECT DISTINCT query_id, unnest(list_filter([CASE WHEN len(w) >= 2 THEN array_to_string(w[-2:], ' ') END, CASE WHEN len(w) >= 3 THEN array_to_string(w[-3:], ' ') END, w[-1]], lambda x: x IS NOT NULL)) AS phrase FROM w")
def suffix_ngrams(spark, d):
    t = table(spark, d, "train").where("product_title is not null")
    return t.select("query_id", F.explode(A.suffixes(F.col("product_title"))).alias("phrase")).distinct()


@query("SELECT query_id, coalesce(length(query), 0) AS chars, coalesce(len(query_tokens), -1) AS tokens FROM train")
def computed_columns(spark, d):
    return table(spark, d, "train").select("query_id", F.coalesce(F.length("query"), F.lit(0)).cast("long").alias("chars"), F.coalesce(F.size("query_tokens"), F.lit(-1)).cast("long").alias("tokens"))


@query("SELECT count(*) - count(DISTINCT query) AS duplicated FROM train WHERE query IS NOT NULL")
def duplicated_count(spark, d):
    return table(spark, d, "train").where("query is not null").agg((F.count("*") - F.countDistinct("query")).alias("duplicated"))


@query("SELECT floor(num_tokens)::BIGINT AS bin, count(*) AS n FROM train WHERE num_tokens BETWEEN 1 AND 19 GROUP BY 1")
def length_histogram(spark, d):
    return table(spark, d, "train").where("num_tokens between 1 and 19").groupBy(F.col("num_tokens").cast("long").alias("bin")).agg(F.count("*").alias("n"))
