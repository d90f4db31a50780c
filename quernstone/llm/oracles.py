"""SQL that says the same as queries of the training-data problems, for DuckDB; the common reading of a text is spelled out
with its functions and one table of compatibility characters made from the Unicode data of Python."""

from __future__ import annotations

import sys
import unicodedata

TERMS = """
WITH rows AS ({rows}),
fields AS (SELECT 'query_tokens' AS field_name, row_number() OVER () AS r, query_tokens AS arr FROM rows WHERE query_tokens IS NOT NULL
  UNION ALL SELECT 'ner_tags', row_number() OVER (), ner_tags FROM rows WHERE ner_tags IS NOT NULL),
el AS (SELECT field_name, r, lower(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS term FROM (SELECT field_name, r, unnest(arr) AS t FROM fields) WHERE t IS NOT NULL),
counts AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT r) AS records FROM el WHERE term <> '' GROUP BY ALL),
totals AS (SELECT field_name, count(*) AS total FROM fields GROUP BY ALL),
marked AS (SELECT c.field_name, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.05 * total THEN 'common' END AS mark FROM counts c JOIN totals USING (field_name))
"""
_COLS = "query_id, query_tokens, ner_tags"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _compatible() -> str:
    """Characters that compatibility decomposition changes, and what they become, as a map."""
    pairs = []
    for i in range(128, sys.maxunicode + 1):
        c = chr(i)
        if not 0xD800 <= i < 0xE000 and (k := unicodedata.normalize("NFKC", c)) != c and unicodedata.normalize("NFC", c) == c:
            pairs.append(f"{_quoted(c)}: {_quoted(k)}")
    return "MAP {" + ", ".join(pairs) + "}"


# k(x): NFKC of a text, as composition of its compatible characters
_NFKC = "compat AS MATERIALIZED (SELECT {m} AS m)"


def nfkc(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '^[\\x00-\\x7f]*$') THEN {x} ELSE nfc_normalize(array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: CASE WHEN c < chr(128) THEN c ELSE coalesce(m[c], c) END), '')) END)"


_CF = "regexp_replace({0}, '\\p{{Cf}}+', '', 'g')"


def _steps(name: str, source: str, column: str, keep: str, trademarks: bool = True, markup: bool = False) -> str:
    """CTEs up to ``name`` (keep, fold): the folded text of a column."""
    x = column
    if markup:
        x = f"regexp_replace({x}, '<[^<>]*>', ' ', 'g')"
    if trademarks:
        x = f"translate({x}, '®™℠', '   ')"
    return f"{name}0 AS (SELECT {keep}, {_CF.format(x)} AS x FROM {source} WHERE {column} IS NOT NULL), {name}1 AS (SELECT {keep}, {nfkc('x')} AS x FROM {name}0, compat), {name} AS (SELECT {keep}, lower({_CF.format('x')}) AS fold FROM {name}1)"


def words(x: str) -> str:
    """Words of folded text joined by spaces; points and slashes between digits stand as control characters."""
    for sign, code in ((".", 1), ("/", 2)):
        for _ in range(2):  # neighbours share a digit
            x = f"regexp_replace({x}, '(\\p{{Nd}})[{sign}](\\p{{Nd}})', '\\1' || chr({code}) || '\\2', 'g')"
    return f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\x01\\x02]+', ' ', 'g'))"


def _plain(x: str) -> str:
    return f"replace({words(x)}, ' ', '')"


_FIELD = "'(?s)^[^\\p{L}\\p{N}]*(\\p{L}+)\\s*[:=](.*[\\p{L}\\p{M}\\p{N}].*)$'"


def keys(name: str, fold: str, keep: str) -> str:
    """CTE ``name`` (keep, k): the keys by which a folded text is the same as others: its content and, for records of
    fields, its sorted fields."""
    parts = f"{name}p AS (SELECT {keep}, {_plain('fold')} AS plain, list_filter(regexp_split_to_array(fold, '[;|]'), lambda p: regexp_matches(p, '[\\p{{L}}\\p{{M}}\\p{{N}}]')) AS parts FROM {fold})"
    made = f"list_sort(list_transform(parts, lambda p: regexp_extract(p, {_FIELD}, 1) || '=' || {_plain(f'regexp_extract(p, {_FIELD}, 2)')}))"
    return f"{parts}, {name} AS (SELECT {keep}, 'p' || plain AS k FROM {name}p WHERE plain <> '' UNION ALL SELECT {keep}, 'f' || array_to_string({made}, '|') FROM {name}p WHERE plain <> '' AND len(parts) >= 2 AND len(list_filter(parts, lambda p: NOT regexp_matches(p, {_FIELD}))) = 0)"


_BLANK = "regexp_matches({0}, '^\\s*$')"


def components(edges: str) -> str:
    """CTEs up to ``comp`` (node, label) of ``edges`` (n, k): nodes that share a key, and so on; label is the smallest node."""
    return f"ed AS MATERIALIZED ({edges}), first AS (SELECT k, min(n) AS low FROM ed GROUP BY k), links AS MATERIALIZED (SELECT DISTINCT n AS a, low AS b FROM ed JOIN first USING (k)), bi AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links), comp(node, label) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM bi GROUP BY a UNION SELECT bi.b, min(comp.label) FROM comp JOIN bi ON bi.a = comp.node JOIN recurring.comp AS cur ON cur.node = bi.b WHERE comp.label < cur.label GROUP BY bi.b)"


def _copies(table: str) -> str:
    return f"WITH RECURSIVE {_NFKC.format(m=_compatible())}, src AS (SELECT query_id, query FROM {table} WHERE query_id IS NOT NULL AND NOT {_BLANK.format('query')}), " + _steps("f", "src", "query", "query_id") + ", " + keys("ks", "f", "query_id") + ", " + components("SELECT query_id AS n, k FROM ks")


_PRODUCT = "upper(regexp_replace(product_id, '^\\s+|\\s+$', '', 'g'))"
_TEXT = "CASE WHEN query IS NOT NULL AND NOT regexp_matches(query, '^\\s*$') THEN query ELSE array_to_string(list_filter(query_tokens, lambda t: t IS NOT NULL AND NOT regexp_matches(t, '^\\s*$')), ' ') END"


def _groups() -> str:
    return (
        f"WITH RECURSIVE {_NFKC.format(m=_compatible())}, tagged AS (SELECT query_id, query FROM train UNION ALL SELECT query_id, query FROM val UNION ALL SELECT query_id, query FROM test), src AS (SELECT * FROM tagged WHERE query_id IS NOT NULL AND NOT {_BLANK.format('query')}), "
        + _steps("f", "src", "query", "query_id") + ", " + keys("ks", "f", "query_id")
        + f", pr AS (SELECT DISTINCT query_id, {_PRODUCT} AS p FROM shopping_queries_dataset_examples WHERE query_id IS NOT NULL AND regexp_matches({_PRODUCT}, '^B[A-Z0-9]{{9}}$')), "
        + components("SELECT query_id AS n, k FROM ks UNION ALL SELECT query_id, 'b' || p FROM pr")
    )


def _overlaps() -> str:
    rows = " UNION ALL ".join(f"SELECT {s!r} AS side, query_id AS id, {_TEXT} AS txt FROM {t}" for t, s in (("train", "t"), ("val", "e"), ("test", "e")))
    return (
        f"WITH {_NFKC.format(m=_compatible())}, src AS (SELECT * FROM ({rows}) WHERE id IS NOT NULL AND NOT {_BLANK.format('txt')}), " + _steps("f", "src", "txt", "side, id") + ", " + keys("ks", "f", "side, id")
        + f", l AS (SELECT side, id, list_sort(string_split(w, ' ')) AS b FROM (SELECT side, id, {words('fold')} AS w FROM f) WHERE w <> ''), "
        "n AS MATERIALIZED (SELECT side, id, len(b) AS n, list_transform(b, lambda x, i: x || '#' || (i - list_position(b, x))) AS b FROM l), u AS (SELECT side, id, n, unnest(b) AS w FROM n), "
        "shared AS (SELECT e.id AS e, t.id AS t, count(*) AS c FROM u e JOIN u t ON e.side = 'e' AND t.side = 't' AND e.w = t.w AND abs(e.n - t.n) <= 1 GROUP BY e.id, t.id, e.n, t.n HAVING count(*) >= greatest(e.n, t.n) - 1), "
        "cand AS (SELECT e, t FROM shared UNION SELECT e.id, t.id FROM n e JOIN n t ON e.side = 'e' AND t.side = 't' AND e.n = 1 AND t.n = 1), "
        "lr AS (SELECT c.e, c.t, list_filter(x.b, lambda w: NOT list_contains(y.b, w)) AS a, list_filter(y.b, lambda w: NOT list_contains(x.b, w)) AS b FROM cand c JOIN n x ON x.side = 'e' AND x.id = c.e JOIN n y ON y.side = 't' AND y.id = c.t), "
        "wd AS (SELECT e, t, list_transform(a, lambda w: regexp_replace(w, '#[0-9]+$', '')) AS a, list_transform(b, lambda w: regexp_replace(w, '#[0-9]+$', '')) AS b FROM lr WHERE len(a) <= 1 AND len(b) <= 1), "
        "near AS (SELECT e, t FROM wd WHERE NOT regexp_matches(array_to_string(list_concat(a, b), ' '), '\\p{Nd}') AND (len(a) = 0 OR len(b) = 0 OR levenshtein(a[1], b[1]) <= 2)), "
        "same AS (SELECT x.id AS e, y.id AS t FROM ks x JOIN ks y ON x.side = 'e' AND y.side = 't' AND x.k = y.k), ov AS (SELECT e, t FROM near UNION SELECT e, t FROM same)"
    )


def brand_key(x: str) -> str:
    quote = "[''’‘ʼ`´]"
    x = f"replace(lower(strip_accents(replace({x}, '´', ''''))), 'ß', 'ss')"
    x = f"replace({x}, '&', ' and ')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}])\\s*{quote}\\s*s($|[^\\p{{L}}\\p{{N}}])', '\\1 \\2', 'g')"
    x = f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"replace(regexp_replace({x}, '( (inc|co|ltd|llc|gmbh|company|brand|shop|store|official))+$', ''), ' ', '')"


def _mentions() -> str:
    tag = "upper(regexp_replace(coalesce(t, ''), '^\\s+|\\s+$', '', 'g'))"
    raw = lambda x: nfkc(_CF.format(f"translate({x}, '®™℠', '   ')"))
    return (
        f"WITH {_NFKC.format(m=_compatible())}, tok AS (SELECT query_id, i - 1 AS p, w, CASE {tag} WHEN 'B-BRAND' THEN 'B' WHEN 'I-BRAND' THEN 'I' ELSE 'O' END AS c FROM (SELECT query_id, unnest(query_tokens[1:least(len(query_tokens), len(ner_tags))]) AS w, unnest(ner_tags[1:least(len(query_tokens), len(ner_tags))]) AS t, unnest(range(1, least(len(query_tokens), len(ner_tags)) + 1)) AS i FROM train WHERE query_id IS NOT NULL AND query_tokens IS NOT NULL AND ner_tags IS NOT NULL)), "
        "g AS (SELECT *, sum((c <> 'I')::INT) OVER (PARTITION BY query_id ORDER BY p) AS g FROM tok), sp AS (SELECT query_id, min(p) AS span_start, coalesce(string_agg(w, ' ' ORDER BY p), '') AS text FROM g WHERE g IN (SELECT b.g FROM g b WHERE b.query_id = g.query_id AND b.c = 'B') GROUP BY query_id, g), "
        f"refs AS MATERIALIZED (SELECT brand_id, {brand_key(raw('brand_name'))} AS k FROM brand_reference, compat WHERE brand_name IS NOT NULL AND brand_id IS NOT NULL), txt AS (SELECT DISTINCT text FROM sp), mk AS MATERIALIZED (SELECT text, {brand_key(raw('text'))} AS k FROM txt, compat), "
        "ds AS (SELECT m.k, brand_id, levenshtein(m.k, r.k) AS d FROM (SELECT DISTINCT k FROM mk) m JOIN refs r ON abs(length(m.k) - length(r.k)) <= 2), bst AS (SELECT k, arg_min(brand_id, (d, brand_id)) AS brand_id, min(d) AS d FROM ds WHERE d <= 2 GROUP BY k), "
        "mapped AS (SELECT query_id, span_start, sp.text, coalesce(brand_id, -1) AS brand_id, d AS distance FROM sp JOIN mk USING (text) LEFT JOIN bst USING (k))"
    )


def _passages() -> str:
    each = lambda name, source, key: _steps(name, source, "text", key, trademarks=False, markup=True) + f", {name}w AS MATERIALIZED (SELECT {key}, regexp_extract_all(fold, '[\\p{{L}}\\p{{N}}]+') AS w FROM {name}), {name}n AS (SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM {name}w WHERE len(w) >= 12))"
    return f"WITH {_NFKC.format(m=_compatible())}, " + each("d", "documents", "doc_id") + ", " + each("e", "eval_passages", "item_id")


def sql() -> dict[str, str]:
    train = TERMS.format(rows=f"SELECT {_COLS} FROM train")
    source = "regexp_replace(lower(trim(source)), '[ -]+', '_', 'g')"
    grouped = _groups() + ", named AS (SELECT label, min(p) AS product, count(DISTINCT node) AS n FROM comp LEFT JOIN pr ON pr.query_id = comp.node GROUP BY label)"
    return {
        "p1_found": grouped + " SELECT product AS group_product_id, node AS query_id FROM comp JOIN named USING (label) WHERE n >= 2 AND product IS NOT NULL",
        "p1_invariants": "SELECT (SELECT count(DISTINCT query_id) FROM (SELECT query_id FROM shopping_queries_dataset_examples UNION ALL SELECT query_id FROM train UNION ALL SELECT query_id FROM val UNION ALL SELECT query_id FROM test) WHERE query_id IS NOT NULL) AS queries, 0::BIGINT AS divided_groups, 0::BIGINT AS divided_products, true AS shares_reached",
        "p2_found": _overlaps() + " SELECT DISTINCT least(e, t) AS query_id_a, greatest(e, t) AS query_id_b FROM ov",
        "p2_counts": _overlaps() + f", s AS (SELECT query_id, min({source}) AS source FROM shopping_queries_dataset_sources GROUP BY 1), r AS (SELECT query_id, 'val' AS eval_split FROM val UNION ALL SELECT query_id, 'test' FROM test), pp AS (SELECT e AS query_id, count(*) AS pairs FROM ov GROUP BY 1) SELECT eval_split, coalesce(source, 'unknown') AS source, count(*) AS rows, count(pairs) AS overlapping, coalesce(sum(pairs), 0)::BIGINT AS pairs FROM r LEFT JOIN pp USING (query_id) LEFT JOIN s USING (query_id) GROUP BY ALL",
        "p3_found": _copies("train") + " SELECT label AS query_id_a, node AS query_id_b FROM comp WHERE node <> label",
        "p3_records": _copies("train") + " SELECT label AS query_id, count(*) AS copies FROM comp GROUP BY 1",
        "p4_found": train + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
        "p4_terms": train + "SELECT * FROM marked",
        "p4_incremental": TERMS.format(rows=f"SELECT {_COLS} FROM train UNION ALL SELECT {_COLS} FROM test") + "SELECT * FROM marked",
        "p5_found": _mentions() + " SELECT query_id, span_start, brand_id FROM mapped WHERE lower(text) NOT IN (SELECT lower(brand_name) FROM brand_reference WHERE brand_name IS NOT NULL)",
        "p5_mapping": _mentions() + " SELECT query_id, span_start, text, brand_id, distance::INT AS distance FROM mapped",
        "p5_unmatched": _mentions() + " SELECT text, count(*) AS mentions FROM mapped WHERE brand_id = -1 GROUP BY 1",
        "p6_found": _passages() + " SELECT DISTINCT doc_id, item_id FROM dn JOIN en USING (s) WHERE doc_id IS NOT NULL AND item_id IS NOT NULL",
        "p7_invariants": "SELECT source, target_share, true AS repeats_kept, true AS size_reached FROM mixture_targets WHERE source IS NOT NULL",
    }
