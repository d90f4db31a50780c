"""Queries of the training-data problems: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import brands, leaks, mixture, oracles, overlap, runs, splits, terms, toxicity
from quernstone.session import materialize, spread, table

EXAMPLES, SOURCES = "shopping_queries_dataset_examples", "shopping_queries_dataset_sources"


def _tagged(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("train", "val", "test")]


def _p1_split(spark, d):
    return splits.stratified_split(splits.query_groups(table(spark, d, EXAMPLES), _tagged(spark, d)))


def p1_found(spark, d):
    return splits.found_groups(_p1_split(spark, d))


def p1_assignment(spark, d):
    return _p1_split(spark, d).select("query_id", "grp", "split")


def p1_groups(spark, d):
    return _p1_split(spark, d).groupBy("grp", "split").agg(F.sum("n").alias("queries"), *[F.sum(x).alias(f"queries_{x.lower()}") for x in splits.LABELS])


def p1_shares(spark, d):
    return splits.shares(materialize(_p1_split(spark, d), "split")[0])


def p1_invariants(spark, d):
    """What every assignment must keep: all queries once, no group and no judged product in two splits, and shares of all
    queries and of every label within two in a hundred of their targets."""
    split = materialize(_p1_split(spark, d), "split")[0]
    groups = split.groupBy("grp").agg(F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("divided_groups"))
    judged = table(spark, d, EXAMPLES).select("query_id", splits.product_id(F.col("product_id")).alias("p")).where("p is not null").join(split.select("query_id", "split"), "query_id")
    products = judged.groupBy("p").agg(F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("divided_products"))
    reached = splits.shares(split).agg(F.bool_and(F.abs(F.col("share") - F.col("target")) <= 0.02).alias("shares_reached"))
    return split.agg(F.count("*").alias("queries")).crossJoin(groups).crossJoin(products).crossJoin(reached)  # one row each


def _eval_rows(spark, d, *extra):
    val, test = (table(spark, d, t).select("query_id", "query", "query_tokens", F.lit(t).alias("eval_split")) for t in ("val", "test"))
    return val.unionByName(test)


def _overlaps(spark, d):
    return overlap.overlaps(overlap.texts(table(spark, d, "train")), overlap.texts(_eval_rows(spark, d)))


def p2_found(spark, d):
    return _overlaps(spark, d).select(F.least("eval_id", "train_id").alias("query_id_a"), F.greatest("eval_id", "train_id").alias("query_id_b")).distinct()


def p2_counts(spark, d):
    """Per evaluation split and source: all rows, those that overlap train, and the pairs. A query of several sources
    counts under the first by name; unknown sources are one group."""
    source = F.regexp_replace(F.lower(F.trim("source")), "[ -]+", "_")
    sources = table(spark, d, SOURCES).groupBy("query_id").agg(F.min(source).alias("source"))
    per_row = overlap.overlap_counts(overlap.texts(table(spark, d, "train")), overlap.texts(_eval_rows(spark, d))).withColumnRenamed("eval_id", "query_id")
    rows = _eval_rows(spark, d).select("query_id", "eval_split").join(per_row, "query_id", "left").join(sources, "query_id", "left")
    return rows.groupBy("eval_split", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("rows"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def p3_found(spark, d):
    copies = runs.format_copies(table(spark, d, "train"), "query_id", "query")
    return copies.where("id <> rep").select(F.col("rep").alias("query_id_a"), F.col("id").alias("query_id_b"))


def p3_records(spark, d):
    """One row per record of train with a representative and its number of copies."""
    counts = runs.copy_counts(table(spark, d, "train"), "query_id", "query")
    return counts.select(F.col("rep").alias("query_id"), "copies")


def p4_found(spark, d):
    return p4_terms(spark, d).where("mark is not null").select("field_name", "term", "mark")


def p4_terms(spark, d):
    """Every term of train with its exact occurrences, records and mark: a store that was loaded with most of train and with
    val, and is brought to train by the changes."""
    return terms.table_terms(table(spark, d, "train"), table(spark, d, "val"))


def p4_incremental(spark, d):
    """A store that held train and val and is brought to train and test by the changes alone: val's rows go, test's come."""
    train, val, test = (table(spark, d, t).select("query_id", *terms.FIELDS) for t in ("train", "val", "test"))
    store = terms.TermStore(spark)
    store.merge(terms.term_changes(train.unionByName(val), None))
    added, deleted = terms.changed_rows(train.unionByName(val), train.unionByName(test), "query_id")
    store.merge(terms.term_changes(added, deleted))
    return terms.marked(store.counts())


def _brand_spans(spark, d):
    train = table(spark, d, "train").where("query_id is not null").select("query_id", "query_tokens", "ner_tags")
    return brands.spans(train, "query_id", "query_tokens", "ner_tags", "BRAND"), table(spark, d, "brand_reference").select("brand_id", "brand_name")


def p5_found(spark, d):
    found, reference = _brand_spans(spark, d)
    mapped = brands.map_spans(brands.spelled_otherwise(found, reference), reference)
    return mapped.select(F.col("id").alias("query_id"), "span_start", F.col("entry").alias("brand_id"))


def p5_mapping(spark, d):
    """Every brand mention of train with its entry, or -1, and its distance."""
    found, reference = _brand_spans(spark, d)
    return brands.map_spans(found, reference).select(F.col("id").alias("query_id"), "span_start", "text", F.col("entry").alias("brand_id"), "distance")


def p5_unmatched(spark, d):
    """The spellings of train that no entry is near, with their number of mentions."""
    return p5_mapping(spark, d).where("brand_id = -1").groupBy("text").agg(F.count("*").alias("mentions"))


def _leaks(spark, d):
    return leaks.leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_passages").select("item_id", "text"))


def p6_found(spark, d):
    return _leaks(spark, d).where((F.col("edits") == 0) & (F.col("item_words") >= leaks.WINDOW)).select("doc_id", "item_id")


def p6_leaks(spark, d):
    """All leaks, also those with up to two word edits in twelve words."""
    return _leaks(spark, d)


def p6_items(spark, d):
    """Per test item: in how many documents it leaked."""
    return leaks.leaked_items(_leaks(spark, d), table(spark, d, "eval_passages").select("item_id", "eval_split"))


def _mix(spark, d):
    return mixture.mix(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mixture_targets"))


def p7_selection(spark, d):
    """The documents of the mixture with their tokens and copies."""
    return _mix(spark, d)[0]


def p7_report(spark, d):
    """Per source: wanted and reached tokens and share, repeats, and what fell short; the total size is in every row."""
    return _mix(spark, d)[1]


def p7_invariants(spark, d):
    """What every mixture must keep, per target source: no document more often than allowed, and the wanted size reached to
    within its largest document, or all that the allowed repeats give."""
    selection, report = _mix(spark, d)
    largest = selection.groupBy("source").agg(F.max("tokens").alias("largest"), F.max("copies").alias("most"))
    rows = report.where("max_repeats > 0").join(largest, "source", "left")
    within = F.abs(F.col("wanted_tokens") - F.col("tokens")) <= 2 * F.col("largest")
    full = F.col("tokens") == F.col("own_tokens") * F.col("max_repeats")
    kept = F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True))
    return rows.select("source", "target_share", kept.alias("repeats_kept"), F.coalesce(within | full, F.col("own_tokens") == 0).alias("size_reached"))


def p8_scores(spark, d):
    """Every document with its score and the offsets of its abusive spans."""
    documents = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    tagger = toxicity.train(toxicity.labelled_sample(documents.select("doc_id", "text"), table(spark, d, "doc_labels")))
    return toxicity.score(documents, tagger)


def p8_found(spark, d):
    return p8_scores(spark, d).where(F.col("score") > toxicity.THRESHOLD).select("doc_id").distinct()


def p8_rates(spark, d):
    """Per source: documents, those found abusive, and the rate."""
    flagged = p8_scores(spark, d).groupBy(mixture.source_name(F.col("source")).alias("source")).agg(F.count("*").alias("documents"), F.count_if(F.col("score") > toxicity.THRESHOLD).alias("abusive"))
    return flagged.withColumn("rate", F.col("abusive") / F.col("documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL that says the same; the other problems' queries are held against brute force in tests/llm."""
    return oracles.sql()
