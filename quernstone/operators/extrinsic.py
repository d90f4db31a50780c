"""What tags are good for: slots, query understanding, attribute coverage, reformulation, agreement and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators import spans as S
from quernstone.operators.metrics import prf, ratio
from quernstone.schema import tag_type
from quernstone.session import materialize


def attributes(tags: str, tokens: str = "tokens") -> Column:
    """Array of struct(t, v): type and text of the attribute reading's spans, in order."""
    n = F.least(F.size(tokens), F.size(tags))
    spans = S.decode(F.slice(F.col(tags), F.lit(1), n), S.ATTRIBUTE)
    return F.transform(spans, lambda s: F.struct(s["entity_type"].alias("t"), F.array_join(F.slice(tokens, s["start"] + 1, s["end"] - s["start"] + 1), " ").alias("v")))


def slots(attrs: Column) -> Column:
    """Distinct (type, lower-case trimmed text)."""
    return F.array_distinct(F.transform(attrs, lambda a: F.struct(a["t"].alias("t"), F.lower(F.trim(a["v"])).alias("v"))))


def slot_prf(df: DataFrame) -> DataFrame:
    """Micro figures over the distinct slots of each query; both sides are in one row, so sets meet without a join."""
    s = df.select(slots(attributes("gold_tags")).alias("g"), slots(attributes("pred_tags")).alias("p"))
    c = s.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for x, n in ((F.size(F.array_intersect("g", "p")), "matched"), (F.size("p"), "predicted"), (F.size("g"), "gold"))])
    return c.select("*", *prf(F.col("matched"), F.col("predicted"), F.col("gold")))


def _values(attrs: str, kind: Column) -> Column:
    return F.transform(F.filter(attrs, lambda a: a["t"] == kind), lambda a: a["v"])


def understanding(df: DataFrame) -> DataFrame:
    """Share of queries whose attributes are exactly right (per type the ordered values, case kept; both empty is right) and of
    those with at least one gold type whose value set is right."""
    s = df.select(attributes("gold_tags").alias("g"), attributes("pred_tags").alias("p"))
    types = lambda c: F.array_distinct(F.transform(c, lambda a: a["t"]))
    exact = (F.array_sort(types("g")) == F.array_sort(types("p"))) & F.forall(types("g"), lambda t: _values("g", t) == _values("p", t))
    same_set = lambda t: F.array_sort(F.array_distinct(_values("g", t))) == F.array_sort(F.array_distinct(_values("p", t)))
    c = s.agg(F.count("*").alias("queries"), F.count_if(exact).alias("exact"), F.count_if(F.exists(types("g"), same_set)).alias("partial"))
    return c.select("*", ratio(F.col("exact"), F.col("queries")).alias("exact_rate"), ratio(F.col("partial"), F.col("queries")).alias("partial_rate"))


def coverage(df: DataFrame) -> DataFrame:
    """Per type and ALL: gold value occurrences, those among the predicted values of the type (any case), in percent."""
    s = df.select(attributes("gold_tags").alias("g"), slots(attributes("pred_tags")).alias("p"))
    rows = s.select(F.explode("g").alias("a"), "p").select(F.col("a.t").alias("entity_type"), F.exists("p", lambda x: (x["t"] == F.col("a.t")) & (x["v"] == F.lower(F.trim(F.col("a.v"))))).alias("hit"))
    counts = rows.groupBy("entity_type").agg(F.count("*").alias("total"), F.count_if("hit").alias("covered"))
    every = counts.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered")).withColumn("entity_type", F.lit("ALL"))
    return counts.unionByName(every).withColumn("coverage", F.lit(100.0) * ratio(F.col("covered"), F.col("total")))


def reformulation(df: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """Share of queries with metadata for which some value is in no predicted value of any type. ``metadata`` maps kinds to
    string columns; null and blank values are no metadata."""
    pred = F.transform(attributes("pred_tags"), lambda a: F.lower(a["v"]))
    values = F.filter(F.array(*[F.lower(F.trim(c)) for c in metadata.values()]), lambda v: v.isNotNull() & (v != ""))
    s = df.select(pred.alias("p"), values.alias("m")).where(F.size("m") > 0)
    missed = F.exists("m", lambda v: ~F.exists("p", lambda x: F.contains(x, v)))
    c = s.agg(F.count("*").alias("queries"), F.count_if(missed).alias("reformulated"))
    return c.withColumn("rate", F.lit(100.0) * ratio(F.col("reformulated"), F.col("queries")))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Token accuracy and Cohen's kappa of two labellings, one row a token. Kappa is null where chance agreement is 1."""
    counts = rows.groupBy(a, b).agg(F.count("*").alias("n"))  # as many rows as pairs of labels
    total = counts.agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agreed"))
    left, right = counts.groupBy(F.col(a).alias("l")).agg(F.sum("n").alias("na")), counts.groupBy(F.col(b).alias("l")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "l").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("both"))
    entity = counts.agg(F.sum(F.when(F.col(a) != "O", F.col("n")).otherwise(0)).alias("entity_a"), F.sum(F.when(F.col(b) != "O", F.col("n")).otherwise(0)).alias("entity_b"))
    one = total.crossJoin(chance).crossJoin(entity)  # one row each
    po, pe = ratio(F.col("agreed"), F.col("tokens")), ratio(F.col("both"), F.col("tokens").cast("double") * F.col("tokens"))
    return one.select("tokens", "agreed", "entity_a", "entity_b", po.alias("accuracy"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


# fixed values: what a kappa from so much on is called
KAPPA = ((0.8, "Almost perfect agreement"), (0.6, "Substantial agreement"), (0.4, "Moderate agreement"))


def kappa_bucket(kappa: Column) -> Column:
    return F.coalesce(*[F.when(kappa >= least, name) for least, name in KAPPA], F.lit("Fair/Slight agreement"))


def qa_report(df: DataFrame, tags: str) -> DataFrame:
    """One row: queries, tokens, entity tokens, their ratio, queries with an entity, and B- tags by type as a map."""
    c = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    entity = F.size(F.filter(c, lambda t: t != "O"))
    one = df.agg(F.count("*").alias("queries"), F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.sum(entity), F.lit(0)).cast("long").alias("entity_tokens"), F.count_if(entity > 0).alias("queries_with_entity")).withColumn("entity_ratio", ratio(F.col("entity_tokens"), F.col("tokens")))
    types = df.select(F.explode(c).alias("t")).where(F.col("t").startswith("B-")).groupBy(tag_type(F.col("t")).alias("k")).agg(F.count("*").alias("v"))
    return one.crossJoin(types.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("entity_counts")))  # one row each


def accuracy_by_type(rows: DataFrame, silver: str, corrected: str) -> DataFrame:
    """Full-tag accuracy per type of the silver tag, O as its own type."""
    kind = F.when(F.col(silver) == "O", "O").otherwise(F.substr(F.col(silver), F.lit(3)))
    return rows.groupBy(kind.alias("entity_type")).agg(F.count("*").alias("tokens"), F.avg((F.col(silver) == F.col(corrected)).cast("double")).alias("accuracy"))


def correction_rate(rows: DataFrame, silver: str, corrected: str) -> DataFrame:
    """One row: tokens, corrections made and their rate in percent, kappa and what it is called."""
    c = agreement(rows, silver, corrected)
    made = F.col("tokens") - F.col("agreed")
    return c.select("tokens", made.alias("corrections"), (F.lit(100.0) * ratio(made, F.col("tokens"))).alias("rate"), "kappa", kappa_bucket(F.col("kappa")).alias("interpretation"))


def correction_patterns(rows: DataFrame, silver: str, corrected: str, n: int = 20) -> DataFrame:
    """(silver_tag, corrected_tag, n): the n most frequent changes of a tag; equals by both tags."""
    changed = rows.where(F.col(silver) != F.col(corrected)).groupBy(F.col(silver).alias("silver_tag"), F.col(corrected).alias("corrected_tag")).agg(F.count("*").alias("n"))
    return changed.orderBy(F.desc("n"), "silver_tag", "corrected_tag").limit(n)


def types_of(rows: DataFrame, silver: str, corrected: str) -> DataFrame:
    """Token rows with types in place of tags, O as its own, for the confusion of types."""
    kind = lambda c: F.when(tag_type(F.col(c)) == "", F.col(c)).otherwise(tag_type(F.col(c)))
    return rows.select(kind(silver).alias("gold"), kind(corrected).alias("pred"))


def corrections(review: DataFrame) -> DataFrame:
    """(query_idx, corrected tags) from review rows (query_idx, pos, token, silver_tag, corrected_tag); an empty correction
    keeps the silver tag, rows without a token are separators."""
    tag = F.coalesce(F.nullif(F.trim("corrected_tag"), F.lit("")), F.col("silver_tag"))
    kept = review.where("token is not null and token <> ''")
    return kept.groupBy("query_idx").agg(F.array_sort(F.collect_list(F.struct("pos", tag.alias("t")))).alias("l")).select("query_idx", F.transform("l", lambda x: x["t"]).alias("corrected"))


def merge_corrections(df: DataFrame, fixed: DataFrame, tags: str, idx: str = "query_idx") -> DataFrame:
    """``df`` with corrected tags where there is a correction of the same length, plus ``was_corrected``. Unknown indexes and
    other lengths change nothing."""
    joined = df.join(fixed, idx, "left")
    takes = F.coalesce((F.size("corrected") == F.size(tags)) & (F.col("corrected") != F.col(tags)), F.lit(False))
    return joined.withColumn("was_corrected", takes).withColumn(tags, F.when(takes, F.col("corrected")).otherwise(F.col(tags))).drop("corrected")


def tag_distribution(df: DataFrame, tags: str) -> DataFrame:
    """(tag, n, fraction) over all tokens."""
    counts = df.select(F.explode(tags).alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # a row a tag


def imbalance(df: DataFrame, tags: str) -> DataFrame:
    """One row: tokens tagged O, tokens of entities, and the first over the second."""
    c = df.select(F.explode(tags).alias("t")).where("t is not null").agg(F.count_if(F.col("t") == "O").alias("outside"), F.count_if(F.col("t") != "O").alias("entity"))
    return c.withColumn("imbalance", ratio(F.col("outside"), F.col("entity")))


def entities_per_query(df: DataFrame, tags: str) -> DataFrame:
    """One row: mean, median and most B- tags and types of a query, and the queries without any."""
    b = F.filter(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: t.startswith("B-"))
    each = df.select(F.size(b).alias("n"), distinct_types(F.col(tags)).alias("types"))
    return each.agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("max"), F.count_if(F.col("n") == 0).alias("without"), F.max("types").alias("most_types"))


def distinct_types(tags: Column) -> Column:
    """Number of types with a B- tag in a query; null tags have none."""
    b = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.startswith("B-"))
    return F.size(F.array_distinct(F.transform(b, tag_type)))


def data_quality(df: DataFrame, text: str, tokens: str, tags: str) -> DataFrame:
    """One row: rows, repeated texts and rows whose tokens and tags are not of one length; a null array has length 0."""
    n = lambda c: F.greatest(F.size(c), F.lit(0))
    return df.agg(F.count("*").alias("rows"), (F.count(text) - F.countDistinct(text)).alias("duplicates"), F.count_if(~n(tokens).eqNullSafe(n(tags))).alias("misaligned"))


def dataset_summary(splits: dict[str, DataFrame], tokens: str, tags: str) -> DataFrame:
    """One row about all splits: samples in all and of each, mean tokens and B- tags of a query, and B- tags by type."""
    rows = None
    for name, df in splits.items():
        part = df.select(F.lit(name).alias("split"), F.col(tokens).alias("w"), F.filter(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: t.startswith("B-")).alias("b"))
        rows = part if rows is None else rows.unionByName(part)
    one = rows.agg(F.count("*").alias("total_samples"), *[F.count_if(F.col("split") == s).alias(f"{s}_samples") for s in splits], F.avg(F.greatest(F.size("w"), F.lit(0))).alias("avg_tokens_per_query"), F.avg(F.size("b")).alias("avg_entities_per_query"))
    types = rows.select(F.explode("b").alias("t")).groupBy(tag_type(F.col("t")).alias("k")).agg(F.count("*").alias("v"))
    return one.crossJoin(types.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("entity_span_counts")))  # one row each


SPECIAL = ("<PAD>", "<UNK>")


def vocabulary(df: DataFrame, tokens: str, order: list[str]) -> DataFrame:
    """(token, id): lower-case tokens in first-seen order after <PAD> 0 and <UNK> 1."""
    return _numbered(df.select(*order, F.posexplode(tokens).alias("pos", "raw")).where("raw is not null").select(F.lower("raw").alias("token"), F.struct(*order, "pos").alias("at")))


def characters(df: DataFrame, tokens: str, order: list[str]) -> DataFrame:
    """(token, id): the characters of the tokens, case kept, in first-seen order after <PAD> 0 and <UNK> 1."""
    words = df.select(*order, F.posexplode(tokens).alias("pos", "raw")).where("raw <> ''")
    each = words.select(*order, "pos", F.posexplode(F.split("raw", "")).alias("place", "token")).where("token <> ''")
    return _numbered(each.select("token", F.struct(*order, "pos", "place").alias("at")))


def _numbered(seen: DataFrame) -> DataFrame:
    """Numbers from 2 on by the first place: distinct tokens are laid out in ranges of places and counted there; a range's
    numbers start where the counts of the ranges before it end."""
    spark = seen.sparkSession
    first, _ = materialize(seen.groupBy("token").agg(F.min("at").alias("at")).repartitionByRange("at", "token").withColumn("part", F.spark_partition_id()), "vocabulary")
    sizes = first.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("part").orderBy("at", "token"))
    ids = first.withColumn("own", own).join(F.broadcast(before), "part").select("token", (F.col("before") + F.col("own") + len(SPECIAL) - 1).alias("id"))
    return ids.unionByName(spark.createDataFrame([(x, i) for i, x in enumerate(SPECIAL)], "token string, id long"))
