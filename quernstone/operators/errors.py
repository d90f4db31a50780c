"""Error analysis over paired tag sequences (query_id, tokens, gold_tags, pred_tags)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import length_bin
from quernstone.operators import spans as S
from quernstone.operators.metrics import coarse_gain, prf, ratio, span_prf
from quernstone.schema import COARSE, coarse_tag, tag_type


def token_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row a token: query_id, pos, token, gold, pred; arrays end with the shortest."""
    n = F.least(F.size("tokens"), F.size("gold_tags"), F.size("pred_tags"))
    part = lambda c: F.slice(F.col(c), F.lit(1), n)
    zipped = F.arrays_zip(part("tokens").alias("token"), part("gold_tags").alias("gold"), part("pred_tags").alias("pred"))
    return df.select("query_id", *keep, F.posexplode(zipped).alias("pos", "x")).select("query_id", *keep, "pos", "x.*")


def confusion(rows: DataFrame, normalize: str | None = "true") -> DataFrame:
    """(gold, pred, n, value) over the full grid of labels, missing cells 0; normalised by row (true), column (pred), all or not."""
    counts = rows.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    labels = counts.select(F.col("gold").alias("l")).union(counts.select("pred")).distinct()
    grid = labels.select(F.col("l").alias("gold")).crossJoin(labels.select(F.col("l").alias("pred")))  # labels of the tag set only
    full = grid.join(counts, ["gold", "pred"], "left").na.fill(0, ["n"])
    if normalize is None:
        return full.withColumn("value", F.col("n").cast("double"))
    by = {"true": ["gold"], "pred": ["pred"], "all": [F.lit(1)]}[normalize]
    return full.withColumn("value", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*by))))


def error_kind() -> Column:
    """fp, fn or confusion of a token, null where the tags agree."""
    g, p = F.col("gold"), F.col("pred")
    return F.when(g == p, None).when(g == "O", "fp").when(p == "O", "fn").otherwise("confusion")


def common_errors(rows: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent (token, gold, pred) of each error kind; equals by key."""
    counts = rows.withColumn("kind", error_kind()).where("kind is not null").groupBy("kind", "token", "gold", "pred").agg(F.count("*").alias("n"))
    return top(counts, ["kind"], n, "token", "gold", "pred")


def top(counts: DataFrame, by: list[str], n: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*by or [F.lit(1)]).orderBy(F.desc("n"), *keys)
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def type_confusion(rows: DataFrame, n: int = 20) -> DataFrame:
    """Pairs of different types where both tags are entities."""
    t = rows.select(tag_type(F.col("gold")).alias("g"), tag_type(F.col("pred")).alias("p")).where("g <> '' and p <> '' and g <> p")
    return top(t.groupBy(F.concat("g", F.lit("->"), "p").alias("pair")).agg(F.count("*").alias("n")), [], n, "pair")


def by_length(df: DataFrame) -> DataFrame:
    """Lenient micro metrics per bin of the token count, with the number of queries."""
    binned = df.withColumn("bin", length_bin(F.size("tokens")))
    sizes = binned.groupBy("bin").agg(F.count("*").alias("queries"))
    return _with_all(span_prf(binned, ["bin"], S.LENIENT), sizes, "bin")


def _with_all(metrics: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    m = ["gold_spans", "pred_spans", "matched", "precision", "recall", "f1"]
    return sizes.join(metrics.where("entity_type = 'ALL'").select(by, *m), by, "left").na.fill(0, m)


def gold_types(tags: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(tags, lambda t: t.startswith("B-")), tag_type))


def multi_attribute(df: DataFrame) -> DataFrame:
    """Lenient micro metrics of queries with more than one gold type and of the others."""
    grouped = df.withColumn("grp", F.when(F.size(gold_types(F.col("gold_tags"))) > 1, "multi").otherwise("single"))
    return _with_all(span_prf(grouped, ["grp"], S.LENIENT), grouped.groupBy("grp").agg(F.count("*").alias("queries")), "grp")


def type_counts(df: DataFrame) -> DataFrame:
    """(entity_type, n): gold B- tags."""
    return df.select(F.explode("gold_tags").alias("t")).where(F.col("t").startswith("B-")).groupBy(tag_type(F.col("t")).alias("entity_type")).agg(F.count("*").alias("n"))


def rarity(df: DataFrame, rare: int = 5, common: int = 50) -> DataFrame:
    """Types with their counts and class: rare up to ``rare``, common from ``common`` on, else neither."""
    return type_counts(df).withColumn("class", F.when(F.col("n") <= rare, "rare").when(F.col("n") >= common, "common").otherwise("neither"))


def rarity_gain(df: DataFrame) -> DataFrame:
    """Coarse gain of queries with a rare type and with a common one; rare is below the upper median count. A query of both
    counts in both."""
    counts = type_counts(df)
    cut = counts.agg(F.array_sort(F.collect_list("n")).alias("v")).select(F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("cut"))
    rare = counts.crossJoin(cut).groupBy().agg(F.collect_set(F.when(F.col("n") < F.col("cut"), F.col("entity_type"))).alias("rare_types"), F.collect_set(F.when(F.col("n") >= F.col("cut"), F.col("entity_type"))).alias("common_types"))
    both = df.crossJoin(F.broadcast(rare))  # one row
    has = lambda c: F.arrays_overlap(gold_types(F.col("gold_tags")), c)
    flagged = both.withColumn("grp", F.explode(F.array_compact(F.array(F.when(has("rare_types"), "rare"), F.when(has("common_types"), "common")))))
    return coarse_gain(flagged, ["grp"])


def fp_fn(rows: DataFrame) -> DataFrame:
    """Per type and token, prefixes aside: right, false and missed; a wrong type is missed for one and false for the other."""
    t = rows.select(tag_type(F.col("gold")).alias("g"), tag_type(F.col("pred")).alias("p"))
    kind = lambda ty, tp, fp, fn: F.struct(ty.alias("entity_type"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn"))
    hits = F.when(F.col("g") == F.col("p"), F.array(kind(F.col("g"), 1, 0, 0))).otherwise(F.array(kind(F.col("g"), 0, 0, 1), kind(F.col("p"), 0, 1, 0)))
    return t.select(F.explode(hits).alias("x")).select("x.*").where("entity_type <> ''").groupBy("entity_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def one_type(rows: DataFrame, name: str = "COLOR") -> DataFrame:
    """Token-level figures of one type, prefixes aside."""
    g, p = F.contains("gold", F.lit(name)), F.contains("pred", F.lit(name))
    c = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return c.select("*", *prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")))


def one_type_lists(rows: DataFrame, name: str = "COLOR", n: int = 20) -> DataFrame:
    """The n most frequent cases of each list around one type: tokens of it that were missed, those that became another
    entity (with its tag), and others taken for it (with their true tag). Tokens in lower case; equals by token and tag."""
    g, p = F.contains("gold", F.lit(name)), F.contains("pred", F.lit(name))
    case = F.when(g & ~p, F.when(F.col("pred") == "O", "missed").otherwise("confusion")).when(~g & p, "hallucinated")
    tag = F.when(case == "missed", "").when(case == "confusion", F.col("pred")).otherwise(F.col("gold"))
    counts = rows.select(case.alias("list"), F.lower("token").alias("token"), tag.alias("tag")).where("list is not null").groupBy("list", "token", "tag").agg(F.count("*").alias("n"))
    return top(counts, ["list"], n, "token", "tag")


def sparsity(rows: DataFrame, below: int = 1000) -> DataFrame:
    """Per type with a gold B- tag, and PRODUCT for all of them: its number of B- tags and figures over whole tags, where a
    token of the type with another tag is missed for one and false for the other; PRODUCT compares tags made coarse.
    ``is_rare`` where a type has fewer B- tags than ``below``."""

    def of(g: Column, p: Column, gold: Column, pred: Column) -> DataFrame:
        t = rows.select(g.alias("g"), p.alias("p"), (gold == pred).cast("int").alias("same"), gold.startswith("B-").cast("int").alias("b"))
        kind = lambda ty, b, tp, pr, go: F.struct(ty.alias("entity_type"), b.alias("count"), tp.alias("tp"), F.lit(pr).alias("predicted"), F.lit(go).alias("gold"))
        parts = F.array(kind(F.col("g"), F.col("b"), F.col("same"), 0, 1), kind(F.col("p"), F.lit(0), F.lit(0), 1, 0))
        return t.select(F.explode(parts).alias("x")).select("x.*").where("entity_type <> ''").groupBy("entity_type").agg(*[F.sum(c).alias(c) for c in ("count", "tp", "predicted", "gold")])

    gold, pred = F.col("gold"), F.col("pred")
    coarse = lambda c: F.when(tag_type(c) == "", "").otherwise(COARSE)
    both = of(tag_type(gold), tag_type(pred), gold, pred).where("count > 0").unionByName(of(coarse(gold), coarse(pred), coarse_tag(gold), coarse_tag(pred)))
    return both.select("entity_type", "count", "tp", "predicted", "gold", *prf(F.col("tp"), F.col("predicted"), F.col("gold")), ((F.col("entity_type") != COARSE) & (F.col("count") < below)).alias("is_rare"))


def sparsity_summary(table: DataFrame) -> DataFrame:
    """One row from :func:`sparsity`: mean F1 of the rare and of the common types, the coarse F1 and both lists of types."""
    fine, rare = F.col("entity_type") != COARSE, F.col("is_rare")
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("f1"))), F.lit(0.0))
    types = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("entity_type"))))
    return table.agg(mean(fine & rare).alias("avg_rare_f1"), mean(fine & ~rare).alias("avg_common_f1"), mean(~fine).alias("coarse_f1"), types(fine & rare).alias("rare_types"), types(fine & ~rare).alias("common_types"))


BUCKETS = {"fp": "false_positive", "fn": "false_negative", "confusion": "wrong_type"}


def error_buckets(rows: DataFrame) -> DataFrame:
    """(error_type, n, rate): tokens of each of the three kinds of error and of all, with their share of all tokens in percent."""
    named = F.coalesce(*[F.when(error_kind() == k, v) for k, v in BUCKETS.items()])
    counts = rows.agg(F.count("*").alias("tokens"), *[F.count_if(named == v).alias(v) for v in BUCKETS.values()])
    every = counts.withColumn("total", sum((F.col(v) for v in BUCKETS.values()), F.lit(0)))
    long = every.unpivot(["tokens"], [*BUCKETS.values(), "total"], "error_type", "n")
    return long.select("error_type", "n", (F.lit(100.0) * ratio(F.col("n"), F.col("tokens"))).alias("rate"))


def first_mismatches(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n queries, by id, whose predicted tags are not the gold ones; a shorter prediction differs."""
    return df.where(F.col("gold_tags") != F.col("pred_tags")).orderBy("query_id").limit(n)


def error_report(df: DataFrame) -> dict[str, DataFrame]:
    """All analyses of a set of predictions by their names; each is a plan of its own and runs when it is read."""
    rows = token_rows(df)
    return {
        "confusion_matrix": confusion(rows, "true"), "common_errors": common_errors(rows), "by_query_length": by_length(df), "by_entity_rarity": rarity(df), "fp_fn_by_entity": fp_fn(rows),
        "multi_attribute_analysis": multi_attribute(df), "color_ambiguity": one_type(rows), "color_lists": one_type_lists(rows),
    }


def tall(tables: dict[str, DataFrame]) -> DataFrame:
    """(section, name, metric, value): several result tables in one, the text columns of a row joined into its name."""
    out = None
    for section, t in tables.items():
        text, figures = [c for c, k in t.dtypes if k == "string"], [c for c, k in t.dtypes if k in ("int", "bigint", "double")]
        named = t.select(F.lit(section).alias("section"), F.concat_ws("|", *text).alias("name"), *[F.col(c).cast("double").alias(c) for c in figures])
        part = named.unpivot(["section", "name"], figures, "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


def error_flags(df: DataFrame) -> DataFrame:
    """Per query has_fp, has_fn, has_confusion, is_correct and the error types joined by commas."""
    pairs = F.zip_with(*S.cut("gold_tags", "pred_tags"), lambda g, p: F.when(g == p, "").when(g == "O", "FP").when(p == "O", "FN").otherwise("TYPE_CONFUSION"))
    out = df.withColumn("_k", pairs)
    flags = {"has_fp": "FP", "has_fn": "FN", "has_confusion": "TYPE_CONFUSION"}
    out = out.withColumns({c: F.array_contains("_k", k) for c, k in flags.items()})
    kinds = F.array_join(F.array_compact(F.array(*[F.when(F.col(c), k) for c, k in flags.items()])), ",")
    return out.withColumn("is_correct", ~(F.col("has_fp") | F.col("has_fn") | F.col("has_confusion"))).withColumn("error_types", kinds).drop("_k")


def qualitative(df: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """n queries to look at: a fifth right ones, the rest wrong, a third of these from each kind of error, filled up by others."""
    flagged = error_flags(df).withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("query_id").cast("string"))))
    n_right = n // 5
    third = (n - n_right) // 3
    picked = None
    for i, c in enumerate(("has_fp", "has_fn", "has_confusion")):
        part = flagged.where(c).orderBy("_h", "query_id").limit(third).withColumn("_o", F.lit(i))
        picked = part if picked is None else picked.unionByName(part)
    first = Window.partitionBy("query_id").orderBy("_o")
    picked = picked.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")  # n rows at most
    rest = flagged.where("not is_correct").join(picked.select("query_id"), "query_id", "left_anti").orderBy("_h", "query_id").limit(n - n_right).withColumn("_o", F.lit(3))
    wrong = picked.unionByName(rest.select(picked.columns)).orderBy("_o", "_h", "query_id").limit(n - n_right)
    right = flagged.where("is_correct").orderBy("_h", "query_id").limit(n_right).withColumn("_o", F.lit(4))
    return wrong.unionByName(right.select(picked.columns)).drop("_h", "_o")
