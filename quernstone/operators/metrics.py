"""Precision, recall and F1 over spans, tokens and slots; averages and summaries of metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators import spans as S
from quernstone.schema import coarse_tag
from quernstone.sources.files import markdown, training_time


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(matched: Column, predicted: Column, gold: Column) -> list[Column]:
    p, r = ratio(matched, predicted), ratio(matched, gold)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def paired(df: DataFrame, gold: str = "gold_tags", pred: str = "pred_tags") -> DataFrame:
    """Both tag columns cut to the shorter of the two."""
    g, p = S.cut(gold, pred)
    return df.withColumns({gold: g, pred: p})


def span_counts(df: DataFrame, by: list[str], decoder: str = S.STRICT, gold: str = "gold_tags", pred: str = "pred_tags") -> DataFrame:
    """(by, entity_type, gold_spans, pred_spans, matched) of paired sequences.

    Both sides' spans lie in one row, so a match is a set intersection inside the row; the only shuffle carries one
    partial sum per group and type. Column names in ``by`` come from ``df``.
    """
    key = lambda arr: F.transform(arr, lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end")))
    both = paired(df, gold, pred).select(*by, key(S.decode(F.col(gold), decoder)).alias("g"), key(S.decode(F.col(pred), decoder)).alias("p"))
    one = lambda arr, side: F.transform(arr, lambda s: F.struct(s["entity_type"].alias("entity_type"), F.lit(side).alias("side")))
    rows = both.select(*by, F.explode(F.concat(one(F.col("g"), "g"), one(F.col("p"), "p"), one(F.array_intersect("g", "p"), "m"))).alias("x")).select(*by, "x.*")
    count = lambda side: F.count_if(F.col("side") == side).cast("long")
    return rows.groupBy(*by, "entity_type").agg(count("g").alias("gold_spans"), count("p").alias("pred_spans"), count("m").alias("matched"))


def span_prf(df: DataFrame, by: list[str], decoder: str = S.STRICT, types: list[str] | None = None, **columns: str) -> DataFrame:
    """Per group and entity type, with the row ``ALL`` for the micro average; without groups there is that row even if there
    are no spans."""
    counts = span_counts(df, by, decoder, **columns)
    if types:
        counts = counts.where(F.col("entity_type").isin(types))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold_spans", "pred_spans", "matched")]
    every = counts.groupBy(*by).agg(*sums).withColumn("entity_type", F.lit("ALL"))
    both = counts.unionByName(every)
    return both.select(*by, "entity_type", "gold_spans", "pred_spans", "matched", *prf(F.col("matched"), F.col("pred_spans"), F.col("gold_spans")))


def to_coarse(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.transform(c, coarse_tag) for c in columns})


def coarse_gain(df: DataFrame, by: list[str], decoder: str = S.STRICT) -> DataFrame:
    """Fine and coarse micro F1 per group and what the coarse types gain."""
    fine = span_prf(df, by, decoder).where("entity_type = 'ALL'")
    coarse = span_prf(to_coarse(df, "gold_tags", "pred_tags"), by, decoder).where("entity_type = 'ALL'")
    pick = lambda x, name: x.select(*by, *[F.col(c).alias(f"{name}_{c}") for c in ("precision", "recall", "f1")])
    joined = pick(fine, "fine").join(pick(coarse, "coarse"), by) if by else pick(fine, "fine").crossJoin(pick(coarse, "coarse"))  # one row each
    return joined.select("*", *[(F.col(f"coarse_{c}") - F.col(f"fine_{c}")).alias(f"{c}_gain") for c in ("precision", "recall", "f1")])


def averages(per_type: DataFrame, by: list[str]) -> DataFrame:
    """Macro and support-weighted averages of per-type rows (precision, recall, f1, support)."""
    m = ("precision", "recall", "f1")
    return per_type.groupBy(*by).agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in m],
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in m],
        F.sum("support").cast("long").alias("support"),
    )


def seed_summary(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Mean and population deviation over repeated runs, formatted, with the values in run order."""
    v = F.col(value).cast("double")
    agg = rows.groupBy(*by).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std"), F.count(v).alias("n_seeds"), F.array_sort(F.collect_list(F.struct(order, v.alias("v")))).alias("runs"))
    return agg.select(*by, "mean", "std", F.format_string("%.4f ± %.4f", "mean", "std").alias("mean_std"), "n_seeds", F.array_join(F.transform("runs", lambda x: F.format_string("%.4f", x["v"])), "|").alias("values"))


def pivot(rows: DataFrame, index: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """Long to wide with the given column values; one value a cell, missing cells are null."""
    return rows.groupBy(*index).pivot(column, values).agg(F.first(value))


def unpivot_metrics(rows: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Wide to (ids, metric, value)."""
    return rows.unpivot(ids, columns, "metric", "value")


def describe(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, min, interpolated quartiles and max."""
    c = F.col(column)
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    agg = rows.groupBy(*(by or [])).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), q.alias("q"), F.max(c).alias("max"))
    return agg.select(*(by or []), "count", "mean", "std", "min", F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(1)).alias("p50"), F.get("q", F.lit(2)).alias("p75"), "max")


def spread(rows: DataFrame, column: str) -> DataFrame:
    """mean, interpolated median, greatest value and number of zeros."""
    c = F.col(column)
    return rows.agg(F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.max(c).alias("max"), F.count_if(c == 0).alias("zeros"))


def unique_count(rows: DataFrame, column: str) -> DataFrame:
    """Exact number of distinct non-null values."""
    return rows.agg(F.countDistinct(column).alias("unique"))


def upper_median(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """The element at half the length of the sorted values, not interpolated."""
    return rows.groupBy(*(by or [])).agg(F.count(column).alias("n"), F.array_sort(F.collect_list(column)).alias("v")).select(*(by or []), F.get("v", F.floor(F.col("n") / 2).cast("int")).alias("upper_median"))


def ranked(rows: DataFrame, by: list[Column]) -> DataFrame:
    """Rows numbered 1..n in the order of ``by``; meant for the few rows of a result table."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*by)).cast("long"))


def latency(rows: DataFrame, by: list[str], value: str, run: str, warmup: int = 10) -> DataFrame:
    """Latency figures over the runs from ``warmup`` on; throughput is 1000 / mean milliseconds."""
    v = F.col(value)
    agg = rows.where(F.col(run) >= warmup).groupBy(*by).agg(F.avg(v).alias("mean_ms"), F.stddev_pop(v).alias("std_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"), F.count(v).alias("runs"))
    return agg.withColumn("throughput", ratio(F.lit(1000.0), F.col("mean_ms")))


def best_model(rows: DataFrame, value: str = "f1", model: str = "model") -> DataFrame:
    """The model of the greatest value, the first by name among equals, and that value."""
    return rows.select(model, F.coalesce(F.col(value), F.lit(0.0)).alias(value)).orderBy(F.desc(value), model).limit(1)


def lookup(rows: DataFrame, others: DataFrame, key: str, columns: dict[str, str], suffix: str = "", default: str = "-") -> DataFrame:
    """``rows`` with columns of another metric table as text, by its key less ``suffix``; ``columns`` maps them to their number
    formats. A key or figure that is not there has ``default``; of rows that share a key the last in order of their own keys counts."""
    plain = F.regexp_replace(F.col(key), f"{suffix}$", "") if suffix else F.col(key)
    held = others.select(plain.alias(key), F.struct(F.col(key), *columns).alias("_r")).groupBy(key).agg(F.max_by("_r", F.col(f"_r.{key}")).alias("_r"))
    joined, value = rows.join(held, key, "left"), {c: F.col(f"_r.{c}") for c in columns}
    text = [F.when(v.isNotNull(), F.format_string(columns[c], v.cast("double"))).otherwise(default).alias(c) for c, v in value.items()]
    return joined.select(*rows.columns, *text)


def medal(rank: Column) -> Column:
    """The first three ranks as medals, others as their number."""
    return F.coalesce(*[F.when(rank == i, m) for i, m in ((1, "🥇"), (2, "🥈"), (3, "🥉"))], rank.cast("string"))


def arranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The columns of ``order`` that are there, then the others as they stand."""
    return df.select(*[c for c in order if c in df.columns], *[c for c in df.columns if c not in order])


def formatted(df: DataFrame, forms: dict[str, str]) -> DataFrame:
    """Number columns as text in the given formats; absent columns are skipped, text passes through, null stays."""
    kinds = dict(df.dtypes)
    numbers = {c: f for c, f in forms.items() if kinds.get(c) in ("double", "float", "bigint", "int")}
    named = {c: F.col(f"`{c}`") for c in numbers}
    return df.withColumns({c: F.when(x.isNotNull(), F.format_string(numbers[c], x.cast("double"))) for c, x in named.items()}) if numbers else df


FOUR = "%.4f"


def comparison_table(overall: DataFrame, queries: DataFrame) -> DataFrame:
    """Models by falling F1 with their span figures and those of whole queries, as text: four decimals, coverage in percent.
    ``overall`` is (model, precision, recall, f1), ``queries`` (model, exact_match, coverage, slot_f1)."""
    table = ranked(overall.join(queries, "model", "left"), [F.desc("f1"), F.col("model")])
    forms = dict.fromkeys(("precision", "recall", "f1", "exact_match", "slot_f1"), FOUR) | {"coverage": "%.1f%%"}
    return arranged(formatted(table, forms), ["rank", "model", "precision", "recall", "f1", "exact_match", "coverage", "slot_f1"])


def entity_summary(per_type: DataFrame, models: list[str]) -> DataFrame:
    """(entity_type, a column a model): F1 with two decimals, 0.00 where a model has none. ``per_type`` is (model,
    entity_type, f1); rows of averages are no types."""
    types = per_type.where(~F.col("entity_type").isin("ALL", "micro avg", "macro avg", "weighted avg"))
    wide = pivot(types, ["entity_type"], "model", models, "f1").na.fill(0.0)
    return formatted(wide, dict.fromkeys(models, "%.2f"))


def final_table(overall: DataFrame, retrieval: DataFrame, efficiency: DataFrame) -> DataFrame:
    """Models ranked by F1 with span figures, retrieval figures (of ``<model>_rerank``) and size and latency; a dash where a
    model is in no such table. All figures are text."""
    table = lookup(ranked(overall, [F.desc("f1"), F.col("model")]), retrieval, "model", {"ndcg": FOUR, "mrr": FOUR}, "_rerank")
    table = lookup(table, efficiency, "model", {"params_m": "%.2f", "latency_ms": "%.2f"})
    return arranged(formatted(table, dict.fromkeys(("precision", "recall", "f1"), FOUR)), ["rank", "model", "precision", "recall", "f1", "ndcg", "mrr", "params_m", "latency_ms"])


def trained_on(gold: DataFrame, silver: DataFrame, names: dict[str, str]) -> DataFrame:
    """(model, gold_precision, gold_f1, silver_precision, silver_f1): the same models trained on either set, ``names`` mapping
    a silver model to its gold one; a model without figures has 0.0000."""
    spark = gold.sparkSession
    known = spark.createDataFrame(list(names.items()), "model string, gold_model string")
    pick = lambda df, key, name: df.select(F.col("model").alias(key), F.col("precision").alias(f"{name}_precision"), F.col("f1").alias(f"{name}_f1"))
    both = known.join(pick(gold, "gold_model", "gold"), "gold_model", "left").join(pick(silver, "model", "silver"), "model", "left")
    figures = ["gold_precision", "gold_f1", "silver_precision", "silver_f1"]
    return formatted(both.na.fill(0.0, figures), dict.fromkeys(figures, FOUR)).select("model", *figures)


# fixed values: sizes of training sets by their labels
SIZES = {"1k": 1000, "2.5k": 2500, "5k": 5000, "full": 52500}


def learning_curve(rows: DataFrame, metric: str = "f1") -> DataFrame:
    """(model, a column a size): a metric by the size of the training set; sizes that are not known are left out."""
    return pivot(rows.where(F.col("size").isin(*SIZES)), ["model"], "size", list(SIZES), metric)


UNKNOWN = -1.0


def efficiency(latencies: DataFrame, models: DataFrame, warmup: int = 10) -> DataFrame:
    """A row a model of ``models`` (model, total_params, trainable_params, log): parameters also in millions, latency figures
    of its runs (model, latency_ms, run), the training time that its log states; -1 for what is not known."""
    runs = latency(latencies, ["model"], "latency_ms", "run", warmup).select("model", F.col("mean_ms").alias("avg_latency_ms"), F.col("std_ms").alias("std_latency_ms"), F.col("throughput").alias("throughput_queries_per_sec"))
    of = models.join(runs, "model", "left").withColumn("training_time_seconds", training_time(F.col("log"))).drop("log")
    millions = {f"{c}_millions": F.col(c) / 1e6 for c in ("total_params", "trainable_params")}
    full = of.withColumns(millions).withColumn("training_time_minutes", F.col("training_time_seconds") / 60)
    full = full.na.fill(UNKNOWN, [c for c, k in full.dtypes if k == "double"]).na.fill(int(UNKNOWN), ["total_params", "trainable_params"])
    order = ["model", "total_params", "total_params_millions", "trainable_params", "trainable_params_millions", "training_time_seconds", "training_time_minutes", "avg_latency_ms", "std_latency_ms", "throughput_queries_per_sec"]
    return arranged(full, order)


def summary_report(overall: DataFrame, per_type: DataFrame, models: list[str], title: str = "Results") -> str:
    """A Markdown report: the best model, all models with their medals, and F1 by entity type."""
    best = best_model(overall).first()
    rows = ranked(overall, [F.desc("f1"), F.col("model")]).withColumn("place", medal(F.col("rank"))).orderBy("rank")
    main = markdown(formatted(rows, dict.fromkeys(("precision", "recall", "f1"), FOUR)), ["model", "precision", "recall", "f1", "place"])
    types = markdown(entity_summary(per_type, models).orderBy("entity_type"), ["entity_type", *models])
    return f"# {title}\n\nBest by F1: **{best.model}** with **{best.f1:.4f}**.\n\n## Models\n\n{main}\n## F1 by entity type\n\n{types}"
