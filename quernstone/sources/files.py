"""File formats around tagged queries: CoNLL, review TSV, prediction JSON and JSONL, metric folders, logs, fixed-width and
LaTeX tables."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROWS = 10_000  # of a printed table
SEED_FOLDER = r"([^/]+)_seed(\d+)/[^/]+$"
# fixed values: ways in which logs state a training time in seconds, the first that matches counts
LOG_PATTERNS = (
    r"Training.*completed in (\d+\.?\d*)\s*seconds",
    r"Total training time:\s*(\d+\.?\d*)\s*s",
    r"train_runtime['\"]?\s*[:=]\s*(\d+\.?\d*)",
    r"(\d+\.?\d*)\s*seconds.*total",
)


def conll_block(tokens: Column, tags: Column) -> Column:
    """token<TAB>tag lines of one query; arrays end with the shorter, pairs with a null are left out."""
    n = F.least(F.size(tokens), F.size(tags))
    lines = F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tags, F.lit(1), n), lambda w, t: F.concat(w, F.lit("\t"), t))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def write_conll(df: DataFrame, path: str, order: str, tokens: str = "query_tokens", tags: str = "ner_tags") -> None:
    """Blocks in the order of a column, a blank line after each; files sort by name into the whole."""
    df.orderBy(order).select(F.concat(conll_block(F.col(tokens), F.col(tags)), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """(query_tokens, ner_tags) of each block."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.contains("\t"))
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(lines.alias("l")).where(F.size("l") > 0)
    return blocks.select(F.transform("l", lambda x: F.split_part(x, F.lit("\t"), F.lit(1))).alias("query_tokens"), F.transform("l", lambda x: F.split_part(x, F.lit("\t"), F.lit(2))).alias("ner_tags"))


def review_rows(df: DataFrame, idx: str, tokens: str = "query_tokens", tags: str = "ner_tags") -> DataFrame:
    """Rows of the review sheet (query_idx, pos, token, silver_tag, corrected_tag), with a separator after each query."""
    n = F.least(F.size(tokens), F.size(tags))
    pairs = F.arrays_zip(F.slice(tokens, F.lit(1), n).alias("token"), F.slice(tags, F.lit(1), n).alias("silver_tag"))
    rows = df.select(F.col(idx).alias("query_idx"), F.posexplode(pairs).alias("pos", "x")).select("query_idx", "pos", "x.token", "x.silver_tag", F.lit("").alias("corrected_tag"))
    ends = df.select(F.col(idx).alias("query_idx"), n.alias("pos"), F.lit("").alias("token"), F.lit("").alias("silver_tag"), F.lit("").alias("corrected_tag"))
    return rows.unionByName(ends)


def write_review(df: DataFrame, path: str, idx: str, **columns: str) -> None:
    line = F.concat_ws("\t", F.col("query_idx").cast("string"), "token", "silver_tag", "corrected_tag")
    rows = review_rows(df, idx, **columns).orderBy("query_idx", "pos").select(line.alias("value"))
    head = df.sparkSession.createDataFrame([("query_idx\ttoken\tsilver_tag\tcorrected_tag",)], "value string")
    head.coalesce(1).union(rows.coalesce(1)).coalesce(1).write.mode("overwrite").text(path)  # a sheet for one person to read


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """The sheet as rows with pos, the place in the file; trailing tabs are cells, so uncorrected rows stay."""
    rows = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    cell = lambda i: F.split_part("value", F.lit("\t"), F.lit(i))
    out = rows.select(F.try_cast(cell(1), "bigint").alias("query_idx") if hasattr(F, "try_cast") else cell(1).try_cast("bigint").alias("query_idx"), "pos", cell(2).alias("token"), cell(3).alias("silver_tag"), cell(4).alias("corrected_tag"))
    return out.where("query_idx is not null and token <> ''")


def predictions(gold: DataFrame, predicted: DataFrame, models: list[str]) -> DataFrame:
    """One row per query of ``gold`` (query_id, tokens, gold_tags) and model; a missing prediction is empty."""
    spark = gold.sparkSession
    grid = gold.crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in models], "model string")))  # a row a model
    got = predicted.select("query_id", "model", F.col("tags").alias("pred_tags"))
    return grid.join(got, ["query_id", "model"], "left").withColumn("pred_tags", F.coalesce("pred_tags", F.array().cast("array<string>")))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.withColumn("query_id", F.col("query_id").cast("string")).write.mode("overwrite").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(model, query_index, tags) from JSON files of arrays of arrays; the model is the file name without its suffix."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("_f", F.input_file_name())
    named = F.coalesce(*[F.nullif(F.regexp_extract("_f", p, 1), F.lit("")) for p in (r"/model=([^/]+)/", r"([^/]+?)(?:_predictions)?\.json$")])
    raw = raw.select(named.alias("model"), "value")
    return raw.select("model", F.posexplode(F.from_json("value", "array<array<string>>")).alias("query_index", "tags"))


def write_predictions(df: DataFrame, path: str) -> None:
    """``df`` (model, query_index, tags) as one JSON array of arrays a model, in the order of the indexes, under ``model=<name>``;
    rows pass through the writing task one by one."""
    rows = df.select("model", F.col("query_index").cast("long").alias("i"), F.to_json("tags").alias("j"))
    ends = rows.groupBy("model").agg(F.max("i").alias("last"))  # a row a model
    lines = rows.join(F.broadcast(ends), "model").select("model", "i", F.concat("j", F.when(F.col("i") == F.col("last"), "").otherwise(",")).alias("value"))
    brackets = ends.select("model", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("i"), F.lit("[").alias("value")), F.struct((F.col("last") + 1).alias("i"), F.lit("]").alias("value")))).alias("x")).select("model", "x.*")
    lines.unionByName(brackets).repartition("model").sortWithinPartitions("model", "i").select("model", "value").write.mode("overwrite").partitionBy("model").text(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A Parquet table without an index column, by folders of ``by`` if given."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, order: str | None = None, defaults: float | None = None) -> None:
    """A result table as one CSV file with a header, in the order of a column; missing figures as ``defaults``."""
    df = df if defaults is None else df.na.fill(defaults)
    (df.orderBy(order) if order else df).coalesce(1).write.mode("overwrite").csv(path, header=True)  # a table for people to read


def write_corpus(df: DataFrame, path: str, column: str, order: list[str], limit: int | None = None) -> None:
    """Non-null texts of a column in order, a line each, the first ``limit`` of them; line breaks in a text become spaces, so
    that a line stays a text."""
    rows = df.where(F.col(column).isNotNull()).orderBy(*order)
    (rows.limit(limit) if limit else rows).select(F.regexp_replace(column, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


def read_size_metrics(spark: SparkSession, path: str, sizes: dict[str, int]) -> DataFrame:
    """Metric files under ``<model>_<size>/``: model, size, size_value and the file's columns; folders of other sizes are
    skipped, f1 stands in for a missing test_f1."""
    some = "|".join(re.escape(x) for x in sorted(sizes, key=len, reverse=True))
    raw = spark.read.option("multiLine", True).json(path).withColumn("_f", F.input_file_name())
    form = rf"([^/]+)_({some})/[^/]+$"
    out = raw.withColumns({"model": F.regexp_extract("_f", form, 1), "size": F.regexp_extract("_f", form, 2)}).where("size <> ''").drop("_f")
    value = F.coalesce(*[F.when(F.col("size") == k, v) for k, v in sizes.items()])
    return out.withColumns({"size_value": value, "f1": F.coalesce(*[c for c in ("f1", "test_f1") if c in raw.columns])})


def read_seed_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric files under ``<model>_seed<n>/``: model, seed and the file's columns; f1 stands in for a missing test_f1."""
    raw = spark.read.option("multiLine", True).json(path).withColumn("_f", F.input_file_name())
    out = raw.withColumns({"model": F.regexp_extract("_f", SEED_FOLDER, 1), "seed": F.expr(f"try_cast(regexp_extract(_f, r'{SEED_FOLDER}', 2) as int)")}).where("seed is not null").drop("_f")
    return out.withColumn("f1", F.coalesce(*[c for c in ("f1", "test_f1") if c in out.columns]))


def training_time(text: Column) -> Column:
    """Seconds stated in a log, by the first pattern that matches; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")).try_cast("double") for p in LOG_PATTERNS])


def fixed_width(df: DataFrame, order: str, columns: dict[str, str]) -> DataFrame:
    """(line, value): a fixed-width table in the order of a column, names to 30 characters and figures with four decimals to
    10, under a heading of the names in ``columns`` and a line of dashes."""
    form = "%-30s" + " %10.4f" * len(columns)
    head = ("%-30s" + " %10s" * len(columns)) % ("Model", *columns.values())
    rows = df.select(F.row_number().over(Window.orderBy(order)).cast("long").alias("line"), F.format_string(form, order, *columns).alias("value"))  # a row a model
    heading = df.sparkSession.createDataFrame([(-1, head), (0, "-" * len(head))], "line long, value string")
    return heading.unionByName(rows)


def write_fixed_width(df: DataFrame, path: str, order: str, columns: dict[str, str]) -> None:
    fixed_width(df, order, columns).coalesce(1).sortWithinPartitions("line").select("value").write.mode("overwrite").text(path)


def read_fixed_width(spark: SparkSession, path: str, columns: list[str], skip: int = 2) -> DataFrame:
    """The table back; lines of fewer than four fields and ``skip`` heading lines are left out."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).where(F.col("n") >= skip).select(cells.alias("c")).where(F.size("c") >= 4)
    return rows.select(F.get("c", F.lit(0)).alias("model"), *[F.get("c", F.lit(i + 1)).try_cast("double").alias(x) for i, x in enumerate(columns)])


def _few(df: DataFrame, columns: list[str]) -> list:
    """All rows of a table to print; it is an error if there are more than MAX_ROWS."""
    rows = df.select(*columns).limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a table of more than {MAX_ROWS} rows is not printed")
    return rows


def _cell(x, form: str | None) -> str:
    return "" if x is None else form % x if form else f"{x:.4f}" if isinstance(x, float) else str(x)


def latex(df: DataFrame, columns: list[str], caption: str = "", forms: dict[str, str] | None = None) -> str:
    """A LaTeX table of a result of a few rows; figures in the formats of ``forms``, by default with four decimals."""
    esc = lambda x: re.sub(r"([_%&#])", r"\\\1", x)
    forms = forms or {}
    body = "\n".join(" & ".join(esc(_cell(r[c], forms.get(c))) for c in columns) + r" \\" for r in _few(df, columns))
    head = " & ".join(map(esc, columns)) + r" \\"
    return f"\\begin{{table}}\n\\caption{{{esc(caption)}}}\n\\begin{{tabular}}{{{'l' * len(columns)}}}\n\\hline\n{head}\n\\hline\n{body}\n\\hline\n\\end{{tabular}}\n\\end{{table}}\n"


def markdown(df: DataFrame, columns: list[str], forms: dict[str, str] | None = None) -> str:
    rows, forms = _few(df, columns), forms or {}
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(_cell(r[c], forms.get(c)) for c in columns) + " |" for r in rows)]) + "\n"


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def load_config(path: str) -> dict:
    """A YAML file; numbers that YAML reads as text, such as 3e-5, become numbers."""
    import yaml

    def fix(x):
        if isinstance(x, dict):
            return {k: fix(v) for k, v in x.items()}
        if isinstance(x, list):
            return [fix(v) for v in x]
        return float(x) if isinstance(x, str) and re.fullmatch(r"[+-]?\d+(\.\d*)?[eE][+-]?\d+", x) else x

    return fix(yaml.safe_load(Path(path).read_text()) or {})


def save_config(config: dict, path: str) -> None:
    """A YAML file, keys in their order."""
    import yaml

    Path(path).write_text(yaml.safe_dump(config, sort_keys=False, allow_unicode=True))
