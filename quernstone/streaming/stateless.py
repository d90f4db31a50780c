"""The row-wise operators on streams: cleaning, annotation and error flags keep no state, so a stream is a table to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import annotate, errors


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def clean_stream(df: DataFrame, column: str = "query", low: int = text.MIN_TOKENS, high: int = text.MAX_TOKENS) -> DataFrame:
    """Cleaned and tokenised rows within the token range; there is no deduplication over an endless table."""
    out = df.withColumn("query_clean", text.clean_text(F.col(column))).where("query_clean <> ''").withColumn("query_tokens", text.tokenize(F.col("query_clean")))
    return out.withColumn("num_tokens", F.size("query_tokens").cast("long")).where(F.col("num_tokens").between(low, high))


def annotate_stream(df: DataFrame, tokens: str = "query_tokens", out: str = "ner_tags") -> DataFrame:
    return annotate.annotate_table(df, tokens, out)


def flag_stream(df: DataFrame) -> DataFrame:
    return errors.error_flags(df)


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Append to parquet until the present input is used up; the checkpoint makes a restart go on where it was."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
