"""The entity schema: six product entity types in IOB2, their priorities and label ids."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: entity types by annotation priority, first wins
PRIORITY = {"PRODUCT_TYPE": 1, "BRAND": 2, "MATERIAL": 3, "COLOR": 4, "SIZE_MEASURE": 5, "ATTRIBUTE_VALUE": 6}
TYPES = tuple(PRIORITY)
COARSE = "PRODUCT"
LABELS = ("O", *chain.from_iterable((f"B-{t}", f"I-{t}") for t in TYPES))
LABEL_IDS = {label: i for i, label in enumerate(LABELS)}


def schema_table(spark: SparkSession) -> DataFrame:
    """The dimension table (entity_type, coarse_type, priority)."""
    return spark.createDataFrame([(t, COARSE, p) for t, p in PRIORITY.items()], "entity_type string, coarse_type string, priority int")


def tag_type(tag: Column) -> Column:
    """The type of a tag; empty for O and null."""
    return F.when(tag.startswith("B-") | tag.startswith("I-"), F.substr(tag, F.lit(3))).otherwise(F.lit(""))


def coarse_tag(tag: Column) -> Column:
    """O stays, any other tag keeps its prefix and becomes the coarse type."""
    return F.when(tag == "O", tag).otherwise(F.concat(F.substring(tag, 1, 1), F.lit(f"-{COARSE}")))


def _literal(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def encode_label(tag: Column) -> Column:
    """Label id of a tag; unknown tags and nulls are 0."""
    return F.coalesce(F.try_element_at(_literal(LABEL_IDS), tag), F.lit(0))


def decode_label(label_id: Column) -> Column:
    """Tag of a label id; unknown ids and nulls are O."""
    return F.coalesce(F.try_element_at(_literal({i: x for x, i in LABEL_IDS.items()}), label_id), F.lit("O"))
