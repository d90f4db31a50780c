"""Entity spans from tag sequences, under three readings of malformed tags.

All readings share the same islands: a tag I-T goes on with the island before it if that ends in a tag of type T; any
other tag but O starts an island. ``strict`` keeps the islands that start with B-, ``lenient`` all, ``attribute`` those
with a B- at or before them in the same run of tags without an O.

A sequence lies in one row, so islands are found inside the row by array functions: no shuffle, no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT, LENIENT, ATTRIBUTE = "strict", "lenient", "attribute"
SPAN = "array<struct<entity_type:string,start:int,end:int,has_b:boolean,run_b:boolean>>"


def islands(tags: Column) -> Column:
    """Islands of a tag array in order: struct(entity_type, start, end, has_b, run_b), ends inclusive. Null tags are O."""
    empty = F.struct(F.array().cast(SPAN).alias("done"), F.lit("").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("from"), F.lit(False).alias("has_b"), F.lit(False).alias("run_b"))
    state = "struct<done:%s,kind:string,i:int,from:int,has_b:boolean,run_b:boolean>" % SPAN

    def closed(a: Column) -> Column:
        span = F.struct(a["kind"].alias("entity_type"), a["from"].alias("start"), (a["i"] - 1).alias("end"), a["has_b"].alias("has_b"), a["run_b"].alias("run_b"))
        return F.when(a["kind"] != "", F.concat(a["done"], F.array(span))).otherwise(a["done"])

    def step(a: Column, tag: Column) -> Column:
        tag = F.coalesce(tag, F.lit("O"))
        kind, is_b = F.substr(tag, F.lit(3)), tag.startswith("B-")
        live = is_b | tag.startswith("I-")
        goes_on = tag.startswith("I-") & (a["kind"] == kind) & (a["kind"] != "")
        nxt = a["i"] + 1
        same = F.struct(a["done"].alias("done"), a["kind"].alias("kind"), nxt.alias("i"), a["from"].alias("from"), a["has_b"].alias("has_b"), a["run_b"].alias("run_b"))
        new = F.struct(closed(a).alias("done"), kind.alias("kind"), nxt.alias("i"), a["i"].alias("from"), is_b.alias("has_b"), (is_b | ((a["kind"] != "") & a["run_b"])).alias("run_b"))
        out = F.struct(closed(a).alias("done"), F.lit("").alias("kind"), nxt.alias("i"), F.lit(0).alias("from"), F.lit(False).alias("has_b"), F.lit(False).alias("run_b"))
        return F.when(goes_on, same).when(live, new).otherwise(out).cast(state)

    return F.aggregate(tags, empty.cast(state), step, closed)


def keeps(decoder: str, span: Column) -> Column:
    if decoder == STRICT:
        return span["has_b"]
    return F.lit(True) if decoder == LENIENT else span["run_b"]


def decode(tags: Column, decoder: str = STRICT) -> Column:
    """The spans that a reading keeps, as an array like that of :func:`islands`."""
    if decoder not in (STRICT, LENIENT, ATTRIBUTE):
        raise ValueError(f"unknown decoder: {decoder}")
    return F.filter(islands(tags), lambda s: keeps(decoder, s))


def cut(a: str, b: str) -> tuple[Column, Column]:
    """Two arrays cut to the shorter one's length."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(F.col(a), F.lit(1), n), F.slice(F.col(b), F.lit(1), n)


def span_rows(df: DataFrame, keys: list[str], tags: Column | str, decoder: str = STRICT, tokens: str | None = None) -> DataFrame:
    """One row a span: keys, entity_type, start, end and, with ``tokens``, the span's text."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    rows = df.select(*keys, *([tokens] if tokens else []), F.explode(decode(tags, decoder)).alias("s")).select(*keys, *([tokens] if tokens else []), F.col("s.entity_type"), F.col("s.start"), F.col("s.end"))
    if not tokens:
        return rows
    text = F.array_join(F.slice(tokens, F.col("start") + 1, F.col("end") - F.col("start") + 1), " ")
    return rows.withColumn("text", text).drop(tokens)


def sequences(rows: DataFrame, key: str, order: list[str], columns: dict[str, Column]) -> DataFrame:
    """Row-per-token data gathered into one row per sequence, in the given order. A sequence is one text's tokens, which
    bounds the group."""
    item = F.struct(*order, *[c.alias(k) for k, c in columns.items()])
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("seq"))
    # a list of structs read by field name is the list of that field
    return grouped.select(key, *[F.col(f"seq.{k}").alias(k) for k in columns])
