"""Formatting duplicates by sorting canonical records and scanning adjacent runs.

The records are range-partitioned by (key, id), sorted inside the partitions and scanned once, comparing whole keys with
their neighbours. Splitting on the id too means that a key holding any share of the rows spreads over many partitions;
only the first run of a partition can go on from the one before, so one small row per partition is enough to stitch the
runs together, their members and their counts alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.components import connected
from quernstone.llm.reading import folded, is_blank, plain_key, record_key
from quernstone.session import discard, materialize

_SCAN = "kind string, id long, rep long, first_run boolean, copies long, part int, head string, tail string"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (kind id: id, rep of its run in this partition), (kind run: rep, copies) and at the end one border row of the
    partition with its first and last key."""
    part = TaskContext.get().partitionId()
    head = last = None
    rep, count, first = 0, 0, True  # of the run that is open

    def rows(**columns) -> pd.DataFrame:
        frame = pd.DataFrame({"part": part, **columns})
        return frame.reindex(columns=["kind", "id", "rep", "first_run", "copies", "part", "head", "tail"]).astype({"id": "Int64", "rep": "Int64", "copies": "Int64", "first_run": "boolean", "kind": object, "head": object, "tail": object})

    for pdf in batches:
        if not len(pdf):
            continue
        key, ids = pdf["key"], pdf["id"].to_numpy()
        new = key.ne(key.shift()).to_numpy()
        new[0] = key.iloc[0] != last
        at = np.flatnonzero(new)
        run = np.cumsum(new)  # 0 is the run that is open
        reps = np.concatenate([[rep], ids[at]])
        sizes = np.bincount(run, minlength=len(at) + 1)
        sizes[0] += count
        firsts = np.full(len(at) + 1, False)
        firsts[0] = first
        if head is None:
            head, firsts[0], firsts[1] = key.iloc[0], False, True
        yield rows(kind="id", id=ids, rep=reps[run], first_run=firsts[run])
        ended = slice(1 if not sizes[0] else 0, len(at))
        if ended.start < ended.stop:
            yield rows(kind="run", rep=reps[ended], copies=sizes[ended], first_run=firsts[ended])
        last, rep, count, first = key.iloc[-1], int(reps[-1]), int(sizes[-1]), bool(firsts[-1])
    if head is not None:
        yield rows(kind="run", rep=[rep], copies=[count], first_run=[first])
        yield rows(kind="border", rep=[rep], first_run=[first], head=[head], tail=[last])


def scanned(records: DataFrame) -> DataFrame:
    """(kind, id, rep, copies) for ``records`` (key string not null, id long): rows of kind id have the smallest id with the
    same key, rows of kind run the copies of a record; a run that lies in several partitions has a row in each."""
    spark = records.sparkSession
    # nulls sort first and would only cost a partition; ids repeat where a record does and then share one run
    laid = records.select("key", "id").where("key is not null and id is not null").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    scan, _ = materialize(laid.mapInPandas(_scan, _SCAN), "runs")
    rep_at, carried, tail = {}, None, None
    borders = scan.where("kind = 'border'").select("part", "rep", "first_run", "head", "tail").collect()  # a row a partition
    for b in sorted(borders, key=lambda b: b.part):
        goes_on = b.head == tail
        rep_at[b.part] = carried if goes_on else None
        carried, tail = (carried if goes_on and b.first_run else b.rep), b.tail
    joins = {p: r for p, r in rep_at.items() if r is not None}
    rows = scan.where("kind <> 'border'")
    if not joins:
        return rows.select("kind", "id", "rep", "copies")
    ahead = F.broadcast(spark.createDataFrame(list(joins.items()), "part int, ahead long"))  # at most one row a partition
    rep = F.when(F.col("first_run"), F.coalesce("ahead", "rep")).otherwise(F.col("rep"))
    return rows.join(ahead, "part", "left").select("kind", "id", rep.alias("rep"), "copies")


def runs(records: DataFrame) -> DataFrame:
    """(id, rep) for ``records`` (key, id): rep is the smallest id with the same key."""
    return scanned(records).where("kind = 'id'").select("id", "rep")


def keyed(rows: DataFrame, id_col: str, text_col: str, *keep: str, **more: Callable[[Column], Column]) -> DataFrame:
    """(id, key, kept columns) of the rows whose text has content; ``more`` are columns made of the folded text. The key is
    the canonical record; a plain text whose characters are those of a field record takes that record's key, so that both
    readings of a copy meet."""
    fold = rows.where(~is_blank(F.col(text_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), folded(F.col(text_col)).alias("fold"), *keep)
    names = [*keep, *more]
    both = fold.select("id", *keep, *[f(F.col("fold")).alias(c) for c, f in more.items()], record_key(F.col("fold")).alias("key"), plain_key(F.col("fold")).alias("plain")).where("key is not null")
    both, _ = materialize(both.withColumn("plain", F.when(F.col("key").startswith("|"), F.col("plain"))), "keys")  # plain only of field records
    fields = both.where("plain is not null")
    if fields.isEmpty():
        return both.select("id", "key", *names)
    common = fields.groupBy("plain").agg(F.min("key").alias("common"), F.max("key").alias("other"))
    common, path = materialize(common, "readings")
    if not common.where("common <> other").isEmpty():  # some characters read as several records
        common, _ = materialize(_closure(fields.select("plain", "key").distinct()), "readings")
        discard(both.sparkSession, path)
    known = both.withColumn("plain", F.coalesce("plain", "key")).join(common.select("plain", "common"), "plain", "left")
    return known.select("id", F.coalesce("common", "key").alias("key"), *names)


def _closure(pairs: DataFrame) -> DataFrame:
    """One common key for all (plain, key) readings that hang together, as components of numbered readings."""
    pairs, _ = materialize(pairs, "field-readings")
    names = pairs.select(F.col("plain").alias("name"), F.lit("p").alias("side")).union(pairs.select("key", F.lit("k"))).distinct()
    names, _ = materialize(names.withColumn("n", F.monotonically_increasing_id()), "numbers")  # numbers stay as written
    number = lambda side, c, at: names.where(F.col("side") == side).select(F.col("name").alias(c), F.col("n").alias(at))
    linked = pairs.join(number("p", "plain", "a"), "plain").join(number("k", "key", "b"), "key")
    label = connected(linked.select("a", "b")).withColumnRenamed("node", "a")
    whole = linked.join(label, "a")
    common = whole.groupBy("label").agg(F.min("key").alias("common"))
    return whole.select("plain", "label").distinct().join(common, "label").select("plain", "common")


def format_copies(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rep): every row with content and the smallest id among the rows that differ from it in formatting only.

    Null ids and blank texts give no row; so do texts without a letter or digit, as nothing tells them apart.
    A repeated id counts as one more copy. Extra columns are ignored.
    """
    return runs(keyed(rows, id_col, text_col))


def copy_counts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, copies): one row per record of the same rows with its exact number of copies, as the scan counts them; only a
    run that several partitions share is added up."""
    found = scanned(keyed(rows, id_col, text_col)).where("kind = 'run'")
    return found.groupBy("rep").agg(F.sum("copies").alias("copies"))
