"""Mixing sources to target shares of tokens by pivotal dependent rounding.

A source's documents get one fractional number of copies, its target size over its own size and at most its
``max_repeats``. The whole part is taken at once; the fractions are rounded in pairs: of two documents one takes over as
much of the other's fraction as keeps both between 0 and 1, at random in the proportion that leaves every document's
expectation as it was, until one of them is whole. Documents lie sorted by source and falling size in ranges of any number
of tasks; each task pairs neighbours as it scans its range and hands on the one document a source that is left open. The open
ones are laid out and paired again, until one a source is left. The sum of copies stays within one of what was asked, and
as pairs are of like size, and the smallest come last, so do the tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import discard, materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # a public vocabulary as ranks, see the README beside it
# fixed value: how that vocabulary cuts text before it merges
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TASK_ROWS = 100_000  # open documents that one task pairs once there are so few
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) with the source in its plain spelling; null texts have no tokens, null ids are left out. The
    vocabulary file goes to the executors with the job."""
    documents.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(SparkFiles.get(name))
        for pdf in batches:
            n = [0 if t is None else len(encoder.encode_ordinary(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": n})

    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where("doc_id is not null")
    return rows.mapInPandas(count, "doc_id long, source string, tokens long")


def source_name(col: Column) -> Column:
    """Lower case, no surrounding white space, underscores between words."""
    return F.regexp_replace(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), r"(?U)[\s-]+", "_")


def _unit(seed: int, *parts) -> float:
    """A number in [0, 1) that depends on nothing but its arguments, so a task that runs again decides the same."""
    h = hashlib.blake2b("|".join(map(str, (seed, *parts))).encode(), digest_size=8).digest()
    return (int.from_bytes(h, "big") >> 11) / (1 << 53)


class Pivot:
    """Pairs the documents of one source as they come; one at most is open."""

    def __init__(self, seed: int, level: int):
        self.seed, self.level, self.open = seed, level, None

    def add(self, doc: int, p: float, row: tuple) -> list[tuple]:
        """The rows that become whole copies by this document."""
        if p <= 1e-12:
            return []
        if p >= 1 - 1e-12:
            return [row]
        if self.open is None:
            self.open = (doc, p, row)
            return []
        other, q, that = self.open
        u, s = _unit(self.seed, self.level, doc, other), p + q
        if s < 1:  # one takes all of it, the other is out
            self.open = (doc, s, row) if u * s < p else (other, s, that)
            return []
        # one becomes a whole copy, the other keeps the rest
        (won, rest) = (row, (other, s - 1, that)) if u * (2 - s) < 1 - q else (that, (doc, s - 1, row))
        self.open = rest if s - 1 > 1e-12 else None
        return [won]


_ROUNDED = "doc_id long, source string, tokens long, prob double, taken boolean"


def _rounder(seed: int, level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[str, Pivot] = {}  # a source each
        for pdf in batches:
            rows = []
            for row in pdf[["doc_id", "source", "tokens", "prob"]].itertuples(index=False, name=None):
                rows += [(d, s, n, 1.0, True) for d, s, n, _ in open_.setdefault(row[1], Pivot(seed, level)).add(row[0], row[3], row)]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "tokens", "prob", "taken"])
        rows = [(x.open[2][0], s, x.open[2][2], x.open[1], False) for s, x in open_.items() if x.open]
        yield pd.DataFrame(rows, columns=["doc_id", "source", "tokens", "prob", "taken"])

    return run


def dependent_rounding(rows: DataFrame, seed: int = 17, task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, source) of the documents of ``rows`` (doc_id, source, tokens, prob) that get one copy more.

    ``doc_id`` is unique. Every level leaves at most one open document a task and source, so the levels grow with the
    logarithm of the rows; the last is one task of at most ``task_rows`` rows or of one a source.
    """
    open_, level, out, paths = rows.select("doc_id", "source", "tokens", "prob"), 0, [], []
    order = ["source", F.desc("tokens"), "doc_id"]
    n, before = open_.count(), None
    while n:
        # ranges of a source's sizes; where a level no longer helps, one row a source and task is left
        laid = open_.coalesce(1) if n <= task_rows or n == before else open_.repartitionByRange(*order)
        rounded, path = materialize(laid.sortWithinPartitions(*order).mapInPandas(_rounder(seed, level), _ROUNDED), f"rounded-{level}")
        paths.append(path)
        out.append(rounded.where("taken").select("doc_id", "source"))
        last = n <= task_rows or n == before
        open_ = rounded.where("not taken").select("doc_id", "source", "tokens", "prob")
        before, n, level = n, open_.count(), level + 1
        if last:  # at most one a source: its fraction is a single draw
            draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
            out.append(open_.where(draw < F.col("prob")).select("doc_id", "source"))
            break
    result = rows.select("doc_id", "source").limit(0)
    for part in out:
        result = result.unionByName(part)
    result, _ = materialize(result, "rounded")
    discard(rows.sparkSession, *paths)
    return result


def plan(sizes: DataFrame, targets: DataFrame, total: int) -> DataFrame:
    """(source, target_share, max_repeats, own_tokens, own_documents, want, copies): per target source the tokens it should
    give, its share of ``total``, and the copies per document.

    What a source cannot give falls short and is not made up by others, so these keep their proportions.
    """
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    full = F.broadcast(t).join(F.broadcast(sizes), "source", "left").na.fill(0, ["own_tokens", "own_documents"])  # a row a source
    want = full.withColumn("want", F.col("target_share") * F.lit(total))
    return want.withColumn("copies", F.least(F.coalesce(F.try_divide("want", "own_tokens"), F.lit(0.0)), F.col("max_repeats").cast("double")))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of a mixture of ``total`` tokens, by default as many as all documents hold.

    selection: (doc_id, source, tokens, copies) with copies >= 1. report: a row per target source with its own tokens, what
    was wanted and reached, its share of the size that was asked for and of the size that was reached, the most copies of a
    document, and what fell short; and a row for each other source, which gives nothing. Both sizes are in every row. If
    some source falls short, the shares of the reached size of the others are higher than their targets by one factor.
    Documents without tokens are never chosen. Repeated doc_ids are one document.
    """
    spark = documents.sparkSession
    counted, path = materialize(token_counts(documents, tokenizer), "tokens")
    docs = counted.groupBy("doc_id").agg(F.min_by("source", F.struct("source", "tokens")).alias("source"), F.min_by("tokens", F.struct("source", "tokens")).alias("tokens"))
    docs, _ = materialize(docs.where("tokens > 0"), "sized")
    discard(spark, path)
    sizes, _ = materialize(docs.groupBy("source").agg(F.sum("tokens").alias("own_tokens"), F.count("*").alias("own_documents")), "sizes")
    asked = total if total is not None else sizes.agg(F.coalesce(F.sum("own_tokens"), F.lit(0))).first()[0]
    known = targets.select(source_name(F.col("source")).alias("source")).distinct()
    planned, _ = materialize(plan(sizes.join(F.broadcast(known), "source"), targets, asked), "plan")
    whole = F.floor("copies").cast("int")
    wanted = docs.join(F.broadcast(planned.select("source", "copies")), "source").select("doc_id", "source", "tokens", whole.alias("base"), (F.col("copies") - F.floor("copies")).alias("prob"))
    extra = dependent_rounding(wanted.where("prob > 0"), seed).select("doc_id", F.lit(1).alias("one"))
    selection, _ = materialize(wanted.join(extra, "doc_id", "left").select("doc_id", "source", "tokens", (F.col("base") + F.coalesce("one", F.lit(0))).alias("copies")).where("copies > 0"), "selection")
    got = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    rest = sizes.join(F.broadcast(known), sizes.source.eqNullSafe(known.source), "left_anti").select("source", F.lit(0.0).alias("target_share"), F.lit(0).alias("max_repeats"), "own_tokens", "own_documents", F.lit(0.0).alias("want"))
    rows = planned.select("source", "target_share", "max_repeats", "own_tokens", "own_documents", "want").unionByName(rest)
    joined = rows.join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    reached = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over the few rows of the report
    report = joined.select(
        "source", "target_share", "max_repeats", "own_documents", "own_tokens", F.round("want").cast("long").alias("wanted_tokens"), "tokens", "documents", "most_copies",
        F.coalesce(F.try_divide("tokens", F.lit(asked)), F.lit(0.0)).alias("share"), F.coalesce(F.try_divide("tokens", reached), F.lit(0.0)).alias("share_of_reached"),
        F.greatest(F.lit(0), F.round("want").cast("long") - F.col("tokens")).alias("short_by"), F.lit(asked).cast("long").alias("asked_tokens"), reached.alias("total_tokens"),
    )
    return selection, report
