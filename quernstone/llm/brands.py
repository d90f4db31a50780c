"""Freely typed brands mapped to a reference list by BK-trees under edit distance.

Reference entries lie in shards of about ``SHARD`` entries, the distinct mentions in blocks. Every block meets every shard in
one task, which makes the shard's BK-tree and looks the mentions up; the winners of the shards merge by (distance, entry).
Neither list passes through the driver. The triangle inequality lets a lookup skip every subtree whose distance to its
parent cannot bring an entry within the threshold, so nothing within it is missed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.reading import TRADEMARKS
from quernstone.session import materialize

SHARD, MENTIONS = 20_000, 1_000  # entries of a shard, mentions of a block
WITHIN = 2
# fixed values: words that say nothing about a brand at the end of its name
TRAILING = frozenset("inc co ltd llc gmbh company brand shop store official".split())

_CF = regex.compile(r"\p{Cf}+")
_MARKS = regex.compile(r"\p{M}+")
_POSSESSIVE = regex.compile(r"(?<=[\p{L}\p{N}])\s*['’‘ʼ`´]\s*s(?![\p{L}\p{N}])")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def brand_key(text: str) -> str:
    """What of a brand's spelling counts: letters and digits without case and accents, & as ``and``, no possessive s, no
    trailing business words."""
    s = _CF.sub("", text.translate(TRADEMARKS))
    s = _MARKS.sub("", unicodedata.normalize("NFKD", s.replace("´", "'"))).casefold()
    words = _WORD.findall(_POSSESSIVE.sub(" ", s.replace("&", " and ")))
    while len(words) > 1 and words[-1] in TRAILING:
        words.pop()
    return "".join(words)


class Pattern:
    """One side of an edit distance, compiled for Myers' bit-parallel algorithm; works on text and on lists of words."""

    __slots__ = ("full", "masks", "size", "top")

    def __init__(self, a):
        self.size, self.masks = len(a), {}
        for i, c in enumerate(a):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.full, self.top = (1 << len(a)) - 1, 1 << len(a) >> 1

    def distances(self, b, inside: bool = False) -> Iterator[int]:
        """After each element of ``b``: the distance of the whole pattern to ``b`` so far or, ``inside``, to its best
        ending there."""
        pv, mv, score, masks, full, top = self.full, 0, self.size, self.masks, self.full, self.top
        start = 0 if inside else 1
        for c in b:
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 | start
            pv = (mh << 1 | ~(xv | ph)) & full
            mv = ph & xv & full
            yield score

    def distance(self, b) -> int:
        if not self.size:
            return len(b)
        d = self.size
        for d in self.distances(b):  # noqa: B007
            pass
        return d


class BKTree:
    """(key, entry) pairs; of equal keys the smallest entry stays."""

    def __init__(self, entries: list[tuple[str, int]]):
        best: dict[str, int] = {}
        for key, entry in entries:
            best[key] = min(entry, best.get(key, entry))
        self.best, self.root = best, None
        for key in best:
            self._add(key)

    def _add(self, key: str) -> None:
        if self.root is None:
            self.root = (key, {})
            return
        node, p = self.root, Pattern(key)
        while True:
            d = p.distance(node[0])
            if d not in node[1]:
                node[1][d] = (key, {})
                return
            node = node[1][d]

    def within(self, key: str, most: int) -> list[tuple[int, int]]:
        """(distance, entry) of every entry at most ``most`` edits away."""
        found, stack, p = [], [self.root] if self.root else [], Pattern(key)
        while stack:
            node, children = stack.pop()
            d = p.distance(node)
            if d <= most:
                found.append((d, self.best[node]))
            stack += [child for cd, child in children.items() if d - most <= cd <= d + most]
        return found

    def closest(self, key: str, most: int) -> tuple[int, int] | None:
        if key in self.best:
            return 0, self.best[key]
        return min(self.within(key, most), default=None)


@F.pandas_udf(T.StringType())
def brand_key_udf(col: pd.Series) -> pd.Series:
    return col.map(lambda s: None if s is None else brand_key(s))


def spans(rows: DataFrame, id_col: str, tokens: str, tags: str, kind: str) -> DataFrame:
    """(id, span_start, text): a span starts at B-``kind`` and goes on over directly following I-``kind`` tags (trimmed,
    any case); both arrays end with the shorter. Null arrays have no spans. The text is the non-null tokens in it."""
    n = F.least(F.size(tokens), F.size(tags))
    mark = lambda t: F.upper(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)^\s+|\s+$", ""))
    code = lambda t: F.when(mark(t) == f"B-{kind}", "B").when(mark(t) == f"I-{kind}", "I").otherwise("O")
    coded = rows.where(F.col(tokens).isNotNull() & F.col(tags).isNotNull() & (n > 0)).select(F.col(id_col).alias("id"), F.col(tokens).alias("tok"), F.array_join(F.transform(F.slice(F.col(tags), F.lit(1), n), code), "").alias("code"))
    starts = F.filter(F.sequence(F.lit(0), F.length("code") - 1), lambda i: F.substring(F.col("code"), i + 1, F.lit(1)) == "B")
    at = coded.where(F.col("code").contains("B")).withColumn("span_start", F.explode(starts))
    size = F.length(F.regexp_extract(F.expr("substring(code, span_start + 1)"), "^BI*", 0))
    held = F.filter(F.slice("tok", F.col("span_start") + 1, size), lambda t: t.isNotNull())
    return at.select("id", F.col("span_start").cast("long").alias("span_start"), F.array_join(held, " ").alias("text"))


def _search(within: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[tuple[int, int], tuple[list, list]] = {}
        for pdf in batches:  # rows of a block and shard: first its entries, then its mentions, as sorted
            for at, part in pdf.groupby(["block", "shard"], sort=False):
                entries, mentions = trees.setdefault(at, ([], []))
                given = part["entry"].notna()
                entries += zip(part["key"][given], part["entry"][given].astype("int64"))
                mentions += part["key"][~given].to_list()
            for at in list(trees)[:-1]:  # later rows belong to the last one
                yield _closest(*trees.pop(at), within)
        for entries, mentions in trees.values():
            yield _closest(entries, mentions, within)

    return run


def _closest(entries: list[tuple[str, int]], mentions: list[str], within: int) -> pd.DataFrame:
    tree = BKTree(entries)
    hits = [(key, *hit) for key in mentions if (hit := tree.closest(key, within))]
    return pd.DataFrame(hits, columns=["key", "distance", "entry"])


def closest_entries(texts: DataFrame, reference: DataFrame, within: int = WITHIN, shard: int = SHARD, block: int = MENTIONS) -> DataFrame:
    """(text, entry, distance) for the distinct ``texts`` (text string); entry -1 and no distance where none is near enough.

    ``reference`` is (entry long, name string). Ties go to the smallest entry. Null names and ids are no entries; names and
    mentions without a letter or digit read as the empty word, which is as far from a key as the key is long. Blocks grow
    with the shards, so that entries are not copied more often than there are mentions.
    """
    ref = reference.toDF("entry", "name").where("entry is not null and name is not null").select(brand_key_udf("name").alias("key"), F.col("entry").cast("long").alias("entry"))
    ref, _ = materialize(ref, "reference")
    keyed, _ = materialize(texts.select("text").where("text is not null").distinct().select("text", brand_key_udf("text").alias("key")), "mentions")
    keys = keyed.select("key").distinct()
    n_ref, n_keys = ref.count(), keys.count()
    shards = max(1, -(-n_ref // shard))
    blocks = max(1, -(-n_keys // max(block, min(n_ref, shard))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(n)).cast("int")
    left = ref.withColumn("shard", of(shards, 1)).withColumn("block", every(blocks)).select("block", "shard", "key", "entry")
    right = keys.withColumn("block", of(blocks, 2)).withColumn("shard", every(shards)).select("block", "shard", "key", F.lit(None).cast("long").alias("entry"))
    # a number of partitions that is asked for is not coalesced, however small the rows are
    laid = left.unionByName(right).repartition(shards * blocks, "block", "shard").sortWithinPartitions("block", "shard")
    won = laid.mapInPandas(_search(within), "key string, distance int, entry long").groupBy("key").agg(F.min(F.struct("distance", "entry")).alias("best"))
    return keyed.join(won, "key", "left").select("text", F.coalesce("best.entry", F.lit(-1)).alias("entry"), F.col("best.distance").alias("distance"))


def map_spans(found: DataFrame, reference: DataFrame, within: int = WITHIN) -> DataFrame:
    """``found`` (id, span_start, text) plus entry and distance. One mention may hold a third of the spans: mentions are
    looked up once each and joined back, by broadcast where Spark sees that they are few, else by a shuffle that adaptive
    execution splits at hot keys."""
    entries, _ = materialize(closest_entries(found, reference, within), "entries")
    return found.join(entries, "text", "left")


def spelled_otherwise(found: DataFrame, reference: DataFrame) -> DataFrame:
    """The spans whose text is no reference name, case aside."""
    names = reference.toDF("entry", "name").where("name is not null").select(F.lower("name").alias("low")).distinct()
    return found.withColumn("low", F.lower("text")).join(names, "low", "left_anti").drop("low")
