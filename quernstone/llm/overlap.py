"""Exact and near copies across splits: a prefix-filter join between evaluation and training texts.

A text is the multiset of its words, each word numbered by occurrence so that multisets become sets. Two texts are near
if their sets differ by at most one word on each side, so the larger of n and m words shares all but one. In any common
order of the words, that many shared ones put at least one among the first two of either set: the prefixes. Words stand
in the order of their exact document frequency, from rare to common, so prefixes are as rare as can be. The prefixes of
the evaluation texts are the index, those of the training texts probe it, length and position filters thin the hits, and
each candidate is verified. The canonical record of a text is a shingle beside its words, by which texts meet that are
the same but for formatting.

A shingle that more than ``HOT`` texts hold on both sides is split into rarer ones: what is left of the text without one
of its words, and with it a third of that word, as two words within two edits share one. So no shingle pairs more than
``HOT`` texts of one side with those of the other. One-word texts have no rarer word and meet in the same way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.reading import is_blank, words
from quernstone.llm.runs import keyed
from quernstone.session import discard, materialize

EDITS = 2
HOT = 256  # texts of the rarer side up to which a shingle's texts are paired as they are
_DIGIT = regex.compile(r"\p{Nd}")


def texts(rows: DataFrame) -> DataFrame:
    """(id, text): the query or, where that is blank, the joined tokens without null and blank elements; null ids and
    rows without text are left out."""
    tokens = F.array_join(F.filter("query_tokens", lambda t: ~is_blank(t)), " ")
    text = F.when(~is_blank(F.col("query")), F.col("query")).otherwise(tokens)
    return rows.select(F.col("query_id").alias("id"), text.alias("text")).where(F.col("id").isNotNull() & ~is_blank(F.col("text")))


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and replacements turn one into the other; linear in their length."""
    if abs(len(a) - len(b)) > most:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if not a or not b:
        return len(a) + len(b) <= most
    return most > 0 and (within_edits(a[1:], b[1:], most - 1) or within_edits(a[1:], b, most - 1) or within_edits(a, b[1:], most - 1))


def near(a: list[str], b: list[str]) -> bool:
    """At most one word left on each side, none with a digit, two at most EDITS edits apart."""
    ca, cb = Counter(a), Counter(b)
    left, right = list((ca - cb).elements()), list((cb - ca).elements())
    if len(left) > 1 or len(right) > 1 or any(_DIGIT.search(w) for w in (*left, *right)):
        return False
    return not left or not right or within_edits(left[0], right[0], EDITS)


def _hash(kind: str, *parts) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join((kind, *map(str, parts)))) - (1 << 63)


def _pieces(size: int) -> list[tuple[int, int]]:
    """EDITS + 1 consecutive pieces (start, length) of a word of ``size`` letters."""
    cuts = [size * i // (EDITS + 1) for i in range(EDITS + 2)]
    return [(s, e - s) for s, e in zip(cuts, cuts[1:])]


def _word_shingles(side: str, w: str) -> set[int]:
    """A word and any other within EDITS edits share one: the evaluation word's pieces, and in the training word whatever
    could be a piece of an evaluation word of a near length, moved by at most EDITS places."""
    if side == "eval":
        return {_hash("d", len(w), i, w[s : s + n]) for i, (s, n) in enumerate(_pieces(len(w)))}
    return {
        _hash("d", size, i, w[s + move : s + move + n])
        for size in range(max(1, len(w) - EDITS), len(w) + EDITS + 1)
        for i, (s, n) in enumerate(_pieces(size))
        for move in range(-EDITS, EDITS + 1)
        if 0 <= s + move <= len(w) - n
    }


def _shingles(side: str, own: list[str], under: str = "") -> set[int]:
    """The rare shingles of a text under a hot one: two texts with it are near only if they share one of these. Equal texts
    share the whole; a text and one with a word more share what that one is without the word; texts that differ in one
    word each share what is left and a piece of these words."""
    total = sum(_hash("r", w) for w in own)  # a chance equality is only a candidate
    longer, shorter = ("b", "a") if side == "eval" else ("a", "b")  # texts of one size do not meet in what they are without a word
    out = {_hash("s", under, len(own), total), _hash(shorter, under, len(own), total)}
    for w in set(own):
        rest = total - _hash("r", w)
        if len(own) > 1:
            out.add(_hash(longer, under, len(own) - 1, rest))
        if not _DIGIT.search(w):
            out |= {_hash("p", under, len(own), rest, x) for x in _word_shingles(side, w)}
    return out


def _splitter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(side, n, x) for side, n, bag, under in zip(pdf["side"], pdf["text_id"], pdf["bag"], pdf["shingle"]) for x in _shingles(side, bag.split(" "), str(under))]
        yield pd.DataFrame(rows, columns=["side", "text_id", "shingle"])


@F.pandas_udf(T.BooleanType())
def _near_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(x.split(" "), y.split(" ")) for x, y in zip(a, b)], dtype=bool)


def prefixes(classes: DataFrame) -> DataFrame:
    """(side, text_id, size, shingle, place) of ``classes`` (side, text_id, bag, key): the two rarest words of each text by
    exact document frequency, and its record, at place -1."""
    each = classes.where("bag <> ''").select("side", "text_id", F.explode(F.split("bag", " ")).alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    # a word that a third of the texts hold is one row of counts; adaptive execution splits its other side
    ranked = each.join(counts, "word").groupBy("side", "text_id").agg(F.count("*").cast("int").alias("size"), F.slice(F.array_sort(F.collect_list(F.struct("n", "word"))), 1, 2).alias("first"))
    # the second of two equal words is another element than the first
    again = F.when(F.get("first", F.lit(1))["word"] == F.get("first", F.lit(0))["word"], 2).otherwise(1)
    held = F.transform("first", lambda x, i: F.struct(F.xxhash64(F.lit("w"), x["word"], F.when(i == 0, 1).otherwise(again)).alias("shingle"), i.alias("place")))
    rare = ranked.select("side", "text_id", "size", F.explode(held).alias("x")).select("side", "text_id", "size", "x.*")
    record = classes.select("side", "text_id", F.lit(0).alias("size"), F.xxhash64(F.lit("k"), "key").alias("shingle"), F.lit(-1).alias("place"))
    return rare.unionByName(record)


def met(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """(e, t) of all evaluation and training texts that share a shingle and pass the length and position filters."""
    found, a = materialize(prefixes(classes), "prefixes")
    on = lambda side: F.count_if(F.col("side") == side)
    over, b = materialize(found.where("place >= 0").groupBy("shingle").agg(F.least(on("eval"), on("train")).alias("n")).where(F.col("n") > hot).select("shingle"), "hot-shingles")
    plain = found.join(over, "shingle", "left_anti")
    side = lambda df, s, names: df.where(F.col("side") == s).select("shingle", *[F.col(a).alias(b) for a, b in names.items()])
    e, t = (side(plain, s, {"text_id": a, "size": n, "place": i}) for s, a, n, i in (("eval", "e", "n", "i"), ("train", "t", "m", "j")))
    pairs = e.join(t, "shingle").where("i = j and i < 0 or i >= 0 and j >= 0 and abs(n - m) <= 1 and 1 + least(n - i, m - j) >= greatest(n, m)").select("e", "t")
    # what the hot shingles held, and the one-word texts, which have no second word
    rest = found.join(over, "shingle").select("text_id", "shingle").unionByName(found.where("size = 1 and place = 0").select("text_id", F.lit(0).cast("long").alias("shingle")))
    split, c = materialize(rest.join(classes.select("text_id", "side", "bag"), "text_id").mapInPandas(_splitter, "side string, text_id long, shingle long"), "split-shingles")
    pairs = pairs.unionByName(side(split, "eval", {"text_id": "e"}).join(side(split, "train", {"text_id": "t"}), "shingle").select("e", "t"))
    pairs, _ = materialize(pairs.distinct(), "candidates")
    discard(classes.sparkSession, a, b, c)
    return pairs


def text_classes(train: DataFrame, evaluation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members (side, id, text_id) of both sides, both as from :func:`texts`, and their distinct texts
    (side, text_id, bag, key, copies), a bag being a text's sorted words and the key its record. Texts without a letter or
    digit are left out."""
    sides = [x.select(F.lit(side).alias("side"), "id", "text") for side, x in (("train", train), ("eval", evaluation))]
    rows = keyed(sides[0].unionByName(sides[1]), "id", "text", "side", bag=lambda fold: F.array_join(F.array_sort(F.split(words(fold), " ")), " "))
    classes, _ = materialize(rows.groupBy("side", "bag", "key").agg(F.count("*").alias("copies")).withColumn("text_id", F.monotonically_increasing_id()), "classes")  # numbers stay as written
    members, _ = materialize(rows.join(classes.select("side", "bag", "key", "text_id"), ["side", "bag", "key"]).select("side", "id", "text_id"), "members")
    return members, classes


def class_pairs(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """(e, t): text_ids of every evaluation and training text that are the same record or near."""
    known = lambda side, at, name: classes.where(F.col("side") == side).select(F.col("text_id").alias(at), F.col("bag").alias(f"{name}_bag"), F.col("key").alias(f"{name}_key"))
    full = met(classes, hot).join(known("eval", "e", "eval"), "e").join(known("train", "t", "train"), "t")
    same = F.col("eval_key") == F.col("train_key")
    return full.where(same | _near_udf(F.when(~same, F.col("eval_bag")).otherwise(""), F.when(~same, F.col("train_bag")).otherwise(""))).select("e", "t")


def overlaps(train: DataFrame, evaluation: DataFrame, hot: int = HOT) -> DataFrame:
    """(eval_id, train_id) of all rows whose texts are the same record or near; both sides as from :func:`texts`.

    Copies are one text for the search and only meet again in the result. Texts without a letter or digit overlap with
    nothing; empty tables give no rows; a repeated id has the pairs of all its texts.
    """
    members, classes = text_classes(train, evaluation)
    of = lambda side, at: members.where(F.col("side") == side).select(F.col("id").alias(f"{side}_id"), F.col("text_id").alias(at))
    return class_pairs(classes, hot).join(of("eval", "e"), "e").join(of("train", "t"), "t").select("eval_id", "train_id").distinct()


def overlap_counts(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(eval_id, pairs) of the evaluation rows with an overlap: how many training rows there are. Only distinct texts are
    paired; copies are counted, not expanded."""
    members, classes = text_classes(train, evaluation)
    copies = classes.where("side = 'train'").select(F.col("text_id").alias("t"), "copies")
    each = class_pairs(classes).join(copies, "t").groupBy("e").agg(F.sum("copies").alias("pairs"))
    return members.where("side = 'eval'").select(F.col("id").alias("eval_id"), F.col("text_id").alias("e")).join(each, "e").groupBy("eval_id").agg(F.sum("pairs").alias("pairs"))
