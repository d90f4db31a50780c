"""Evaluation passages inside a corpus: pigeonhole pieces, exact hits, Myers verification.

A passage is any ``WINDOW`` consecutive words of an item, or the whole of a shorter one; it may be changed by ``BUDGET``
word edits (one in six words, so one under twelve words and none under six). Cut into one piece more than its edits, one
piece stays as it is. The pieces of all passages are the index: pieces of four words at every place of an item, halves of
items of six to eleven words, shorter items whole.

The corpus is read once. Every document's words are hashed in numpy and looked up in a bit table of the pieces, which is
all that is broadcast and of bounded size; the few places that hit go on with the words around them, meet their pieces
in a join on the hash, and are verified by Myers' bit-parallel algorithm over words, many at a time. A full bit table or a
chance equality of hashes only sends more places on; passages without edits are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.reading import fold_text
from quernstone.session import materialize

WINDOW, BUDGET = 12, 2
AROUND = WINDOW + BUDGET  # words of a document that are looked at on either side of a piece
LEAST_BITS, MOST_BITS, BITS_A_PIECE = 16, 28, 512  # of the bit table: 2^28 bits are 32 MB
PAIRS = 50_000  # passages that are verified at a time
CHARS = 1 << 21  # characters of documents that are hashed at a time
_TAG = regex.compile(r"<[^<>]*>")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PIECES = "item_id long, hash long, size int, own array<long>, own_text string, first int, item_words int"
_HITS = "doc_id long, hash long, words array<long>, text string, at int, size int"
_LEAKS = "doc_id long, item_id long, item_words int, edits int"
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def marked_text(text: str) -> str:
    return fold_text(_TAG.sub(" ", text), trademarks=False)


def passage_words(text: str) -> list[str]:
    """Runs of letters and digits in NFKC and lower case; markup tags separate, Cf characters vanish."""
    return _WORD.findall(marked_text(text))


def budget(words: int) -> int:
    """Word edits that a passage of so many words may have."""
    return min(BUDGET, words // 6)


def pieces(words: int) -> list[tuple[int, int]]:
    """(first word, size) of the pieces of an item of so many words."""
    if words >= WINDOW:
        size = WINDOW // (BUDGET + 1)
        return [(i, size) for i in range(words - size + 1)]
    parts = budget(words) + 1
    cuts = [words * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


class Hasher:
    """64-bit hashes of all words of a text in numpy: a word is a polynomial of its characters, read off prefix sums."""

    def __init__(self):
        kept = regex.compile(r"[\p{L}\p{N}]")
        self.is_word = np.zeros(0x110000, dtype=bool)
        for at in range(0, 0x110000, 0x1000):  # surrogates are no characters
            chunk = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(at, at + 0x1000))
            self.is_word[at : at + 0x1000] = np.frombuffer(kept.sub("￿", chunk.replace("￿", " ")).encode("utf-32-le"), dtype=np.uint32) == 0xFFFF
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 1 << 16)
            base, inverse = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            base[0] = inverse[0] = 1
            self.up, self.down = np.multiply.accumulate(base), np.multiply.accumulate(inverse)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes) of the words of a text."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        on = np.zeros(len(codes) + 2, dtype=np.int8)
        on[1:-1] = self.is_word[codes]
        edge = np.diff(on)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self._powers(len(codes))
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)], out=sums[1:])
        return starts, ends, _stir((sums[ends] - sums[starts]) * self.down[starts])


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = _stir(out * np.uint64(_BASE) + hashes[k : k + n])
    return out


_HASHER: list[Hasher] = []


def hasher() -> Hasher:
    if not _HASHER:
        _HASHER.append(Hasher())  # a worker builds its table once
    return _HASHER[0]


def _item_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for item, text in zip(pdf["item_id"], pdf["text"]):
            plain = marked_text(text)
            words, (_, _, hashes) = _WORD.findall(plain), hasher().words(plain)
            for at, size in pieces(len(words)):
                low = max(0, at + size - WINDOW)
                rows.append((item, int(grams(hashes[at : at + size], size)[0].astype(np.int64)), size, hashes[low : at + WINDOW].astype(np.int64), " ".join(words[low : at + WINDOW]), at - low, len(words)))
        yield pd.DataFrame(rows, columns=["item_id", "hash", "size", "own", "own_text", "first", "item_words"])


def item_pieces(items: DataFrame) -> DataFrame:
    """The index: a row a piece with the words of its item around it."""
    return items.toDF("item_id", "text").where("item_id is not null and text is not null").mapInPandas(_item_pieces, _PIECES)


def bit_table(index: DataFrame) -> tuple[list[int], int, np.ndarray]:
    """(sizes of pieces, bits, table) that says of a hash whether it may be a piece's. The driver gets the table's words
    that are not empty, at most 2^MOST_BITS bits whatever the number of pieces."""
    n, sizes = index.agg(F.count("*"), F.collect_set("size")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_A_PIECE).bit_length()))
    # two places a piece, from the upper and the lower bits of its hash
    slot = F.explode(F.array(F.shiftrightunsigned("hash", 64 - bits), F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))))
    slots = index.select(slot.alias("slot")).select(F.shiftright("slot", 3).cast("int").alias("word"), F.expr("shiftleft(1, cast(slot & 7 as int))").alias("bit"))
    words = slots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.uint8)
    return sorted(sizes), bits, table


def _set(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _lookup(held):
    def hits(docs: list[int], texts: list[str], sizes: list[int], bits: int, table: np.ndarray) -> list[tuple]:
        ends_at = np.cumsum([len(t) + 1 for t in texts])
        whole = "\n".join(texts)
        starts, ends, hashes = hasher().words(whole)
        doc_of = np.searchsorted(ends_at, starts, side="right")
        first = np.searchsorted(starts, np.concatenate([[0], ends_at]))  # the first word of each document
        rows = []
        for size in sizes:
            h = grams(hashes, size)
            at = np.flatnonzero(_set(table, h >> np.uint64(64 - bits)))
            at = at[_set(table, h[at] & np.uint64((1 << bits) - 1))]
            at = at[doc_of[at] == doc_of[at + size - 1]]
            for i, d, x in zip(at.tolist(), doc_of[at].tolist(), h[at].astype(np.int64).tolist()):
                low, high = max(int(first[d]), i - AROUND), min(int(first[d + 1]), i + size + AROUND)
                rows.append((docs[d], x, hashes[low:high].astype(np.int64), " ".join(_WORD.findall(whole[starts[low] : ends[high - 1]])), i - low, size))
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, bits, table = held.value
        for pdf in batches:
            docs, texts, chars = [], [], 0
            for doc, text in [*zip(pdf["doc_id"], pdf["text"]), (None, None)]:
                if text is not None:
                    docs.append(doc)
                    texts.append(marked_text(text))
                    chars += len(texts[-1])
                if docs and (text is None or chars >= CHARS):
                    yield pd.DataFrame(hits(docs, texts, sizes, bits, table), columns=["doc_id", "hash", "words", "text", "at", "size"])
                    docs, texts, chars = [], [], 0

    return run


def distances(pattern: np.ndarray, sizes: np.ndarray, text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Least edits of each pattern anywhere in its text, by Myers' bit-parallel algorithm on all rows at a time. Rows of
    ``pattern`` and ``text`` are words, of which the first ``sizes`` and ``lengths`` count; a pattern has at most 31."""
    one = np.uint32(1)
    full = (one << sizes.astype(np.uint32)) - one
    top = (sizes - 1).astype(np.uint32)
    pv, mv, score, best = full.copy(), np.zeros_like(full), sizes.astype(np.int32), sizes.astype(np.int32)
    for t in range(text.shape[1]):
        eq = np.zeros_like(full)
        for j in range(pattern.shape[1]):
            eq |= (pattern[:, j] == text[:, t]).astype(np.uint32) << np.uint32(j)
        eq &= full
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += ((ph >> top) & one).astype(np.int32) - ((mh >> top) & one).astype(np.int32)
        ph <<= one
        pv, mv = ((mh << one) | ~(xv | ph)) & full, ph & xv & full
        best = np.where(t < lengths, np.minimum(best, score), best)
    return best


def passages(first: np.ndarray, size: np.ndarray, item_words: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of every passage of an item around its piece, by the row of the piece; ``own`` has the words around it."""
    span = np.minimum(WINDOW, item_words)
    low, high = np.maximum(0, first + size - span), np.minimum(first, own - span)
    n = np.maximum(0, high - low + 1)
    row = np.repeat(np.arange(len(n)), n)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _gathered(values: np.ndarray, at: np.ndarray, n: np.ndarray, width: int, fill: int) -> np.ndarray:
    places = at[:, None] + np.arange(width)
    held = np.arange(width) < n[:, None]
    return np.where(held, values[np.minimum(places, max(len(values) - 1, 0))], fill)


def edits_of(own: tuple, first: np.ndarray, size: np.ndarray, item_words: np.ndarray, words: tuple, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, start) of the best passage around each piece, ``BUDGET + 1`` edits where there is none. ``own`` and ``words``
    are (values, offsets) of the words around the piece in its item and in the document."""
    (o, o_at), (w, w_at) = own, words
    most = np.minimum(BUDGET, item_words // 6)
    edits, where = np.full(len(first), BUDGET + 1), np.zeros(len(first), dtype=np.int64)
    rows, starts = passages(first, size, item_words, np.diff(o_at))
    for i in range(0, len(rows), PAIRS):
        r, a = rows[i : i + PAIRS], starts[i : i + PAIRS]
        span, begin = np.minimum(WINDOW, item_words[r]), np.maximum(0, a + at[r] - first[r] - most[r])
        stop = np.minimum(a + at[r] - first[r] + span + most[r], (w_at[1:] - w_at[:-1])[r])
        d = distances(_gathered(o, o_at[r] + a, span, WINDOW, 0), span, _gathered(w, w_at[r] + begin, stop - begin, WINDOW + 2 * BUDGET, 1), stop - begin)
        order = np.lexsort((a, d, r))
        r, a, d = r[order], a[order], d[order]
        best = np.concatenate([[True], r[1:] != r[:-1]])
        r, a, d = r[best], a[best], d[best]
        better = d < edits[r]
        edits[r[better]], where[r[better]] = d[better], a[better]
    return np.where(edits <= most, edits, BUDGET + 1), where


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def listed(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()

    for b in batches:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        number = lambda n: col[n].to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        first, item_words = number("first"), number("item_words")
        edits, at = edits_of(listed(col["own"]), first, number("size"), item_words, listed(col["words"]), number("at"))
        kept = edits <= BUDGET
        for i in np.flatnonzero(edits == 0):  # hashes are equal; so must be the words
            passage = col["own_text"][i].as_py().split(" ")[at[i] : at[i] + min(WINDOW, item_words[i])]
            kept[i] = f" {' '.join(passage)} " in f" {col['text'][i].as_py()} "
        keep = pa.array(kept)
        yield pa.RecordBatch.from_arrays([col["doc_id"].filter(keep), col["item_id"].filter(keep), col["item_words"].filter(keep), pa.array(edits[kept], pa.int32())], ["doc_id", "item_id", "item_words", "edits"])


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, edits): documents that hold a passage of an item within its budget of word edits, and
    the fewest edits of one. That a document and an item share ``WINDOW`` consecutive words is what ``edits = 0 and
    item_words >= WINDOW`` says.

    ``documents`` is (doc_id, text), ``items`` (item_id, text). Null ids and texts and items without words match nothing;
    repeated documents and items are one each by their id; whole texts are searched. A piece that many documents hold is
    one row an item on the other side of the join, which adaptive execution splits.
    """
    index, _ = materialize(item_pieces(items), "pieces")
    held = documents.sparkSession.sparkContext.broadcast(bit_table(index))
    docs = documents.toDF("doc_id", "text").where("doc_id is not null and text is not null")
    hits = docs.mapInPandas(_lookup(held), _HITS)
        # where the words before a piece are equal too, the piece before it hits as well, and its passages have no more edits
    goes_on = (F.col("item_words") >= WINDOW) & (F.get("own", F.col("first") - 1) == F.get("words", F.col("at") - 1))
    met = hits.join(index, ["hash", "size"]).where(~F.coalesce(goes_on, F.lit(False)))
    return met.mapInArrow(_verify, _LEAKS).groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.min("edits").alias("edits"))


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: the documents that hold a passage of it, without any edit and in any form."""
    exact = (F.col("edits") == 0) & (F.col("item_words") >= WINDOW)
    counts = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct(F.when(exact, F.col("doc_id"))).alias("documents_exact"), F.min("edits").alias("fewest_edits"))
    return items.select("item_id", "eval_split").join(counts, "item_id", "left").na.fill(0, ["documents", "documents_exact"])
