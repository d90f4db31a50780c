"""Abusive, hateful or sexual text: a linear-chain CRF over words, trained on labelled documents.

Labels say of a document that something in it is abusive, not where. Training therefore alternates: the present model
says which sentences of a positive document are meant (at first word statistics do) and which of their words, those of the
word classes with them; these words become labelled spans, the rest of the sentence and the sentences of negative documents
are labelled clean, and words, moves and start of the chain are fitted again. Forward-backward marginals give the
probability that a word is inside an abusive span. A document scores by its worst span (the mean of the span's words), so it
is found whenever a span is tagged; long sentences are read in overlapping chains.

Words are read through the usual disguises: zero-width characters, look-alike letters, digits and signs for letters,
stretched, starred, swapped and spaced-out letters.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.lexicon import ABUSIVE, CLASSES, INNOCENT

# bounds of the labelled sample the model is fitted on; everything is scored
MAX_POSITIVE, MAX_NEGATIVE = 3_000, 6_000
BITS, CHAIN, OVERLAP, MIN_DOCS, THRESHOLD = 18, 60, 30, 3, 0.5

# fixed values: Cyrillic and Greek letters that look Latin, and signs that stand for letters
LOOKALIKE = str.maketrans("абвгдеёзіїјкмнорстухѕԁԛԝαβγεικνορτυχ", "abbrdeeziijkmhopctyxsdqwabyeiknoptux")
SIGNS = str.maketrans("0134578@$!|+", "oieastbasiit")
_TAG = regex.compile(r"<[^<>]*>")
_SPACED = regex.compile(r"(?<![\p{L}\p{N}])\p{L}(?:([ ._\-])\p{L})(?:\1\p{L})+(?![\p{L}\p{N}])(?![._\-]\p{L})")
_MAY_SPACE = re.compile(r"(?<![^\W_])[^\W_]([ ._\-])[^\W_]\1[^\W_]")  # a quick test: whatever _SPACED finds begins so
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}@$*]+(?:[!|+'’][\p{L}\p{M}\p{N}@$*]+)*")
_SENTENCE = regex.compile(r"(?<=[.!?…])\s+|\n+|\s{2,}")
_CF = regex.compile(r"\p{Cf}+")
_LONG = re.compile(r"(.)\1{2,}")
_CLASS = {w: k for k, (_, words) in enumerate(CLASSES.items()) for w in words.split()}
_CLASS_BITS: dict[str, int] = defaultdict(int)
for _k, _words in enumerate(CLASSES.values()):
    for _w in _words.split():
        _CLASS_BITS[_w] |= 1 << _k
_MARKED = frozenset(w for name in ("insult", "slight", "sex", "body", "base", "harm") for w in CLASSES[name].split())


def sentences(text: str) -> list[tuple[int, str]]:
    """(offset, sentence) of ``text``; markup tags become spaces, so offsets are those of the text."""
    text = _TAG.sub(lambda m: " " * len(m.group()), text) if "<" in text else text
    out, at = [], 0
    for cut in _SENTENCE.finditer(text):
        if cut.start() > at:
            out.append((at, text[at : cut.start()]))
        at = cut.end()
    if at < len(text):
        out.append((at, text[at:]))
    return out


def sentence_words(part: str) -> list[tuple[int, int, str]]:
    """(start, end, raw word) of a sentence; letters that are spaced out are one word."""
    out, i = [], 0
    for m in [*(_SPACED.finditer(part) if _MAY_SPACE.search(part) else ()), None]:
        s, e = m.span() if m else (len(part), len(part))
        out += [(w.start(), w.end(), w.group()) for w in _TOKEN.finditer(part, i, s)]
        if m:
            out.append((s, e, regex.sub(r"[ ._\-]", "", part[s:e])))
        i = e
    return out


def tokens(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Whole sentences as lists of (start, end, raw word); offsets are those of ``text``."""
    for at, part in sentences(text):
        if words := sentence_words(part):
            yield [(at + s, at + e, w) for s, e, w in words]


def chains(n: int) -> list[tuple[int, int]]:
    """Where chains of at most CHAIN of a sentence's n words start and end; neighbours share at least OVERLAP words."""
    starts = [*range(0, max(n - CHAIN, 0), CHAIN - OVERLAP), max(n - CHAIN, 0)]
    return [(a, min(a + CHAIN, n)) for a in starts]


def joined(parts: list[np.ndarray], n: int) -> np.ndarray:
    """Figures of a sentence's words from those of its chains; each word's come from the chain that shows most around it."""
    out, cuts = np.zeros(n, dtype=np.float32), chains(n)
    for k, (a, b) in enumerate(cuts):
        lo = (a + cuts[k - 1][1]) // 2 if k else a
        out[lo:b] = parts[k][lo - a :]
    return out


def spans(p: np.ndarray) -> list[tuple[int, int]]:
    """First and last word of each run of words that are more likely abusive than THRESHOLD."""
    if not p.size or p.max() <= THRESHOLD:
        return []
    on = np.concatenate([[False], p > THRESHOLD, [False]])
    return list(zip(np.flatnonzero(on[1:] & ~on[:-1]).tolist(), (np.flatnonzero(on[:-1] & ~on[1:]) - 1).tolist()))


def best(p: np.ndarray) -> float:
    """The greatest mean of a span; without one, the likeliest word."""
    return max((float(p[a : b + 1].mean()) for a, b in spans(p)), default=float(p.max(initial=0)))


def plain(word: str) -> str:
    w = _CF.sub("", unicodedata.normalize("NFKC", _CF.sub("", word))).lower()
    if not w.isascii() and any("a" <= c <= "z" for c in w) or any(c in "іѕј" for c in w):
        w = w.translate(LOOKALIKE)
    return w.replace("’", "'")


class _Known(dict):
    """Ids of the words seen so far; others are found when they are asked for."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = self.find(word)
        return got


class Reader:
    """Words to ids of a vocabulary, undoing disguises for words it doesn't know."""

    def __init__(self, vocabulary: list[str]):
        self.ids = {w: i + 4 for i, w in enumerate(vocabulary)}  # 0 pad, 1 unknown, 2 number, 3 disguised and unknown
        self.bits = np.zeros(len(vocabulary) + 4, dtype=np.int64)
        for w, i in self.ids.items():
            self.bits[i] = _CLASS_BITS.get(w, 0)
        self.by_letters: dict[str, str] = {}
        for w in vocabulary:
            if len(w) >= 4:
                self.by_letters.setdefault("".join(sorted(w)), w)
        self.marked = [w for w in vocabulary if w in _MARKED and len(w) >= 3]
        self.known = _Known(self._find)
        self.near: dict[str, list[int]] = {}  # marked words by what they are without a letter
        for i, m in enumerate(self.marked):
            for x in _shorter(m) if len(m) >= 5 else ():
                self.near.setdefault(x, []).append(i)

    def id(self, word: str) -> int:
        return self.known[word]

    def _find(self, word: str) -> int:
        w = plain(word)
        if w in self.ids:
            return self.ids[w]
        if w.isdigit():
            return 2
        signs = w.translate(SIGNS) if any(not c.isdigit() for c in w) else w
        for x in (w, signs):
            for y in (x, _LONG.sub(r"\1\1", x), _LONG.sub(r"\1", x)):
                if y in self.ids:
                    return self.ids[y]
        s = _LONG.sub(r"\1", signs)
        if "*" in signs:
            try:
                pattern = re.compile("".join("\\w{1,%d}" % len(g) if g[0] == "*" else re.escape(g) for g in re.findall(r"\*+|[^*]+", s)))
                hit = next((m for m in self.marked if pattern.fullmatch(m)), None)
            except re.error:
                hit = None
            return self.ids[hit] if hit else 3
        if s.isalpha() and len(s) >= 4:
            other = self.by_letters.get("".join(sorted(s)))
            if other and other[0] == s[0] or other and other in _MARKED:
                return self.ids[other]
            if signs != w or s != w or len(s) >= 6:
                for i in sorted({i for x in _shorter(s) for i in self.near.get(x, ())}):
                    if abs(len(self.marked[i]) - len(s)) <= 1 and _one_edit(self.marked[i], s):
                        return self.ids[self.marked[i]]
        for k in range(3, len(s) - 2) if len(s) <= 24 else ():
            if s[:k] in _MARKED and s[k:] in _MARKED and s[:k] in self.ids:
                return self.ids[s[:k]]
        return 3 if signs != w else 1


def _shorter(w: str) -> set[str]:
    """A word and what it is without one of its letters; words one edit apart share one of these."""
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


def _one_edit(a: str, b: str) -> bool:
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


_AT = {name: k for k, name in enumerate(CLASSES)}
_TELLING = sum(1 << _AT[name] for name in ("insult", "slight", "sex", "body", "base", "harm"))
_MEANT = sum(1 << _AT[name] for name in ("you", "group"))
_PAIRS = [(_AT[a], _AT[b]) for a, b in (("group", "base"), ("group", "harm"), ("you", "insult"), ("you", "slight"), ("you", "harm"), ("you", "sex"), ("self", "insult"), ("sex", "body"), ("slight", "insult"), ("self", "harm"))]
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(template: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(parts[0].shape, template, dtype=np.uint64) * _PRIMES[4]
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ (p.astype(np.uint64) + np.uint64(template))) * _PRIMES[1]
            h ^= h >> np.uint64(29)
    return ((h * _PRIMES[0]) >> np.uint64(64 - BITS)).astype(np.int32)


def _shifted(on: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(on)
    n = on.shape[1]
    if abs(by) < n:
        out[:, max(by, 0) : n + min(by, 0)] = on[:, max(-by, 0) : n - max(by, 0)]
    return out


def _closed(on: np.ndarray) -> np.ndarray:
    """Gaps of at most two words closed."""
    return on | np.logical_or.reduce([_shifted(on, a) & _shifted(on, -b) for a, b in ((1, 1), (1, 2), (2, 1))])


def listed(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the word classes point to a word of ``ids`` (sentences x words): telling words, who is meant close by, and
    what lies between."""
    own = bits[ids]
    on = ((own & _TELLING) != 0) | (ids == 3)
    near = np.logical_or.reduce([_shifted(on, k) for k in range(-3, 4)])
    return _closed(on | near & ((own & _MEANT) != 0))


def features(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Hashed features of every word of ``ids`` (sentences x words, 0 pads): neighbours, their n-grams and word classes."""
    n, length = ids.shape
    wide = np.zeros((n, length + 4), dtype=np.int64)
    wide[:, 2:-2] = ids
    w = {k: wide[:, 2 + k : 2 + k + length] for k in range(-2, 3)}
    c = {k: bits[x] for k, x in w.items() if abs(k) < 2}
    all_bits = np.bitwise_or.reduce(bits[ids], axis=1)[:, None] + np.zeros_like(ids)
    first = ids[:, :1] + np.zeros_like(ids)
    second = (ids[:, 1:2] if length > 1 else ids[:, :1]) + np.zeros_like(ids)
    on = listed(ids, bits)
    zone = np.where(on.any(axis=1)[:, None], on, 2)  # what holds for a sentence counts apart outside its listed words
    parts = [(w[0],), (w[-1],), (w[1],), (w[-1], w[0]), (w[0], w[1]), (w[-2], w[-1], w[0]), (w[-1], w[0], w[1]), (w[0], w[1], w[2]), (w[-2], w[0]), (w[0], w[2]),
             (c[0],), (c[-1], c[0]), (c[0], c[1]), (all_bits, zone), (c[0], all_bits), (first, all_bits, zone), (first, second, zone), (first, w[0])]
    out = [_mix(k + 1, *p) for k, p in enumerate(parts)]
    for a, b in _PAIRS:
        out.append(_mix(200 + 16 * a + b, (all_bits >> a) & (all_bits >> b) & 1, zone))
    for k in range(len(CLASSES)):
        out.append(_mix(100 + k, (all_bits >> k) & 1, zone))
    return np.stack(out, axis=2)


class Chain:
    """Binary linear-chain CRF: clean words have no weights of their own, abusive ones the sum of their features'."""

    def __init__(self):
        self.weights = np.zeros(1 << BITS, dtype=np.float32)
        self.moves = np.array([[2.0, -2.0], [-2.0, 2.0]])
        self.start = np.array([0.0, -1.0])

    def marginals(self, feats: np.ndarray, mask: np.ndarray, weight: np.ndarray | None = None, moving: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """P(abusive) of each word and, unless ``moving`` is off, the expected number of each transition, sentences counted by
        ``weight``."""
        n, length = mask.shape
        e = np.zeros((n, length, 2))
        e[..., 1] = self.weights[feats].sum(axis=2)
        fwd, bwd = np.zeros((length, n, 2)), np.zeros((length, n, 2))
        fwd[0] = self.start + e[:, 0]
        for t in range(1, length):
            nxt = np.logaddexp(fwd[t - 1][:, 0:1] + self.moves[0], fwd[t - 1][:, 1:2] + self.moves[1]) + e[:, t]
            fwd[t] = np.where(mask[:, t, None], nxt, fwd[t - 1])
        for t in range(length - 2, -1, -1):
            on = bwd[t + 1] + e[:, t + 1]
            prev = np.logaddexp(self.moves[:, 0] + on[:, 0:1], self.moves[:, 1] + on[:, 1:2])
            bwd[t] = np.where(mask[:, t + 1, None], prev, 0)
        z = np.logaddexp(fwd[-1][:, 0], fwd[-1][:, 1])
        p = np.exp(np.clip(fwd[..., 1] + bwd[..., 1] - z, -60, 0)).T * mask
        if not moving:
            return p, np.zeros((2, 2))
        on = (bwd + e.transpose(1, 0, 2))[1:]
        each = np.exp(np.clip(fwd[:-1, :, :, None] + self.moves + on[:, :, None, :] - z[:, None, None], -60, 0)) * mask.T[1:, :, None, None]
        return p, (each if weight is None else each * weight[:, None, None]).sum(axis=(0, 1))

    def fit(self, batches: list[tuple], labels: list[np.ndarray], weight: np.ndarray, epochs: int, seed: int = 5) -> None:
        """``batches`` as from :func:`prepared`; ``labels`` has a 0 or 1 for every word; features, moves and start follow
        expected less observed counts. Only the features of a batch move with it."""
        rng = np.random.default_rng(seed)
        given = [(weight[x], feats, mask, own, at, _padded([labels[i] for i in x])[0]) for x, feats, mask, own, at in batches]
        squares = np.full(1 << BITS, 1e-2, dtype=np.float32)
        squares_moves, squares_start = np.full((2, 2), 1e-2), np.full(2, 1e-2)
        for epoch in range(epochs):
            rate = 0.15 / (1 + 0.3 * epoch)
            for k in rng.permutation(len(given)):
                w, feats, mask, own, at, y = given[k]
                p, expected = self.marginals(feats, mask, w)
                gap = ((p - y) * w[:, None]).astype(np.float32)
                grad = np.bincount(at, weights=np.broadcast_to(gap[:, :, None], feats.shape).reshape(-1), minlength=len(own)).astype(np.float32)
                grad += 1e-4 * self.weights[own]
                squares[own] += grad * grad
                self.weights[own] -= rate * grad / np.sqrt(squares[own])
                grad = expected - transitions(y, mask, w) + 1e-4 * self.moves
                squares_moves += grad * grad
                self.moves = self.moves - rate * grad / np.sqrt(squares_moves)
                grad = gap[:, 0].sum(dtype=float) * np.array([-1.0, 1.0]) + 1e-4 * self.start
                squares_start += grad * grad
                self.start = self.start - rate * grad / np.sqrt(squares_start)


def prepared(sentences: list[np.ndarray], bits: np.ndarray) -> list[tuple]:
    """Batches of sentences of like length for :meth:`Chain.fit`: their numbers, features, mask, the features that occur and
    where each stands among them."""
    out = []
    for x in _by_length(sentences, 256):
        ids, mask = _padded([sentences[i] for i in x])
        feats = features(ids, bits)
        own, at = np.unique(feats.reshape(-1), return_inverse=True)
        out.append((x, feats, mask, own, at.astype(np.int32)))
    return out


def transitions(labels: np.ndarray, mask: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The number of each transition in labelled sentences, counted by ``weight``."""
    both = np.broadcast_to(weight[:, None], mask[:, 1:].shape)[mask[:, 1:]]
    return np.bincount((2 * labels[:, :-1] + labels[:, 1:])[mask[:, 1:]], weights=both, minlength=4).reshape(2, 2)


def _padded(sentences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, sentences))
    ids = np.zeros((len(sentences), length), dtype=np.int64)
    for i, s in enumerate(sentences):
        ids[i, : len(s)] = s
    mask = np.arange(length)[None, :] < np.array([len(s) for s in sentences])[:, None]
    return ids, mask


def _by_length(sentences: list[np.ndarray], size: int) -> list[np.ndarray]:
    order = np.argsort([len(s) for s in sentences], kind="stable")
    return [order[i : i + size] for i in range(0, len(order), size)]


class Tagger:
    """Reads sentences, each distinct one once: what was found in it is kept and looked up when it comes again."""

    def __init__(self, reader: Reader, chain: Chain):
        self.reader, self.chain = reader, chain
        self._found: dict[str, tuple[float, tuple[tuple[int, int], ...]]] = {}

    def words(self, sentences: list[np.ndarray]) -> list[np.ndarray]:
        """P(abusive) of each word of each sentence, given as ids; equal ones are figured once."""
        keys = [s.tobytes() for s in sentences]
        new = dict(zip(keys, sentences))
        todo, found = list(new.values()), {}
        for x in _by_length(todo, 512) if todo else ():
            ids, mask = _padded([todo[i] for i in x])
            p, _ = self.chain.marginals(features(ids, self.reader.bits), mask, moving=False)
            for row, i in zip(p, x):
                found[todo[i].tobytes()] = row[: len(todo[i])].astype(np.float32)
        return [found[k] for k in keys]

    def _learn(self, parts: list[str]) -> None:
        known, read = self.reader.known, []
        for part in parts:
            words = [w for _, _, w in sentence_words(part)] if _MAY_SPACE.search(part) else _TOKEN.findall(part)
            if words:
                read.append((part, np.array([known[w] for w in words], dtype=np.int64)))
        probs = iter(self.words([ids[a:b] for _, ids in read for a, b in chains(len(ids))]))
        self._found.update(dict.fromkeys(parts, (0.0, ())))
        for part, ids in read:
            p = next(probs) if len(ids) <= CHAIN else joined([next(probs) for _ in chains(len(ids))], len(ids))
            top = float(p.max())
            if top <= THRESHOLD:
                self._found[part] = (top, ())
                continue
            found, words = spans(p), sentence_words(part)  # places are only needed here
            self._found[part] = (best(p), tuple((words[a][0], words[b][1]) for a, b in found))

    def documents(self, texts: list[str]) -> list[tuple[float, list[int], list[int]]]:
        """(score, starts, ends of the abusive spans) of each text."""
        read = [sentences(t) for t in texts]
        if len(self._found) > 200_000:
            self._found.clear()
        new = {part for doc in read for _, part in doc if part not in self._found}
        self._learn(sorted(new))
        out = []
        for doc in read:
            score, starts, ends = 0.0, [], []
            for at, part in doc:
                own, found = self._found[part]
                score = max(score, own)
                starts += [at + a for a, _ in found]
                ends += [at + b for _, b in found]
            out.append((score, starts, ends))
        return out


def pointed(ids: np.ndarray, bits: np.ndarray, odds: list[float], p: np.ndarray | None = None) -> np.ndarray:
    """A 0 or 1 for every word of an abusive sentence: the words that the classes or the model (``p``) point to, with who is
    meant close by, else those of its most telling pairs (``odds`` of each pair); gaps of two words are closed."""
    on = listed(ids[None, :], bits)[0]
    if p is not None:
        on |= p > THRESHOLD
    if not on.any():
        for k, x in enumerate(odds):
            if x >= max(odds) - 1:
                on[k : k + 2] = True
        on |= not odds
    return _closed(on[None, :])[0].astype(np.int64)


def train(sample: list[tuple[str, int]], rounds: int = 3, epochs: int = 6) -> Tagger:
    """A tagger from (text, label) documents; without any it rests on the seed sentences."""
    raw = [([[w for _, _, w in s] for s in tokens(t)], y) for t, y in sample]
    read = {w: plain(w) for doc, _ in raw for s in doc for w in s}
    split = [([[read[w] for w in s] for s in doc], y) for doc, y in raw]
    seeds = [([s.split()], y) for part, y in ((ABUSIVE, 1), (INNOCENT, 0)) for s in part]
    docs_with = Counter(w for doc, _ in split for w in {w for s in doc for w in s if w.isalpha()})
    vocabulary = sorted({w for w, n in docs_with.items() if n >= MIN_DOCS} | set(_CLASS) | {w for doc, _ in seeds for s in doc for w in s})
    reader = Reader(vocabulary)
    where: dict[bytes, int] = {}
    sentences: list[np.ndarray] = []

    def known(words: list[str]) -> int:
        ids = np.array([reader.known[w] for w in words], dtype=np.int64)
        key = ids.tobytes()
        if key not in where:
            where[key] = len(sentences)
            sentences.append(ids)
        return where[key]

    docs = [(sorted({known(s[a:b]) for s in doc for a, b in chains(len(s))}), y) for doc, y in raw]
    seed_of = {known(doc[0]): y for doc, y in seeds}
    n = len(sentences)
    pos, neg = np.zeros(n), np.zeros(n)
    for doc, y in docs:
        (pos if y else neg)[doc] += 1
    n_pos, n_neg = sum(y for _, y in docs), sum(1 - y for _, y in docs)

    # first guess: pairs of words that mark positive documents, and word classes
    grams = [set(zip(s[:-1].tolist(), s[1:].tolist())) for s in sentences]
    in_pos, in_neg = Counter(), Counter()
    for doc, y in docs:
        (in_pos if y else in_neg).update(set().union(*[grams[i] for i in doc]) if doc else ())
    prior = (n_pos + 1) / (n_pos + n_neg + 2)
    logit = lambda x: np.log(x / (1 - x))
    odds = lambda g: logit((in_pos[g] + 2 * prior) / (in_pos[g] + in_neg[g] + 2)) - logit(prior)
    marked = sum(1 << k for k, name in enumerate(CLASSES) if name in ("insult", "sex", "body", "base", "harm"))
    telling = np.array([bool((reader.bits[s] & marked).any() or (s == 3).any()) for s in sentences])
    guess = np.array([float(np.mean(sorted((odds(g) for g in gr), reverse=True)[:3])) if gr else 0.0 for gr in grams]) + telling
    label = 1 / (1 + np.exp(-(guess - 2.5)))

    tagger, probs, batches = Tagger(reader, Chain()), [None] * n, prepared(sentences, reader.bits)
    for r in range(rounds):
        target, weight = np.zeros(n), np.zeros(n)
        for doc, y in docs:
            if not doc:
                continue
            if not y:
                weight[doc] += 1
                continue
            p = label[doc]
            hit = [i for i, x in zip(doc, p) if x > 0.5] or ([doc[int(p.argmax())]] if p.max() > 0.2 and telling[doc[int(p.argmax())]] else [])
            target[hit] += 1
            weight[hit] += 1
            weight[[i for i in doc if i not in set(hit)]] += 0.3
        # a sentence is abusive if more of its documents say so; a clean one that reads abusive for sure may be mislabelled
        y = (target > 0.5 * weight).astype(float)
        w = np.minimum(np.log1p(weight), 3.0)
        if r:
            w[(y == 0) & (label > 0.95)] *= 0.3
        for i, s in seed_of.items():
            y[i], w[i] = s, 2.0
        w[y == 1] *= 2.0
        words = [pointed(s, reader.bits, [odds(g) for g in zip(s[:-1].tolist(), s[1:].tolist())], probs[i]) if y[i] else np.zeros(len(s), dtype=np.int64) for i, s in enumerate(sentences)]
        tagger = Tagger(reader, Chain())
        tagger.chain.fit(batches, words, w, epochs)
        for x, feats, mask, _, _ in batches:
            p, _ = tagger.chain.marginals(feats, mask, moving=False)
            for row, i in zip(p, x):
                probs[i] = row[: len(sentences[i])].astype(np.float32)
        label = np.array([best(p) for p in probs])
    return tagger


def labelled_sample(documents: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """At most MAX_POSITIVE and MAX_NEGATIVE labelled texts, by hash of their id. Raters decide by majority; nulls do not
    count, ties are left out. Ids are chosen first, so no more texts than these go to the driver; repeated ids bring each
    of their texts."""
    votes = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.avg("toxic").alias("share")).where("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("y"))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    known = votes.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = [r for y, n in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE)) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    ids = documents.sparkSession.createDataFrame(chosen, "doc_id long, y int")
    rows = texts.join(F.broadcast(ids), "doc_id").collect()  # MAX_POSITIVE + MAX_NEGATIVE ids at most
    return sorted(((r.text, r.y) for r in rows), key=lambda r: (-r[1], r[0]))


_TAGGERS: dict[str, Tagger] = {}


def _tagger(name: str, held) -> Tagger:
    if name not in _TAGGERS:
        _TAGGERS.clear()
        vocabulary, weights, moves, start = held.value
        chain = Chain()
        chain.weights, chain.moves, chain.start = weights, moves, start
        _TAGGERS[name] = Tagger(Reader(vocabulary), chain)
    return _TAGGERS[name]


def score(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, source, score, starts, ends): every document with its score in [0, 1] and the offsets of its abusive spans
    in characters of ``text``. Null and empty texts score 0; repeated ids keep their rows; whole texts are read."""
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast((list(tagger.reader.ids), tagger.chain.weights, tagger.chain.moves, tagger.chain.start))  # 1 MB of weights

    def run(batches: Iterator[pd.DataFrame], name=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
        own = _tagger(name, held)
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                got = own.documents(["" if t is None else t for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].to_list(), "source": part["source"].to_list(), "score": [g[0] for g in got], "starts": [g[1] for g in got], "ends": [g[2] for g in got]})

    return documents.select("doc_id", "source", "text").where("doc_id is not null").mapInPandas(run, "doc_id long, source string, score double, starts array<int>, ends array<int>")
