"""The training-data operators against brute force on small fixtures."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import brands, components, leaks, mixture, overlap, reading, runs, splits, terms, toxicity


def closure(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("limit", [4_000_000, 3])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "LOCAL_EDGES", limit)
    rng = random.Random(limit)
    edges = [(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200), (200, 201), (200, 201)]
    df = spark.createDataFrame([*edges, (None, 5)], "a long, b long").repartition(6)
    got = {r.node: r.label for r in components.connected(df).collect()}
    assert got == closure(edges)
    assert components.connected(df.limit(0)).count() == 0


def test_local_labels_of_a_long_path():
    a = np.random.default_rng(1).permutation(5000)
    nodes, label = components.local_labels(a, a + 1)
    assert len(nodes) == 5001 and set(label) == {0}


def test_reading(spark):
    cases = {"Desk  LAMP™": "desk lamp", "a​b": "ab", "ｆｕｌｌ 3.25 oz.": "full 3.25 oz", "1/2 a/b": "1/2 a b", "Crème": "crème", "!!": "", "": "", None: None, "x®y": "x y"}
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    for r in df.select("q", reading.words(reading.folded(F.col("q"))).alias("w")).collect():
        assert r.w == cases[r.q], r


def test_format_copies(spark):
    rows = [
        (5, "Desk-Lamp"), (3, "desk lamp"), (9, "DESKLAMP!"), (4, "type: mug; color: red"), (8, "COLOR=Red | TYPE=Mug"), (7, "type mug color red"), (6, "color red type mug"),
        (1, None), (2, "  "), (10, "1.5 oz"), (11, "15 oz"), (12, "???"), (13, "x" * 100_000), (14, "X" * 100_000), (None, "desk lamp"), (3, "desk lamp"),
    ]
    df = spark.createDataFrame(rows, "query_id long, query string").withColumn("rep", F.lit(1)).withColumn("key", F.lit("clash"))
    got = runs.format_copies(df, "query_id", "query")
    groups = defaultdict(set)
    for r in got.collect():
        groups[r.rep].add(r.id)
    assert dict(groups) == {3: {3, 5, 9}, 4: {4, 8, 7, 6}, 10: {10}, 11: {11}, 13: {13, 14}}
    assert {r.rep: r.copies for r in runs.copy_counts(df, "query_id", "query").collect()} == {3: 4, 4: 4, 10: 1, 11: 1, 13: 2}
    assert runs.format_copies(df.limit(0), "query_id", "query").count() == 0


def test_runs_across_partitions(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 7}", 1000 + i) for i in range(70)]
    df = spark.createDataFrame(rows, "key string, id long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scan = runs.scanned(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    least = {}
    for k, i in rows:
        least[k] = min(i, least.get(k, i))
    assert {r.id: r.rep for r in scan if r.kind == "id"} == {i: least[k] for k, i in rows}
    copies = Counter()
    for r in scan:
        if r.kind == "run":
            copies[r.rep] += r.copies
    assert copies == Counter(least[k] for k, _ in rows)


def test_readings_that_hang_together(spark):
    rows = [(1, "a:bc; d:e"), (2, "abcde"), (3, "ab:c; d:e"), (4, "d:e; a:bc"), (5, "d=e | ab=c"), (6, "abcdef")]
    got = runs.format_copies(spark.createDataFrame(rows, "query_id long, query string"), "query_id", "query").collect()
    assert {r.id: r.rep for r in got} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6}


def test_groups_and_split(spark):
    ex = spark.createDataFrame([(1, "b000000001", "E"), (2, " B000000001 ", "S"), (3, "N/A", "E"), (4, None, "exact"), (2, "B00000000A", None), (6, "B00000000A", "C"), (None, "B000000001", "E"), (1, "b000000001", "E")], "query_id long, product_id string, esci_label string")
    none = spark.createDataFrame([], "query_id long, query string")
    train = spark.createDataFrame([(3, "red mug"), (7, "Red MUG"), (6, "blue"), (8, None)], "query_id long, query string")
    got = sorted(map(tuple, splits.found_groups(splits.stratified_split(splits.query_groups(ex, [train, none]))).collect()))
    assert got == [("B000000001", 1), ("B000000001", 2), ("B000000001", 6)]
    rows = splits.stratified_split(splits.query_groups(ex, [train, none])).collect()
    assert sorted(r.query_id for r in rows) == [1, 2, 3, 4, 6, 7, 8]
    by = defaultdict(set)
    for r in rows:
        by[r.grp].add(r.split)
    assert all(len(x) == 1 for x in by.values())
    assert splits.stratified_split(splits.query_groups(ex.limit(0), [none])).count() == 0


def test_split_reaches_its_shares():
    rng = random.Random(3)
    groups = [{"n": rng.choice((1, 1, 2, 3, 9)), **{x: int(rng.random() < p) for x, p in zip("ESCI", (0.6, 0.5, 0.1, 0.4))}} for _ in range(2000)]
    groups.append({"n": 400, "E": 300, "S": 200, "C": 30, "I": 100})
    totals = {d: sum(u[d] for u in groups) for d in splits.DIMS}
    order = sorted(splits.LABELS, key=lambda x: totals[x]) + ["n"]
    vectors = [dict(zip(splits.DIMS, v)) | {"groups": k, "lead": next(x for x in order if v[splits.DIMS.index(x)])} for v, k in Counter(tuple(u[d] for d in splits.DIMS) for u in groups).items()]
    vectors.sort(key=lambda v: (order.index(v["lead"]), -v[v["lead"]], *[v[x] for x in splits.LABELS], -v["n"]))
    got, dealt = Counter(), Counter()
    for row in splits.place(vectors, totals, splits.RATIOS):
        vector, (split, first, last) = row[:5], row[5:]
        assert first == dealt[vector] + 1
        dealt[vector] = last
        for d, x in zip(splits.DIMS, vector):
            got[split, d] += x * (last - first + 1)
    assert dealt == Counter({tuple(v[d] for d in splits.DIMS): v["groups"] for v in vectors})
    for s, r in splits.RATIOS.items():
        for d in splits.DIMS:
            assert abs(got[s, d] / totals[d] - r) < 0.01, (s, d)


@pytest.mark.parametrize("part", [50_000, 3])
def test_groups_of_one_vector_are_dealt(spark, monkeypatch, part):
    monkeypatch.setattr(splits, "PART", part)
    ex = spark.createDataFrame([(i, f"B{i // 2:09d}", "E") for i in range(200)] + [(900 + i, None, "S") for i in range(100)], "query_id long, product_id string, esci_label string")
    rows = splits.stratified_split(splits.query_groups(ex, [ex.select("query_id", F.lit(None).cast("string").alias("query")).limit(0)])).collect()
    assert Counter(r.split for r in rows if r.E) == {"train": 140, "val": 30, "test": 30}
    assert Counter(r.split for r in rows if r.S) == {"train": 70, "val": 15, "test": 15}


@pytest.mark.parametrize("hot", [256, 0])
def test_overlaps_against_all_pairs(spark, hot):
    rng = random.Random(5)
    vocabulary = ["red", "blue", "mug", "lamp", "desk", "steel", "stel", "lamps", "5", "3.5", "xylofon", "xylophon", "a"]
    make = lambda n: [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    train, ev = [*make(150), "desklamp red", "xylofonbrandname", "!!"], [*make(60), "desk lamp red", "xylophonbrandname", "?"]
    frame = lambda rows, at: spark.createDataFrame([(at + i, t, None) for i, t in enumerate(rows)], "query_id long, query string, query_tokens array<string>")
    got = {(r.eval_id, r.train_id) for r in overlap.overlaps(overlap.texts(frame(train, 0)), overlap.texts(frame(ev, 10_000)), hot).collect()}
    words = lambda t: reading.words_text(t).split()
    want = {(10_000 + i, j) for (i, a), (j, b) in itertools.product(enumerate(ev), enumerate(train)) if words(a) and words(b) and ("".join(words(a)) == "".join(words(b)) or overlap.near(words(a), words(b)))}
    assert got == want
    pairs = {r.eval_id: r.pairs for r in overlap.overlap_counts(overlap.texts(frame(train, 0)), overlap.texts(frame(ev, 10_000))).collect()}
    assert pairs == Counter(i for i, _ in want)


@pytest.mark.parametrize("hot", [1_000, 5])
def test_a_hot_word_pairs_what_is_near(spark, hot):
    """A third of the texts hold one word; the near ones among them are found whether the word is split or not."""
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in ("rn", "st", "lk")]
    train = [(i, f"{w} mug") for i, w in enumerate(words)] + [(500, "mug"), (501, "mug 7"), (502, "mug mug")]
    ev = [(1000 + i, f"mug {w}s") for i, w in enumerate(words)] + [(2000, "mug")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    _, classes = overlap.text_classes(frame(train), frame(ev))
    assert hot == 1_000 or classes.where("side = 'eval'").count() > hot
    got = {(r.eval_id, r.train_id) for r in overlap.overlaps(frame(train), frame(ev), hot).collect()}
    assert got == {(i, j) for (i, a), (j, b) in itertools.product(ev, train) if overlap.near(a.split(), b.split())}


def test_overlap_texts(spark):
    df = spark.createDataFrame([(1, " ", ["a", None, " ", "b"]), (2, None, None), (3, "q", ["x"]), (None, "q", None)], "query_id long, query string, query_tokens array<string>")
    assert sorted(map(tuple, overlap.texts(df).collect())) == [(1, "a b"), (3, "q")]
    empty = overlap.texts(df.limit(0))
    assert overlap.overlaps(empty, empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=7), st.text("ab", max_size=7))
def test_edit_distances_agree(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    assert brands.Pattern(a).distance(b) == row[-1]
    assert overlap.within_edits(a, b, 2) == (row[-1] <= 2)


def test_near_words_share_a_shingle():
    rng = random.Random(7)
    for _ in range(2000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        b = list(a)
        for _ in range(2):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        if b and overlap.within_edits(a, b, 2):
            assert overlap._word_shingles("eval", a) & overlap._word_shingles("train", b), (a, b)


def test_term_deltas_equal_a_recount(spark):
    schema = "query_id long, query_tokens array<string>, ner_tags array<string>"
    old = spark.createDataFrame([(1, ["A", " a ", None, ""], ["O"]), (2, ["b"], None), (3, None, [])], schema)
    new = spark.createDataFrame([(1, ["A", " a ", None, ""], ["O"]), (2, ["c", "a"], ["O", "O"]), (4, ["d"], None)], schema)
    store = terms.TermStore(spark)
    store.merge(terms.term_changes(old, None))
    store.merge(terms.term_changes(*terms.changed_rows(old, new, "query_id")))
    fresh = terms.TermStore(spark)
    fresh.merge(terms.term_changes(new, None))
    rows = lambda s: sorted(map(str, s.counts().collect()))
    assert rows(store) == rows(fresh)
    got = {(r.field_name, r.term): (r.occurrences, r.records, r.mark) for r in terms.marked(fresh.counts()).collect()}
    assert got[("query_tokens", "a")] == (3, 2, "rare") and ("query_tokens", "b") not in got
    assert terms.table_terms(old.limit(0)).count() == 0


def test_term_store_outlives_its_session_object(spark, tmp_path):
    changes = lambda *rows: spark.createDataFrame(rows, terms.COUNTS)
    path = f"file://{tmp_path}/terms"
    first = terms.TermStore(spark, path, bucket_terms=4)
    assert first.counts().count() == 0
    first.merge(changes(*[("query_tokens", f"t{i}", 2, 1) for i in range(20)]))
    again = terms.TermStore(spark, path, bucket_terms=4)
    old = again.manifest()
    assert old["version"] == 1 and old["buckets"] == 5 and old["terms"] == 20
    again.merge(changes(("query_tokens", "t3", -2, -1), ("query_tokens", "t4", 1, 0)))
    new = terms.TermStore(spark, path, bucket_terms=4).manifest()
    assert new["version"] == 2 and new["terms"] == 19
    assert 1 <= sum(v == 2 for v in new["at"].values()) <= 2 < sum(v == 1 for v in new["at"].values())  # only what changed is written
    got = {r.term: (r.occurrences, r.records) for r in first.counts().collect()}
    assert got == {f"t{i}": (3, 1) if i == 4 else (2, 1) for i in range(20) if i != 3}
    assert {r.term for r in first.counts(1).collect()} == {f"t{i}" for i in range(20)}
    first.merge(changes(*[("ner_tags", f"u{i}", 1, 1) for i in range(40)]))  # laid out anew
    grown = again.manifest()
    assert grown["buckets"] > 5 and grown["terms"] == 59 and set(grown["at"].values()) == {3}
    again.merge(changes())
    assert again.manifest()["version"] == 3


def test_brand_keys():
    same = [("Nara Skoldgralton", "nara-sk​oldgralton™"), ("Cov & Grass", "cov and grass"), ("Fluxmumora", "FLUXMUMORA's"), ("Fluxmumora", "fluxmumora co. ltd"), ("Bröntova", "brontova official store")]
    for a, b in same:
        assert brands.brand_key(a) == brands.brand_key(b), (a, b)
    assert brands.brand_key("Store") == "store" and brands.brand_key("") == ""


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(2)
    keys = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 7))) for _ in range(300)]
    tree = brands.BKTree([(k, i) for i, k in enumerate(keys)])
    first = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
    for q in keys[:60] + ["", "zzzzzz", "abcd"]:
        want = sorted((brands.Pattern(q).distance(k), i) for k, i in first.items() if brands.Pattern(q).distance(k) <= 2)
        assert sorted(tree.within(q, 2)) == want
        assert tree.closest(q, 2) == (want[0] if want else None)


def test_spans_to_entries(spark):
    ref = spark.createDataFrame([(1, "Acme & Sons"), (2, "Acme"), (3, "Zenith"), (4, None)], "brand_id long, brand_name string")
    rows = [(1, ["acme", "mug"], ["b-brand ", "O"]), (2, ["acme", "and", "sons", "x"], ["B-BRAND", "I-BRAND", "I-BRAND", "O"]), (3, ["zenit"], ["B-BRAND", "O"]), (4, ["foo", None], ["B-BRAND", "I-BRAND"]), (5, None, ["B-BRAND"]), (6, ["acme"], ["B_BRAND"]), (7, ["ACME"], ["B-BRAND"]), (8, [None], ["B-BRAND"])]
    df = spark.createDataFrame(rows, "query_id long, query_tokens array<string>, ner_tags array<string>")
    found = brands.spans(df, "query_id", "query_tokens", "ner_tags", "BRAND")
    for shard, block in ((20_000, 1_000), (1, 1), (2, 2)):
        entries = brands.closest_entries(found, ref, shard=shard, block=block)
        got = {r.text: r.entry for r in entries.collect()}
        assert got == {"acme": 2, "acme and sons": 1, "zenit": 3, "foo": -1, "ACME": 2, "": -1}
    mapped = brands.map_spans(brands.spelled_otherwise(found, ref), ref).collect()
    assert sorted((r.id, r.span_start, r.entry) for r in mapped) == [(2, 0, 1), (3, 0, 3), (4, 0, -1), (8, 0, -1)]
    assert brands.map_spans(found.limit(0), ref).count() == 0


def test_leaks_against_all_windows(spark):
    rng = random.Random(4)
    item = [[f"w{rng.randint(0, 400)}" for _ in range(30)] for _ in range(6)]
    docs = []
    for i in range(60):
        text = [f"w{rng.randint(0, 400)}" for _ in range(40)]
        src, a, n = rng.choice(item), rng.randint(0, 15), rng.randint(5, 15)
        piece = src[a : a + n]
        for _ in range(rng.randint(0, 2)):
            piece[rng.randrange(len(piece))] = "zz"
        text[10:10] = piece
        docs.append((i, "<b>" + " ".join(text[:20]).upper() + "</b>\n" + ", ".join(text[20:])))
    d = spark.createDataFrame([*docs, (100, None), (101, ""), (None, "x"), (102, "<p></p>" * 20_000)], "doc_id long, text string")
    it = spark.createDataFrame([*[(i, " ".join(x)) for i, x in enumerate(item)], (50, "too short"), (51, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in leaks.leaks(d, it).collect()}
    exact, near = set(), set()
    for (i, t), (j, x) in itertools.product(docs, enumerate(item)):
        w = leaks.passage_words(t)
        windows = {tuple(w[p : p + 12]) for p in range(len(w) - 11)}
        for p in range(len(x) - 11):
            if tuple(x[p : p + 12]) in windows:
                exact.add((i, j))
            if min(brands.Pattern(x[p : p + 12]).distances(w, inside=True)) <= 2:
                near.add((i, j))
    assert {k for k, r in found.items() if r.edits == 0} == exact
    assert set(found) == near
    assert leaks.leaks(d.limit(0), it).count() == 0 and leaks.leaks(d, it.limit(0)).count() == 0


def test_short_items_leak_too(spark):
    items = [(1, "alpha"), (2, "beta gamma"), (3, "one two three four five six seven"), (4, "one two three four five six seven eight nine ten eleven"), (5, "!!"), (6, "käse über alles")]
    docs = [
        (1, "an ALPHA here"), (2, "beta, gamma"), (3, "gamma beta"), (4, "one two three four five SIX seven"), (5, "one two three x five six seven"),
        (6, "one two x four five y seven"), (7, "one two three four five six seven eight nine ten"), (8, "Käse <b>über</b> alles"), (9, "x"),
    ]
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.edits for r in found.collect()}
    assert got == {(1, 1): 0, (2, 2): 0, (4, 3): 0, (5, 3): 1, (7, 3): 0, (7, 4): 1, (8, 6): 0}


def test_vector_distances_equal_the_plain_ones():
    rng = np.random.default_rng(9)
    pattern, text = rng.integers(2, 6, (400, 12)), rng.integers(2, 6, (400, 16))
    sizes, lengths = rng.integers(1, 13, 400), rng.integers(0, 17, 400)
    got = leaks.distances(pattern, sizes, text, lengths)
    for p, n, t, m, d in zip(pattern, sizes, text, lengths, got):
        assert d == min([n, *brands.Pattern(p[:n].tolist()).distances(t[:m].tolist(), inside=True)])


def test_word_hashes():
    h = leaks.hasher()
    starts, ends, hashes = h.words("straße 12 x straße")
    assert starts.tolist() == [0, 7, 10, 12] and ends.tolist() == [6, 9, 11, 18]
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 3
    long = "ab " * 200_000
    assert set(h.words(long)[2].tolist()) == {int(h.words("ab")[2][0])} and h.words("")[2].size == 0


def test_pivot_keeps_its_sum():
    rng = random.Random(6)
    hits = Counter()
    for seed in range(400):
        probs = [0.3, 0.9, 0.25, 0.55, 0.5, 0.5]
        pivot, taken = mixture.Pivot(seed, 0), []
        for i, p in enumerate(probs):
            taken += [row[0] for row in pivot.add(i, p, (i,))]
        assert len(taken) + (pivot.open[1] if pivot.open else 0) == pytest.approx(3.0)
        hits.update(taken)
        if pivot.open and rng.random() < pivot.open[1]:
            hits[pivot.open[0]] += 1
    for i, p in enumerate(probs):
        assert abs(hits[i] / 400 - p) < 0.1


@pytest.mark.parametrize("task_rows", [100_000, 2])
def test_rounding_over_many_tasks(spark, task_rows):
    rows = spark.createDataFrame([(i, "ab"[i % 2], 10 + i % 7, 0.25 + 0.5 * (i % 2)) for i in range(400)], "doc_id long, source string, tokens long, prob double").repartition(5)
    got = mixture.dependent_rounding(rows, task_rows=task_rows).collect()
    assert len({r.doc_id for r in got}) == len(got)
    assert Counter(r.source for r in got) == {"a": 50, "b": 150}


def test_mixture(spark):
    rows = [(i, f"word {'x ' * (i % 5)}", "Big" if i % 10 else " small-one ") for i in range(400)] + [(900, None, "big"), (901, "a b", None), (None, "q", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small_one", 0.4, 3), ("gone", 0.1, 4)], "source string, target_share double, max_repeats int")
    selection, report = mixture.mix(docs, targets)
    most = {r.source: r.m for r in selection.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert most["small_one"] == 3 and most["big"] <= 2
    got = {r.source: r for r in report.collect()}
    assert got["gone"].tokens == 0 and got["gone"].short_by > 0
    assert abs(got["big"].tokens - got["big"].wanted_tokens) <= 8
    assert got["big"].asked_tokens == got["big"].wanted_tokens * 2 and abs(got["big"].share - 0.5) < 0.02
    assert sum(r.share_of_reached for r in got.values()) == pytest.approx(1.0)
    assert got["small_one"].short_by > 0
    again, _ = mixture.mix(docs, targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, selection.collect()))
    none, rep = mixture.mix(docs.limit(0), targets)
    assert none.count() == 0 and rep.count() == 3


def test_chain_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    chain = toxicity.Chain()
    chain.weights[:50] = rng.normal(size=50)
    feats = rng.integers(0, 50, size=(2, 4, 3))
    mask = np.array([[True] * 4, [True] * 2 + [False] * 2])
    p, _ = chain.marginals(feats, mask)
    for row, n in ((0, 4), (1, 2)):
        e = chain.weights[feats[row]].sum(axis=1)
        total, each = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            s = chain.start[y[0]] + sum(e[t] for t in range(n) if y[t]) + sum(chain.moves[y[t - 1], y[t]] for t in range(1, n))
            total += np.exp(s)
            each += np.exp(s) * np.array(y)
        assert np.allclose(p[row, :n], each / total, atol=1e-5)


def test_disguises():
    r = toxicity.Reader(["idiot", "stupid", "naked", "filthy", "the", "wine"])
    for w in ("idi​ot", "ідіоt", "1d1ot", "idiooooot", "id*ot", "n4k3d", "filhty", "$tupid"):
        assert r.id(w) > 3, w
    assert r.id("2024") == 2 and r.id("krolvian") == 1 and r.id("wine") > 3
    words = [w for s in toxicity.tokens("you i d i o t, s.t.u.p.i.d <b>one</b>\nnext") for _, _, w in s]
    assert words == ["you", "idiot", "stupid", "one", "next"]


def test_tagger_on_held_out_documents(spark):
    bad, good = ["you are a total {}", "only a {} would sell this", "shut up you {}"], ["the lid is {}", "i bought the {} mug", "it came in a {} box"]
    insults, words = ["moron", "idiot", "loser", "clown"], ["red", "blue", "small", "large"]
    rng = random.Random(8)
    fill = lambda t, w: rng.choice(t).format(rng.choice(w))
    make = lambda y: ". ".join([fill(good, words) for _ in range(4)] + ([fill(bad, insults)] if y else []))
    train = [(make(y), y) for y in [0, 1] * 60] + [(make(1), 0), (make(0), 1)]
    tagger = toxicity.train(train)
    test = [(make(y), y) for y in [0, 1] * 30]
    right = sum((s > 0.5) == bool(y) for (s, _, _), (_, y) in zip(tagger.documents([t for t, _ in test]), test))
    assert right >= 57
    text = "The lid is red. You are a total moron."
    score, starts, ends = tagger.documents([text])[0]
    assert score > 0.5 and "moron" in text[starts[0] : ends[-1]]
    docs = spark.createDataFrame([(1, text, "a", "x"), (2, None, None, "y"), (3, "", "a", "z"), (4, "the lid " * 30_000, "b", "w")], "doc_id long, text string, source string, score string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, tagger).collect()}
    assert got[1] > 0.5 and got[2] == 0 and got[3] == 0 and got[4] < 0.5
    assert toxicity.train([]).documents(["you are an idiot"])[0][0] > 0.5


def test_a_short_span_in_a_long_sentence_is_found(monkeypatch):
    tagger = toxicity.Tagger(toxicity.Reader(["idiot", "word"]), toxicity.Chain())
    bad = tagger.reader.id("idiot")
    monkeypatch.setattr(tagger, "words", lambda sentences: [np.where(s == bad, 0.9, 0.01).astype(np.float32) for s in sentences])
    for n, at in ((20, 3), (200, 59), (200, 60), (75, 74)):
        text = " ".join("idiot" if i in (at, at + 1) else "word" for i in range(n))
        score, starts, ends = tagger.documents([text])[0]
        assert score > toxicity.THRESHOLD and len(starts) == 1, (n, at)
        assert set(text[starts[0] : ends[0]].split()) == {"idiot"}
    assert tagger.documents(["word " * 100, ""])[0][0] < toxicity.THRESHOLD


def test_chains_show_every_phrase_whole():
    for n in (1, 60, 61, 90, 91, 500):
        cuts = toxicity.chains(n)
        assert all(b - a <= toxicity.CHAIN for a, b in cuts)
        assert all(any(a <= i and min(i + toxicity.OVERLAP, n) <= b for a, b in cuts) for i in range(n))
        assert toxicity.joined([np.arange(a, b) for a, b in cuts], n).tolist() == list(range(n))


def test_chain_fits_moves_and_start_to_spans_inside_sentences():
    rng = np.random.default_rng(3)
    sentences, labels = [], []
    for _ in range(300):
        s, n = rng.integers(10, 20, 12), int(rng.integers(2, 4))
        a = int(rng.integers(1, 12 - n))
        s[a : a + n] = rng.integers(20, 24, n)
        sentences.append(s)
        labels.append((s >= 20).astype(np.int64))
    bits, chain, first = np.zeros(30, dtype=np.int64), toxicity.Chain(), toxicity.Chain()
    chain.fit(toxicity.prepared(sentences, bits), labels, np.ones(300), 6)
    assert abs(chain.moves - first.moves).min() > 0.01 and abs(chain.start - first.start).min() > 0.01
    assert chain.start[1] < chain.start[0]
    mask = np.ones((300, 12), dtype=bool)
    p, expected = chain.marginals(toxicity.features(np.stack(sentences), bits), mask, np.full(300, 2.0))
    assert ((p > 0.5) == np.stack(labels)).mean() > 0.99
    assert np.isclose(expected.sum(), 2 * 300 * 11)
    counted = toxicity.transitions(np.array([[0, 1, 1, 0]]), np.array([[True, True, True, False]]), np.array([3.0]))
    assert counted.tolist() == [[0, 3], [0, 3]]


def test_spans_leave_the_rest_of_the_sentence():
    clean = ["the lid fits and the shop sent a new one after two weeks", "we use it in the garage almost every day", "it holds water and is easy to clean"]
    abuse = [f"the shop sent a {x} one after two weeks and told me that you are {y} so i left" for x in ("new", "red", "big", "small") for y in ("an idiot", "a moron", "a bastard", "a stupid loser")]
    tagger = toxicity.train([(t, 0) for t in clean * 6] + [(t, 1) for t in abuse])
    for text in abuse:
        score, starts, ends = tagger.documents([text])[0]
        got = " ".join(text[a:b] for a, b in zip(starts, ends))
        assert score > toxicity.THRESHOLD and text.split()[-4] in got and len(got) < len(text) / 2, (text, got)


def test_rows_with_nulls_repeats_and_extra_columns(spark):
    """Clashing names and nulls in any column change nothing; repeated rows and ties have one defined result."""
    long = "word " * 20_000
    rows = [(1, "red mug"), (1, "red mug"), (2, None), (None, "red mug"), (3, long), (4, "")]
    clash = lambda df: df.withColumns({c: F.lit(None).cast("string") for c in ("key", "bag", "text_id", "side", "rep", "n", "grp", "split", "tokens", "copies", "hash", "entry", "score")})
    queries = clash(spark.createDataFrame([(i, t, None) for i, t in rows], "query_id long, query string, query_tokens array<string>"))
    other = queries.withColumn("query_id", F.col("query_id") + 100)
    pairs = sorted(map(tuple, overlap.overlaps(overlap.texts(queries), overlap.texts(other)).collect()))
    assert pairs == [(101, 1), (103, 3)]
    assert sorted((r.id, r.rep) for r in runs.format_copies(queries, "query_id", "query").collect()) == [(1, 1), (1, 1), (3, 3)]
    documents = clash(spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, source string"))
    items = clash(spark.createDataFrame([(7, "word " * 12), (7, None), (None, "word")], "item_id long, text string"))
    found = leaks.leaks(documents.select("doc_id", "text"), items.select("item_id", "text")).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in found] == [(3, 7, 0)]
    selection, report = mixture.mix(documents, spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int"))
    assert {r.doc_id for r in selection.collect()} == {1, 3} and report.count() == 1
    scored = toxicity.score(documents, toxicity.Tagger(toxicity.Reader(["mug"]), toxicity.Chain())).collect()
    assert Counter(r.doc_id for r in scored) == {1: 2, 2: 1, 3: 1, 4: 1} and all(r.score == 0 for r in scored if r.doc_id in (2, 4))
    assert terms.table_terms(clash(spark.createDataFrame([(None, ["a", "a"]), (["b", None], None), (["b", None], None)], "query_tokens array<string>, ner_tags array<string>"))).where("term = 'b'").first().records == 2


def test_labelled_sample_takes_ids_first(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 2)
    documents = spark.createDataFrame([(i, f"text {i}") for i in range(8)] + [(9, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, "a"), (1, 1, "a"), (2, 1, "a"), (3, 1, "a"), (3, 0, "b"), (4, 0, "a"), (5, 0, None), (6, 7, "a"), (9, 1, "a"), (50, 1, "a"), (None, 1, "a")], "doc_id long, toxic int, rater string")
    got = toxicity.labelled_sample(documents, labels)
    assert sum(y for _, y in got) == 2 and {t for t, y in got if not y} == {"text 4", "text 5"}
    assert {t for t, y in got if y} < {"text 0", "text 1", "text 2"}
