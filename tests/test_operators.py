import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import fuzzy, text
from quernstone.operators import annotate, errors, extrinsic, ingest, metrics, predict, sampling, spans
from quernstone.schema import LABELS, coarse_tag, decode_label, encode_label
from quernstone.sources import files
from quernstone.streaming import stateless

SEQ = "query_id long, tokens array<string>, gold_tags array<string>, pred_tags array<string>"


def by_hand(tags, decoder):
    """The three readings, one tag after the other."""
    out, cur, run_b, prev = [], None, False, None
    for i, t in enumerate([*tags, "O"]):
        live = t[:2] in ("B-", "I-")
        kind = t[2:] if live else None
        if live and t[0] == "I" and cur and cur[0] == kind:
            cur[2] = i
        else:
            if cur:
                out.append(cur)
            cur = None
            if live:
                run_b = t[0] == "B" or (prev and run_b)
                cur = [kind, i, i, t[0] == "B", run_b]
        prev = live
        run_b = run_b and live
    keep = {"strict": lambda s: s[3], "lenient": lambda s: True, "attribute": lambda s: s[4]}[decoder]
    return [tuple(s[:3]) for s in out if keep(s)]


def test_decoders_against_a_sequential_reading(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice(["O", "B-X", "I-X", "B-Y", "I-Y"]) for _ in range(rng.randint(0, 9))]) for i in range(300)]
    df = spark.createDataFrame(rows, "query_id long, tags array<string>")
    for decoder in (spans.STRICT, spans.LENIENT, spans.ATTRIBUTE):
        got = {}
        for r in spans.span_rows(df, ["query_id"], "tags", decoder).collect():
            got.setdefault(r.query_id, []).append((r.entity_type, r.start, r.end))
        for i, tags in rows:
            assert sorted(got.get(i, [])) == sorted(by_hand(tags, decoder)), (decoder, tags)


def test_odd_sequences(spark):
    rows = [(1, ["a"], ["O"], ["O"]), (2, [], [], []), (3, ["a", "b"], ["I-X", "O"], ["O", "I-X"]), (4, ["a", "b", "c"], ["B-X", "I-Y", "I-Y"], ["B-X"]), (5, None, None, None), (6, ["a"], [None], ["B-X"])]
    df = spark.createDataFrame(rows, SEQ)
    got = {r.entity_type: r for r in metrics.span_prf(df, [], spans.LENIENT).collect()}
    assert (got["X"].gold_spans, got["X"].pred_spans, got["X"].matched) == (2, 3, 1)
    assert "Y" not in got  # cut to the shorter side
    flags = {r.query_id: r.error_types for r in errors.error_flags(df).collect()}
    assert flags[1] == "" and flags[3] == "FP,FN"


def test_equal_sides_score_one(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["B-X", "I-X"], ["B-X", "I-X"])], SEQ)
    r = metrics.span_prf(df, []).where("entity_type = 'ALL'").first()
    assert (r.precision, r.recall, r.f1) == (1.0, 1.0, 1.0)
    none = metrics.span_prf(df.limit(0), []).collect()
    assert [(r.entity_type, r.gold_spans, r.f1) for r in none] == [("ALL", 0, 0.0)]


def test_schema_ids(spark):
    df = spark.createDataFrame([(t,) for t in (*LABELS, "B-NONE", None)], "t string")
    rows = df.select("t", encode_label(F.col("t")).alias("i")).withColumn("back", decode_label(F.col("i"))).collect()
    assert [r.i for r in rows[:13]] == list(range(13)) and all(r.back == r.t for r in rows[:13])
    assert [r.i for r in rows[13:]] == [0, 0]
    assert spark.range(1).select(coarse_tag(F.lit("I-BRAND"))).first()[0] == "I-PRODUCT"


def test_clean_text(spark):
    cases = {"w/o box": "without box", "W/ charger": "with charger", "usb-c cable": "usb type c cable", "5 in": "5 inch", "Nike® Air™": "nike air", "a b": "a b", " ": "", None: "", "café": "cafe", "naïve": "nai ve", "3.5 x 2": "3.5 x 2"}
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    for r in df.select("q", text.clean_text(F.col("q")).alias("c")).collect():
        assert r.c == cases[r.q], r


def test_preprocess_keeps_the_first_of_equal_texts(spark):
    long = " ".join(["w"] * 21)
    df = spark.createDataFrame([("Red Mug", 1), ("red  mug", 2), ("one", 3), (long, 4), (None, 5)], "query string, x int")
    rows = text.preprocess(df).collect()
    assert [(r.query, r.query_clean, r.num_tokens) for r in rows] == [("Red Mug", "red mug", 2)]


def test_markup(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["B-X", "I-Y", "O", "I-X"])], "w array<string>, t array<string>")
    assert df.select(text.markup_tags(F.col("w"), F.col("t"))).first()[0] == "[a b](X) c"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_ratio_is_indel_similarity(a, b):
    want = 100.0 if a == b else 200 * lcs(a, b) / (len(a) + len(b))
    assert fuzzy.ratio(a, b) == pytest.approx(want) and fuzzy.ratio(a, b) == fuzzy.ratio(b, a)


def test_best_window():
    assert fuzzy.best_window(["red", "mug", "red"], "red") == (0, 0)
    assert fuzzy.best_window(["stanlee", "mug"], "stanley") == (0, 0)
    assert fuzzy.best_window(["mug"], "red mug") is None
    assert fuzzy.best_window(["a"], " ") is None
    assert fuzzy.best_window(["x", "y"], "abcdef") is None


def test_annotate_by_priority():
    tags = annotate.annotate("acme steel travel mug 12 oz".split(), [("BRAND", "acme"), ("PRODUCT_TYPE", "travel mug"), ("PRODUCT_TYPE", "mug"), ("MATERIAL", "steel"), ("SIZE_MEASURE", "12 oz"), ("COLOR", "mug")])
    assert tags == ["B-BRAND", "B-MATERIAL", "B-PRODUCT_TYPE", "I-PRODUCT_TYPE", "B-SIZE_MEASURE", "I-SIZE_MEASURE"]


def test_dominant(spark):
    df = spark.createDataFrame([(["a", "b", "b", "a"],), ([],), (None,), ([None, "z"],)], "v array<string>")
    assert [r[0] for r in df.select(sampling.dominant(F.col("v"))).collect()] == ["a", "unknown", "unknown", "z"]


def test_splits_and_samples(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 5, "rare").when(F.col("id") < 300, "mid").otherwise("big"))
    split = sampling.stratified_split(df, "s", "id")
    assert split.count() == 1000 and split.select("id").distinct().count() == 1000
    assert split.where("split = 'train'").count() in (700, 701, 699)
    sample = sampling.stratified_sample(df, 100, "s", "id")
    assert {r.s: r["count"] for r in sample.groupBy("s").count().collect()} == {"big": 70, "mid": 30}  # the last stratum takes what is left
    small = {r.id for r in sampling.nested_subsets(df, [50, 200], "s", "id").where("subset = '0.05k'").collect()}
    large = {r.id for r in sampling.nested_subsets(df, [50, 200], "s", "id").where("subset = '0.2k'").collect()}
    assert small <= large
    with pytest.raises(ValueError):
        sampling.stratified_split(df, "s", "id", (0.5, 0.2, 0.2))
    assert sampling.stratified_sample(df.limit(0), 10, "s", "id").count() == 0


def test_roll_up(spark):
    ex = spark.createDataFrame([(1, "q", "p1", "us", "E"), (2, "q", "p2", "us", None), (3, "q", "p1", "us", "E"), (4, None, "p1", "us", "S")], "n int, query string, product_id string, product_locale string, esci_label string")
    pr = spark.createDataFrame([("p1", "us", "T1", "x"), ("p2", "us", None, "y")], "product_id string, product_locale string, product_title string, query string")
    joined = ingest.join_products(ex, pr)
    assert "query_product" in joined.columns and ingest.unmatched(joined).first().unmatched == 1
    r = ingest.roll_up(joined, ["product_title", "absent"], [F.col("n")]).collect()
    assert len(r) == 1 and r[0].product_title == ["T1"] and r[0].esci_label == ["E", None, "E"]


def test_kappa_without_variation_is_null(spark):
    df = spark.createDataFrame([("O", "O"), ("O", "O")], "a string, b string")
    r = extrinsic.agreement(df, "a", "b").first()
    assert r.accuracy == 1.0 and r.kappa is None


def test_review_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], ["O", "B-X"]), (2, ["c"], ["O"])], "query_idx long, query_tokens array<string>, ner_tags array<string>")
    files.write_review(df, str(tmp_path / "sheet"), "query_idx")
    sheet = files.read_review(spark, str(tmp_path / "sheet")).withColumn("corrected_tag", F.when(F.col("token") == "a", "B-X").otherwise(F.col("corrected_tag")))
    fixed = {r.query_idx: r for r in extrinsic.merge_corrections(df, extrinsic.corrections(sheet), "ner_tags").collect()}
    assert fixed[1].ner_tags == ["B-X", "B-X"] and fixed[1].was_corrected and not fixed[2].was_corrected


def test_conll_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], ["O", "B-X"]), (2, ["c"], ["O"])], "i long, query_tokens array<string>, ner_tags array<string>")
    files.write_conll(df, str(tmp_path / "c"), "i")
    got = sorted((tuple(r.query_tokens), tuple(r.ner_tags)) for r in files.read_conll(spark, str(tmp_path / "c")).collect())
    assert got == [(("a", "b"), ("O", "B-X")), (("c",), ("O",))]


def test_metric_files_and_logs(spark, tmp_path):
    for m, s, f in (("bert", 1, 0.5), ("bert", 2, 0.7)):
        (tmp_path / f"{m}_seed{s}").mkdir()
        (tmp_path / f"{m}_seed{s}" / "test_metrics.json").write_text('{"test_f1": %s}' % f)
    rows = files.read_seed_metrics(spark, str(tmp_path / "*" / "test_metrics.json"))
    r = metrics.seed_summary(rows, ["model"], "f1", "seed").first()
    assert (r.model, r.n_seeds, r.mean_std, r["values"]) == ("bert", 2, "0.6000 ± 0.1000", "0.5000|0.7000")
    log = spark.createDataFrame([("'train_runtime': 34.5",), ("Total training time: 12 s",), ("Training of x completed in 34 seconds",), ("34 SECONDS total",), ("none",)], "t string")
    assert [x[0] for x in log.select(files.training_time(F.col("t"))).collect()] == [34.5, 12.0, 34.0, 34.0, None]


def test_predictor_may_return_fewer_tags(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "query_id long, tokens array<string>")
    got = predict.apply(df, lambda batch: [["O"] * min(1, len(x)) for x in batch], "tokens", "t").orderBy("query_id").collect()
    assert got[0].t == ["O"] and got[1].t is None
    ids = spark.createDataFrame([([None, 0, 0, 1, None], ["B-X", "O"])], "w array<int>, t array<string>")
    assert ids.select(predict.align_pieces(F.col("w"), F.col("t"))).first()[0] == ["-100", "B-X", "-100", "O", "-100"]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("Red Mug",), ("x",), ("Blue Cup w/o lid",)], "query string")
    df.write.parquet(str(tmp_path / "in"))
    stream = stateless.clean_stream(stateless.read_stream(spark, str(tmp_path / "in"), df.schema))
    stateless.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.query_clean for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["blue cup without lid", "red mug"]


@pytest.mark.parametrize("form", [files.latex, files.markdown])
def test_long_tables_are_not_cut(spark, form):
    assert "9999" in form(spark.range(10_000), ["id"])
    with pytest.raises(ValueError):
        form(spark.range(10_001), ["id"])


def test_annotated_and_flagged_streams_equal_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, ["red", "mug"], ["Acme Mug"], ["Acme"], ["red"], ["B-COLOR", "O"]), (2, ["acme"], [], ["Acme"], None, ["O"]), (3, [], None, None, None, [])], "query_id long, query_tokens array<string>, product_title array<string>, product_brand array<string>, product_color array<string>, gold_tags array<string>")
    df.write.parquet(str(tmp_path / "in"))
    source = stateless.read_stream(spark, str(tmp_path / "in"), df.schema)
    tagged = stateless.annotate_stream(source, out="pred_tags").withColumnRenamed("query_tokens", "tokens")
    stateless.write_stream(stateless.flag_stream(tagged), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = {r.query_id: (r.pred_tags, r.error_types) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (["B-COLOR", "B-PRODUCT_TYPE"], "FP"), 2: (["B-BRAND"], "FP"), 3: ([], "")}
