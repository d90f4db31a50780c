"""Result tables against recorded figures, files in their formats, and summaries on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import annotate as A
from quernstone.operators import errors as E
from quernstone.operators import extrinsic as X
from quernstone.operators import ingest, predict, sampling
from quernstone.operators import metrics as M
from quernstone.operators import retrieval as R
from quernstone.sources import files

OVERALL = [("bert_ner", 0.5544, 0.4718, 0.5098), ("bilstm_crf", 0.6091, 0.3530, 0.4469), ("cnn_bilstm", 0.6630, 0.2922, 0.4056), ("roberta_ner", 0.5080, 0.4749, 0.4909)]
RETRIEVAL = [("bert_ner_rerank", 0.4795, 0.4404), ("bilstm_crf_rerank", 0.4822, 0.4435), ("cnn_bilstm_rerank", 0.4818, 0.4408), ("roberta_ner_rerank", 0.4851, 0.4459)]
EFFICIENCY = [("bert_ner", 108.90, 32.80), ("bilstm_crf", 5.06, 4.21), ("cnn_bilstm", 4.98, 3.91), ("roberta_ner", 124.07, 33.67)]


@pytest.fixture
def overall(spark):
    return spark.createDataFrame(OVERALL, "model string, precision double, recall double, f1 double")


def test_final_table_as_recorded(spark, overall):
    got = M.final_table(overall, spark.createDataFrame(RETRIEVAL, "model string, ndcg double, mrr double"), spark.createDataFrame(EFFICIENCY, "model string, params_m double, latency_ms double"))
    assert [",".join(map(str, r)) for r in got.orderBy("rank").collect()] == [
        "1,bert_ner,0.5544,0.4718,0.5098,0.4795,0.4404,108.90,32.80", "2,roberta_ner,0.5080,0.4749,0.4909,0.4851,0.4459,124.07,33.67",
        "3,bilstm_crf,0.6091,0.3530,0.4469,0.4822,0.4435,5.06,4.21", "4,cnn_bilstm,0.6630,0.2922,0.4056,0.4818,0.4408,4.98,3.91",
    ]


def test_lookup_defaults_and_repeated_keys(spark, overall):
    others = spark.createDataFrame([("bert_ner", 1.0), ("bert_ner_rerank", 2.0), ("x", 3.0), ("cnn_bilstm", None)], "model string, v double")
    got = {r.model: r.v for r in M.lookup(overall.select("model"), others, "model", {"v": "%.1f"}, "_rerank").collect()}
    assert got == {"bert_ner": "2.0", "bilstm_crf": "-", "cnn_bilstm": "-", "roberta_ner": "-"}


def test_fixed_width_as_recorded(spark, overall, tmp_path):
    lines = [r.value for r in files.fixed_width(overall, "model", {"precision": "Precision", "recall": "Recall", "f1": "F1"}).orderBy("line").collect()]
    assert lines[0] == "Model                           Precision     Recall         F1" and lines[1] == "-" * 63
    assert lines[2] == "bert_ner                           0.5544     0.4718     0.5098"
    path = str(tmp_path / "t")
    files.write_fixed_width(overall, path, "model", {"precision": "Precision", "recall": "Recall", "f1": "F1"})
    assert sorted(map(tuple, files.read_fixed_width(spark, path, ["precision", "recall", "f1"]).collect())) == OVERALL


def test_averages_as_recorded(spark):
    rows = [
        ("ATTRIBUTE_VALUE", 0.8819561551433389, 0.9849340866290018, 0.9306049822064056, 531), ("BRAND", 0.6926048565121413, 0.572536496350365, 0.626873126873127, 2192),
        ("COLOR", 0.29259259259259257, 0.14821763602251406, 0.1967621419676214, 533), ("MATERIAL", 0.7814207650273224, 0.9407894736842105, 0.8537313432835821, 456),
        ("PRODUCT_TYPE", 0.5251562965168205, 0.2200873362445415, 0.3101811148232812, 8015), ("SIZE_MEASURE", 0.5063291139240507, 0.6369426751592356, 0.5641748942172075, 314),
    ]
    got = M.averages(spark.createDataFrame(rows, "entity_type string, precision double, recall double, f1 double, support long"), []).first()
    assert got.macro_f1 == pytest.approx(0.5803879338952042, abs=1e-12) and got.weighted_f1 == pytest.approx(0.417381065190296, abs=1e-12)
    assert got.macro_precision == pytest.approx(0.6133432966193777, abs=1e-12) and got.weighted_recall == pytest.approx(0.3529607175483764, abs=1e-12)


def test_seeds_as_recorded(spark):
    runs = spark.createDataFrame([("bert_ner", s, v) for s, v in ((42, 0.5000848176420696), (43, 0.500043863496798), (44, 0.5100335195530725))], "model string, seed int, f1 double")
    got = M.seed_summary(runs, ["model"], "f1", "seed").first()
    assert got.mean_std == "0.5034 ± 0.0047" and got.std == pytest.approx(0.0046995457827642044, abs=1e-12) and got["values"] == "0.5001|0.5000|0.5100"


def test_report_and_printed_tables(spark, overall):
    per_type = spark.createDataFrame([("bert_ner", "BRAND", 0.5), ("bert_ner", "ALL", 0.6), ("cnn_bilstm", "COLOR", 0.25)], "model string, entity_type string, f1 double")
    report = M.summary_report(overall, per_type, ["bert_ner", "cnn_bilstm"])
    assert "**bert_ner** with **0.5098**" in report and "| bert_ner | 0.5544 | 0.4718 | 0.5098 | 🥇 |" in report and "| COLOR | 0.00 | 0.25 |" in report
    assert r"bert\_ner & 51.0\%" in files.latex(overall.orderBy("model").withColumn("f1", F.format_string("%.1f%%", F.col("f1") * 100)), ["model", "f1"])
    assert "0.51" in files.markdown(overall.where("model = 'bert_ner'"), ["f1"], {"f1": "%.2f"})
    assert M.best_model(overall.limit(0)).count() == 0
    tied = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None)], "model string, f1 double")
    assert tuple(M.best_model(tied).first()) == ("a", 0.5)


def test_files(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([("m", 1, ["O"]), ("m", 0, []), ("n", 0, ["B-X", "O"])], "model string, query_index long, tags array<string>")
    files.write_predictions(rows, path)
    assert sorted((r.model, r.query_index, tuple(r.tags)) for r in files.read_predictions(spark, path).collect()) == [("m", 0, ()), ("m", 1, ("O",)), ("n", 0, ("B-X", "O"))]
    path = str(tmp_path / "c")
    files.write_corpus(spark.createDataFrame([(2, "b\nb"), (1, "a"), (3, None), (4, "d")], "id int, t string"), path, "t", ["id"], 2)
    assert sorted(r.text for r in files.read_corpus(spark, path).collect()) == ["a", "b b"]
    path = str(tmp_path / "csv")
    files.write_csv(spark.createDataFrame([("b", None), ("a", 1.5)], "model string, f1 double"), path, "model", 0.0)
    assert list(map(tuple, files.read_sources(spark, path).collect())) == [("a", 1.5), ("b", 0.0)]
    path = str(tmp_path / "x.yaml")
    files.save_config({"lr": "3e-5", "b": {"c": [1, "x"]}}, path)
    assert files.load_config(path) == {"lr": 3e-5, "b": {"c": [1, "x"]}}
    wide = spark.range(files.MAX_ROWS + 1).select(F.col("id"))
    with pytest.raises(ValueError):
        files.markdown(wide, ["id"])


def test_missing_path_names_both(tmp_path):
    with pytest.raises(FileNotFoundError, match="shopping_queries_dataset"):
        ingest.resolve(str(tmp_path), "absent.parquet")


def test_kappa_names(spark):
    ks = [0.95, 0.8, 0.6, 0.41, 0.1, None]
    got = [r.b for r in spark.createDataFrame([(k,) for k in ks], "k double").select(X.kappa_bucket(F.col("k")).alias("b")).collect()]
    assert got == ["Almost perfect agreement", "Almost perfect agreement", "Substantial agreement", "Moderate agreement", "Fair/Slight agreement", "Fair/Slight agreement"]


def test_markup(spark):
    cases = [(["a", "b", "c"], ["B-X", "I-Y", "O"], "[a b](X) c"), (["a", "b"], ["I-X", "O"], "b"), ([], [], ""), (["a", "b"], ["B-X", "B-X"], "[a](X) [b](X)"), (["a", "b"], ["O"], "a")]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "id int, w array<string>, t array<string>")
    got = {r.id: r.m for r in df.select("id", text.markup_tags(F.col("w"), F.col("t")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_color_lists_and_buckets(spark):
    df = spark.createDataFrame([(1, ["Red", "mug", "blue"], ["B-COLOR", "O", "B-COLOR"], ["O", "B-COLOR", "B-BRAND"]), (2, ["x"], ["O"], ["O"])], "query_id long, tokens array<string>, gold_tags array<string>, pred_tags array<string>")
    rows = E.token_rows(df)
    assert sorted((r.list, r.token, r.tag, r.n) for r in E.one_type_lists(rows).collect()) == [("confusion", "blue", "B-BRAND", 1), ("hallucinated", "mug", "O", 1), ("missed", "red", "", 1)]
    assert {r.error_type: (r.n, r.rate) for r in E.error_buckets(rows).collect()} == {"false_positive": (1, 25.0), "false_negative": (1, 25.0), "wrong_type": (1, 25.0), "total": (3, 75.0)}
    assert {r.rate for r in E.error_buckets(rows.limit(0)).collect()} == {0.0}
    summary = E.sparsity_summary(E.sparsity(rows)).first()
    assert summary.rare_types == ["COLOR"] and summary.common_types == [] and summary.coarse_f1 == pytest.approx(0.5)
    assert E.first_mismatches(df).count() == 1
    assert set(E.error_report(df)) >= {"confusion_matrix", "common_errors", "by_query_length", "color_ambiguity"}


def test_predict_and_score(spark):
    df = spark.createDataFrame([(["red", "mug"], ["B-COLOR", "O"]), (["mug"], ["O"]), ([], [])], "tokens array<string>, gold_tags array<string>")
    got = {r.entity_type: (r.gold_spans, r.pred_spans, r.matched) for r in predict.evaluate(df, predict.dictionary({"red": "COLOR", "mug": "BRAND"})).collect()}
    assert got == {"ALL": (1, 3, 1), "COLOR": (1, 1, 1), "BRAND": (0, 2, 0)}


def test_attribute_index(spark):
    docs = spark.createDataFrame([("p", " Acme ", ["Red", None, "red", ""], 5), ("q", None, None, None)], "doc_id string, brand string, Color array<string>, pack long")
    got = sorted(tuple(r) for r in R.attribute_index(docs, ["brand", "Color", "pack"]).collect())
    assert got == [("p", "BRAND", "acme"), ("p", "COLOR", "red"), ("p", "PACK", "5")]


@pytest.mark.parametrize("block", [4_096, 1])
def test_bm25_by_blocks_and_tasks(spark, block):
    docs = spark.createDataFrame([(f"d{i:02d}", "mug " * (i % 3) + ("red " if i % 2 else "blue ")) for i in range(40)], "doc_id string, text string").repartition(4)
    queries = spark.createDataFrame([(1, "red mug"), (2, "blue blue"), (3, "absent"), (4, None)], "query_id long, query string")
    idx = R.index(docs)
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in R.bm25(queries, idx, 5, block=block).collect())
    rows = [(f"d{i:02d}", ["mug"] * (i % 3) + ["red" if i % 2 else "blue"]) for i in range(40)]
    n, avg = 40, sum(len(w) for _, w in rows) / 40
    import math

    def score(words, q):
        out = 0.0
        for t in q:
            df, tf = sum(t in w for _, w in rows), words.count(t)
            out += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg)) if tf else 0
        return round(out, 9)

    want = []
    for q, words in ((1, ["red", "mug"]), (2, ["blue", "blue"])):
        best = sorted((-score(w, words), d) for d, w in rows if score(w, words) > 0)[:5]
        want += [(q, i + 1, d, pytest.approx(-s)) for i, (s, d) in enumerate(best)]
    assert got == want
    assert R.bm25(queries.limit(0), idx, 5).count() == 0


def test_roll_up_of_one_query(spark):
    rows = [("q", 2, "T2", "E"), ("q", 1, "T1", None), ("q", 3, "T2", "E"), ("q", 3, "T2", "E"), (None, 4, "T", "S"), ("r", 5, None, "S")]
    df = spark.createDataFrame(rows, "query string, id int, product_title string, esci_label string")
    got = {r["query"]: (r.product_title, r.esci_label) for r in ingest.roll_up(df, ["product_title", "absent"], [F.col("id")]).collect()}
    assert got == {"q": (["T1", "T2"], [None, "E", "E", "E"]), "r": ([], ["S"])}
    assert sorted(r[0] for r in ingest.roll_up(df, ["absent"], [F.col("id")]).collect()) == ["q", "r"]


@pytest.mark.parametrize("rows", [50_000, 7])
def test_ranks_over_buckets(spark, rows):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(60)], "id long, s string")
    got = sampling.hash_rank(df, "s", "id", 42, rows).collect()
    for s, n in (("a", 40), (None, 20)):
        own = sorted((r for r in got if r.s == s), key=lambda r: r.rn)
        assert [r.rn for r in own] == list(range(1, n + 1)) and {r.cnt for r in own} == {n}
        import hashlib

        assert [r.id for r in own] == sorted((r.id for r in own), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())


def test_tiny_strata_fall_back_to_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, s string")
    assert {r.s for r in sampling.fold_tiny(df, "s", 2).collect()} == {"a", "_other"}
    assert {r.s for r in sampling.fold_tiny(df, "s", 5).collect()} == {"_other"}


def test_only_possible_candidates_leave(spark):
    df = spark.createDataFrame([(["red", "mug"], [("BRAND", "mugg"), ("BRAND", "zzz"), ("COLOR", "red mug set"), ("COLOR", "red")])], "t array<string>, c array<struct<entity_type:string,phrase:string>>")
    assert df.select(A.possible(F.col("c"), F.col("t")).alias("x")).first().x == ["2mugg", "4red"]


def test_summaries_of_data(spark):
    df = spark.createDataFrame([("a", ["x", "y"], ["B-X", "O"]), ("a", ["x"], None), ("b", None, []), (None, ["x", "y"], ["B-X", "B-Y"])], "query string, w array<string>, t array<string>")
    assert tuple(X.data_quality(df, "query", "w", "t").first()) == (4, 1, 1)
    e = X.entities_per_query(df, "t").first()
    assert (e.mean, e.max, e.without, e.most_types) == (0.75, 2, 2, 2)
    s = X.dataset_summary({"train": df, "val": df.limit(0)}, "w", "t").first()
    assert (s.total_samples, s.train_samples, s.val_samples, s.entity_span_counts) == (4, 4, 0, {"X": 2, "Y": 1})
    assert A.annotation_summary(df, "t").first().percent == 50.0
