"""The predictor boundary: any function from token lists to tag lists, applied in Arrow batches, and helpers around it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.fuzzy import best_window
from quernstone.operators.metrics import span_prf
from quernstone.operators.spans import STRICT
from quernstone.schema import coarse_tag

Predictor = Callable[[list[list[str]]], list[list[str]]]
REGISTRY: dict[str, Callable[..., Predictor]] = {}
# fixed values: labels of a general recogniser and the entity types they stand for
EXTERNAL = {"ORG": "BRAND", "PRODUCT": "PRODUCT_TYPE", "QUANTITY": "SIZE_MEASURE", "CARDINAL": "SIZE_MEASURE", "MONEY": "ATTRIBUTE_VALUE"}


def register(f: Callable[..., Predictor]) -> Callable[..., Predictor]:
    REGISTRY[f.__name__] = f
    return f


@register
def dictionary(words: dict[str, str]) -> Predictor:
    """Tags every single token found in ``words`` with its type."""
    return lambda batch: [[f"B-{words[w.lower()]}" if w and w.lower() in words else "O" for w in tokens] for tokens in batch]


@register
def external(recognise: Callable[[str], list[tuple[str, str]]]) -> Predictor:
    """Tags from a recogniser of (text, label) entities: each is placed at its first equal window, later ones overwrite."""

    def run(batch: list[list[str]]) -> list[list[str]]:
        out = []
        for tokens in batch:
            tags = ["O"] * len(tokens)
            for text, label in recognise(" ".join(tokens)):
                at = best_window(tokens, text, 100.0) if label in EXTERNAL else None
                for i in range(at[0], at[1] + 1) if at else ():
                    tags[i] = f"{'B' if i == at[0] else 'I'}-{EXTERNAL[label]}"
            out.append(tags)
        return out

    return run


def apply(df: DataFrame, predictor: Predictor, tokens: str, out: str) -> DataFrame:
    """``df`` plus predicted tags; a prediction shorter than its tokens stays short, null tokens give null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(col: pd.Series) -> pd.Series:
        got = predictor([[] if x is None else list(x) for x in col])
        return pd.Series([None if x is None else list(g) for x, g in zip(col, got)])

    return df.withColumn(out, run(tokens))


def evaluate(df: DataFrame, predictor: Predictor, tokens: str = "tokens", gold: str = "gold_tags", decoder: str = STRICT) -> DataFrame:
    """Predict and score in one: span figures per type and in all; predictions are cut to their tokens."""
    return span_prf(apply(df.select(tokens, gold), predictor, tokens, "_pred"), [], decoder, gold=gold, pred="_pred")


def align_pieces(word_ids: Column, tags: Column, all_pieces: bool = False, ignore: str = "-100") -> Column:
    """Word labels on sub-word pieces: ``word_ids`` holds each piece's word or null. The first piece of a word has its label,
    others ``ignore`` or, with ``all_pieces``, the label too."""
    first = lambda w, i: (i == 0) | ~F.coalesce(F.get(word_ids, i - 1) == w, F.lit(False))
    return F.transform(word_ids, lambda w, i: F.when(w.isNull(), ignore).when(first(w, i) | F.lit(all_pieces), F.coalesce(F.get(tags, w), F.lit(ignore))).otherwise(ignore))


def consistency(df: DataFrame, fine: str, coarse_of: str) -> DataFrame:
    """Share of tokens whose fine tag, made coarse, is not the coarse tag of the other column."""
    n = F.least(F.size(fine), F.size(coarse_of))
    zipped = F.zip_with(F.slice(F.col(fine), F.lit(1), n), F.slice(F.col(coarse_of), F.lit(1), n), lambda f, c: (coarse_tag(f) != coarse_tag(c)).cast("int"))
    return df.select(F.explode(zipped).alias("m")).agg(F.avg("m").alias("mismatch"))
