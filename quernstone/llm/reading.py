"""The common reading of a query text, as Column expressions.

``folded``: characters of category Cf vanish, trademark signs become spaces, the rest is NFKC and lower case.
``words``: runs of letters, marks and digits, joined by one space each; a point or slash directly between two digits
stays. Both are null for null; a text without content reads as the empty string.
Pure ASCII text never leaves the JVM; only the rest goes to Python, in Arrow batches, as NFKC has no builtin.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRADEMARKS = str.maketrans(dict.fromkeys("®™℠", " "))
_CF = regex.compile(r"\p{Cf}+")
SEPARATORS = r"(?:[^\p{L}\p{M}\p{N}./]|(?<!\p{Nd})[./]|[./](?!\p{Nd}))+"
_SEPARATORS = regex.compile(SEPARATORS)


def fold_text(s: str, trademarks: bool = True) -> str:
    if trademarks:
        s = s.translate(TRADEMARKS)
    return _CF.sub("", unicodedata.normalize("NFKC", _CF.sub("", s))).lower()


def words_text(s: str) -> str:
    return _SEPARATORS.sub(" ", fold_text(s)).strip()


@F.pandas_udf(T.StringType())
def _fold_udf(col: pd.Series) -> pd.Series:
    return col.map(lambda s: None if s is None else fold_text(s))


def folded(col: Column) -> Column:
    plain = col.rlike(r"^\p{ASCII}*$")
    return F.coalesce(F.when(plain, F.lower(col)), _fold_udf(F.when(~plain, col)))


def words(fold: Column) -> Column:
    """From folded text."""
    return F.trim(F.regexp_replace(fold, SEPARATORS, " "))


def is_blank(col: Column) -> Column:
    return col.isNull() | ~col.rlike(r"(?U)\S")


def record_key(fold: Column) -> Column:
    """The canonical record of folded text: its content without separators; for two or more ``name:value`` or
    ``name=value`` fields the sorted fields, marked by a leading bar so that they meet no plain record by chance.
    Null where there is no content."""
    parts = F.filter(F.split(fold, r"[;|]"), lambda p: p.rlike(r"[\p{L}\p{M}\p{N}]"))
    field = r"^[^\p{L}\p{N}]*(\p{L}+)(?U:\s*)[:=](.*[\p{L}\p{M}\p{N}].*)$"
    fields = F.transform(
        parts,
        lambda p: F.concat(
            F.regexp_extract(p, "(?s)" + field, 1), F.lit("="), F.replace(words(F.regexp_extract(p, "(?s)" + field, 2)), F.lit(" "), F.lit(""))
        ),
    )
    is_fields = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike("(?s)" + field))
    plain = plain_key(fold)
    return F.when(plain != "", F.when(is_fields, F.concat(F.lit("|"), F.array_join(F.array_sort(fields), "|"))).otherwise(plain))


def plain_key(fold: Column) -> Column:
    return F.replace(words(fold), F.lit(" "), F.lit(""))
