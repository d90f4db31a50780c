"""Every training-data query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quernstone.llm import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - {"p1_invariants", "p7_invariants"}))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    r = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=str)


def test_near_pairs_come_from_the_prefix_filter(spark):
    """All overlapping pairs that are not one record are met by the filter at the smallest scale too, hot or not."""
    from pyspark.sql import functions as F

    from quernstone.llm import overlap
    from quernstone.session import table

    train = overlap.texts(table(spark, str(DATA), "train"))
    ev = overlap.texts(registry._eval_rows(spark, str(DATA)))
    _, classes = overlap.text_classes(train, ev)
    found = {hot: {tuple(r) for r in overlap.class_pairs(classes, hot).collect()} for hot in (overlap.HOT, 0)}
    assert found[overlap.HOT] == found[0]
    texts = {r.text_id: (r.side, r.bag.split(" "), r.key) for r in classes.where(F.col("bag") != "").collect()}
    e, t = ([(i, b, k) for i, (s, b, k) in texts.items() if s == side] for side in ("eval", "train"))
    assert found[0] == {(i, j) for i, a, k in e for j, b, m in t if k == m or overlap.near(a, b)}
