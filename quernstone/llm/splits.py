"""Splits that keep related queries together: components, label vectors, grouped iterative stratification.

Groups are placed by their label vectors, the group with the rarest outstanding label first and the one with more of it
before others, each into the split that needs most of that label. Groups of equal labels are alike to this rule, so they
are dealt in one step, as many to each split as its need is of all need; what does not divide goes one by one to the split
that needs it most. Among groups of equal labels, those of more queries go where queries are lacking. So the driver sees
one row a vector, in order and one at a time, and never a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby, islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.components import connected
from quernstone.llm.runs import format_copies
from quernstone.session import discard, materialize, scratch_path

PRODUCT_BASE = 1 << 62  # product nodes lie above all query ids, so a component's smallest node is a query
LABELS = ("E", "S", "C", "I")
RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}
DIMS = (*LABELS, "n")
QUERIES = 8  # how much a split's need of queries counts beside that of the lead label, for the groups that do not divide
PART = 50_000  # groups of one vector that are ranked in one task; rows of the plan that the driver holds


def product_id(col: Column) -> Column:
    """Upper case without surrounding whitespace; null unless it is B and nine letters A-Z or digits."""
    p = F.upper(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))
    return F.when(p.rlike("^B[A-Z0-9]{9}$"), p)


def product_node(col: Column) -> Column:
    """An exact, order-keeping number for a valid product id: its last nine characters in base 36."""
    return F.lit(PRODUCT_BASE) + F.conv(F.substring(product_id(col), 2, 9), 36, 10).cast("long")


def product_of(node: Column) -> Column:
    return F.concat(F.lit("B"), F.lpad(F.conv((node - F.lit(PRODUCT_BASE)).cast("string"), 10, 36), 9, "0"))


def query_labels(examples: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(node, label): components of queries and products. Queries meet in a product they are judged against, or as
    copies of one text in ``tables``. Invalid products and blank texts link nothing; null ids are left out."""
    judged = examples.select("query_id", product_node(F.col("product_id")).alias("product")).where("query_id is not null and product is not null")
    texts = reduce(DataFrame.unionByName, [t.select("query_id", "query") for t in tables])
    copies = format_copies(texts, "query_id", "query").where("id <> rep")
    return connected(judged.toDF("a", "b").unionByName(copies.toDF("a", "b")))


def esci(col: Column) -> Column:
    """E, S, C or I from its spellings (any case, padding, whole words); null for the rest."""
    head = F.upper(F.substring(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""), 1, 1))
    return F.when(F.upper(F.regexp_replace(col, r"(?U)\s+", "")).rlike("^(E|S|C|I|EXACT|SUBSTITUTE|COMPLEMENT|IRRELEVANT)$"), head)


def query_groups(examples: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(query_id, grp, product, n, E, S, C, I): every query of any table with its group, the group's smallest product node and
    which labels it was ever judged with."""
    flags = [F.max((esci(F.col("esci_label")) == x).cast("int")).alias(x) for x in LABELS]
    seen = examples.select("query_id", "esci_label").unionByName(reduce(DataFrame.unionByName, [t.select("query_id", F.lit(None).cast("string").alias("esci_label")) for t in tables]))
    vectors = seen.where("query_id is not null").groupBy("query_id").agg(*flags).na.fill(0, list(LABELS)).withColumn("n", F.lit(1))
    labels = query_labels(examples, tables)
    query = F.col("node") < PRODUCT_BASE
    products = labels.where(~query).groupBy("label").agg(F.min("node").alias("product"))
    of = labels.where(query).join(products, "label", "left").select(F.col("node").alias("query_id"), "label", "product")
    return vectors.join(of, "query_id", "left").select("query_id", F.coalesce("label", "query_id").alias("grp"), "product", "n", *LABELS)


def label_order(rows: DataFrame) -> list[str]:
    """The labels by how rare they are among what is outstanding: once the groups with the first are placed, the next is the
    rarest of the rest, and so on; last n, the queries without any label."""
    held = sum(F.when(F.col(x) > 0, 1 << i).otherwise(0) for i, x in enumerate(LABELS))
    sums = {r.held: r.asDict() for r in rows.groupBy(held.alias("held")).agg(*[F.sum(x).alias(x) for x in LABELS]).collect()}  # a row a set of labels
    order: list[str] = []
    while len(order) < len(LABELS):
        placed = sum(1 << LABELS.index(x) for x in order)
        open_ = {x: sum(r[x] for h, r in sums.items() if not h & placed) for x in LABELS if x not in order}
        order.append(min(open_, key=lambda x: (open_[x] == 0, open_[x], x)))
    return [*order, "n"]


class Placer:
    """What each split still needs of every label and of all queries, and the dealing of groups of equal labels."""

    def __init__(self, totals: dict[str, int], ratios: dict[str, float]):
        self.need = {s: {d: r * totals[d] for d in DIMS} for s, r in ratios.items()}
        self.ratios = ratios

    def deal(self, labels: dict[str, int], lead: str, sizes: list[tuple[int, int]]) -> list[dict[str, int]]:
        """How many groups of each size go to each split; ``sizes`` has (queries, groups) of falling size. The lead label
        decides how many of all groups a split gets, and what it lacks of all queries how large these are."""
        need, count = self.need, sum(k for _, k in sizes)
        lack = {s: max(0.0, x[lead]) for s, x in need.items()}
        whole = sum(lack.values())  # at least what the groups hold of the label
        open_ = {s: int(count * x / whole) if whole else 0 for s, x in lack.items()}
        each, many = {"n": sizes[0][0]} | labels, {d: max(1.0, sum(abs(x[d]) for x in need.values())) for d in (lead, "n")}
        # need of the lead label and of queries as parts of what is outstanding, against the split's share of the whole
        most = lambda s: sum((need[s][d] - open_[s] * each[d]) / many[d] * (QUERIES if d == "n" else 1) for d in (lead, "n")) / self.ratios[s]
        for _ in range(count - sum(open_.values())):
            open_[max(need, key=lambda s: (most(s), self.ratios[s], s))] += 1
        for s, k in open_.items():
            for d in LABELS:
                need[s][d] -= k * labels[d]
        queries = {s: max(0.0, x["n"]) for s, x in need.items()}
        all_queries, all_here = sum(queries.values()) or 1.0, sum(n * k for n, k in sizes)
        want, least = {s: all_here * x / all_queries for s, x in queries.items()}, sizes[-1][0]
        out = []
        for n, k in sizes:
            over = {s: max(0.0, want[s] - open_[s] * least) if open_[s] else 0.0 for s in need}
            whole, got = sum(over.values()), dict.fromkeys(need, 0)
            for s in need:
                got[s] = min(open_[s], int(k * over[s] / whole)) if whole else 0
            for _ in range(k - sum(got.values())):
                s = max((s for s in need if open_[s] > got[s]), key=lambda s: ((want[s] - got[s] * n) / (open_[s] - got[s]), s))
                got[s] += 1
            for s in need:
                open_[s] -= got[s]
                want[s] -= got[s] * n
                need[s]["n"] -= got[s] * n
            out.append(got)
        return out


def place(vectors: Iterable[dict], totals: dict[str, int], ratios: dict[str, float]) -> Iterator[tuple]:
    """(E, S, C, I, n, split, first, last): which of the groups of each vector, numbered from 1, go to a split. ``vectors`` come
    in the order of placement, with their lead label and their number of groups."""
    placer = Placer(totals, ratios)
    for (lead, *counts), same in groupby(vectors, key=lambda v: (v["lead"], *[v[d] for d in LABELS])):
        sizes = [(v["n"], v["groups"]) for v in same]
        for (n, _), got in zip(sizes, placer.deal(dict(zip(LABELS, counts)), lead, sizes)):
            at = 0
            for s, k in got.items():
                if k:
                    yield (*counts, n, s, at + 1, at + k)
                    at += k


def stratified_split(rows: DataFrame, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """(query_id, grp, product, split, n, labels...) for the rows of :func:`query_groups`; no group is divided.

    An empty input gives no rows. A group larger than a split's target overfills it; the reached shares say so.
    """
    spark = rows.sparkSession
    rows, _ = materialize(rows, "query-groups")
    sums = [F.sum(x).alias(x) for x in DIMS]
    totals = rows.agg(*sums).first().asDict()
    if not totals["n"]:
        return rows.withColumn("split", F.lit(None).cast("string"))
    groups, a = materialize(rows.groupBy("grp").agg(*sums), "groups")
    order = label_order(groups)
    step = F.coalesce(*[F.when(F.col(x) > 0, i) for i, x in enumerate(order)])
    of_lead = F.coalesce(*[F.when(F.col(x) > 0, F.col(x)) for x in order])
    vectors = groups.groupBy(*DIMS).agg(F.count("*").alias("groups")).withColumn("step", step)
    vectors, b = materialize(vectors, "vectors")
    ordered = (r.asDict() | {"lead": order[r["step"]]} for r in vectors.orderBy("step", of_lead.desc(), *LABELS, F.desc("n")).toLocalIterator(prefetchPartitions=True))
    path, planned = scratch_path(spark, "plan"), place(ordered, totals, ratios)
    schema = ", ".join(f"{d} long" for d in DIMS) + ", split string, first long, last long"
    while part := list(islice(planned, PART)):
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
    plan = spark.read.schema(schema).parquet(path)
    # places 1..n of the groups of a vector: counts of parts come first, so a vector of any share of the groups is no one task
    parts = vectors.select(*DIMS, F.ceil(F.col("groups") / PART).alias("parts"))
    hashed = groups.join(parts, list(DIMS)).withColumn("part", F.pmod(F.xxhash64("grp"), F.col("parts"))).select("grp", *DIMS, "part")
    sizes = hashed.groupBy(*DIMS, "part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy(*DIMS).orderBy("part")) - F.col("size")).drop("size")
    inside = F.row_number().over(Window.partitionBy(*DIMS, "part").orderBy("grp"))
    numbered = hashed.withColumn("at", inside).join(before, [*DIMS, "part"]).withColumn("at", F.col("at") + F.col("before"))
    placed = numbered.join(plan, list(DIMS)).where("at between first and last").select("grp", "split")
    placed, _ = materialize(placed, "placed")
    discard(spark, a, b, path)
    return rows.join(placed, "grp", "left")


def found_groups(split: DataFrame) -> DataFrame:
    """(group_product_id, query_id) of all queries in groups of at least two that have a product, from an assignment."""
    large = split.groupBy("grp").agg(F.count("*").alias("queries")).where("queries >= 2").select("grp")
    return split.where("product is not null").join(large, "grp", "left_semi").select(product_of(F.col("product")).alias("group_product_id"), "query_id")


def shares(split: DataFrame, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """(split, label, target, queries, share): what each split reached of all queries and of each label's."""
    spark = split.sparkSession
    got = split.groupBy("split").agg(F.sum("n").alias("all"), *[F.sum(x).alias(x) for x in LABELS])
    long = got.unpivot("split", ["all", *LABELS], "label", "queries")
    grid = spark.createDataFrame(list(ratios.items()), "split string, target double").join(F.broadcast(spark.createDataFrame([(x,) for x in ("all", *LABELS)], "label string")))
    full = grid.join(long, ["split", "label"], "left").na.fill(0, ["queries"])
    sums = full.groupBy("label").agg(F.sum("queries").alias("total"))
    return full.join(sums, "label").select("split", "label", "target", "queries", F.coalesce(F.try_divide("queries", "total"), F.lit(0.0)).alias("share"))

