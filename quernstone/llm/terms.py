"""Term frequencies kept up to date by signed deltas.

A change set turns into per-term changes of two counts, occurrences and records: an added record counts +1, a deleted one
-1, a changed one -1 for its old and +1 for its new state, an unchanged one is not looked at. The changes are summed
before the shuffle and merged into a store of counts partitioned by a hash of the term; a merge reads and rewrites the
partitions that hold changed terms and no others.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import discard, hadoop_fs, materialize, scratch_path

FIELDS = ("query_tokens", "ner_tags")
COUNTS = "field_name string, term string, occurrences long, records long"
RARE_ROWS, COMMON_SHARE = 2, 0.05
BUCKET_TERMS = 250_000  # terms that one bucket holds when buckets are laid out anew; twice as many lay them out again


def term(col: Column) -> Column:
    """Trimmed (any Unicode white space) and in lower case."""
    return F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))


def _signed(rows: DataFrame, sign: int, fields: tuple[str, ...]) -> DataFrame:
    """(field_name, term, occ, rec) with one row per element and one per distinct term of a record; the null term
    stands for the record itself, where the field is not null."""

    def of(name: str) -> Column:
        terms = F.filter(F.transform(F.col(name), term), lambda t: t.isNotNull() & (t != ""))
        entry = lambda t, occ, rec: F.struct(F.lit(name).alias("field_name"), t.alias("term"), F.lit(occ * sign).alias("occ"), F.lit(rec * sign).alias("rec"))
        own = F.array(entry(F.lit(None).cast("string"), 0, 1))
        every = F.transform(terms, lambda t: entry(t, 1, 0))
        once = F.transform(F.array_distinct(terms), lambda t: entry(t, 0, 1))
        return F.when(F.col(name).isNotNull(), F.concat(own, every, once)).otherwise(F.array().cast(own_type))

    own_type = "array<struct<field_name:string,term:string,occ:int,rec:int>>"
    return rows.select(F.explode(F.concat(*[of(x) for x in fields])).alias("e")).select("e.*")


def term_changes(added: DataFrame | None, deleted: DataFrame | None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Summed signed changes of the counts; only terms whose counts change remain."""
    parts = [_signed(x.select(*fields), sign, fields) for x, sign in ((added, 1), (deleted, -1)) if x is not None]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    sums = both.groupBy("field_name", "term").agg(F.sum("occ").cast("long").alias("occurrences"), F.sum("rec").cast("long").alias("records"))
    return sums.where("occurrences <> 0 or records <> 0")


def changed_rows(old: DataFrame, new: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(added, deleted) between two states of a table with a unique, non-null key: changed rows are in both."""
    o = old.select(key, F.struct(*fields).alias("before"), F.xxhash64(*fields).alias("hb"))
    n = new.select(key, F.struct(*fields).alias("after"), F.xxhash64(*fields).alias("ha"))
    both = o.join(n, key, "full").where("not (hb <=> ha) or not (before <=> after)")
    return both.where("after is not null").select("after.*"), both.where("before is not null").select("before.*")


class TermStore:
    """Persistent counts under ``path``: ``data/v=<version>/bucket=<hash of the term>`` and a manifest per version that says
    which version holds each bucket. A version exists once its manifest is renamed into place; readers, also those of
    another session, see the newest. A writer that dies leaves nothing but files that no manifest names.

    The null term of a field holds the number of records in which the field is not null. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_terms: int = BUCKET_TERMS):
        self.spark, self.path, self.bucket_terms = spark, path or scratch_path(spark, "terms"), bucket_terms

    def versions(self) -> list[int]:
        fs, p = hadoop_fs(self.spark, f"{self.path}/manifests")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(x.removesuffix(".json")) for x in names if x.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, buckets, terms and ``at``, the version of each bucket that holds any; of the newest version by default."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if not version:
            return {"version": 0, "buckets": 0, "terms": 0, "at": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        name = f"{self.path}/manifests/{manifest['version']}.json"
        fs, whole = hadoop_fs(self.spark, name)
        _, part = hadoop_fs(self.spark, name + ".part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(part, whole):
            raise RuntimeError(f"version {manifest['version']} of {self.path} exists already")

    def counts(self, version: int | None = None) -> DataFrame:
        """(field_name, term, occurrences, records) of a version, by default the newest."""
        return self._read(self.manifest(version)["at"])

    def _read(self, at: dict[str, int]) -> DataFrame:
        if not at:
            return self.spark.createDataFrame([], COUNTS)
        return self.spark.read.schema(COUNTS).parquet(*[f"{self.path}/data/v={v}/bucket={b}" for b, v in at.items()])

    def merge(self, changes: DataFrame) -> None:
        """Add signed changes and commit the next version; terms that no longer occur go away. No change, no version."""
        old = self.manifest()
        changes, path = materialize(changes.select("field_name", "term", "occurrences", "records"), "changes")
        n = changes.count()
        if not n:
            discard(self.spark, path)
            return
        buckets, most = old["buckets"], 2 * self.bucket_terms
        if not buckets or old["terms"] + n > most * buckets:
            buckets = -(-(old["terms"] + n) // self.bucket_terms)
        bucket = F.pmod(F.xxhash64("field_name", "term"), F.lit(buckets)).cast("int").alias("bucket")
        if buckets == old["buckets"]:  # as many rows as buckets
            touched = [str(r.bucket) for r in changes.select(bucket).distinct().collect()]
        else:
            touched = list(old["at"])  # all are laid out anew
        held = self._read({b: old["at"][b] for b in touched if b in old["at"]})
        sums = [F.sum(c).alias(c) for c in ("occurrences", "records")]
        merged = held.unionByName(changes).groupBy("field_name", "term").agg(*sums).where("occurrences <> 0 or records <> 0")
        version, data = old["version"] + 1, f"{self.path}/data/v={old['version'] + 1}"
        merged.select("*", bucket).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        written = self.spark.read.schema(COUNTS + ", bucket int").parquet(data).groupBy("bucket").agg(F.count("*").alias("n")).collect()
        kept = {} if buckets != old["buckets"] else {b: v for b, v in old["at"].items() if b not in set(touched)}
        sizes = {} if buckets != old["buckets"] else {b: old["sizes"][b] for b in kept}
        sizes |= {str(r.bucket): r.n for r in written}
        at = kept | {str(r.bucket): version for r in written}
        self._commit({"version": version, "buckets": buckets, "terms": sum(sizes.values()), "at": at, "sizes": sizes})
        discard(self.spark, path)


def marked(counts: DataFrame, rare_rows: int = RARE_ROWS, common_share: float = COMMON_SHARE) -> DataFrame:
    """counts plus ``mark``: rare in at most ``rare_rows`` records, common in more than ``common_share`` of the records
    where the field is not null, else null. A term that is both, in a table of a few rows, is rare."""
    totals = counts.where("term is null").select("field_name", F.col("records").alias("total"))  # one row a field
    mark = F.when(F.col("records") <= rare_rows, "rare").when(F.col("records") > F.lit(common_share) * F.col("total"), "common")
    return counts.where("term is not null").join(F.broadcast(totals), "field_name").select("field_name", "term", "occurrences", "records", mark.alias("mark"))


def table_terms(rows: DataFrame, earlier: DataFrame | None = None, store: TermStore | None = None, share: int = 8) -> DataFrame:
    """Marked counts of a whole table, which reaches the store in two deltas, as a table does that is loaded and later
    changed: first all rows but one in ``share`` and the rows of ``earlier``, then the others come and those of ``earlier``
    go. A store that is given keeps what it held.

    Null and blank elements are no terms, null arrays are no records of their field, empty arrays are; repeated rows
    count again, extra columns are ignored, an empty table has no terms.
    """
    store = store or TermStore(rows.sparkSession)
    rows = rows.select(*FIELDS)
    late = F.pmod(F.xxhash64(*FIELDS), F.lit(share)) == 0
    first = rows.where(~late)
    store.merge(term_changes(first if earlier is None else first.unionByName(earlier.select(*FIELDS)), None))
    store.merge(term_changes(rows.where(late), earlier))
    return marked(store.counts())
