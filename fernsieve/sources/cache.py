"""Results kept by (uuid, mod_key, analysis_key) in a folder for each version of the analysis.

Rows lie in BUCKETS buckets by their uuid. A manifest, a small file that is put in its place whole, says which folders
hold each bucket now; a write adds its folder to the buckets that it has rows for, and rewrites those that have too many.
So a write that fails changes nothing, readers see one state, and the files of a bucket are bounded however many writes
there have been. All access goes through Hadoop's file systems, so the folder can be in any store that renames files.
"""

from __future__ import annotations

import json
import uuid as uuids

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsieve.plans.staging import stage_table

KEYS = ["uuid", "mod_key", "analysis_key"]
#: Buckets of a cache; folders of a bucket beyond which it is rewritten; manifests that are kept for those who still read.
BUCKETS, MOST_FOLDERS, KEPT_MANIFESTS = 64, 6, 3
WRITE, BUCKET = "_write", "_bucket"


def cache_folder(root: str, kind: str, version: int) -> str:
    """Another version is another folder: what an older one holds is not seen."""
    return f"{root.rstrip('/')}/{kind}/v{version}"


def hits_and_misses(wanted: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``wanted`` with the cached columns where all three keys agree, and what has to be computed."""
    return wanted.join(latest(cached), KEYS), wanted.join(cached.select(*KEYS), KEYS, "left_anti")


def latest(cached: DataFrame) -> DataFrame:
    """One row for each key: the one written last, by ``written`` where there is such a column."""
    if "written" not in cached.columns:
        return cached.dropDuplicates(KEYS)
    rest = [c for c in cached.columns if c not in KEYS]
    return cached.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "written").alias("row")).select(*KEYS, "row.*")


class Store:
    """A cache's folder: its manifests and what they name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def manifests(self) -> list[int]:
        if not self.fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def read(self, number: int) -> dict[str, list[str]]:
        rows = self.spark.read.text(f"{self.folder}/manifest-{number:09d}.json", wholetext=True).collect()  # bounded: BUCKETS * MOST_FOLDERS names
        return json.loads(rows[0][0])

    def now(self) -> tuple[int, dict[str, list[str]]]:
        """The newest manifest's number, 0 without one, and the folders of each bucket, oldest first."""
        while True:
            numbers = self.manifests()
            if not numbers:
                return 0, {}
            try:
                return numbers[-1], self.read(numbers[-1])
            except Exception:  # noqa: BLE001  it has been retired meanwhile, if there is a newer one
                if self.manifests()[-1:] == numbers[-1:]:
                    raise

    def switch(self, number: int, state: dict[str, list[str]]) -> bool:
        """Put manifest ``number`` in its place; False if somebody else has been first."""
        final, draft = self._path(f"{self.folder}/manifest-{number:09d}.json"), self._path(f"{self.folder}/.{uuids.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            return False
        return True

    def retire(self) -> None:
        """Delete manifests but the last KEPT_MANIFESTS, and folders that only those name."""
        numbers = self.manifests()
        old, kept = numbers[:-KEPT_MANIFESTS], numbers[-KEPT_MANIFESTS:]
        names = lambda some: {p for n in some for of in self.read(n).values() for p in of}
        for path in sorted(names(old) - names(kept)) if old else ():
            self.fs.delete(self._path(f"{self.folder}/{path}"), True)
        for n in old:
            self.fs.delete(self._path(f"{self.folder}/manifest-{n:09d}.json"), False)

    def table(self, state: dict[str, list[str]], schema, buckets: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{p}" for b in buckets for p in state.get(b, ())]
        empty = self.spark.createDataFrame([], schema).withColumn(WRITE, F.lit(0).cast("bigint"))
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty


def bucket_of() -> Column:
    return F.pmod(F.xxhash64("uuid"), F.lit(BUCKETS)).cast("int")


def newest(rows: DataFrame) -> DataFrame:
    """One row for each key, that of the last write; of one write that with the largest ``written``, if there is such a column."""
    rest = [c for c in rows.columns if c not in (*KEYS, WRITE)]
    order = F.struct(WRITE, *[c for c in ("written",) if c in rest])
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), order).alias("row"), F.max(WRITE).alias(WRITE)).select(*KEYS, "row.*", WRITE)


def put(fresh: DataFrame, folder: str) -> None:
    """Add rows, or replace those whose keys are there; only what lies in the buckets of ``fresh`` is touched."""
    store = Store(fresh.sparkSession, folder)
    rows = stage_table(newest(fresh.withColumn(WRITE, F.lit(0).cast("bigint"))), "upsert")
    touched = sorted(str(r[0]) for r in rows.select(bucket_of()).distinct().collect())  # BUCKETS at most
    if not touched:
        return
    while True:
        number, state = store.now()
        full = [b for b in touched if len(state.get(b, ())) >= MOST_FOLDERS]
        marked = rows.withColumn(WRITE, F.lit(number + 1).cast("bigint"))
        old = store.table(state, fresh.schema, full)
        merged = newest(marked.where(bucket_of().isin([int(b) for b in full])).unionByName(old)).unionByName(marked.where(~bucket_of().isin([int(b) for b in full]))) if full else marked
        name = f"write-{number + 1:09d}-{uuids.uuid4().hex}"
        merged.withColumn(BUCKET, bucket_of()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{store.folder}/{name}")
        new = {b: [f"{name}/{BUCKET}={b}"] if b in full else [*state.get(b, ()), f"{name}/{BUCKET}={b}"] for b in touched}
        if store.switch(number + 1, state | new):
            store.retire()
            return
        store.fs.delete(store._path(f"{store.folder}/{name}"), True)  # another write came first: on top of it once more


def get(spark: SparkSession, folder: str, schema, wanted: DataFrame | None = None) -> DataFrame:
    """The cache, one row for each key, empty where nothing has been put yet; with ``wanted``, only the buckets of its uuids are read."""
    store = Store(spark, folder)
    _, state = store.now()
    asked = sorted(state) if wanted is None else sorted(str(r[0]) for r in wanted.select(bucket_of()).distinct().collect())
    rows = store.table(state, schema, asked)
    single = all(len(state.get(b, ())) <= 1 for b in asked)
    names = spark.createDataFrame([], schema).columns
    return (rows if single else newest(rows)).select(*names)
