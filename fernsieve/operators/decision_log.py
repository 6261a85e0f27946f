"""A decision log on disk, whose state comes from the last snapshot and what has been logged since.

Batches and undos lie in segments by batch id, undos by the newest batch at their time. A snapshot covers all segments
before one: ``top`` has the newest live batch of each cluster, ``live`` all live batches, in buckets by cluster. The state
is the snapshot's top, but for clusters whose top has been undone since: only their buckets of ``live`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsieve.plans.staging import sent_if_few, stage_table

#: Batch ids of a segment, and buckets of a snapshot.
SEGMENT, BUCKETS = 10_000, 32


class DecisionLog:
    """Batches (batch_id, cluster_key) and undos (batch_id) in ``folder``. Batch ids grow; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "bigint") -> None:
        """``kind`` is the type of cluster keys."""
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def batches(self, since: int = 0) -> DataFrame:
        """What has been logged in segments from ``since`` on; earlier ones are not read."""
        return self._read("batches", f"batch_id bigint, cluster_key {self.kind}, segment bigint").where(F.col("segment") >= since).drop("segment")

    def undos(self, since: int = 0) -> DataFrame:
        return self._read("undos", "batch_id bigint, segment bigint").where(F.col("segment") >= since).drop("segment")

    def append(self, batches: DataFrame | None = None, undos: DataFrame | None = None) -> None:
        """Log batches, then undos of any batches up to now. Nothing is ever rewritten."""
        if batches is not None:
            new = stage_table(batches.select(F.col("batch_id").cast("bigint").alias("batch_id"), F.col("cluster_key").cast(self.kind).alias("cluster_key")), "log")
            low, newest = new.agg(F.min("batch_id")).first()[0], self._newest()
            if low is not None and newest is not None and low <= newest:
                raise ValueError(f"batch {low} is not newer than {newest}, which is logged")
            new.withColumn("segment", F.floor(F.col("batch_id") / SEGMENT)).write.mode("append").partitionBy("segment").parquet(f"{self.folder}/batches")
        if undos is not None:
            at = (self._newest() or 0) // SEGMENT
            undos.select(F.col("batch_id").cast("bigint").alias("batch_id")).withColumn("segment", F.lit(at).cast("bigint")).write.mode("append").partitionBy("segment").parquet(f"{self.folder}/undos")

    def _segments(self) -> list[int]:
        """Segments of batches, by the names of their folders."""
        return self._numbers("batches", "segment=")

    def _numbers(self, name: str, prefix: str) -> list[int]:
        path = f"{self.folder}/{name}" if name else self.folder
        if not self._there(path):
            return []
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found = [s.getPath().getName() for s in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        return sorted(int(n.removeprefix(prefix)) for n in found if n.startswith(prefix) and n.removeprefix(prefix).isdigit())

    def _newest(self) -> int | None:
        segments = self._segments()
        return self.batches(segments[-1]).agg(F.max("batch_id")).first()[0] if segments else None

    def snapshots(self) -> list[int]:
        """Segments up to which, not included, there is a whole snapshot; its ``top`` is written last."""
        return [n for n in self._numbers("", "snapshot-") if self._there(f"{self.folder}/snapshot-{n}/top/_SUCCESS")]

    def take_snapshot(self) -> int:
        """Cover all segments but the newest, which still grows, from the last snapshot and what came after it. Returns the first segment not covered."""
        segments = self._segments()
        upto = segments[-1] if segments else 0
        taken = self.snapshots()
        if not segments or taken and taken[-1] >= upto:
            return taken[-1] if taken else 0
        since = taken[-1] if taken else 0
        known = self._live(since).drop("bucket") if taken else self.batches().limit(0)
        # undos of the newest segment are left to the state, which reads that segment anyhow
        fresh = self.batches(since).where(F.col("batch_id") < upto * SEGMENT)
        gone = self._read("undos", "batch_id bigint, segment bigint").where((F.col("segment") >= since) & (F.col("segment") < upto)).select("batch_id").distinct()
        live = known.unionByName(fresh).join(sent_if_few(stage_table(gone, "undone")), "batch_id", "left_anti").withColumn("bucket", bucket_of())
        path = f"{self.folder}/snapshot-{upto}"
        live.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/live")
        self._live(upto).groupBy("cluster_key").agg(F.max("batch_id").alias("batch_id")).write.mode("overwrite").parquet(f"{path}/top")
        return upto

    def _live(self, snapshot: int) -> DataFrame:
        return self._read(f"snapshot-{snapshot}/live", f"batch_id bigint, cluster_key {self.kind}, bucket int")

    def state(self) -> DataFrame:
        """(cluster_key, batch_id): the newest batch of each cluster that has not been undone, as ``decisions.current_state`` of the whole log."""
        taken = self.snapshots()
        since = taken[-1] if taken else 0
        gone = stage_table(self.undos(since).distinct(), "undone")
        live = self.batches(since).join(sent_if_few(gone), "batch_id", "left_anti").select("cluster_key", "batch_id")
        if taken:
            top = self._read(f"snapshot-{since}/top", f"cluster_key {self.kind}, batch_id bigint").select("cluster_key", "batch_id")
            broken = stage_table(top.join(sent_if_few(gone), "batch_id", "left_semi").select("cluster_key"), "broken")
            asked = [r[0] for r in broken.select(bucket_of()).distinct().collect()]  # BUCKETS at most
            live = live.unionByName(top.join(sent_if_few(gone), "batch_id", "left_anti").select("cluster_key", "batch_id"))
            if asked:
                before = self._live(since).where(F.col("bucket").isin(asked)).join(sent_if_few(broken), "cluster_key", "left_semi")
                live = live.unionByName(before.join(sent_if_few(gone), "batch_id", "left_anti").select("cluster_key", "batch_id"))
        return live.groupBy("cluster_key").agg(F.max("batch_id").alias("batch_id"))


def bucket_of() -> Column:
    return F.pmod(F.xxhash64("cluster_key"), F.lit(BUCKETS)).cast("int")
