"""From decisions to actions, and carrying each out once."""

from __future__ import annotations

import contextlib
import datetime as dt
import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsieve.functions.scalar import action_key
from fernsieve.plans.staging import drop_staged, let_workers_import, stage_table

#: Fixed values.
ALBUM, KEYWORD = "Cull/Candidates", "cull"


def mark_status(marks: DataFrame, live: DataFrame) -> DataFrame:
    """Add status to marks: gone from the live library, edited since, else keep, cull or ignored (an unset mark)."""
    now = live.select("photo_id", F.coalesce("mod_key", F.lit("")).alias("_now"), F.lit(True).alias("_in"))
    joined = marks.join(now, "photo_id", "left")
    status = (
        F.when(~F.col("mark").isin("keep", "cull"), "ignored").when(F.col("_in").isNull(), "gone")
        .when(F.coalesce("mod_key", F.lit("")) != F.col("_now"), "edited").otherwise(F.col("mark"))
    )
    return joined.withColumn("status", status).drop("_now", "_in")


def plan_actions(status: DataFrame, album: str = ALBUM, keyword: str = KEYWORD) -> DataFrame:
    """(photo_id, action): culls go to an album and get a keyword, kept favorites are marked; others do nothing."""
    kinds = F.when(F.col("status") == "cull", F.array(action_key(F.lit("album"), F.lit(album)), action_key(F.lit("keyword"), F.lit(keyword)))).when((F.col("status") == "keep") & F.col("favorite"), F.array(F.lit("favorite")))
    return status.select("photo_id", F.explode(kinds).alias("action"))


def split_by_ledger(actions: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is pending, and what the ledger says has been done."""
    done = ledger.select("photo_id", "action").distinct()
    return actions.join(done, ["photo_id", "action"], "left_anti"), actions.join(done, ["photo_id", "action"], "left_semi")


class FolderJournal:
    """What each action has come to, as small files in a folder that the driver and all executors mount.

    An action is claimed by creating its file, which the file system grants once; what is done says so in a second file,
    put in its place whole. Any object with ``path``, ``claim``, ``finish``, ``release`` and ``state`` may stand in.
    """

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://").rstrip("/")

    def _file(self, photo: object, action: str, kind: str) -> str:
        name = hashlib.sha256(f"{photo}\0{action}".encode()).hexdigest()
        return os.path.join(self.path, kind, name[:2], f"{name}.json")

    def claim(self, photo: object, action: str) -> bool:
        """True for the one that may act now."""
        path = self._file(photo, action, "intent")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True

    def finish(self, photo: object, action: str, row: dict) -> None:
        path = self._file(photo, action, "done")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.{uuid.uuid4().hex}.tmp", "w") as f:
            f.write(json.dumps(row))
            f.flush()
            os.fsync(f.fileno())
        os.replace(f.name, path)

    def release(self, photo: object, action: str) -> None:
        """Give a claim back: the action has failed and may be tried again."""
        with contextlib.suppress(FileNotFoundError):
            os.remove(self._file(photo, action, "intent"))

    def state(self, photo: object, action: str) -> str:
        """``done``, ``begun`` (claimed, and not known to have ended) or ``open``."""
        kinds = [k for k in ("done", "intent") if os.path.exists(self._file(photo, action, k))]
        return {"done": "done", "intent": "begun"}[kinds[0]] if kinds else "open"


LEDGER = "photo_id {kind}, action string, session_id string, applied_at string"


def read_ledger(spark: SparkSession, ledger_path: str, kind: str = "string") -> DataFrame:
    """(photo_id, action, session_id, applied_at) of what has been done, each action once, by its first row; empty without a ledger."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER.format(kind=kind))
    rows = spark.read.schema(LEDGER.format(kind=kind)).parquet(ledger_path)
    return rows.groupBy("photo_id", "action").agg(F.min(F.struct("applied_at", "session_id")).alias("first")).select("photo_id", "action", "first.session_id", "first.applied_at")


def fold_journal(spark: SparkSession, journal: FolderJournal, ledger_path: str, kind: str = "string") -> None:
    """Move what a journal says is done into the ledger. A run that was cut off is folded by the next one.

    Rows are added before their files go, and those that the ledger has already are not added, so that a fold that is cut
    off itself is made good by the next.
    """
    done = os.path.join(journal.path, "done")
    if not os.path.isdir(done) or not any(files for _, _, files in os.walk(done)):
        return
    rows = stage_table(spark.read.schema(LEDGER.format(kind=kind)).json(f"file://{done}/*/*.json"), "folded")
    rows.dropDuplicates(["photo_id", "action"]).join(read_ledger(spark, ledger_path, kind).select("photo_id", "action"), ["photo_id", "action"], "left_anti").write.mode("append").parquet(ledger_path)
    for row in rows.select(F.col("photo_id"), "action").toLocalIterator():
        for kind_of in ("intent", "done"):
            with contextlib.suppress(FileNotFoundError):
                os.remove(journal._file(row["photo_id"], row["action"], kind_of))
    drop_staged(rows)


def apply_actions(pending: DataFrame, writer: Callable[[str, str], None] | None, ledger_path: str | None, dry_run: bool = True, journal: FolderJournal | None = None, session_id: str = "", landed: Callable[[str, str], bool | None] | None = None) -> DataFrame:
    """Carry out what is pending; each action fails or succeeds alone, and successes are logged as they land.

    The result counts actions by status. A real run needs a writer and a ledger. Before a task acts it claims the action in
    the ``journal`` (by default a folder beside the ledger), afterwards it says so: a task that Spark repeats, or runs
    twice at once, or a second run after a lost one, acts on nothing that another has begun. An action that was begun by
    a task that is gone may have landed or not; ``landed`` is asked, and acts again on False only. Without an answer it is
    ``in_doubt`` and stays so until the claim is released. Failed actions are open again. All actions of a photo are in
    one task, in order; repeated rows act once.
    """
    pending = pending.select("photo_id", "action").distinct()
    if dry_run:
        return pending.agg(F.count("*").alias("n")).select(F.lit("planned").alias("status"), "n")
    if writer is None or ledger_path is None:
        raise ValueError("a real run needs a writer and a ledger")
    spark, kind = pending.sparkSession, dict(pending.dtypes)["photo_id"]
    journal = journal or FolderJournal(f"{ledger_path.rstrip('/')}.journal")
    fold_journal(spark, journal, ledger_path, kind)
    pending, _ = split_by_ledger(pending, read_ledger(spark, ledger_path, kind))

    def act(photo: object, action: str) -> tuple[str, str | None]:
        if not journal.claim(photo, action):
            state = journal.state(photo, action)
            if state == "done":
                return "done", None
            known = landed(photo, action) if landed else None
            if known is None or state == "open":  # whoever has it is at work, or has just failed
                return "in_doubt", None
        else:
            known = False
        try:
            if not known:
                writer(photo, action)
        except Exception as e:  # noqa: BLE001  one failure must not stop the others
            journal.release(photo, action)
            return "failed", f"{type(e).__name__}: {e}"
        journal.finish(photo, action, {"photo_id": photo, "action": action, "session_id": session_id, "applied_at": dt.datetime.now(dt.UTC).isoformat()})
        return "done", None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            photos, names = batch.column(0), batch.column(1)
            status, error = zip(*map(act, photos.to_pylist(), names.to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([photos, names, pa.array(status, pa.string()), pa.array(error, pa.string())], names=["photo_id", "action", "status", "error"])

    let_workers_import(spark)
    ordered = pending.repartition("photo_id").sortWithinPartitions("photo_id", "action")
    done = stage_table(ordered.mapInArrow(work, f"photo_id {kind}, action string, status string, error string"), "applied")
    fold_journal(spark, journal, ledger_path, kind)
    return done.groupBy("status").agg(F.count("*").alias("n"))
