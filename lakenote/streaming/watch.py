"""Live upkeep: changes of a folder's files, bursts of events, and one incremental build for each burst."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakenote.operators.incremental import snapshot_diff
from lakenote.sources.files import listing
from lakenote.tables import checkpoint


@dataclass(frozen=True)
class Watch:
    """A folder whose listings are kept as Parquet tables in `state`, a folder that all nodes share."""

    spark: SparkSession
    root: str
    state: str
    relevant: Column | None = None

    def last(self) -> int:
        """The number of the last listing that was built from, 0 before the first."""
        try:
            return self.spark.read.parquet(f"{self.state}/done").agg(F.max("n")).collect()[0][0] or 0
        except Exception as e:  # noqa: BLE001 - Spark's error for a missing path
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def step(self, build: Callable[[DataFrame, int], None]) -> bool:
        """List the folder, and build from what changed since the last listing. The listing counts once the build has ended,
        so a build that fails sees the same changes again. Files are compared by time and size in a join."""
        n = self.last()
        now = checkpoint(listing(self.spark, self.root))
        old = self.spark.read.parquet(f"{self.state}/v{n}") if n else now.limit(0)
        diff = checkpoint(snapshot_diff(now, old).where("status <> 'unchanged'").join(now, "path", "left").select("path", "mtime", "size", "status"))
        if diff.isEmpty():
            return False
        shown = diff if self.relevant is None else diff.where(self.relevant)
        if not shown.isEmpty():
            build(shown, n + 1)
        now.write.mode("overwrite").parquet(f"{self.state}/v{n + 1}")
        self.spark.createDataFrame([(n + 1,)], "n bigint").coalesce(1).write.mode("append").parquet(f"{self.state}/done")
        return True


def watch(spark: SparkSession, root: str, state: str, relevant: Column | None = None) -> Watch:
    """The changes (path, mtime, size, status) of the files below a folder for which `relevant` holds: added, updated and
    removed ones, which Spark's own file source does not report."""
    return Watch(spark, root, state, relevant)


def build_on_change(changes: Watch, build: Callable[[DataFrame, int], None], checkpoint_dir: str, seconds: float = 2.0, once: bool = False) -> StreamingQuery:
    """Run `build(changed rows, snapshot number)` whenever something has changed, one at a time; changes within the interval
    come together. The stream is a clock; what was seen stands in the watch's own tables. once: for one look only."""
    clock = changes.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    w = clock.writeStream.foreachBatch(lambda _, n: changes.step(build) and None).option("checkpointLocation", checkpoint_dir)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{seconds} seconds")).start()


def burst_stream(events: DataFrame, ts: str, gap: str, late: str, by: list[str] = []) -> DataFrame:
    """Bursts of a stream of events with at most that gap between neighbours: (by..., burst_start, burst_end, events)."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = e.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.max(ts).alias("burst_end"), F.count("*").alias("events"))
    return g.select(*by, F.col("w.start").alias("burst_start"), "burst_end", "events")
