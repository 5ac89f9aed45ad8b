"""Container averages over a stream of curves, and windowed scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.container import bin_means, decade_bin

SCAN, CONTAINER = ("scan_id",), ("surface_id",)


def scan_sums(curves: DataFrame, x: str, y: str, scan: tuple[str, ...] = SCAN, container: tuple[str, ...] = CONTAINER, per_decade: int = 10) -> DataFrame:
    """(container, scan, bin, sx, sy, n): each scan's sums in its bins, of a stream or a table. A stream's state is one such row for each bin of each scan."""
    c = curves.where((F.col(x) > 0) & F.col(y).isNotNull()).withColumn("bin", decade_bin(F.col(x), per_decade))
    return c.groupBy(*container, *scan, "bin").agg(F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.count("*").alias("n"))


def write_sums(curves: DataFrame, x: str, y: str, path: str, checkpoint: str, scan: tuple[str, ...] = SCAN, container: tuple[str, ...] = CONTAINER, per_decade: int = 10, **trigger) -> StreamingQuery:
    """Starts a query that writes to path the sums that each micro-batch has changed; a batch that is run again replaces what it wrote."""

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    sums = scan_sums(curves, x, y, scan, container, per_decade)
    return sums.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_averages(spark: SparkSession, path: str, scan: tuple[str, ...] = SCAN, container: tuple[str, ...] = CONTAINER) -> DataFrame:
    """container.log_average of all that write_sums() has written so far: means over scans of their means, whichever batches a scan came in."""
    last = spark.read.parquet(path).groupBy(*container, *scan, "bin").agg(F.max_by(F.struct("sx", "sy", "n"), "batch").alias("s"))
    each = last.select(*container, *scan, "bin", (F.col("s.sx") / F.col("s.n")).alias("x"), (F.col("s.sy") / F.col("s.n")).alias("y"))
    return bin_means(each, container)


def windowed_scans(events: DataFrame, time: str = "ts", value: str = "value", key: str = "user_id", length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(key, window, n, mean, rq): line scans of one time window each, kept open for late points."""
    w = events.withWatermark(time, late).groupBy(key, F.window(time, length))
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("rq"))
