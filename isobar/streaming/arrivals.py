"""Reductions over steps that arrive in files: each call takes what is new, and goes on from where the last one stopped.

Partial sums of open intervals are the stream's state, kept with the checkpoint and dropped once the watermark has
passed; so a call reads new files only. A batch leaves the intervals it changed in a folder named by its number, which a
repeated batch overwrites, and the newest row of an interval is the one that holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isobar.streaming.reductions import windowed_reduction


def reduce_arrivals(spark: SparkSession, landing: str, schema: StructType, out: str, checkpoint: str, time: str, width: str, variables: list[str], operator: str, by: list[str] | None = None, late: str = "1 day") -> None:
    """Folds the Parquet files that came to `landing` since the last call into the interval reductions under `out`.

    Rows that are later than all that an earlier call saw by more than `late` are left out, as in any stream with a watermark.
    """

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    arriving = spark.readStream.schema(schema).parquet(landing)
    reduced = windowed_reduction(arriving, time, width, variables, operator, by, late)
    run = reduced.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def reduced_so_far(spark: SparkSession, out: str, by: list[str] | None = None) -> DataFrame:
    """The newest row of each interval (and group)."""
    held = spark.read.parquet(out)
    keys = ["start", "end", *(by or [])]
    values = [c for c in held.columns if c not in (*keys, "batch")]
    newest = held.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("newest"))
    return newest.select(*keys, *(F.col(f"newest.{v}").alias(v) for v in values))
