"""The heaviest items without a count of all items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionrec.sources.events import staged

#: Counters of a task's summary, and the most items that are counted exactly.
COUNTERS, SURVIVORS = 8_192, 100_000
SUMMARY = pa.schema([("aid", pa.int32()), ("least", pa.float64()), ("error", pa.float64())])


def summaries(counters: int):
    """Rows (aid, weight) of a task to at most `counters` items with the least that they can weigh, and a row with how much more any item may weigh.

    When there are too many, all lose the weight of the heaviest that is let go (Misra and Gries, with weights), which is added to the error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aids, sums, error = np.empty(0, dtype=np.int64), np.empty(0), 0.0
        for batch in batches:
            more, weights = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            aids, at = np.unique(np.concatenate([aids, more]), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate([sums, weights]), minlength=len(aids))
            if len(aids) > counters:
                lost = np.partition(sums, len(sums) - counters - 1)[len(sums) - counters - 1]
                error += lost
                aids, sums = aids[sums > lost], sums[sums > lost] - lost
        yield pa.RecordBatch.from_arrays([pa.array([*aids.tolist(), None], pa.int32()), pa.array([*sums, None], pa.float64()), pa.array([*[None] * len(aids), error], pa.float64())], schema=SUMMARY)

    return run


def heavy_items(events: DataFrame, weight: Column, k: int, counters: int = COUNTERS, survivors: int = SURVIVORS) -> DataFrame:
    """aid, score, rank: the k items of the greatest summed weight (not negative), exactly, ties by item.

    Each task sends a summary of bounded size, and those are added up. They bound each item's weight from both sides, so
    items that can't be among the k are known; only the others are counted, exactly. Where the bound can't decide, since weights
    are too even for so few counters, or too many items are left, all items are counted. Null items don't count.
    """
    rows = events.select("aid", weight.cast("double").alias("w")).where("aid is not null")
    parts = staged(rows.mapInArrow(summaries(counters), "aid int, least double, error double"), "summaries")
    listed = staged(parts.where("aid is not null").groupBy("aid").agg(F.sum("least").alias("least")), "listed")
    error = parts.agg(F.coalesce(F.sum("error"), F.lit(0.0))).first()[0]
    best = [r.least for r in listed.orderBy(F.desc("least")).limit(k).collect()]  # k rows
    bound = best[-1] if len(best) == k else 0.0
    possible = listed.where(F.col("least") + error >= bound).select("aid")
    # An item in no summary weighs `error` at most.
    decided = (error < bound or error == 0) and possible.count() <= survivors
    if decided:
        rows = rows.join(F.broadcast(possible), "aid")  # `survivors` rows at most
    heaviest = rows.groupBy("aid").agg(F.sum("w").alias("score")).orderBy(F.desc("score"), "aid").limit(k)
    # k rows at most are ranked in one task.
    return heaviest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "aid")))
