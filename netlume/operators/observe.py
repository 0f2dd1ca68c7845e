"""Observations of several producers as one table, in one total order."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def union(*producers: DataFrame) -> DataFrame:
    """All rows; a column that a producer lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), producers)


def placed(rows: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Adds each row's number, from 1, in a total order that begins with a number (a second).

    Rows are dealt by ranges of that number, whose bounds are settled first, and numbered within; only each range's count
    is gathered, so no task and no window holds all rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile(order[0], [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []

    def range_of(column: pa.Array) -> pa.Array:
        values = column.cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(bounds, values, "right").astype(np.int32))

    dealt = rows.withColumn("_range", F.arrow_udf(range_of, "int")(F.col(order[0])))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row a range
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_number", number).join(starts, "_range").withColumn(name, (F.col("_start") + F.col("_number")).cast("bigint")).drop("_range", "_number", "_start")
