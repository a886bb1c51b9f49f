"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampstat.session import materialize

#: Bytes (as JSON text, which is never less than the row) up to which a side is broadcast.
MAX_BROADCAST_BYTES = 64 << 20
#: A side of at most so many rows is fetched by the check itself and needs no table.
MAX_LOCAL_ROWS = 10_000


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_BYTES, local_rows: int = MAX_LOCAL_ROWS) -> DataFrame:
    """Mark a side for broadcast when it is measured to be small; else the planner joins
    it by shuffle, and AQE splits skewed partitions. The result is the same either way.

    A side of few rows (one per run or stage) is computed once, by the check: at most
    ``local_rows`` + 1 rows are fetched, and used as they are when they are all and within
    ``limit`` bytes. A larger one is written once, as it is computed once for
    the check and the join, and broadcast when its measured bytes are within ``limit``."""
    head = df.limit(local_rows + 1).toArrow()
    if head.num_rows <= local_rows:
        side = df.sparkSession.createDataFrame(head, df.schema)
        return F.broadcast(side) if head.nbytes <= limit else side
    del head
    side = materialize(df, "side")
    size = side.select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.sum("b")).first()[0] or 0
    return F.broadcast(side) if size <= limit else side
