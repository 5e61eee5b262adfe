"""Settings of the session that hold for one step."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is queried or written meanwhile go when that has ended, not when the driver happens to collect its garbage, which with much memory it may never do."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, True)
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)
