"""Session defaults shared by the tests, the bench and ad-hoc use."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(app: str = "stridelake", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the queries assume (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a context, so that they need no installation of it.

    Arrow batches hold 4 MB then, unless the session has another limit than Spark's own of 64 MB:
    rows here are whole texts, and a worker holds a batch more than once.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_BYTES).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    if getattr(context, "_stridelake_shipped", False):
        return spark
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="stridelake-ship-")) / "stridelake.zip"
    with zipfile.ZipFile(at, "w") as out:
        for p in sorted(here.rglob("*.py")):
            out.write(p, p.relative_to(here.parent))
    context.addPyFile(str(at))
    context._stridelake_shipped = True
    return spark


@contextmanager
def shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside send no side through the driver, but for those with a hint; the session's own limits hold again afterwards.

    A limit doesn't help where tables come from files: it is held against their size there, and 8 MB of
    strings in Parquet can be 280 MB of rows.
    """
    limits = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in limits}
    for k in limits:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
