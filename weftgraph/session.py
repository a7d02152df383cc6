"""Session factory, the shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def get_spark(app: str = "weftgraph", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A session with the settings the operators are tested under (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one is set only where the session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "weftgraph-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


class Scratch:
    """Tables of one job in the shared folder; what is not dropped earlier goes when the session's program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._quietly_drop_all)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _quietly_drop_all(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session may be gone
            pass

    def save(self, df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
        """Write ``df`` and read it back; ``counts`` are aggregates observed while writing."""
        seen = Observation() if counts else None
        if seen:
            df = df.observe(seen, *[c.alias(k) for k, c in counts.items()])
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), (seen.get if seen else {})

    def release(self) -> None:
        """Let go of the shuffle files of finished steps, which stay until the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")
