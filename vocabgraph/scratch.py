"""Tables written to the shared checkpoint folder, to cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master without the setting gets a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _FALLBACK:
        _FALLBACK[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="vocabgraph-")
    return _FALLBACK[context.applicationId]


class Scratch:
    """Hands out written copies of frames. ``drop`` removes tables no longer read; the rest goes when Python ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:04d}-{name}"

    def cut(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` once as Parquet and return a frame that reads it: later failures recompute from the files."""
        path = self.path(name)
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def measured(self, df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
        """``cut``, and aggregates over the rows, which come with the write."""
        seen = Observation()
        out = self.cut(df.observe(seen, *[m.alias(k) for k, m in measures.items()]), name)
        return out, seen.get

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        out, seen = self.measured(df, name, n=F.count(F.lit(1)))
        return out, seen["n"]

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = getattr(frame, "_scratch_path", None)
            if path:
                self._delete(path)

    def close(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the session may be gone
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        if jvm is None:
            return
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
