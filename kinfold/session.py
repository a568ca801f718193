"""Session helpers: builder defaults, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "kinfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword settings use '__' for '.'."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table `name` under the folder `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it.

    Only where the setting is absent on a local master (tests, a laptop) a temporary folder stands in.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.TemporaryDirectory(prefix="kinfold-")
    return "file://" + _LOCAL.name


_LOCAL: tempfile.TemporaryDirectory | None = None


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone at exit
        pass


class Scratch:
    """Tables written into the shared folder to cut lineage; `drop` removes what is no longer read.

    A written table survives the loss of any executor and is column-pruned when read again.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kinfold/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(_forget, spark, self.root)

    def write(self, frame: DataFrame, name: str = "part") -> DataFrame:
        path = f"{self.root}/{self._n:03d}-{name}"
        self._n += 1
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        kept._kinfold_path = path
        return kept

    def drop(self, frame: DataFrame) -> None:
        path = getattr(frame, "_kinfold_path", None)
        if path:
            _forget(self.spark, path)


def vocabulary_dir() -> str:
    """Default folder of public tokenizer files; a parameter wherever it is used."""
    return os.environ.get("KINFOLD_TOKENIZERS", "/opt/tokenizers")
