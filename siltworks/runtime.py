"""Session defaults, table access and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings every query here assumes (UTC, adaptive execution, Arrow)."""
    builder = (
        SparkSession.builder.master(master)
        .appName("siltworks")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names. Only a local master, whose tasks all see this machine, may do without."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    made = spark.conf.get("siltworks.shared.dir", None)
    if not made:
        made = "file://" + tempfile.mkdtemp(prefix="siltworks-")
        spark.conf.set("siltworks.shared.dir", made)
    return made


class Stage:
    """Intermediate tables of one run: written as Parquet in the shared folder, so that a lost executor costs
    a re-read and not a recomputation, and removed as soon as the run no longer needs them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n:04d}"
        self._n += 1
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._stage_path = path
        return kept

    def plain(self, df: DataFrame, *columns: str) -> DataFrame:
        """Some columns of a kept table, still droppable as that table."""
        out = df.select(*columns)
        out._stage_path = df._stage_path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = getattr(df, "_stage_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
