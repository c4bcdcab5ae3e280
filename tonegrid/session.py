"""Session settings and the shared scratch folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

POS, NEG = "pos", "neg"

# Spark only trims per-group top-n before the shuffle up to this n; the corpus-level
# bigram selection asks for 5000.
GROUP_LIMIT = 5000


def build_session(app: str = "tonegrid", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """The two settings the operators rely on; everything else is left to the submitter."""
    raise_group_limit(spark, GROUP_LIMIT)
    # A union of equally partitioned inputs claims their partitioning, which adaptive execution can
    # change afterwards on one side: on 4.1.2 this failed on unequal partition counts and probably split groups.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def raise_group_limit(spark: SparkSession, n: int) -> None:
    """Let Spark trim the best ``n`` of each group before the shuffle, whatever ``n`` the caller asks for."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(key)) < n:
        spark.conf.set(key, str(n))


def bounded_batches(spark: SparkSession, rows: int = 1024, mb: int = 2) -> None:
    """Bound what one Arrow batch holds in a Python worker, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def released() -> None:
    """Give back what a Python worker has freed: workers live from task to task, and allocators keep their memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, columns matched by name, under the settings above."""
    tune(parts[0].sparkSession)
    return reduce(DataFrame.unionByName, parts)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="tonegrid-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch path with all below it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so that later stages survive executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
