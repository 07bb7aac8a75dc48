"""Session helpers: UTC pinning, shared scratch folder, code for Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

UTC = "UTC"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "milepost") -> SparkSession:
    """Session used by tests and the benchmark. A cluster job passes its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", UTC)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Every report function works on UTC days and prints CET text explicitly.

    The session zone decides what ``to_date``/``date_format`` mean, so it is
    pinned once here instead of sprinkling zone arguments everywhere.
    """
    if spark.conf.get("spark.sql.session.timeZone", None) != UTC:
        spark.conf.set("spark.sql.session.timeZone", UTC)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    It is read from the session; only when it is unset (local tests) a
    private folder is created and registered, so lineage cuts and stream
    checkpoints never land on a machine-local path on a real cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="milepost-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared folder for one run."""
    base = shared_dir(spark)
    path = f"{base}/milepost/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file:", ""), exist_ok=True)
    return path


#: Rows that are worth a file of their own, in narrow tables.
FILE_ROWS = 1 << 16


def few_files(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """``df`` in no more partitions than ``rows`` rows (an upper bound of what it
    holds) fill with ``each``, and one for each core at least.

    Many partitions of few rows make a file each, and on a local or mounted path
    Hadoop starts a process (``chmod``) for every file and its checksum.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


_SHIPPED: set[str] = set()
#: Most megabytes of an Arrow batch on its way to Python; a row stays whole.
BATCH_MB = 8
#: Most rows of a Parquet reader's batch.
READER_ROWS = 256


def _megabytes(size: str) -> float:
    """A size in Spark's notation ('64m', '67108864b'); without a unit, bytes."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)[a-z]*", size.strip().lower()).groups()
    return float("inf") if int(number) <= 0 else int(number) * {"": 1, "b": 1, "k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}[unit] / 2**20


def ship_package(spark: SparkSession) -> None:
    """Make ``milepost`` importable in Python workers (what ``--py-files``
    does): zip the package once per Spark application and ``addPyFile`` it; and
    bound the batches of readers and Arrow, as these stages read whole texts.

    Every function that builds a Python stage (Arrow maps and groups of the
    training-data operators, the log reader) calls it, so a job needs nothing but
    the package on the driver. The zip is placed in the shared folder when that is
    a local or mounted path, otherwise in a driver-side file that Spark's file
    server distributes.
    """
    import zipfile

    import milepost

    # Arrow buffers are outside the heap, one or two for each running task; a
    # reader's batch holds whole texts on the heap, in arrays that double.
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _megabytes(spark.conf.get(size)) > BATCH_MB:
        spark.conf.set(size, f"{BATCH_MB}m")
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(rows)) > READER_ROWS:
        spark.conf.set(rows, str(READER_ROWS))
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(milepost.__file__))
    base = shared_dir(spark)
    folder = base[len("file:"):] if base.startswith("file:") else base
    if "://" in folder:
        folder = tempfile.mkdtemp(prefix="milepost-code-")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"milepost-{uuid.uuid4().hex[:12]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith((".py", ".sql")):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(key)
