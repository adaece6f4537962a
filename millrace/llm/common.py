"""Shared plumbing of the corpus operators: tables, written cuts of lineage, word rules.

``materialize`` is the only way these operators cut lineage.  It writes a Parquet table below the
folder that the session names in ``spark.checkpoint.dir`` and reads it back, so a lost executor never
loses an intermediate result and the next plan starts from real file sizes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space; ``bytes.split()`` follows the same rule.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch that is sent to a worker (or one row), unless the session sets its own limit.  Spark's default of
#: 64 MB is held by the JVM, by its buffers and by the worker at once, for each task.
BATCH_BYTES = 1 << 22
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark needs to be able to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written cuts: ``spark.checkpoint.dir``, or in local mode, where it is unset, an own one.

    On a cluster a folder of this machine would be another one on each executor, so there it has to be set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _own_dirs[app]


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``mapInArrow`` by batches of ``BATCH_BYTES``; this sets the session's limit if it has none."""
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at interpreter exit; the folder is then left to its owner
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it; removed at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote, when nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/millrace-" in path:
            _remove(df.sparkSession, path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can never clash with ours."""
    return df.select(*[df[n] for n in names])


def refuse_clash(keep: tuple[str, ...], own: tuple[str, ...]) -> None:
    """Columns to keep may not have the name of a result."""
    if clash := sorted({c.lower() for c in keep} & {c.lower() for c in own}):
        raise ValueError(f"columns to keep have names of results: {', '.join(clash)}")
