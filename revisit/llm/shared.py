"""Tables and folders in the shared folder that the session names.

Cut lineage by writing a table below ``spark.checkpoint.dir`` and reading it
back: every executor and the driver see that folder, and a lost executor loses
nothing that was written there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session without the
    setting (tests) gets a folder of its own; a cluster without it is an error."""
    path = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="revisit-llm-")
    spark.conf.set(_KEY, path)
    return path


_MADE: list[str] = []  # folders that this process has named and not given back


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def give_back(spark: SparkSession, since: int, kept: DataFrame | None = None) -> None:
    """Delete the folders named after the first ``since`` ones, but for those that
    ``kept`` reads. For callers that have written a result which needs them no more."""
    used = [] if kept is None else [f.rsplit("/", 1)[0] for f in kept.inputFiles()]
    for path in _MADE[since:]:
        if not any(u.endswith(path.split(":", 1)[-1]) for u in used):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _MADE.remove(path)


def named() -> int:
    """How many folders are named so far (for ``give_back``)."""
    return len(_MADE)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(kept: DataFrame) -> None:
    """Delete the table that ``keep`` wrote, once nothing reads it any more."""
    spark = kept.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in kept.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _MADE[:] = [path for path in _MADE if not folder.endswith(path.split(":", 1)[-1])]


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, the knob a user sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``, also
    inside other lambdas (which would evaluate an inlined expression per element)."""
    return F.transform(F.array(value), body)[0]
