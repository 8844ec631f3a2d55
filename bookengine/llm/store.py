"""Durable intermediate tables in the folder that the driver and all executors share.

The folder is ``spark.checkpoint.dir``. Where that setting is absent a temporary folder is made if Spark runs on one
machine (local master), as in tests; on a cluster it is an error. Tables are Parquet, so a lost executor costs no
recomputation of what stands before them, and later readers prune columns.

Operators work inside ``scratch``, which deletes the tables that their result does not read. Results read the others
lazily; once they are written elsewhere, ``discard_all`` removes the tables of a session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition of a table whose size is bounded.
ROWS_A_FILE = 10_000
_own_folder: str | None = None
#: Paths of the tables that each application has written and not discarded.
_written: dict[str, set[str]] = {}
#: Where the readers that ``spill`` has returned read from.
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="bookengine-")
    return f"file://{_own_folder}"


def materialize(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` once and return a reader of what was written. See ``spill``."""
    return spill(df, name, most_rows)[0]


def spill(df: DataFrame, name: str, most_rows: int | None = None) -> tuple[DataFrame, str]:
    """The reader of a written table, and its path.

    ``most_rows`` is an upper bound of its rows, where one is known: the table then has a partition for each ROWS_A_FILE
    of them at most, so that bookkeeping tables are not hundreds of tiny files, and grow in files as they grow in rows.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // ROWS_A_FILE)))
    path = f"{shared_folder(spark)}/bookengine/{uuid.uuid4().hex}/{name}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out, path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Deletes at its end, or on an error, the tables that were written inside it, but for those given to the function that it yields."""
    written = _written.setdefault(spark.sparkContext.applicationId, set())
    before, kept = set(written), set()
    try:
        yield lambda *tables: kept.update(_path_of[t] for t in tables)
    except BaseException:
        # a failed run has no result that reads them
        kept.clear()
        raise
    finally:
        for path in sorted(written - before - kept):
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that no live DataFrame reads any more."""
    _written.get(spark.sparkContext.applicationId, set()).discard(path)
    # the folder that the table has to itself
    path = path.rpartition("/")[0]
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard_all(spark: SparkSession) -> None:
    """Delete every table that this application has written, when all results have been written elsewhere."""
    for path in sorted(_written.get(spark.sparkContext.applicationId, set())):
        discard(spark, path)
