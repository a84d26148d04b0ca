"""Shared helpers: scratch tables, crc32 folds, word splitting."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the text contracts define it.
SPACES = " \t\n\x0b\x0c\r"
#: The words of a text are the maximal runs of other characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of texts that Spark hands to Python at once; the setting's default of 10,000 is meant for numbers.
ARROW_ROWS = 1000

_tables: list[tuple[SparkSession, str]] = []
_written: list[tuple[SparkSession, str]] = []


def small_batches(df: DataFrame) -> DataFrame:
    """`df`; its session hands at most ARROW_ROWS rows at once to Python from here on, so that workers stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= ARROW_ROWS:
        df.sparkSession.conf.set(name, ARROW_ROWS)
    return df


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="shelfspark-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` as Parquet to the shared scratch folder and read it back: later stages start from files that survive lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/t-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write `df` to the shared warehouse in buckets of `key`: later groupings by it read the buckets without a shuffle."""
    spark = df.sparkSession
    name = f"shelfspark_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(name)
    _tables.append((spark, name))
    return spark.table(name)


def written(make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` returns, written to the scratch folder; the scratch tables that it was made from are deleted."""
    tables, files = len(_tables), len(_written)
    out = materialise(make())
    own = _written.pop()
    while len(_tables) > tables:
        spark, name = _tables.pop()
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    while len(_written) > files:
        _delete(*_written.pop())
    _written.append(own)
    return out


def release(df: DataFrame) -> None:
    """Delete the scratch files behind a materialised frame that nothing reads any more."""
    names = {f.split("/t-")[-1].split("/")[0] for f in df.inputFiles() if "/t-" in f}
    for item in [x for x in _written if x[1].split("/t-")[-1] in names]:
        _delete(*item)
        _written.remove(item)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, name in _tables:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    for spark, path in _written:
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue
        _delete(spark, path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo `parts`; a null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def parallelism(spark: SparkSession) -> int:
    """Number of keys that packed exchanges are dealt over: follows the session's shuffle partitions, which are sized to the data."""
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
