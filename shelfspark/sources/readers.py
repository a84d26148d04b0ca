"""Reading the retail catalog from CSV or Parquet, and artifacts from the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from shelfspark.sources.schemas import SCHEMAS, struct


#: Holds the whole line where a cell can't be read as its column's type, or the line has too few or too many cells.
REJECTED = "_rejected"


def scan_csv(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """All lines of a CSV file under the table's declared schema, in one scan, with REJECTED. The header must be the declared
    columns in their order, or `columns` where a file has others: those that the schema knows have its types, the rest are
    strings. Another header is an error when the file is read; a missing file is one at once."""
    declared = {f.name: f.dataType for f in struct(name)}
    schema = T.StructType([T.StructField(c, declared.get(c, T.StringType())) for c in columns or declared])
    cells = schema.fieldNames()
    reader = spark.read.schema(schema.add(REJECTED, T.StringType())).options(header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED)
    try:
        # True of every line, but it reads all columns: a line is judged by all its cells, whatever a query asks for.
        return clean(reader.csv(path).filter(F.pmod(F.hash(*cells), F.lit(2)) < 2))
    except AnalysisException as e:
        raise FileNotFoundError(f"CSV introuvable: {path}") from e


def read_csv(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """The lines of `scan_csv` that could be read; NaN becomes null."""
    return scan_csv(spark, path, name, columns).filter(F.col(REJECTED).isNull()).drop(REJECTED)


def rejected_rows(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """The lines that could not be read: `line`, and what could be read of its columns."""
    rows = scan_csv(spark, path, name, columns).filter(F.col(REJECTED).isNotNull())
    return rows.select(F.col(REJECTED).alias("line"), F.struct(*[c for c in rows.columns if c != REJECTED]).alias("cells"))


def clean(df: DataFrame) -> DataFrame:
    """NaN to null in floating columns."""
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(kind)).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes])


def catalog(spark: SparkSession, folder: str, kind: str = "csv", register: bool = False) -> dict[str, DataFrame]:
    """The five tables by name; as temporary views as well if asked for."""
    read = (lambda n: read_csv(spark, f"{folder}/{n}.csv", n)) if kind == "csv" else (lambda n: clean(spark.read.parquet(f"{folder}/{n}.parquet")))
    tables = {n: read(n) for n in SCHEMAS}
    if register:
        for n, df in tables.items():
            df.createOrReplaceTempView(n)
    return tables
