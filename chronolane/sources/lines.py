"""JSON lines with declared schemas, hashed ledgers, JDBC tables and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines by a declared schema; lines that do not fit keep their text in _corrupt."""
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return spark.read.schema(T.StructType([*declared.fields, T.StructField("_corrupt", T.StringType())])).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def ledger(spark: SparkSession, path: str, schema: str, hashed: str = "body", stated: str = "body_hash") -> DataFrame:
    """Ledger lines with sound: whether the stated hash is that of the body."""
    return read_lines(spark, path, schema).withColumn("sound", F.coalesce(F.col(stated) == F.concat(F.lit("sha256:"), F.sha2(hashed, 256)), F.lit(False)))


def read_table(spark: SparkSession, url: str, name: str, partition: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table over JDBC, in `parts` ranges of a numeric column if one is given. Needs the driver's jar on the cluster."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition and bounds:
        reader = reader.options(partitionColumn=partition, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def catalog_columns(spark: SparkSession, database: str = "default") -> DataFrame:
    """(table, column, type, nullable) of a database's tables and views."""
    rows = [(t.name, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean")
