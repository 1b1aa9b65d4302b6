"""The catalog file: XML with one element a title, in document order."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTRY = "array<struct<Title:string,Notes:string,ReleaseYear:string,ApplicationPath:string>>"
_COLUMNS = "pos long, title string, notes string, year string, application_path string"


def read_catalog(spark: SparkSession, path: str, root: str = "Catalog", element: str = "Game") -> DataFrame:
    """``pos, title, notes, year, application_path``; a file that can't be read as XML gives no entry."""
    schema = T.StructType([T.StructField(element, T._parse_datatype_string(_ENTRY))])
    try:
        df = spark.read.format("xml").option("rowTag", root).option("mode", "DROPMALFORMED").schema(schema).load(path)
        rows = df.select(F.posexplode(element).alias("pos", "e")).select(
            F.col("pos").cast("long"), F.col("e.Title").alias("title"), F.col("e.Notes").alias("notes"),
            F.col("e.ReleaseYear").alias("year"), F.col("e.ApplicationPath").alias("application_path"))
        rows.limit(1).count()
        return rows
    except PySparkException:
        return spark.createDataFrame([], _COLUMNS)
