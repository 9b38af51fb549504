"""CSV at the edges, read and written the way pandas does.

Spark's CSV defaults differ from pandas': the escape character is a
backslash (pandas doubles the quote), the writer trims padding and writes
``""`` for empty strings, and only one null marker is recognised. The
options below make a round trip keep every text unchanged except that an
empty string comes back missing, as after ``to_csv`` + ``read_csv``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from moodline.session import scratch_path
from moodline.sources.csv_ranges import read_records

# The markers pandas.read_csv treats as missing by default.
PANDAS_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

READ_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
                "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
                "mode": "FAILFAST"}
WRITE_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "",
                 "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
                 "quoteAll": "false"}


def read_posts_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
                   line_breaks: bool = True, stray_quotes: bool = False) -> DataFrame:
    """All columns as strings (no inference pass over the data); pandas'
    missing markers become null. Files are split over tasks. With
    ``line_breaks`` a quoted field may hold line breaks; the quotes before a
    byte range then tell where its first record starts (two passes). Files
    with ``stray_quotes`` (an unquoted field with a quote in it) and line breaks
    can only be read one task a file."""
    options = READ_OPTIONS | {"multiLine": str(line_breaks).lower()}
    if columns is None:
        columns = spark.read.options(**options).csv(path).columns
    schema = Ty.StructType([Ty.StructField(c, Ty.StringType()) for c in columns])
    if line_breaks and not stray_quotes:
        ddl = ", ".join("`{}` string".format(c.replace("`", "``")) for c in columns)
        fields = {k: v for k, v in options.items() if k != "header"}
        df = read_records(spark, path).select(F.from_csv("record", ddl, fields).alias("r")).select(
            *[F.col("r").getField(c).alias(c) for c in columns])
    else:
        df = spark.read.options(**options).schema(schema).csv(path)
    return df.select(*[F.when(F.col(f"`{c}`").isin(PANDAS_NA_VALUES), F.lit(None).cast("string"))
                       .otherwise(F.col(f"`{c}`")).alias(c) for c in columns])


def write_posts_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").options(**WRITE_OPTIONS)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def roundtrip(df: DataFrame) -> DataFrame:
    """Write ``df`` as CSV under the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, "csv")
    write_posts_csv(df, path)
    return read_posts_csv(spark, path, df.columns)
