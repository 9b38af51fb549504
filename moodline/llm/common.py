"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodline.operators.joins import materialize
from moodline.sources.tables import read_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The word separators of the contracts: space and \x09-\x0D, the very bytes
#: on which Python's bytes.split() splits.
WORD_SEPARATORS = "\\x20\\x09-\\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    return materialize(df)


def drop_written(df: DataFrame) -> None:
    """Delete the folder of a ``written`` table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/moodline/" in folder and "/tables/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; null counts as empty.
    ``lower`` does the same on pure ASCII text and is much faster there."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(F.octet_length(t) == F.char_length(t), F.lower(t))
            .otherwise(F.translate(t, UPPER, UPPER.lower())))


def row_hash(text: Column) -> Column:
    """Tells the rows of an id apart: a hash of the text, A-Z lower-cased."""
    return F.xxhash64(ascii_lower(text))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose id and text are named in ``kept``
    (doc_id, row_hash of the text); one row for each name. An id may be null;
    the columns of ``docs`` may have any names."""
    names = docs.columns
    keys = {"_row_id_": F.coalesce(F.col("doc_id"), F.lit(0).cast("long")), "_row_null_": F.col("doc_id").isNull()}
    keyed = docs.withColumns(keys | {"_row_hash_": row_hash(F.col("text"))})
    named = kept.withColumns(keys).select(*keys, F.col("row_hash").alias("_row_hash_"))
    on = [*keys, "_row_hash_"]
    return keyed.join(named, on, "left_semi").dropDuplicates(on).select(*names)


def map_rows(df: DataFrame, per_batch: Callable[[dict[str, list]], dict[str, list]],
             schema: str, rows: int = 512) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows: ``per_batch`` gets
    the columns of a slice as Python lists and returns columns of the output
    schema. Only one slice is decoded to Python objects at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    spark_schema = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(spark_schema)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                out = per_batch({n: piece.column(i).to_pylist() for i, n in enumerate(piece.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], f.type) for f in out_schema], schema=out_schema)

    return df.mapInArrow(run, spark_schema)
