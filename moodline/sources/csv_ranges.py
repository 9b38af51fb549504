"""Records of CSV files whose quoted fields may hold line breaks, read in
parallel byte ranges (S1).

Spark's text source deals a file over tasks in byte ranges and gives each line
to the range it starts in. Whether a range starts inside a quoted field follows
from the number of quotes before it, modulo 2: a partial aggregate counts each
range's quotes, a running sum over the small table of ranges combines them
(quotes inside a field are doubled and cancel out). A task then cuts its lines
into records, in order. Only the record that crosses the end of a range is put
together from its fragments, at most two for each range.

Fields follow RFC 4180, as pandas and Spark write them: a field with a quote
is quoted. A stray quote inside an unquoted field would shift all records
behind it; such files need the one-task reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges are few (one for each spark.sql.files.maxPartitionBytes): a range is
#: one row of the broadcast table.
RANGE = ["file", "block"]
SCHEMA = "file string, block long, first boolean, piece string, open boolean, close boolean"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the byte range), line: in order inside a range."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.col("value").alias("line"))


def range_starts(lines: DataFrame) -> DataFrame:
    """file, block, inside: whether the range starts inside a quoted field."""
    quotes = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))).cast("long")
    counts = lines.groupBy(*RANGE).agg(F.sum(quotes).alias("n"))
    w = Window.partitionBy("file").orderBy("block")
    return counts.select(*RANGE, ((F.sum("n").over(w) - F.col("n")) % 2 == 1).alias("inside"))


class _Cutter:
    """Puts the lines of one range together; pieces are (first record of the
    file, text, began before the range, unfinished at its end)."""

    def __init__(self, block: int, inside: bool) -> None:
        self.block, self.inside = block, inside
        self.before, self.first = inside, block == 0
        self.lines: list[str] = []

    def add(self, line: str, odd: bool) -> tuple | None:
        self.lines.append(line)
        if odd:
            self.inside = not self.inside
        return None if self.inside else self._piece(False)

    def _piece(self, unfinished: bool) -> tuple:
        out = (self.first, "\n".join(self.lines), self.before, unfinished)
        self.lines, self.before, self.first = [], False, False
        return out

    def rest(self) -> tuple | None:
        return self._piece(True) if self.lines else None


def cut_records(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """SCHEMA rows: whole records (neither open nor close), and fragments of
    records that began before the range (close) or go on behind it (open)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, now = None, None
        for batch in batches:
            rows: list[tuple] = []
            odd = pc.count_substring(batch.column(2), '"').to_pylist()
            for file, block, line, inside, n in zip(*(batch.column(i).to_pylist() for i in range(4)), odd, strict=True):
                if (file, block) != now:
                    if cutter is not None and (piece := cutter.rest()):
                        rows.append((*now, *piece))
                    cutter, now = _Cutter(block, inside), (file, block)
                if piece := cutter.add(line, n % 2 == 1):
                    rows.append((*now, *piece))
            yield _batch(rows)
        if cutter is not None and (piece := cutter.rest()):
            yield _batch([(*now, *piece)])

    # the ranges are the table's few rows: a broadcast join keeps the order
    return lines.join(F.broadcast(starts), RANGE).select("file", "block", "line", "inside").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    file, block, first, piece, before, unfinished = zip(*rows, strict=True) if rows else [()] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(file, pa.string()), pa.array(block, pa.int64()), pa.array(first, pa.bool_()), pa.array(piece, pa.string()),
         pa.array(unfinished, pa.bool_()), pa.array(before, pa.bool_())],
        ["file", "block", "first", "piece", "open", "close"])


def read_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``record``: the text of every record that is not empty, without its line
    end; with ``header`` the first record of each file is left out."""
    from moodline.operators.joins import materialize
    lines = read_lines(spark, path)
    # the lines are read once more to be cut; the table of ranges is written
    pieces = cut_records(lines, materialize(range_starts(lines)))
    whole = pieces.filter(~F.col("open") & ~F.col("close")).select("first", F.col("piece").alias("record"))
    # a record's fragments: from the range in which it began to the one that ends it
    parts = pieces.filter(F.col("open") | F.col("close"))
    w = Window.partitionBy("file").orderBy("block", F.col("open").cast("int"))
    chain = F.last(F.when(~F.col("close"), F.col("block")), ignorenulls=True).over(w)
    joined = parts.withColumn("chain", chain).groupBy("file", "chain").agg(
        F.max("first").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.col("open").cast("int").alias("o"), "piece"))),
                                 lambda p: p["piece"]), "\n").alias("record"))
    records = whole.unionByName(joined.select("first", "record"))
    if header:
        records = records.filter(~F.col("first"))
    record = F.when(F.col("record").endswith("\r"), F.expr("substring(record, 1, char_length(record) - 1)")).otherwise(F.col("record"))
    return records.select(record.alias("record")).filter(F.col("record") != "")
