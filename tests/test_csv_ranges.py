"""CSV with line breaks in byte ranges equals the one-task reader."""

import csv
import random
import uuid
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from moodline.sources import csv_io, csv_ranges

SPLIT = "spark.sql.files.maxPartitionBytes"
COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in (SPLIT, COST)}

    def ranges(size):
        spark.conf.set(SPLIT, str(size))
        spark.conf.set(COST, "1")
    yield ranges
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n", names=("id", "text", "a b")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(names)
        out.writerows(rows)


def random_rows(n, seed, long=0):
    rng = random.Random(seed)
    parts = ["word", " ", '"', '""', "\n", "\n\n", ",", "é漢😀", "NA", "", "'", "\\", "x" * long, "\t", '",\n"']
    return [(i, "".join(rng.choices(parts, k=rng.randrange(9))), rng.choice(["", "b", 'q"', "l\nm"])) for i in range(n)]


def values(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [7, 64, 1000, 100_000])
def test_every_cut_gives_the_same_rows(spark, tmp_path, small_ranges, end, size):
    path = f"{tmp_path}/{uuid.uuid4().hex}.csv"
    rows = random_rows(40 if size == 7 else 400, size)
    write(path, rows, end)
    one = csv_io.read_posts_csv(spark, path, stray_quotes=True)
    want = values(one)
    small_ranges(size)
    got = csv_io.read_posts_csv(spark, path)
    assert got.columns == ["id", "text", "a b"] and values(got) == want and sum(want.values()) == len(rows)
    frame = pd.read_csv(path, dtype=str)
    assert want == Counter(tuple(None if pd.isna(x) else x for x in r) for r in frame.itertuples(index=False))


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    path = str(tmp_path / "long.csv")
    long = "line\n" * 3000
    write(path, [(1, "a", "b"), (2, long, "c"), (3, "d\ne", "f"), (4, '"' + long + '"', "")])
    small_ranges(100)
    got = csv_io.read_posts_csv(spark, path)
    assert values(got) == Counter([("1", "a", "b"), ("2", long, "c"), ("3", "d\ne", "f"), ("4", '"' + long + '"', None)])


def test_several_files_and_their_headers(spark, tmp_path, small_ranges):
    for i in range(5):
        write(tmp_path / f"{i}.csv", random_rows(50 * i, i))
    want = values(csv_io.read_posts_csv(spark, str(tmp_path), stray_quotes=True))
    for size in (50, 500, 1_000_000):
        small_ranges(size)
        assert values(csv_io.read_posts_csv(spark, str(tmp_path))) == want


def test_empty_files_last_line_and_empty_lines(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('id,text\n1,"x\ny"', newline="")
    (tmp_path / "b.csv").write_text("id,text\n", newline="")
    (tmp_path / "c.csv").write_text('id,text\r\n\r\n2,"é\r\n"\r\n\r\n', newline="")
    small_ranges(4)
    got = csv_io.read_posts_csv(spark, str(tmp_path), ["id", "text"])
    assert values(got) == Counter([("1", "x\ny"), ("2", "é\r\n")])


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    path = str(tmp_path / "large.csv")
    row = 'some words and, a comma\nand a "quoted" line break '
    write(path, ((i, row * 8, "x") for i in range(150_000)))  # about 60 MB
    small_ranges(4 << 20)
    df = csv_io.read_posts_csv(spark, path)
    lines = csv_ranges.read_lines(spark, path)
    assert lines.rdd.getNumPartitions() >= 12
    tasks = df.select(F.spark_partition_id().alias("p"), "id", F.length("text").alias("n")).agg(
        F.countDistinct("p"), F.countDistinct("id"), F.min("n"), F.max("n"), F.count("id")).first()
    assert tasks[0] >= 12 and tuple(tasks)[1:] == (150_000, len(row) * 8, len(row) * 8, 150_000)
    assert csv_io.read_posts_csv(spark, path, stray_quotes=True).rdd.getNumPartitions() == 1


def test_what_is_malformed_stops_the_job(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,text\n1,a,b,c\n", newline="")
    with pytest.raises(Exception):
        csv_io.read_posts_csv(spark, str(tmp_path / "bad.csv")).collect()
