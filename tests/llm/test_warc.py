"""WARC archives: round trips, copies, damage, awkward rows."""

import hashlib
import random
import struct
import uuid
from collections import Counter

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodline.llm import warc as W

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    largest = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and page_id is not None:
            largest[body] = max(largest.get(body, page_id), page_id)
    out = Counter()
    for page_id, _, html in rows:
        body = (html or "").encode()
        target = largest.get(body)
        revisit = target is not None and target != page_id
        out[(page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response",
             target if revisit else None)] += 1
    return out


def archived(spark, tmp_path, df, **kw):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    W.write_archives(df, path, **kw)
    return path


def result(spark, path):
    got = W.read_archives(spark, path)
    return Counter(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                "refers_to").collect())


def pages(n=300, seed=1):
    rng = random.Random(seed)
    words = ["<p>", "the", "page", "of", "<b>", "ünï", "漢字", "\r\n\r\n", "\n", "WARC/1.1"]
    rows = [(i, f"http://host{i % 7}.example/{i}", "<html>" + " ".join(rng.choices(words, k=rng.randrange(600))))
            for i in range(n)]
    copies = [(n + i, f"http://copy.example/{i}", rows[(i * i) % 40][2]) for i in range(n // 3)]
    return rows + copies


def test_every_page_comes_back(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    path = archived(spark, tmp_path, df)
    got = W.read_archives(spark, path, payload=True).collect()
    assert result(spark, path) == brute(rows) and any(r["record_type"] == "revisit" for r in got)
    html = {i: h for i, _, h in rows}
    for r in got:
        assert r["payload"] == (html[r["page_id"]].encode() if r["record_type"] == "response" else None)
        if r["record_type"] == "revisit":
            assert html[r["refers_to"]] == html[r["page_id"]]
        assert r["target_uri"].startswith("http://") and r["error"] is None


def test_archives_are_plain_zstandard_with_a_leading_dictionary(spark, tmp_path):
    rows = pages()
    path = archived(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).repartition(3), archive_bytes=20_000)
    files = spark.read.format("binaryFile").load(path).collect()
    assert len(files) > 3
    n = 0
    for f in files:
        assert struct.unpack("<I", f.content[:4])[0] == W.DICTIONARY_MAGIC
        dictionary, at = W.load_dictionary(memoryview(bytes(f.content)))
        reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(
            bytes(f.content[at:]), read_across_frames=True)
        whole = reader.read()
        n += whole.count(b"WARC-Record-ID: ")
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ") and whole.endswith(b"\r\n\r\n")
    assert n == len(rows) and result(spark, path) == brute(rows)


def test_a_record_is_read_by_its_offset(spark, tmp_path):
    rows = pages(60)
    path = archived(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).coalesce(1))
    content = bytes(spark.read.format("binaryFile").load(path).first().content)
    dictionary, _ = W.load_dictionary(memoryview(content))
    for r in W.read_archives(spark, path).collect()[::7]:
        end = W.frame_end(memoryview(content), r["offset"])
        data = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(content[r["offset"]:end])
        assert W.parse_record(data)["page_id"] == r["page_id"]


def test_awkward_rows(spark, tmp_path):
    big, other = "x" * 1000, "é" * 500
    rows = [(1, None, None), (2, "", ""), (None, "http://a", big), (3, "http://a\r\nEvil: 1", big), (4, "u", big),
            (4, "u", big), (4, "v", big), (5, "ü ö", "y" * 999), (6, "u", "y" * 999), (7, "u", other), (-8, "u", other),
            (None, "n", "z" * 2000), (None, "n", "z" * 2000), (9, "u", "\u0000 null"), (10, "u", "a" * 3_000_000 + big)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("x") for c in ("_key", "target", "shared", "payload", "archive", "offset", "error", "_n")})
    path = archived(spark, tmp_path, df.repartition(3))
    assert result(spark, path) == brute(rows)
    uris = {r["target_uri"] for r in W.read_archives(spark, path).collect()}
    assert "http://a%0D%0AEvil:%201" in uris and None in uris


def test_empty_and_tiny_tables(spark, tmp_path):
    path = archived(spark, tmp_path, spark.createDataFrame([], SCHEMA))
    assert result(spark, path) == Counter()
    path = archived(spark, tmp_path, spark.createDataFrame([(1, "u", "t")], SCHEMA))
    assert result(spark, path) == brute([(1, "u", "t")])


def test_hot_payload_and_shuffle_join(spark, tmp_path):
    rows = pages(90) + [(1000 + i, "u", "hot " * 400) for i in range(200)]
    spark.conf.set("moodline.broadcast.maxRows", "2")
    try:
        path = archived(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).repartition(4))
    finally:
        spark.conf.unset("moodline.broadcast.maxRows")
    assert result(spark, path) == brute(rows)


def archive(records, dictionary=None):
    w = W.ArchiveWriter(dictionary)
    for r in records:
        w.add(r)
    return w.close(b"\n") + b"\n"


def record(i=1, body=b"payload", **kw):
    return W.build_record(i, "http://u", body, None, False, **kw)


def changed(old, new):
    data = record()
    assert old in data
    return data.replace(old, new, 1)


@pytest.mark.parametrize("bad", [
    changed(b"WARC/1.1", b"WARC/9.1"), changed(b"WARC-Type", b"X-Type"), changed(b"WARC-Date: ", b"WARC-Date "),
    changed(b"payload\r\n\r\n", b"payload\r\n"), changed(b"payload\r\n\r\n", b"payloads\r\n\r\n"),
    changed(b"payload\r\n\r\n", b"paYload\r\n\r\n"), changed(b"sha1:", b"md5:"), changed(b"Length: 7", b"Length: 8"),
    changed(b"HTTP/1.1 200", b"FTP"), changed(b"<urn:page:1>", b"<urn:page:x>"), b"", b"WARC/1.1\r\n\r\n\r\n\r\n",
    changed(b"WARC-Date", b"WARC-Type"), record()[:-1], record() + b"\n"])
def test_invalid_records_are_found_and_the_next_is_read(spark, tmp_path, bad):
    with pytest.raises(ValueError):
        W.parse_record(bad)
    got = list(W.read_frames(archive([record(1), bad, record(3)])))
    assert len(got) == 3 and W.parse_record(got[2][1])["page_id"] == 3


def test_damaged_archives(spark, tmp_path):
    sound = archive([record(i, random.Random(i).randbytes(3000)) for i in range(5)])
    frames = [o for o, _ in W.read_frames(sound)]
    flipped = bytearray(sound)
    flipped[frames[2] + 1500] ^= 255
    texts = {"cut": sound[:frames[3] + 100], "flipped": bytes(flipped), "tail": sound + b"junk", "sound": sound,
             "dictionary": W.skippable(W.DICTIONARY_MAGIC, b"x" * 50)[:20], "empty": b""}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    got = W.read_archives(spark, str(tmp_path), strict=False).collect()
    found = {n: (sum(r["error"] is None for r in got if r["archive"].endswith(n)),
                 sum(r["error"] is not None for r in got if r["archive"].endswith(n))) for n in texts}
    assert found == {"cut": (3, 1), "flipped": (4, 1), "tail": (5, 1), "sound": (5, 0), "dictionary": (0, 1), "empty": (0, 0)}
    with pytest.raises(Exception, match="at byte"):
        W.read_archives(spark, str(tmp_path / "flipped")).collect()


def test_other_record_types_are_passed_over():
    info = (b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n"
            b"Content-Length: 3\r\n\r\nabc\r\n\r\n")
    assert W.parse_record(info) is None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-2**63, 2**63 - 1)), st.one_of(st.none(), st.text()),
                          st.binary(max_size=3000)), max_size=5))
def test_any_record_round_trips(rows):
    rows = [(i, None if u is None else u.encode("utf-8", "ignore").decode(), b) for i, u, b in rows]
    data = archive([W.build_record(i, u, b, None, False) for i, u, b in rows])
    got = [W.parse_record(f) for _, f in W.read_frames(data)]
    assert [(r["page_id"], r["payload"], r["payload_bytes"], r["payload_digest"]) for r in got] == [
        (i, b, len(b), hashlib.sha1(b).hexdigest()) for i, _, b in rows]
    revisits = [W.parse_record(W.build_record(i, u, b, 7, True)) for i, u, b in rows]
    assert all(r["refers_to"] == 7 and r["payload"] is None for r in revisits)


def test_frame_ends_of_all_block_types():
    rng = random.Random(4)
    for body in (b"", b"a" * 500_000, rng.randbytes(300_000), b"abc" * 100_000 + rng.randbytes(1000)):
        for checksum in (True, False):
            frame = zstandard.ZstdCompressor(write_checksum=checksum).compress(body)
            assert W.frame_end(memoryview(frame + b"rest"), 0) == len(frame)
