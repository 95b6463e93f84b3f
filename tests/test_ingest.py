"""Dispatch to parsers, idempotent ingest, and ranged reads on real files."""

import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lakefold import parsing
from lakefold.registry import FormatRegistry
from lakefold.sources import files as SF
from lakefold.sources import ranged
from lakefold.streaming.ingest import detect_stream, ingest_tables


def _files(spark, rows):
    return spark.createDataFrame(rows, "path STRING, content BINARY")


def _words(files):
    return files.select("path", F.explode(F.split(F.col("content").cast("string"), " ")).alias("word"))


def test_registration_rules():
    known = FormatRegistry()
    with pytest.raises(ValueError, match="unsupported type"):
        known.register_parser("nope", _words)
    known.register_parsers({"txt": _words, "csv": _words})
    assert known.is_registered("txt") and known.registered_types() == ["csv", "txt"]
    known.unregister("txt")
    assert not known.is_registered("txt")
    known.register_format("LAKE", "special", _words, magic="4c41")
    assert known.is_supported("lake") and known.families()["lake"] == "special"


def test_dispatch_errors_and_custom_format(spark, tmp_path):
    known = FormatRegistry()
    known.register_parser("txt", _words)
    known.register_format("lake", "special", _words, magic="4C414B45")
    files = _files(spark, [("a.txt", b"x y"), ("b", b"LAKE z"), ("c.pdf", b"%PDF"), ("d", b"?"), ("e.lake", b"q"), ("f.txt", None), ("g.txt", b"0" * 64)])
    staged = parsing.stage_files(files.withColumn("length", F.octet_length("content").cast("bigint")), str(tmp_path / "s"), known, max_size=32)
    rows = {(r.path, r.family, r.type, r.w, r.error) for r in parsing.parse_files(staged, known).select(
        "*", F.try_variant_get("record", "$.word", "string").alias("w")).collect()}
    assert rows == {
        ("a.txt", "document", "txt", "x", None), ("a.txt", "document", "txt", "y", None), ("b", "special", "lake", "LAKE", None), ("b", "special", "lake", "z", None),
        ("e.lake", "special", "lake", "q", None), ("c.pdf", "errors", "pdf", None, "no parser for type: pdf"), ("d", "errors", "unknown", None, "unsupported type: unknown"),
        ("g.txt", "errors", "txt", None, "file too large"),
    }
    assert staged.where("path = 'g.txt'").collect()[0].content is None
    typed = parsing.records(parsing.parse_files(staged, known), "txt", "word: string")
    assert sorted(map(tuple, typed.collect())) == [("a.txt", "x"), ("a.txt", "y")]


def test_repeated_batch_and_failing_parser(spark, tmp_path):
    @F.udf("string")
    def fail(_):
        raise RuntimeError("bad luck")

    known = FormatRegistry()
    known.register_parser("txt", _words)
    known.register_parser("csv", lambda files: files.select("path", fail("path").alias("x")))
    staged = parsing.stage_files(_files(spark, [("a.txt", b"x y"), ("b.csv", b"1"), ("c.doc", b"2")]), str(tmp_path / "s"), known)
    out = str(tmp_path / "t")

    def state():
        docs = sorted((r.path, r.batch, r.type) for r in parsing.read_family(spark, out, "document").collect())
        bad = sorted((r.path, r.error.split(":")[0], r.batch) for r in parsing.read_family(spark, out, "errors").collect())
        return docs, bad

    parsing.write_batch(spark, staged, out, 3, known)
    once = state()
    assert once == ([("a.txt", 3, "txt")] * 2, [("b.csv", "parser failed", 3), ("c.doc", "no parser for type", 3)])
    parsing.write_batch(spark, staged, out, 3, known)
    assert state() == once
    parsing.write_batch(spark, staged, out, 4, known)
    assert len(state()[0]) == 4


def test_stream_of_real_files(spark, tmp_path):
    lake = tmp_path / "lake"
    lake.mkdir()
    (lake / "a.txt").write_text("héllo")
    (lake / "b.csv").write_text("k,v\n1,2\n")
    (lake / "c.bin").write_bytes(b"\0\1")
    with zipfile.ZipFile(lake / "d.zip", "w") as z:
        z.writestr("one.txt", "1")
    known, out, state = parsing.default_registry(), str(tmp_path / "out"), str(tmp_path / "state")
    for step in range(2):
        ingest_tables(SF.stream_files(spark, str(lake)), out, state, known).awaitTermination()
        assert not os.path.exists(f"{state}-stage/batch={step}")
        if step == 0:
            (lake / "e.json").write_text('{"k": 1}')
    assert parsing.records(parsing.read_family(spark, out, "document"), "txt", "charset: string, text: string").collect()[0].text == "héllo"
    assert {r.type for r in parsing.read_family(spark, out, "document").collect()} == {"txt", "json"}
    assert [r.error for r in parsing.read_family(spark, out, "errors").collect()] == ["unsupported type: unknown"]
    names = parsing.records(parsing.read_family(spark, out, "archive"), "zip", "name: string").collect()
    assert [r.name for r in names] == ["one.txt"]


def test_header_only_detection_of_large_and_missing_files(spark, tmp_path):
    big = tmp_path / "big"
    with open(big, "wb") as f:  # sparse: three gigabytes, no disk
        f.write(b"%PDF-1.7")
        f.truncate(3 << 30)
    found = detect_stream(SF.stream_paths(spark, str(tmp_path)).drop("x"))
    query = found.writeStream.format("memory").queryName("heads").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "_c")).start()
    query.awaitTermination()
    row = spark.table("heads").collect()[0]
    assert (row.type, row.family, row.length, row.error) == ("pdf", "document", 3 << 30, None)
    gone = spark.createDataFrame([(str(tmp_path / "gone"), 1)], "path STRING, length BIGINT")
    assert "FileNotFound" in ranged.file_headers(gone).collect()[0].error
    with pytest.raises(Exception, match="no file system for 'wasb'"):
        ranged.file_headers(spark.createDataFrame([("wasb://x/y", 1)], "path STRING, length BIGINT")).collect()


def test_ranged_walks_read_little(spark, tmp_path):
    payload = os.urandom(4 << 20)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(3):
            z.writestr(f"m{k}", payload)
    fmt = struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)
    with open(tmp_path / "b.wav", "wb") as f:
        f.write(b"RIFF\0\0\0\0WAVE" + b"LIST" + struct.pack("<I", len(payload)) + payload + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", 64000))
    with open(tmp_path / "c.jpg", "wb") as f:
        f.write(b"\xff\xd8" + (b"\xff\xe1" + struct.pack(">H", 65000) + b"\0" * 64998) * 40 + b"\xff\xff\xc0" + struct.pack(">HBHH", 11, 8, 480, 640) + payload)
    paths = SF.scan_files(spark, str(tmp_path)).select("path", "length")
    zips, wavs, jpgs = (paths.where(F.col("path").endswith(e)) for e in (".zip", ".wav", ".jpg"))
    z = ranged.archive_directories(zips).collect()[0]
    assert [e.name for e in z.entries] == ["m0", "m1", "m2"] and z.bytes_read < 300_000 < z.length
    w = ranged.wav_headers(wavs).collect()[0]
    assert (w.format, w.channels, w.sample_rate, w.bits_per_sample, w.duration) == ("PCM", 2, 8000, 16, 2.0) and w.bytes_read <= 3 * ranged.BLOCK
    j = ranged.jpeg_sizes(jpgs).collect()[0]
    assert (j.width, j.height) == (640, 480) and j.bytes_read < j.length / 1.5
    assert all(r.error for r in ranged.wav_headers(zips).collect() + ranged.jpeg_sizes(zips).collect() + ranged.archive_directories(wavs).collect())
