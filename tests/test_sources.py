"""File sources, sinks, registry, table functions and the ingest stream on real files."""

import zipfile

import pytest
from pyspark.sql import functions as F

from lakefold.functions.csvtext import CsvOptions
from lakefold.registry import FormatRegistry
from lakefold.sources import files as SF
from lakefold.sources.sinks import write_csv
from lakefold.sources.udtf import register_udtfs
from lakefold.streaming.ingest import ingest


@pytest.fixture()
def lake(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("﻿hé\nx".encode())
    (tmp_path / "b.csv").write_text('k,v\n1,"a\nb"\n2,c\n')
    (tmp_path / "c.json").write_text('{"a": [1]}')
    (tmp_path / "d.xml").write_text("<r><i>1</i><i>2</i></r>")
    (tmp_path / "sub" / "e name").write_bytes(b"%PDF-1.4 ...")
    with zipfile.ZipFile(tmp_path / "sub" / "f.zip", "w") as z:
        z.writestr("one.txt", "1")
    return str(tmp_path)


def names(frame):
    return sorted(r.n for r in frame.select(SF.file_name(F.col("path")).alias("n")).collect())


def test_scan(spark, lake):
    assert names(SF.scan_files(spark, lake)) == ["a.txt", "b.csv", "c.json", "d.xml", "e name", "f.zip"]
    assert names(SF.scan_files(spark, lake, glob="*.csv")) == ["b.csv"]
    plan = SF.scan_files(spark, lake, max_size=8)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "LessThanOrEqual(length,8)" in plan


def test_headers(spark, lake):
    heads = {r.path.rsplit("/", 1)[-1]: bytes(r.header) for r in SF.file_headers(SF.scan_files(spark, lake).select("path", "length"), 4).collect()}
    assert heads["f.zip"] == b"PK\x03\x04" and b"%PDF" in heads.values()


def test_documents(spark, lake):
    assert SF.read_text(spark, lake + "/a.txt").collect()[0].text == "hé\nx"
    rows = SF.read_csv_files(spark, lake + "/b.csv").orderBy("row_num").collect()
    assert [(r.row_num, r.columns) for r in rows] == [(2, ["1", "a\nb"]), (3, ["2", "c"])]
    assert [tuple(r) for r in SF.read_csv_table(spark, lake + "/b.csv", "k INT, v STRING").orderBy("k").collect()] == [(1, "a\nb"), (2, "c")]
    assert SF.read_json_docs(spark, lake + "/c.json").select("valid", F.variant_get("doc", "$.a[0]", "int").alias("x")).collect()[0] == (True, 1)
    assert SF.read_xml_docs(spark, lake + "/d.xml").collect()[0].valid
    assert sorted(r.n for r in SF.read_xml_rows(spark, lake + "/d.xml", "i", "_VALUE INT").selectExpr("_VALUE AS n").collect()) == [1, 2]


def test_write_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a,"b"\nc', None), (2, "", "x")], "k INT, v STRING, w STRING")
    write_csv(rows.coalesce(1), str(tmp_path / "out"))
    back = SF.read_csv_files(spark, str(tmp_path / "out"), CsvOptions(has_header=False)).filter("path LIKE '%.txt'").orderBy("row_num").collect()
    assert [r.columns for r in back] == [["1", 'a,"b"\nc', ""], ["2", "", "x"]]


def test_registry(spark):
    registry = FormatRegistry()
    registry.register_format("Foo", "custom", parser=lambda f: f)
    assert registry.frame(spark).filter("ext = 'foo' AND category = 'custom'").count() == 1 and "foo" in registry.parsers
    with pytest.raises(ValueError):
        registry.register_parser("nope", lambda f: f)
    registry.unregister("foo")
    assert "foo" not in registry.parsers


def test_table_functions(spark, lake):
    register_udtfs(spark)
    SF.scan_files(spark, lake, glob="*.zip").createOrReplaceTempView("zips")
    found = spark.sql("SELECT e.name, p.data FROM zips, LATERAL archive_entries(content) e, LATERAL archive_parts(content, 'one') p").collect()
    assert [(r.name, bytes(r.data)) for r in found] == [("one.txt", b"1")]


def test_ingest_stream(spark, lake, tmp_path_factory):
    out = tmp_path_factory.mktemp("ingest")
    for _ in range(2):  # a second run finds nothing new
        ingest(SF.stream_files(spark, lake, files_per_trigger=2), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{out}/table").count() == 6
    kinds = {r["type"] for r in spark.read.parquet(f"{out}/table").select("type").collect()}
    assert kinds == {"txt", "csv", "json", "xml", "pdf", "zip"}
