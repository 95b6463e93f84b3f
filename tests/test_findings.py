"""Cases that a review found: tables as folders of parts, cut references, lines that look like hex, long films."""

import os
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakefold.functions import html, xmltext
from lakefold.operators import media, ofd
from lakefold.plans import QUERIES, binary, ingesting
from lakefold.plans import fixtures as X
from lakefold.sources import archive
from lakefold.sources.mp4 import mp4_boxes
from lakefold.streaming import events as SE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The tables with ``documents`` as a folder of parts."""
    folder = tmp_path_factory.mktemp("parts")
    for name in os.listdir(SF):
        if name != "documents.parquet":
            shutil.copyfile(f"{SF}/{name}", folder / name)
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["scan_files", "file_headers", "detect_stream"])
def test_parts_of_a_table_are_one_row(spark, parts, name):
    assert sorted(map(tuple, QUERIES[name](spark, parts).collect())) == sorted(map(tuple, QUERIES[name](spark, SF).collect()))


def test_stream_of_a_table_in_parts(spark, parts):
    got = QUERIES["ingest_tables"](spark, parts)
    assert sorted(map(str, got.collect())) == sorted(map(str, QUERIES["ingest_tables"](spark, SF).collect()))


def test_references_cut_by_the_end_of_a_text(spark):
    frame = spark.createDataFrame([("<title>a&amp;&am</title>",), ("<title>b&amp;&amp</title>",)], "h STRING")
    assert [r.t for r in frame.select(html.html_title(F.col("h"), unclosed=False).alias("t")).collect()] == ["a&&am", "b&&amp"]
    assert [r.t for r in frame.select(html.html_title(F.col("h")).alias("t")).collect()] == ["a&&am", "b&&"]


def test_lines_that_read_as_hex(spark):
    docs = spark.createDataFrame([(1, "de\nab\r\nplain\n12", "en", "s")], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    rows = ofd.ofd_elements(ofd.open_ofd(X.ofd_documents(docs))).where("type = 'text'").orderBy("page_no").collect()
    assert [r.content for r in rows] == ["ende", "enab\r", "enplain", "en12"]


def test_mark_before_a_short_first_line(spark):
    files = spark.createDataFrame([("a", bytearray(b"de\ncafe")), ("b", bytearray(b"LAKEx\ny"))], "path STRING, content BINARY")
    assert sorted(map(tuple, ingesting._lake_lines(files).collect())) == [("a", 0, ""), ("a", 1, "cafe"), ("b", 0, "x"), ("b", 1, "y")]


def test_films_beyond_32_bits_of_milliseconds(spark):
    orders = spark.createDataFrame([(2, 500_000), (3, 500_000), (4, 7)], "o_orderkey BIGINT, o_custkey BIGINT")
    files = orders.select(F.col("o_orderkey").cast("string").alias("path"), binary._mp4_content().alias("content"))
    assert {r.path: r.duration for r in media.mp4_summary(mp4_boxes(files)).collect()} == {"2": 5e6, "3": 5e6, "4": 70.0}


def test_event_and_subscription_meet_in_one_place(spark):
    """Closed, long, open, empty and inverted intervals, before and after 1970; a closed one meets only its own time."""
    hour = 3_600_000_000
    subs = [(0, 5 * hour, 11 * hour), (1, -3 * hour, hour), (2, 0, 1000 * hour), (3, 2 * hour, None), (4, hour, hour), (5, 9 * hour, hour), (6, 2 * hour, 4 * hour)]
    times = [h * hour + d for h in range(-5, 200) for d in (-1, 0, 1)]
    s = spark.createDataFrame(subs, "s INT, on_us BIGINT, off_us BIGINT").withColumn("place", F.explode(SE._places_of_subscription(F.col("on_us"), F.col("off_us"), F.xxhash64("s"), 3)))
    e = spark.createDataFrame([(t,) for t in times], "us BIGINT").withColumn("place", F.explode(SE._places_of_event(F.col("us"), 3)))
    met = e.join(s, "place").localCheckpoint()
    got = sorted((r.s, r.us) for r in met.where("us >= on_us AND (off_us IS NULL OR us < off_us)").collect())
    assert got == sorted((i, t) for i, on, off in subs for t in times if t >= on and (off is None or t < off))
    assert met.where("s IN (0, 6)").count() < 3 * 16


class _Stage:
    """Stands in for a DataFrame and keeps the function of its Arrow stage."""

    def select(self, *_):
        return self

    def mapInArrow(self, stage, _):  # noqa: N802 - Spark's name
        self.stage = stage
        return self


def test_built_files_leave_in_bounded_batches():
    parts = [[{"name": "a.png", "data": b"x" * 3_000_000, "raw_name": None}]] * 20
    kind = pa.list_(pa.struct([("name", pa.string()), ("data", pa.binary()), ("raw_name", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(20)]), pa.array(parts, kind)], ["path", "parts"])
    out = list(X.pack(_Stage()).stage(iter([batch])))
    assert [p for b in out for p in b.column("path").to_pylist()] == [str(i) for i in range(20)]
    assert max(b.nbytes for b in out) < 24_000_000


def test_arrow_stages_take_bounded_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    files = spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("x"), 8000).cast("binary").alias("content"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    taken = archive.arrow_stage(files, sizes, "rows LONG, bytes LONG").collect()
    assert sum(r.rows for r in taken) == 3000
    assert max(r.bytes for r in taken) < 5 << 20


def test_values_of_one_parse(spark):
    rows = [("<a><t>1</t><b:t xmlns:b='u'>2</b:t><c k=' 5x'/><y> &amp; <z>q</z></y></a>",), ("<a/>",), ("<a><b></a>",), ("plain",), (None,)]
    paths = {"n": 'count(//*[local-name()="t"]/text())', "k": '//*[local-name()="c"]/@k', "y": '//*[local-name()="y"]'}
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(rows, "x STRING").select(xmltext.xml_values(F.col("x"), **paths)).collect()]
    assert got == [("2", " 5x", " & q"), ("0", "", ""), None, None, None]
    assert QUERIES["xml_query"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("XPath") == 1


def test_ofd_resources_meet_in_the_row(spark):
    layer = '<p><Layer><ImageObject ResourceID="{}"/><TextObject/></Layer><Layer><PathObject/><ImageObject/><ImageObject ResourceID="{}"/></Layer></p>'
    parts = {"Doc_0/Pages.xml": "<Pages><Page/><Page/><Page/></Pages>", "Doc_0/Pages/Page_0/Content.xml": layer.format("r1", "r9"), "Doc_0/Pages/Page_1/Content.xml": "<p>",
             "Doc_0/Pages/Page_2/Content.xml": layer.format("r2", "r1"), "Doc_0/Res/x_r1.png": "abc", "Doc_0/Res/y_r1.png": "b", "Doc_0/Res/r2": "de"}
    files = X.pack(spark.createDataFrame([("f", [(k, v.encode(), None) for k, v in parts.items()])], "path STRING, parts ARRAY<STRUCT<name: STRING, data: BINARY, raw_name: BINARY>>"))
    docs = ofd.open_ofd(files, resources=True)
    found = ofd.ofd_resources(docs)
    expected = [(0, 1, "r1", "Doc_0/Res/x_r1.png", 3), (2, 1, "r2", "Doc_0/Res/r2", 2), (2, 3, "r1", "Doc_0/Res/x_r1.png", 3)]
    assert sorted(tuple(r)[1:] for r in found.collect()) == expected
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.page_no, r.element_no, bytes(r.data)) for r in ofd.ofd_resource_data(files, docs).collect()) == [(0, 1, b"abc"), (2, 1, b"de"), (2, 3, b"abc")]
