"""Hand-made vectors for the expression-level rules."""

import pytest
from pyspark.sql import functions as F

from lakefold.functions import csvtext as C
from lakefold.functions import jsontext as J
from lakefold.functions import markdown as M
from lakefold.functions import markup as U
from lakefold.functions import scalars as S
from lakefold.functions import xmltext as X
from lakefold.functions.arrays import prefix_sums
from lakefold.functions.text import trim_space
from lakefold.operators import docs, jsondocs, sheets
from lakefold.operators.text import keyword_hits, rtf_runs


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).collect()[0].r


def fields(rows):
    return [list(r.columns) for r in rows]


@pytest.mark.parametrize("text, want", [
    ("name,age\n张三,25\n李四,30", [["张三", "25"], ["李四", "30"]]),
    ('h\n"a, b","x\ny","包含""引号"""', [["a, b", "x\ny", '包含"引号"']]),
    ("h\r\na,b\r\n\r\nc,d\r", [["a", "b"], ["c", "d"]]),
    ("h\na,,c\n,,", [["a", "", "c"], ["", "", ""]]),
    ('h\n" a ", b \n"open,x', [["a", "b"], ["open,x"]]),
    ("", []),
    ("only", []),
])
def test_csv(spark, text, want):
    assert fields(one(spark, text, lambda c: C.csv_data(C.csv_rows(c)))) == want


def test_csv_options(spark):
    semi = C.CsvOptions(delimiter=";", has_header=False)
    assert fields(one(spark, "a;b\nc;d", lambda c: C.csv_rows(c, semi))) == [["a", "b"], ["c", "d"]]
    tab = C.CsvOptions(delimiter="\t", quote="'", escape="\\", has_header=False)
    assert fields(one(spark, "'it\\'s\tx'\ty", lambda c: C.csv_rows(c, tab))) == [["it's\tx", "y"]]
    assert [r.row_num for r in one(spark, "h\n\nx\n", lambda c: C.csv_rows(c))] == [1, 3]


def test_csv_long_record(spark):
    """Patterns loop instead of recursing, so long quoted records do not overflow the stack."""
    text = 'h\n"' + "a,\n" * 60000 + '",b'
    rows = one(spark, text, lambda c: C.csv_data(C.csv_rows(c)))
    assert len(rows) == 1 and len(rows[0]["columns"]) == 2


@pytest.mark.parametrize("text, valid", [
    ('{"k": 1}', True), ('{"k": 1}}', False), ('{"a":1,"a":2}', True), ("1,2", False), ("1],[2", False), ('1},{"v":2', False),
    ("", False), ("null", True), ("NaN", False), ("{'a':1}", False), ("[1,]", False), ('"x"', True), (None, False),
])
def test_json_valid(spark, text, valid):
    assert one(spark, text, J.is_valid_json) is valid


@pytest.mark.parametrize("text, want", [
    ("{}", ("object", 0, 0, 1, 1)), ("[]", ("array", 0, 1, 0, 1)), ("3", ("number", 0, 0, 0, 1)), ('"{[:"', ("string", 0, 0, 0, 1)),
    ('{"a":{"b":[1,{"c":null}]}}', ("object", 3, 1, 3, 5)), ("null", ("object", 0, 0, 0, 1)), ("[[],[[]]]", ("array", 0, 4, 0, 3)),
])
def test_json_profile(spark, text, want):
    r = one(spark, text, J.json_profile)
    assert (r.data_type, r["keys"], r.arrays, r.objects, r.max_depth) == want


@pytest.mark.parametrize("text, want", [
    ('{"a":[1,2.50,{}],"b":"\\u0041"}', '{\n  "a": [\n    1,\n    2.5,\n    {}\n  ],\n  "b": "A"\n}'), ("[]", "[]"), ("[", None),
])
def test_json_pretty(spark, text, want):
    assert one(spark, text, J.json_pretty) == want


def test_json_deep_tree(spark):
    text = "[" * 600 + "]" * 600
    rows = jsondocs.json_nodes(spark.createDataFrame([(1, text)], "id INT, doc STRING"), "id", "doc").collect()
    assert len(rows) == 600 and all(r.parent == (r.node_id - 1 or None) for r in rows)


@pytest.mark.parametrize("ref, want", [
    ("A1", (0, 0)), ("Z1", (25, 0)), ("AA1", (26, 0)), ("B10", (1, 9)), ("AB100", (27, 99)), ("INVALID", (0, 0)), (None, (0, 0)),
])
def test_cell_ref(spark, ref, want):
    r = one(spark, ref, sheets.cell_ref)
    assert (r.col, r.row) == want


@pytest.mark.parametrize("color, want", [
    ("#FF8000", (255, 128, 0, 1)), ("#80FF8000", (255, 128, 0, 128 / 255)), ("rgb(1, 2,3)", (1, 2, 3, 1)), ("rgba(1,2,3,.5)", (1, 2, 3, 0.5)),
    ("red", (0, 0, 0, 1)), (None, (0, 0, 0, 1)),
])
def test_color(spark, color, want):
    assert tuple(one(spark, color, S.parse_color)) == pytest.approx(want)


@pytest.mark.parametrize("size, style, want", [
    (0, "short", "0 B"), (1536, "short", "1.5 KB"), (1024 ** 5, "short", "1024 TB"), (1024 ** 4, "short_gb", "1024 GB"),
    (1024, "fixed", "1.00 KB"), (None, "fixed", "0 B"), (512, "plain", "512 B"),
])
def test_format_bytes(spark, size, style, want):
    assert one(spark, size, lambda c: S.format_bytes(c, style), "bigint") == want


def test_prefix_sums_across_blocks(spark):
    values = [i % 7 - 3 for i in range(1500)]
    want = [sum(values[:i]) for i in range(0, 1500, 100)]
    got = one(spark, values, prefix_sums, "array<int>")
    assert len(got) == 1500 and got[::100] == want
    assert one(spark, [], prefix_sums, "array<int>") == []


def test_trim_space(spark):
    assert one(spark, " \t x 　y﻿\n", trim_space) == "x 　y"


def test_keyword_hits_literal(spark):
    docs_ = spark.createDataFrame([(1, "a.b A.B axb\na.b.a.b")], "id INT, t STRING")
    rows = [(r.line_no, r.start_index, r.end_index) for r in keyword_hits(docs_, "id", "t", "a.b").orderBy("line_no", "start_index").collect()]
    assert rows == [(1, 0, 3), (1, 4, 7), (2, 0, 3), (2, 4, 7)]


@pytest.mark.parametrize("text, want", [
    ("{\\rtf1 Hello}", ["Hello"]), ("{\\rtf1 One\\par Two\\par}", ["One", "Two"]), ("{\\rtf1 \\{x\\} \\\\y}", ["{x} \\y"]), ("{\\rtf1   }", []),
    ("{\\rtf1 a\\tab b\\line c", ["a\tb", "c"]),
])
def test_rtf(spark, text, want):
    closed = text if text.endswith("}") else text + "}"
    rows = rtf_runs(spark.createDataFrame([(1, closed)], "id INT, t STRING"), "id", "t").orderBy("run_no").collect()
    assert [r.text for r in rows] == want


def test_markdown_unclosed_fence(spark):
    blocks = one(spark, "```py\na\n```\n```\nb", M.md_code_blocks)
    assert [(b.language, b.start_line, b.end_line, b["lines"]) for b in blocks] == [("py", 1, 3, 1)]


@pytest.mark.parametrize("text, valid", [("<a><b/></a>", True), ("<a><b></a>", False), ("", False), ("plain", False), (None, False)])
def test_xml_valid(spark, text, valid):
    assert one(spark, text, X.is_valid_xml) is valid


def test_markup_references(spark):
    assert one(spark, "<t a='1 &lt; 2'>x &amp;lt; &#233;&#x1F600; &amp; y</t>", U.text_content) == "x &lt; é\U0001F600 & y"
    assert one(spark, "<t a='1 &lt; 2'/>", lambda c: U.attribute(c, "a")) == "1 < 2"
    assert one(spark, "<t b='1'/>", lambda c: U.attribute(c, "a")) is None


def test_nested_tables(spark):
    inner = "<w:tbl><w:tr><w:tc><w:t>in</w:t></w:tc></w:tr></w:tbl>"
    outer = f"<w:d><w:tbl><w:tr><w:tc><w:t>a</w:t>{inner}</w:tc></w:tr><w:tr><w:tc><w:t>b</w:t></w:tc></w:tr></w:tbl>{inner}</w:d>"
    found = one(spark, outer, docs._tables)
    assert [t.depth for t in found] == [1, 2, 1] and found[0].markup.count("<w:tr>") == 2
