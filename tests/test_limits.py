"""Depths and lengths at which a fixed window or a reader's own limit would show."""

import html as markup
import json
import random
import threading
from html import entities

import pytest
from pyspark.sql import functions as F

from lakefold.functions import formats, html, image
from lakefold.functions import jsontext as J
from lakefold.operators.jsondocs import json_nodes
from lakefold.sources import archive


def _texts(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, text STRING")


def test_deep_json(spark):
    deep, cut = "[" * 5000 + "1" + "]" * 5000, "[" * 5000 + "1" + "]" * 4999
    members = '{"a":' * 1200 + "null" + "}" * 1200
    docs = _texts(spark, deep, cut, members, members + "x", "[" * 1000 + "tru" + "]" * 1000)
    rows = docs.select("id", J.is_valid_json(F.col("text")).alias("valid"), J.json_profile(F.col("text"))["max_depth"].alias("depth"),
                       J.json_error_context(F.col("text"))["position"].alias("at")).orderBy("id").collect()
    assert [r.valid for r in rows] == [True, False, True, False, False]
    assert [r.depth for r in rows] == [5001, None, 1201, None, None]
    assert [r["at"] for r in rows] == [None, len(cut), None, len(members), 1000]
    assert json_nodes(docs.where("id = 2"), "id", "text").count() == 1201


@pytest.mark.parametrize("text", ["", "1", "-0.5e3", "01", "1.", "[]", "[1,]", "[,1]", "{}", '{"a":1,}', '{"a" : [true, {"b":null}]}', '{a:1}', '"\\u12g4"', '"tab\t"',
                                  " [1] ", "[1] 2", "nul", "[1 2]", '{"a":1 "b":2}', '["]"]', "{]", "[}"])
def test_iterative_check_agrees(text):
    try:
        json.loads(text)
        valid = True
    except json.JSONDecodeError:
        valid = False
    assert (J._first_error(text) is None) == valid


def test_token_check_agrees(spark):
    """Random token sequences, right and wrong, by the token rules and by the reader in Python."""
    rnd = random.Random(2)
    tokens = ["{", "}", "[", "]", ":", ",", '"a"', "1", "true", "-0.5e3", '"\\u12aF"', " ", "0", "x", '"\t"']

    def value(depth):
        kind = rnd.randrange(4) if depth < 4 else 0
        if kind == 1:
            return "[" + ",".join(value(depth + 1) for _ in range(rnd.randrange(3))) + "]"
        if kind == 2:
            return "{" + ", ".join(f'"k" : {value(depth + 1)}' for _ in range(rnd.randrange(3))) + "}"
        return rnd.choice(["1", '"s"', "null", "-2.50"])

    texts = [value(0) for _ in range(300)]
    for t in list(texts):  # one token more, less or other
        at = rnd.randrange(len(t) + 1)
        texts.append(t[:at] + rnd.choice(tokens) + t[at + rnd.randrange(2):])
    texts += ["".join(rnd.choice(tokens) for _ in range(rnd.randrange(1, 6))) for _ in range(300)]
    rows = _texts(spark, *texts).select("text", J._valid_beyond(F.col("text")).alias("ok")).collect()
    assert {(r.text, r.ok) for r in rows} == {(t, J._first_error(t) is None) for t in texts}


def test_no_python_in_the_plans(spark):
    docs = _texts(spark, "1")
    for c in (J.is_valid_json(F.col("text")), J.json_profile(F.col("text")), html.html_text(F.col("text")), html.html_title(F.col("text"))):
        assert "Python" not in docs.select(c)._jdf.queryExecution().executedPlan().toString()
    plan = json_nodes(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_all_references_agree(spark):
    names = [f"&{n}" for n in entities.html5]
    numbers = [f"&#{n};" for n in (0, 1, 9, 11, 13, 31, 65, 127, 128, 129, 150, 159, 160, 0xD800, 0xFDD0, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000, 10**30)]
    odd = ["&#x41", "&#X1f600;", "&#xZ;", "&copy2020", "&notit;", "&notin;", "&ampamp;", "&#", "&", "& &;", "&lt&gt", "&#00065;", "&#x00000000041;", "&copy\u00e9", "&Nonsense;"]
    texts = names + numbers + odd
    rows = {r.id: r.t for r in _texts(spark, *texts).select("id", html.html_unescape(F.col("text")).alias("t")).collect()}
    assert [(t, rows[i]) for i, t in enumerate(texts) if rows[i] != markup.unescape(t)] == []


def test_html_references(spark):
    texts = _texts(spark, "<p>&eacute;&#8217;&hellip;&#x41;</p>", "a &amp;lt; b", "<b>&lt;&copy;</b>", "R&D & more", "&bogus; &amp;eacute;", None)
    got = [r[0] for r in texts.orderBy("id").select(html.html_text(F.col("text"))).collect()]
    assert got == ["\u00e9\u2019\u2026A", "a &lt; b", "<\u00a9", "R&D & more", "&bogus; &eacute;", None]


def test_headers_beyond_a_window(spark):
    profile = b"ICCP" + (400).to_bytes(4, "little") + bytes(400)
    webp = [b"RIFF" + bytes(4) + b"WEBPVP8X" + (10).to_bytes(4, "little") + bytes([flags]) + bytes(9) + profile + b"ANIM" for flags in (0x22, 0x20)]
    void = b"\xec\x40\xc8" + bytes(200)
    header = void + b"\x42\x82\x84webm"
    ebml = [b"\x1a\x45\xdf\xa3" + size + header for size in ((0x4000 | len(header)).to_bytes(2, "big"), b"\x01" + len(header).to_bytes(7, "big"), b"\xff")]
    short = b"\x1a\x45\xdf\xa3" + bytes([0x80 | 36]) + b"\x42\x82\x88matroska" + bytes(25) + b"title webm"  # a header of 40 bytes, then more
    ebml.append(short)
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(webp + ebml + [b"\x1a\x45\xdf\xa3", b""])], "id INT, content BINARY")
    rows = frame.orderBy("id").select(image.webp_animated(F.col("content")).alias("w"), formats.ebml_doctype(F.col("content")).alias("e")).collect()
    assert [r.w for r in rows[:2]] == [True, False]
    assert [r.e for r in rows[2:]] == ["webm", "webm", "unknown", "mkv", "unknown", "unknown"]


def test_arrow_stage_bounds_batches_in_a_thread_without_an_active_session(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, rows, seen = spark.conf.get(name), spark.range(3), []
    spark.conf.set(name, "64m")

    def stage():
        archive.arrow_stage(rows, lambda batches: batches, "id BIGINT")
        seen.append(spark.conf.get(name))

    try:
        thread = threading.Thread(target=stage)
        thread.start()
        thread.join()
    finally:
        spark.conf.set(name, before)
    assert seen == [str(archive._TAKEN_BYTES)]
