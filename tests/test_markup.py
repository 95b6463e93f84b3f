"""Comments, character data and signs inside attributes must not mislead the document operators."""

from pyspark.sql import functions as F

from lakefold.functions.markup import attribute, elements, plain_markup, text_content
from lakefold.operators import docs, ofd, slides


def _package(spark, parts):
    frame = spark.createDataFrame([("f", {k: bytearray(v.encode()) for k, v in parts.items()}, None)], "path STRING, parts MAP<STRING, BINARY>, error STRING")
    return frame.repartition(2)


def test_plain_markup(spark):
    text = "<a t='x>y'><!-- <b>no</b> --><b>1 <![CDATA[<b>&amp;</b>]]></b><b u=\"2>3\"/></a>"
    row = spark.createDataFrame([(text,)], "t STRING").select(plain_markup(F.col("t")).alias("t")).select(
        "t", F.transform(elements(F.col("t"), "b"), text_content).alias("b"), attribute(F.col("t"), "t").alias("a"), attribute(F.get(elements(F.col("t"), "b"), F.lit(1)), "u").alias("u")).collect()[0]
    assert row.b == ["1 <b>&amp;</b>", ""] and (row.a, row.u) == ("x>y", "2>3")
    same = "<a b='1'>x -- y &gt; z<c/></a>"
    assert spark.createDataFrame([(same,)], "t STRING").select(plain_markup(F.col("t"))).collect()[0][0] == same


def test_paragraphs_slides_and_pages(spark):
    word = "<w:document xmlns:w='u'><w:body><!-- <w:p><w:r><w:t>gone</w:t></w:r></w:p> --><w:p w:x='a>b'><w:r><w:t><![CDATA[<w:t>kept</w:t>]]></w:t></w:r></w:p></w:body></w:document>"
    rows = docs.paragraphs(_package(spark, {"word/document.xml": word})).collect()
    assert [r.text for r in rows] == ["<w:t>kept</w:t>"]
    deck = {"ppt/presentation.xml": "<p:presentation xmlns:p='u' xmlns:r='v'><p:sldIdLst><p:sldId id='1' r:id='rId1'/></p:sldIdLst></p:presentation>",
            "ppt/slides/slide1.xml": "<p:sld xmlns:p='u' xmlns:a='v'><!-- <p:sp><a:r><a:t>gone</a:t></a:r></p:sp> --><p:sp><p:txBody><a:p><a:r><a:t>a <![CDATA[& b]]></a:t></a:r></a:p></p:txBody></p:sp></p:sld>"}
    assert [r.text for r in slides.slide_text_runs(_package(spark, deck)).collect()] == ["a & b"]
    pages = {"Doc_0/Pages.xml": "<o:Pages xmlns:o='u'><o:Page/></o:Pages>",
             "Doc_0/Pages/Page_0/Content.xml": "<o:Page xmlns:o='u'><o:Content><o:Layer><!-- <o:TextObject/> --><o:TextObject ID='1>2'><o:TextCode>x<![CDATA[<]]></o:TextCode></o:TextObject></o:Layer></o:Content></o:Page>"}
    rows = ofd.ofd_elements(_package(spark, pages)).collect()
    assert [(r.id, r.content) for r in rows] == [("1>2", "x<")]
