"""Packed files built from table rows, one file per row, for round-trip queries and tests.

Each builder writes the markup with column expressions and packs it in one Arrow stage, so the
fixtures grow with the tables and no group of rows is ever collected.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of, xml_escape
from ..sources.archive import _batches, arrow_stage

_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'


def x(text: Column | str) -> Column:
    return F.lit(text) if isinstance(text, str) else text.cast("string")


def cat(*pieces: Column | str) -> Column:
    return F.concat(*[x(p) for p in pieces])


def entry(name: Column | str, data: Column, raw_name_hex: str | None = None) -> Column:
    """One member; text data is UTF-8.  ``raw_name_hex`` stores undeclared name bytes."""
    raw = F.unhex(F.lit(raw_name_hex)) if raw_name_hex else F.lit(None).cast("binary")
    return F.struct(x(name).alias("name"), data.cast("binary").alias("data"), raw.alias("raw_name"))


class _RawName(zipfile.ZipInfo):
    """Entry whose name bytes are stored as given."""

    raw: bytes = b""

    def _encodeFilenameFlags(self):  # noqa: N802 - overrides the library's hook
        return self.raw, self.flag_bits


def _pack(parts: list[dict]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for p in parts:
            cls = _RawName if p["raw_name"] else zipfile.ZipInfo
            info = cls(p["name"], (2021, 3, 4, 5, 6, 8))
            if p["raw_name"]:
                info.raw = p["raw_name"]
            info.compress_type = zipfile.ZIP_STORED if p["name"].endswith((".png", "/")) else zipfile.ZIP_DEFLATED
            info.external_attr = 0x10 if p["name"].endswith("/") else 0
            archive.writestr(info, p["data"] or b"")
    return buffer.getvalue()


_FILES = pa.schema([("path", pa.string()), ("content", pa.binary())])


def _built(rows: DataFrame, build) -> DataFrame:
    """``files(path, content)`` by ``build`` of a row's values, path first; one row is unpacked at a time and output is bounded in bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                path, *rest = (v.as_py() for v in values)
                yield path, build(path, *rest)

    return arrow_stage(rows, lambda batches: _batches(made(batches), _FILES, lambda row: len(row[1])), "path STRING, content BINARY")


def pack(rows: DataFrame) -> DataFrame:
    """``(path, parts ARRAY<STRUCT<name, data, raw_name>>)`` to ``files(path, content)``."""
    return _built(rows.select("path", "parts"), lambda path, parts: _pack(parts))


def damage(files: DataFrame) -> DataFrame:
    """Cut every file whose number ends in 7 to half its bytes."""
    number = F.regexp_extract("path", "(\\d+)", 1)
    half = F.substring(F.col("content"), F.lit(1), (F.octet_length("content") / 2).cast("int"))
    return files.withColumn("content", F.when(number.endswith("7"), half).otherwise(F.col("content")))


def zip_documents(docs: DataFrame) -> DataFrame:
    """Archive per document: two folders, body, language, an image, and a GBK-named note."""
    return damage(pack(docs.select(
        cat("d", F.col("doc_id"), ".zip").alias("path"),
        F.array(
            entry("text/", F.lit("")), entry("text/body.txt", F.col("text")), entry("meta/", F.lit("")), entry("meta/lang.json", F.col("lang")),
            entry("img.PNG", F.col("source")), entry("说明.md", F.lit("utf")), entry("gbk", F.lit("gbk"), "CBB5C3F72E747874"),
            entry("x/word/document.xml", F.lit("<a/>")),
        ).alias("parts"),
    )))


def xlsx_documents(docs: DataFrame) -> DataFrame:
    """Workbook per document: a row per line (shared string, number, boolean, formula, raw, error) and a second sheet."""
    line = lines_of(F.col("text"))
    n = F.size(line)

    def row(v: Column, i: Column) -> Column:
        r = (i + 1).cast("string")
        long = F.when(F.length(v) > 100, "1").otherwise("0")
        size = F.length(v).cast("string")
        return cat(
            '<row r="', r, '"><c r="A', r, '" t="s" s="1"><v>', i, '</v></c><c r="B', r, '" t="n"><v>', size, '.5</v></c><c r="C', r,
            '" t="b"><v>', long, '</v></c><c r="D', r, '" t="str"><f>LEN(A', r, ')</f><v>', size, '</v></c><c r="E', r, '" s="7"><v>raw', r, "</v></c>",
            F.when(i % 3 == 0, cat('<c r="AA', r, '" t="e"><v>#N/A</v></c>')).otherwise(""), "</row>",
        )

    def item(v: Column, i: Column) -> Column:
        text = xml_escape(v)
        return (
            F.when(i % 5 == 4, "<si/>")
            .when(i % 5 == 3, cat("<si><r><rPr><b/></rPr><t xml:space=\"preserve\">", text, "</t></r><r><t>more</t></r></si>"))
            .otherwise(cat('<si><t xml:space="preserve">', text, "</t></si>"))
        )

    sheet1 = cat(
        _HEAD, '<worksheet xmlns="urn:s"><dimension ref="A1:AA', n, '"/><sheetData>', F.array_join(F.transform(line, row), ""),
        '</sheetData><mergeCells count="2"><mergeCell ref="A1:B2"/><mergeCell ref="B2:D', n + 70, '"/></mergeCells></worksheet>',
    )
    sheet2 = cat('<worksheet><sheetData><row><c r="A1" t="str"><v>', F.col("lang"), '</v></c><c r="B1" t="str"><v>', F.col("source"), '</v></c><c r="?1"><v>0</v></c></row></sheetData></worksheet>')
    styles = (
        '<styleSheet><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><i val="0"/><sz val="14.5"/><color rgb="FFFF0000"/><name val="Arial"/></font></fonts>'
        '<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFFF00"/></patternFill></fill></fills>'
        '<borders><border><left/><right/><top/><bottom/></border><border><left style="thin"/><right/><top style="thick"/><bottom/></border></borders>'
        '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" fontId="1" fillId="1" borderId="1" applyFont="1" applyFill="1"><alignment horizontal="center" wrapText="1"/></xf></cellXfs></styleSheet>'
    )
    book = '<workbook xmlns:r="urn:r"><sheets><sheet name="Lines" sheetId="1" r:id="rId2"/><sheet name="Meta" sheetId="4" r:id="rId1"/><sheet name="Lost" sheetId="9" r:id="rId9"/></sheets></workbook>'
    rels = '<Relationships xmlns="urn:rel"><Relationship Id="rId1" Type="t/worksheet" Target="worksheets/sheet2.xml"/><Relationship Id="rId2" Type="t/worksheet" Target="/xl/worksheets/sheet1.xml"/></Relationships>'
    return damage(pack(docs.select(
        cat("d", F.col("doc_id"), ".xlsx").alias("path"),
        F.array(
            entry("[Content_Types].xml", F.lit("<Types/>")), entry("xl/workbook.xml", F.lit(book)), entry("xl/_rels/workbook.xml.rels", F.lit(rels)),
            entry("xl/sharedStrings.xml", cat("<sst>", F.array_join(F.transform(line, item), ""), "</sst>")), entry("xl/styles.xml", F.lit(styles)),
            entry("xl/worksheets/sheet1.xml", sheet1), entry("xl/worksheets/sheet2.xml", sheet2),
        ).alias("parts"),
    )))


def et_parts(part: DataFrame) -> DataFrame:
    """WPS table per part row: default and explicit sheet names and files, shared strings."""
    sheet = cat(
        '<worksheet><sheetData><row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="n"><v>', F.col("p_size"), '</v></c><c r="D3" t="e"><v>#REF</v></c></row></sheetData></worksheet>'
    )
    return pack(part.select(
        cat("p", F.col("p_partkey"), ".et").alias("path"),
        F.array(
            entry("Workbook.xml", F.lit('<workbook><sheets><sheet/><sheet name="Two" sheetId="7" filename="b.xml"/><sheet name="Gone" filename="none.xml"/></sheets></workbook>')),
            entry("SharedStrings.xml", cat("<sst><si><t>", F.col("p_name"), "</t></si></sst>")), entry("2.xml", sheet),
            entry("b.xml", cat('<worksheet><sheetData><row><c r="A1" t="b"><v>1</v></c><c r="B1"><f>A1</f><v>', F.col("p_brand"), "</v></c></row></sheetData></worksheet>")),
        ).alias("parts"),
    ))


def _p(*runs: Column | str, props: Column | str = "") -> Column:
    return cat("<w:p>", props, *runs, "</w:p>")


def _t(text: Column | str, style: str = "") -> Column:
    return cat("<w:r>", style, '<w:t xml:space="preserve">', text, "</w:t></w:r>")


def docx_documents(docs: DataFrame) -> DataFrame:
    """Document per row: a styled two-run paragraph per line, a table with a nested table, a text box, an image."""
    line = lines_of(F.col("text"))
    first = '<w:rPr><w:b/><w:sz w:val="28"/><w:color w:val="FF0000"/><w:rFonts w:ascii="Arial"/></w:rPr>'
    rest = '<w:rPr><w:i/><w:u w:val="single"/><w:color w:val="auto"/></w:rPr>'

    def paragraph(v: Column, i: Column) -> Column:
        style = F.when(i == 0, '<w:pStyle w:val="T1"/>').when(i == 1, '<w:pStyle w:val="H1"/>').when(i == 2, '<w:pStyle w:val="Odd"/>').otherwise("")
        jc = F.when(i % 2 == 0, '<w:jc w:val="center"/>').otherwise("")
        return F.when((v == "") & (i % 2 == 0), '<w:p w:rsidR="1"/>').otherwise(_p(
            _t(xml_escape(F.substring(v, 1, 5)), first), "<w:r><w:tab/></w:r>", _t(xml_escape(F.substring(v, 6, 1000000000)), rest),
            props=cat("<w:pPr>", style, jc, "</w:pPr>"),
        ))

    nested = cat("<w:tbl><w:tr><w:tc>", _p(_t("n")), "</w:tc></w:tr></w:tbl>")
    table = cat("<w:tbl><w:tblPr/><w:tr><w:tc>", _p(_t(F.col("lang"))), "</w:tc><w:tc>", _p(_t(F.col("source"))), nested, "</w:tc></w:tr><w:tr><w:tc>",
                _p(_t(F.col("doc_id"))), "</w:tc></w:tr></w:tbl>")
    box = cat("<w:r><w:pict><w:txbxContent>", _p(_t("boxed")), "</w:txbxContent></w:pict></w:r>")
    body = cat(_HEAD, '<w:document xmlns:w="urn:w"><w:body>', F.array_join(F.transform(line, paragraph), ""), table, _p(_t("out"), box), "</w:body></w:document>")
    styles = (
        '<w:styles xmlns:w="urn:w"><w:style w:type="paragraph" w:styleId="T1"><w:name w:val="Title"/><w:basedOn w:val="Normal"/></w:style>'
        '<w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:styleId="Odd"><w:name w:val="Odd Style"/></w:style>'
        '<w:style w:styleId="NoType"><w:name w:val="x"/></w:style></w:styles>'
    )
    rels = ('<Relationships xmlns="urn:rel"><Relationship Id="rId1" Type="urn/styles" Target="styles.xml"/><Relationship Id="rId2" Type="urn/image" Target="media/image1.png"/>'
            '<Relationship Id="rId3" Type="urn/image" Target="../media/two.JPG"/><Relationship Id="rId4" Type="urn/image" Target="media/none.png"/></Relationships>')
    return damage(pack(docs.select(
        cat("d", F.col("doc_id"), ".docx").alias("path"),
        F.array(
            entry("word/document.xml", body), entry("word/styles.xml", F.lit(styles)), entry("word/_rels/document.xml.rels", F.lit(rels)),
            entry("word/media/image1.png", F.col("source")), entry("media/two.JPG", F.col("lang")),
        ).alias("parts"),
    )))


def wps_parts(part: DataFrame) -> DataFrame:
    """WPS text per part row, its main part under each of the three names; some hold only tables."""
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, "document.xml").when(k == 1, "doc.xml").otherwise("content.xml")
    paragraphs = cat('<doc xmlns:x="u"><p align="center"><t>', F.col("p_name"), "</t><t> &#233;&amp;</t></p><x:p jc='left'>whole <b>", F.col("p_brand"), "</b></x:p><p/><table><row><cell>no</cell></row></table></doc>")
    rows = cat("<doc><table><row><cell><t>", F.col("p_name"), "</t></cell><cell>", F.col("p_brand"), "</cell></row></table></doc>")
    trs = cat("<doc><x><table><tr><td>", F.col("p_name"), "</td></tr><tr><td>", F.col("p_brand"), "</td></tr></table></x></doc>")
    styles = '<styles><style id="s1" font="Arial" size="12"/><style name="only" a=\'b\'>x</style><style other="1"/></styles>'
    return pack(part.select(
        cat("p", F.col("p_partkey"), ".wps").alias("path"),
        F.array(entry(name, F.when(k == 0, paragraphs).when(k == 1, rows).otherwise(trs)), entry("style.xml", F.lit(styles))).alias("parts"),
    ))


def pptx_parts(part: DataFrame) -> DataFrame:
    """Deck per part row: three listed slides, the last without a part; text, shape, picture, transitions."""
    ns = 'xmlns:p="urn:p" xmlns:a="urn:a" xmlns:r="urn:r"'
    xfrm = cat('<a:xfrm><a:off x="', F.col("p_size") * 9525, '" y="19050"/><a:ext cx="952500" cy="', F.col("p_partkey") * 9525, '"/></a:xfrm>')
    text = cat("<p:sp><p:spPr>", xfrm, '</p:spPr><p:txBody><a:p><a:r><a:rPr b="1" sz="2400"><a:solidFill><a:srgbClr val="FF0000"/></a:solidFill></a:rPr><a:t>', F.col("p_name"),
               '</a:t></a:r><a:r><a:rPr i="1"/><a:t>', F.col("p_brand"), "</a:t></a:r><a:r><a:rPr/></a:r></a:p></p:txBody></p:sp>")
    shape = cat("<p:sp><p:spPr>", xfrm, '<a:prstGeom prst="ellipse"/><a:solidFill><a:srgbClr val="00FF00"/></a:solidFill></p:spPr></p:sp><p:sp><p:spPr/></p:sp>')
    pic = cat('<p:pic><p:blipFill><a:blip r:embed="rId7"/></p:blipFill><p:spPr>', xfrm, '</p:spPr></p:pic><p:pic><p:blipFill><a:blip r:embed="rId8"/></p:blipFill></p:pic>')
    slide = lambda tree, tail: cat(f"<p:sld {ns}><p:cSld><p:spTree>", tree, "</p:spTree></p:cSld>", tail, "</p:sld>")
    rels = lambda *items: '<Relationships xmlns="urn:rel">' + "".join(f'<Relationship Id="{i}" Type="t" Target="{t}"/>' for i, t in items) + "</Relationships>"
    deck = f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="rId3"/><p:sldId id="257" r:id="rId2"/><p:sldId id="258" r:id="rId9"/></p:sldIdLst></p:presentation>'
    app = cat("<Properties><Application>Deck</Application><Manager>", F.col("p_brand"), "</Manager><Title>", F.col("p_name"), " &amp; co</Title></Properties>")
    return damage(pack(part.select(
        cat("p", F.col("p_partkey"), ".pptx").alias("path"),
        F.array(
            entry("docProps/app.xml", app), entry("ppt/presentation.xml", F.lit(deck)),
            entry("ppt/_rels/presentation.xml.rels", F.lit(rels(("rId2", "slides/slide1.xml"), ("rId3", "slides/slide2.xml"), ("rId9", "slides/slide9.xml")))),
            entry("ppt/slides/slide2.xml", slide(cat(text, shape, pic), "<p:transition><p:fade/></p:transition>")),
            entry("ppt/slides/slide1.xml", slide("<p:grpSp><p:sp><p:txBody><a:p><a:r><a:t>solo</a:t></a:r></a:p></p:txBody></p:sp></p:grpSp>", F.when(F.col("p_partkey") % 2 == 0, "<p:transition/>").otherwise(""))),
            entry("ppt/slides/_rels/slide2.xml.rels", F.lit(rels(("rId7", "../media/a.png"), ("rId8", "../media/lost.png")))),
            entry("ppt/slides/_rels/slide1.xml.rels", F.lit(rels(("rId7", "../media/b.png")))),
            entry("ppt/media/a.png", F.col("p_type")), entry("ppt/media/b.png", F.lit("b")),
        ).alias("parts"),
    )))


def dps_parts(part: DataFrame) -> DataFrame:
    """WPS deck per part row with default and explicit names, shared strings, shapes, an image and media."""
    body = cat('<slide><shape id="s1" type="circle" x="', F.col("p_size"), '" y="200" width="300"/><shape id="s2"/><text><t>#1</t></text><text><t>#9</t></text><text><t>',
               F.col("p_name"), '</t></text><text/><image ref="img1" x="5"/></slide>')
    return pack(part.select(
        cat("p", F.col("p_partkey"), ".dps").alias("path"),
        F.array(
            entry("Presentation.xml", F.lit('<deck><slides><slide/><slide id="7" name="Two" filename="s.xml"/><slide filename="none.xml"/></slides></deck>')),
            entry("SharedStrings.xml", cat("<sst><si><t>zero</t></si><si><t>", F.col("p_brand"), "</t></si><si/></sst>")),
            entry("2.xml", body), entry("s.xml", F.lit("<slide><text><t>plain</t></text></slide>")), entry("media/one.PNG", F.col("p_type")), entry("media/two.bin", F.lit("xx")),
        ).alias("parts"),
    ))


def epub_documents(docs: DataFrame) -> DataFrame:
    """Book per document: a chapter per line, a nested contents tree, an image, metadata."""
    line = lines_of(F.col("text"))
    item = F.transform(line, lambda v, i: cat('<item id="c', i, '" href="text/c', i, '.xhtml" media-type="application/xhtml+xml"/>'))
    ref = F.transform(line, lambda v, i: cat('<itemref idref="c', i, '"/>'))
    # even chapters are top-level points, the odd one after each is its child
    point = F.transform(line, lambda v, i: cat(
        '<navPoint id="n', i, '"><navLabel><text> Chapter ', i, ' &amp; </text></navLabel><content src="text/c', i, '.xhtml"/>',
        F.when((i % 2 == 0) & (i + 1 < F.size(line)), "").when(i % 2 == 0, "</navPoint>").otherwise("</navPoint></navPoint>")))
    opf = cat(
        _HEAD, '<package xmlns:dc="urn:dc"><metadata><dc:title>', xml_escape(F.substring(F.get(line, F.lit(0)), 1, 20)), "</dc:title><dc:creator>", F.col("source"), "</dc:creator><dc:language>", F.col("lang"),
        '</dc:language></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="cover" href="img/cover.jpg" media-type="image/jpeg"/>'
        '<item id="lost" href="img/lost.png" media-type="image/png"/><item id="gone" href="gone.xhtml" media-type="x"/>', F.array_join(item, ""),
        '</manifest><spine toc="ncx"><itemref idref="nowhere"/><itemref idref="gone"/>', F.array_join(ref, ""), "</spine></package>",
    )
    chapters = F.transform(line, lambda v, i: entry(cat("OEBPS/text/c", i, ".xhtml"), cat(
        "<html><head><title>Chapter ", i, " &amp;</title><style>s</style></head><body><p>", xml_escape(v), "</p></body></html>")))
    return damage(pack(docs.select(
        cat("d", F.col("doc_id"), ".epub").alias("path"),
        F.concat(F.array(
            entry("META-INF/container.xml", F.lit('<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')),
            entry("OEBPS/content.opf", opf), entry("OEBPS/toc.ncx", cat("<ncx><navMap>", F.array_join(point, ""), "</navMap></ncx>")), entry("OEBPS/img/cover.jpg", F.col("source")),
        ), chapters).alias("parts"),
    )))


def ofd_documents(docs: DataFrame) -> DataFrame:
    """OFD per document: a page per line with hex and plain text, an image and a path; one listed page has no content.

    A plain line that reads as hex pairs itself is written in hex, or it would be decoded.
    """
    line = lines_of(F.col("text"))
    head = F.hex(F.encode(F.regexp_replace("lang", "[^a-z]", ""), "UTF-8"))
    page = F.transform(line, lambda v, i: F.when(i == 0, '<ofd:Page ID="first" BaseLoc="x"/>').otherwise('<ofd:Page BaseLoc="x"/>'))
    body = F.transform(line, lambda v, i: entry(cat("Doc_0/Pages/Page_", i, "/Content.xml"), cat(
        '<ofd:Page xmlns:ofd="urn:ofd">', F.when(i % 2 == 0, "<ofd:Area><ofd:PhysicalBox>0 0 100 0</ofd:PhysicalBox></ofd:Area>").otherwise(""),
        '<ofd:Content><ofd:Layer><ofd:PathObject ID="3" Boundary="1 2 3 4" LineWidth="0.5"><ofd:StrokeColor Value="#FF0000"/></ofd:PathObject><ofd:TextObject ID="1" Boundary="', i, ' 5 6.5 7"><ofd:TextCode X="0" Y="1">',
        head, "</ofd:TextCode><ofd:TextCode>", F.when(v.rlike("^(?:[0-9A-Fa-f]{2})+\\z"), F.hex(F.encode(v, "UTF-8"))).otherwise(xml_escape(v)), '</ofd:TextCode></ofd:TextObject><ofd:ImageObject ID="2" ResourceID="res', i % 2, '"/></ofd:Layer></ofd:Content></ofd:Page>')))
    return damage(pack(docs.select(
        cat("d", F.col("doc_id"), ".ofd").alias("path"),
        F.concat(F.array(
            entry("OFD.xml", F.lit('<ofd:OFD xmlns:ofd="urn:ofd" Version="1.1"/>')),
            entry("Doc_0/Document.xml", cat('<ofd:Document xmlns:ofd="urn:ofd"><ofd:CommonData><ofd:Title>', F.col("source"), "</ofd:Title><ofd:Creator>", F.col("lang"), "</ofd:Creator></ofd:CommonData></ofd:Document>")),
            entry("Doc_0/Pages.xml", cat('<ofd:Pages xmlns:ofd="urn:ofd">', F.array_join(page, ""), "<ofd:Page/></ofd:Pages>")),
            entry("Doc_0/Res/a_res1.png", F.col("source")), entry("Doc_0/Res/b_res1.png", F.lit("second")),
        ), body).alias("parts"),
    )))


def _pdf(path: str, lines: list[str], title: str) -> bytes:
    """One page per ten lines; odd pages use two compressed streams, even pages one plain stream."""
    import zlib

    out, n = bytearray(b"%PDF-1.7\n"), 4
    pages, bodies = [], []
    for k in range(0, len(lines), 10):
        shown = [("(" + x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ") Tj").encode("latin-1", "replace") for x in lines[k:k + 10]]
        text = b"BT\n/F1 12 Tf\n" + b"\n".join(shown) + b"\nET"
        number = k // 10
        if number % 2:
            halves = [zlib.compress(text), zlib.compress(b"/Im1 Do\n[(a) -20 (\\142)] TJ")]
            streams = [b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(h), h) for h in halves]
        else:
            streams = [b"<< /Length %d >>\nstream\n%s\nendstream" % (len(text), text)]
        refs = list(range(n + 1, n + 1 + len(streams)))
        where = b"[ %s ]" % b" ".join(b"%d 0 R" % r for r in refs) if len(refs) > 1 else b"%d 0 R" % refs[0]
        box = b" /MediaBox [0 0 %d 400.4]" % (100 + number) if number % 2 else b""
        bodies.append((n, b"<< /Type /Page /Parent 2 0 R%s /Contents %s >>" % (box, where)))
        bodies += list(zip(refs, streams, strict=True))
        pages.append(n)
        n += 1 + len(streams)
    kids = b" ".join(b"%d 0 R" % p for p in pages)
    head = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages))),
            (3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")]
    info = [(n, b"<< /Title (%s \\(x\\)) /Producer (lake) >>" % title.encode("latin-1", "replace")), (n + 1, b"<< /Type /Font /Subtype /TrueType /BaseFont /Odd+Sans /Encoding /MacRomanEncoding >>")]
    for number, body in head[:1] + bodies[::-1] + head[1:] + info:
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    out += b"xref\n0 1\n0000000000 65535 f \ntrailer\n<< /Size %d /Root 1 0 R /Info %d 0 R%s >>\nstartxref\n0\n%%%%EOF\n" % (n + 2, n, b" /Encrypt 9 0 R" if "9" in path else b"")
    return bytes(out)


def pdf_documents(docs: DataFrame) -> DataFrame:
    """PDF per document: ten lines a page, characters outside Latin-1 replaced; the page objects lie in reverse order."""
    return _built(docs.select(cat("d", F.col("doc_id"), ".pdf").alias("path"), "text", "source"), lambda path, text, source: _pdf(path, text.split("\n"), source))


def _dense_pdf(path: str, lines: list[str]) -> bytes:
    """A page per line, its whole program on one line, under a two-level page tree whose nodes state boxes and a rotation.

    Every third page has a box of its own, the second half takes its node's box by reference.  The first page's old
    version is a plain object, its newer one lies in an object stream.  Files whose number ends in 7 have a last page
    whose compressed content ends early.
    """
    import zlib

    objects: list[tuple[int, bytes]] = []
    n, half = 10, (len(lines) + 1) // 2
    pages = []
    for k, line in enumerate(lines):
        word = line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("latin-1", "replace")
        program = b"BT /F1 12 Tf 10 20 Td (%s) Tj 14 TL (b(2)) ' 1 2 (c) \" [(d) -20 <65 66>] TJ ET q /Im1 Do Q BI /W 1 /H 1 ID (x) Tj EI" % word
        data = zlib.compress(program) if k % 2 else program
        objects.append((n + 1, b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if k % 2 else b"", data)))
        box = b" /MediaBox [ 0 0 %d 70 ]" % (50 + k) if k % 3 == 2 else b""
        objects.append((n, b"<< /Type /Page /Parent %d 0 R%s /Contents %d 0 R >>" % (2 if k < half else 3, box, n + 1)))
        pages.append(n)
        n += 2
    if path.split(".")[0].endswith("7"):
        data = zlib.compress(b"(kept) Tj " + b" " * 4000, 0)[:2000]
        objects += [(n, b"<< /Type /Page /Contents %d 0 R >>" % (n + 1)), (n + 1, b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data))]
        pages.append(n)
        n += 2
    refs = lambda nodes: b" ".join(b"%d 0 R" % p for p in nodes)
    first = dict(objects)[10]
    packed = zlib.compress(b"10 0 5 %d " % (len(first) + 1) + first + b"\n<< /S /T >>")
    start = len(b"10 0 5 %d " % (len(first) + 1))
    head = [
        (1, b"<< /Type /Catalog /Pages 4 0 R >>"), (4, b"<< /Type /Pages /Kids [ 2 0 R 3 0 R ] /MediaBox [0 0 300 500.4] /Rotate 90 >>"),
        (2, b"<< /Type /Pages /Parent 4 0 R /Kids [%s] /Resources << /Font << /F1 7 0 R >> >> >>" % refs(pages[:half])),
        (3, b"<< /Type /Pages /Parent 4 0 R /Kids [%s] /MediaBox 6 0 R /Rotate 0 >>" % refs(pages[half:])), (6, b"[ 10 10 210 410 ]"),
        (10, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 9 9] /Contents 11 0 R >>"),
    ]
    out = bytearray(b"%PDF-1.7\n")
    for number, body in head + [o for o in objects if o[0] != 10]:
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    out += b"8 0 obj\n<< /Type /ObjStm /N 2 /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (start, len(packed), packed)
    return bytes(out + b"trailer\n<< /Root 1 0 R >>\nstartxref\n0\n%%EOF\n")


def dense_pdfs(docs: DataFrame) -> DataFrame:
    """PDF per document by :func:`_dense_pdf`."""
    return _built(docs.select(cat("d", F.col("doc_id"), ".pdf").alias("path"), "text"), lambda path, text: _dense_pdf(path, text.split("\n")))


def mixed_lake(docs: DataFrame) -> DataFrame:
    """``files(path, length, content)`` of nine kinds, one per document: text formats, packages (some damaged), and files nobody reads."""
    kind = F.col("doc_id") % 9
    of = lambda k: docs.where(kind == k)
    plain = docs.where(kind > 1).select(
        cat("d", F.col("doc_id"), F.element_at(F.array(*[F.lit(e) for e in (".json", ".csv", ".txt", "", ".json", ".lake", ".xyz")]), (kind - 1).cast("int"))).alias("path"),
        F.when(kind == 2, F.to_json(F.struct("lang", "source"))).when(kind == 3, cat("lang,source\n", F.col("lang"), ",", F.col("source"), "\n"))
        .when(kind == 5, cat("LAKE", F.col("text"))).when(kind == 6, cat("{", F.col("source"))).otherwise(F.col("text")).cast("binary").alias("content"),
    )
    files = xlsx_documents(of(0)).unionByName(epub_documents(of(1))).unionByName(plain)
    return files.withColumn("length", F.octet_length("content").cast("bigint"))


def as_files(rows: DataFrame) -> DataFrame:
    """Hand built bytes over as if a scan had read them: the optimizer must not fold their construction into the parsers."""
    return arrow_stage(rows, lambda batches: batches, rows.schema)
