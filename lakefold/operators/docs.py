"""Word-processor packages: paragraphs, runs, tables, styles, images, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import at, let, prefix_sums, whole
from ..functions.formats import mime_of
from ..functions.markup import (
    RELS_SCHEMA, attribute, elements, first_element, first_part_text, has_element, leading_int, part, part_struct, part_text,
    plain_markup, resolve_target, text_content, texts_of,
)
from ..functions.scalars import parse_hex_color
from ..functions.text import is_blank, word_count
from ..functions.xmltext import is_valid_xml, xml_fault
from ..sources.archive import open_packages
from .faults import fault, package_errors

DOCX_PARTS = r"(^|/)document\.xml$|^word/(styles\.xml|_rels/document\.xml\.rels)$"
DOCX_PARTS_WITH_MEDIA = DOCX_PARTS + r"|^word/media/|^media/"
WPS_PARTS = r"^(document|doc|content|styles?)\.xml$"

_VAL = "(?:\\w+:)?val"
_PARAGRAPH = "<(?:\\w+:)?p(?:\\s[^>]*?)?(?:/>|>.*?</(?:\\w+:)?p\\s*>)"
_BOX = "(?s)<(?:\\w+:)?txbxContent(?:\\s[^>]*)?>.*?</(?:\\w+:)?txbxContent\\s*>"


def open_documents(files: DataFrame, media: bool = False) -> DataFrame:
    return open_packages(files, DOCX_PARTS_WITH_MEDIA if media else DOCX_PARTS)


def open_wps(files: DataFrame) -> DataFrame:
    return open_packages(files, WPS_PARTS)


def main_document(parts: Column) -> Column:
    """Markup of ``word/document.xml``, else of the first part whose name ends that way; null if malformed."""
    other = at(F.filter(F.map_keys(parts), lambda k: k.endswith("document.xml")), 0)
    return let(F.coalesce(part_text(parts, "word/document.xml"), part_text(parts, other)), lambda t: F.when(is_valid_xml(t), plain_markup(t)))


def _blocks(markup: Column) -> Column:
    """``array<struct<par, in_table>>`` of paragraph markup in document order, text boxes last."""
    body = F.regexp_replace(markup, _BOX, "")
    marks = F.regexp_extract_all(body, F.lit(f"(?s)({_PARAGRAPH}|<(?:\\w+:)?tbl(?=[\\s>])|</(?:\\w+:)?tbl\\s*>)"), F.lit(1))
    step = lambda m: F.when(m.rlike("^<(?:\\w+:)?tbl"), 1).when(m.rlike("^</(?:\\w+:)?tbl"), -1).otherwise(0)
    placed = let(marks, lambda ms: F.zip_with(
        ms, prefix_sums(F.transform(ms, step)), lambda m, d: F.struct(m.alias("par"), (d > 0).alias("in_table"))))
    paragraphs = F.filter(placed, lambda b: ~b["par"].rlike("^</?(?:\\w+:)?tbl"))
    boxed = F.transform(
        F.flatten(F.transform(elements(markup, "txbxContent"), lambda b: elements(b, "p"))),
        lambda p: F.struct(p.alias("par"), F.lit(False).alias("in_table")),
    )
    return F.concat(paragraphs, boxed)


def _run(run: Column) -> Column:
    def styled(style: Column) -> Column:
        value = lambda tag: attribute(first_element(style, tag), _VAL)
        return F.struct(
            F.array_join(texts_of(run, "t"), "").alias("text"),
            F.coalesce(has_element(style, "b"), F.lit(False)).alias("bold"),
            F.coalesce(has_element(style, "i"), F.lit(False)).alias("italic"),
            value("u").alias("underline"),
            (leading_int(value("sz")) / 2).alias("font_size"),
            let(value("color"), lambda c: F.when(~c.isin("auto", ""), F.concat(F.lit("#"), c))).alias("color"),
            attribute(first_element(style, "rFonts"), "(?:\\w+:)?ascii").alias("font_family"),
        )

    return let(first_element(run, "rPr"), styled)


def _runs(paragraph: Column) -> Column:
    return F.filter(F.transform(elements(paragraph, "r"), _run), lambda r: r["text"] != "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(path, par_no, text, align, in_table, runs)`` of paragraphs that have text runs."""
    markup = docs.select("path", main_document(F.col("parts")).alias("xml"))
    read = markup.select("path", F.filter(
        F.transform(_blocks(F.col("xml")), lambda b: F.struct(
            _runs(b["par"]).alias("runs"),
            attribute(first_element(first_element(b["par"], "pPr"), "jc"), _VAL).alias("align"),
            b["in_table"].alias("in_table"))),
        lambda p: F.size(p["runs"]) > 0,
    ).alias("pars"))
    return read.select("path", F.posexplode(whole("pars")).alias("par_no", "p")).select(
        "path", "par_no", F.array_join(F.transform("p.runs", lambda r: r["text"]), "").alias("text"),
        F.col("p.align").alias("align"), F.col("p.in_table").alias("in_table"), F.col("p.runs").alias("runs"),
    )


def paragraphs_errors(docs: DataFrame) -> DataFrame:
    """``(path, part, error)``: packages that do not open, and those whose main document is missing or malformed."""
    parts = F.col("parts")
    name = F.when(F.map_contains_key(parts, F.lit("word/document.xml")), F.lit("word/document.xml")).otherwise(
        at(F.filter(F.map_keys(parts), lambda k: k.endswith("document.xml")), 0))
    return package_errors(docs, let(F.coalesce(name, F.lit("word/document.xml")), lambda n: F.array(fault(n, xml_fault(part_text(parts, n))))))


def runs(docs: DataFrame) -> DataFrame:
    """``(path, par_no, run_no, text, bold, italic, underline, font_size, color, font_family)``."""
    return paragraphs(docs).select("path", "par_no", F.posexplode(whole("runs")).alias("run_no", "r")).select("path", "par_no", "run_no", "r.*")


def paragraphs_trimmed(docs: DataFrame) -> DataFrame:
    """Paragraphs with visible text and one merged style each: any bold run makes it bold, the last size and colour win.

    Only the first text of a run counts, and styles of runs without text count too.
    """
    def styled(run: Column) -> Column:
        return let(first_element(run, "rPr"), lambda style: F.struct(
            F.coalesce(text_content(first_element(run, "t")), F.lit("")).alias("text"),
            F.coalesce(has_element(style, "b"), F.lit(False)).alias("bold"), F.coalesce(has_element(style, "i"), F.lit(False)).alias("italic"),
            F.coalesce(has_element(style, "u"), F.lit(False)).alias("underline"),
            (leading_int(attribute(first_element(style, "sz"), _VAL)) / 2).alias("size"),
            F.nullif(attribute(first_element(style, "color"), _VAL), F.lit("")).alias("color"),
        ))

    last = lambda rs, field: F.element_at(F.concat(F.array(F.lit(None)), F.filter(F.transform(rs, lambda r: r[field]), lambda v: v.isNotNull())), -1)
    read = docs.select("path", F.transform(_blocks(main_document(F.col("parts"))), lambda b: F.transform(elements(b["par"], "r"), styled)).alias("pars"))
    rs = F.col("rs")
    return (
        read.select("path", F.posexplode(whole("pars")).alias("par_no", "rs"))
        .select(
            "path", "par_no", F.array_join(F.transform(rs, lambda r: r["text"]), "").alias("text"),
            F.exists(rs, lambda r: r["bold"]).alias("bold"), F.exists(rs, lambda r: r["italic"]).alias("italic"),
            F.exists(rs, lambda r: r["underline"]).alias("underline"), last(rs, "size").alias("font_size"),
            let(last(rs, "color"), lambda c: F.when(c.isNotNull(), parse_hex_color(c))).alias("color"),
        )
        .filter(~is_blank(F.col("text")))
    )


def _tables(markup: Column, tag: str = "tbl") -> Column:
    """``array<struct<markup, depth>>`` of all tables in document order.

    Tables nest, so the text is split at table borders and a table is the pieces from its start
    to the piece where its depth closes; inner tables' own tags are renamed within it.
    """
    pieces = F.split(markup, f"(?=<(?:\\w{{1,20}}:)?{tag}[\\s>])|(?<=</{tag}>)|(?<=</\\w{{1,20}}:{tag}>)", -1)
    opens = f"^<(?:\\w+:)?{tag}[\\s>]"
    closes = f"</(?:\\w+:)?{tag}>$"
    marked = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i"), p.rlike(opens).alias("opens"), p.rlike(closes).alias("closes")))

    def place(ms: Column) -> Column:
        steps = F.transform(ms, lambda m: m["opens"].cast("int") - m["closes"].cast("int"))
        return F.zip_with(ms, prefix_sums(steps), lambda m, d: F.struct(
            m["p"].alias("p"), m["i"].alias("i"), m["opens"].alias("opens"), m["closes"].alias("closes"), (d + m["opens"].cast("int")).alias("depth")))

    def assemble(laid: Column, start: Column) -> Column:
        end = at(F.filter(laid, lambda q: (q["i"] >= start["i"]) & (q["depth"] == start["depth"]) & q["closes"]), 0)["i"]
        inside = F.slice(laid, start["i"] + 1, F.coalesce(end, F.size(laid) - 1) - start["i"] + 1)
        renamed = F.transform(inside, lambda q: F.when(
            q["depth"] > start["depth"], F.regexp_replace(q["p"], f"<(/?)((?:\\w+:)?)(tr|tc|{tag})(?=[\\s>/])", "<$1$2$3_inner")
        ).otherwise(q["p"]))
        return F.struct(F.array_join(renamed, "").alias("markup"), start["depth"].alias("depth"))

    return let(let(marked, place), lambda laid: F.transform(F.filter(laid, lambda p: p["opens"]), lambda start: assemble(laid, start)))


def doc_tables(docs: DataFrame) -> DataFrame:
    """``(path, table_no, depth, row_no, col_no, text)``: each table once, nested ones with depth 2 and more."""
    read = docs.select("path", F.posexplode(_tables(main_document(F.col("parts")))).alias("table_no", "t"))
    rows = read.select("path", "table_no", "t.depth", F.posexplode(elements(F.col("t.markup"), "tr")).alias("row_no", "tr"))
    cells = rows.select("path", "table_no", "depth", "row_no", F.posexplode(elements(F.col("tr"), "tc")).alias("col_no", "tc"))
    return cells.select("path", "table_no", "depth", "row_no", "col_no", F.array_join(texts_of(F.col("tc"), "t"), "").alias("text"))


_STYLES = "style ARRAY<STRUCT<_styleId: STRING, _type: STRING, name: STRUCT<_val: STRING>, basedOn: STRUCT<_val: STRING>>>"


def _style_list(parts: Column) -> Column:
    listed = part_struct(parts, "word/styles.xml", _STYLES)["style"]
    kept = F.filter(listed, lambda s: (F.coalesce(s["_styleId"], F.lit("")) != "") & (F.coalesce(s["_type"], F.lit("")) != ""))
    return F.transform(kept, lambda s: F.struct(
        s["_styleId"].alias("style_id"), s["_type"].alias("type"), F.coalesce(s["name"]["_val"], F.lit("")).alias("name"),
        F.coalesce(s["basedOn"]["_val"], F.lit("")).alias("based_on")))


def doc_styles(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.inline(_style_list(F.col("parts"))))


def _relationships(parts: Column) -> Column:
    rels = part_struct(parts, "word/_rels/document.xml.rels", RELS_SCHEMA)["Relationship"]
    return F.transform(rels, lambda r: F.struct(r["_Id"].alias("id"), r["_Type"].alias("type"), r["_Target"].alias("target")))


def doc_relationships(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.inline(_relationships(F.col("parts"))))


def doc_images(docs: DataFrame) -> DataFrame:
    """``(path, id, mime_type, original_path, part, data)`` of image relationships whose part exists."""
    parts = F.col("parts")
    images = F.transform(
        F.filter(_relationships(parts), lambda r: F.contains(r["type"], F.lit("image"))),
        lambda r: F.struct(r["id"].alias("id"), mime_of(r["target"], "word").alias("mime_type"), r["target"].alias("original_path"),
                           resolve_target("word/", r["target"]).alias("part"), part(parts, resolve_target("word/", r["target"])).alias("data")),
    )
    return docs.select("path", F.inline(F.filter(images, lambda i: i["data"].isNotNull())))


# Paragraph style names and the element each becomes.
STYLE_MAP = {"title": "h1", "heading 1": "h2", "heading 2": "h3", "heading 3": "h4", "heading 4": "h4", "heading 5": "h5",
             "heading 6": "h6", "normal": "p"}
STRONG_STYLES = ["strong"]


def docx_html(docs: DataFrame, style_map: dict[str, str] = STYLE_MAP) -> DataFrame:
    """``(path, html, raw_text, warnings, errors)``: styled HTML, plain text and messages split by type.

    Paragraph styles are resolved by name; unmapped named styles become ``p`` with a warning.
    """
    parts = F.col("parts")
    opened = docs.select("path", "error", main_document(parts).alias("xml"), _style_list(parts).alias("styles"))
    token = F.lit(f"(?s)({_PARAGRAPH}|</?(?:\\w+:)?(?:tbl|tr|tc)(?=[\\s>])[^>]*>)")
    boxes = F.transform(elements(F.col("xml"), "txbxContent"), lambda b: F.regexp_extract_all(b, token, F.lit(1)))
    tokens = F.concat(F.regexp_extract_all(F.regexp_replace("xml", _BOX, ""), token, F.lit(1)), F.flatten(boxes))
    pairs = [F.lit(v) for kv in style_map.items() for v in kv]
    tags = F.create_map(*pairs)

    def style_name(style_id: Column) -> Column:
        return let(style_id, lambda sid: F.coalesce(at(F.filter("styles", lambda s: s["style_id"] == sid), 0)["name"], sid))

    def wrap(text: Column, tag: str) -> Column:
        return F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))

    def run_html(run: Column) -> Column:
        text = F.array_join(texts_of(run, "t"), "")
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(char), F.lit(entity))

        def dress(r: Column) -> Column:
            inner = let(F.when(r["em"], wrap(r["text"], "em")).otherwise(r["text"]),
                        lambda t: F.when(r["strong"], wrap(t, "strong")).otherwise(t))
            return F.when(r["text"] == "", F.lit("")).otherwise(inner)

        return let(first_element(run, "rPr"), lambda props: let(
            F.struct(
                text.alias("text"), F.coalesce(has_element(props, "i"), F.lit(False)).alias("em"),
                F.coalesce(has_element(props, "b") | F.lower(style_name(attribute(first_element(props, "rStyle"), _VAL))).isin(*STRONG_STYLES),
                           has_element(props, "b"), F.lit(False)).alias("strong"),
            ), dress))

    def paragraph_html(t: Column) -> Column:
        named = style_name(attribute(first_element(first_element(t, "pPr"), "pStyle"), _VAL))
        found = F.struct(named.alias("name"), F.array_join(F.transform(elements(t, "r"), run_html), "").alias("inner"))

        def build(p: Column) -> Column:
            tag = F.coalesce(F.try_element_at(tags, F.lower(p["name"])), F.lit("p"))
            return F.struct(
                F.when(p["inner"] != "", let(tag, lambda g: F.concat(F.lit("<"), g, F.lit(">"), p["inner"], F.lit("</"), g, F.lit(">")))).otherwise("").alias("html"),
                F.concat(F.array_join(texts_of(t, "t"), ""), F.lit("\n\n")).alias("text"),
                F.when(~F.map_contains_key(tags, F.lower(p["name"])), p["name"]).alias("unknown"),
            )

        return let(found, build)

    def token_html(t: Column) -> Column:
        kind = F.regexp_extract(t, "^</?(?:\\w+:)?(tbl|tr|tc)(?=[\\s>])", 1)
        tag = F.when(kind == "tbl", "table").when(kind == "tr", "tr").when(kind == "tc", "td")
        border = F.struct(
            F.concat(F.when(t.startswith("</"), "</").otherwise("<"), tag, F.lit(">")).alias("html"), F.lit("").alias("text"),
            F.lit(None).cast("string").alias("unknown"),
        )
        return F.when(kind != "", border).otherwise(paragraph_html(t))

    made = opened.select("path", "error", F.transform(tokens, token_html).alias("made"))
    return made.select(
        "path", F.array_join(F.transform("made", lambda m: m["html"]), "").alias("html"),
        F.array_join(F.transform("made", lambda m: m["text"]), "").alias("raw_text"),
        F.transform(F.array_distinct(F.filter(F.transform("made", lambda m: m["unknown"]), lambda u: u.isNotNull())),
                    lambda u: F.concat(F.lit("Unrecognised paragraph style: "), u)).alias("warnings"),
        F.filter(F.array("error"), lambda e: e.isNotNull()).alias("errors"),
    )


def doc_info(files: DataFrame, docs: DataFrame) -> DataFrame:
    """``(path, file_size, word_count, char_count)`` of the plain text.

    Sizes come from the file table and meet the text by path (one row each side).
    """
    texts = docx_html(docs).select("path", "raw_text")
    sizes = files.select("path", F.octet_length("content").cast("bigint").alias("file_size"))
    return texts.join(sizes, "path").select(
        "path", "file_size", word_count(F.col("raw_text")).alias("word_count"), F.length("raw_text").cast("bigint").alias("char_count")
    )


# ------------------------------------------------------------------ WPS


def _wps_text(p: Column) -> Column:
    texts = F.filter(texts_of(p, "t"), lambda t: t != "")
    return let(texts, lambda ts: F.when(F.size(ts) > 0, F.array_join(ts, "")).otherwise(text_content(p)))


def _wps_paragraph(p: Column) -> Column:
    align = F.coalesce(*[F.nullif(attribute(p, n), F.lit("")) for n in ("align", "text-align", "w:jc", "jc")])
    return F.struct(_wps_text(p).alias("text"), align.alias("align"))


def _wps_main(parts: Column) -> Column:
    return let(first_part_text(parts, ["document.xml", "doc.xml", "content.xml"]), lambda t: F.when(is_valid_xml(t), plain_markup(t)))


def wps_content(docs: DataFrame) -> DataFrame:
    """``(path, kind, block_no, row_no, col_no, text, align)``: paragraphs, or table cells where a file has none."""
    opened = docs.select("path", _wps_main(F.col("parts")).alias("xml"))
    pars = F.filter(F.transform(elements(F.col("xml"), "p"), _wps_paragraph), lambda p: p["text"] != "")
    split = opened.select("path", "xml", pars.alias("pars"))
    as_rows = split.select("path", F.posexplode(whole("pars")).alias("block_no", "p")).select(
        "path", F.lit("paragraph").alias("kind"), "block_no", F.lit(None).cast("int").alias("row_no"), F.lit(None).cast("int").alias("col_no"), "p.text", "p.align"
    )
    tables = split.filter(F.size("pars") == 0).select("path", F.posexplode(_tables(F.col("xml"), "table")).alias("block_no", "t"))
    either = lambda c, *names: F.coalesce(*[let(elements(c, n), lambda e: F.when(F.size(e) > 0, e)) for n in names])
    rows = tables.select("path", "block_no", F.posexplode(either(F.col("t.markup"), "row", "tr")).alias("row_no", "row"))
    cells = rows.select("path", "block_no", "row_no", F.posexplode(either(F.col("row"), "cell", "td", "tc")).alias("col_no", "cell"))
    as_cells = cells.select("path", F.lit("table").alias("kind"), "block_no", "row_no", "col_no", _wps_text(F.col("cell")).alias("text"),
                            F.lit(None).cast("string").alias("align"))
    return as_rows.unionByName(as_cells)


def wps_errors(docs: DataFrame) -> DataFrame:
    """``(path, part, error)``: packages that do not open, and those whose main part is missing or malformed."""
    names = ["document.xml", "doc.xml", "content.xml"]
    name = F.coalesce(*[F.when(F.map_contains_key("parts", F.lit(n)), F.lit(n)) for n in names], F.lit(names[0]))
    return package_errors(docs, F.array(fault(name, xml_fault(first_part_text(F.col("parts"), names)))))


def wps_styles(docs: DataFrame) -> DataFrame:
    """``(path, style_id, attributes)`` with all attributes of the style element as a map."""
    listed = elements(first_part_text(F.col("parts"), ["styles.xml", "style.xml"]), "style")
    head = F.regexp_extract("style", "(?s)^<[^>]*>", 0)
    pair = "([\\w:.-]+)\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)')"
    names = F.regexp_extract_all(head, F.lit(pair), F.lit(1))
    values = F.zip_with(F.regexp_extract_all(head, F.lit(pair), F.lit(2)), F.regexp_extract_all(head, F.lit(pair), F.lit(3)), lambda a, b: F.concat(a, b))
    rows = docs.select("path", F.explode(listed).alias("style")).select(
        "path", F.coalesce(F.nullif(attribute(F.col("style"), "id"), F.lit("")), F.nullif(attribute(F.col("style"), "name"), F.lit(""))).alias("style_id"),
        F.map_from_arrays(names, values).alias("attributes"),
    )
    return rows.filter("style_id IS NOT NULL")
