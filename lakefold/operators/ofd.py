"""OFD packages: pages, page elements, resources, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import at, let, whole
from ..functions.markup import attribute, elements, first_element, leading_float, part_text, plain_markup, text_content
from ..functions.xmltext import is_valid_xml
from ..sources.archive import archive_parts, open_packages
from .faults import fault, package_errors, part_faults

OFD_PARTS = r"^(OFD\.xml|Doc_0/(Document|Pages)\.xml|Doc_0/Pages/Page_.*)$"
OFD_RESOURCES = "Doc_0/Res/"


def open_ofd(files: DataFrame, resources: bool = False) -> DataFrame:
    """One row per package; with ``resources`` its resource files come along."""
    return open_packages(files, f"{OFD_PARTS}|^{OFD_RESOURCES}" if resources else OFD_PARTS)


def _page_list(parts: Column) -> Column:
    return elements(first_element(F.coalesce(part_text(parts, "Doc_0/Pages.xml"), first_element(part_text(parts, "Doc_0/Document.xml"), "Pages")), "Pages"), "Page")


def _loaded_pages(parts: Column) -> Column:
    """Array of ``(page_no, id, xml)`` with the markup as it is stored."""
    return F.transform(_page_list(parts), lambda p, i: F.struct(
        i.alias("page_no"), F.coalesce(F.nullif(attribute(p, "ID"), F.lit("")), F.concat(F.lit("Page_"), i.cast("string"))).alias("id"),
        part_text(parts, F.concat(F.lit("Doc_0/Pages/Page_"), i.cast("string"), F.lit("/Content.xml"))).alias("xml"),
    ))


def _readable(xml: Column) -> Column:
    return F.when(is_valid_xml(xml), plain_markup(xml))


def _page_rows(docs: DataFrame) -> DataFrame:
    """``(path, page_no, id, xml)``; markup is null where a page's content is missing or malformed."""
    return docs.select("path", F.inline(_loaded_pages(F.col("parts")))).withColumn("xml", _readable(F.col("xml")))


def pages_errors(docs: DataFrame) -> DataFrame:
    """``(path, part, error)``: packages that do not open or list no pages, and pages whose content is missing or malformed."""
    parts = F.col("parts")
    named = _page_list(parts)
    content = lambda i: F.concat(F.lit("Doc_0/Pages/Page_"), i.cast("string"), F.lit("/Content.xml"))
    listed = F.transform(named, lambda p, i: F.struct(content(i).alias("part")))
    none = F.array(fault("Doc_0/Pages.xml", F.when(F.coalesce(F.size(named), F.lit(0)) <= 0, "no pages listed")))
    return package_errors(docs, none, part_faults(listed, "part", lambda p: part_text(parts, p["part"])))


def _or_default(value: Column, default: float) -> Column:
    """Zero and unreadable numbers take the default, as they do in the source rule."""
    return let(value, lambda v: F.when(v.isNull() | (v == 0), F.lit(float(default))).otherwise(v))


def ofd_pages(docs: DataFrame) -> DataFrame:
    """``(path, page_no, id, width, height, element_count)``, 210 by 297 where no box is stated."""
    box = F.split(text_content(first_element(first_element(F.col("xml"), "Area"), "PhysicalBox")), " ")
    older = F.split(text_content(first_element(first_element(F.col("xml"), "PageArea"), "PhysicalBox")), " ")
    count = sum((F.size(elements(F.col("xml"), t)) for t in ("TextObject", "ImageObject", "PathObject")), F.lit(0))
    rows = _page_rows(docs).withColumn("box", F.coalesce(older, box))
    return rows.select(
        "path", "page_no", "id", _or_default(leading_float(at(F.col("box"), 2)), 210).alias("width"),
        _or_default(leading_float(at(F.col("box"), 3)), 297).alias("height"),
        F.when(F.col("xml").isNull(), 0).otherwise(count).alias("element_count"),
    )


def text_decode(code: Column) -> Column:
    """Hex pairs to characters; text that is not hex stays as it is."""
    def one(t: Column) -> Column:
        return F.when(t.rlike("^(?:[0-9A-Fa-f]{2})+\\z"), F.decode(F.try_to_binary(t, F.lit("hex")), "ISO-8859-1")).otherwise(t)

    return let(code, one)


def ofd_elements(docs: DataFrame) -> DataFrame:
    """``(path, page_no, element_no, type, id, x, y, width, height, content, resource_id, stroke, fill, line_width)``.

    Per layer: texts, then images, then paths.
    """
    none = F.lit(None).cast("string")

    def common(e: Column, kind: str, width: float, height: float, content=none, resource=none, stroke=none, fill=none, line=None) -> Column:
        boundary = F.split(attribute(e, "Boundary"), " ")
        return let(boundary, lambda b: F.struct(
            F.lit(kind).alias("type"), attribute(e, "ID").alias("id"),
            _or_default(leading_float(at(b, 0)), 0).alias("x"), _or_default(leading_float(at(b, 1)), 0).alias("y"),
            _or_default(leading_float(at(b, 2)), width).alias("width"), _or_default(leading_float(at(b, 3)), height).alias("height"),
            content.alias("content"), resource.alias("resource_id"), stroke.alias("stroke"), fill.alias("fill"),
            (F.lit(None).cast("double") if line is None else line).alias("line_width"),
        ))

    def text(e: Column) -> Column:
        return common(e, "text", 100, 20, content=F.array_join(F.transform(elements(e, "TextCode"), lambda c: text_decode(text_content(c))), ""))

    def image(e: Column) -> Column:
        return common(e, "image", 100, 100, resource=attribute(e, "ResourceID"))

    def path(e: Column) -> Column:
        color = lambda tag, default: F.coalesce(F.nullif(attribute(first_element(e, tag), "Value"), F.lit("")), F.nullif(attribute(e, tag), F.lit("")), F.lit(default))
        return common(e, "path", 100, 100, stroke=color("StrokeColor", "#000000"), fill=color("FillColor", "#FFFFFF"),
                      line=_or_default(leading_float(attribute(e, "LineWidth")), 1))

    def layer(markup: Column) -> Column:
        return F.concat(F.transform(elements(markup, "TextObject"), text), F.transform(elements(markup, "ImageObject"), image),
                        F.transform(elements(markup, "PathObject"), path))

    rows = _page_rows(docs).select("path", "page_no", F.flatten(F.transform(elements(F.col("xml"), "Layer"), layer)).alias("found"))
    return rows.select("path", "page_no", F.posexplode(whole("found")).alias("element_no", "e")).select("path", "page_no", "element_no", "e.*")


def ofd_resources(docs: DataFrame) -> DataFrame:
    """``(path, page_no, element_no, resource_id, name, size)``: first part under the resource folder whose name contains the id.

    For packages opened with ``resources``: ids and names of a file meet inside its row.
    """
    parts = F.col("parts")
    stored = F.filter(F.map_keys(parts), lambda n: n.startswith(OFD_RESOURCES))

    def ids(markup: Column) -> Column:
        none = lambda e: F.lit(None).cast("string")
        return F.concat(F.transform(elements(markup, "TextObject"), none), F.transform(elements(markup, "ImageObject"), lambda e: attribute(e, "ResourceID")),
                        F.transform(elements(markup, "PathObject"), none))

    def used(page: Column) -> Column:
        numbered = F.transform(F.flatten(F.transform(elements(page["xml"], "Layer"), ids)), lambda r, i: F.struct(
            page["page_no"].alias("page_no"), i.alias("element_no"), r.alias("resource_id")))
        return F.filter(numbered, lambda e: F.coalesce(e["resource_id"], F.lit("")) != "")

    pages = F.transform(_loaded_pages(parts), lambda p: F.struct(p["page_no"].alias("page_no"), _readable(p["xml"]).alias("xml")))
    wanted = F.flatten(F.filter(F.transform(pages, used), lambda e: e.isNotNull()))
    named = let(stored, lambda names: F.transform(wanted, lambda e: F.struct(
        e["page_no"], e["element_no"], e["resource_id"], F.get(F.filter(names, lambda n: F.contains(n, e["resource_id"])), F.lit(0)).alias("name"))))
    sized = F.transform(named, lambda e: F.struct(
        e["page_no"].alias("page_no"), e["element_no"].alias("element_no"), e["resource_id"].alias("resource_id"), e["name"].alias("name"),
        F.octet_length(F.try_element_at(parts, e["name"])).cast("bigint").alias("size")))
    return docs.select("path", F.inline(whole(sized))).filter("name IS NOT NULL")


def ofd_resource_data(files: DataFrame, docs: DataFrame) -> DataFrame:
    """:func:`ofd_resources` with the bytes of each part as ``data``; these move in one join on file and name."""
    stored = archive_parts(files, f"^{OFD_RESOURCES}").filter("error IS NULL").groupBy("path", "name").agg(F.max_by("data", "entry_no").alias("data"))
    return ofd_resources(docs).join(stored, ["path", "name"])


def ofd_meta(docs: DataFrame) -> DataFrame:
    """version, doc_type, title, author, subject, keywords, dates and the number of page entries."""
    parts = F.col("parts")
    root = part_text(parts, "OFD.xml")
    common = first_element(part_text(parts, "Doc_0/Document.xml"), "CommonData")
    info = first_element(root, "DocInfo")
    rows = docs.filter("error IS NULL").select("path", "parts", root.alias("ofd"), common.alias("common"), info.alias("info"))

    def value(*tags: str) -> Column:
        found = [text_content(first_element(F.col(source), tag)) for tag in tags for source in ("common", "info")]
        return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit(""))

    own = first_element(F.col("ofd"), "OFD")
    return rows.select(
        "path", F.coalesce(F.nullif(attribute(own, "Version"), F.lit("")), F.lit("1.0")).alias("version"),
        F.coalesce(F.nullif(attribute(own, "DocType"), F.lit("")), F.lit("OFD")).alias("doc_type"),
        value("Title").alias("title"), value("Creator").alias("author"), value("Subject").alias("subject"), value("Keywords").alias("keywords"),
        value("CreationDate").alias("creation_date"), value("ModDate").alias("modification_date"),
        F.size(F.filter(F.map_keys(F.col("parts")), lambda k: k.startswith("Doc_0/Pages/Page_"))).alias("page_count"),
    )
