"""EPUB packages: container, manifest, spine chapters, contents tree, images, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, prefix_sums, tree_links, whole
from ..functions.html import html_text, html_title
from ..functions.markup import attribute, elements, first_element, part, part_text, plain_markup, text_content
from ..functions.scalars import basename, dirname
from ..functions.text import trim_space
from ..functions.xmltext import is_valid_xml, xml_fault
from ..sources.archive import open_packages
from .faults import fault, package_errors

CONTAINER = "META-INF/container.xml"


def open_books(files: DataFrame) -> DataFrame:
    """Packages with the parts chapters, images and navigation need; their names come from the manifest."""
    return open_packages(files)


def _opf_path(parts: Column) -> Column:
    markup = part_text(parts, CONTAINER)
    return F.nullif(attribute(first_element(markup, "rootfile"), "full-path"), F.lit(""))


def epub_container(books: DataFrame) -> DataFrame:
    """``(path, opf_path, error)``: where the package document is, or why it cannot be found."""
    markup, opf = part_text(F.col("parts"), CONTAINER), _opf_path(F.col("parts"))
    return books.select("path", "error", markup.alias("xml"), opf.alias("opf_path")).select(
        "path", "opf_path",
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("xml").isNull(), F.lit("container.xml not found"))
        .when(first_element(F.col("xml"), "rootfile").isNull(), F.lit("rootfile not found"))
        .when(F.col("opf_path").isNull(), F.lit("full-path attribute missing")).alias("error"),
    )


def _opened(books: DataFrame) -> DataFrame:
    """``(path, parts, dir, opf)`` of books whose package document is well-formed."""
    located = books.select("path", "parts", _opf_path(F.col("parts")).alias("opf_path"))
    read = located.select("path", "parts", dirname(F.col("opf_path")).alias("dir"), part_text(F.col("parts"), F.col("opf_path")).alias("opf"))
    return read.filter(is_valid_xml(F.col("opf"))).withColumn("opf", plain_markup(F.col("opf")))


def _items(opf: Column, directory: Column) -> Column:
    """Manifest items with id and href: ``array<struct<id, href, item_path, media_type>>``."""
    listed = F.transform(
        elements(first_element(opf, "manifest"), "item"),
        lambda i: F.struct(attribute(i, "id").alias("id"), attribute(i, "href").alias("href"), attribute(i, "media-type").alias("media_type")),
    )
    kept = F.filter(listed, lambda i: (F.coalesce(i["id"], F.lit("")) != "") & (F.coalesce(i["href"], F.lit("")) != ""))
    return F.transform(kept, lambda i: F.struct(
        i["id"].alias("id"), i["href"].alias("href"), F.concat(directory, i["href"]).alias("item_path"), i["media_type"].alias("media_type")))


def epub_manifest(books: DataFrame) -> DataFrame:
    """``(path, id, href, item_path, media_type)``."""
    return _opened(books).select("path", F.inline(_items(F.col("opf"), F.col("dir"))))


def epub_chapters(books: DataFrame) -> DataFrame:
    """``(path, chapter_no, title, content, html, item_path)`` in spine order.

    References without a manifest item or without a readable part are skipped.
    """
    spine = F.transform(elements(first_element(F.col("opf"), "spine"), "itemref"), lambda r: attribute(r, "idref"))
    prepared = _opened(books).select("path", "parts", _items(F.col("opf"), F.col("dir")).alias("items"), spine.alias("spine"))

    def resolve(idref: Column, pos: Column) -> Column:
        # the last of several items with one id wins
        item_path = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(
            F.filter("items", lambda i: i["id"] == idref), lambda i: i["item_path"])), -1)
        return let(item_path, lambda p: F.struct(pos.alias("pos"), p.alias("item_path"), part_text(F.col("parts"), p).alias("html")))

    found = F.filter(F.transform("spine", resolve), lambda c: c["html"].isNotNull())
    return prepared.select("path", F.posexplode(found).alias("chapter_no", "c")).select(
        "path", "chapter_no", html_title(F.col("c.html")).alias("title"), html_text(F.col("c.html")).alias("content"),
        F.col("c.html").alias("html"), F.col("c.item_path").alias("item_path"),
    )


def chapters_errors(books: DataFrame) -> DataFrame:
    """``(path, part, error)``: books that do not open, and reading-order references without an item or a part."""
    parts = F.col("parts")
    located = books.select("path", "parts", "error", _opf_path(parts).alias("opf_path"))
    read = located.withColumn("text", part_text(parts, F.col("opf_path"))).withColumn("opf", F.when(is_valid_xml(F.col("text")), F.col("text")))
    spine = F.transform(elements(first_element(F.col("opf"), "spine"), "itemref"), lambda r: attribute(r, "idref"))
    prepared = read.select("path", "parts", "error", "text", "opf", "opf_path", _items(F.col("opf"), dirname(F.col("opf_path"))).alias("items"), spine.alias("spine"))

    def check(idref: Column) -> Column:
        item = F.try_element_at(F.filter("items", lambda i: i["id"] == idref), F.lit(-1))
        return let(item, lambda i: F.when(i.isNull(), fault(idref, F.lit("no manifest item"))).otherwise(
            fault(i["item_path"], F.when(~F.map_contains_key(parts, i["item_path"]), "missing part"))))

    container = F.when(F.col("opf_path").isNull(), "no package document named")
    package = F.when(F.col("opf_path").isNotNull(), xml_fault(F.col("text")))
    return package_errors(prepared, F.array(fault(CONTAINER, container), fault(F.col("opf_path"), package)), F.transform("spine", check))


def epub_toc(books: DataFrame, flat: bool = False) -> DataFrame:
    """``(path, toc_no, depth, parent, title, src)`` of the navigation points.

    ``flat`` lists every point at the top level instead, without depth and parent.
    """
    parts, opf, items = F.col("parts"), F.col("opf"), F.col("items")
    prepared = _opened(books).select("path", "parts", "opf", _items(opf, F.col("dir")).alias("items"))
    ncx_id = attribute(first_element(opf, "spine"), "toc")
    ncx_path = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(
        F.filter(items, lambda i: i["id"] == ncx_id), lambda i: i["item_path"])), -1)
    ncx = prepared.select("path", part_text(parts, ncx_path).alias("ncx")).filter(is_valid_xml(F.col("ncx"))).withColumn("ncx", plain_markup(F.col("ncx")))
    # every piece after the first starts a point; the closing tags in it say how far the level falls
    pieces = F.split("ncx", "(?=<(?:\\w{1,20}:)?navPoint[\\s>])", -1)
    points = F.filter(pieces, lambda p: p.rlike("^<(?:\\w+:)?navPoint[\\s>]"))
    steps = F.transform("points", lambda p: F.lit(1) - F.regexp_count(p, F.lit("</(?:\\w+:)?navPoint\\s*>")))

    def point(z: Column, i: Column) -> Column:
        content = first_element(z["p"], "content")
        return F.struct(
            i.alias("toc_no"), (z["d"] + 1).alias("depth"), trim_space(text_content(first_element(first_element(z["p"], "navLabel"), "text"))).alias("title"),
            attribute(content, "src").alias("src"), content.isNotNull().alias("has_content"))

    listed = ncx.select("path", points.alias("points")).select("path", F.arrays_zip(F.col("points").alias("p"), prefix_sums(steps).alias("d")).alias("z"))
    kept = listed.select("path", F.filter(F.transform("z", point), lambda t: t["title"].isNotNull() & t["has_content"]).alias("kept"))
    if flat:
        return kept.select("path", F.inline(whole("kept"))).select("path", "toc_no", "title", "src")
    linked = F.zip_with("kept", tree_links(F.col("kept.depth")), lambda t, n: F.struct(
        t["toc_no"].alias("toc_no"), t["depth"].alias("depth"), t["title"].alias("title"), t["src"].alias("src"), F.get(F.col("kept"), n["parent"])["toc_no"].alias("parent")))
    return kept.select("path", F.inline(linked))


def epub_images(books: DataFrame) -> DataFrame:
    """``(path, id, file_name, item_path, media_type, size, data)`` of manifest images that have a part."""
    read = _opened(books).select("path", F.transform(
        F.filter(_items(F.col("opf"), F.col("dir")), lambda i: i["media_type"].startswith("image/")),
        lambda i: F.struct(i["id"].alias("id"), basename(i["href"]).alias("file_name"), i["item_path"].alias("item_path"),
                           i["media_type"].alias("media_type"), part(F.col("parts"), i["item_path"]).alias("data")),
    ).alias("images"))
    return read.select("path", F.inline(F.filter("images", lambda i: i["data"].isNotNull()))).withColumn(
        "size", F.octet_length("data").cast("bigint")
    )


# Metadata elements and the columns they fill.
_META = [("title", "title"), ("creator", "author"), ("language", "language"), ("publisher", "publisher"), ("date", "publish_date"),
         ("identifier", "identifier"), ("description", "description")]


def epub_meta(books: DataFrame) -> DataFrame:
    meta = _opened(books).select("path", first_element(F.col("opf"), "metadata").alias("m"))
    return meta.select("path", *[F.coalesce(text_content(first_element(F.col("m"), tag)), F.lit("")).alias(name) for tag, name in _META],
                       F.lit("EPUB").alias("format"))
