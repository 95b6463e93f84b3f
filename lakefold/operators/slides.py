"""Presentation packages: slide lists, text runs, shapes, pictures, properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import at, let
from ..functions.markup import (
    RELS_SCHEMA, attribute, elements, first_element, has_element, leading_int, part, part_struct, part_text, plain_markup, resolve_target, text_content, texts_of,
)
from ..functions.scalars import emu_to_px
from ..functions.xmltext import is_valid_xml, xml_fault, xml_text
from ..sources.archive import open_packages
from .faults import fault, package_errors, part_faults
from .sheets import _strings

PPTX_PARTS = r"^(docProps/app\.xml|ppt/presentation\.xml|ppt/_rels/presentation\.xml\.rels|ppt/slides/([^/]+\.xml|_rels/[^/]+\.rels))$"
PPTX_PARTS_WITH_MEDIA = PPTX_PARTS[:-1] + r"|^ppt/media/"
DPS_PARTS = r"^[^/]+\.xml$|^media/"

SLIDE_WIDTH, SLIDE_HEIGHT, SHAPE_SIZE = 9144000, 6858000, 100000


def open_presentations(files: DataFrame, media: bool = False) -> DataFrame:
    return open_packages(files, PPTX_PARTS_WITH_MEDIA if media else PPTX_PARTS)


def open_dps(files: DataFrame) -> DataFrame:
    return open_packages(files, DPS_PARTS)


def _slide_ids(parts: Column) -> Column:
    return elements(part_text(parts, "ppt/presentation.xml"), "sldId")


def _slide_list(parts: Column, by_rel_number: bool = False) -> Column:
    ids = _slide_ids(parts)
    rels = part_struct(parts, "ppt/_rels/presentation.xml.rels", RELS_SCHEMA)["Relationship"]

    def resolve(rels: Column, s: Column, i: Column, rid: Column) -> Column:
        digits = F.nullif(F.regexp_extract(rid, "(\\d+)$", 1), F.lit(""))
        number = F.coalesce(digits, (i + 1).cast("string"))
        by_number = F.concat(F.lit("ppt/slides/slide"), number, F.lit(".xml"))
        target = at(F.filter(rels, lambda r: r["_Id"] == rid), 0)["_Target"]
        return F.struct(
            (i + 1).alias("slide_no"), attribute(s, "id").alias("id"), number.alias("rel_no"),
            (by_number if by_rel_number else F.coalesce(resolve_target("ppt/", target), by_number)).alias("part"),
        )

    return let(rels, lambda r: F.transform(ids, lambda s, i: let(attribute(s, "r:id"), lambda rid: resolve(r, s, i, rid))))


def slides(decks: DataFrame, by_rel_number: bool = False) -> DataFrame:
    """``(path, slide_no, id, rel_no, part)`` in presentation order."""
    return decks.select("path", F.inline(_slide_list(F.col("parts"), by_rel_number)))


def _slide_rows(decks: DataFrame, max_slides: int | None = None, rels: bool = False) -> DataFrame:
    """One row per slide with its markup (null when the part is missing or malformed)."""
    parts = F.col("parts")
    listed = _slide_list(parts)
    if max_slides is not None:
        listed = F.slice(listed, F.lit(1), F.lit(max_slides))

    def load(s: Column) -> Column:
        fields = [s["slide_no"].alias("slide_no"), s["id"].alias("id"), part_text(parts, s["part"]).alias("xml")]
        if rels:
            rel_part = F.regexp_replace(s["part"], "([^/]+)$", "_rels/$1.rels")
            pictures = F.transform(
                elements(part_text(parts, rel_part), "Relationship"),
                lambda r: F.struct(attribute(r, "Id").alias("rel"), resolve_target("ppt/slides/", attribute(r, "Target")).alias("part")),
            )
            fields.append(F.transform(
                F.filter(pictures, lambda p: F.map_contains_key(parts, p["part"])),
                lambda p: F.struct(p["rel"].alias("rel"), p["part"].alias("part"), part(parts, p["part"]).alias("data")),
            ).alias("pictures"))
        return F.struct(*fields)

    # every listed id is a slide, so their number needs no relationships
    rows = decks.select("path", F.size(_slide_ids(parts)).alias("total_slides"), F.inline(F.transform(listed, load)))
    return rows.withColumn("xml", F.when(is_valid_xml(F.col("xml")), plain_markup(F.col("xml"))))


def slides_errors(decks: DataFrame) -> DataFrame:
    """``(path, part, error)``: packages that do not open, and listed slides whose part is missing or malformed."""
    parts = F.col("parts")
    return package_errors(
        decks, F.array(fault("ppt/presentation.xml", xml_fault(part_text(parts, "ppt/presentation.xml")))),
        part_faults(_slide_list(parts), "part", lambda s: part_text(parts, s["part"])),
    )


def first_n_slides(decks: DataFrame, max_slides: int) -> DataFrame:
    """``(path, slide_no, id, element_count, total_slides, loaded_slides)`` of the leading slides.

    The list is cut before any slide is parsed; a missing part gives an empty slide whose id is its number.
    """
    rows = _slide_rows(decks, max_slides)
    found = F.col("xml").isNotNull()
    return rows.select(
        "path", "slide_no", F.when(found, F.col("id")).otherwise(F.col("slide_no").cast("string")).alias("id"),
        F.when(found, F.size(elements(F.col("xml"), "sp")) + F.size(elements(F.col("xml"), "pic"))).otherwise(0).alias("element_count"),
        "total_slides", F.least("total_slides", F.lit(max_slides)).alias("loaded_slides"),
    )


def _box(element: Column, width: int, height: int) -> Column:
    """Position and size of a shape in pixels."""
    def read(frame: Column) -> Column:
        value = lambda tag, a: leading_int(attribute(first_element(frame, tag), a))
        return F.struct(
            emu_to_px(value("off", "x"), 0).alias("x"), emu_to_px(value("off", "y"), 0).alias("y"),
            emu_to_px(value("ext", "cx"), width).alias("width"), emu_to_px(value("ext", "cy"), height).alias("height"),
        )

    return let(first_element(first_element(element, "spPr"), "xfrm"), read)


def _text_run(r: Column) -> Column:
    return let(first_element(r, "rPr"), lambda props: F.struct(
        F.array_join(texts_of(r, "t"), "").alias("text"),
        F.coalesce(attribute(props, "b") == "1", F.lit(False)).alias("bold"), F.coalesce(attribute(props, "i") == "1", F.lit(False)).alias("italic"),
        F.coalesce(leading_int(attribute(props, "sz")) / 100, F.lit(18.0)).alias("font_size"),
        F.coalesce(attribute(first_element(props, "srgbClr"), "val"), F.lit("000000")).alias("color"),
    ))


def slide_text_runs(decks: DataFrame, max_slides: int | None = None) -> DataFrame:
    """``(path, slide_no, shape_no, run_no, text, bold, italic, font_size, color, x, y, width, height)``."""
    shapes = _slide_rows(decks, max_slides).select("path", "slide_no", F.posexplode(elements(F.col("xml"), "sp")).alias("shape_no", "sp"))
    with_runs = shapes.select(
        "path", "slide_no", "shape_no", _box(F.col("sp"), SLIDE_WIDTH, SLIDE_HEIGHT).alias("box"),
        F.posexplode(F.transform(F.filter(elements(F.col("sp"), "r"), lambda r: has_element(r, "t")), _text_run)).alias("run_no", "r"),
    )
    return with_runs.select("path", "slide_no", "shape_no", "run_no", "r.*", "box.*")


def slide_images(decks: DataFrame) -> DataFrame:
    """``(path, slide_no, rel, part, data, x, y, width, height)``: pictures resolved through their own slide's relationships."""
    rows = _slide_rows(decks, rels=True)
    pics = rows.select("path", "slide_no", "pictures", F.explode(elements(F.col("xml"), "pic")).alias("pic"))
    target = at(F.filter("pictures", lambda p: p["rel"] == attribute(first_element(F.col("pic"), "blip"), "r:embed")), 0)
    return pics.select("path", "slide_no", target.alias("t"), _box(F.col("pic"), SLIDE_WIDTH, SLIDE_HEIGHT).alias("box")).filter("t IS NOT NULL").select(
        "path", "slide_no", "t.rel", "t.part", "t.data", "box.*"
    )


def slide_shapes(decks: DataFrame) -> DataFrame:
    """``(path, slide_no, shape_no, fill, geometry, x, y, width, height)`` of shapes without text."""
    shapes = _slide_rows(decks).select("path", "slide_no", F.posexplode(elements(F.col("xml"), "sp")).alias("shape_no", "sp"))
    props = first_element(F.col("sp"), "spPr")
    bare = shapes.filter(props.isNotNull() & ~has_element(F.col("sp"), "t"))
    fill = attribute(first_element(first_element(props, "solidFill"), "srgbClr"), "val")
    return bare.select(
        "path", "slide_no", "shape_no", F.coalesce(fill, F.lit("FFFFFF")).alias("fill"),
        F.coalesce(attribute(first_element(props, "prstGeom"), "prst"), F.lit("rect")).alias("geometry"),
        _box(F.col("sp"), SHAPE_SIZE, SHAPE_SIZE).alias("box"),
    ).select("path", "slide_no", "shape_no", "fill", "geometry", "box.*")


def slide_transition(decks: DataFrame) -> DataFrame:
    """``(path, slide_no, transition, duration_ms)``; null without a transition."""
    t = first_element(F.col("xml"), "transition")
    kind = F.when(has_element(t, "dissolve"), "dissolve").when(has_element(t, "fade"), "fade").when(t.isNotNull(), "none")
    return _slide_rows(decks).select("path", "slide_no", kind.alias("transition"), F.when(t.isNotNull(), 500).alias("duration_ms"))


def doc_props(decks: DataFrame) -> DataFrame:
    text = part_text(F.col("parts"), "docProps/app.xml")
    return decks.select("path", *[xml_text(text, tag).alias(name) for tag, name in (
        ("Title", "title"), ("Manager", "author"), ("Created", "created"), ("Application", "application"))])


def slide_profile(decks: DataFrame) -> DataFrame:
    """slide_count and has_media; open the decks with media so that media parts are visible."""
    parts = F.col("parts")
    return decks.filter("error IS NULL").select(
        "path", F.size(_slide_list(parts)).alias("slide_count"),
        F.exists(F.map_keys(parts), lambda k: k.startswith("ppt/media/")).alias("has_media"),
    )


# ------------------------------------------------------------------ DPS


def _dps_list(parts: Column) -> Column:
    markup = F.coalesce(part_text(parts, "Presentation.xml"), part_text(parts, "1.xml"))
    own = lambda s, a: F.nullif(attribute(s, a), F.lit(""))
    return F.transform(
        elements(markup, "slide"),
        lambda s, i: F.struct(
            (i + 1).alias("slide_no"), F.coalesce(leading_int(own(s, "id")), i + 1).cast("int").alias("id"),
            F.coalesce(own(s, "name"), F.concat(F.lit("幻灯片"), (i + 1).cast("string"))).alias("name"),
            F.coalesce(own(s, "filename"), F.concat((i + 2).cast("string"), F.lit(".xml"))).alias("part"),
        ),
    )


def dps_slides(decks: DataFrame) -> DataFrame:
    """``(path, slide_no, id, name, part)`` of listed slides whose part exists."""
    parts = F.col("parts")
    return decks.select("path", F.inline(F.filter(_dps_list(parts), lambda s: F.map_contains_key(parts, s["part"]))))


def _dps_rows(decks: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    parts, extra = F.col("parts"), extra or {}
    loaded = F.transform(_dps_list(parts), lambda s: F.struct(s["slide_no"].alias("slide_no"), part_text(parts, s["part"]).alias("xml")))
    rows = decks.select("path", *[c.alias(n) for n, c in extra.items()], F.inline(F.filter(loaded, lambda s: s["xml"].isNotNull())))
    return rows.filter(is_valid_xml(F.col("xml"))).withColumn("xml", plain_markup(F.col("xml")))


def dps_errors(decks: DataFrame) -> DataFrame:
    """``(path, part, error)``: packages that do not open, and listed slides whose part is missing or malformed."""
    parts = F.col("parts")
    deck = F.coalesce(part_text(parts, "Presentation.xml"), part_text(parts, "1.xml"))
    return package_errors(decks, F.array(fault("Presentation.xml", xml_fault(deck))), part_faults(_dps_list(parts), "part", lambda s: part_text(parts, s["part"])))


def dps_texts(decks: DataFrame) -> DataFrame:
    """``(path, slide_no, text_no, content)``: ``#n`` texts come from the shared strings when there are any."""
    rows = _dps_rows(decks, {"strings": _strings(F.col("parts"), "SharedStrings.xml")})
    read = F.transform(F.filter(elements(F.col("xml"), "text"), lambda e: has_element(e, "t")), lambda e: text_content(first_element(e, "t")))
    shared = F.get("strings", leading_int(F.substring("t", 2, 2147483647)).cast("int"))
    return rows.select("path", "slide_no", "strings", F.posexplode(read).alias("text_no", "t")).select(
        "path", "slide_no", "text_no",
        F.when(F.col("t").startswith("#"), F.coalesce(F.nullif(shared, F.lit("")), F.col("t"))).otherwise(F.col("t")).alias("content"),
    )


def dps_shapes(decks: DataFrame) -> DataFrame:
    number = lambda a, d: F.coalesce(leading_int(F.nullif(attribute(F.col("s"), a), F.lit(""))), F.lit(d)).alias(a)
    return _dps_rows(decks).select("path", "slide_no", F.posexplode(elements(F.col("xml"), "shape")).alias("shape_no", "s")).select(
        "path", "slide_no", "shape_no", attribute(F.col("s"), "id").alias("id"),
        F.coalesce(F.nullif(attribute(F.col("s"), "type"), F.lit("")), F.lit("rectangle")).alias("type"),
        number("x", 0), number("y", 0), number("width", 100), number("height", 100),
    )


def dps_images(decks: DataFrame) -> DataFrame:
    number = lambda a: F.coalesce(leading_int(F.nullif(attribute(F.col("s"), a), F.lit(""))), F.lit(0)).alias(a)
    return _dps_rows(decks).select("path", "slide_no", F.posexplode(elements(F.col("xml"), "image")).alias("image_no", "s")).select(
        "path", "slide_no", "image_no", attribute(F.col("s"), "ref").alias("ref"), number("x"), number("y")
    )


def dps_profile(decks: DataFrame) -> DataFrame:
    parts = F.col("parts")
    return decks.filter("error IS NULL").select(
        "path", F.size(F.filter(_dps_list(parts), lambda s: F.map_contains_key(parts, s["part"]))).alias("slide_count"),
        (F.size(_strings(parts, "SharedStrings.xml")) > 0).alias("has_shared_strings"),
        F.exists(F.map_keys(parts), lambda k: k.startswith("media/")).alias("has_media"),
    )
