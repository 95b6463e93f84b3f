"""Spreadsheets: packages to sheets, cells, styles, merges, grids.

A workbook's parts share one row (``open_packages``), so shared strings and styles are looked up
inside the row before the cells are exploded: no shuffle of cells, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import at, let, whole
from ..functions.markup import RELS_SCHEMA, leading_float, leading_int, part_struct, part_text, resolve_target
from ..functions.xmltext import xml_fault, xml_struct
from ..sources.archive import open_packages
from .faults import fault, package_errors, part_faults

XLSX_PARTS = r"^xl/(workbook\.xml|_rels/workbook\.xml\.rels|sharedStrings\.xml|styles\.xml|worksheets/[^/]+\.xml)$"
ET_PARTS = r"^[^/]+\.xml$"

_CELL = "STRUCT<_r: STRING, _t: STRING, _s: STRING, v: STRING, f: STRING>"
_SHEET = f"sheetData STRUCT<row: ARRAY<STRUCT<_r: STRING, c: ARRAY<{_CELL}>>>>"
_BLOCK = 64
_ENTRY = "array<struct<b:int,range_no:int,d:struct<start_row:int,start_col:int,end_row:int,end_col:int>>>"
_DIMENSION = "dimension STRUCT<_ref: STRING>"
_MERGES = "mergeCells STRUCT<mergeCell: ARRAY<STRUCT<_ref: STRING>>>"
_XF = ("STRUCT<_fontId: STRING, _fillId: STRING, _borderId: STRING, _numFmtId: STRING, _applyFont: STRING, _applyFill: STRING, "
       "_applyBorder: STRING, alignment: STRUCT<_horizontal: STRING, _vertical: STRING, _wrapText: STRING>>")


def open_workbooks(files: DataFrame) -> DataFrame:
    return open_packages(files, XLSX_PARTS)


def open_et(files: DataFrame) -> DataFrame:
    return open_packages(files, ET_PARTS)


def cell_ref(ref: Column) -> Column:
    """``A1`` to zero-based (col, row); anything else is (0, 0)."""
    letters = F.regexp_extract(ref, "^([A-Z]+)\\d+$", 1)
    number = F.regexp_extract(ref, "^[A-Z]+(\\d+)$", 1).try_cast("int")
    col = F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64) - 1
    ok = F.coalesce(letters != "", F.lit(False))
    return F.struct(F.when(ok, col).otherwise(0).alias("col"), F.when(ok, number - 1).otherwise(0).alias("row"))


def decode_range(ref: Column) -> Column:
    """``A1:C3`` to zero-based start and end corners; a single cell is its own range."""
    first, last = cell_ref(F.split_part(ref, F.lit(":"), F.lit(1))), cell_ref(F.element_at(F.split(ref, ":"), -1))
    return F.struct(
        first["row"].alias("start_row"), first["col"].alias("start_col"), last["row"].alias("end_row"), last["col"].alias("end_col")
    )


def typed_value(cell_type: Column, raw: Column, strings: Column, errors: bool = True) -> list[Column]:
    """Tagged value columns of a cell: shared or literal text, number, boolean."""
    shared = F.when(raw.isNotNull(), F.coalesce(F.get(strings, leading_int(raw).cast("int")), F.lit("")))
    return [
        F.when(cell_type == "s", shared).when(~F.coalesce(cell_type, F.lit("")).isin("n", "b"), raw).alias("v_string"),
        F.when(cell_type == "n", leading_float(raw)).alias("v_double"),
        F.when(cell_type == "b", raw == "1").alias("v_bool"),
    ]


def _strings(parts: Column, name: str) -> Column:
    sst = part_struct(parts, name, "si ARRAY<STRUCT<t: STRING, r: ARRAY<STRUCT<t: STRING>>>>")
    first = lambda si: F.coalesce(si["t"], F.get(F.filter(F.transform(si["r"], lambda r: r["t"]), lambda t: t.isNotNull()), F.lit(0)), F.lit(""))
    return F.coalesce(F.transform(sst["si"], first), F.array().cast("array<string>"))


def shared_strings(books: DataFrame, name: str = "xl/sharedStrings.xml") -> DataFrame:
    """``(path, idx, text)``: the first text of each item, empty if it has none."""
    return books.select("path", F.posexplode(_strings(F.col("parts"), name)).alias("idx", "text"))


def _cell_xfs(parts: Column) -> Column:
    xfs = part_struct(parts, "xl/styles.xml", f"cellXfs STRUCT<xf: ARRAY<{_XF}>>")["cellXfs"]["xf"]
    number = lambda c: F.coalesce(leading_int(c), F.lit(0)).cast("int")
    return F.transform(
        xfs,
        lambda x: F.struct(
            number(x["_fontId"]).alias("font_id"), number(x["_fillId"]).alias("fill_id"), number(x["_borderId"]).alias("border_id"),
            number(x["_numFmtId"]).alias("num_fmt_id"), F.coalesce(x["_applyFont"] == "1", F.lit(False)).alias("apply_font"),
            F.coalesce(x["_applyFill"] == "1", F.lit(False)).alias("apply_fill"),
            F.coalesce(x["_applyBorder"] == "1", F.lit(False)).alias("apply_border"), x["alignment"].alias("alignment"),
        ),
    )


def cell_styles(books: DataFrame) -> DataFrame:
    """``(path, style_idx, font_id, fill_id, border_id, num_fmt_id, apply_*)``."""
    return books.select("path", F.posexplode(_cell_xfs(F.col("parts"))).alias("style_idx", "x")).select(
        "path", "style_idx", "x.*"
    ).drop("alignment")


def _sheet_list(parts: Column, by_rel_number: bool) -> Column:
    listed = part_struct(parts, "xl/workbook.xml", "sheets STRUCT<sheet: ARRAY<STRUCT<_name: STRING, _sheetId: STRING, _id: STRING>>>")
    rels = part_struct(parts, "xl/_rels/workbook.xml.rels", RELS_SCHEMA)["Relationship"]

    def one(rels: Column, s: Column, i: Column) -> Column:
        digits = F.regexp_extract(s["_id"], "rId(\\d+)", 1)
        by_number = F.concat(F.lit("xl/worksheets/sheet"), F.when(digits != "", digits).otherwise((i + 1).cast("string")), F.lit(".xml"))
        target = at(F.filter(rels, lambda r: r["_Id"] == s["_id"]), 0)["_Target"]
        return F.struct(
            i.alias("sheet_no"), s["_name"].alias("name"), leading_int(s["_sheetId"]).cast("int").alias("sheet_id"), s["_id"].alias("rel_id"),
            (by_number if by_rel_number else F.coalesce(resolve_target("xl/", target), by_number)).alias("part"),
        )

    return let(rels, lambda r: F.transform(listed["sheets"]["sheet"], lambda s, i: one(r, s, i)))


def _et_sheet_list(parts: Column) -> Column:
    schema = "sheet ARRAY<STRUCT<_name: STRING, _sheetId: STRING, _filename: STRING>>, sheets STRUCT<sheet: ARRAY<STRUCT<_name: STRING, _sheetId: STRING, _filename: STRING>>>"
    listed = F.coalesce(part_struct(parts, "1.xml", schema), part_struct(parts, "Workbook.xml", schema))
    return F.transform(
        F.coalesce(listed["sheets"]["sheet"], listed["sheet"]),
        lambda s, i: F.struct(
            i.alias("sheet_no"),
            F.coalesce(F.nullif(s["_name"], F.lit("")), F.concat(F.lit("Sheet"), (i + 1).cast("string"))).alias("name"),
            F.coalesce(leading_int(s["_sheetId"]), i + 1).cast("int").alias("sheet_id"),
            F.lit(None).cast("string").alias("rel_id"),
            F.coalesce(F.nullif(s["_filename"], F.lit("")), F.concat((i + 2).cast("string"), F.lit(".xml"))).alias("part"),
        ),
    )


def sheets(books: DataFrame, by_rel_number: bool = False) -> DataFrame:
    """``(path, sheet_no, name, sheet_id, rel_id, part)``; the part comes from the relationships.

    ``by_rel_number`` takes the digits of the relationship id as the sheet file number instead.
    """
    return books.select("path", F.inline(_sheet_list(F.col("parts"), by_rel_number)))


def _sheet_rows(books: DataFrame, schema: str, et: bool = False, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per existing sheet with its parsed part; ``extra`` columns are computed per workbook."""
    parts = F.col("parts")
    listed = _et_sheet_list(parts) if et else _sheet_list(parts, False)
    with_text = F.filter(
        F.transform(listed, lambda s: F.struct(s["sheet_no"].alias("sheet_no"), s["name"].alias("sheet_name"), s["sheet_id"].alias("sheet_id"),
                                               part_text(parts, s["part"]).alias("xml"))),
        lambda s: s["xml"].isNotNull(),
    )
    extra = extra or {}
    per_book = books.select("path", *[c.alias(n) for n, c in extra.items()], with_text.alias("found"))
    per_sheet = per_book.select("path", *extra, F.inline(whole("found")))
    return per_sheet.select(
        "path", "sheet_no", "sheet_name", "sheet_id", *extra, xml_struct(F.col("xml"), schema + ", _corrupt_record STRING").alias("ws")
    ).filter("ws._corrupt_record IS NULL")


def _spread(rows: DataFrame, more: Callable[[Column], list[Column]] = lambda place: []) -> DataFrame:
    """The cells of parsed sheets as rows; ``more`` adds columns that follow from a cell's place."""

    def one(row: Column, i: Column) -> Column:
        number = F.coalesce(leading_int(row["_r"]).cast("int"), i + 1)

        def described(c: Column, place: Column) -> Column:
            return F.struct(
                number.alias("row_num"), c["_r"].alias("ref"), place["col"].alias("col"), place["row"].alias("row"), c["_t"].alias("cell_type"),
                c["v"].alias("raw_value"), *typed_value(c["_t"], c["v"], F.col("strings")), c["f"].alias("formula"),
                F.coalesce(leading_int(c["_s"]), F.lit(0)).cast("int").alias("style_idx"), *more(place),
            )

        return F.transform(row["c"], lambda c: let(cell_ref(c["_r"]), lambda place: described(c, place)))

    return rows.select("path", "sheet_no", "sheet_name", F.inline(F.flatten(F.filter(
        F.transform("ws.sheetData.row", one), lambda r: r.isNotNull()))))


def cells(books: DataFrame, et: bool = False) -> DataFrame:
    """Typed cells of every sheet: position, type tag, raw and typed value, formula, style index."""
    strings = _strings(F.col("parts"), "SharedStrings.xml" if et else "xl/sharedStrings.xml")
    out = _spread(_sheet_rows(books, _SHEET, et, {"strings": strings}))
    return out.drop("style_idx") if et else out


def cells_with_merges(books: DataFrame) -> DataFrame:
    """Cells with ``merged``, ``hidden``, ``row_span`` and ``col_span``; the first range wins.

    One pass over the sheets: a sheet's ranges are filed by blocks of rows in a map beside its cells, and each cell looks
    at the ranges of its own block only, so nothing is shuffled or joined.
    """
    strings = _strings(F.col("parts"), "xl/sharedStrings.xml")
    rows = _sheet_rows(books, f"{_SHEET}, {_MERGES}", extra={"strings": strings})
    block = lambda r: F.floor(r / _BLOCK).cast("int")
    ranges = F.transform("ws.mergeCells.mergeCell", lambda m, i: let(decode_range(m["_ref"]), lambda d: F.struct(i.alias("range_no"), d.alias("d"))))
    entries = F.flatten(F.transform(ranges, lambda r: F.transform(
        F.sequence(block(r["d"]["start_row"]), block(F.greatest(r["d"]["start_row"], r["d"]["end_row"]))),
        lambda b: F.struct(b.alias("b"), r["range_no"].alias("range_no"), r["d"].alias("d")))))

    def by_block(filed: Column) -> Column:
        """Sorted entries as a map of their runs."""
        first = F.filter(F.transform(filed, lambda e, i: F.struct(e["b"].alias("b"), i.alias("i"), ((i == 0) | (F.get(filed, i - 1)["b"] != e["b"])).alias("new"))), lambda e: e["new"])
        return let(first, lambda f: F.map_from_arrays(
            F.transform(f, lambda e: e["b"]), F.transform(f, lambda e, k: F.slice(filed, e["i"] + 1, F.coalesce(F.get(f, k + 1)["i"], F.size(filed)) - e["i"]))))

    filed = rows.withColumn("_filed", let(F.array_sort(F.coalesce(entries, F.array().cast(_ENTRY))), by_block))

    def spans(place: Column) -> list[Column]:
        inside = lambda e: place["row"].between(e["d"]["start_row"], e["d"]["end_row"]) & place["col"].between(e["d"]["start_col"], e["d"]["end_col"])
        hit = at(F.filter(F.try_element_at(F.col("_filed"), block(place["row"])), inside), 0)["d"]

        def told(d: Column) -> Column:
            anchor = (place["row"] == d["start_row"]) & (place["col"] == d["start_col"])
            return F.struct(
                d.isNotNull().alias("merged"), F.coalesce(~anchor, F.lit(False)).alias("hidden"), F.when(anchor, d["end_row"] - d["start_row"] + 1).alias("row_span"),
                F.when(anchor, d["end_col"] - d["start_col"] + 1).alias("col_span"))

        return [let(hit, told).alias("_merge")]

    return _spread(filed, spans).select("*", "_merge.*").drop("_merge")


def cells_errors(books: DataFrame, et: bool = False) -> DataFrame:
    """``(path, part, error)``: packages that do not open, and listed sheets that :func:`cells` passes over."""
    parts = F.col("parts")
    book = F.coalesce(part_text(parts, "1.xml"), part_text(parts, "Workbook.xml")) if et else part_text(parts, "xl/workbook.xml")
    listed = _et_sheet_list(parts) if et else _sheet_list(parts, False)
    return package_errors(
        books, F.array(fault("Workbook.xml" if et else "xl/workbook.xml", xml_fault(book))), part_faults(listed, "part", lambda s: part_text(parts, s["part"]))
    )


def shown_value() -> Column:
    """One text column out of the tagged values."""
    return F.coalesce("v_string", F.col("v_double").cast("string"), F.col("v_bool").cast("string"))


def formulas(all_cells: DataFrame) -> DataFrame:
    """Cells that carry a formula, with the cached value."""
    return all_cells.filter(F.col("formula").isNotNull())


def resolve_styles(books: DataFrame) -> DataFrame:
    """``(path, sheet_no, ref, style)``: each cell with the style record its index names, or null."""
    rows = _sheet_rows(books, _SHEET, extra={"xfs": _cell_xfs(F.col("parts"))})
    return rows.select("path", "sheet_no", F.inline(F.flatten(F.transform(
        "ws.sheetData.row",
        lambda row: F.transform(row["c"], lambda c: F.struct(
            c["_r"].alias("ref"), F.get("xfs", F.coalesce(leading_int(c["_s"]), F.lit(0)).cast("int")).alias("style"))),
    ))))


_FONTS = "fonts STRUCT<font: ARRAY<STRUCT<name: STRUCT<_val: STRING>, sz: STRUCT<_val: STRING>, b: STRUCT<_val: STRING>, i: STRUCT<_val: STRING>, color: STRUCT<_rgb: STRING>>>>"
_FILLS = "fills STRUCT<fill: ARRAY<STRUCT<patternFill: STRUCT<fgColor: STRUCT<_rgb: STRING>>>>>"
_SIDE = "STRUCT<_style: STRING>"
_BORDERS = f"borders STRUCT<border: ARRAY<STRUCT<top: {_SIDE}, right: {_SIDE}, bottom: {_SIDE}, left: {_SIDE}>>>"


def _rich_styles(parts: Column) -> Column:
    """Font, fill, alignment and border record of each style index of a workbook."""
    sheet = part_struct(parts, "xl/styles.xml", f"{_FONTS}, {_FILLS}, {_BORDERS}")
    on = lambda flag: F.coalesce(flag.isNotNull() & ~F.coalesce(flag["_val"].isin("0", "false"), F.lit(False)), F.lit(False))

    def one(sheet: Column, xf: Column) -> Column:
        font = F.get(sheet["fonts"]["font"], xf["font_id"])
        border = F.get(sheet["borders"]["border"], xf["border_id"])
        return F.struct(
            font["name"]["_val"].alias("font_name"), leading_float(font["sz"]["_val"]).alias("font_size"),
            on(font["b"]).alias("bold"), on(font["i"]).alias("italic"), font["color"]["_rgb"].alias("font_color"),
            F.get(sheet["fills"]["fill"], xf["fill_id"])["patternFill"]["fgColor"]["_rgb"].alias("fill_color"),
            xf["alignment"]["_horizontal"].alias("horizontal"), xf["alignment"]["_vertical"].alias("vertical"),
            F.coalesce(xf["alignment"]["_wrapText"].isin("1", "true"), F.lit(False)).alias("wrap_text"),
            *[border[side]["_style"].alias(f"border_{side}") for side in ("top", "right", "bottom", "left")],
        )

    return let(sheet, lambda s: F.transform(_cell_xfs(parts), lambda xf: one(s, xf)))


def cell_rich_style(books: DataFrame) -> DataFrame:
    """``(path, sheet_no, ref, font_name, ..., border_left)`` of every cell."""
    rows = _sheet_rows(books, _SHEET, extra={"rich": _rich_styles(F.col("parts"))})
    return rows.select("path", "sheet_no", F.inline(F.flatten(F.transform(
        "ws.sheetData.row",
        lambda row: F.transform(row["c"], lambda c: F.struct(
            c["_r"].alias("ref"), F.get("rich", F.coalesce(leading_int(c["_s"]), F.lit(0)).cast("int")).alias("s"))),
    )))).select("path", "sheet_no", "ref", "s.*")


def merged_ranges(books: DataFrame) -> DataFrame:
    """``(path, sheet_no, range_no, ref, start_row, start_col, end_row, end_col)``."""
    rows = _sheet_rows(books, _MERGES)
    return rows.select("path", "sheet_no", F.posexplode("ws.mergeCells.mergeCell._ref").alias("range_no", "ref")).select(
        "path", "sheet_no", "range_no", "ref", decode_range(F.col("ref")).alias("d")
    ).select("path", "sheet_no", "range_no", "ref", "d.*")


def merge_membership(all_cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Add ``merged``, ``hidden``, ``row_span`` and ``col_span`` to cells; the first range wins.

    A range join on blocks of rows: ranges are filed under every block they touch, cells under
    their one block, so even a single large sheet is spread over many keys.
    """
    filed = (
        ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start_row") / _BLOCK), F.floor(F.col("end_row") / _BLOCK))))
        .groupBy("path", "sheet_no", "_block")
        .agg(F.sort_array(F.collect_list(F.struct("range_no", "start_row", "start_col", "end_row", "end_col"))).alias("_ranges"))
    )
    placed = all_cells.withColumn("_block", F.floor(F.col("row") / _BLOCK)).join(filed, ["path", "sheet_no", "_block"], "left")
    inside = at(F.filter("_ranges", lambda r: F.col("row").between(r["start_row"], r["end_row"]) & F.col("col").between(r["start_col"], r["end_col"])), 0)
    anchor = (F.col("row") == F.col("_hit.start_row")) & (F.col("col") == F.col("_hit.start_col"))
    return (
        placed.withColumn("_hit", inside)
        .withColumn("merged", F.col("_hit").isNotNull())
        .withColumn("hidden", F.coalesce(~anchor, F.lit(False)))
        .withColumn("row_span", F.when(anchor, F.col("_hit.end_row") - F.col("_hit.start_row") + 1))
        .withColumn("col_span", F.when(anchor, F.col("_hit.end_col") - F.col("_hit.start_col") + 1))
        .drop("_block", "_ranges", "_hit")
    )


def sheet_ranges(books: DataFrame) -> DataFrame:
    """Used range per sheet with row and column counts; ``A1`` where no dimension is stated."""
    rows = _sheet_rows(books, _DIMENSION)
    bounds = decode_range(F.coalesce(F.nullif(F.col("ws.dimension._ref"), F.lit("")), F.lit("A1:A1")))
    return rows.select("path", "sheet_no", "sheet_name", bounds.alias("b")).select("path", "sheet_no", "sheet_name", "b.*").withColumn(
        "row_count", F.col("end_row") + 1
    ).withColumn("col_count", F.col("end_col") + 1)


def dense_grid(all_cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every position of the used range; positions without a cell have the empty text and type ``s``."""
    grid = ranges.select("path", "sheet_no", F.explode(F.sequence("start_row", "end_row")).alias("row"), "start_col", "end_col").select(
        "path", "sheet_no", "row", F.explode(F.sequence("start_col", "end_col")).alias("col")
    )
    values = all_cells.select("path", "sheet_no", "row", "col", F.coalesce(shown_value(), F.lit("")).alias("value"),
                              F.coalesce("cell_type", F.lit("n")).alias("type"))
    return grid.join(values, ["path", "sheet_no", "row", "col"], "left").select(
        "path", "sheet_no", "row", "col", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("type", F.lit("s")).alias("type")
    )


def sheet_profile(books: DataFrame) -> DataFrame:
    """sheet_count, has_shared_strings, has_styles per workbook, without opening a worksheet's cells."""
    parts = F.col("parts")
    present = F.filter(_sheet_list(parts, False), lambda s: F.map_contains_key(parts, s["part"]))
    return books.filter("error IS NULL").select(
        "path", F.coalesce(F.size(present), F.lit(0)).alias("sheet_count"),
        (F.size(_strings(parts, "xl/sharedStrings.xml")) > 0).alias("has_shared_strings"),
        F.coalesce(F.size(_cell_xfs(parts)) > 0, F.lit(False)).alias("has_styles"),
    )


def sheet_pages(all_cells: DataFrame, page: int) -> DataFrame:
    """One sheet of each workbook as a page: its cells with ``is_header`` set on the first row."""
    return all_cells.filter(F.col("sheet_no") == page).withColumn("is_header", F.col("row") == 0)


def sheet_to_table(all_cells: DataFrame, columns: list[int]) -> DataFrame:
    """Wide rows with one text column per listed sheet column (``c0``, ``c1``, ...).

    Of several cells at one place that with the greatest reference counts, so a stated one comes before one without a place.
    """
    values = all_cells.select("path", "sheet_no", "row", "col", "ref", shown_value().alias("value"))
    wide = values.groupBy("path", "sheet_no", "row").pivot("col", columns).agg(F.max_by("value", "ref"))
    return wide.select("path", "sheet_no", "row", *[F.col(str(c)).alias(f"c{c}") for c in columns])
