"""Queries: media and image headers, with bytes packed from table columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import image as I
from ..functions import media as M
from ..functions.scalars import pack_uint
from ..operators import media as OM
from ..sources.mp4 import mp4_boxes
from .fixtures import as_files
from .tables import query, table


def raw(hexed: str) -> Column:
    return F.unhex(F.lit(hexed))


def ascii_bytes(text: Column | str) -> Column:
    return F.encode(F.lit(text) if isinstance(text, str) else text, "UTF-8")


def zeros(n: int) -> Column:
    return F.unhex(F.lit("00" * n))


def be(value: Column, n: int) -> Column:
    return pack_uint(value, n, little=False)


def key() -> Column:
    return F.col("o_orderkey")


def _orders(spark, sf):
    return table(spark, sf, "orders")


# ------------------------------------------------------------------ MP3


def _mp3(spark, sf):
    """A frame header per order: version, layer, bit rate and sample rate follow the key; 413 bytes each."""
    word = F.lit(0xFFE00000).cast("bigint") + (F.when(key() % 2 == 0, 3).otherwise(2)) * (1 << 19) + (key() % 3 + 1) * (1 << 17) + (key() % 16) * (1 << 12) + (key() % 3) * (1 << 10)
    return _orders(spark, sf).select("o_orderkey", F.concat(be(word, 4), zeros(409)).alias("content"))


_RATE = """coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0][o_orderkey % 16 + 1]
    ELSE [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0][o_orderkey % 16 + 1] END, 0), 128)"""


@query(
    "mp3_frame",
    f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Version 1' ELSE 'Version 2' END AS version, ['III', 'II', 'I'][o_orderkey % 3 + 1] AS layer,
      CASE WHEN o_orderkey % 2 = 0 THEN [44100, 48000, 32000] ELSE [22050, 24000, 16000] END[o_orderkey % 3 + 1] AS sample_rate, {_RATE} AS bitrate, round(413 * 8 / ({_RATE} * 1000), 9) AS duration FROM orders
    """,
)
def mp3_frame(spark, sf):
    f = M.mp3_frame(F.col("content"))
    return _mp3(spark, sf).select("o_orderkey", f.alias("f")).select("o_orderkey", "f.version", "f.layer", "f.sample_rate", "f.bitrate", F.round("f.duration", 9).alias("duration"))


def _fixed(text: Column, n: int) -> Column:
    """Text bytes padded with NULs to a fixed width."""
    return F.rpad(ascii_bytes(F.substring(text, 1, n)), n, raw("00"))


def _id3v1(spark, sf):
    tag = F.concat(ascii_bytes("TAG"), _fixed(F.col("c_name"), 30), _fixed(F.col("c_mktsegment"), 30), _fixed(F.lit("Lake "), 30), zeros(35))
    body = F.concat(raw("FFFB9044"), zeros(100))
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, body).otherwise(F.concat(body, tag)).alias("content"))


@query("id3v1", "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS title, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS artist, CASE WHEN c_custkey % 4 > 0 THEN 'Lake' END AS album FROM customer")
def id3v1(spark, sf):
    return _id3v1(spark, sf).select("c_custkey", M.id3v1(F.col("content")).alias("t")).select("c_custkey", "t.title", "t.artist", "t.album")


def _synchsafe(value: Column) -> Column:
    return F.concat(*[be(F.shiftright(value, 7 * k).bitwiseAND(F.lit(127)), 1) for k in (3, 2, 1, 0)])


def _frame(name: str, encoding: str, body: Column, safe: bool) -> Column:
    size = F.octet_length(body) + 1
    return F.concat(ascii_bytes(name), _synchsafe(size) if safe else be(size, 4), zeros(2), raw(encoding), body)


def _id3v2_bytes(version: int) -> Column:
    safe = version == 4
    note = _frame("TXXX", "00", F.rpad(ascii_bytes("pad"), 300, raw("2E")), safe)
    frames = F.concat(note, _frame("TIT2", "03", ascii_bytes(F.concat("c_name", F.lit("é"))), safe),
                      _frame("TPE1", "01", F.concat(raw("FFFE"), F.encode("c_mktsegment", "UTF-16LE")), safe),
                      _frame("TALB", "00", F.encode(F.lit("Albüm"), "ISO-8859-1"), safe))
    return F.concat(ascii_bytes("ID3"), raw(f"0{version}0000"), _synchsafe(F.octet_length(frames)), frames, raw("FFFB9044"), zeros(413))


def _id3v2(spark, sf):
    content = F.when(F.col("c_custkey") % 3 == 0, _id3v2_bytes(3)).when(F.col("c_custkey") % 3 == 1, _id3v2_bytes(4)).otherwise(F.concat(raw("FFFB9044"), zeros(413)))
    return table(spark, sf, "customer").select("c_custkey", content.alias("content"))


@query(
    "id3v2",
    """
    SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name || 'é' END AS title, CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS artist,
      CASE WHEN c_custkey % 3 < 2 THEN 'Albüm' END AS album, 128 AS bitrate FROM customer
    """,
)
def id3v2(spark, sf):
    """Tags of versions 3 and 4 and untagged files; the frame after the tag is found as well."""
    return _id3v2(spark, sf).select("c_custkey", M.id3v2(F.col("content")).alias("t"), M.mp3_frame(F.col("content"))["bitrate"].alias("bitrate")).select(
        "c_custkey", "t.title", "t.artist", "t.album", "bitrate"
    )


# ------------------------------------------------------------------ WAV and MP4


def _wav_content() -> Column:
    rate, channels, bits = 8000 + key() % 40000, key() % 2 + 1, F.lit(16)
    data = F.col("o_custkey") * 1000
    fmt = F.concat(ascii_bytes("fmt "), pack_uint(F.lit(16), 4), pack_uint(F.when(key() % 5 == 0, 3).otherwise(1), 2), pack_uint(channels, 2), pack_uint(rate, 4),
                   pack_uint(rate * channels * 2, 4), pack_uint(channels * 2, 2), pack_uint(bits, 2))
    extra = F.concat(ascii_bytes("LIST"), pack_uint(F.lit(5), 4), ascii_bytes("data!"), zeros(1))
    tail = F.concat(ascii_bytes("data"), pack_uint(data, 4))
    body = F.when(key() % 3 == 0, F.concat(extra, fmt, tail)).when(key() % 3 == 1, F.concat(fmt, extra, tail)).otherwise(F.concat(fmt, tail))
    return F.concat(ascii_bytes("RIFF"), zeros(4), ascii_bytes("WAVE"), body)


@query(
    "wav_header",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'IEEE Float' ELSE 'PCM' END AS format, o_orderkey % 2 + 1 AS channels, 8000 + o_orderkey % 40000 AS sample_rate,
      16 AS bits_per_sample, round(o_custkey * 1000 / ((8000 + o_orderkey % 40000) * (o_orderkey % 2 + 1) * 2), 9) AS duration FROM orders
    """,
)
def wav_header(spark, sf):
    w = M.wav_header(F.col("content"))
    return _orders(spark, sf).select("o_orderkey", _wav_content().alias("content")).select("o_orderkey", w.alias("w")).select(
        "o_orderkey", "w.format", "w.channels", "w.sample_rate", "w.bits_per_sample", F.round("w.duration", 9).alias("duration")
    )


def _box(name: str, *body: Column) -> Column:
    content = F.concat(*body)
    return F.concat(be(F.octet_length(content) + 8, 4), ascii_bytes(name), content)


def _mp4_content() -> Column:
    seconds = F.col("o_custkey") * 10
    short = _box("mvhd", zeros(12), be(F.lit(1000), 4), be(seconds * 1000, 4), zeros(80))
    long = _box("mvhd", raw("01"), zeros(19), be(F.lit(500), 4), be(seconds * 500, 8), zeros(80))
    video = _box("trak", _box("tkhd", zeros(76), be((key() % 4000 + 1) * 65536, 4), be((key() % 2000 + 1) * 65536, 4)), _box("mdia", _box("hdlr", zeros(8), ascii_bytes("vide"), zeros(12))))
    sound = _box("trak", _box("tkhd", zeros(84)), _box("mdia", _box("hdlr", zeros(8), ascii_bytes("soun"), zeros(12))))
    fits = seconds * 1000 <= 0xFFFFFFFF  # a longer film needs the 64-bit form
    moov = _box("moov", F.when((key() % 2 == 0) & fits, short).otherwise(long), F.when(key() % 3 > 0, video).otherwise(zeros(0)), sound)
    return F.concat(_box("ftyp", ascii_bytes("isom"), zeros(4)), _box("mdat", zeros(32)), moov)


def _mp4(spark, sf):
    return _orders(spark, sf).select(F.concat(F.lit("o"), key().cast("string"), F.lit(".mp4")).alias("path"), _mp4_content().alias("content"))


@query(
    "mp4_summary",
    """
    SELECT 'o' || o_orderkey || '.mp4' AS path, o_custkey * 10 AS duration, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4000 + 1 ELSE 0 END AS width,
      CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 2000 + 1 ELSE 0 END AS height, o_orderkey % 3 > 0 AS has_video, true AS has_audio FROM orders
    """,
)
def mp4_summary(spark, sf):
    return OM.mp4_summary(mp4_boxes(_mp4(spark, sf)))


@query(
    "mp4_boxes",
    """
    SELECT 'o' || o_orderkey || '.mp4' AS path, CASE WHEN o_orderkey % 3 > 0 THEN 12 ELSE 8 END AS boxes, 3 AS deepest, CASE WHEN o_orderkey % 3 > 0 THEN 2 ELSE 1 END AS tracks FROM orders
    """,
)
def mp4_boxes_query(spark, sf):
    return mp4_boxes(_mp4(spark, sf)).groupBy("path").agg(F.count(F.lit(1)).alias("boxes"), F.max("depth").alias("deepest"), F.max("track").alias("tracks"))


def _media_files(spark, sf):
    """Orders as files of four kinds by key: MP3, WAV, MP4 and unknown bytes."""
    k = key() % 4
    content = F.when(k == 0, F.concat(raw("FFFB9044"), zeros(413))).when(k == 1, _wav_content()).when(k == 2, _mp4_content()).otherwise(zeros(16))
    ext = F.when(k == 0, ".mp3").when(k == 1, ".wav").when(k == 2, ".mp4").otherwise(".mov")
    return as_files(_orders(spark, sf).select(F.concat(F.lit("/m/o"), key().cast("string"), ext).alias("path"), content.alias("content")))


_MEDIA = """m AS (SELECT '/m/o' || o_orderkey || ['.mp3', '.wav', '.mp4', '.mov'][o_orderkey % 4 + 1] AS path, ['mp3', 'wav', 'mp4', 'unknown'][o_orderkey % 4 + 1] AS format, o_orderkey % 4 AS k,
    o_orderkey, 8000 + o_orderkey % 40000 AS rate, o_orderkey % 2 + 1 AS channels, o_custkey,
    CASE o_orderkey % 4 WHEN 0 THEN 417 * 8 / 128000.0 WHEN 1 THEN o_custkey * 1000 / ((8000 + o_orderkey % 40000) * (o_orderkey % 2 + 1) * 2) WHEN 2 THEN o_custkey * 10 END AS duration FROM orders)"""


@query(
    "media_profile",
    f"""
    WITH {_MEDIA} SELECT path, format, k < 3 AS playable, round(duration, 6) AS duration, CASE k WHEN 0 THEN 44100 WHEN 1 THEN rate END AS sample_rate, CASE k WHEN 1 THEN channels END AS channels,
      CASE k WHEN 0 THEN 128 END AS bitrate, CASE WHEN k = 2 THEN CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4000 + 1 ELSE 0 END END AS width FROM m
    """,
)
def media_profile(spark, sf):
    return OM.media_profile(_media_files(spark, sf)).select(
        "path", "format", "playable", F.round("duration", 6).alias("duration"), "sample_rate", "channels", "bitrate", "width"
    )


@query(
    "media_record",
    f"""
    WITH {_MEDIA} SELECT path, path[4:] AS name, path[-3:] AS ext, CASE WHEN k < 2 THEN 'audio' ELSE 'video' END AS kind, round(duration, 6) AS duration,
      ['MPEG-3 Audio', 'WAV Audio', 'MP4 Video', 'QuickTime Video'][k + 1] AS display_format FROM m
    """,
)
def media_record(spark, sf):
    return OM.media_record(_media_files(spark, sf)).select("path", "name", "ext", "kind", F.round("duration", 6).alias("duration"), "display_format")


# ------------------------------------------------------------------ images


def _bmp_content() -> Column:
    depth = F.when(key() % 7 == 6, 16).when(key() % 3 == 0, 4).when(key() % 3 == 1, 8).otherwise(24)
    magic = F.when(key() % 11 == 10, ascii_bytes("XX")).otherwise(ascii_bytes("BM"))
    return F.concat(
        magic, pack_uint(key() + 54, 4), zeros(4), pack_uint(F.lit(118), 4), pack_uint(F.lit(40), 4), pack_uint(key() % 5000 + 1, 4), pack_uint(F.lit(4294967296) - (F.col("o_custkey") + 1), 4),
        pack_uint(F.when(key() % 13 == 12, 2).otherwise(1), 2), pack_uint(depth, 2), pack_uint(F.when(key() % 17 == 16, 1).otherwise(0), 4), zeros(12), pack_uint(F.when(key() % 2 == 0, 3).otherwise(0), 4), zeros(4),
        *[pack_uint(F.lit(i) * 65536 + key() % 256, 4) for i in range(16)],
    )


_BMP_ERROR = """CASE WHEN o_orderkey % 11 = 10 THEN 'not a BMP file' WHEN o_orderkey % 13 = 12 THEN 'planes must be 1' WHEN o_orderkey % 7 = 6 THEN 'unsupported colour depth'
      WHEN o_orderkey % 17 = 16 THEN 'compressed files are not supported' END"""


@query(
    "bmp_header",
    f"""
    SELECT o_orderkey, o_orderkey + 54 AS file_size, 118 AS data_offset, o_orderkey % 5000 + 1 AS width, -(o_custkey + 1) AS height,
      CASE WHEN o_orderkey % 7 = 6 THEN 16 WHEN o_orderkey % 3 = 0 THEN 4 WHEN o_orderkey % 3 = 1 THEN 8 ELSE 24 END AS bit_count, {_BMP_ERROR} AS error FROM orders
    """,
)
def bmp_header(spark, sf):
    return as_files(_orders(spark, sf).select("o_orderkey", _bmp_content().alias("content"))).select("o_orderkey", I.bmp_header(F.col("content")).alias("h")).select(
        "o_orderkey", "h.file_size", "h.data_offset", "h.width", "h.height", "h.bit_count", "h.error"
    )


@query(
    "bmp_palette",
    f"""
    SELECT o_orderkey, i AS entry, i AS red, 0 AS green, o_orderkey % 256 AS blue FROM (SELECT *, unnest(generate_series(0, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 15 END)) AS i
      FROM orders WHERE ({_BMP_ERROR}) IS NULL AND o_orderkey % 3 < 2)
    """,
)
def bmp_palette(spark, sf):
    """Stated colour counts, and full palettes bounded by the bytes that are there."""
    return as_files(_orders(spark, sf).select("o_orderkey", _bmp_content().alias("content"))).select(
        "o_orderkey", F.posexplode(I.bmp_palette(F.col("content"))).alias("entry", "c")
    ).select("o_orderkey", "entry", "c.red", "c.green", "c.blue")


@query(
    "psd_header",
    """
    SELECT o_orderkey, 1 AS version, o_orderkey % 4 + 1 AS channels, o_custkey + 1 AS height, o_orderkey + 1 AS width, 8 AS depth, o_orderkey % 10 AS color_mode,
      ['BITMAP', 'GRAYSCALE', 'INDEXED', 'RGB', 'CMYK', NULL, NULL, 'MULTICHANNEL', 'DUOTONE', 'LAB'][o_orderkey % 10 + 1] AS mode_name FROM orders
    """,
)
def psd_header(spark, sf):
    content = F.concat(ascii_bytes("8BPS"), be(F.lit(1), 2), zeros(6), be(key() % 4 + 1, 2), be(F.col("o_custkey") + 1, 4), be(key() + 1, 4), be(F.lit(8), 2), be(key() % 10, 2))
    return _orders(spark, sf).select("o_orderkey", I.psd_header(content).alias("h")).select("o_orderkey", "h.*")


@query(
    "svg_size",
    """
    SELECT p_partkey, round(CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size * 96 / 72.0 WHEN 2 THEN p_size * 10 WHEN 3 THEN 300 WHEN 4 THEN p_size * 96 / 2.54 END, 6) AS width,
      round(CASE p_partkey % 6 WHEN 0 THEN p_size * 2 WHEN 1 THEN p_size WHEN 2 THEN 7.5 WHEN 3 THEN 150 WHEN 4 THEN 150 END, 6) AS height, p_partkey % 6 < 5 AS valid FROM part
    """,
)
def svg_size(spark, sf):
    k, s = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    svg = (
        F.when(k == 0, F.concat(F.lit('<svg xmlns="u" width="'), s, F.lit('" height="'), (F.col("p_size") * 2).cast("string"), F.lit('px"/>')))
        .when(k == 1, F.concat(F.lit("<svg width='"), s, F.lit("pt' height='"), s, F.lit("%'></svg>")))
        .when(k == 2, F.concat(F.lit('<?xml version="1.0"?><svg viewBox="0 0 '), (F.col("p_size") * 10).cast("string"), F.lit(' 7.5"/>')))
        .when(k == 3, F.lit('<svg width="auto" viewBox="0 0"/>'))
        .when(k == 4, F.concat(F.lit('<svg width="'), s, F.lit('cm"><g width="5"/></svg>')))
        .otherwise(F.lit("<svg width='5'>"))
    )
    return table(spark, sf, "part").select("p_partkey", svg.alias("svg")).select("p_partkey", I.svg_size(F.col("svg")).alias("z")).select(
        "p_partkey", F.round("z.width", 6).alias("width"), F.round("z.height", 6).alias("height"), "z.valid"
    )


@query("webp_animated", "SELECT o_orderkey, o_orderkey % 4 IN (1, 2) AS animated FROM orders")
def webp_animated(spark, sf):
    k = key() % 4
    tail = F.when(k == 0, F.concat(ascii_bytes("VP8 "), zeros(20))).when(k == 1, F.concat(ascii_bytes("VP8X"), zeros(14), ascii_bytes("ANIM"))).when(
        k == 2, F.concat(zeros(40), ascii_bytes("ANMF"))).otherwise(F.concat(zeros(100), ascii_bytes("ANIM")))
    content = F.concat(ascii_bytes("RIFF"), zeros(4), ascii_bytes("WEBP"), tail)
    return _orders(spark, sf).select("o_orderkey", I.webp_animated(content).alias("animated"))


@query(
    "image_info",
    """
    WITH i AS (SELECT 'i' || o_orderkey AS path, o_orderkey % 8 AS k, o_orderkey % 5000 + 1 AS w, o_custkey % 3000 + 1 AS h FROM orders)
    SELECT path, ['png', 'gif', 'bmp', 'psd', 'webp', 'webp', 'webp', 'jpg'][k + 1] AS format, w AS width, h AS height, round(w / h, 9) AS aspect_ratio FROM i
    """,
)
def image_info(spark, sf):
    w, h, k = key() % 5000 + 1, F.col("o_custkey") % 3000 + 1, key() % 8
    riff = lambda *body: F.concat(ascii_bytes("RIFF"), zeros(4), ascii_bytes("WEBP"), *body)
    content = (
        F.when(k == 0, F.concat(raw("89504E470D0A1A0A"), zeros(8), be(w, 4), be(h, 4)))
        .when(k == 1, F.concat(ascii_bytes("GIF89a"), pack_uint(w, 2), pack_uint(h, 2)))
        .when(k == 2, F.concat(ascii_bytes("BM"), zeros(16), pack_uint(w, 4), pack_uint(h, 4)))
        .when(k == 3, F.concat(ascii_bytes("8BPS"), zeros(10), be(h, 4), be(w, 4)))
        .when(k == 4, riff(ascii_bytes("VP8X"), zeros(8), pack_uint(w - 1, 3), pack_uint(h - 1, 3)))
        .when(k == 5, riff(ascii_bytes("VP8 "), zeros(10), pack_uint(w + 16384, 2), pack_uint(h, 2)))
        .when(k == 6, riff(ascii_bytes("VP8L"), zeros(4), raw("2F"), pack_uint(w - 1 + (h - 1) * 16384, 4)))
        .otherwise(F.concat(raw("FFD8FFE000104A46494600010100000100010000FFFFC000110 8".replace(" ", "")), be(h, 2), be(w, 2), zeros(8)))
    )
    files = _orders(spark, sf).select(F.concat(F.lit("i"), key().cast("string")).alias("path"), content.alias("content"))
    return OM.image_info(files).withColumn("aspect_ratio", F.round("aspect_ratio", 9))
