"""Media headers: MP3 frames and tags, WAV, as native expressions at fixed offsets."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrays import let
from .formats import begins
from .scalars import byte_slice, read_int, read_uint
from .text import latin1

# MPEG audio sample rates and bit rates (kbit/s) by header index.
SAMPLE_RATES_V1 = [44100, 48000, 32000]
SAMPLE_RATES_V2 = [22050, 24000, 16000]
SAMPLE_RATES_V25 = [11025, 12000, 8000]
BIT_RATES_V1 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0]
BIT_RATES_V2 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0]


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _synchsafe(raw: Column) -> Column:
    """28-bit size out of the low seven bits of four bytes."""
    return let(raw, lambda r: sum(
        (F.shiftrightunsigned(r, 8 * k).bitwiseAND(F.lit(0x7F).cast("bigint")) * (1 << (7 * k)) for k in range(1, 4)),
        r.bitwiseAND(F.lit(0x7F).cast("bigint")),
    ))


def id3v2_size(content: Column) -> Column:
    """Bytes of the leading ID3v2 tag after its ten-byte header, zero without one."""
    return F.when(begins(content, "494433"), F.coalesce(_synchsafe(read_uint(content, 6, 4, little=False)), F.lit(0))).otherwise(F.lit(0))


def mp3_frame(content: Column) -> Column:
    """version, layer, sample_rate, bitrate, duration of the first frame; unknown rates take their defaults."""
    start = F.when(begins(content, "494433"), id3v2_size(content) + 10).otherwise(F.lit(0))
    size = F.octet_length(content)

    def decode(f: Column) -> Column:
        word = f["word"]
        bits = lambda shift, mask: F.shiftrightunsigned(word, shift).bitwiseAND(F.lit(mask).cast("bigint")).cast("int")
        version, layer = bits(19, 3), bits(17, 3)
        of = lambda rates: F.get(_array(rates), bits(10, 3))
        sample = F.when(version == 3, of(SAMPLE_RATES_V1)).when(version == 2, of(SAMPLE_RATES_V2)).when(version == 0, of(SAMPLE_RATES_V25))
        nonzero = lambda c, default: F.coalesce(F.nullif(c, F.lit(0)), F.lit(default))
        rate = nonzero(F.when(version == 3, F.get(_array(BIT_RATES_V1), bits(12, 15))).otherwise(F.get(_array(BIT_RATES_V2), bits(12, 15))), 128)
        return F.struct(
            F.when(version == 3, "Version 1").when(version == 2, "Version 2").otherwise("Reserved").alias("version"),
            F.when(layer == 1, "III").when(layer == 2, "II").when(layer == 3, "I").otherwise("Reserved").alias("layer"),
            F.coalesce(sample, F.lit(44100)).alias("sample_rate"), rate.alias("bitrate"),
            ((size - f["start"]) * 8 / (rate * 1000)).alias("duration"),
        )

    missing = F.struct(F.lit("Unknown").alias("version"), F.lit("Unknown").alias("layer"), F.lit(0).alias("sample_rate"),
                       F.lit(0).alias("bitrate"), F.lit(0.0).alias("duration"))
    frame = let(start, lambda s: F.struct(s.alias("start"), read_uint(content, s.cast("int"), 4, little=False).alias("word")))
    return let(frame, lambda f: F.when(f["word"].isNotNull() & (f["start"] < size - 4), decode(f)).otherwise(missing))


def _clean(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("\x00"), F.lit("")))


def id3v1(content: Column) -> Column:
    """title, artist, album of the tag in the last 128 bytes, null without one."""
    def fields(tag: Column) -> Column:
        text = lambda at: _clean(latin1(F.substring(tag, at + 1, 30)))
        return F.when(begins(tag, "544147"), F.struct(text(3).alias("title"), text(33).alias("artist"), text(63).alias("album")))

    return let(F.when(F.octet_length(content) >= 128, F.substring(content, -128, 128)), fields)


def _id3_text(tag: Column, frame_id: str, size_of) -> Column:
    """Text of a frame: find its id, read its size, decode by its encoding byte."""
    def read(at: Column) -> Column:
        size = size_of(read_uint(tag, at + 3, 4, little=False))
        encoding = read_uint(tag, at + 9, 1)
        body = F.substring(tag, (at + 11).cast("int"), (size - 1).cast("int"))
        text = (
            F.when(encoding == 0, latin1(body)).when(encoding == 3, F.make_valid_utf8(body.cast("string")))
            .when(encoding == 1, F.decode(body, "UTF-16")).when(encoding == 2, F.decode(body, "UTF-16BE"))
        )
        return F.when((at > 0) & (size > 0), F.replace(text, F.lit("\x00"), F.lit("")))

    return F.coalesce(let(F.locate(frame_id, latin1(tag)), read), F.lit(""))


def id3v2(content: Column) -> Column:
    """title, artist, album of the ID3v2 tag; version 4 frame sizes are synchsafe, earlier ones plain."""
    def fields(tag: Column) -> Column:
        version = read_uint(content, 3, 1)
        size_of = lambda raw: F.when(version == 4, _synchsafe(raw)).otherwise(raw)
        return F.struct(*[_id3_text(tag, frame, size_of).alias(name) for frame, name in (("TIT2", "title"), ("TPE1", "artist"), ("TALB", "album"))])

    tag = F.substring(content, F.lit(11), id3v2_size(content).cast("int"))
    return F.when(begins(content, "494433"), let(tag, fields))


@F.pandas_udf(StructType([StructField("fmt", LongType()), StructField("data_size", LongType())]))
def _walk_riff(content: pd.Series) -> pd.DataFrame:
    """Offset of the format chunk's body and size of the data chunk of files with a non-canonical layout."""
    def one(b: bytes | None) -> tuple[int | None, int | None]:
        fmt = size = None
        at = 12
        while b is not None and at + 8 <= len(b):
            name, length = struct.unpack_from("<4sI", b, at)
            fmt = at + 8 if name == b"fmt " and fmt is None else fmt
            if name == b"data":
                size = length
                break
            at += 8 + length + length % 2
        return fmt, size

    return pd.DataFrame([one(b) for b in content], columns=["fmt", "data_size"]).astype("Int64")


def wav_header(content: Column) -> Column:
    """format, channels, sample_rate, bits_per_sample, duration.

    Canonical headers are read in the JVM; only files with other chunks in between go through the walk.
    """
    wave = begins(content, "52494646") & (F.hex(byte_slice(content, 8, 4)) == "57415645")
    canonical = (F.hex(byte_slice(content, 12, 4)) == "666D7420") & (F.hex(byte_slice(content, 36, 4)) == "64617461")
    walked = _walk_riff(F.when(wave & ~F.coalesce(canonical, F.lit(False)), content))
    place = F.when(canonical, F.struct(F.lit(20).cast("bigint").alias("fmt"), read_uint(content, 40, 4).alias("data_size"))).otherwise(walked)

    def read(p: Column) -> Column:
        at = p["fmt"].cast("int")
        tag, channels, rate, bits = (read_uint(content, at, 2), read_uint(content, at + 2, 2), read_int(content, at + 4, 4), read_uint(content, at + 14, 2))
        return F.struct(
            F.when(tag == 1, "PCM").when(tag == 3, "IEEE Float").otherwise("Compressed").alias("format"), channels.alias("channels"),
            rate.alias("sample_rate"), bits.alias("bits_per_sample"),
            F.try_divide(p["data_size"].cast("double"), rate * channels * bits / 8).alias("duration"),
        )

    return F.when(wave, let(place, read))
