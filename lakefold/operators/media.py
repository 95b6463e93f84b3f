"""Media operators: MP4 summaries, profiles over all formats, catalogue records, image information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.formats import detect_media, media_format_name
from ..functions.image import image_size
from ..functions.media import id3v1, id3v2, mp3_frame, wav_header
from ..functions.scalars import basename, file_ext, read_int, read_uint
from ..sources.mp4 import mp4_boxes


def mp4_summary(boxes: DataFrame) -> DataFrame:
    """``(path, duration, width, height, has_video, has_audio)`` from the movie, track and handler boxes."""
    p = F.col("payload")
    long_form = read_uint(p, 0, 1) == 1
    scale = F.when(long_form, read_uint(p, 20, 4, False)).otherwise(read_uint(p, 12, 4, False))
    length = F.when(long_form, read_int(p, 24, 8, False)).otherwise(read_uint(p, 16, 4, False))
    side = lambda at: F.floor(F.when(long_form, read_uint(p, at + 12, 4, False)).otherwise(read_uint(p, at, 4, False)) / 65536).cast("bigint")
    kind, handler = F.col("box_type"), F.decode(F.substring("payload", 9, 4), "ISO-8859-1")
    return boxes.groupBy("path").agg(
        F.max(F.when(kind == "mvhd", F.try_divide(length.cast("double"), scale))).alias("duration"),
        F.max(F.when(kind == "tkhd", side(76))).alias("width"), F.max(F.when(kind == "tkhd", side(80))).alias("height"),
        F.coalesce(F.bool_or(F.when(kind == "hdlr", handler == "vide")), F.lit(False)).alias("has_video"),
        F.coalesce(F.bool_or(F.when(kind == "hdlr", handler == "soun")), F.lit(False)).alias("has_audio"),
    )


def media_profile(files: DataFrame) -> DataFrame:
    """``(path, format, size, playable, duration, sample_rate, channels, bitrate, width, height, title, artist, album)``.

    Formats are told apart once; each file takes one branch, and only MP4 contents go through the box walk.
    """
    detected = files.select("path", "content", F.octet_length("content").cast("bigint").alias("size"), detect_media(F.col("content")).alias("format"))
    none = lambda t: F.lit(None).cast(t)
    c = F.col("content")
    # a tagged MP3 starts with its tag instead of a frame
    tagged = c.isNotNull() & F.startswith(c, F.unhex(F.lit("494433")))
    detected = detected.withColumn("format", F.when(tagged, "mp3").otherwise(F.col("format")))
    mp3 = F.when(F.col("format") == "mp3", F.struct(mp3_frame(c).alias("f"), F.coalesce(id3v1(c), id3v2(c)).alias("t")))
    wav = F.when(F.col("format") == "wav", wav_header(c))
    audio = detected.filter(F.col("format") != "mp4").select("path", "size", "format", mp3.alias("m"), wav.alias("w")).select(
        "path", "size", "format", F.coalesce("m.f.duration", "w.duration").alias("duration"), F.coalesce(F.col("m.f.sample_rate").cast("bigint"), "w.sample_rate").alias("sample_rate"),
        F.col("w.channels").alias("channels"), F.col("m.f.bitrate").alias("bitrate"), none("bigint").alias("width"), none("bigint").alias("height"),
        F.col("m.t.title").alias("title"), F.col("m.t.artist").alias("artist"), F.col("m.t.album").alias("album"),
    )
    video = detected.filter(F.col("format") == "mp4")
    boxes = mp4_summary(mp4_boxes(video))
    movies = video.select("path", "size", "format").join(boxes, "path", "left").select(
        "path", "size", "format", "duration", none("bigint").alias("sample_rate"), none("bigint").alias("channels"), none("int").alias("bitrate"),
        "width", "height", none("string").alias("title"), none("string").alias("artist"), none("string").alias("album"),
    )
    return audio.unionByName(movies).withColumn("playable", F.col("format").isin(*R.PLAYABLE))


def media_record(files: DataFrame) -> DataFrame:
    """``(path, name, ext, kind, size, duration, display_format, width, height)`` for the catalogue.

    The extension decides between audio and video; where both accept it, audio wins.
    """
    audio, video = list(R.AUDIO_NAMES), list(R.VIDEO_NAMES)
    ext = F.col("ext")
    kind = F.when(ext.isin(*audio), "audio").when(ext.isin(*video), "video")
    return media_profile(files).withColumn("name", basename(F.col("path"))).withColumn("ext", file_ext(F.col("name"))).select(
        "path", "name", "ext", kind.alias("kind"), "size", "duration",
        F.when(kind == "audio", media_format_name(ext)).otherwise(media_format_name(ext, "video")).alias("display_format"), "width", "height",
    )


def image_info(files: DataFrame) -> DataFrame:
    """``(path, format, width, height, aspect_ratio)``."""
    return files.select("path", image_size(F.col("content")).alias("i")).select("path", "i.*")
