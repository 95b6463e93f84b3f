"""CSV sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.csvtext import CsvOptions, csv_line


def csv_text(rows: DataFrame, columns: list[str], keep: list[str] = (), opt: CsvOptions = CsvOptions()) -> DataFrame:
    """One escaped record per row, beside the columns in ``keep``; no header is written."""
    return rows.select(*keep, csv_line(*[F.col(c) for c in columns], opt=opt).alias("record"))


def write_csv(rows: DataFrame, path: str, opt: CsvOptions = CsvOptions(), mode: str = "errorifexists") -> None:
    """Write records that :func:`~lakefold.functions.csvtext.csv_rows` reads back, one file per partition."""
    csv_text(rows, rows.columns, opt=opt).write.mode(mode).text(path)
