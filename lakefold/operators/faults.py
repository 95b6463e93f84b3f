"""Error rows of package documents: ``(path, part, error)`` for everything that the document operators pass over.

A damaged package is one row with its open error and no part.  In a package that opens, each listed part that is
missing or malformed is a row; the other parts are still read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.xmltext import xml_fault

FAULT = "array<struct<part:string,error:string>>"


def fault(part: Column | str, error: Column) -> Column:
    return F.struct((F.lit(part) if isinstance(part, str) else part).alias("part"), error.alias("error"))


def part_faults(listed: Column, part: str, markup) -> Column:
    """Faults of listed parts: ``markup`` gives the text of a list item."""
    return F.transform(listed, lambda s: fault(s[part], xml_fault(markup(s))))


def package_errors(opened: DataFrame, *faults: Column) -> DataFrame:
    """The open error of each package, and the faults (arrays of part and error) of packages that opened."""
    found = F.concat(*[F.coalesce(f.cast(FAULT), F.array().cast(FAULT)) for f in faults])
    whole = F.filter(F.array(fault(F.lit(None).cast("string"), F.col("error"))), lambda e: e["error"].isNotNull())
    inside = F.when(F.size("parts") > 0, F.filter(found, lambda e: e["error"].isNotNull())).otherwise(F.array().cast(FAULT))
    return opened.select("path", F.inline(F.concat(whole, inside)))
