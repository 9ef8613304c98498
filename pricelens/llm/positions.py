"""Where a pattern occurs, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int>>"


def where_found(text: Column, pattern: Column, group: int = 0) -> Column:
    """Leftmost non-overlapping matches, as (start, end, size of ``group``), in code points, end exclusive.

    The pieces between the matches and the matches themselves take turns, so lengths add up to places.
    The pattern may not match the empty string.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    inner = F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), F.length) if group else found
    each = F.arrays_zip(between.alias("gap"), found.alias("size"), inner.alias("inner"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,inner:int>>").alias("out"))
    return F.filter(F.aggregate(each, start, lambda s, x: F.struct(
        (s.at + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
        F.concat(s.out, F.array(F.struct((s.at + x["gap"]).alias("start"), (s.at + x["gap"] + x["size"]).alias("end"), x["inner"].alias("inner")))).alias("out"))).out,
        lambda m: m.end.isNotNull())
