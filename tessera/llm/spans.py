"""Places of regular-expression matches as DataFrame functions: Spark has matches, but not where they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.llm.common import let

#: Matches whose places are added up together. Appending copies an array, so blocks keep that cost linear.
BLOCK = 256


def match_spans(text: Column, pattern: Column | str, size: Callable[[Column], Column] = F.length, group: int | None = None) -> Column:
    """Array of (start, end, hit, value) of the leftmost non-overlapping matches.

    Each match is extracted with what precedes it, so lengths add up to places; it must begin
    where the one before ended, or the text's tail would be searched from each of its places.
    ``size`` measures a piece (code points by default). pattern: its groups are numbered from 2 on
    in ``group``, whose content becomes value (else the hit). The pattern must not match the empty text.
    """
    whole = F.concat(F.lit(r"\G((?s:.*?))(?:"), F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(")"))
    pieces, before = F.regexp_extract_all(text, whole, F.lit(0)), F.regexp_extract_all(text, whole, F.lit(1))
    found = F.zip_with(pieces, before, lambda p, b: F.struct(size(b).cast("int").alias("gap"), p.substr(F.length(b) + 1, F.length(p)).alias("hit")))
    if group is None:
        found = F.transform(found, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), x["hit"].alias("value")))
    else:
        found = F.zip_with(found, F.regexp_extract_all(text, whole, F.lit(group)), lambda x, v: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), v.alias("value")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string,value:string>>)")

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = (a + size(x["hit"])).cast("int")
        return F.struct(b.alias("at"), F.concat(acc["spans"], F.array(F.struct(a.alias("start"), b.alias("end"), x["hit"].alias("hit"), x["value"].alias("value")))).alias("spans"))

    def in_block(x: Column) -> Column:
        return F.aggregate(x, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    def joined(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
        starts = F.aggregate(blocks, begin, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
        moved = lambda b, s: F.transform(b["spans"], lambda x: F.struct((x["start"] + s).alias("start"), (x["end"] + s).alias("end"), x["hit"].alias("hit"), x["value"].alias("value")))
        return F.flatten(F.zip_with(blocks, starts, moved))

    blocks = let(found, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(BLOCK)), lambda i: in_block(F.slice(x, i, F.lit(BLOCK)))))
    return let(blocks, joined)
