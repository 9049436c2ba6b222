"""Substring dedup by hashing lines and the sentence runs in them.

Each text is split into lines (at a newline) and each line into sentences (after a full
stop, exclamation or question mark before a blank or the line's end, after other scripts'
sentence marks, and at a blank after Thai, Lao, Burmese or Khmer, which have none). A unit is
a line, or the sentences from one on until they have ``min_words`` words, so that a passage
inside other lines is met wherever a sentence begins. A unit is normalised (case folded, white
space runs to one blank, trimmed) and hashed to 128 bits. Digests are grouped over the whole
table; the occurrence that ranks first, by id and then offset, is kept and every later one is
removed, within one document too. Lines of fewer than ``min_line_words`` words and fewer than
``min_line_chars`` characters ("}", "Yes.") recur by chance in texts that share nothing else, and
are no units; words are counted at white space, and two letters of a script written without
blanks count as one word more. A passage inside a sentence, in a line without sentence marks
too, is no unit. Offsets are those of the original text in code points, end exclusive; a
removed line takes its newline along.

A digest in a third of all rows is combined before it is shuffled, and its join partition
can be split at run time. Null texts count as empty and lose nothing. Null ids rank last;
documents of one id are told apart by a hash of their text; rows equal in both each keep
what the first keeps. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, utf8_rows

#: Sentence marks of other scripts, the marks that may close a quotation after them, the scripts whose
#: sentences end at a blank, and the scripts written without blanks between words.
_MARKS = (
    "\u0589\u061d-\u061f\u06d4\u0700-\u0702\u07f9\u0837\u0839\u083d\u083e\u0964\u0965\u0f0d-\u0f11\u104a\u104b\u1362\u1367\u1368\u166e\u1735\u1736\u17d4\u17d5"
    "\u1803\u1809\u1944\u1945\u1aa8-\u1aab\u1b5a\u1b5b\u1b5e\u1b5f\u1c3b\u1c3c\u1c7e\u1c7f\u203c\u203d\u2047-\u2049\u2e2e\u2e3c\u3002\ua4ff\ua60e\ua60f\ua6f3\ua6f7"
    "\ua876\ua877\ua8ce\ua8cf\ua92f\ua9c8\ua9c9\uaa5d-\uaa5f\uaaf0\uaaf1\uabeb\ufe52\ufe56\ufe57\uff01\uff0e\uff1f\uff61"
)
_CLOSING = "\"'\u00bb\u2019\u201d)\u3009\u300b\u300d\u300f\u3011\uff09\uff63"
_BLANK_ENDS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_UNSPACED = re.compile("[" + _BLANK_ENDS + "\u0f00-\u0fff\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_STOP = re.compile(r"[.!?]+(?:\s+|\Z)")
_STOP_ANY = re.compile(rf"[.!?]+(?:\s+|\Z)|[{_MARKS}][{_MARKS}.!?]*[{_CLOSING}]*\s*|[{_BLANK_ENDS}]\s+")

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def split_units(text: str, min_line_words: int, min_line_chars: int, min_words: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the lines and the sentence runs of a text that may be removed."""
    found, sentences, at = [], [], 0
    for line in text.split("\n"):
        stop = min(len(text), at + len(line) + 1)
        plain = line.isascii()
        words = line.casefold().split()
        if words:
            whole = " ".join(words)
            if len(whole) >= min_line_chars or _size(words, line, plain) >= min_line_words:
                found.append((at, stop, xxhash.xxh3_128_digest("\n" + whole)))
            first = 0
            for last in [*(m.end() for m in (_STOP if plain else _STOP_ANY).finditer(line)), len(line)]:
                if last > first:
                    part = line[first:last]
                    own = part.casefold().split()
                    sentences.append((at + first, stop if last == len(line) else at + last, own, _size(own, part, plain)))
                first = last
        at = stop
    for i, (start, end, words, size) in enumerate(sentences):
        k = i
        while size < min_words and k + 1 < len(sentences):
            k += 1
            end, words, size = sentences[k][1], words + sentences[k][2], size + sentences[k][3]
        if size >= min_words:
            found.append((start, end, xxhash.xxh3_128_digest(" ".join(words))))
    return found


def _size(words: list[str], text: str, plain: bool) -> int:
    """Words at white space, and one for each two letters of a script without it."""
    return len(words) + (0 if plain else len(_UNSPACED.findall(text)) // 2)


def hashed_units(docs: DataFrame, id_col: str, text_col: str, min_line_words: int, min_line_chars: int, min_words: int) -> DataFrame:
    """(doc_id, th, units, again) of every row: each different unit at its first place, and the spans of its later ones.

    A later place in the same text is removed whatever else has the unit, so it needn't be
    compared. A unit's digest is two longs.
    """
    kinds = [("start", pa.int32()), ("end", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())]

    def run(batches):
        for batch in batches:
            offsets, starts, ends, digests, again = [0], [], [], [], []
            for t in utf8_rows(batch.column(2)):
                seen, later = set(), []
                for a, b, d in split_units(t.decode(), min_line_words, min_line_chars, min_words):
                    if d in seen:
                        later.append((a, b))
                        continue
                    seen.add(d)
                    starts.append(a)
                    ends.append(b)
                    digests.append(d)
                offsets.append(len(starts))
                again.append([{"start": a, "end": b} for a, b in merge_spans(later)])
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            units = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], fields=[pa.field(n, k) for n, k in kinds])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), units), pa.array(again, pa.list_(pa.struct(kinds[:2])))], ["doc_id", "th", "units", "again"])

    unit = T.StructType([*SPAN.fields, T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("units", T.ArrayType(unit)), T.StructField("again", T.ArrayType(SPAN))])
    return docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col)).mapInArrow(run, schema)


def merge_spans(spans) -> list[tuple[int, int]]:
    """Sorted maximal runs of (start, end) spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the merged spans."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_line_words: int = 4, min_line_chars: int = 20, min_words: int = 8) -> DataFrame:
    """doc_id, kept_text and removed (array of start, end in the original text) of every row."""
    units = materialize(hashed_units(docs, id_col, text_col, min_line_words, min_line_chars, min_words), "units")
    rows = units.select("doc_id", "th", F.explode("units").alias("u")).select("doc_id", "th", "u.start", "u.end", "u.d1", "u.d2")
    integral = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    last = [F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id")] if integral else [F.col("doc_id").isNull().alias("no_id"), "doc_id"]
    rank = F.struct(*last, "th", "start")
    first = rows.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
    # A digest with one place has no later one. Written, so that both sides of the join are
    # plain shuffles and Spark can split a hot digest's rows.
    first = materialize(first.where("n > 1").select("d1", "d2", "first"), "first-places")
    later = rows.join(first, ["d1", "d2"]).where(rank != F.col("first"))
    own = units.select("doc_id", "th", F.explode("again").alias("a")).select("doc_id", "th", "a.start", "a.end")
    spans = later.select("doc_id", "th", "start", "end").unionByName(own).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "spans")
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    joined = text.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            kept, removed = [], []
            for t, found in zip(utf8_rows(batch.column(1)), batch.column(2).to_pylist()):
                merged = merge_spans((x["start"], x["end"]) for x in found or ())
                kept.append(cut(t.decode(), merged) if merged else t.decode())
                removed.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(removed, span)], ["doc_id", "kept_text", "removed"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("kept_text", T.StringType())]).add("removed", T.ArrayType(SPAN))
    return joined.select("doc_id", "text", "spans").mapInArrow(run, schema)

