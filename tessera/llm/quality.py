"""Quality rules with cross-document line frequency.

Base rules are counts over a text's words `[^\\x20\\x09-\\x0D]+`: too few words, or too many
words inside 3-word windows found twice or more. The method: each line is normalised (A-Z
lower-cased, its words joined by one blank, digits 0-9 to 0) and hashed; for each host the
distinct documents with a line are counted (equal texts are one document), and lines in more
than ``limit`` documents and more than ``share`` of the documents of their host are removed: the
first limit keeps small hosts' chance repeats, the second keeps a host of billions of
documents from losing every line that twenty of them share. A document that loses words so is
depleted and rejected if it keeps less than ``least_share`` of them or fewer than ``min_words``.

Line counts are combined before they are shuffled, so a line in a third of all rows costs
one row from each task. Null texts have no words and fail; null hosts are a host of their
own. Documents of one id are told apart by a hash of their text. Repeated rows each get a
row; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, utf8_rows

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: A-Z to lower case and digits to 0, in UTF-8 bytes.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    words = text.split()
    chars = len(b"".join(words).decode())
    lines = [line for line in text.split(b"\n") if line.split()]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            times, free = Counter(windows), 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 3 - max(i, free)
                    free = i + 3
    return len(words), chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


def line_digests(text: bytes) -> list[tuple[bytes, int]]:
    """Digest and words of each distinct normalised line that has a word; words are summed over its places."""
    found: Counter = Counter()
    for line in text.translate(_FOLD).split(b"\n"):
        words = line.split()
        if words:
            found[xxhash.xxh3_128_digest(b" ".join(words))] += len(words)
    return list(found.items())


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host, th, the five measures and lines (digest, words) of every row."""
    line = pa.list_(pa.struct([("digest", pa.binary()), ("words", pa.int32())]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            counts, lines = [], []
            for t in utf8_rows(batch.column(3)):
                counts.append(measures(t))
                lines.append([{"digest": d, "words": n} for d, n in line_digests(t)])
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, pa.array(lines, line)], ["doc_id", "host", "th", *names, "lines"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("host", docs.schema[host_col].dataType), T.StructField("th", T.LongType())])
    schema = T.StructType([*schema.fields, *(T.StructField(n, T.LongType()) for n in names)]).add("lines", T.ArrayType(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("words", T.IntegerType())])))
    return docs.select(F.col(id_col), F.col(host_col), F.xxhash64(text_col), F.col(text_col)).mapInArrow(run, schema)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = 20, share: float = 0.001, least_share: float = 0.5, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """doc_id, the five measures, removed_words, base_failed, depleted and kept of every row."""
    table = materialize(measured(docs, id_col, text_col, host_col), "measured")
    lines = table.select("doc_id", "th", "host", F.explode("lines").alias("l")).select("doc_id", "th", "host", "l.digest", "l.words")
    places = lines.groupBy("host", "digest", "th").agg(F.lit(1).alias("one"))
    frequent = places.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    hosts = table.groupBy("host", "th").agg(F.lit(1).alias("one")).groupBy(F.col("host").alias("h_host")).agg(F.count(F.lit(1)).alias("docs"))
    frequent = frequent.join(hosts, F.col("host").eqNullSafe(F.col("h_host"))).where(F.col("n") > share * F.col("docs")).select(F.col("host").alias("f_host"), F.col("digest").alias("f_digest"))
    frequent = materialize(frequent, "frequent-lines")  # both sides of the join are then plain shuffles, which can be split
    gone = lines.join(frequent, (F.col("digest") == F.col("f_digest")) & F.col("host").eqNullSafe(F.col("f_host")))
    gone = gone.select("doc_id", "th", "host", "digest", "words").distinct()  # repeated rows have equal lines
    gone = gone.groupBy(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), F.col("host").alias("g_host")).agg(F.sum("words").alias("removed"))
    key = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th")) & F.col("host").eqNullSafe(F.col("g_host"))
    rows = table.drop("lines").join(gone, key, "left").withColumn("removed_words", F.coalesce("removed", F.lit(0)))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < least_share * F.col("n_words")) | (left < min_words))
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", base.alias("base_failed"), depleted.alias("depleted"))
    return rows.select("*", (~F.col("base_failed") & ~F.col("depleted")).alias("kept"))
