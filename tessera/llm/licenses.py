"""License scan by ordered signature rules.

A signature (signatures.py) is a regular expression over a text's normalised words, with a
keyword, a priority and a score. A document is gated twice: by plain cues in the lower-cased
text, then by the keywords its words hold; only rules of those keywords run. Where detections
overlap, one that lies inside a detection of better priority (or of equal priority, and longer
or earlier in the rules) is suppressed. Labels of the survivors join those of three base
phrases, which are sought over the same words and always stay.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; all spans are in words,
from 0, end exclusive.

All main-path work is DataFrame functions. Null and empty texts have no words and no labels;
rows are scanned one by one, so repeated ids and rows are fine; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, lower_ascii, plain_words
from tessera.llm.signatures import CUES, rules
from tessera.llm.spans import match_spans

WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
LOWEST = 7


def _blanks(piece: Column) -> Column:
    return F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))


def _word_spans(said: Column, pattern: Column) -> Column:
    """Spans, in words, of a pattern over words that have a blank before and after each."""
    return match_spans(said, F.concat(F.lit(" (?:"), pattern, F.lit(")(?= )")), size=_blanks)


def unsuppressed(hits: Column) -> Column:
    """The detections that no better one holds, by start.

    In order of start, longest first and then by priority and rule, whatever holds a detection
    comes before it; so one sweep with the furthest end of each priority so far decides.
    """
    order = lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d["order"].alias("order"), d["label"].alias("label"), d["score"].alias("score"), d["text"].alias("text"))
    begin = F.struct(F.array_repeat(F.lit(-1), LOWEST + 1).alias("ends"), F.expr("cast(array() as array<struct<start:int,end:int,label:string,order:int,priority:int,score:double,text:string>>)").alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        held = F.array_max(F.slice(acc["ends"], 1, d["priority"] + 1)) >= -d["back"]
        ends = F.transform(acc["ends"], lambda e, i: F.when((i == d["priority"]) & (e < -d["back"]), -d["back"]).otherwise(e))
        one = F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["label"].alias("label"), d["order"].alias("order"), d["priority"].alias("priority"), d["score"].alias("score"), d["text"].alias("text"))
        return F.struct(ends.alias("ends"), F.when(held, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(one))).alias("kept"))

    return F.aggregate(F.array_sort(F.transform(hits, order)), begin, step, lambda acc: acc["kept"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (spans of the base phrases), detections (spans with label, priority, score and text), labels, base_labels, score."""
    found = rules()
    empty = F.expr("cast(array() as array<struct<start:int,end:int,label:string,order:int,priority:int,score:double,text:string>>)")
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string,value:string>>)")
    text = F.coalesce(F.col(text_col), F.lit(""))
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(F.col("low"), F.lit(c))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.lower(text).alias("low"))  # lower also folds other scripts; it serves the gate alone
    said = F.concat(F.lit(" "), F.array_join(plain_words(lower_ascii(F.col("text"))), " "), F.lit(" "))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(cue, said).alias("said"))
    by_keyword: dict[str, list] = {}
    for i, (label, keyword, rule, priority, score) in enumerate(found):
        by_keyword.setdefault(keyword, []).append(F.struct(F.lit(label).alias("label"), F.lit(rule).alias("rule"), F.lit(i).alias("order"), F.lit(priority).alias("priority"), F.lit(score).alias("score")))
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*own).alias("rules")) for k, own in by_keyword.items()])
    gated = F.col("said").isNotNull()
    chosen = F.flatten(F.transform(F.filter(table, lambda g: F.contains(F.col("said"), g["keyword"])), lambda g: g["rules"]))
    hits = F.flatten(
        F.transform(
            chosen,
            lambda r: F.transform(_word_spans(F.col("said"), r["rule"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["label"].alias("label"), r["order"].alias("order"), r["priority"].alias("priority"), r["score"].alias("score"), F.trim(s["hit"]).alias("text"))),
        )
    )
    base = _word_spans(F.col("said"), F.lit("|".join(PHRASES)))
    rows = rows.select("doc_id", "n_words", F.when(gated, let(hits, unsuppressed)).otherwise(empty).alias("detections"), F.when(gated, base).otherwise(none).alias("base"))
    label = F.create_map(*[F.lit(x) for p in PHRASES.items() for x in p])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: label[F.trim(b["hit"])])))
    rows = rows.select("*", base_labels.alias("base_labels"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0))
    return rows.select("*", labels.alias("labels"), F.greatest(best, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"))
