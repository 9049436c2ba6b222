"""Benchmark decontamination by a distributed positional inverted index.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is
``width`` consecutive words of an item; an item of fewer words, but not none, is one window.

1. The texts are split into words once, and the postings (term, document, position) of every
   word that the benchmark has are stored. All else works on them and never on texts.
2. Frequencies come from the postings; a window with a term that no document has is dropped,
   and of each remaining window the ``rarest`` terms are chosen.
3. Their lists are intersected after taking each term's offset in its item from its position:
   postings of one alignment (document, item, start) come together, and a window whose chosen
   terms all align is a candidate phrase; one whose chosen terms lie within ``slop`` words of
   their places is a proximity match. A document with too few of an item's terms is left out
   before anything is sorted.
4. Candidates are compared place by place with the postings.

Terms are 64-bit hashes in the index, under a seed at which no two words of the benchmark
collide. Everything is DataFrame functions. What comes from the benchmark or from candidates
is broadcast only while its measured size is at most ``broadcast_bytes``; above that it is
joined by shuffle. Null texts have no words. Repeated items are fine; an item is its id. The
words of an item without an id hit too, but no list of items names it. Documents that repeat
an id are told apart by a hash of their text, and repeated rows each get a result row. Empty
tables give no rows, and an empty benchmark marks nothing. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, materialize, plain_words

WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"


def _words(text: Column) -> Column:
    return plain_words(lower_ascii(text))


def _sized(df: DataFrame, limit: int, size: Column) -> DataFrame:
    """df to be broadcast if the summed size of its rows in bytes is at most ``limit``."""
    total = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= limit else df


@dataclass
class Index:
    """items: k, item_id, terms (hashes of its words). postings: doc_id, th, n_words, pos, term of every benchmark word in every text."""

    items: DataFrame
    postings: DataFrame
    width: int
    limit: int

    def windows(self) -> DataFrame:
        """k, s (start) and terms of every window."""
        starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("terms") - self.width, F.lit(0)))).alias("s")
        return self.items.select("k", "terms", starts).select("k", "s", F.slice("terms", F.col("s") + 1, F.lit(self.width)).alias("terms"))


def build_index(docs: DataFrame, benchmark: DataFrame, width: int, broadcast_bytes: int, id_col: str, text_col: str) -> Index:
    """The stored postings; th is the hash that tells documents of one id apart, and k a hash of an item's id and words."""
    items = benchmark.select(F.col("item_id"), _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = materialize(items.select("item_id", "words", F.xxhash64("item_id", "words").alias("k")).dropDuplicates(["k"]), "items")
    vocabulary = materialize(items.select(F.explode("words").alias("word")).distinct(), "vocabulary")
    seed = 0
    while vocabulary.groupBy(F.xxhash64("word", F.lit(seed)).alias("term")).count().where("count > 1").limit(1).count():
        seed += 1
    hashed = items.select("k", "item_id", F.transform("words", lambda w: F.xxhash64(w, F.lit(seed))).alias("terms"))
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), _words(F.col(text_col)).alias("words"))
    # posexplode_outer: posexplode would add a filter on the words' number, and with it count them twice.
    tokens = text.select("doc_id", "th", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    known = _sized(vocabulary.select("word", F.xxhash64("word", F.lit(seed)).alias("term")), broadcast_bytes, F.octet_length("word") + 96)
    postings = tokens.join(known, "word").select("doc_id", "th", "n_words", "pos", "term")
    return Index(materialize(hashed, "hashed-items"), materialize(postings, "postings"), width, broadcast_bytes)


def find_matches(index: Index, rarest: int = 3, slop: int = 5) -> DataFrame:
    """(doc_id, th, k, s, at, exact): candidate phrases at document word ``at`` (exact) and proximity matches (not exact)."""
    frequency = materialize(index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term-frequency")
    terms = index.windows().select("k", "s", F.size("terms").alias("n"), F.posexplode("terms").alias("o", "term")).join(frequency, "term")
    by_window = W.partitionBy("k", "s")
    chosen = (
        terms.withColumn("found", F.count(F.lit(1)).over(by_window)).where("found = n")
        .withColumn("rank", F.row_number().over(by_window.orderBy("df", "o"))).where(F.col("rank") <= rarest)
        .select("k", "s", "term", (F.col("s") + F.col("o")).alias("j"))
    )
    chosen = materialize(chosen, "chosen-terms")
    places = materialize(chosen.groupBy("term").agg(F.collect_set(F.struct("k", "j")).alias("places")), "places")
    places = _sized(places, index.limit, 96 + 24 * F.size("places"))
    needs = chosen.groupBy("k", "s").agg(F.collect_set("j").alias("need"))
    needs = materialize(needs.groupBy("k").agg(F.collect_list(F.struct("s", "need")).alias("needs"), F.min(F.size("need")).alias("least")), "needs")
    needs = _sized(needs, index.limit, 96 + 64 * F.size("needs"))
    aligned = index.postings.join(places, "term").select("doc_id", "th", "pos", F.explode("places").alias("p"))
    aligned = aligned.select("doc_id", "th", F.col("p.k").alias("k"), F.col("p.j").alias("j"), (F.col("pos") - F.col("p.j")).alias("delta"))
    # A window's chosen terms stand at different places of the item, so two at least differ.
    rich = aligned.groupBy("doc_id", "th", "k").agg(F.count(F.lit(1)).alias("n"), F.min("j").alias("low"), F.max("j").alias("high")).join(needs.select("k", "least"), "k")
    rich = materialize(rich.where((F.col("n") >= F.col("least")) & ((F.col("least") < 2) | (F.col("low") < F.col("high")))).select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), F.col("k").alias("r_k")), "rich-documents")
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")) & (F.col("k") == F.col("r_k"))
    aligned = aligned.join(_sized(rich, index.limit, F.lit(192)), same, "left_semi")
    aligned = aligned.groupBy("doc_id", "th", "k", "delta").agg(F.collect_set("j").alias("js"))
    near = W.partitionBy("doc_id", "th", "k").orderBy("delta").rangeBetween(-slop, slop)
    aligned = aligned.withColumn("near", F.array_distinct(F.flatten(F.collect_list("js").over(near))))
    found = aligned.join(needs, "k").select(
        "doc_id", "th", "k", "delta", "js",
        F.explode(F.filter("needs", lambda w: F.size(F.array_except(w["need"], F.col("near"))) == 0)).alias("w"),
    )
    exact = (F.size(F.array_except("w.need", "js")) == 0) & (F.col("delta") + F.col("w.s") >= 0)
    return materialize(found.select("doc_id", "th", "k", F.col("w.s").alias("s"), (F.col("delta") + F.col("w.s")).alias("at"), exact.alias("exact")), "matches")


def contaminations(docs: DataFrame, benchmark: DataFrame, width: int, rarest: int, slop: int, ratio: int, broadcast_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """(__id, __th, n_hit, items, near_items, contaminated) of the documents with a match of either kind."""
    index = build_index(docs, benchmark, width, broadcast_bytes, id_col, text_col)
    matches = find_matches(index, rarest, slop)
    items = index.items.select("k", F.col("item_id").cast("string").alias("item"), "terms", F.least(F.size("terms"), F.lit(width)).alias("n"))
    items = _sized(items, broadcast_bytes, 128 + 8 * F.size("terms") + F.coalesce(F.octet_length("item"), F.lit(0)))
    near = matches.select("doc_id", "th", "k").distinct().join(items.select("k", "item"), "k").groupBy("doc_id", "th").agg(F.collect_set("item").alias("near"))
    exact = matches.where("exact").groupBy("doc_id", "th", "k", (F.col("at") - F.col("s")).alias("delta")).agg(F.collect_set("s").alias("starts")).join(items, "k")
    exact = materialize(exact, "alignments")
    # Of each alignment, the item's words that a candidate window covers, each once.
    within = lambda j: F.exists("starts", lambda s: (s <= j) & (j < s + F.col("n")))
    wanted = exact.select("doc_id", "th", "k", "delta", F.explode(F.filter(F.sequence(F.lit(0), F.size("terms") - 1), within)).alias("j"), "terms")
    wanted = wanted.select("doc_id", "th", "k", "delta", "j", (F.col("delta") + F.col("j")).alias("pos"), F.get("terms", F.col("j")).alias("term"))
    ids = exact.select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th")).distinct()
    ids = _sized(materialize(ids, "candidates"), broadcast_bytes, F.lit(160))
    postings = index.postings.join(ids, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th")), "left_semi")
    # Repeated rows have equal postings.
    postings = postings.select(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"), F.col("pos").alias("p_pos"), F.col("term").alias("p_term"), "n_words").distinct()
    here = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("th") == F.col("p_th")) & (F.col("pos") == F.col("p_pos")) & (F.col("term") == F.col("p_term"))
    same = wanted.hint("merge").join(postings, here).groupBy("doc_id", "th", "k", "delta").agg(F.collect_set("j").alias("same"), F.first("n_words").alias("n_words"))
    same = same.select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), F.col("k").alias("s_k"), F.col("delta").alias("s_delta"), "same", "n_words")
    held = exact.join(same, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")) & (F.col("k") == F.col("s_k")) & (F.col("delta") == F.col("s_delta")))
    whole = F.filter("starts", lambda s: F.size(F.array_intersect(F.sequence(s, s + F.col("n") - 1), F.col("same"))) == F.col("n"))
    held = held.select("doc_id", "th", "item", "n_words", "delta", "n", whole.alias("starts")).where(F.size("starts") > 0)
    places = F.flatten(F.transform("starts", lambda s: F.sequence(F.col("delta") + s, F.col("delta") + s + F.col("n") - 1)))
    held = held.groupBy("doc_id", "th").agg(F.size(F.array_distinct(F.flatten(F.collect_list(places)))).cast("long").alias("n_hit"), F.collect_set("item").alias("items"), F.first("n_words").alias("n_words"))
    held = held.select(F.col("doc_id").alias("h_id"), F.col("th").alias("h_th"), "n_hit", "items", "n_words")
    both = near.join(held, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")), "left")
    none = F.array().cast("array<string>")
    both = both.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.array_sort(F.coalesce("items", none)).alias("items"), "near", "n_words")
    contaminated = F.coalesce((F.col("n_hit") > 0) & (ratio * F.col("n_hit") >= F.col("n_words")), F.lit(False))
    return materialize(both.select("__id", "__th", "n_hit", "items", F.array_sort(F.array_except("near", "items")).alias("near_items"), contaminated.alias("contaminated")), "contaminations")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, rarest: int = 3, slop: int = 5, ratio: int = 20, broadcast_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with doc_id, n_words, n_hit, items (sorted ids as strings), near_items, contaminated.

    A document word inside any occurrence of a window is hit; a document is contaminated if
    it has a hit and hits times ``ratio`` reach its words.
    """
    found = contaminations(docs, benchmark, width, rarest, slop, ratio, broadcast_bytes, id_col, text_col)
    found = _sized(found, broadcast_bytes, 96 + F.octet_length(F.array_join("items", ",")) + F.octet_length(F.array_join("near_items", ",")))
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), n_words.alias("n_words"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, rarest: int = 3, slop: int = 5, ratio: int = 20, broadcast_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, less the contaminated rows."""
    text = docs.select(F.col(id_col), F.col(text_col))
    found = contaminations(text, benchmark, width, rarest, slop, ratio, broadcast_bytes, id_col, text_col)
    bad = _sized(found.where("contaminated").select("__id", "__th"), broadcast_bytes, F.lit(160))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left_anti")
