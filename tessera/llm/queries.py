"""The operators over their intended tables, as the registered queries op1 to op10."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, licenses, linedup, mixing, quality, repeats, secrets, sharding, simhash
from tessera.llm.common import read_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, fitted rate and number of copies of every document, and what share of all tokens the worst domain misses its target by."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model, rates, table = mixing.fit(docs, labels, mixing.label_domain(), mixing.TARGETS)
    place = {d: i for i, d in enumerate(model.domains)} if model else {}
    p = [(F.get("p", F.lit(place[d])) if d in place else F.lit(0.0)).alias(f"p_{d}") for d in mixing.TARGETS]
    return table.select("doc_id", F.col("tokens").alias("n_tokens"), *p, "rate", "copies", F.lit(rates.unmet).alias("unmet_share"))


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less every byte of a 400-byte string that also starts elsewhere."""
    found = repeats.remove_repeats(read_table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes; equal texts stay together."""
    placed = sharding.assign_shards(read_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less their repeated lines and sentences, as digests of what stays."""
    found = linedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("removed").cast("long").alias("n_spans"), removed.alias("n_removed"), spans.alias("spans"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    found = licenses.scan_licenses(read_table(spark, sf_dir, "documents"))
    place = lambda f: f(F.transform("base", lambda b: b["start"])).cast("long")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), place(F.array_min).alias("first_word"), place(F.array_max).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at three differing bits or fewer."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), budget=3, shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.scan_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda b: b["kind"] == i)).cast("long").alias(f"n_{secrets.KINDS[i]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 13-word window of a benchmark item."""
    found = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), width=13)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit_centroids(langid.training_rows(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    found = quality.apply_rules(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "depleted", "removed_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_repeated_substrings": op2_repeated_substrings,
    "op3_sharding": op3_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_simhash": op6_simhash,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op2_repeated_substrings": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS s FROM d WHERE length(h) >= 800),
w AS (SELECT doc_id, s, md5(substring(h, 2 * s + 1, 800)) AS k FROM p),
r AS (SELECT doc_id, s FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER o + 400 THEN 0 ELSE 1 END AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM g),
x AS (SELECT doc_id, n, min(s) AS a, max(s) + 400 AS b FROM i GROUP BY 1, 2),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM x GROUP BY 1),
e AS (SELECT doc_id, a, b FROM x UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d),
q AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS f FROM e),
t AS (SELECT q.doc_id, string_agg(substring(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY f) AS kept FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
""",
    "op8_decontaminate": r"""
WITH l AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, w[s : s + 12] AS k FROM n),
g AS (SELECT DISTINCT len(k) AS size FROM v),
o AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS q FROM l, g WHERE len(w) >= size),
h AS (SELECT doc_id, item_id, q, size FROM (SELECT doc_id, q, size, w[q : q + size - 1] AS k FROM o) x JOIN v USING (k)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(q, q + size)) AS p FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM l LEFT JOIN c ON l.doc_id = c.doc_id LEFT JOIN i ON l.doc_id = i.doc_id
""",
    "op10_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM v),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT doc_id, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k, regexp_replace(translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS norm FROM l),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM m WHERE k > 0 GROUP BY 1),
h AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY 1),
f AS (SELECT g.source, norm FROM (SELECT source, norm, count(DISTINCT text) AS n FROM m WHERE k > 0 GROUP BY 1, 2 HAVING count(DISTINCT text) > 20) g JOIN h ON g.source IS NOT DISTINCT FROM h.source WHERE n > 0.001 * docs),
z AS (SELECT doc_id, sum(k) AS n FROM m JOIN f ON m.source IS NOT DISTINCT FROM f.source AND m.norm = f.norm WHERE k > 0 GROUP BY 1),
a AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(z.n, 0) AS BIGINT) AS removed_words
FROM d LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN z USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, removed_words > 0 AND (n_words - removed_words < 0.5 * n_words OR n_words - removed_words < 50) AS depleted FROM a)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM b
""",
}
