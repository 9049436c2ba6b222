"""Language identification by nearest centroid over TF-IDF letter trigrams.

Trigrams are taken over the UTF-8 bytes of the whole text, with ASCII letters folded in case and
all other ASCII in one class; the bytes of other scripts stay apart, so their letters tell
languages too. Trigrams are hashed into a fixed number of features. A text's vector is
log(1 + count) times inverse document frequency; it is compared by cosine with several
spherical k-means centroids of each language. A text whose best cosine lies under a share
of what the centroid's own members reach is rejected, if it has enough trigrams for the
cosine to mean something; a shorter one stays.

Null texts and texts without a letter get ``und``, score 0 and are rejected. Without any
labelled row every text is ``und``. Empty tables give no rows; repeated rows are each
predicted; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import byte_offsets, small_batches

#: Trigrams fall into this many features by a hash, of which the most frequent are used.
CODES = 1 << 17


def _classes() -> np.ndarray:
    """0 for ASCII without letters, 1 to 26 for its letters without case, and a class of its own for every other byte."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        if 65 <= b <= 90 or 97 <= b <= 122:
            out[b] = (b | 32) - 96
        elif b >= 0x80:
            out[b] = b - 0x80 + 27
    return out


CLASSES = _classes()


@dataclass
class Centroids:
    """A fitted model: trigram code to feature, idf, unit centroids with their languages and radii."""

    feature: np.ndarray
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: np.ndarray


def _codes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram code starting at each byte, the rows' offsets, and which bytes are ASCII letters or more."""
    data, at = byte_offsets(column)
    data = data[at[0] : at[-1]]
    at = at - at[0]
    c = CLASSES[data]
    codes = np.zeros(len(c), np.int32)
    if len(c) > 2:
        whole = (c[:-2] * 160 + c[1:-1]) * 160 + c[2:]
        codes[:-2] = np.where(whole > 0, 1 + (whole * 0x9E3779B1 >> 8) % (CODES - 1), 0)  # code 0: no letter
    return codes, at, c


def _texts_without_letters(column, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rows that are null or have no letter of any script."""
    ascii_letters = np.concatenate([[0], np.cumsum((classes > 0) & (classes < 27))])  # others are looked at one by one
    none = ascii_letters[at[1:]] == ascii_letters[at[:-1]]
    for i in np.flatnonzero(none):
        if any(ch.isalpha() for ch in column[int(i)].as_py() or ""):
            none[i] = False
    return none | column.is_null().to_numpy(zero_copy_only=False)


def _sparse_vectors(batches):
    """(lang, key, codes, counts) of each text."""
    for batch in small_batches(batches, 1):
        codes, at, _ = _codes(batch.column(1))
        rows, counts = [], []
        for a, b in zip(at[:-1], at[1:]):
            found, n = np.unique(codes[a : max(a, b - 2)], return_counts=True)
            rows.append(found.astype(np.int32))
            counts.append(n.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["lang", "key", "codes", "counts"])


def fit_centroids(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 2048, features: int = 4096, per_lang: int = 3, rounds: int = 12, least_rows: int = 8) -> Centroids | None:
    """Fit on a bounded sample of labelled rows: about ``sample_rows`` in all, an equal share for each language.

    The sample is the rows whose hash of id and text falls under the language's share, and the
    lowest one of each, so it doesn't depend on partitioning and every label is learned; rows
    equal in both are one. With many labels it grows to ``least_rows`` for each. Only sparse
    vectors of whole texts reach the driver.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    unit = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    counts = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.min(unit).alias("lowest")).orderBy("lang").collect()
    if not counts:
        return None
    sample_rows = max(sample_rows, least_rows * len(counts))
    share = sample_rows / len(counts)
    most = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(r["lowest"], min(1.0, share / r["n"])))])
    sample = known.where(unit <= most[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    sample = sample.groupBy("lang", "key").agg(F.first("text").alias("text")).select("lang", "text", "key")  # the same row again adds nothing
    vectors = sample.mapInArrow(_sparse_vectors, "lang string, key long, codes array<int>, counts array<int>").toArrow()
    vectors = vectors.take(pa.compute.sort_indices(vectors, sort_keys=[("key", "ascending"), ("lang", "ascending")]))  # the fit depends on no partition's order
    langs = np.array(vectors.column("lang").to_pylist(), object)
    if not len(langs):
        return None
    codes = vectors.column("codes").combine_chunks()
    at = codes.offsets.to_numpy() - codes.offsets[0].as_py()
    code = codes.flatten().to_numpy()
    count = vectors.column("counts").combine_chunks().flatten().to_numpy()
    df = np.bincount(code, minlength=CODES)
    df[0] = 0
    chosen = np.sort(np.argsort(-df, kind="stable")[:features])
    feature = np.full(CODES, features, np.int32)
    feature[chosen] = np.arange(len(chosen), dtype=np.int32)
    idf = (np.log((1 + len(langs)) / (1 + np.concatenate([df[chosen], np.zeros(features - len(chosen))]))) + 1).astype(np.float32)
    centroids, names, least = [], [], []
    labels, label = np.unique(langs, return_inverse=True)
    for lang, rows in zip(labels, np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))[:-1])):
        n = at[rows + 1] - at[rows]
        take = np.repeat(at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        own = np.zeros((len(rows), features + 1), np.float32)
        own[np.repeat(np.arange(len(rows)), n), feature[code[take]]] = count[take]
        own = _unit(np.log1p(own[:, :features]) * idf)
        own = own[np.linalg.norm(own, axis=1) > 0]
        if not len(own):
            continue
        centre = own[np.linspace(0, len(own) - 1, min(per_lang, len(own))).astype(int)]
        for _ in range(rounds):  # spherical k-means
            near = np.argmax(own @ centre.T, axis=1)
            centre = _unit(np.stack([own[near == k].sum(0) if (near == k).any() else centre[k] for k in range(len(centre))]))
        cosine = own @ centre.T
        near = cosine.argmax(1)
        for k in range(len(centre)):
            mine = cosine[near == k, k]
            centroids.append(centre[k])
            names.append(str(lang))
            least.append(float(np.quantile(mine, 0.005)) if len(mine) else 0.0)
    return Centroids(feature, idf, np.stack(centroids), names, np.array(least, np.float32)) if centroids else None


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def predict(column, model: Centroids | None, reject_share: float = 0.35, block: int = 256, enough: int = 64):
    """lang, score and rejected of each text of an Arrow string column; a text of under ``enough`` trigrams with a letter isn't rejected by its score."""
    n = len(column)
    if not n:
        return [], np.zeros(0), np.zeros(0, bool)
    codes, at, classes = _codes(column)
    none = _texts_without_letters(column, at, classes)
    langs, score, rejected = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
    if model is None:
        return langs.tolist(), score, rejected
    lettered = np.concatenate([[0], np.cumsum(codes > 0)])
    short = lettered[np.maximum(at[:-1], at[1:] - 2)] - lettered[at[:-1]] < enough
    feature, width, names = model.feature[codes], len(model.idf), np.array(model.langs, object)
    for first in range(0, n, block):
        last = min(n, first + block)
        x = np.zeros((last - first, width), np.float32)
        for i in range(first, last):
            x[i - first] = np.bincount(feature[at[i] : max(at[i], at[i + 1] - 2)], minlength=width + 1)[:width]
        cosine = _unit(np.log1p(x) * model.idf) @ model.centroids.T
        best = cosine.argmax(1)
        top = cosine[np.arange(last - first), best]
        langs[first:last] = names[best]
        score[first:last] = np.clip(top, 0, 1)
        rejected[first:last] = top < reject_share * model.least[best]
    rejected &= ~short
    langs[none], score[none], rejected[none] = "und", 0.0, True
    return langs.tolist(), score, rejected


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose crc32 of the id as text isn't 1 modulo 3; the others are held out."""
    return docs.where(F.crc32(F.col(id_col).cast("string")) % 3 != 1)


def identify(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text", reject_share: float = 0.35) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row; text is the only input of a prediction."""
    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids of fixed width

    def run(batches):
        for batch in small_batches(batches, 1):
            langs, score, rejected = predict(batch.column(1), shared.value, reject_share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Centroids | None, text_col: str = "text", reject_share: float = 0.35) -> DataFrame:
    """The rows of docs, with all their columns, whose language isn't rejected."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_batches(batches, at):
            _, _, rejected = predict(batch.column(at), shared.value, reject_share)
            yield batch.filter(pa.array(~np.asarray(rejected, bool)))

    return docs.mapInArrow(run, docs.schema)
