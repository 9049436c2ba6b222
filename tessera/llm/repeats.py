"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that also starts elsewhere.

A Burrows-Wheeler transform of the whole table at once would not fit a task, so the table is
first cut into pieces that can be searched apart, without losing a pair of places:

1. Texts are UTF-8 bytes (null: empty). Equal texts are one text of the collection; each
   copy of length or more bytes is covered whole, as its twin starts the same strings.
2. Every byte run of ``gram`` bytes is hashed, and each ``span`` consecutive runs yield
   their smallest hash as an anchor. Equal strings have equal anchors, so a string with an
   anchor that the collection has once cannot repeat. Anchors are counted over all texts.
3. The remaining strings are dealt by the smallest hash in them, neighbours with the same
   one together as a chunk. Equal strings are always dealt alike. Equal chunks are combined
   with their number.
4. In each group the strings that repeat are found by breadth-first backward extension on
   the transform of its chunks (bwt.py), stopping at ``length``.

A group of more than ``group_bytes`` of different chunks, or of more than ``group_rows`` of them,
is dealt again by where the smallest hash stands in the string and by the bytes that all
strings of such a place share, in steps down to single strings, where combining equal ones is
the answer; so no task gets an unbounded group and nothing is dropped.

Texts are told apart by a 64-bit hash with length and CRC-32. Repeated ids and rows count
as copies. Empty tables give no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bwt import repeated_starts
from tessera.llm.common import byte_offsets, discard, materialize, small_batches, utf8_rows
from tessera.llm.linedup import SPAN, merge_spans

GRAM, WIDTH = 32, 200
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position on, equal for equal bytes."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    up, down = _powers
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def sliding(x: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """Smallest (or largest) of each ``width`` consecutive values, in two passes over blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = -(-n // width)
    fill = np.full(blocks * width, x[-1], x.dtype)
    fill[:n] = x
    rows = fill.reshape(blocks, width)
    ahead = least.accumulate(rows, axis=1).ravel()
    behind = least.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, places) of the texts of at least ``length`` bytes in a batch."""
    none = np.zeros(0, np.int64)
    if len(data) < GRAM + WIDTH or not (np.diff(at) >= length).any():
        return none, none, none
    h = gram_hashes(data)
    low = sliding(h, WIDTH)
    valid = np.zeros(len(low) + 1, np.int32)  # windows within one long text
    long = np.flatnonzero(np.diff(at) >= length)
    np.add.at(valid, at[long], 1)
    np.add.at(valid, at[long + 1] - GRAM - WIDTH + 2, -1)
    low[np.cumsum(valid[:-1]) == 0] = 0
    reach = sliding(np.concatenate([np.zeros(WIDTH - 1, np.uint64), low, np.zeros(WIDTH - 1, np.uint64)]), WIDTH, np.maximum)
    place = np.flatnonzero((reach[: len(h)] == h) & (h != 0))
    row = np.searchsorted(at, place, "right") - 1
    value = h[place].view(np.int64)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])) if len(row) else none
    return row[new], value[new], np.diff(np.concatenate([new, [len(row)]]))


def _anchor_table(texts: DataFrame, length: int) -> DataFrame:
    """(th, tl, anchors, places) of texts that have an anchor."""

    def run(batches):
        for batch in small_batches(batches, 2, 2 << 20):
            data, at = byte_offsets(batch.column(2))
            data, at = data[at[0] : at[-1]], at - at[0]
            row, value, n = anchors(data, at, length)
            some, first = np.unique(row, return_index=True)
            offsets = pa.array(np.concatenate([first, [len(row)]]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), pa.ListArray.from_arrays(offsets, pa.array(value, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(np.minimum(n, 2), pa.int32()))],
                ["th", "tl", "anchors", "places"],
            )

    return texts.select("th", "tl", "text").mapInArrow(run, "th long, tl long, anchors array<long>, places array<int>")


def chunks(data: np.ndarray, repeated: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(key, start, end) of the strings of a text whose anchors all repeat, by smallest hash."""
    n = len(data)
    h = gram_hashes(data)
    low = sliding(h, WIDTH)
    change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    known = np.isin(low[change].view(np.int64), repeated)
    bad = np.zeros(len(low) + 1, np.int32)
    bad[1:] = np.cumsum(np.repeat(~known, np.diff(np.concatenate([change, [len(low)]]))))
    within = length - GRAM - WIDTH + 2  # anchors in one string
    good = bad[within:] == bad[:-within]
    key = sliding(h, length - GRAM + 1)
    starts = n - length + 1
    good, key = good[:starts], key[:starts]
    cut = np.flatnonzero(np.concatenate([[True], (good[1:] != good[:-1]) | (key[1:] != key[:-1])]))
    ends = np.concatenate([cut[1:], [starts]])
    return [(int(key[a]), int(a), int(b) - 1 + length) for a, b in zip(cut, ends) if good[a]]


_CHUNK = "key long, digest binary, th long, tl long, start int, data binary"


def _chunk_batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "digest", "th", "tl", "start", "data"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chunk_table(marked: DataFrame, length: int) -> DataFrame:
    """Chunks of the texts in (th, tl, text, repeated)."""

    def run(batches):
        for batch in small_batches(batches, 2):
            th, tl = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, held = [], 0
            for i, t in enumerate(utf8_rows(batch.column(2))):
                repeated = np.sort(batch.column(3)[i].values.to_numpy(zero_copy_only=False))
                for key, a, b in chunks(np.frombuffer(t, np.uint8), repeated, length):
                    rows.append((_signed(key), xxhash.xxh3_128_digest(t[a:b]), th[i], tl[i], a, t[a:b]))
                    held += b - a
                if held > 4 << 20:
                    yield _chunk_batch(rows)
                    rows, held = [], 0
            yield _chunk_batch(rows)

    return marked.mapInArrow(run, _CHUNK)


def deal_again(data: bytes, step: int, length: int) -> list[tuple[int, int, int]]:
    """(key, start, end) of a chunk's strings by where their smallest hash stands, in classes of ``step`` places.

    All strings of a class share the bytes from the last start it allows to the first end;
    those are part of the key, so with step 1 the key holds the whole string.
    """
    h = gram_hashes(np.frombuffer(data, np.uint8))
    starts = len(data) - length + 1
    width = length - GRAM + 1
    low = sliding(h, width)[:starts]
    place = np.array([s + int(np.argmax(h[s : s + width] == low[s])) for s in range(starts)])
    klass = (place - np.arange(starts)) // step
    out, a = [], 0
    for b in range(1, starts + 1):
        if b == starts or klass[b] != klass[a] or place[b] != place[a]:
            top = int(place[a]) - int(klass[a]) * step
            core = data[top : top - step + 1 + length]
            out.append((_signed(xxhash.xxh3_64_intdigest(core, seed=int(klass[a]) * 1000 + step)), a, b - 1 + length))
            a = b
    return out


def _deal_again(rows: DataFrame, step: int, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out, held = [], 0
            for r in batch.to_pylist():
                for key, a, b in deal_again(r["data"], step, length):
                    piece = r["data"][a:b]
                    out.append((key, xxhash.xxh3_128_digest(piece), r["th"], r["tl"], r["start"] + a, piece))
                    held += b - a
                if held > 4 << 20:
                    yield _chunk_batch(out)
                    out, held = [], 0
            yield _chunk_batch(out)

    return rows.mapInArrow(run, _CHUNK)


def _search(length: int, batch_bytes: int = 1 << 20):
    """Of groups of different chunks (key, digest, n, data): covered spans of each chunk that has some."""

    def solve(keys, digests, counts, texts):
        spans = [[] for _ in texts]
        sizes: dict[int, int] = {}
        for k in keys:
            sizes[k] = sizes.get(k, 0) + 1
        search = [i for i, k in enumerate(keys) if sizes[k] > 1 or counts[i] == 1]
        if search:
            for i, at in zip(search, repeated_starts([texts[i] for i in search], length)):
                if len(at):
                    jump = np.flatnonzero(np.diff(at) > length)
                    spans[i] = list(zip(at[np.concatenate([[0], jump + 1])].tolist(), (at[np.concatenate([jump, [len(at) - 1]])] + length).tolist()))
        for i, n in enumerate(counts):
            if n > 1:
                spans[i] = [(0, len(texts[i]))]
        some = [i for i, s in enumerate(spans) if s]
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[i] for i in some], pa.int64()), pa.array([digests[i] for i in some], pa.binary()), pa.array([[{"start": a, "end": b} for a, b in spans[i]] for i in some], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            ["key", "digest", "spans"],
        )

    def run(batches):
        keys, digests, counts, texts, held = [], [], [], [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                k, d, n, t = (batch.column(i)[row].as_py() for i in range(4))
                if held > batch_bytes and k != keys[-1]:
                    yield solve(keys, digests, counts, texts)
                    keys, digests, counts, texts, held = [], [], [], [], 0
                keys.append(k)
                digests.append(d)
                counts.append(n)
                texts.append(t)
                held += len(t)
        if keys:
            yield solve(keys, digests, counts, texts)

    return run


def covered_chunks(rows: DataFrame, length: int, group_bytes: int, group_rows: int, steps: tuple[int, ...]) -> list[tuple[DataFrame, DataFrame]]:
    """(chunks, spans of different chunks) for the groups as dealt and, where one is too large, as dealt again."""
    out = []
    for step in (*steps, 0):
        different = whole = materialize(rows.groupBy("key", "digest").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("n"), F.first("data").alias("data")), "different-chunks")
        large = different.groupBy("key").agg(F.sum(F.length("data")).alias("bytes"), F.count(F.lit(1)).alias("kinds"))
        # Many kinds alone are dealt again once: a finer step multiplies the bytes, and would for chunks of little of them.
        most = group_rows if step == steps[0] else 1 << 62
        large = large.where((F.col("kinds") > 1) & ((F.col("bytes") > group_bytes) | (F.col("kinds") > most))).select("key")
        again = bool(step) and not large.isEmpty()
        if again:
            large = materialize(large, "large-groups")
            different = different.join(large, "key", "left_anti").select("key", "digest", "n", "data")
        dealt = different.repartition("key").sortWithinPartitions("key")
        found = materialize(dealt.mapInArrow(_search(length), T.StructType([T.StructField("key", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("spans", T.ArrayType(SPAN))])), "covered")
        # Where a chunk lies is all that is needed later on; its bytes go once they are dealt again.
        out.append((materialize(rows.select("key", "digest", "th", "tl", "start"), "places"), found))
        held = rows
        if again:
            rows = materialize(_deal_again(rows.join(large, "key", "left_semi").select("key", "digest", "th", "tl", "start", "data"), step, length), "dealt-again")
        discard(held, whole)
        if not again:
            return out
    return out


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 8 << 20, group_rows: int = 1024, steps: tuple[int, ...] = (64, 8, 1)) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes) and removed (maximal runs as start, end in bytes) of every row."""
    if length < GRAM + WIDTH:
        raise ValueError(f"length must be at least {GRAM + WIDTH} bytes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = base.withColumns({"th": F.xxhash64("text"), "tl": F.shiftleft(F.octet_length("text").cast("long"), 32).bitwiseOR(F.crc32(F.col("text").cast("binary")))})
    key = ["th", "tl"]
    copies = base.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep"))
    table = _anchor_table(base.where(F.octet_length("text") >= length), length)
    table = materialize(table.dropDuplicates(key), "anchors")
    pairs = table.select(*key, F.explode(F.arrays_zip("anchors", "places")).alias("a")).select(*key, F.col("a.anchors").alias("anchor"), F.col("a.places").alias("places"))
    repeated = pairs.groupBy("anchor").agg(F.sum("places").alias("n")).where("n > 1").select("anchor")
    marks = pairs.select(*key, "anchor").join(repeated, "anchor").groupBy(*key).agg(F.collect_list("anchor").alias("repeated"))
    copies = materialize(copies, "copies")
    # One row of each text carries it on; a null id is never the smallest unless it is the only one.
    marks = marks.join(copies, key).select(*key, "repeated", "rep")
    carried = base.select("doc_id", *key, "text").join(marks.select(*(F.col(c).alias(f"m_{c}") for c in (*key, "rep")), "repeated"), (F.col("th") == F.col("m_th")) & (F.col("tl") == F.col("m_tl")) & F.col("doc_id").eqNullSafe(F.col("m_rep")))
    rows = materialize(_chunk_table(carried.select("th", "tl", "text", "repeated"), length), "chunks")
    discard(table)
    spans, stages = None, covered_chunks(rows, length, group_bytes, group_rows, steps)
    for held, found in stages:
        part = held.select("key", "digest", *key, "start").join(found, ["key", "digest"])
        part = part.select(*key, F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end"))).alias("spans"))
        spans = part if spans is None else spans.unionByName(part)
    spans = spans.groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    info = copies.join(spans, key, "left").where((F.col("n") > 1) | F.col("spans").isNotNull())
    info = info.select(F.col("th").alias("i_th"), F.col("tl").alias("i_tl"), (F.col("n") > 1).alias("copied"), "spans")
    # Written, so that both sides of the join are plain shuffles and Spark can split the rows of a text with many copies.
    info = materialize(info, "covered-texts")
    discard(copies, *(part for stage in stages for part in stage))
    joined = base.join(info, (F.col("th") == F.col("i_th")) & (F.col("tl") == F.col("i_tl")), "left").select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "spans")

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in small_batches(batches, 1):
            n_bytes, kept, removed = [], [], []
            for t, copied, found in zip(utf8_rows(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if copied and len(t) >= length:
                    merged = [(0, len(t))]
                else:
                    merged = merge_spans((x["start"], x["end"]) for x in found or ())
                at, pieces = 0, []
                for a, b in merged:
                    pieces.append(t[at:a])
                    at = b
                n_bytes.append(len(t))
                kept.append(b"".join([*pieces, t[at:]]))
                removed.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, span)], ["doc_id", "n_bytes", "kept", "removed"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("removed", T.ArrayType(SPAN))])
    return joined.mapInArrow(run, schema)

