"""SimHash near-duplicates: a binary-trie self-join over 64-bit fingerprints.

Fingerprints come from 3-word shingles (A-Z lower-cased, words split at ASCII white space,
repeats counted) by XXH64 with seed 42; a bit is set where over half the hashes have it.
Equal fingerprints collapse to one before anything is joined. The join is over binary
tries: pairs of nodes are traversed together from the top, bits that differ are added up,
and a pair whose sum passes the budget is pruned. With budget b, two linked fingerprints
agree on one of b + 1 bit ranges, so one trie is kept for each range with that range on
top, where the budget is zero; its nodes of that depth are what the cluster is dealt.
A node with more than ``node_limit`` fingerprints is dealt again by its next ranges, so no
task gets an unbounded node and nothing is capped.

Three bits over three-word shingles find few copies with edits: at five-word similarity 0.8,
fingerprints differ in about ten of 64 bits. ``drop_near_duplicates`` therefore joins sketches:
three fingerprints over single words and word pairs, which edits change less, traversed with a
wider budget below a range of 16 bits that agrees, and then a comparison of 256 bits over
five-word shingles; a crowded node is cut into blocks there, each two of which meet. Bits of a sketch only make a similarity likely, so ``link_similar`` follows:
texts that no sketch linked meet again by parts of their shingle sets, one of which is the same
in both whenever the similarity is reached, and parities bound the shingles that differ.

Null and empty texts have fingerprint zero and link to each other. Ids need not be unique;
null ids take part, and a component's id is the smallest non-null one. Empty tables give
no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, materialize, utf8_rows
from tessera.llm.components import components

BITS = 64


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text. bytes.lower and bytes.split know ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = functools.partial(xxhash.xxh64_intdigest, seed=seed)
    if len(words) <= shingle:
        hashes = [digest(joined)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        hashes = [digest(joined[a:b]) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())]
    counts = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[first : first + (1 << 16)], "<u8")
        counts += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, hashed: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row, and th (a hash of the text) if ``hashed``."""
    also = [F.xxhash64(text_col).alias("th")] if hashed else []
    names = ["doc_id", "fp", *["th"] * hashed]

    def run(batches):
        for batch in batches:
            found = np.array([simhash(t, shingle) for t in utf8_rows(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], names)

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in names[1:]]])
    return docs.select(F.col(id_col), F.col(text_col), *also).mapInArrow(run, schema)


def _rotated(bits: Column, fixed: int, by: int) -> Column:
    """The low 64 - fixed bits turned left by ``by``; the fixed high ones stay."""
    width = BITS - fixed
    if not by:
        return bits
    mask = F.lit(-1) if not fixed else F.lit((1 << width) - 1)
    low = bits.bitwiseAND(mask)
    turned = F.shiftleft(low, by).bitwiseAND(mask).bitwiseOR(F.shiftrightunsigned(low, width - by))
    return turned if not fixed else bits.bitwiseAND(F.lit(-(1 << width))).bitwiseOR(turned)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Forest:
    """Minimum-label union-find over arrays of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> bool:
        changed = False
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                break
            changed = True
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up
        return changed


def trie_self_join(values: np.ndarray, tops: np.ndarray, fixed: np.ndarray, budget: int = 3, chunk: int = 1 << 17, leaf: int = 24, check: np.ndarray | None = None, check_budget: int = 0) -> np.ndarray:
    """Component label (an index) of each value; values are sorted within each top node.

    tops: where each top node's values begin (one more entry at the end); fixed: how many
    high bits its values share. Node pairs are kept in chunks of one depth on a stack, so
    memory is bounded by the chunk; a pair whose values all are in one component is pruned.
    check: further bits of each value (a row of words), which must differ in at most
    ``check_budget`` for a link; then a top node may hold a value several times.
    """
    forest = _Forest(len(values))
    joined_up = np.concatenate([[0], np.arange(len(values))])  # label changes up to each value

    def relabel():
        joined_up[1:] = np.concatenate([[0], np.cumsum(forest.label[1:] != forest.label[:-1])])

    def agree(i, j):
        return (_popcount(check[i] ^ check[j]).sum(axis=-1) <= check_budget) if check is not None else np.ones(np.broadcast(i, j).shape, bool)

    if check is not None and len(values):  # equal values of a node, which no bit of theirs tells apart
        node = np.repeat(np.arange(len(tops) - 1), np.diff(tops))
        new = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (node[1:] != node[:-1]), [True]]))
        linked = False
        for a, b in zip(new[:-1][np.diff(new) > 1], new[1:][np.diff(new) > 1]):
            linked |= _link_equal(np.arange(a, b), agree, forest)
        if linked:
            relabel()
    stack = []
    for depth in np.unique(fixed):
        own = np.flatnonzero((fixed == depth) & (np.diff(tops) > 1))
        for first in range(0, len(own), chunk):
            k = own[first : first + chunk]
            lo, hi = tops[:-1][k], tops[1:][k]
            stack.append((int(depth), lo, hi, lo, hi, np.zeros(len(k), np.uint8)))
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        same = alo == blo
        one = forest.label[alo] == forest.label[blo]
        one &= (joined_up[ahi] == joined_up[alo + 1]) & (joined_up[bhi] == joined_up[blo + 1])
        keep = ~one | ((ahi - alo) * (bhi - blo) == 1) & ~same
        keep &= ~(same & ((ahi - alo == 1) | (depth == BITS)))
        alo, ahi, blo, bhi, diff, same = (x[keep] for x in (alo, ahi, blo, bhi, diff, same))
        size = (ahi - alo) * (bhi - blo)
        small = size <= leaf
        if small.any():
            n = size[small]
            pair = np.repeat(np.flatnonzero(small), n)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            width = (bhi - blo)[pair]
            i, j = alo[pair] + at // width, blo[pair] + at % width
            near = np.flatnonzero((i < j) & (_popcount(values[i] ^ values[j]) <= budget))
            near = near[agree(i[near], j[near])]
            if len(near) and forest.link(i[near], j[near]):
                relabel()
        alo, ahi, blo, bhi, diff, same = (x[~small] for x in (alo, ahi, blo, bhi, diff, same))
        if depth == BITS:  # two values, each there several times
            linked = False
            for a, b, c, d in zip(alo, ahi, blo, bhi):
                linked |= _link_between(np.arange(a, b), np.arange(c, d), agree, forest)
            if linked:
                relabel()
            continue
        if not len(alo):
            continue
        bit = np.uint64(1 << (BITS - 1 - depth))
        asplit, bsplit = _splits(values, alo, ahi, bit), _splits(values, blo, bhi, bit)
        parts = [
            (alo, asplit, blo, bsplit, diff, np.ones(len(alo), bool)),
            (asplit, ahi, bsplit, bhi, diff, np.ones(len(alo), bool)),
            (alo, asplit, bsplit, bhi, diff + 1, diff < budget),
            (asplit, ahi, blo, bsplit, diff + 1, (diff < budget) & ~same),
        ]
        merged = []
        for p in zip(*parts):
            merged.append(np.concatenate(p))
        alo, ahi, blo, bhi, diff, ok = merged
        ok &= (ahi > alo) & (bhi > blo)
        alo, ahi, blo, bhi, diff = (x[ok] for x in (alo, ahi, blo, bhi, diff))
        for first in range(0, len(alo), chunk):
            s = slice(first, first + chunk)
            stack.append((depth + 1, alo[s], ahi[s], blo[s], bhi[s], diff[s]))
    return forest.label


def _link_equal(rows: np.ndarray, agree, forest: _Forest) -> bool:
    """Link rows of one value that agree, breadth first: each linked row is compared with those not linked yet."""
    linked = False
    while len(rows) > 1:
        reached, rows = rows[:1], rows[1:]
        while len(reached) and len(rows):
            near = agree(reached[0], rows)
            if near.any():
                linked |= forest.link(np.full(int(near.sum()), reached[0]), rows[near])
            reached, rows = np.concatenate([reached[1:], rows[near]]), rows[~near]
    return linked


def _link_between(a: np.ndarray, b: np.ndarray, agree, forest: _Forest) -> bool:
    linked = False
    for x in a:
        other = b[forest.label[b] != forest.label[x]]
        near = other[agree(x, other)] if len(other) else other
        if len(near):
            linked |= forest.link(np.full(len(near), x), near)
    return linked


def _splits(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where each node's values with the bit set begin, by bisection of all nodes at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = (values[np.minimum(mid, len(values) - 1)] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _join_nodes(budget: int, checks: int = 0, check_budget: int = 0, rows: int = 1 << 18):
    """Of trie nodes in order: each linked row's label with the smallest label of its component there."""

    def solve(parts):
        node, fixed, turned, label, *check = (np.concatenate(x) for x in zip(*parts))
        turned = turned.view(np.uint64)
        order = np.lexsort((label, turned, node))
        node, fixed, turned, label, *check = (x[order] for x in (node, fixed, turned, label, *check))
        begins = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        found = trie_self_join(turned, np.concatenate([begins, [len(node)]]), fixed[begins], budget, check=np.stack(check, axis=1).view(np.uint64) if check else None, check_budget=check_budget)
        linked = np.flatnonzero(found != np.arange(len(found)))
        for first in range(0, len(linked), 1 << 16):
            k = linked[first : first + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(label[k]), pa.array(label[found[k]])], ["u", "v"])

    def run(batches):
        names = ["node", "fixed", "turned", "label", *[f"c{i}" for i in range(checks)]]
        parts, held = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(n).to_numpy() for n in names]
            if held + b.num_rows > rows:  # whole nodes only, which are of bounded size
                last = int(np.searchsorted(part[0], part[0][-1], "left"))
                new = not parts or parts[-1][0][-1] != part[0][-1]
                if last or new:
                    yield from solve([*parts, [x[:last] for x in part]] if last else parts) if parts or last else ()
                    parts, held, part = [], 0, [x[last:] for x in part]
            parts.append(part)
            held += len(part[0])
        if parts:
            yield from solve(parts)

    return run


def _deal(rows: DataFrame, ranges: int, node_limit: int) -> list[DataFrame]:
    """Rows (label, turned, node, fixed, checks), dealt to nodes by the bits that must agree, crowded nodes again by their next ranges."""
    checks = [c for c in rows.columns if c not in ("label", "turned", "node", "fixed")]
    out, fixed = [], BITS // ranges
    while True:
        width = (BITS - fixed) // ranges
        crowded = rows.groupBy("node").count().where(F.col("count") > node_limit).select("node")
        if width < 2 or crowded.isEmpty():
            return [*out, rows]
        crowded = materialize(crowded, "crowded")
        out.append(rows.join(crowded, "node", "left_anti").select("label", "turned", "node", "fixed", *checks))
        turns = F.array(*[F.struct(F.lit(r).alias("turn"), _rotated(F.col("turned"), fixed, r * width).alias("turned")) for r in range(ranges)])
        fixed += width
        rows = rows.join(crowded, "node").select("label", "node", F.explode(turns).alias("x"), *checks)
        rows = materialize(rows.select("label", "x.turned", F.xxhash64("node", "x.turn", F.shiftrightunsigned("x.turned", BITS - fixed)).alias("node"), F.lit(fixed).alias("fixed"), *checks), "dealt-again")


def _block_pairs(rows: DataFrame, item: str, node_limit: int) -> DataFrame:
    """Rows whose crowded nodes are cut into blocks, with a node for each two of them (a block with itself too), so that all pairs still meet.

    The low five bits of a node, where ``link_similar`` keeps the family, stay.
    """
    crowded = rows.groupBy("node").count().where(F.col("count") > node_limit)
    if crowded.isEmpty():
        return rows
    crowded = materialize(crowded.select("node", F.ceil(2 * F.col("count") / node_limit).alias("blocks")), "crowded")
    own, other, low = F.pmod(F.xxhash64(item), "blocks"), F.col("other"), F.lit(31).cast("long")
    split = rows.join(crowded, "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    node = F.xxhash64("node", F.least("own", other), F.greatest("own", other)).bitwiseAND(F.lit(-32).cast("long")).bitwiseOR(F.col("node").bitwiseAND(low))
    split = split.withColumn("node", node).select(*rows.columns)
    return rows.join(crowded, "node", "left_anti").select(*rows.columns).unionByName(split)


def _linked(dealt: list[DataFrame], budget: int, check_budget: int = 0) -> DataFrame:
    checks = len(dealt[0].columns) - 4
    found = [x.repartition("node").sortWithinPartitions("node").mapInArrow(_join_nodes(budget, checks, check_budget), "u long, v long") for x in dealt]
    return components(functools.reduce(DataFrame.unionByName, found))


def link_fingerprints(prints: DataFrame, budget: int = 3, node_limit: int = 200_000) -> DataFrame:
    """(node, root) of each distinct fingerprint in column fp that isn't its component's smallest one."""
    ranges = budget + 1
    width = BITS // ranges
    distinct = materialize(prints.select("fp").distinct(), "fingerprints")
    turns = F.array(*[F.struct(F.lit(r).alias("turn"), _rotated(F.col("fp"), 0, r * width).alias("turned")) for r in range(ranges)])
    rows = distinct.select("fp", F.explode(turns).alias("x"))
    rows = rows.select(F.col("fp").alias("label"), "x.turned", F.xxhash64("x.turn", F.shiftrightunsigned("x.turned", BITS - width)).alias("node"), F.lit(width).alias("fixed"))
    return _linked(_deal(rows, ranges, node_limit), budget)


#: Longs of a sketch: three values that are joined, and four that are compared.
VALUES, CHECKS = 3, 4


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    z = h + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 1 << 15):
        part = hashes[first : first + (1 << 15)]
        counts += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of ``width`` consecutive words, or of all where there are fewer."""
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(_ODD) + words[i : len(words) - width + 1 + i]
    return np.unique(_mixed(out, width))


_ODD = 0x9E3779B97F4A7C15


def _word_hashes(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    words = text.lower().split()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, seed=42)
    return np.array([known[w] for w in words], np.uint64)


def sketch(text: bytes, known: dict[bytes, int], shingle: int = 5) -> list[int]:
    """Fingerprints over distinct shingles: three values, each of 48 bits from words or word pairs and 16 from ``shingle`` words, and 256 bits from ``shingle`` words."""
    h = _word_hashes(text, known)
    return _sketch(h, _shingles(h, shingle)) if len(h) else [0] * (VALUES + CHECKS)


def _sketch(h: np.ndarray, long: np.ndarray) -> list[int]:
    single, pairs = np.unique(h), _shingles(h, 2)
    low = (1 << 16) - 1
    tail = _majority(_mixed(long, 13))
    values = [_majority(_mixed(single, 1)), _majority(_mixed(single, 2)), _majority(_mixed(pairs, 3))]
    return [v & ~low | (tail >> 16 * k) & low for k, v in enumerate(values)] + [_majority(_mixed(long, 20 + k)) for k in range(CHECKS)]


def _most(similarity: float, n: int) -> int:
    """The most shingles by which a set of n and one so similar to it differ: those of both that only one has."""
    return math.floor((1 - similarity) / similarity * n + 1e-9)


def _parity_bits(family: int) -> int:
    return max(256, 2 << family)


def set_parts(long: np.ndarray, similarity: float) -> tuple[np.ndarray, bytes]:
    """Parts of a set of shingle hashes (sorted, different), and the parities of their numbers at each place.

    A family (the low five bits of a part) is for sets of up to two to its power; a set that a
    larger family's set can be so similar to takes part in both. There the hashes are cut by
    their range into parts, of which a shingle that differs changes one. With at most d that
    differ, the first part with a hash that is the same in both is among the first d + 1 with a
    hash of either set; where one has fewer, it gives all its parts, empty ones too, and what
    agrees in two such sets may be an empty one.
    """
    n = len(long)
    if not n:
        return np.zeros(0, np.int64), b""
    most, own = _most(similarity, n), (n - 1).bit_length()
    families = [own] + [own + 1] * (math.floor(n / similarity + 1e-9) > 1 << own)
    mixed, out = _mixed(long, 31), []
    for f in families:
        count = _most(similarity, 1 << f) * 6 // 5 + 5
        part = ((long >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums, place = np.add.reduceat(mixed, begins), part[begins]
        if len(place) <= most:
            empty = np.setdiff1d(np.arange(count), place)
            sums, place = np.concatenate([sums, np.zeros(len(empty), np.uint64)]), np.concatenate([place, empty])
        else:
            sums, place = sums[: most + 1], place[: most + 1]
        h = _mixed(sums + _mixed(place.astype(np.uint64), 32 + f), 33)
        out.append(h & ~np.uint64(31) | np.uint64(f))
    bits = _parity_bits(families[-1])
    odd = np.bincount((long & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.concatenate(out).view(np.int64), np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float | None = None) -> DataFrame:
    """doc_id, th (a hash of the text), sig (a hash of the sketch), v0 to v2 and c0 to c3 of every row; with a similarity also size (number of shingles), parts and parity."""
    names = [*[f"v{i}" for i in range(VALUES)], *[f"c{i}" for i in range(CHECKS)]]
    sets = [] if similarity is None else ["size", "parts", "parity"]

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            rows, sizes, parts, parity = [], [], [], []
            for t in utf8_rows(batch.column(2)):
                h = _word_hashes(t, known)
                long = _shingles(h, shingle) if len(h) else h
                rows.append(_sketch(h, long) if len(h) else [0] * (VALUES + CHECKS))
                if sets:
                    found = set_parts(long, similarity)
                    sizes.append(len(long))
                    parts.append(found[0])
                    parity.append(found[1])
            found = np.array(rows, np.uint64).reshape(-1, VALUES + CHECKS).view(np.int64)
            columns = [batch.column(0), batch.column(1), *[pa.array(found[:, k].copy()) for k in range(VALUES + CHECKS)]]
            if sets:
                ends = np.cumsum([0, *map(len, parts)])
                columns += [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))), pa.array(parity, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", *names, *sets])
            if len(known) > 1 << 20:
                known.clear()

    kinds = [T.LongType(), T.ArrayType(T.LongType()), T.BinaryType()]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("th", *names)], *[T.StructField(n, k) for n, k in zip(sets, kinds)]])
    found = docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col)).mapInArrow(run, schema)
    return found.withColumn("sig", F.xxhash64(*names))


def differing_bits(similarity: float, bits: int, spread: float = 1.3) -> int:
    """The bits in which fingerprints of texts of a set similarity differ, and ``spread`` standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + spread * math.sqrt(bits * p * (1 - p)))


def link_sketches(prints: DataFrame, similarity: float = 0.8, budget: int = 10, ranges: int = 4, node_limit: int = 8192) -> DataFrame:
    """(node, root) of each distinct sig that isn't its component's smallest one.

    Two sketches link if one of their values agrees in one of its ranges and differs in at most
    ``budget`` bits in all, and if their compared bits differ no more than ``similarity`` makes
    likely. A range of 16 bits agrees in most near copies but in few others, so twelve of them
    reach what a budget that wide could not if every range of it had to be tried. A node of more
    than ``node_limit`` is searched by pairs of blocks.
    """
    width = BITS // ranges
    names = [*[f"v{i}" for i in range(VALUES)], *[f"c{i}" for i in range(CHECKS)]]
    distinct = materialize(prints.groupBy("sig").agg(*[F.first(n).alias(n) for n in names]), "sketches")
    turns = F.array(*[F.struct(F.lit(v * ranges + r).alias("turn"), _rotated(F.col(f"v{v}"), 0, r * width).alias("turned")) for v in range(VALUES) for r in range(ranges)])
    checks = [f"c{i}" for i in range(CHECKS)]
    rows = distinct.select("sig", F.explode(turns).alias("x"), *checks)
    rows = rows.select(F.col("sig").alias("label"), "x.turned", F.xxhash64("x.turn", F.shiftrightunsigned("x.turned", BITS - width)).alias("node"), F.lit(width).alias("fixed"), *checks)
    return _linked([_block_pairs(rows, "label", node_limit)], budget, differing_bits(similarity, CHECKS * BITS))


def _folded(parity: list[bytes], words: int) -> np.ndarray:
    """Parities at words * 64 places, folded from those at more."""
    out = np.zeros((len(parity), words), np.uint64)
    for i, p in enumerate(parity):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(p, "<u8").reshape(-1, words), axis=0)
    return out


def similar_links(node: np.ndarray, label: np.ndarray, size: np.ndarray, parity: list[bytes], similarity: float, chunk: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Links (label, smallest label) of rows of one node whose parities differ no more than sets so similar can.

    Rows are compared in chunks of pairs, and only while their labels are apart.
    """
    names, at = np.unique(label, return_inverse=True)
    forest = _Forest(len(names))
    ratio = (1 - similarity) / (1 + similarity)
    for f in np.unique(node & 31):
        rows = np.flatnonzero((node & 31) == f)
        rows = rows[np.lexsort((size[rows], node[rows]))]
        words = _parity_bits(int(f)) // 64
        bits, own, n, begin = _folded([parity[i] for i in rows], words), at[rows], size[rows], node[rows]
        rank = np.cumsum(np.concatenate([[0], begin[1:] != begin[:-1]]))
        wide = int(n.max() / similarity) + 2  # rows of a node in order of size, up to the largest a row can be so similar to
        partners = np.searchsorted(rank * wide + n, rank * wide + np.floor(n / similarity + 1e-9).astype(np.int64), "right") - np.arange(len(rows)) - 1
        upto = np.concatenate([[0], np.cumsum(partners)])
        step, first = max(1, chunk // words), 0  # pairs of rows, numbered by their first row
        while first < upto[-1]:
            pair = np.arange(first, min(first + step, upto[-1]))
            i = np.searchsorted(upto, pair, "right") - 1
            j = i + 1 + pair - upto[i]
            apart = forest.label[own[i]] != forest.label[own[j]]
            i, j = i[apart], j[apart]
            for part in (slice(0, 4), slice(0, words)):  # 256 bits tell most apart
                near = _popcount(bits[i, part] ^ bits[j, part]).sum(axis=1, dtype=np.int64) <= np.floor(ratio * (n[i] + n[j]) + 1e-9)
                i, j = i[near], j[near]
            forest.link(own[i], own[j])
            first += step
    linked = np.flatnonzero(forest.label != np.arange(len(names)))
    return names[linked], names[forest.label[linked]]


def _link_nodes(similarity: float, most: int = 16 << 20):
    """Of rows (node, label, size, parity) in order of the node: each node's links."""

    def solve(parts):
        node, label, size = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in range(3))
        u, v = similar_links(node, label, size, [x for b in parts for x in b.column(3).to_pylist()], similarity)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            if held + b.nbytes > most:  # whole nodes only
                node = b.column(0).to_numpy()
                last = int(np.searchsorted(node, node[-1], "left"))
                if last:
                    yield solve([*parts, b.slice(0, last)])
                    parts, held, b = [], 0, b.slice(last)
                elif parts and parts[-1].column(0)[-1].as_py() != node[0]:
                    yield solve(parts)
                    parts, held = [], 0
            parts.append(b)
            held += b.nbytes
        if parts:
            yield solve(parts)

    return run


def link_similar(prints: DataFrame, roots: DataFrame, similarity: float = 0.8, node_limit: int = 8192) -> DataFrame:
    """(node, root) as in ``roots``, joined up where texts of different roots have shingle sets of at least ``similarity``.

    No such pair is left out: sets so similar have a part in common (``set_parts``), and parities
    differ at no more places than shingles do. Parts that one root alone has are dropped before
    anything is compared, and parts with the same texts are compared once. A part that more than
    ``node_limit`` texts share is searched by pairs of blocks.
    """
    rooted = prints.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("th", F.coalesce("root", "sig").alias("label"), F.explode("parts").alias("part"))
    w = Window.partitionBy("part")
    low, high = F.min("label").over(w), F.max("label").over(w)
    texts = F.xxhash64(F.count(F.lit(1)).over(w), F.min("th").over(w), F.max("th").over(w), F.sum(F.shiftrightunsigned("th", 32)).over(w))
    shared = rooted.select("th", "label", "part", low.alias("low"), high.alias("high"), texts.alias("texts")).where("low < high")
    family = F.col("part").bitwiseAND(F.lit(31).cast("long"))
    shared = materialize(shared.select("th", "label", F.col("texts").bitwiseAND(F.lit(-32).cast("long")).bitwiseOR(family).alias("node")).distinct(), "shared-parts")
    sets = prints.join(shared.select("th").distinct(), "th", "left_semi").groupBy("th").agg(F.first("size").alias("size"), F.first("parity").alias("parity"))
    rows = _block_pairs(shared, "th", node_limit).join(sets, "th").select("node", "label", "size", "parity").repartition("node").sortWithinPartitions("node")
    more = components(rows.mapInArrow(_link_nodes(similarity), "u long, v long"))
    discard(shared)
    further = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return roots.join(further, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, shingle: int = 3, node_limit: int = 200_000) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable, itself included) of every row."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "prints")
    roots = link_fingerprints(prints, budget, node_limit)
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = smallest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.join(lows, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest id.

    Groups are components of texts whose sets of ``shingle`` words are at least ``similarity``
    alike, or whose sketches say they are about so. Rows without an id rank last; rows that repeat an id are told apart
    by a hash of their text; of rows equal in both a single one stays.
    """
    prints = materialize(sketches(docs, id_col, text_col, shingle, similarity), "prints")
    roots = link_similar(prints, link_sketches(prints, similarity), similarity)
    rows = prints.groupBy("sig", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "n")
    first = rows.groupBy("sig").agg(F.min(rank).alias("first")).join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    keep = first.groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("first").alias("first"))
    keep = materialize(keep.select(F.col("first.doc_id").alias("__kept"), F.col("first.th").alias("__th"), F.col("first.n").alias("__n")), "kept-rows")
    discard(prints)
    same = F.col(id_col).eqNullSafe(F.col("__kept")) & (F.xxhash64(text_col) == F.col("__th"))
    # Most rows stay, so they are as many as the documents: merged at every size, never broadcast.
    stay = docs.join(keep.where("__n = 1").hint("merge"), same, "left_semi")
    again = keep.where("__n > 1")
    if again.isEmpty():
        return stay
    return stay.unionByName(docs.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
