"""Sharding by Karmarkar-Karp differencing, for groups that must not be split.

Groups are the equal texts. Small groups fall into a fixed number of bundles by content
hash; a group larger than an even share of the bundles is a bundle of its own, so there
are never more than twice ``bundles`` of them whatever the input. The driver runs
multi-way differencing over that bounded list: the two partial partitions with the
largest spread are combined, oppositely ordered, until one remains.

Null texts count as empty ones. An empty table gives no rows. Repeated rows each take a
slot. Columns other than the id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def differencing(weights: list[int], parts: int) -> list[int]:
    """The part (0 to parts - 1) of each weight, by multi-way Karmarkar-Karp differencing.

    A partial partition holds, by descending sum, its parts' sums less the smallest one
    and their members as nested pairs. Ties go to the earlier entry.
    """
    if not weights:
        return []
    heap = [(-w, i, [w] + [0] * (parts - 1), [i] + [None] * (parts - 1)) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    made = len(weights)
    while len(heap) > 1:
        _, _, left, in_left = heapq.heappop(heap)
        _, _, right, in_right = heapq.heappop(heap)
        joined = [
            (left[k] + right[-1 - k], k, in_left[k] if in_right[-1 - k] is None else in_right[-1 - k] if in_left[k] is None else (in_left[k], in_right[-1 - k]))
            for k in range(parts)
        ]
        joined.sort(key=lambda x: (-x[0], x[1]))
        low = joined[-1][0]
        heapq.heappush(heap, (low - joined[0][0], made, [x[0] - low for x in joined], [x[2] for x in joined]))
        made += 1
    out = [0] * len(weights)
    for part, members in enumerate(heap[0][3]):
        stack = [members]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            elif x is not None:
                out[x] = part
    return out


def assign_shards(docs: DataFrame, shards: int = 16, bundles: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash")
    )
    key = ["hash", "text_crc32", "size"]
    groups = materialize(rows.groupBy(*key).agg((F.count(F.lit(1)) * F.col("size")).alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    big = F.col("bytes") * bundles > F.lit(total)
    large = groups.where(big).select(*key, "bytes")  # fewer than `bundles` groups can exceed that share
    bucket = F.pmod("hash", F.lit(bundles)).cast("int")
    small = groups.where(~big).groupBy(bucket.alias("bucket")).agg(F.sum("bytes").alias("bytes"))
    own = sorted(tuple(r) for r in large.collect())
    loose = sorted(tuple(r) for r in small.collect())
    part = differencing([r[3] for r in own] + [r[1] for r in loose], shards)
    spark = docs.sparkSession
    own_map = spark.createDataFrame([(*r[:3], p) for r, p in zip(own, part)], "hash long, text_crc32 long, size long, own_shard int")
    map_loose = spark.createDataFrame([(r[0], p) for r, p in zip(loose, part[len(own) :])], "bucket int, loose_shard int")
    placed = (
        rows.withColumn("bucket", bucket).join(F.broadcast(own_map), key, "left").join(F.broadcast(map_loose), "bucket", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "loose_shard").alias("shard"), F.pmod(F.xxhash64("doc_id", "hash"), F.lit(1 + n_rows // 4096)).alias("cell"))
    )
    placed = materialize(placed, "shard-placed")
    # Slots: cells of a few thousand rows are numbered apart, then moved up by the cells before them.
    before = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("shard", "cell", (F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("number", number).join(before, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot")
    )
