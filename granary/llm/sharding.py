"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Equal texts share a key, and a key's hash is its place on the ring. The ring has a fixed number of cells, so that the
table of bytes per cell has the same size for any input; the driver walks that table only. A cell goes to the shard of
the first virtual node clockwise that has room for it; a full shard passes it on clockwise. Only a cell that no shard
can take whole (a group of copies larger than what is left anywhere) is split, by bytes, over the shards clockwise.
"""
from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import as_text, documents, materialize, running_sums

RING_BITS = 14
VIRTUAL_NODES = 128
#: A shard takes (1 + SLACK) of the mean at most, so that none gets less than 1 - (shards - 1) * SLACK of it.
SLACK = 0.002


def virtual_nodes(shards: int, each: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, in ring order. Those of a shard don't depend on how many shards there are."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> (64 - RING_BITS)
    return sorted((place(s, v), s) for s in range(shards) for v in range(each))


def place_cells(sizes: dict[int, int], shards: int, slack: float = SLACK, at_cell: dict[int, int] | None = None) -> list[tuple[int, int, int, int]]:
    """(cell, shard, from byte, to byte) for every cell. The input is bounded by the ring, not by the data.

    at_cell: where on the ring a text lies that is placed by itself, under a number of its own.
    """
    nodes = virtual_nodes(shards)
    cells, total = [c for c, _ in nodes], sum(sizes.values())
    cap = -(-int(total * (1 + slack)) // shards) + 1
    room = [cap] * shards
    out = []
    large = cap // 64
    for cell in sorted(sizes, key=lambda c: (-max(sizes[c], large), c)):  # hot groups first, then clockwise
        at = bisect.bisect_left(cells, (at_cell or {}).get(cell, cell))
        clockwise = list(dict.fromkeys(nodes[(at + i) % len(nodes)][1] for i in range(len(nodes))))
        whole = next((s for s in clockwise if room[s] >= sizes[cell]), None)
        if whole is not None:
            room[whole] -= sizes[cell]
            out.append((cell, whole, 0, sizes[cell]))
            continue
        done = 0
        for s in clockwise:
            if (take := min(room[s], sizes[cell] - done)) > 0:
                room[s] -= take
                out.append((cell, s, done, done + take))
                done += take
    return out


def assign_shards(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", slack: float = SLACK) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1 (a null text has none). Shards hold near equal bytes; equal texts (null counts
    as empty) share a shard unless their group is larger than any shard's room. Slots run from 0 without gaps in each
    shard. Repeated rows are rows of their own; no rows give no rows; further columns are not read.
    """
    spark = docs.sparkSession
    body = as_text(text)
    slim = materialize(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("key"),
        F.shiftrightunsigned(F.xxhash64(body), 64 - RING_BITS).cast("int").alias("cell"),
        F.monotonically_increasing_id().alias("uid"),
    ), "shard-sizes")
    rows = slim.count()
    sizes = {r["cell"]: r["size"] for r in slim.groupBy("cell").agg(F.sum("size").alias("size")).collect()}  # at most 2 ** RING_BITS rows
    plan = place_cells(sizes, shards, slack)
    split = sorted({c for c, _, a, b in plan if b - a < sizes[c]})
    if split:  # Large texts of such cells are placed by themselves, so that only they are split: 64 * shards at most.
        cells = F.broadcast(spark.createDataFrame([(c,) for c in split], "_cell int"))
        of = slim.join(cells, F.col("cell") == F.col("_cell"), "left_semi").groupBy("cell", "key").agg(F.sum("size").alias("size"))
        large = of.filter(F.col("size") > sum(sizes.values()) // (64 * shards)).orderBy("cell", "key").collect()
        own = {(r["cell"], r["key"]): (1 << RING_BITS) + i for i, r in enumerate(large)}
        for r in large:
            sizes[r["cell"]] -= r["size"]
            sizes[own[r["cell"], r["key"]]] = r["size"]
        plan = place_cells(sizes, shards, slack, {n: c for (c, _), n in own.items()})
        named = F.broadcast(spark.createDataFrame([(c, k, n) for (c, k), n in own.items()], "_cell int, _key long, _own int"))
        slim = slim.join(named, (F.col("cell") == F.col("_cell")) & (F.col("key") == F.col("_key")), "left")
        slim = materialize(slim.withColumn("cell", F.coalesce("_own", "cell")).drop("_cell", "_key", "_own"), "shard-cells")
    whole = {c: s for c, s, a, b in plan if b - a == sizes[c]}
    parts = [p for p in plan if p[0] not in whole]
    whole_df = F.broadcast(spark.createDataFrame(list(whole.items()), "cell int, shard int"))
    placed = slim.join(whole_df, "cell")
    if parts:
        cut = spark.createDataFrame(parts, "_cell int, _shard int, _lo long, _hi long")
        cells = spark.createDataFrame([(c,) for c in sorted({p[0] for p in parts})], "_cell int")
        inside = slim.join(F.broadcast(cells), F.col("cell") == F.col("_cell"), "left_semi")
        at = running_sums(inside, ["cell"], F.xxhash64("uid"), {"_at": F.col("size")}, rows, ["uid"])
        hit = (F.col("cell") == F.col("_cell")) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))
        placed = placed.select(*slim.columns, "shard").unionByName(at.join(F.broadcast(cut), hit).select(*slim.columns, F.col("_shard").alias("shard")))
    slots = running_sums(placed, ["shard"], F.xxhash64("uid"), {"slot": F.lit(1)}, rows, ["uid"])
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
