"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows lie in blocks.  How many rows of each block go to each shard is drawn from
the multivariate hypergeometric distribution, so that every block is used up and
every shard gets its exact number of rows.  Within a block, rows in random order
are dealt by those counts (first permutation); within a shard they are put in
random order again (second permutation), which gives the slot.

All work on rows is DataFrame functions.  The driver sees one count per block (at
most ``MAX_BLOCKS``).  No window spans a whole shard: a shard's rows are ordered
within ranges of their random key, and a range starts where the smaller ones end.

Law: ``rows`` - shard sizes differ by one row at most.  Every row gets a number of its own, which is
written with it, and its random keys are hashes of the number and the seed: a task that runs again deals
alike, and rows equal in all columns part like any others.

Edge cases: null texts have size 1 and the checksum of no bytes; null ids are
hashed like any other value; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrand.llm.common import materialize, table, text_of

SHARDS = 16
#: Rows that one block, and one range of a shard, hold about.
BLOCK_ROWS = 1_000_000
LEAST_BLOCKS, MAX_BLOCKS = 64, 4096


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good balls among ``draws`` from an urn, by inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    ln = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(ln(good, mode) + ln(bad, draws - mode) - ln(good + bad, draws))
    u = rng.random() - p
    up, down, p_up, p_down = mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of block i that go to shard j: row sums are ``counts``, column sums ``sizes``."""
    rng = random.Random(seed)
    left, matrix = list(sizes), []
    for n in counts:
        total, row = sum(left), []
        for j, room in enumerate(left):
            take = hypergeometric(rng, room, total - room, n)
            row.append(take)
            total -= room
            n -= take
            left[j] -= take
        matrix.append(row)
    return matrix


def random_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "_row")


def uniform_shards(df: DataFrame, shards: int = SHARDS, seed: int = 20_240_601, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns of ``df`` plus shard (int) and slot (long, gapless from 0 in each shard); columns of these names are replaced."""
    names = [c for c in df.columns if c not in ("shard", "slot")]
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("given"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(given, "sharding-rows")
    n = rows.count()
    blocks = min(MAX_BLOCKS, max(LEAST_BLOCKS, math.ceil(n / block_rows)))
    rows = rows.withColumn("_block", F.pmod(random_key(seed), F.lit(blocks)).cast("int"))
    found = dict(rows.groupBy("_block").agg(F.count("*").alias("n")).collect())
    counts = [found.get(b, 0) for b in range(blocks)]
    sizes = [n // shards + (j < n % shards) for j in range(shards)]
    matrix = communication_matrix(counts, sizes, seed)
    # the ends of each shard's share of each block: blocks x shards numbers, a constant of the plan
    ends = [[sum(row[: j + 1]) for j in range(shards)] for row in matrix]
    deal = F.from_json(F.lit(str(ends)), "array<array<bigint>>")
    in_block = Window.partitionBy("_block").orderBy(random_key(seed + 1), "_row")
    rows = rows.withColumn("_rank", F.row_number().over(in_block) - 1).withColumn("_ends", deal[F.col("_block")])
    rows = rows.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int")).drop("_ends", "_rank", "_block")
    ranges = 1 << min(12, max(4, math.ceil(math.log2(max(1, n / shards / block_rows)))))
    rows = rows.withColumn("_u", random_key(seed + 2))
    rows = materialize(rows.withColumn("_range", F.shiftrightunsigned("_u", 64 - int(math.log2(ranges))).cast("int")), "sharding")
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each shard and range, at most shards x 4096
    starts = rows.groupBy("shard", "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    in_range = Window.partitionBy("shard", "_range").orderBy(F.shiftleft("_u", int(math.log2(ranges))) + F.lit(0), "_row")
    ranked = rows.withColumn("_rank", F.row_number().over(in_range) - 1)
    out = ranked.join(F.broadcast(starts), ["shard", "_range"])
    return out.select("given.*", "shard", (F.col("_start") + F.col("_rank")).cast("long").alias("slot"))


def op7_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = uniform_shards(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
