"""Uniform shuffle into shards of exact size.

Method: hypergeometric communication matrix. The rows sit in input blocks (the
splits of the scan). In a uniformly random permutation cut into shards of
fixed sizes, the number of rows that go from each block to each shard follows
a multivariate hypergeometric law. That matrix is drawn first, exactly; each
block is permuted locally; its first rows go to shard 0, the next to shard 1
and so on by the drawn counts; the rows are exchanged once; and each shard is
permuted again.

Everything that touches rows is DataFrame code. The driver only sees one count
per block and draws blocks x shards numbers.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage

#: Most numbers (of the matrix, of bucket starts) that are sent to every executor; more are joined by shuffle.
BROADCAST_NUMBERS = 4_000_000
#: Rows and bytes of a shard that one window group permutes, at most on average.
ROWS_PER_BUCKET = 200_000
BYTES_PER_BUCKET = 8 << 20
#: Bytes that a task of the exchange reads, about.
BYTES_PER_TASK = 64 << 20


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among ``drawn`` out of ``good + bad``, by inversion
    around the mode (12 standard deviations and 40 steps to either side; what
    lies beyond is below the resolution of a double)."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    total = good + bad
    mode = (drawn + 1) * (good + 1) // (total + 2)
    var = drawn * (good / total) * (bad / total) * ((total - drawn) / max(1, total - 1))
    reach = int(12 * math.sqrt(var)) + 40
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(steps)])
    cdf = np.cumsum(np.exp(logp - logp.max()))
    return a + int(np.searchsorted(cdf, rng.random() * cdf[-1], side="right"))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows: blocks, columns: shards; row sums ``counts``, column sums ``sizes``."""
    if sum(counts) != sum(sizes):
        raise ValueError("shard sizes must add up to the number of rows")
    rng = np.random.default_rng(seed)
    left = list(sizes)
    matrix = []
    for count in counts:
        row, need, rest = [], count, sum(left)
        for s in range(len(left) - 1):
            rest -= left[s]
            x = hypergeometric(rng, left[s], rest, need)
            row.append(x)
            need -= x
        row.append(need)
        left = [a - x for a, x in zip(left, row)]
        matrix.append(row)
    return matrix


def shard_sizes(rows: int, n_shards: int) -> list[int]:
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def shuffle_into_shards(df: DataFrame, n_shards: int = 8, seed: int = 20) -> DataFrame:
    """All rows and columns of ``df`` plus ``shard`` (int, 0 to n_shards - 1)
    and ``slot`` (long, gapless from 0 in each shard): a uniformly random
    permutation cut into shards whose row counts differ by at most one.

    Rows are moved whatever they hold: nulls, empty or very long texts and
    repeated rows are rows like any other, so no key can be hot. An empty input
    gives no rows. Input columns called ``shard`` or ``slot`` are replaced.
    The input is staged once with its block and its place there, so retries
    and re-reads see the same blocks. Window groups and tasks of the exchange are
    sized by the bytes of the texts, so long rows do not swell a task."""
    spark = df.sparkSession
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    df = df.drop("shard", "slot")
    cols = df.columns
    block, pos, key, cum, bucket, before, size = (f"__tl_{x}" for x in ("block", "pos", "key", "cum", "bucket", "before", "size"))
    texts = [F.coalesce(F.octet_length(df[f"`{f.name}`"]), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    octets = reduce(lambda a, b: a + b, texts, F.lit(8 * len(cols)).cast("long"))
    # local permutation: a random key per row, sorted inside the block
    local = (df.select(*[df[f"`{c}`"] for c in cols], octets.alias(size), F.spark_partition_id().alias(block), F.rand(seed).alias(key))
             .sortWithinPartitions(key).drop(key)
             .withColumn(pos, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    staged = stage(local, "shards")

    found = staged.groupBy(block).agg(F.count(F.lit(1)), F.sum(size)).collect()
    per_block, total = sorted((r[0], r[1]) for r in found), sum(r[2] for r in found)
    rows = sum(n for _, n in per_block)
    sizes = shard_sizes(rows, n_shards)
    matrix = communication_matrix([n for _, n in per_block], sizes, seed)
    limits = spark.createDataFrame(
        [(b, [int(x) for x in np.cumsum(row)]) for (b, _), row in zip(per_block, matrix)],
        f"{block} int, {cum} array<long>")
    if len(per_block) * n_shards <= BROADCAST_NUMBERS:
        limits = F.broadcast(limits)

    n_buckets = max(1, math.ceil(rows / n_shards / ROWS_PER_BUCKET), math.ceil(total / n_shards / BYTES_PER_BUCKET), math.ceil(2 * partitions(spark) / n_shards))
    dealt = (staged.join(limits, block)
             .withColumn("shard", F.size(F.filter(cum, lambda c: c <= F.col(pos))))
             .withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), block, pos), F.lit(n_buckets)))
             .drop(cum))
    # where each bucket starts in its shard; shards x buckets rows
    starts = (dealt.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias("n"))
              .withColumn(before, F.sum("n").over(Window.partitionBy("shard").orderBy(bucket)) - F.col("n"))
              .drop("n"))
    if n_shards * n_buckets <= BROADCAST_NUMBERS:
        starts = F.broadcast(starts)
    order = Window.partitionBy("shard", bucket).orderBy(F.xxhash64(F.lit(seed + 2), block, pos), block, pos)
    tasks = max(partitions(spark), math.ceil(total / BYTES_PER_TASK))
    placed = dealt.drop(size).repartition(tasks, "shard", bucket).withColumn("slot", F.row_number().over(order).cast("long") - 1)
    return (placed.join(starts, ["shard", bucket])
            .select(*[F.col(f"`{c}`") for c in cols], "shard", (F.col("slot") + F.col(before)).alias("slot")))
