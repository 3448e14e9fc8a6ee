"""Exact linear-interpolated quantiles that never gather a column, a group or a
band of ranks into one task.

Spark's exact ``percentile`` merges a value->count map per group in a single
task, which is unbounded for a whole column or a category that holds a third of
all rows. Here every (key, rank) is searched for by counting:

1. one aggregate makes a mergeable KLL sketch per key, which knows its count,
   minimum and maximum and brackets every wanted rank between two values;
2. one counting pass cuts the values of a key at its brackets: a bracket into
   ``BUCKETS`` value ranges (its ends are ranges of their own), all between two
   brackets into one. Rows are counted per range with their smallest and largest
   value, and a running sum over a key's ranges finds the one that holds a rank;
3. a rank is settled once its range holds one value, or the rank is the first
   or last of its range. Else, as where a bracket is wide or the sketch missed
   the rank, that range is the band of another round, cut in the same way.

So the sketch only saves rounds; what it says is counted. Bands of the same key
are equal or disjoint, and a round sends at most ``BUCKETS`` rows per band and
task through the shuffle, so a value repeated a billion times is one of them.
Bands always shrink (their ends leave them), by a factor of ``BUCKETS`` in value
per round: on ordinary columns the first counting pass settles every rank.

Interpolation follows the usual linear rule (numpy "linear", pandas
``quantile``, SQL ``quantile_cont``): ``pos = (n-1)·p``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import local_frame, qcol

ACCURACY = 10000
BUCKETS = 1 << 14
#: Size of a sketch (some 20 KB a key and task) and half the width of a bracket, in ranks per value:
#: three times the sketch's rank error, so that it seldom misses.
SKETCH_SIZE = 1024
RANK_ERROR = 0.0085


def sketch(v: Column) -> Column:
    """Aggregate: mergeable sketch of the values of ``v`` (no NaN)."""
    return F.kll_sketch_agg_double(v, F.lit(SKETCH_SIZE))


def brackets(sketched: Column, probs: Sequence[float]) -> Column:
    """From a sketch: (n, at), ``at`` the minimum, the maximum and the values
    below and above each quantile, [min, max, low, high, low, high, ...] (null
    where there are no values)."""
    n = F.coalesce(F.kll_sketch_get_n_double(sketched), F.lit(0))
    sides = [0.0, 1.0, *[x for p in probs for x in (max(0.0, p - RANK_ERROR), min(1.0, p + RANK_ERROR))]]
    at = F.when(n > 0, F.kll_sketch_get_quantile_double(sketched, F.array(*[F.lit(x) for x in sides])))
    return F.struct(n.alias("n"), at.alias("at"))


def bounds_of(row) -> tuple:
    """(n, min, max, brackets) from a row of ``brackets``."""
    n, at = row
    return (int(n), at[0], at[1], at[2:]) if n else (0, None, None, [])


def exact_quantiles(long_df: DataFrame, key: str, value: str, probs: Sequence[float], accuracy: int = ACCURACY,
                    bounds: dict | None = None, exact: bool = True, buckets: int = BUCKETS) -> dict:
    """Quantiles of ``value`` per ``key`` (keys: a bounded set such as column
    names or top-k categories; the driver holds a few numbers per key).
    Returns ``{key: {"n": n, p: q, ...}}``; nulls and NaN are ignored, keys with
    no values are absent. ``bounds``: ``{key: (n, min, max, brackets)}`` where the
    caller has them already. ``exact=False``: one pass of GK sketches (rank error
    at most n/accuracy, values not interpolated)."""
    probs = [float(p) for p in probs]
    data = long_df.select(qcol(key).alias("k"), qcol(value).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v"))
    if not exact:
        rows = data.groupBy("k").agg(F.count("v").alias("n"), F.percentile_approx("v", probs, accuracy).alias("a"))
        return {r["k"]: {"n": int(r["n"]), **dict(zip(probs, r["a"]))} for r in rows.collect()}
    if bounds is None:
        rows = data.groupBy("k").agg(sketch(F.col("v")).alias("s")).select("k", brackets(F.col("s"), probs).alias("b"))
        bounds = {r["k"]: bounds_of(r["b"]) for r in rows.collect()}
    bounds = {k: b for k, b in bounds.items() if b[0] > 0}
    ranks = {(k, r) for k, (n, *_) in bounds.items() for p in probs for r in _neighbours(n, p)}
    at = _values_at(data, long_df.schema[key].dataType, bounds, ranks, buckets)
    out: dict = {}
    for k, (n, *_) in bounds.items():
        out[k] = {"n": n}
        for p in probs:
            lo, hi = (at[(k, r)] for r in _neighbours(n, p))
            frac = (n - 1) * p - math.floor((n - 1) * p)
            out[k][p] = lo if frac == 0.0 or lo == hi else lo + (hi - lo) * frac
    return out


def _neighbours(n: int, p: float) -> tuple[int, int]:
    pos = (n - 1) * p
    return math.floor(pos), math.ceil(pos)


def _bands(lo: float, hi: float, sides: Sequence[float]) -> list[tuple[float, float, bool]]:
    """(low, high, to be cut) that cover [lo, hi] in ascending order without
    overlap: the brackets, joined where they overlap, and all between them."""
    out, pairs = [], sorted(zip(sides[::2], sides[1::2]))
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), True)
        else:
            start = math.nextafter(out[-1][1], math.inf) if out else lo
            if start < a:
                out.append((start, math.nextafter(a, -math.inf), False))
            out.append((a, b, True))
    if out[-1][1] < hi:
        out.append((math.nextafter(out[-1][1], math.inf), hi, False))
    return out


def _values_at(data: DataFrame, key_type: T.DataType, bounds: dict, ranks: set, buckets: int) -> dict:
    """{(key, rank): value} for 0-based ranks within each key."""
    spark = data.sparkSession
    found: dict = {}
    open_ranks = {}   # (key, rank) -> (lo, hi, values of the key below lo, values in the band)
    for k, r in ranks:
        n, lo, hi, _ = bounds[k]
        _settle(found, open_ranks, (k, r), (lo, hi, 0, n))
    band_schema = T.StructType([T.StructField("k", key_type), T.StructField("group", T.IntegerType()), T.StructField("band", T.IntegerType()),
                                T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
                                T.StructField("width", T.DoubleType())])
    wanted_schema = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("inner", T.LongType())])
    bracketed = True
    while open_ranks:
        # groups: bands whose rows count on from one to the next; (key, values below the first band)
        groups: dict = {}
        for (k, _), (lo, hi, below, _) in open_ranks.items():
            groups.setdefault((k, 0) if bracketed else (k, below), [(lo, hi, True)])
        if bracketed:
            # with few values the brackets are narrower than the step between two ranks
            groups = {(k, 0): _bands(lo, hi, at if n * RANK_ERROR >= 2 else [lo, hi]) for k, _ in groups for n, lo, hi, at in [bounds[k]]}
        number = {g: i for i, g in enumerate(groups)}
        bands = [(k, number[k, below], lo, hi, cut) for (k, below), parts in groups.items() for lo, hi, cut in parts]
        # Halves keep the width of a band finite for any pair of doubles; a band
        # that reaches infinity, or is too narrow to halve, has one inner range.
        width = [hi / 2 - lo / 2 if cut else None for _, _, lo, hi, cut in bands]
        band_df = local_frame(spark, [(k, g, i, lo, hi, w if w and 0 < w < math.inf else None)
                                      for i, ((k, g, lo, hi, _), w) in enumerate(zip(bands, width))], band_schema)
        wanted = []
        for (k, r), (_, _, below, _) in open_ranks.items():
            start = 0 if bracketed else below
            wanted.append((number[k, start], r, r - start))
        wanted_df = local_frame(spark, wanted, wanted_schema)
        v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
        inner = F.floor((v / 2 - lo / 2) / F.col("width") * (buckets - 2))
        bucket = (F.when(v <= lo, 0).when(v >= hi, buckets)
                  .otherwise(1 + F.coalesce(F.least(inner, F.lit(buckets - 2)), F.lit(0))).cast("int"))
        counted = (data.join(F.broadcast(band_df), (data["k"] == band_df["k"]) & v.between(lo, hi))
                   .groupBy("group", "band", bucket.alias("bucket"))
                   .agg(F.count("v").alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx")))
        running = F.sum("c").over(Window.partitionBy("group").orderBy("band", "bucket"))
        hits = (counted.withColumn("start", running - F.col("c")).join(F.broadcast(wanted_df), "group")
                .where((F.col("inner") >= F.col("start")) & (F.col("inner") < F.col("start") + F.col("c")))
                .select("group", "rank", "start", "c", "mn", "mx").collect())
        keys = list(groups)
        open_ranks, bracketed = {}, False
        for h in hits:
            k, below = keys[h["group"]]
            _settle(found, open_ranks, (k, h["rank"]), (h["mn"], h["mx"], below + h["start"], h["c"]))
    return found


def _settle(found: dict, open_ranks: dict, target: tuple, band: tuple) -> None:
    """Note the value of a rank whose band decides it, or keep it open."""
    lo, hi, below, n = band
    if lo == hi or target[1] == below:
        found[target] = float(lo)
    elif target[1] == below + n - 1:
        found[target] = float(hi)
    else:
        open_ranks[target] = band


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], bounds: dict | None = None,
                     **kw) -> dict:
    """Exact quantiles of several numeric columns of ``df`` (one shared scan
    per round: the columns are unpivoted to ``(column, value)``)."""
    from tablelens.functions.columns import as_double
    if not cols:
        return {}
    wide = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    long_df = wide.unpivot([], [f"c{i}" for i in range(len(cols))], "key", "val")
    if bounds is not None:
        bounds = {f"c{i}": bounds[c] for i, c in enumerate(cols)}
    res = exact_quantiles(long_df, "key", "val", probs, bounds=bounds, **kw)
    return {cols[int(k[1:])]: v for k, v in res.items()}
