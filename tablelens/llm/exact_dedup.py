"""Exact duplicates.

Method: rows are grouped by a 128-bit hash of their content (two XXH64 of the
normalised text with different seeds), the smallest id of a group stays, and
the bytes inside the groups of two or more are compared, so that texts which
only share their hash are told apart.

Only the hashes, ids and digests of all rows are shuffled. The comparison
groups the texts of repeated hashes by (hash, bytes): each task sends one copy
of a text, however many rows hold it. A group that holds a third of all rows is
one partial row a task there, and its result is broadcast to its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Runs of white space but a single space, which is its own replacement.
_RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
#: Groups of at least a 1/HOT_GROUPS of all rows are hot: there are at most so many, and they are broadcast.
HOT_GROUPS = 10_000
#: Most repeated hashes that are broadcast to leave out texts without a partner (some 100 bytes each);
#: beyond, all texts are compared.
BROADCAST_KEYS = 500_000
KEY = ["h0", "h1"]


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")


def content_hash(norm: Column, bits: int = 128) -> tuple[Column, Column]:
    """The first ``bits`` bits of a 128-bit hash, as two longs."""
    if not 0 <= bits <= 128:
        raise ValueError("the hash has 0 to 128 bits")
    halves = (F.xxhash64(norm), F.xxhash64(F.lit(1), norm))
    parts = (min(bits, 64), max(bits - 64, 0))
    return tuple(F.shiftrightunsigned(h, 64 - b) if b else F.lit(0).cast("long") for h, b in zip(halves, parts))


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Size and first row of each group; a null id comes after all others."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid")))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), first.alias("first"))


def _attach(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with their group's figures (none: the row is alone). Hot groups
    come by broadcast, so no key of the shuffled join has many rows."""
    least = max(2, math.ceil(rows.count() / HOT_GROUPS))
    hot = F.broadcast(groups.where(F.col("n") >= least))
    cold = groups.where(F.col("n") < least)
    return rows.join(hot, KEY).unionByName(rows.join(hot, KEY, "left_anti").join(cold, KEY, "left"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id`` (smallest id among the
    equal texts), ``group_size`` (long), ``kept`` (true for exactly one row a
    group) and ``text_sha256`` (of the normalised text in UTF-8).

    Texts are equal when their normalised bytes are; null counts as empty, so
    null, empty and missing texts are one group. Ids may be of any type that
    Spark orders; a null id comes after all others, and of rows with equal id
    and text one stays. Very long texts are compared whole. An empty table gives
    no rows; other columns, whatever their names, are not read. ``bits``
    shortens the hash (results stay the same, more texts are compared)."""
    content = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm"))
    h0, h1 = content_hash(F.col("norm"), bits)
    keyed = content.select("id", "norm", h0.alias("h0"), h1.alias("h1"))
    digest = F.sha2("norm", 256).alias("text_sha256")
    rows = stage(keyed.select("id", *KEY, digest, F.monotonically_increasing_id().alias("uid")), "exact-rows")
    repeated = stage(_groups(rows, KEY).where("n > 1"), "exact-groups")

    # bytes inside the groups: more than one text under a hash is a collision
    suspects = keyed
    if repeated.count() <= BROADCAST_KEYS:
        suspects = keyed.join(F.broadcast(repeated.select(*KEY)), KEY, "left_semi")
    texts = suspects.groupBy(*KEY, "norm").agg(F.lit(1).alias("one"))
    mixed = stage(texts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select(*KEY), "exact-mixed")

    if mixed.isEmpty():
        found = _attach(rows, repeated)
    else:
        clean = _attach(rows.join(mixed, KEY, "left_anti"), repeated.join(mixed, KEY, "left_anti"))
        wide = stage(keyed.join(mixed, KEY, "left_semi").select("id", "norm", *KEY, digest, F.monotonically_increasing_id().alias("uid")), "exact-wide")
        apart = wide.join(_groups(wide, ["text_sha256", "norm"]), ["text_sha256", "norm"])
        found = clean.unionByName(apart.select(clean.columns))
    one = F.col("n").isNull()
    return found.select("id", F.when(one, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
                        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                        (one | (F.col("uid") == F.col("first.uid"))).alias("kept"), "text_sha256")
