"""Merkle manifest of a dataset: every row gets its leaf digest, the roots above
it and the proof that leads there.

Method: butterfly exchange. The leaves of a run (rows with the same run key, in
order) are cut into aligned blocks of ``fanout ** levels``; a block's subtree is
hashed in one task. Then, round by round, aligned groups of ``fanout`` blocks
swap the roots of the subtrees they stand in: in round r block b meets the
blocks that differ from it in digit r alone (base ``fanout``), so a meeting has
at most ``fanout`` rows however large the run is. All of them hash the common
ancestor, each for itself, and note the others as the next part of its own
proof. After the last round every block knows its run's root and the whole
proof above it; nothing is sent down. The last subtree of a run may lack
members: those that it has stand in for them.

The roots of the runs, ordered by run, are leaves of one more tree of this kind.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, ship, stage

#: Most rows of the table of run offsets (one a run and range partition) that is broadcast; more are joined by shuffle.
BROADCAST_SPANS = 200_000
#: Copies of a run's proof that share the blocks of a hot run.
SALTS = 32


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def record_digest(values: Sequence[Column]) -> Column:
    """Leaf of a record: sha256 (lower-case hex) of its encoded values."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def fold(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and its proof lead to; for checking one row alone."""
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), leaf,
                       lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def proof_digest(left: Column, right: Column) -> Column:
    """sha256 of all digests of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def ascend(nodes: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The levels from ``nodes`` up to ``height`` or (None) to a single node."""
    levels = [nodes]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha256("".join(last[i:i + fanout]).encode()).hexdigest() for i in range(0, len(last), fanout)])
    return levels


def siblings(nodes: list[str], fanout: int) -> tuple[list[str], list[str]]:
    """Of each node, what stands left and right of it in its run of ``fanout``."""
    left, right = [], []
    for i in range(len(nodes)):
        start = i - i % fanout
        left.append("".join(nodes[start:i]))
        right.append("".join(nodes[i + 1:start + fanout]))
    return left, right


def _placed(leaves: DataFrame, order: list[str], block: int) -> DataFrame:
    """``leaves`` (with ``rk``, the run) with ``pos`` in their run, ``block`` and
    ``run_n``: a range sort, whose partitions are counted per run."""
    n = partitions(leaves.sparkSession)
    names = leaves.columns
    ordered = leaves.repartitionByRange(n, "rk", *order).sortWithinPartitions("rk", *order)
    staged = stage(ordered.select(*names, F.monotonically_increasing_id().alias("uid")), "merkle-order")
    part = F.shiftrightunsigned("uid", 33)
    spans = staged.groupBy("rk", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("lo"))
    whole = Window.partitionBy("rk")
    spans = cut(spans.select("rk", "part", (F.sum("n").over(whole.orderBy("part")) - F.col("n") - F.col("lo")).alias("shift"),
                             F.sum("n").over(whole).alias("run_n")))
    if spans.count() <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    rows = staged.withColumn("part", part).join(spans, ["rk", "part"])
    pos = F.col("uid") + F.col("shift")
    return rows.select(*names, pos.alias("pos"), F.floor(pos / block).cast("long").alias("block"), "run_n")


def _roots(placed: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One row per block: ``rk``, ``block``, ``blocks`` of its run, ``node``."""
    size = fanout ** levels

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        run_n = table["run_n"][0].as_py()
        node = ascend(table["leaf"].to_pylist(), fanout, levels if run_n > size else None)[-1][0]
        return pa.table({"rk": [table["rk"][0].as_py()], "block": [table["block"][0].as_py()], "blocks": [-(-run_n // size)], "node": [node]})

    return (placed.select("rk", "block", "pos", "leaf", "run_n").groupBy("rk", "block")
            .applyInArrow(top, "rk string, block long, blocks long, node string"))


def _butterfly(state: DataFrame, fanout: int) -> DataFrame:
    """``state`` with every block's proof above it (``left``, ``right``) and, as
    ``node``, the root of its run."""
    none = F.array().cast("array<string>")
    state = cut(state.withColumn("left", none).withColumn("right", none))
    most = state.agg(F.max("blocks")).collect()[0][0] or 0
    r, size = 0, 1
    while size < most:
        whole = F.lit(size).cast("long")
        at = F.floor(F.col("block") / whole).cast("long")              # the subtree that the block stands in
        low = F.col("block") % whole
        active = F.col("blocks") > whole
        members = F.least(whole, F.col("blocks") - at * whole)         # fewer in the last subtree
        stands_in = active & (members < whole) & (at % fanout > 0)
        slots = F.when(stands_in, F.sequence(low, whole - 1, members)).otherwise(F.array(low))
        met = (state.withColumn("at", at).withColumn("low", low).withColumn("active", active)
               .withColumn("slot", F.explode(slots)).withColumn("meeting", F.floor(F.col("at") / fanout).cast("long")))
        group = Window.partitionBy("rk", "meeting", "slot")
        met = (met.withColumn("all", F.sort_array(F.collect_list(F.struct("at", "node")).over(group)))
               .where(F.col("slot") == F.col("low")))                  # stand-ins have done their part
        joined = lambda keep: F.array_join(F.transform(F.filter("all", keep), lambda x: x["node"]), "")
        add = lambda c, keep: F.when(F.col("active"), F.concat(c, F.array(joined(keep)))).otherwise(F.col(c)).alias(c)
        state = met.select("rk", "block", "blocks",
                           F.when(F.col("active"), F.sha2(joined(lambda x: F.lit(True)), 256)).otherwise(F.col("node")).alias("node"),
                           add("left", lambda x: x["at"] < F.col("at")), add("right", lambda x: x["at"] > F.col("at")))
        r, size = r + 1, size * fanout
        if r % 4 == 0:
            state = cut(state)
    return cut(state) if r % 4 else state


def _proofs(placed: DataFrame, upper: DataFrame, keep: list[str], fanout: int, levels: int) -> DataFrame:
    """``keep`` columns and ``pos`` of ``placed`` with ``left``, ``right`` (whole
    proofs), ``subroot`` and ``root`` (as in ``upper``, one row per block)."""
    size = fanout ** levels

    def prove(table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.num_rows
        nodes = ascend(table["leaf"].to_pylist(), fanout, levels if table["run_n"][0].as_py() > size else None)
        above = above.to_pylist()[0]
        paths = [[], []]
        for h, level in enumerate(nodes[:-1]):
            for path, side in zip(paths, siblings(level, fanout)):
                path.append([side[i // fanout ** h] for i in range(n)])
        columns = {c: table[c] for c in [*keep, "pos"]}
        for c, path in zip(("left", "right"), paths):
            path += [[x] * n for x in above[c]]
            columns[c] = pa.array([list(p) for p in zip(*path)] if path else [[]] * n, pa.list_(pa.string()))
        for c in ("subroot", "root"):
            columns[c] = pa.array([above[c]] * n, pa.string())
        return pa.table(columns)

    rows = placed.select(*[c for c in placed.columns if c in {*keep, "rk", "block", "pos", "leaf", "run_n"}])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*keep).schema)
    return (rows.groupBy("rk", "block").cogroup(upper.select("rk", "block", "left", "right", "subroot", "root").groupBy("rk", "block"))
            .applyInArrow(prove, kinds + ", pos long, left array<string>, right array<string>, subroot string, root string"))


def manifest(leaves: DataFrame, run_col: str, order_col: str, leaf_col: str, fanout: int = 2, levels: int = 12) -> DataFrame:
    """All rows and columns of ``leaves`` with ``subroot`` (of the row's run),
    ``root`` (of all runs), ``pos`` (long, place in the run) and the row's proof
    from its leaf to ``root``: ``proof_left`` and ``proof_right``, arrays with
    one text a level, the digests left and right of the path put together
    (empty: none). ``fold`` gives the root back from a leaf and its proof.

    Runs are told apart and ordered by the UTF-8 bytes of ``run_col`` as text,
    null first; leaves ascend by ``order_col`` (any type that Spark orders, null
    first), ties by leaf; rows equal in all three are interchangeable. A lone
    leaf is its own subroot. Leaves must not be null. An empty table gives no
    rows; columns of the names above are replaced, others may have any name.
    A run that holds most rows is cut into blocks of ``fanout ** levels``
    leaves like any other, and an id on a third of all rows is spread by leaf and row."""
    if fanout < 2 or levels < 0:
        raise ValueError("fanout must be 2 or more, levels 0 or more")
    ship(leaves.sparkSession)
    names = [c for c in leaves.columns if c not in ("subroot", "root", "pos", "proof_left", "proof_right")]
    own = {c: f"c{i}" for i, c in enumerate(names)}
    run = F.col(f"`{run_col}`").cast("string")
    inner = leaves.select(F.coalesce(F.concat(F.lit("="), run), F.lit("")).alias("rk"), F.col(f"`{order_col}`").alias("key"),
                          F.col(f"`{leaf_col}`").alias("leaf"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
                          *[F.col(f"`{c}`").alias(x) for c, x in own.items()])
    # staged first: a range sort reads its input twice
    placed = _placed(stage(inner, "merkle-leaves"), ["key", "leaf", "tie"], fanout ** levels)
    state = _butterfly(_roots(placed, fanout, levels), fanout)

    runs = state.groupBy("rk").agg(F.min("node").alias("leaf")).select(F.lit("").alias("rk"), F.col("rk").alias("key"), "leaf")
    tops = _placed(runs, ["key"], fanout ** levels)
    above = _butterfly(_roots(tops, fanout, levels), fanout).withColumn("subroot", F.col("node")).withColumnRenamed("node", "root")
    above = _proofs(tops, above, ["key", "leaf"], fanout, levels).select(
        F.col("key").alias("rk"), F.col("left").alias("l2"), F.col("right").alias("r2"), "root", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    upper = state.withColumn("salt", (F.col("block") % SALTS).cast("int")).join(above, ["rk", "salt"]).select(
        "rk", "block", F.concat("left", "l2").alias("left"), F.concat("right", "r2").alias("right"), F.col("node").alias("subroot"), "root")

    rows = _proofs(placed, stage(upper, "merkle-upper"), list(own.values()), fanout, levels)
    return rows.select(*[F.col(x).alias(c) for c, x in own.items()], "pos", "subroot", "root",
                       F.col("left").alias("proof_left"), F.col("right").alias("proof_right"))
