"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within ``radius`` bits
agree, in at least one segment, up to that segment's share of the radius; so a
small Hamming ball is enumerated around every segment value, the values are
looked up in the table of all fingerprints by segment, and each match is
verified over all bits. Fingerprints are made distinct first, so a group of
copies is one row. Of the verified matches of one table value only a spanning
forest is emitted, never all pairs: components are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, stage
from .components import components
from .simhash import fingerprints, plain_words

#: Table rows of one segment value that one task compares with all probes; more are split.
HEAVY = 2_000
#: Heavy values that are sent to every executor; beyond, they are joined by shuffle.
BROADCAST_VALUES = 200_000


def segments_of(bits: int, radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(start, width, radius of the ball) of each segment. With radius =
    segments * q + a, a + 1 segments search q and the others q - 1: were all
    exceeded, the whole distance would be over the radius."""
    q, a = divmod(radius, segments)
    cuts = [round(i * bits / segments) for i in range(segments + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i], q if i <= a else q - 1) for i in range(segments)]


def ball(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in flips) for r in range(radius + 1) for flips in combinations(range(width), r)]


#: A probe row that is shuffled costs as much as comparing it with so many table rows.
COMPARES_PER_PROBE = 50


def best_segments(n: int, bits: int, radius: int) -> int:
    """3 segments, or 2 where ``n`` fingerprints make the compares of 3 dearer than
    the many more probes of 2 (at 64 bits and radius 4 from about 10^9 on)."""
    def cost(segments: int) -> float:
        balls = [(w, len(ball(w, r))) for _, w, r in segments_of(bits, radius, segments) if r >= 0]
        return sum(probes * (1 + n / 2 ** w / COMPARES_PER_PROBE) for w, probes in balls)
    return min((3, 2), key=cost)


def _forest(p: np.ndarray, t: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Spanning forest of the links between probes ``p`` and table rows ``t``."""
    a: list[int] = []
    b: list[int] = []
    left_p, left_t = np.ones(len(p), bool), np.ones(len(t), bool)
    for start in range(len(p)):
        if not left_p[start]:
            continue
        left_p[start] = False
        todo = [(True, start)]
        while todo:
            probe, i = todo.pop()
            x = p[i] if probe else t[i]
            rest, other = (left_t, t) if probe else (left_p, p)
            at = np.flatnonzero(rest)
            hit = at[np.bitwise_count(other[at] ^ x) <= radius]
            rest[hit] = False
            for j in hit.tolist():
                if other[j] != x:
                    a.append(int(x))
                    b.append(int(other[j]))
                todo.append((not probe, j))
    return a, b


def _link_groups(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group ``g`` (long) and table rows first."""
        def out(a, b):
            a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        open_table: np.ndarray | None = None  # table rows of the group that earlier batches began
        open_g = None
        for batch in batches:
            g, probe, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.astype(np.int64).view(np.uint64)
            if not len(g):
                continue
            starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
            ends = np.concatenate([starts[1:], [len(g)]])
            n_probe = np.add.reduceat(probe.astype(np.int64), starts)
            n_table = ends - starts - n_probe
            carry = open_table if open_g is not None and g[0] == open_g else None
            # groups of one table row and its own probe, or of probes alone, link nothing
            busy = (n_table > 0) & (n_probe > 0) & (ends - starts > 2)
            if carry is not None:
                busy[0] = True
            if n_table[-1] and n_probe[-1]:  # its own probe may come with the next batch
                busy[-1] = True
            links_a: list[int] = []
            links_b: list[int] = []
            for k in np.flatnonzero(busy).tolist():
                lo, hi = int(starts[k]), int(ends[k])
                is_p = probe[lo:hi].astype(bool)
                t = fp[lo:hi][~is_p]
                if k == 0 and carry is not None:
                    t = np.concatenate([carry, t])
                x, y = _forest(fp[lo:hi][is_p], t, radius)
                links_a += x
                links_b += y
            last = int(starts[-1])
            tail = fp[last:][~probe[last:].astype(bool)]
            open_table = np.concatenate([carry, tail]) if len(starts) == 1 and carry is not None else tail
            open_g = g[-1]
            if links_a:
                yield out(np.array(links_a, np.uint64).view(np.int64), np.array(links_b, np.uint64).view(np.int64))
    return run


def near_links(fps: DataFrame, fp: str = "fp", radius: int = 4, bits: int = 64, segments: int | None = None) -> DataFrame:
    """Links (``a``, ``b``, longs) that connect the same fingerprints as all
    pairs within ``radius`` bits would. ``fp``: long; null and repeated ones are
    left out first.

    ``segments`` sets the trade between probes per fingerprint and rows per
    table value, not the result (default: by the number of fingerprints). A
    value with more than HEAVY table rows is split: its table rows are dealt to
    blocks, and its probes go to each block."""
    ship(fps.sparkSession)
    base = cut(fps.select(F.col(fp).alias("fp")).dropna().distinct())
    parts = segments_of(bits, radius, segments or best_segments(base.count(), bits, radius))
    value = lambda s, w: F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
    own = [F.struct(F.lit(i).alias("s"), value(s, w).alias("v")) for i, (s, w, r) in enumerate(parts) if r >= 0]
    table = base.select("fp", F.explode(F.array(*own)).alias("x")).select("fp", "x.s", "x.v")
    heavy = cut(table.groupBy("s", "v").count().where(F.col("count") > HEAVY)
                .select("s", "v", F.ceil(F.col("count") / HEAVY).cast("int").alias("blocks")))
    n_heavy = heavy.count()
    def around(i: int, start: int, width: int, r: int):
        flips = F.array(*[F.lit(m).cast("long") for m in ball(width, r)])
        return F.transform(flips, lambda m: F.struct(F.lit(i).alias("s"), value(start, width).bitwiseXOR(m).alias("v")))

    masks = [around(i, s, w, r) for i, (s, w, r) in enumerate(parts) if r >= 0]
    probes = base.select("fp", F.explode(F.flatten(F.array(*masks))).alias("x")).select("fp", "x.s", "x.v")
    if n_heavy:
        few = F.broadcast(heavy) if n_heavy <= BROADCAST_VALUES else heavy
        table = table.join(few, ["s", "v"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")), F.lit(0)))
        probes = probes.join(few, ["s", "v"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    else:
        table, probes = table.withColumn("block", F.lit(0)), probes.withColumn("block", F.lit(0))
    # s takes 8 bits and a value at most 32: the group id is exact while blocks fit in what is left
    group = F.shiftleft(F.col("block").cast("long"), 40).bitwiseXOR(F.shiftleft(F.col("s").cast("long"), 34)).bitwiseXOR(F.col("v")).alias("g")
    rows = (table.select(group, F.lit(0).cast("byte").alias("probe"), "fp")
            .unionByName(probes.select(group, F.lit(1).cast("byte").alias("probe"), "fp")))
    rows = rows.repartition("g").sortWithinPartitions("g", "probe")
    return rows.mapInArrow(_link_groups(radius), "a long, b long").distinct()


def shingle_hashes(words, n: int):
    """XXH64 (seed 42) of the space-joined ``n``-word shingles, repeats
    included; fewer words: of the whole sequence; none: no hashes."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - n),
                        lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) > n, F.transform(grams, lambda g: F.xxhash64(g))) \
        .when(F.size(words) > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))) \
        .otherwise(F.array().cast("array<long>"))


def document_simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, uid_col: str | None = None) -> DataFrame:
    """``id``, ``uid`` and ``fp`` (long) of every document. Words of whole texts
    with A-Z in lower case; a bit is one if it is set in over half of the
    shingles' hashes; no word (null, empty, blank): zero. Repeated rows keep a
    row each; ``uid_col`` numbers the rows if given."""
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    words = docs.select(F.col(id_col).alias("id"), uid.alias("uid"), plain_words(F.col(text_col), True).alias("w"))
    hashed = words.select("id", "uid", shingle_hashes(F.col("w"), shingle).alias("h"))
    return fingerprints(hashed, ["uid", "id"], "h").select("id", "uid", F.col("f0").alias("fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4, segments: int | None = None, uid_col: str | None = None) -> DataFrame:
    """``id``, ``uid``, ``fp``, ``component_id`` (the smallest id reachable over
    links of at most ``radius`` differing bits, the document's own included) and
    ``keeper`` (the ``uid`` of a row that has it). Null ids are never the
    smallest; a component of null ids only has a null component_id. Empty input:
    no rows."""
    marked = cut(document_simhash(docs, id_col, text_col, shingle, uid_col))
    smallest = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    classes = marked.groupBy("fp").agg(F.min(smallest).alias("low"))
    roots = components(near_links(marked, "fp", radius, 64, segments))
    named = cut(classes.join(roots, classes["fp"] == roots["node"], "left")
                .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lows = named.groupBy("root").agg(F.min("low").alias("least"))
    final = named.join(lows, "root").select("fp", F.col("least.id").alias("component_id"), F.col("least.uid").alias("keeper"))
    return marked.join(final, "fp").select("id", "uid", "fp", "component_id", "keeper")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (of
    repeated rows, one). The rows are staged with a number each, so the two
    passes over them agree."""
    staged = stage(docs.withColumn("__tl_uid", F.monotonically_increasing_id()), "near-dedup")
    rows = near_duplicates(staged.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "__tl_uid"), "id", "text", shingle, radius, uid_col="__tl_uid")
    kept = rows.where("uid = keeper").select(F.col("uid").alias("__tl_uid"))
    return staged.join(kept, "__tl_uid", "left_semi").drop("__tl_uid")
