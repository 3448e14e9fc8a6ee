"""SimHash: weighted term hashes vote on signed bits.

The votes are counted in Spark's own aggregates: every term hash is one row,
and 32 sums per 64-bit hash count two bits each (bit k in the lower, bit
k + 32 in the upper half of a long). Partial aggregation leaves one row per
document and task before the shuffle, so neither long texts nor copies weigh
on it. Weights of a document must stay below 2^31 in total.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import combinations
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, partitions

_PAIR = (1 << 32) + 1
_LOW = (1 << 32) - 1
# fixed values: white space and letters of the word rule
SPACES = "\t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_words(text: Column, lower: bool) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; null text: no words."""
    folded = F.translate(F.coalesce(text, F.lit("")), SPACES + (UPPER if lower else ""),
                         " " * len(SPACES) + (UPPER.lower() if lower else ""))
    return F.filter(F.split(folded, " "), lambda w: w != F.lit(""))


def votes(h: Column, weight: Column, prefix: str) -> list[Column]:
    """The 32 aggregates of one 64-bit hash."""
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_PAIR)) * weight).alias(f"{prefix}{k}")
            for k in range(32)]


def majority(prefix: str, total: Column) -> Column:
    """The 64-bit word whose bits have over half of the weight."""
    def bit(k: int) -> Column:
        pair = F.coalesce(F.col(f"{prefix}{k % 32}"), F.lit(0).cast("long"))
        count = pair.bitwiseAND(F.lit(_LOW)) if k < 32 else F.shiftrightunsigned(pair, 32)
        return F.when(count * 2 > total, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in range(64)])


def hex16(word: Column) -> Column:
    return F.lower(F.lpad(F.hex(word), 16, "0"))


def fingerprints(df: DataFrame, keys: list[str], terms: str, weights: str | None = None, words: int = 1) -> DataFrame:
    """``keys`` plus ``f0`` .. ``f{words-1}``: the fingerprint of the array of
    long hashes ``terms`` (null or empty: zero). ``weights``: array of ints as
    long as ``terms``, else every hash weighs one. Further 64-bit words hash
    the first hash again. Rows with equal keys are one document."""
    if weights:
        rows = (df.select(*keys, F.explode_outer(F.arrays_zip(F.col(terms).alias("h"), F.col(weights).alias("w"))).alias("t"))
                .select(*keys, F.col("t.h").alias("h"), F.col("t.w").cast("long").alias("w")))
    else:
        rows = df.select(*keys, F.explode_outer(terms).alias("h")).withColumn("w", F.lit(1).cast("long"))
    rows = rows.withColumn("w", F.when(F.col("h").isNotNull(), F.col("w")).otherwise(F.lit(0).cast("long")))
    sums = [F.sum("w").alias("total")]
    for i in range(words):
        sums += votes(F.col("h") if i == 0 else F.xxhash64(F.lit(i), F.col("h")), F.col("w"), f"v{i}_")
    return rows.groupBy(*keys).agg(*sums).select(
        *keys, *[majority(f"v{i}_", F.col("total")).alias(f"f{i}") for i in range(words)])


def distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(p.bitwiseXOR(q)) for p, q in zip(a, b)])


def _blocks(words: list[Column], blocks: int) -> list[list[Column]]:
    """The ``blocks`` runs of neighbouring bits of the 64-bit ``words``, each as
    the parts that lie in one word; the last block takes what is left over."""
    bits = 64 * len(words)
    width, out = bits // blocks, []
    for i in range(blocks):
        start, end, parts = i * width, bits if i == blocks - 1 else (i + 1) * width, []
        while start < end:
            stop = min(end, (start // 64 + 1) * 64)
            n = stop - start
            mask = -1 if n == 64 else (1 << n) - 1
            parts.append(F.shiftrightunsigned(words[start // 64], start % 64).bitwiseAND(F.lit(mask).cast("long")))
            start = stop
        out.append(parts)
    return out


def _fronts(radius: int, blocks: int) -> list[tuple[int, ...]]:
    """The blocks that stand in front in each permuted table."""
    if not 0 <= radius < blocks:
        raise ValueError("blocks must exceed the radius")
    return list(combinations(range(blocks), blocks - radius))


def block_tables(fps: DataFrame, words: list[str], radius: int, blocks: int) -> DataFrame:
    """One row per fingerprint and permuted table: the ``blocks - radius``
    blocks that stand in front form ``key``. Two fingerprints within
    ``radius`` bits agree on all of them in at least one table."""
    fronts, parts = _fronts(radius, blocks), _blocks([F.col(w) for w in words], blocks)
    tables = [F.struct(F.lit(t).alias("table"), F.xxhash64(*[c for i in front for c in parts[i]]).alias("key"))
              for t, front in enumerate(fronts)]
    return fps.select("*", F.explode(F.array(*tables)).alias("t")).select(*fps.columns, "t.table", "t.key")


#: Rows of one table and key that a query is compared with in one place; more are split.
HEAVY = 2_000
#: Heavy keys that are sent to every executor; beyond, they are joined by shuffle.
BROADCAST_KEYS = 200_000


def near_fingerprints(fps: DataFrame, words: list[str], queries: DataFrame, radius: int = 3, blocks: int = 4,
                      carry: list[str] | None = None) -> DataFrame:
    """For the stated ``queries`` (frames of the same ``words`` columns) all
    fingerprints of ``fps`` within ``radius`` bits, by permuted block tables
    and a check of the whole distance: ``q_<word>``, ``<word>``, ``distance``.
    Both sides are reduced to distinct fingerprints first, so groups of copies
    cost one row; with ``carry`` (columns of ``fps`` to return) ``fps`` has one row a
    fingerprint already. Null words match nothing; an empty side gives no rows.

    A pair is returned from the first table in which it meets, so none needs to
    be made distinct. A key with more than HEAVY rows is split: its rows are
    dealt to parts and its queries go to each part."""
    carry = carry or []
    base = fps.select(*words, *carry).dropna(subset=words)
    right = block_tables(cut(base if carry else base.distinct()), words, radius, blocks)
    left = block_tables(queries.select(*words).dropna().distinct(), words, radius, blocks)
    left = left.select("table", "key", *[F.col(w).alias(f"q_{w}") for w in words])
    heavy = cut(right.groupBy("table", "key").count().where(F.col("count") > HEAVY)
                .select("table", "key", F.ceil(F.col("count") / HEAVY).cast("long").alias("parts")))
    n_heavy, zero, at = heavy.count(), F.lit(0).cast("long"), ["table", "key"]
    if n_heavy:
        few = F.broadcast(heavy) if n_heavy <= BROADCAST_KEYS else heavy
        deal = F.coalesce(F.pmod(F.xxhash64(*words), F.col("parts")), zero)
        right = right.join(few, at, "left").withColumn("part", deal).drop("parts")
        left = left.join(few, at, "left").withColumn("part", F.explode(F.sequence(zero, F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        at = [*at, "part"]
    same = [reduce(lambda a, b: a & b, [p == 0 for p in parts])
            for parts in _blocks([F.col(f"q_{w}").bitwiseXOR(F.col(w)) for w in words], blocks)]
    first = F.coalesce(*[F.when(reduce(lambda a, b: a & b, [same[i] for i in front]), F.lit(t))
                         for t, front in enumerate(_fronts(radius, blocks))])
    d = distance([F.col(f"q_{w}") for w in words], [F.col(w) for w in words])
    return (left.join(right, at).where((d <= radius) & (first == F.col("table")))
            .select(*[f"q_{w}" for w in words], *words, *carry, d.alias("distance")))


#: Parts over which rows with one fingerprint are dealt in a join.
DEALT = 16


def near_rows(rows: DataFrame, words: list[str], uid: str, id_col: str, asked: Column, radius: int = 3, blocks: int = 4) -> DataFrame:
    """For each row that is ``asked`` (null: not): its ``uid``, the number
    ``near_rows`` of rows whose fingerprint is within ``radius`` bits (itself
    included) and their smallest id ``near_id`` (null if all are null). Equal
    fingerprints are counted first, so copies are searched for once. Nothing
    asked or no rows: no rows."""
    asked = F.coalesce(asked, F.lit(False))
    classes = cut(rows.groupBy(*words).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("low"), F.max(asked).alias("asked")))
    found = (near_fingerprints(classes, words, classes.where("asked"), radius, blocks, ["n", "low"])
             .groupBy(*[F.col(f"q_{w}").alias(w) for w in words])
             .agg(F.sum("n").alias("near_rows"), F.min("low").alias("near_id"))
             .withColumn("deal", F.explode(F.array(*[F.lit(i).cast("long") for i in range(DEALT)]))))
    mine = rows.where(asked).select(uid, *words, F.pmod(F.xxhash64(uid), F.lit(DEALT).cast("long")).alias("deal"))
    return mine.join(found, [*words, "deal"]).select(uid, "near_rows", "near_id")


#: The smallest long.
_LEAST = -(1 << 63)


def _point(k, h) -> Column:
    return F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h"))


def _range_bucket(at: Column, cuts: list[tuple[int, int]]) -> Column:
    """Number of the descending ``cuts`` above ``at``, in two steps, so that a
    row costs about twice the root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    points = lambda xs: F.array(*[_point(*x) for x in xs])
    above = lambda xs: F.size(F.filter(xs, lambda c: at < c))
    full = above(points([g[-1] for g in groups]))  # groups that lie above as a whole
    rest = F.get(F.array(*[points(g) for g in groups]), full)
    return full * step + F.when(full < len(groups), above(rest)).otherwise(F.lit(0))


def order_hint(ids: Column, kind: T.DataType, skip: int = 0) -> Column:
    """A long that never falls where ``ids`` rise: numbers and times cut to whole
    ones, of texts and bytes seven bytes after the first ``skip``, which all
    share. Null: the smallest long."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        # seven bytes and a zero behind keep the number positive
        k = F.conv(F.rpad(F.hex(F.substring(ids.cast("binary"), skip + 1, 7)), 14, "0"), 16, 10).cast("long")
    elif isinstance(kind, (T.DateType, T.TimestampNTZType)):  # local times by day: an hour may be skipped in a zone
        k = F.unix_date(ids.cast("date")).cast("long")
    elif isinstance(kind, T.TimestampType):
        k = F.unix_micros(ids)
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        bound = F.lit(float(1 << 62))
        k = F.greatest(F.least(ids.cast("double"), bound), -bound).cast("long")
    else:
        k = ids.cast("long")
    return F.coalesce(k, F.lit(-(1 << 63)).cast("long"))


#: Bytes of text that weigh as much as a row where the ranges are cut.
BYTES_PER_COUNT = 16 << 10


def next_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Each document with the text of the next one in descending id order
    (after the last: the first): ``uid`` and ``next_uid`` (long), ``id``,
    ``text``, ``next_text``. Ids of any type that Spark orders (texts by bytes).
    Null texts are empty. Null ids come last, equal ids are ordered by text hash. An
    empty input gives no rows.

    The ids are cut into ranges at approximate quantiles of the bytes; an id
    that fills ranges by itself is cut by text hash as well (rows with one id and
    one text stay together). Each range gets a copy of the first row of the range
    after it, so one exchange and a window per range suffice."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    skip = 0
    if isinstance(kind, (T.StringType, T.BinaryType)):
        low, high = (bytes(x or b"") for x in docs.agg(F.min(F.col(id_col).cast("binary")), F.max(F.col(id_col).cast("binary"))).first())
        skip = len(commonprefix([low, high]))
    base = docs.select(order_hint(F.col(id_col), kind, skip).alias("k"),
                       F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(2, buckets or 4 * partitions(spark))
    weighed = base.select("k", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("text") / BYTES_PER_COUNT).cast("int"))))
    found = Counter(weighed.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10_000)).first()[0] or [])
    often = [k for k, m in found.items() if m > 1]
    single = [r["k"] for r in base.where(F.col("k").isin(often)).groupBy("k")
              .agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("id").alias("n"), F.count(F.lit(1)).alias("all"))
              .where("a is null or (a = b and n = all)").select("k").collect()] if often else []
    # rows run by falling id and rising text hash, so the hash is negated
    h = F.when(F.col("k").isin(single), F.bitwise_not(F.xxhash64("text"))) if single else F.lit(None)
    base = base.withColumn("h", F.coalesce(h, F.lit(0)).cast("long"))
    inner = [(k, _LEAST + j * ((1 << 64) // found[k])) for k in single for j in range(1, found[k])]
    cuts = sorted({(k, _LEAST) for k in found} | set(inner), reverse=True)
    here = F.struct("k", "h")
    own = _range_bucket(here, cuts)
    firsts = dict(base.select(own.alias("b"), here.alias("at")).groupBy("b").agg(F.max("at")).collect())
    order = sorted(firsts) or [0]
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the range that needs a copy of b's first row
    marks = F.array(*[F.struct(_point(*firsts.get(b, (None, None))).alias("first"), F.lit(before.get(b, 0)).alias("before"))
                      for b in range(order[-1] + 1)])
    rows = base.withColumn("own", own).withColumn("mark", F.get(marks, F.col("own")))
    home = F.struct(F.col("own").alias("b"), F.lit(0).alias("guard"))
    guard = F.struct(F.col("mark.before").alias("b"), F.lit(1).alias("guard"))
    rows = (rows.withColumn("g", F.explode(F.when(here == F.col("mark.first"), F.array(home, guard))
                                           .otherwise(F.array(home))))
            .select("k", "id", "text", "own", "g.b", "g.guard"))
    w = Window.partitionBy("b").orderBy("guard", F.col("k").desc(), F.col("id").desc_nulls_last(), F.xxhash64("text"))
    at = lambda b, r: F.shiftleft(b.cast("long"), 40) + r
    rows = rows.withColumn("r", F.row_number().over(w))
    rows = rows.withColumn("uid", F.when(F.col("guard") == 0, at(F.col("b"), F.col("r"))).otherwise(at(F.col("own"), F.lit(1))))
    return (rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_uid", F.lead("uid").over(w))
            .where("guard = 0").select("uid", "next_uid", "id", "text", "next_text"))


#: A word's vote weighs its length in characters up to this: longer words are rarer.
MAX_WEIGHT = 12


def pair_terms(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` plus ``h`` and ``n``: hashes and weights of the pairs of
    neighbouring lower-cased words (a single word: itself)."""
    words = rows.select(*keep, plain_words(F.col(text), True).alias("w"))
    one = words.select(*keep, F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
                       F.transform("w", lambda w: F.least(F.length(w), F.lit(MAX_WEIGHT))).alias("n"))
    def pairs(c: str, f) -> Column:
        heads, tails = F.expr(f"slice({c}, 1, greatest(size({c}) - 1, 0))"), F.expr(f"slice({c}, 2, greatest(size({c}) - 1, 0))")
        return F.when(F.size(c) < 2, F.col(c)).otherwise(F.zip_with(heads, tails, f)).alias(c)
    return one.select(*keep, pairs("h", lambda a, b: F.xxhash64(a, b)), pairs("n", lambda a, b: a + b))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", asked: Column | None = None,
                          radius: int = 3, blocks: int = 4) -> DataFrame:
    """For each document: ``id``, ``n_chars``, ``edited_sha256`` and the
    128-bit fingerprints of its text (``f0, f1``), of its edited text (``e0,
    e1``: the last third replaced by the start of the next document) and of the
    next document (``x0, x1``). With ``asked`` (a condition on ``id``) also the
    ``near_rows`` and ``near_id`` of the documents it holds for, null for others.

    Terms are pairs of neighbouring words; a pair votes once per occurrence
    with the capped length of its words. Null and empty texts have the
    fingerprint zero; equal texts have equal fingerprints; repeated rows are
    separate documents; other columns are ignored."""
    texts = (next_texts(docs, id_col, text_col)
             .withColumn("third", F.expr("cast(floor(length(text) / 3) as int)"))
             .withColumn("edited", F.concat(F.expr("left(text, length(text) - third)"), F.expr("left(next_text, third)"))))
    keys = ["uid", "next_uid", "id", "n_chars", "edited_sha256"]
    both = texts.select("uid", "next_uid", "id", F.length("text").cast("long").alias("n_chars"),
                        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        F.posexplode(F.array("text", "edited")).alias("kind", "t"))
    fps = cut(fingerprints(pair_terms(both, [*keys, "kind"], "t"), [*keys, "kind"], "h", "n", words=2))
    own = fps.where("kind = 0").drop("kind")
    edited = fps.where("kind = 1").select("uid", F.col("f0").alias("e0"), F.col("f1").alias("e1"))
    following = own.select(F.col("uid").alias("next_uid"), F.col("f0").alias("x0"), F.col("f1").alias("x1"))
    rows = own.join(edited, "uid")
    if asked is not None:
        rows = rows.join(near_rows(own, ["f0", "f1"], "uid", "id", asked, radius, blocks), "uid", "left")
    return rows.join(following, "next_uid").drop("uid", "next_uid")


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal bits."""
    return 1 - distance(a, b) / F.lit(64.0 * len(a))
