"""Text-table jobs re-aimed from the reference's language-model guards
(X4, X5): they run over tables of text pairs and decisions, so the rules
apply at table scale instead of to one sentence or one chart list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import qcol

from tablelens.functions.scalar import number_tokens


def turn_pairs(conv: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
               text_col: str = "text") -> DataFrame:
    """Consecutive turns of each conversation as (id, turn, original,
    rewritten). An equi-join on (id, turn) = (id, turn - 1): rows are hashed
    on both keys, so one very long conversation still spreads over tasks."""
    a = conv.select(qcol(id_col).alias("id"), qcol(turn_col).alias("turn"), qcol(text_col).alias("original"))
    b = conv.select(qcol(id_col).alias("id"), (qcol(turn_col) - 1).alias("turn"),
                    qcol(text_col).alias("rewritten"))
    return a.join(b, ["id", "turn"])


def numbers_preserved(pairs: DataFrame, original: str = "original", rewritten: str = "rewritten") -> DataFrame:
    """Accept a rewrite only if it is not blank and its set of number
    tokens equals the original's; ``text`` is the rewrite if accepted, else
    the original."""
    o, r = qcol(original), qcol(rewritten)
    same = F.coalesce(number_tokens(o) == number_tokens(r), F.lit(False))
    ok = r.isNotNull() & (F.trim(r) != "") & same
    return pairs.select("*", F.size(number_tokens(o)).cast("long").alias("original_numbers"),
                        F.size(number_tokens(r)).cast("long").alias("rewritten_numbers"),
                        ok.alias("accepted"), F.when(ok, F.trim(r)).otherwise(o).alias("text"))


def apply_rerank(base: DataFrame, decisions: DataFrame, group: str = "grp", index: str = "idx",
                 title: str = "title", order: str = "ord") -> DataFrame:
    """Apply re-ranking decisions (group, order, index, title) to base
    items (group, index, title). A decision counts only if its index names a
    base item of its group; the first decision per index wins; a non-blank
    title replaces the base title; items without a decision are dropped; a
    group with no valid decision keeps its base items unchanged.
    Output (group, ord, index, title, source)."""
    d = decisions.select(qcol(group).alias("grp"), qcol(index).alias("idx"),
                         F.struct(qcol(order).alias("ord"), qcol(title).alias("title")).alias("d"))
    first = d.groupBy("grp", "idx").agg(F.min("d").alias("d"))  # partial agg, no window
    b = base.select(qcol(group).alias("grp"), qcol(index).alias("idx"), qcol(title).alias("base_title"))
    kept = first.join(b, ["grp", "idx"]).select(
        "grp", F.col("d.ord").alias("ord"), "idx",
        F.coalesce(F.when(F.trim(F.col("d.title")) != "", F.trim(F.col("d.title"))), F.col("base_title"))
        .alias("title"), F.lit("decision").alias("source"))
    untouched = (b.join(kept.select("grp").distinct(), "grp", "left_anti")
                 .select("grp", F.col("idx").cast("long").alias("ord"), "idx", F.col("base_title").alias("title"),
                         F.lit("original").alias("source")))
    return kept.select("grp", F.col("ord").cast("long").alias("ord"), "idx", "title", "source").unionByName(untouched)
