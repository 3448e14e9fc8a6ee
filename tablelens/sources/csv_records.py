"""Records of a quoted CSV file from its lines, in many tasks.

Spark cuts a text file into byte ranges and reads their lines side by side. A
line is a step between two states, outside (0) and inside (1) of quotes; which
one a range begins in depends on all ranges before it. So each range is summed
up as a function of its first state (one row per range), the functions are
chained in the order of the file, and a line's own state follows from its
range's. Lines that begin and end outside are records as they stand; only
the lines of records with quoted line breaks are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RANGE = ["file", "start"]


def read_lines(spark: SparkSession, path: str, latin: bool = False) -> DataFrame:
    """(file, start, at, line): the file, where its byte range begins, an ascending
    number inside the range, and the line with its ``\\r``, if any."""
    line = F.decode(F.col("value").cast("binary"), "ISO-8859-1") if latin else F.col("value")
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.monotonically_increasing_id().alias("at"), line.alias("line")))


def _end_state(line: Column, inside: int) -> Column:
    """State after ``line``. A quote opens only at a cell's start and closes only
    inside; a doubled one does neither. Other quotes are text."""
    pieces = F.split(F.replace(line, F.lit('""'), F.lit("")), '"')
    begin = F.struct(F.lit(inside).alias("s"), F.element_at(pieces, 1).alias("before"), F.lit(True).alias("first"))

    def step(acc: Column, piece: Column) -> Column:
        at_cell = F.endswith(acc["before"], F.lit(",")) | (acc["first"] & (acc["before"] == ""))
        s = F.when(acc["s"] == 1, 0).when(at_cell, 1).otherwise(0)
        return F.struct(s.alias("s"), piece.alias("before"), F.lit(False).alias("first"))

    end = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), begin, step)["s"]
    return F.when(F.contains(line, F.lit('"')), end).otherwise(F.lit(inside))


def _chained(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``rows`` with states ``e0, e1`` (after the row, if it begins in 0 or 1) plus
    ``p0, p1``: the state before the row if its group begins in 0 or 1. A row
    either keeps, swaps or sets the state: what counts is the last one that
    sets it and the swaps since."""
    to_here = Window.partitionBy(*by).orderBy(order)
    before = to_here.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("swaps", F.sum(((F.col("e0") == 1) & (F.col("e1") == 0)).cast("long")).over(to_here))
    setter = F.when(F.col("e0") == F.col("e1"), F.struct(F.col("e0").alias("s"), "swaps"))
    rows = (rows.withColumn("set", F.last(setter, ignorenulls=True).over(before))
            .withColumn("sofar", F.coalesce(F.lag("swaps").over(to_here), F.lit(0))))

    def state(first: int) -> Column:
        s = F.when(F.col("set").isNull(), F.lit(first) + F.col("sofar")).otherwise(F.col("set.s") + F.col("sofar") - F.col("set.swaps"))
        return (s % 2).cast("int")
    return rows.withColumn("p0", state(0)).withColumn("p1", state(1)).drop("swaps", "set", "sofar")


def _after(first: str) -> Column:
    return F.when(F.col(first) == 1, F.col("e1")).otherwise(F.col("e0"))


def range_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside, opened): the state each byte range begins in and the
    line that opened the record it continues. Only lines with an odd state
    (they open, close or swap) are shuffled, without their text."""
    marks = (lines.select(*_RANGE, "at", _end_state(F.col("line"), 0).alias("e0"), _end_state(F.col("line"), 1).alias("e1"))
             .where("e0 <> 0 or e1 <> 1"))
    at = F.col("at")
    opens = lambda p: F.max(F.when((F.col(p) == 0) & (F.col("e0") == 1), at))
    ends = (_chained(marks, _RANGE, "at").groupBy(*_RANGE)
            .agg(F.max_by(_after("p0"), at).alias("e0"), F.max_by(_after("p1"), at).alias("e1"),
                 opens("p0").alias("o0"), opens("p1").alias("o1")))
    every = lines.groupBy(*_RANGE).agg(F.min("at").alias("lowest"))
    ranges = (every.join(ends, _RANGE, "left")
              .select(*_RANGE, F.coalesce("e0", F.lit(0)).alias("e0"), F.coalesce("e1", F.lit(1)).alias("e1"), "o0", "o1"))
    opened = F.when(F.col("p0") == 1, F.col("o1")).otherwise(F.col("o0"))  # a file begins outside
    mark = F.when(opened.isNotNull(), F.struct(F.col("start").alias("start"), opened.alias("at")))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return (_chained(ranges, ["file"], "start")
            .select(*_RANGE, F.col("p0").alias("inside"), F.last(mark, ignorenulls=True).over(before).alias("opened")))


def records(lines: DataFrame) -> DataFrame:
    """(file, start, at, record): the text of each record and the place of its first
    line; blank lines outside of quotes are left out."""
    own = lines.withColumn("e0", _end_state(F.col("line"), 0)).withColumn("e1", _end_state(F.col("line"), 1))
    own = _chained(own, _RANGE, "at").join(range_states(lines), _RANGE)
    own = own.withColumn("before", F.when(F.col("inside") == 1, F.col("p1")).otherwise(F.col("p0")))
    own = own.withColumn("after", _after("before"))
    opens = F.when((F.col("before") == 0) & (F.col("after") == 1), F.struct(F.col("start").alias("start"), F.col("at").alias("at")))
    to_here = Window.partitionBy(*_RANGE).orderBy("at")
    own = own.withColumn("of", F.coalesce(F.last(opens, ignorenulls=True).over(to_here), "opened"))
    single = (F.col("before") == 0) & (F.col("after") == 0)
    whole = own.where(single & (F.trim(F.rtrim(F.col("line"), F.lit("\r"))) != "")).select(*_RANGE, "at", F.col("line").alias("record"))
    pieces = F.sort_array(F.collect_list(F.struct("start", "at", "line")))
    broken = (own.where(~single).groupBy("file", "of").agg(pieces.alias("lines"))
              .select("file", "of.start", "of.at", F.array_join(F.col("lines.line"), "\n").alias("record")))
    return whole.unionByName(broken).withColumn("record", F.regexp_replace("record", r"\r$", ""))


def read_records(spark: SparkSession, path: str, columns: list[str], options: dict, latin: bool = False) -> DataFrame:
    """The cells of all records but each file's first (its header) as text
    ``columns``, parsed by Spark's CSV parser with ``options``."""
    rows = records(read_lines(spark, path, latin))
    head = rows.groupBy("file").agg(F.min(F.struct("start", "at")).alias("head"))
    rows = rows.join(head, "file").where(F.struct("start", "at") != F.col("head"))
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    cells = rows.select(F.from_csv("record", schema, options).alias("r"))
    return cells.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])
