import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from tablelens.operators import text as X
from tablelens.sources import files as IO


def test_numbers_preserved(spark):
    # FIXTURES rewrites: equal, missing, added and reformatted numbers
    # the token pattern keeps a trailing period: "1,200." differs from "1,200"
    df = spark.createDataFrame([(1, "Revenue rose 12% to 1,200.", "Up 12% to 1,200."),
                                (6, "Revenue rose 12% to 1,200.", "Up 12% to 1,200!"),
                                (2, "Revenue rose 12% to 1,200.", "Revenue rose to 1,200."),
                                (3, "Sales 5", "Sales 5 and 7"),
                                (4, "Total 1,200", "Total 1200"),
                                (5, "Total 3", "   ")], "id int, original string, rewritten string")
    got = {r["id"]: (r["accepted"], r["text"]) for r in X.numbers_preserved(df).collect()}
    assert got[1] == (True, "Up 12% to 1,200.")
    assert [got[i][0] for i in (2, 3, 4, 5, 6)] == [False] * 5 and got[5][1] == "Total 3"


def test_apply_rerank(spark):
    # FIXTURES rerank: repeated index, out-of-range index, blank title, a
    # group with no valid decision keeps its base items
    base = spark.createDataFrame([("g1", 0, "A"), ("g1", 1, "B"), ("g1", 2, "C"), ("g2", 0, "X"), ("g2", 1, "Y")],
                                 "grp string, idx int, title string")
    dec = spark.createDataFrame([("g1", 1, 2, "Third"), ("g1", 2, 2, "Again"), ("g1", 3, 0, "  "),
                                 ("g1", 4, 9, "Nope"), ("g2", 1, 7, "Bad")], "grp string, ord int, idx int, title string")
    got = sorted((r["grp"], r["ord"], r["idx"], r["title"], r["source"]) for r in X.apply_rerank(base, dec).collect())
    assert got == [("g1", 1, 2, "Third", "decision"), ("g1", 3, 0, "A", "decision"),
                   ("g2", 0, 0, "X", "original"), ("g2", 1, 1, "Y", "original")]


def test_turn_pairs(spark):
    conv = spark.createDataFrame([(1, 0, "a 1"), (1, 1, "b 1"), (1, 2, "c"), (2, 0, "x")],
                                 "conv_id long, turn long, text string")
    pairs = sorted((r["id"], r["turn"]) for r in X.turn_pairs(conv).collect())
    assert pairs == [(1, 0), (1, 1)]


def test_csv_round_trip_with_na_words(spark):
    d = tempfile.mkdtemp(prefix="tl-csv-")
    path = os.path.join(d, "in.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("id,amount,flag,name,empty\n1,2.5,true,x,\n2,NA,False,N/A,\n3,7,true,z,\n")
    df = IO.read_csv(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "amount": "double", "flag": "boolean", "name": "string",
                               "empty": "double"}
    rows = df.orderBy("id").collect()
    assert rows[1]["amount"] is None and rows[1]["name"] is None and rows[1]["flag"] is False
    out = os.path.join(d, "out")
    IO.write_csv(df, out)
    back = IO.read_csv(spark, out)
    assert back.count() == 3 and not IO.is_empty(back)
    assert IO.is_empty(df.where(F.lit(False)))


def test_csv_latin1_fallback(spark):
    d = tempfile.mkdtemp(prefix="tl-csv-")
    path = os.path.join(d, "l1.csv")
    with open(path, "wb") as f:
        f.write("name,v\nCaf\xe9,1\n".encode("latin-1"))
    r = IO.read_csv(spark, path).collect()[0]
    assert r["name"] == "Café" and r["v"] == 1


def test_command_line_on_a_csv(spark, capsys):
    import json as _json

    from tablelens.__main__ import main
    d = tempfile.mkdtemp(prefix="tl-cli-")
    path = os.path.join(d, "sales.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("order_date,region,revenue\n")
        for i in range(60):
            f.write(f"2024-{1 + i % 12:02d}-{1 + i % 27:02d},{['N', 'S', 'E'][i % 3]},${100 + i},\n"[:-2] + "\n")
    assert main([path, "--no-insights"]) == 0
    out = _json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["profile"]["roles"] == {"order_date": "date", "region": "categorical", "revenue": "numeric"}
    assert out["kpis"][1]["label"] == "Total Revenue" and out["kpis"][1]["value"] == sum(100 + i for i in range(60))
    assert len(out["charts"]) > 0


def test_csv_quotes_breaks_blanks_and_large_numbers(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tl-csv-"), "in.csv")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write('id,name,big,note\n1,"x ""q"" y",99999999999999999999, a\n2,"two\nlines",5,a\n')
    df = IO.read_csv(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "big": "decimal(38,0)", "note": "string"}
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert [(r[0], r[1], int(r[2]), r[3]) for r in rows] == [(1, 'x "q" y', 99999999999999999999, " a"),
                                                            (2, "two\nlines", 5, "a")]
    again = IO.csv_to_parquet(spark, path, os.path.join(tempfile.mkdtemp(prefix="tl-csv-"), "out"))
    assert [tuple(r) for r in again.orderBy("id").collect()] == rows


def test_padded_na_words_and_blanks_are_text(spark):
    df = IO.infer_types(spark.createDataFrame([(" NA ", "1"), ("  ", "NA"), ("q", ""), ("NA", " 2 ")], "a string, n string"))
    assert dict(df.dtypes) == {"a": "string", "n": "bigint"}
    assert [r["a"] for r in df.collect()] == [" NA ", "  ", "q", None] and [r["n"] for r in df.collect()] == [1, None, None, 2]


def test_csv_in_byte_ranges_equals_one_task_and_pandas(spark):
    """Quoted breaks, doubled and stray quotes, blank lines and short records, with
    a range's edge at every place of the text. With CRLF the cells are those of
    pandas, which keeps a quoted CRLF (Spark's whole-file reader makes it a line feed)."""
    text = ('id,"na\nme",note\n1,plain,x\n2,"two\nlines, ""q""\n\nend",y\n\n3,5" pipe,z\n'
            '4,"",""\n5,"""open\n,""\n""",u\n6,"a\nb","c\nd"\n7,"long\n1\n2\n3\n4\n5\n6\n7\n8\n9\n",k\n8,short\n9,é,"last\n"')
    d = tempfile.mkdtemp(prefix="tl-csv-")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, body in [("lf", text), ("crlf", text.replace("\n", "\r\n"))]:
        path = os.path.join(d, f"{name}.csv")
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(body)
        cells = pd.read_csv(path, dtype=str, keep_default_na=False, na_values=[""])
        want = [tuple(None if pd.isna(c) else c for c in r) for r in cells.itertuples(index=False)]
        assert len(want) == 9
        if name == "lf":
            assert [tuple(c or None for c in r) for r in IO._one_task_per_file(spark, path, "UTF-8").orderBy("id").collect()] == want
        try:
            for size in (3, 5, 17, 64, 4096):
                spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
                columns = ["id", "na\nme", "note"]
                got = IO.read_records(spark, path, columns, IO.CSV_OPTIONS).orderBy("id").collect()
                assert [tuple(c or None for c in r) for r in got] == want, (name, size)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_folder_has_a_header_per_file_and_lone_returns_still_read(spark):
    d = tempfile.mkdtemp(prefix="tl-csv-")
    for i in range(3):
        with open(os.path.join(d, f"{i}.csv"), "w", newline="") as f:
            f.write(f'a,b\n{i},"x\ny"\n{i + 10},z\n')
    for ranged in (None, True):
        assert sorted(tuple(r) for r in IO.read_csv(spark, d, ranged).collect()) == [
            (0, "x\ny"), (1, "x\ny"), (2, "x\ny"), (10, "z"), (11, "z"), (12, "z")]
    path = os.path.join(tempfile.mkdtemp(prefix="tl-csv-"), "mac.csv")
    with open(path, "w", newline="") as f:
        f.write("a,b\r1,2\r3,4\r")
    assert sorted(tuple(r) for r in IO.read_csv(spark, path, True).collect()) == [(1, 2), (3, 4)]
