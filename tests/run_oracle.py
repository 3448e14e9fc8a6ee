"""CLI: compare registered queries with their DuckDB oracle.
usage: python tests/run_oracle.py [sf_dir] [--json out.json] [name ...]"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle_compare import compare, duck  # noqa: E402


def main():
    args = sys.argv[1:]
    out_json = None
    if "--json" in args:
        i = args.index("--json")
        out_json = args[i + 1]
        args = args[:i] + args[i + 2:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    record = {}
    import __spark_entry__ as E
    from tablelens.session import get_spark
    spark = get_spark()
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = 0
    for n in (names or list(qs)):
        t = time.time()
        try:
            r = compare(spark, qs[n], sql.get(n), sf, con)
        except Exception as e:  # noqa: BLE001
            r = {"ok": False, "error": repr(e)[:600]}
        dt = time.time() - t
        status = {True: "OK  ", False: "FAIL", None: "ROWS"}[r["ok"]]
        bad += r["ok"] is False
        extra = "" if r["ok"] else " " + str({k: v for k, v in r.items() if k != "ok"})[:1500]
        if r.get("type_mismatch"):
            extra += " TYPES " + str(r["type_mismatch"])
        print(f"{status} {n:28s} {dt:6.2f}s rows={r.get('rows_spark', r.get('rows'))}{extra}", flush=True)
        record[n] = {"ok": r["ok"], "seconds": round(dt, 3), "rows": r.get("rows_spark", r.get("rows")),
                     "type_mismatch": r.get("type_mismatch")}
    print(f"failures: {bad}")
    if out_json:
        import json
        with open(out_json, "w") as f:
            json.dump({"sf": sf, "failures": bad, "queries": record}, f, indent=1, default=str)


if __name__ == "__main__":
    main()
