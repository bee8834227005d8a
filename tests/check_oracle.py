"""Compare registered queries with their SQL: python tests/check_oracle.py [folder] [name...]"""
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>", "nan"):
        return None
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if hasattr(v, "item"):
        v = v.item()
    if hasattr(v, "tzinfo") and v.tzinfo:
        v = v.replace(tzinfo=None)
    return v


def rows_of(table, columns):
    data = table.select(columns).to_pydict() if columns else {}
    return sorted((tuple(_cell(v) for v in row) for row in zip(*data.values())), key=repr)


def compare(spark_df, con, sql):
    left = spark_df.toArrow()
    right = con.execute(sql).to_arrow_table()
    lc, rc = sorted(left.column_names), sorted(right.column_names)
    if lc != rc:
        return f"columns {lc} != {rc}"
    a, b = rows_of(left, lc), rows_of(right, rc)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for c in lc:
        lt, rt = str(left.schema.field(c).type), str(right.schema.field(c).type)
        lt, rt = (t.replace("large_string", "string").split("[")[0] for t in (lt, rt))
        if lt != rt:
            return f"type of {c}: {lt} != {rt} (values equal: {a == b})"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, first: {str(bad[0])[:900]}"
    return f"ok {len(a)} rows"


def main():
    from hearthlog.plans import catalog
    from hearthlog.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    catalog.load()
    names = sys.argv[2:] or list(catalog.QUERIES)
    names = [q for q in catalog.QUERIES if any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    spark = local_session(8)
    con = connect(folder)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = catalog.QUERIES[name](spark, folder)
            if name in catalog.SQL:
                out = compare(df, con, catalog.SQL[name])
            else:
                out = f"no sql, {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            out = "ERROR " + str(e)[:1200]
        bad += not (out.startswith("ok") or out.startswith("no sql"))
        print(f"{name:34s} {time.time() - t0:6.2f}s {out}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
