"""Run registered queries against their SQL in DuckDB: python tools/check_queries.py [sf] [name-prefix ...]"""

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from cohortlens.session import local_session  # noqa: E402
from cohortlens.catalog import load_all  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = float(v)
        if math.isnan(v):
            return None
        if v == int(v) and abs(v) < 1e15:
            return int(v)
        r = float(f"{v:.9g}")
        return int(r) if r == int(r) else round(r, 9)
    return v if isinstance(v, (int, str)) else str(v)


def close(a, b):
    if a == b:
        return True
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= 1e-7 * max(1.0, abs(a), abs(b))
    return False


def same(x, y):
    return len(x) == len(y) and all(all(close(a, b) for a, b in zip(r, s)) for r, s in zip(x, y))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    want = sys.argv[2:]
    spark = local_session()
    data = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    queries, oracle = load_all()
    bad = 0
    for name, fn in queries.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        try:
            t0 = time.time()
            df = fn(spark, data)
            cols = sorted(df.columns)
            got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
            t1 = time.time() - t0
            if name not in oracle:
                print(f"rows  {name:40s} {len(got):8d} rows {t1:6.2f}s  {df.dtypes if not got else ''}", flush=True)
                continue
            cur = con.execute(oracle[name])
            names = [d[0] for d in cur.description]
            kinds = {d[0]: str(d[1]) for d in cur.description}
            raw = cur.fetchall()
            odd = {c: k for c, k in kinds.items() if "HUGE" in k or "DECIMAL" in k or "BOOL" in k or "DATE" in k}
            if sorted(names) != cols:
                bad += 1
                print(f"COLS  {name}: {cols} vs {sorted(names)}")
                continue
            pos = [names.index(c) for c in cols]
            exp = [tuple(norm(r[i]) for i in pos) for r in raw]
            key = lambda r: tuple((v is not None, isinstance(v, str), (round(v, 5) if isinstance(v, float) else v) if v is not None else 0) for v in r)
            got.sort(key=key)
            exp.sort(key=key)
            ok = same(got, exp)
            bad += not ok
            print(f"{'ok   ' if ok else 'DIFF '} {name:40s} {len(got):8d} rows {t1:6.2f}s {odd or ''}", flush=True)
            if not ok:
                print("   cols", cols, len(got), len(exp))
                shown = 0
                for g, e in zip(got, exp):
                    if not all(close(a, b) for a, b in zip(g, e)):
                        print("   spark", g, "\n   duck ", e)
                        shown += 1
                        if shown == 3:
                            break
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
