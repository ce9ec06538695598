"""Queries against their SQL: `python tests/oracle.py [folder] [names]` prints what differs."""

import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings export_source media sidecar embedded_meta suspicious_date process_record manifest_change mix_target size_limit"


def connect(folder):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in TABLES.split():
        if Path(f"{folder}/{t}.parquet").exists():
            db.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' if Path(f'{folder}/{t}.parquet').is_dir() else ''}')")
    return db


def plain(x):
    return round(x, 9) if isinstance(x, float) else x


def ordered(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def compare(spark, db, name, query, sql, folder):
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    ours = ordered(tuple(r) for r in frame.select(columns).collect())
    cursor = db.execute(sql)
    at = [d[0] for d in cursor.description]
    theirs = ordered(tuple(r[at.index(c)] for c in columns) for r in cursor.fetchall()) if sorted(at) == columns else None
    return ours, theirs, (columns, at)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as e
    from argentum.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, db, queries, oracles = local_session(), connect(folder), e.queries(), e.oracle_sql()
    names = sys.argv[2:] or list(oracles)
    wrong = 0
    for n in names:
        began = time.time()
        try:
            ours, theirs, columns = compare(spark, db, n, queries[n], oracles[n], folder)
            if ours == theirs:
                print(f"ok   {n}: {len(ours)} rows, {time.time() - began:.1f} s", flush=True)
                continue
            wrong += 1
            a, b = (set(ours), set(theirs)) if theirs is not None else (set(), set())
            print(f"DIFF {n}: {len(ours)} {None if theirs is None else len(theirs)} {columns if theirs is None else columns[0]}\n   ours only {list(a - b)[:3]}\n   theirs only {list(b - a)[:3]}", flush=True)
        except Exception as x:  # noqa: BLE001
            wrong += 1
            print(f"FAIL {n}: {type(x).__name__} {str(x)[:700]}", flush=True)
    print("no oracle:", sorted(set(queries) - set(oracles)), "| wrong:", wrong)
