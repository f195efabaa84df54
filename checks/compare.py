"""Run registered queries against their SQL and compare all values.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

from checks.catalog import QUERIES
from checks.oracle import ORACLE
from presslens.session import local_session

TABLES = ("documents", "pages")


def canonical(row: tuple) -> tuple:
    return tuple(
        "nan" if isinstance(x, float) and math.isnan(x) else x for x in row
    )


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = Counter(canonical(tuple(r)) for r in df.select(columns).collect())
    sql = con.sql(ORACLE[name])
    if sorted(sql.columns) != columns:
        return False, f"columns {columns} != {sorted(sql.columns)}"
    order = [sql.columns.index(c) for c in columns]
    theirs = Counter(canonical(tuple(r[i] for i in order)) for r in sql.fetchall())
    if ours == theirs:
        return True, f"{sum(ours.values())} rows"
    only = list((ours - theirs).items())[:2], list((theirs - ours).items())[:2]
    return False, (
        f"{sum(ours.values())} rows against {sum(theirs.values())}, "
        f"{sum((ours - theirs).values())} differ\n  ours:   {str(only[0])[:1500]}\n  theirs: {str(only[1])[:1500]}"
    )


def main() -> int:
    import duckdb

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf_dir, table)}.parquet'")
    spark = local_session(8)
    bad = 0
    for name in names:
        if name not in ORACLE:
            print(f"-    {name}: no SQL", flush=True)
            continue
        start = time.time()
        try:
            same, text = compare(spark, con, name, sf_dir)
        except Exception as error:  # shown, then the next query
            same, text = False, str(error)[:1500]
        bad += not same
        print(f"{'ok  ' if same else 'FAIL'} {name}: {text} ({time.time() - start:.1f} s)", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
