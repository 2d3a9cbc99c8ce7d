"""Compares registered queries with their SQL: check_queries.py SF_DIR [NAME ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry_point  # noqa: E402
from conftest import make_session  # noqa: E402
from oracle import compare, connect  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = make_session()
    con = connect(sf_dir)
    sql = entry_point.oracle_sql()
    bad = 0
    for name, run in entry_point.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            if name in sql:
                n, differences = compare(run(spark, sf_dir), con, sql[name])
            else:
                n, differences = run(spark, sf_dir).count(), []
        except Exception as e:
            n, differences = -1, [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(differences)
        state = "DIFF" if differences else ("ok" if name in sql else "rows")
        print(f"{state:5}{name:26}{n:8}{time.time() - started:8.1f}s", *differences, flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
