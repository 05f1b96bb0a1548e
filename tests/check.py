"""Command line check: python tests/check.py <sf folder> [name or prefix ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from wattloom.session import local_session  # noqa: E402


def main() -> int:
    folder, names = sys.argv[1], [a for a in sys.argv[2:] if not a.startswith("-")]
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [n for n in queries if not names or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)]
    spark, con, failed = local_session(8), connect(folder), 0
    if "--split" in sys.argv:  # every series counts as too large for one task
        spark.conf.set("wattloom.split.bytes", "0")
        spark.conf.set("wattloom.split.rows", "20")
    for name in wanted:
        t0 = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            took = time.time() - t0
            if name not in oracles:
                print(f"rows  {name:28s} {len(got):7d} rows {took:6.2f}s", flush=True)
                continue
            problems = compare(got, con.sql(oracles[name]).df())
        except Exception as exc:  # noqa: BLE001
            problems, took, got = [f"{type(exc).__name__}: {str(exc)[:600]}"], time.time() - t0, []
            if "-v" in sys.argv:
                traceback.print_exc()
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '}  {name:28s} {len(got):7d} rows {took:6.2f}s", *problems, sep="\n        " if problems else " ", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} fine")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
