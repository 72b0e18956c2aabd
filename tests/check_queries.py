"""Run registered queries against their SQL: python tests/check_queries.py [sf_dir] [name-part ...]"""

import sys
import time

sys.path.insert(0, "/".join(__file__.split("/")[:-2]) or ".")
sys.path.insert(0, "/".join(__file__.split("/")[:-1]) or ".")

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from loomgraph.session import build_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, plan in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            df = plan(spark, sf_dir)
            if name in oracles:
                ok, note = compare(df, con, oracles[name])
            else:
                ok, note = True, f"{len(df.collect())} rows (no SQL)"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:6.1f}s  {note}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
