"""Run checked queries against the oracle: ``python tests/check_all.py [sf_dir] [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry
from compare import connect, differences

from hazardflow import session


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = session.build(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            if name in oracles:
                problems = differences(df, con, oracles[name])
            else:
                print(f"{name}: rows {df.count()}")
                problems = []
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.1f}s", *problems, sep="\n    ", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
