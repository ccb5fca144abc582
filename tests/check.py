"""Developer loop: python tests/check.py [-s sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

from medloom.plans import catalog  # noqa: E402
from medloom.session import build_session  # noqa: E402


def main(args):
    sf = "/root/testdata/sf0.01"
    if args and args[0] == "-s":
        sf, args = args[1], args[2:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        t = time.time()
        try:
            got = fn(spark, sf).toPandas()
        except Exception as exc:
            print(f"ERR   {name}: {str(exc)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - t
        if name not in catalog.ORACLES:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        t = time.time()
        try:
            want = con.execute(catalog.ORACLES[name]).fetchdf()
        except Exception as exc:
            print(f"SQL   {name}: {str(exc)[:800]}", flush=True)
            bad += 1
            continue
        diff = oracle.differences(got, want)
        bad += bool(diff)
        print(f"{'DIFF ' if diff else 'ok   '} {name}: {len(got)} rows {took:.1f}s duck {time.time()-t:.1f}s {diff}", flush=True)
    print("bad", bad)


main(sys.argv[1:])
