"""Driver-style check: load __spark_entry__ by file path in a plain session
(any working directory), run entry() and every query, and compare each with
its DuckDB oracle.

    cd /tmp && python /root/repo/tools/driver_check.py [sf_dir]
"""

import importlib.util
import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from check_oracle import digest, duck  # noqa: E402


def main(sf_dir: str = "/root/testdata/sf0.01") -> int:
    spec = importlib.util.spec_from_file_location("entry_mod", os.path.join(os.path.dirname(HERE), "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    m.entry(spark).collect()
    ok = 0
    for name, run in m.queries().items():
        try:
            df = run(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            res = con.execute(m.oracle_sql()[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
            same = sorted(df.columns) == sorted(dcols) and digest(df.columns, rows)[0] == digest(dcols, drows)[0]
            ok += same
            print(name, "OK" if same else "MISMATCH", flush=True)
        except Exception as ex:  # noqa: BLE001
            print(name, "ERROR", str(ex).splitlines()[0][:200], flush=True)
    print("SUMMARY", ok, "of", len(m.queries()), flush=True)
    spark.stop()
    return 0 if ok == len(m.queries()) else 1


if __name__ == "__main__":
    raise SystemExit(main(*sys.argv[1:]))
