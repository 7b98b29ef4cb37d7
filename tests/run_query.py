"""python tests/run_query.py SF_DIR [NAME...]: runs queries and compares those that have SQL."""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

import __spark_entry__ as e  # noqa: E402
from oracle import compare  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

if __name__ == "__main__":
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sql = e.oracle_sql()
    for name, q in e.queries().items():
        if len(sys.argv) > 2 and not any(name == a or name.startswith(a + "_") for a in sys.argv[2:]):
            continue
        t = time.time()
        try:
            df = q(spark, sys.argv[1])
            said = compare(df, sql[name], sys.argv[1]) or "same" if name in sql else f"{len(df.collect())} rows"
        except Exception:
            said = traceback.format_exc()[-1500:]
        print(f"{name} {time.time() - t:.1f}s {said}", flush=True)
