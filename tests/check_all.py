"""python tests/check_all.py [sf-folder] [name ...]: compare queries with their SQL, with times."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import connect, difference  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "8g").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
names, sql = entry.queries(), entry.oracle_sql()
wanted = sys.argv[2:] or list(names)
bad = []
for name in wanted:
    start = time.time()
    try:
        df = names[name](spark, folder)
        if name in sql:
            note = difference(df, con, sql[name])
        else:
            got = df.collect()
            note = None
            print(f"   {name}: {len(got)} rows, {str(got[:2])[:300]}")
    except Exception as e:  # noqa: BLE001
        note = f"{type(e).__name__}: {str(e)[:1500]}"
        traceback.print_exc(limit=-2)
    print(f"{'ok ' if note is None else 'BAD'} {name:12s} {time.time() - start:6.2f}s {note or ''}", flush=True)
    if note is not None:
        bad.append(name)
print("bad:", bad)
