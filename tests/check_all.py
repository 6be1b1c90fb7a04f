"""Run queries against their DuckDB forms: ``python tests/check_all.py SF_DIR [name part ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from marketlens import session  # noqa: E402
from tests.compare import compare, duck  # noqa: E402
import __spark_entry__ as entry  # noqa: E402

sf = sys.argv[1]
parts = sys.argv[2:]
spark = session.build("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                             "spark.driver.memory": "8g"})
spark.sparkContext.setLogLevel("ERROR")
con = duck(sf)
oracles = entry.oracle_sql()
bad = 0
for name, fn in entry.queries().items():
    if parts and not any(p in name for p in parts):
        continue
    start = time.time()
    try:
        df = fn(spark, sf)
        if name in oracles:
            problem = compare(df, con, oracles[name])
            kinds = {f.name: f.dataType.simpleString() for f in df.schema}
            sql_kinds = dict(zip(con.sql(oracles[name]).columns, map(str, con.sql(oracles[name]).types)))
            note = "ok" if problem is None else "DIFF " + problem
            if os.environ.get("TYPES"):
                note += " " + str({k: (v, sql_kinds.get(k)) for k, v in kinds.items()})
        else:
            problem, note = None, f"rows {len(df.collect())}"
    except Exception as error:  # noqa: BLE001
        problem, note = "error", f"ERROR {str(error)[:1500]}"
    bad += problem is not None
    print(f"{name:34s} {time.time() - start:6.2f}s {note}", flush=True)
print("failed", bad)
