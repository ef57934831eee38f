"""Queries against their SQL twins on values that only larger tables have."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from melisma.functions import strings
from melisma.plans import registry


def against_sql(spark, folder, name, table, columns):
    pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    want = db.execute(registry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in registry.queries()[name](spark, str(folder)).collect()]
    assert sorted(got) == sorted(want)
    return dict(want)


def test_halves_of_years(spark, tmp_path):
    balances = [0.5, 1.5, -0.5, 0.51, 2028.5, 2029.49, 2029.5, None]
    keys = list(range(len(balances)))
    want = against_sql(spark, tmp_path, "dq03_years", "customer", {"c_custkey": pa.array(keys, pa.int64()), "c_acctbal": pa.array(balances, pa.float64())})
    assert want[0] == "bad"


def test_sizes_beyond_gigabytes(spark, tmp_path):
    keys = [0, 1, 7, 8, 250, 254317, 254318, 900_000, 9_000_000, 36_000_000, 700_000_000]
    want = against_sql(spark, tmp_path, "str11_sizes", "orders", {"o_orderkey": pa.array(keys, pa.int64())})
    assert want[254318] == "1024.01 GB"


def test_ties_of_sizes_go_to_even(spark):
    sizes = {1152: "1.12 KB", 1408: "1.38 KB", (1 << 20) - 1: "1024.00 KB", 5 << 38: "1.25 TB", 0: "0 B", None: None, (1 << 63) - 1: "8388608.00 TB"}
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", strings.byte_size(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == sizes
