"""Queries against their SQL on tables whose keys pass a million and more, as larger tables have them."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from shelfwise.plans import library


def both(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL on small tables, each given as columns."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    got = library.QUERIES[name](spark, str(folder))
    want = con.execute(library.ORACLES[name])
    names = [d[0] for d in want.description]
    return sorted((tuple(r) for r in got.select(*names).collect()), key=str), sorted(want.fetchall(), key=str)


LINES = {"l_orderkey": [1, 1, 1, 1, 2], "l_partkey": [3, 1_500_000, 4, 1_500_000, 5], "l_linenumber": pa.array([2, 1, 1, 3, 1], pa.int32()), "l_returnflag": ["R"] * 5}


def test_allergy_reasons(spark, tmp_path):
    got, want = both(spark, tmp_path, "agg_allergy_reasons", lineitem=LINES, part={"p_partkey": [3, 4, 5, 1_500_000], "p_name": ["gel", " wax", None, "oil"]})
    assert got == want == [(1, " wax|gel|oil"), (2, None)]


def test_first_photo(spark, tmp_path):
    lines = {"l_orderkey": [2_500_000, 7, 9, 8], "l_partkey": [1, 1, 2, 2], "l_linenumber": pa.array([1, 3, 7, None], pa.int32()), "l_returnflag": ["A"] * 4}
    got, want = both(spark, tmp_path, "agg_first_photo", lineitem=lines)
    assert got == want == [(1, 7), (2, 9)]


ORDERS = [1, 150_000, 2_162_162, 2_162_163, 3_173_686, 3_174_785, 30_000_000]


def test_ean_checksum(spark, tmp_path):
    got, want = both(spark, tmp_path, "fn_ean_checksum", orders={"o_orderkey": ORDERS})
    assert got == want and (3_173_686, True) in got


def test_barcode(spark, tmp_path):
    got, want = both(spark, tmp_path, "ext_barcode", orders={"o_orderkey": ORDERS})
    assert got == want and (3_174_785, "137467045") in got


def test_all_pages_are_read(spark, tmp_path):
    """Customers of over twenty pages, none of which is left out."""
    orders = {"o_custkey": [1] * 123 + [2] * 5 + [None] * 6, "o_orderkey": list(range(134)), "o_orderdate": [k % 9 for k in range(134)], "o_orderpriority": ["1-URGENT"] * 134}
    got, want = both(spark, tmp_path, "src_rest_paged", orders=orders)
    assert got == want and len(got) == 134 and max(r[2] for r in got) == 24
