"""Queries on tags against their SQL where keys have six and seven digits."""

import duckdb
import pytest
from compare import rows

from canopylens.plans import catalogue

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Parts and their lines with keys from 999900 on."""
    out = tmp_path_factory.mktemp("long_tags")
    for table, key in (("part", "p_partkey"), ("lineitem", "l_partkey")):
        duckdb.sql(f"copy (select * replace ({key} + 999900 as {key}) from '{DIR}/{table}.parquet') to '{out}/{table}.parquet' (format parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["op_c7_crown_label", "op_c9_normal_tag", "op_j6_registry_mnemonic", "op_j8_diameter", "op_g8_registry"])
def test_same_rows_with_long_tags(spark, folder, name):
    with duckdb.connect() as duck:
        for table in ("part", "lineitem"):
            duck.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
        want = duck.sql(SQL[name]).df()
    got = QUERIES[name](spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
