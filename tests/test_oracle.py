"""Every registered query with SQL, held against DuckDB at the smallest size."""

import glob
import math
import os

import pytest

from strophe import queries

queries.load()
SF = "/root/testdata/sf0.001"


def shown(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    own = sorted((tuple(shown(r[c]) for c in names) for r in df.collect()), key=str)
    cursor = con.execute(queries.SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    expected = sorted((tuple(shown(r[theirs.index(c)]) for c in names) for r in cursor.fetchall()), key=str)
    assert own == expected


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_every_inventory_id_is_registered():
    """The ids of the inventory, by the leading part of the queries' names."""
    ids = {n.split("_")[0] for n in queries.QUERIES}
    wanted = {f"s{i:02d}" for i in range(1, 14)} | {f"f{i:02d}" for i in range(1, 9)} | {f"q{i:02d}" for i in range(1, 14)} | {f"j{i:02d}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 10)}
    wanted |= {f"a{i:02d}" for i in range(1, 16)} | {f"w{i:02d}" for i in range(1, 10)} | {f"o{i:02d}" for i in range(1, 12)} | {"u01", "u02", "h01", "h02", "h03", "h04", "p01", "p02"}
    wanted |= {f"x{i:02d}" for i in range(1, 40) if i not in (23, 36)} | {f"r{i:02d}" for i in range(1, 10)}
    assert not wanted - ids


@pytest.mark.parametrize("name", ["w03_token_offsets", "o01_global_shuffle", "x03_pack_concatenated"])
def test_no_row_meets_in_one_partition(spark, name):
    """Only the bounded table of bucket totals is allowed a single partition."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1
    assert "CartesianProduct" not in plan
