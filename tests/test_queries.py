"""Every registered query of the plans against its SQL in DuckDB."""

import os
from pathlib import Path

import duckdb
import pytest

from tidemark import plans

DATA = Path(os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].astype(object).where(frame[names].notna(), None).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.sql()))
def test_same_rows(spark, duck, name):
    ours, theirs = rows(plans.queries()[name](spark, str(DATA)).toPandas()), rows(duck.execute(plans.sql()[name]).df())
    assert ours == theirs


def test_group_counts_sum_to_rows(spark):
    out = plans.queries()["agg_sum_count_min_max"](spark, str(DATA)).toPandas()
    assert out["n"].sum() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def test_semi_and_anti_make_the_whole(spark):
    q = plans.queries()
    both = q["semi_join"](spark, str(DATA)).union(q["anti_join"](spark, str(DATA)))
    assert both.count() == spark.read.parquet(f"{DATA}/customer.parquet").count()


def test_running_max_never_falls(spark):
    out = plans.queries()["running_min_max"](spark, str(DATA)).join(spark.read.parquet(f"{DATA}/events.parquet"), "event_id").orderBy("user_id", "ts").toPandas()
    assert (out.groupby("user_id")["most"].diff().dropna() >= 0).all()


def test_custom_agg_adds_up_beyond_64_bits(spark, duck, tmp_path):
    """Products of two nations of one region, each beyond 64 bits, of which the total is within; and a total that isn't."""
    first, second = [r[0] for r in duck.execute("SELECT n_nationkey FROM nation WHERE n_regionkey = 0 ORDER BY 1 LIMIT 2").fetchall()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW nation AS SELECT * FROM read_parquet('{DATA}/nation.parquet')")
    for path in DATA.glob("*.parquet"):
        if path.stem not in ("nation", "customer", "supplier"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    con.execute(f"CREATE TABLE customer AS SELECT * REPLACE (k AS c_nationkey, 1e8 AS c_acctbal) FROM (SELECT * FROM read_parquet('{DATA}/customer.parquet') LIMIT 10), (VALUES ({first}), ({second})) u(k)")
    con.execute(f"CREATE TABLE supplier AS SELECT * REPLACE (k AS s_nationkey, v AS s_acctbal) FROM (SELECT * FROM read_parquet('{DATA}/supplier.parquet') LIMIT 1), range(10), (VALUES ({first}, 4e6), ({second}, -4e6 + 1)) u(k, v)")
    query, sql = plans.queries()["custom_agg"], plans.sql()["custom_agg"]
    for name in ("nation", "customer", "supplier"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    assert rows(query(spark, str(tmp_path)).toPandas()) == rows(con.execute(sql).df())
    con.execute(f"COPY (SELECT * FROM supplier WHERE s_acctbal > 0) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    with pytest.raises(Exception, match="OVERFLOW"):
        query(spark, str(tmp_path)).collect()
