import datetime as dt

import duckdb

from brookmill.plans import registry, state


def test_the_first_line_of_the_file_breaks_a_tie(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(o, 1, 7, "R", day(d)) for o in range(40) for d in (9, 3, 20)] + [(o, 2, 7, "N", day(1)) for o in range(40)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_shipdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = state.filled_siblings(spark, str(tmp_path)).where("l_linenumber = 2").collect()
    assert [r.returned for r in found] == [day(9)] * 40


def test_odd_lines_are_filled_as_by_the_sql(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [
        (None, 1, 7, "R", day(1)), (None, 2, 7, "N", day(2)),
        (1, 1, 7, "R", None), (1, 2, 7, "R", day(3)), (1, 3, 7, "N", day(4)),
        (2, None, 7, "R", day(5)), (2, 2, 7, "R", day(6)), (2, 3, 7, "N", day(4)),
        (3, 1, None, "R", day(7)), (3, 2, 7, "R", day(8)), (3, 3, 7, None, day(4)),
        (4, 1, 3_000_000_000, "R", day(9)), (4, 2, 7, "R", day(10)), (4, 3, 7, "N", day(4)),
        (5, None, None, "R", day(13)), (5, 1, 1, "N", day(14)),
        (6, 1, -5, "R", day(15)), (6, 1, 5, "R", day(16)), (6, -1, 5, "R", day(17)), (6, 1, 5, "N", day(16)),
    ]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_shipdate timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * REPLACE (CAST(l_shipdate AS TIMESTAMP) AS l_shipdate) FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    wanted = con.execute(registry.ORACLE_SQL["filled_siblings"]).fetchall()
    found = state.filled_siblings(spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "l_partkey", "returned").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
