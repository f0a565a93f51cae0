"""Scans, filters, joins, aggregation, windows, sorting, set operations, subqueries and CTEs.

Most are one declarative statement that Spark and DuckDB read alike; `both` gives Spark the tables as DataFrames, so no
view is registered. Frames are written out, and null order is too.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table
from .registry import query


def both(name: str, statement: str) -> None:
    """Register one statement, with {tables} in braces, for Spark and DuckDB."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", statement)))

    @query(name, re.sub(r"\{(\w+)\}", r"\1", statement))
    def run(spark, sf_dir) -> DataFrame:
        return spark.sql(statement, **{t: table(spark, sf_dir, t) for t in tables})


@query("flagship_revenue_by_nation", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY n_name HAVING count(*) > 10 ORDER BY revenue DESC, n_name LIMIT 10""")
def flagship(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp'1996-01-01'")
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    totals = joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n_lines"))
    return totals.where("n_lines > 10").orderBy(F.desc("revenue"), "n_name").limit(10)


# scans, projection, predicates
both("scan_project", "SELECT c_custkey, c_name, c_mktsegment AS segment, 1 AS one FROM {customer}")
both("filter_and_or_not", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR NOT (o_orderpriority <> '1-URGENT')")
both("filter_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 12")
both("filter_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE 's%g' OR p_name LIKE '_ed %'")
both("filter_in", "SELECT p_partkey, p_size FROM {part} WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#1', 'Brand#2')")
both("filter_null", "SELECT o_orderkey, n_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey LEFT JOIN {nation} ON c_nationkey = n_nationkey AND n_nationkey < 5 WHERE n_name IS NULL")
both("arithmetic", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, -l_quantity AS neg, l_orderkey % 7 AS rest FROM {lineitem}")
both("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS tier FROM {orders}")
both("no_from", "SELECT 1 + 2 AS three, upper('abc') AS up")

# joins
both("join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
both("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000")
both("join_right", "SELECT c_custkey, o_orderkey FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey AND o_orderstatus = 'P'")
both("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM {supplier} WHERE s_acctbal > 0) s FULL OUTER JOIN (SELECT * FROM {customer} WHERE c_acctbal > 5000) c ON s_suppkey = c_custkey")
both("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
both("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
both("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
both("join_compound", "SELECT a.l_orderkey, a.l_linenumber, b.l_suppkey FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity > 40")
both("join_theta", "SELECT a.n_name AS low, b.n_name AS high FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
both("join_or", "SELECT a.n_nationkey, r_regionkey FROM {nation} a JOIN {region} ON a.n_regionkey = r_regionkey OR a.n_nationkey = r_regionkey")
both("join_using", "SELECT o_orderkey, n FROM {orders} JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) x USING (o_orderkey)")
both("join_natural", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM {nation}) NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM {region})")
both("join_self", "SELECT a.s_suppkey AS s, b.s_suppkey AS t FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
both("join_chain", "SELECT r_name, count(*) AS n FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name")

# aggregation
both("agg_global", "SELECT count(*) AS n, count(l_tax) AS n_tax, CAST(sum(l_linenumber) AS BIGINT) AS total, round(avg(l_quantity), 6) AS mean, min(l_shipdate) AS first, max(l_shipdate) AS last FROM {lineitem}")
both("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 6) AS mean FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
both("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderstatus")
both("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) >= 3 AND (avg(o_totalprice) > 100000 OR NOT (min(o_totalprice) < 50000))")
both("agg_min_max_text", "SELECT c_nationkey, min(c_name) AS first, max(c_mktsegment) AS last FROM {customer} GROUP BY c_nationkey")
both("group_without_aggregate", "SELECT p_brand, p_type FROM {part} GROUP BY p_brand, p_type")
both("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("agg_cube", "SELECT p_brand, p_type, count(*) AS n FROM {part} GROUP BY CUBE (p_brand, p_type)")
both("agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 10) AS big, count(*) AS n FROM {events} GROUP BY event_type")

both("agg_grouping_sets", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {customer} GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())")
both("agg_spread", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_discount), 8) AS v, round(corr(l_quantity, l_extendedprice), 6) AS c FROM {lineitem} GROUP BY l_returnflag")
both("agg_sum_distinct", "SELECT o_orderpriority, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, count(DISTINCT o_orderstatus) AS k FROM {orders} GROUP BY o_orderpriority")

# windows: the whole partition, unless the frame says otherwise
_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
both("window_rank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment NULLS FIRST) AS rk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment NULLS FIRST) AS dr FROM {customer}")
both("window_lag_lead", "SELECT o_orderkey, lag(o_totalprice, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_totalprice, 2, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM {orders}")
both("window_ntile", "SELECT s_suppkey, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS q FROM {supplier}")
both("window_values", f"SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM {{orders}} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey {_ALL})")
both("window_aggregates", f"SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, round(avg(o_totalprice) OVER w, 4) AS mean, count(*) OVER w AS n, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi FROM {{orders}} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey {_ALL})")
both("window_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running, percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pr FROM {orders}")

both("window_cume_dist", "SELECT c_custkey, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment NULLS FIRST), 9) AS cd, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment NULLS FIRST), 9) AS pr FROM {customer}")
both("window_moving", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS mean FROM {orders}")
both("window_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM {orders}")

# sorting, limits, sets
both("sort_limit", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
both("sort_offset", "SELECT c_custkey, c_nationkey FROM {customer} ORDER BY c_nationkey NULLS FIRST, c_custkey DESC LIMIT 20 OFFSET 15")
both("distinct", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM {orders}")
both("set_union", "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey AS k FROM {region}")
both("set_union_all", "SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT r_regionkey AS k FROM {region}")
both("set_intersect", "SELECT s_nationkey AS k FROM {supplier} INTERSECT SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal < 0")
both("set_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey AS k FROM {supplier} WHERE s_acctbal > 8000")

# subqueries and CTEs
both("derived_table", "SELECT segment, n FROM (SELECT c_mktsegment AS segment, count(*) AS n FROM {customer} GROUP BY c_mktsegment) x WHERE n > 10")
both("scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})")
both("correlated_scalar", "SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS n FROM {customer}")
both("in_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)")
# keys that can't be null make NOT IN a plain anti join; over nullable ones, one side would have to be broadcast
both("not_in_subquery", "SELECT p_partkey FROM {part} WHERE coalesce(p_partkey, -1) NOT IN (SELECT coalesce(l_partkey, -2) FROM {lineitem} WHERE l_quantity > 45)")
both("with_chain", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey), b AS (SELECT avg(total) AS mean FROM a) SELECT o_custkey, round(total, 2) AS total FROM a, b WHERE total > 2 * mean")
both("with_recursive", "WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 50) SELECT n, total FROM t")
