"""Checks of the analytical plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.operators.tables import page
from tablewise.plans import Filter, Plan, as_points, run
from tablewise.quantiles import quantiles

from .inputs import CUSTOMER, LOOSE, ORDERS, PART, STRICT, customer, orders, part
from .registry import query, table


@query(
    "group_sum_filtered",
    """select l_returnflag, round(sum(l_extendedprice), 2) as sum_l_extendedprice from lineitem
       where l_quantity > 24 group by 1 order by 2 desc, 1""",
)
def group_sum_filtered(spark, sf):
    plan = Plan("group_by", ["l_extendedprice"], "l_returnflag", "sum", [Filter("l_quantity", ">", 24)])
    out = run(table(spark, sf, "lineitem"), plan).table
    return out.withColumn("sum_l_extendedprice", F.round("sum_l_extendedprice", 2))


@query(
    "group_count",
    f"""select c_mktsegment, count(*) as count from {CUSTOMER} where c_mktsegment is not null
        group by 1 order by 2 desc, 1""",
)
def group_count(spark, sf):
    return run(customer(spark, sf), Plan("group_by", ["C_MKTSEGMENT"])).table


def _grouped(agg: str, sql: str):
    @query(
        f"group_{agg}",
        f"""select p_brand, round(v, 4) as {agg}_p_code from (
              select p_brand, {sql} as v from (select p_brand, {STRICT.format('p_code')} as x from {PART})
              group by 1) order by v desc nulls last, p_brand""",
    )
    def run_it(spark, sf):
        plan = Plan("group_by", ["p_code"], "p_brand", agg)
        out = run(part(spark, sf), plan).table
        return out.withColumn(f"{agg}_p_code", F.round(f"{agg}_p_code", 4))

    return run_it


for _agg, _sql in (
    ("sum", "coalesce(sum(x), 0.0)"),
    ("mean", "avg(x)"),
    ("median", "median(x)"),
    ("min", "min(x)"),
    ("max", "max(x)"),
):
    _grouped(_agg, _sql)


@query(
    "group_distinct_count",
    """select l_shipmode, distinct_count_l_partkey from (
         select l_linestatus as l_shipmode, count(distinct l_partkey) as distinct_count_l_partkey
         from lineitem group by 1) order by 2 desc, 1""",
)
def group_distinct_count(spark, sf):
    plan = Plan("group_by", ["l_partkey"], "l_linestatus", "distinct_count")
    return run(table(spark, sf, "lineitem"), plan).table.withColumnRenamed("l_linestatus", "l_shipmode")


@query(
    "group_median_large_path",
    """select l_returnflag, round(median(l_extendedprice), 4) as median_l_extendedprice from lineitem
       group by 1 order by 2 desc, 1""",
)
def group_median_large_path(spark, sf):
    """The selection that large tables take, forced on a small one."""
    plan = Plan("group_by", ["l_extendedprice"], "l_returnflag", "median")
    out = run(table(spark, sf, "lineitem"), plan, small_rows=1000).table
    return out.withColumn("median_l_extendedprice", F.round("median_l_extendedprice", 4))


def _side_table(computed: str, source: str, column: str) -> str:
    return f"""with s as (select {source} as c from {ORDERS}),
        a as (select {computed} as v, count(c) as n, count(*) - count(c) as m, count(distinct c) as u,
              avg(c) as mean, min(c) as lo, max(c) as hi from s)
        select 'Computed Value' as metric, round(cast(v as double), 4) as value from a
        union all select 'Non-Null Count', n from a union all select 'Null Count', m from a
        union all select 'Unique Count', u from a union all select 'Mean', round(mean, 4) from a
        union all select 'Min', round(lo, 4) from a union all select 'Max', round(hi, 4) from a"""


for _agg, _sql in (
    ("sum", "coalesce(sum(c), 0.0)"),
    ("mean", "avg(c)"),
    ("median", "median(c)"),
    ("min", "min(c)"),
    ("max", "max(c)"),
    ("count", "count(c)"),
    ("distinct_count", "count(distinct c)"),
):

    def _make(agg):
        def run_it(spark, sf):
            return run(orders(spark, sf), Plan("aggregate", ["o_totalprice"], None, agg)).table

        return run_it

    query(f"aggregate_{_agg}", _side_table(_sql, "o_totalprice", "o_totalprice"))(_make(_agg))


@query(
    "distribution_numeric",
    """with b as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
       e as (select cast(range as integer) as bin, lo + range * ((hi - lo) / 10) as s,
             case when range = 9 then hi else lo + (range + 1) * ((hi - lo) / 10) end as t from b, range(10))
       select bin, round(s, 4) as bin_start, round(t, 4) as bin_end,
         (select count(*) from lineitem where l_extendedprice >= s and (l_extendedprice < t or bin = 9)) as count
       from e order by bin""",
)
def distribution_numeric(spark, sf):
    out = run(table(spark, sf, "lineitem"), Plan("distribution", ["l_extendedprice"])).table
    return out.select(
        "bin", F.round("bin_start", 4).alias("bin_start"), F.round("bin_end", 4).alias("bin_end"), "count"
    )


@query(
    "distribution_discrete",
    """with v as (select cast(l_discount as double) as v from lineitem),
       b as (select min(v) as lo, max(v) as hi from v),
       e as (select cast(range as integer) as bin, lo + range * ((hi - lo) / 10) as s,
             case when range = 9 then hi else lo + (range + 1) * ((hi - lo) / 10) end as t from b, range(10)),
       n as (select v, count(*) as n from v group by 1)
       select bin, coalesce((select cast(sum(n) as bigint) from n where v >= s and (v < t or bin = 9)), 0) as count
       from e order by bin""",
)
def distribution_discrete(spark, sf):
    return run(table(spark, sf, "lineitem"), Plan("distribution", ["l_discount"])).table.select("bin", "count")


@query(
    "distribution_categorical",
    """select event_type as category, count(*) as count from events group by 1 order by 2 desc, 1""",
)
def distribution_categorical(spark, sf):
    return run(table(spark, sf, "events"), Plan("distribution", ["event_type"])).table


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(
    "missing_analysis",
    "select * from ("
    + " union all ".join(
        f"""select '{c}' as "column", count(*) filter (where {c} is null or cast({c} as varchar) = '') as missing_count,
            count(*) filter (where {c} is not null and cast({c} as varchar) <> '') as present_count,
            round(count(*) filter (where {c} is null or cast({c} as varchar) = '') * 100.0 / count(*), 2)
              as missing_percentage from {ORDERS}"""
        for c in _ORDER_COLUMNS
    )
    + ") order by missing_percentage desc",
)
def missing_analysis(spark, sf):
    return run(orders(spark, sf), Plan("missing_analysis")).table


@query(
    "missing_analysis_metrics",
    f"""select cast(6 as bigint) as total_columns, cast(count(*) as bigint) as columns_with_missing from (
        select unnest([count(*) filter (where o_orderkey is null), count(*) filter (where o_custkey is null),
          count(*) filter (where o_orderstatus is null or o_orderstatus = ''),
          count(*) filter (where o_totalprice is null), count(*) filter (where o_orderdate is null),
          count(*) filter (where o_orderpriority is null or o_orderpriority = '')]) as m from {ORDERS}) where m > 0""",
)
def missing_analysis_metrics(spark, sf):
    return run(orders(spark, sf), Plan("missing_analysis")).metrics


@query(
    "general_summary",
    f"""with s as (select * from {ORDERS})
        select 'Total Records' as metric, count(*) as value from s union all select 'Total Columns', 6
        union all select 'Unique ''o_orderkey''', count(distinct o_orderkey) from s
        union all select 'Unique ''o_custkey''', count(distinct o_custkey) from s
        union all select 'Unique ''o_orderstatus''', count(distinct o_orderstatus) from s
        union all select 'Unique ''o_totalprice''', count(distinct o_totalprice) from s
        union all select 'Unique ''o_orderdate''', count(distinct o_orderdate) from s
        union all select 'Unique ''o_orderpriority''', count(distinct o_orderpriority) from s""",
)
def general_summary(spark, sf):
    return run(orders(spark, sf), Plan("general_summary")).table


@query(
    "plan_on_no_rows",
    """select 'empty_dataset' as status, cast(count(*) as bigint) as total_records from events where event_type = 'no such type'""",
)
def plan_on_no_rows(spark, sf):
    """A plan over a table whose filter leaves nothing."""
    none = table(spark, sf, "events").where(F.col("event_type") == "no such type")
    return run(none, Plan("group_by", ["value"], "event_type", "sum")).metrics


@query(
    "group_by_metrics",
    """with g as (select event_type, count(*) as n from events group by 1)
       select 'event_type' as group_column, 'count' as aggregation, count(*) as distinct_groups_analyzed,
         first(event_type order by n desc, event_type) as top_group from g""",
)
def group_by_metrics(spark, sf):
    return run(table(spark, sf, "events"), Plan("group_by", ["event_type"])).metrics


@query(
    "distribution_labels",
    """with f as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
       b as (select cast(unnest(range(10)) as integer) as bin, lo, hi from f)
       select bin, format('{:.1f}', round_even(lo + bin * ((hi - lo) / 10), 1)) || ' - ' ||
         format('{:.1f}', round_even(case when bin = 9 then hi else lo + (bin + 1) * ((hi - lo) / 10) end, 1)) as bin_range from b""",
)
def distribution_labels(spark, sf):
    return run(table(spark, sf, "lineitem"), Plan("distribution", ["l_extendedprice"])).table.select("bin", "bin_range")


@query(
    "sort_limit_desc",
    """select l_orderkey, l_linenumber, l_extendedprice, l_partkey from lineitem
       order by l_extendedprice desc, l_orderkey limit 25""",
)
def sort_limit_desc(spark, sf):
    plan = Plan("sort_limit", ["l_orderkey"], sort_by="l_extendedprice", limit=25, order_column="l_orderkey")
    out = run(table(spark, sf, "lineitem"), plan).table
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")


@query(
    "sort_limit_text_numbers",
    f"""select p_partkey, p_code from {PART}
        order by {STRICT.format('p_code')} asc nulls last, p_code asc nulls last, p_partkey""",
)
def sort_limit_text_numbers(spark, sf):
    plan = Plan(
        "sort_limit", ["p_code"], sort_by="p_code", sort_ascending=True, order_column="p_partkey"
    )
    return run(part(spark, sf), plan).table.select("p_partkey", "p_code")


@query(
    "sort_limit_words",
    f"""select c_custkey, c_mktsegment from {CUSTOMER}
        order by c_mktsegment desc nulls last, c_custkey limit 100""",
)
def sort_limit_words(spark, sf):
    plan = Plan("sort_limit", [], sort_by="C_MktSegment", limit=100, order_column="c_custkey")
    return run(customer(spark, sf), plan).table.select("c_custkey", "c_mktsegment")


def _filtered(name: str, filters, where: str):
    @query(
        f"filter_{name}",
        f"""select count(*) as records, count(c_mktsegment) as with_segment,
            cast(sum(c_custkey) as bigint) as keys from {CUSTOMER} where {where}""",
    )
    def run_it(spark, sf):
        from tablewise.operators.filters import apply_filters

        return apply_filters(customer(spark, sf), filters).agg(
            F.count(F.lit(1)).alias("records"),
            F.count("c_mktsegment").alias("with_segment"),
            F.sum("c_custkey").alias("keys"),
        )

    return run_it


_filtered("equal", [Filter("c_mktsegment", "==", "MACHINERY")], "c_mktsegment = 'MACHINERY'")
_filtered(
    "not_equal",
    [Filter("c_mktsegment", "!=", "MACHINERY")],
    "c_mktsegment is distinct from 'MACHINERY'",
)
_filtered("greater", [Filter("c_acctbal", ">", "5000")], "c_acctbal > 5000")
_filtered("less_equal", [Filter("c_acctbal", "<=", 1000), Filter("c_nationkey", ">=", 3)], "c_acctbal <= 1000 and c_nationkey >= 3")
_filtered("less", [Filter("c_acctbal", "<", 0)], "c_acctbal < 0")
_filtered("no_number", [Filter("c_acctbal", ">", "many")], "true")
_filtered("contains", [Filter("c_mktsegment", "contains", "mach")], "c_mktsegment ilike '%mach%'")
_filtered("is_null", [Filter("c_mktsegment", "is_null")], "c_mktsegment is null")
_filtered("is_not_null", [Filter("c_acctbal", "is_not_null")], "c_acctbal is not null")


@query(
    "filter_rows",
    f"""select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from {CUSTOMER}
        where c_mktsegment is distinct from 'MACHINERY' and c_acctbal > 100 order by c_custkey""",
)
def filter_rows(spark, sf):
    plan = Plan(
        "filter",
        filters=[Filter("c_mktsegment", "!=", "MACHINERY"), Filter("c_acctbal", ">", 100)],
        order_column="c_custkey",
    )
    return run(customer(spark, sf), plan).table


_SKEWED = "(select event_id, user_id, event_type, value * value * value as cubed from events)"


def _skewed(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", (v * v * v).alias("cubed"))


_BOUNDS = f"""b as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi, q1, q3 from (
      select quantile_cont(cubed, 0.25) as q1, quantile_cont(cubed, 0.75) as q3 from {_SKEWED}))"""


@query(
    "outlier_rows",
    f"""with {_BOUNDS} select event_id, user_id, event_type, round(cubed, 4) as cubed
        from {_SKEWED}, b where cubed < lo or cubed > hi order by event_id""",
)
def outlier_rows(spark, sf):
    plan = Plan("outlier_detection", ["cubed"], order_column="event_id")
    return run(_skewed(spark, sf), plan).table.withColumn("cubed", F.round("cubed", 4))


@query(
    "outlier_bounds",
    f"""with {_BOUNDS} select 'cubed' as "column", round(q1, 2) as q1, round(q3, 2) as q3, round(q3 - q1, 2) as iqr,
        round(lo, 2) as lower_bound, round(hi, 2) as upper_bound,
        (select count(*) from {_SKEWED} where cubed < lo or cubed > hi) as outlier_count from b""",
)
def outlier_bounds(spark, sf):
    out = run(_skewed(spark, sf), Plan("outlier_detection", ["cubed"])).metrics
    return out.select(
        "column",
        *[F.round(c, 2).alias(c) for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")],
        "outlier_count",
    )


@query(
    "outlier_bounds_large_path",
    f"""with {_BOUNDS} select round(lo, 2) as lower_bound, round(hi, 2) as upper_bound,
        (select count(*) from {_SKEWED} where cubed < lo or cubed > hi) as outlier_count from b""",
)
def outlier_bounds_large_path(spark, sf):
    """Quartiles narrowed over several passes, forced on a small table."""
    df = _skewed(spark, sf)
    c = F.col("cubed")
    q1, q3 = quantiles(df, {"cubed": c}, [0.25, 0.75], few_rows=3)["cubed"]
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return df.where((c < low) | (c > high)).agg(
        F.round(F.max(F.lit(low)), 2).alias("lower_bound"),
        F.round(F.max(F.lit(high)), 2).alias("upper_bound"),
        F.count(F.lit(1)).alias("outlier_count"),
    )


_LINE = "(select l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * 2 + l_tax as mixed, 5 as fixed from lineitem)"
_PAIRS = [
    (a, b)
    for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax", "mixed", "fixed"))
    for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "mixed", "fixed")[i + 1 :]
]


def line(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("mixed"),
        F.lit(5).alias("fixed"),
    )


def _corr(a: str, b: str) -> str:
    return f"case when stddev_pop({a}) = 0 or stddev_pop({b}) = 0 then null else corr({a}, {b}) end"


PAIRS_SQL = " union all ".join(
    f"select '{a}' as column_a, '{b}' as column_b, {_corr(a, b)} as r from {_LINE}" for a, b in _PAIRS
)


@query(
    "correlation",
    f"""select column_a, column_b, round(r, 4) as correlation,
        case when r > 0 then 'Positive' else 'Negative' end as relationship,
        case when abs(r) >= 0.7 then 'Strong' when abs(r) >= 0.4 then 'Moderate' else 'Weak' end as strength
        from ({PAIRS_SQL}) where r is not null order by abs(r) desc""",
)
def correlation(spark, sf):
    return run(line(spark, sf), Plan("correlation")).table


@query(
    "chart_points_of_result",
    """select l_returnflag as name, round(sum(l_quantity), 2) as value from lineitem group by 1""",
)
def chart_points_of_result(spark, sf):
    plan = Plan("group_by", ["l_quantity"], "l_returnflag", "sum")
    return as_points(run(table(spark, sf, "lineitem"), plan).table, "l_returnflag", "sum_l_quantity").withColumn(
        "value", F.round("value", 2)
    )


@query(
    "page_of_orders",
    f"""select o_orderkey, o_totalprice from {ORDERS}
        order by o_totalprice desc nulls last, o_orderkey limit 40 offset 80""",
)
def page_of_orders(spark, sf):
    p = page(orders(spark, sf), [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 3, 40)
    return p.rows.select("o_orderkey", "o_totalprice")


@query(
    "page_total",
    "select count(*) as total, cast(greatest(1, ceil(count(*) / 40.0)) as bigint) as pages from orders",
)
def page_total(spark, sf):
    return page(orders(spark, sf), [F.col("o_orderkey")], 1, 40).total
