"""Checks of statistics, profiles, quality scores, distributions and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.operators.insights import insights, report_bundle
from tablewise.operators.profile import (
    Field,
    chart_points,
    field_distributions,
    profile_columns,
    profile_overview,
    quality_facts,
    quality_scores,
)
from tablewise.frequent import first_values, frequent_values
from tablewise.quantiles import quantiles
from tablewise.operators.stats import (
    correlation_matrix,
    describe_numeric,
    outlier_report,
    top_correlations,
)
from tablewise.operators.tables import column_kinds, column_samples

from .inputs import CUSTOMER, LOOSE, ORDERS, PART, STRICT, customer, orders, part
from .plan_queries import _SKEWED, PAIRS_SQL, _skewed, line
from .registry import query, table


def _rounded(df, *names, places=4):
    return df.withColumns({n: F.round(n, places) for n in names})


# -- descriptive statistics -------------------------------------------------

_LINE_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)


def _describe(source: str, columns, number="cast({0} as double)", empty="{0} is null") -> str:
    return " union all ".join(
        f"""select '{c}' as "column", count(x) as count, round(avg(x), 4) as mean, round(coalesce(stddev_samp(x), 0), 4) as std,
            round(min(x), 4) as min, round(quantile_cont(x, 0.25), 4) as q25, round(median(x), 4) as median,
            round(quantile_cont(x, 0.75), 4) as q75, round(max(x), 4) as max,
            count(*) filter (where e) as null_count
            from (select {number.format(c)} as x, {empty.format(c)} as e from {source})"""
        for c in columns
    )


@query("describe_lineitem", _describe("lineitem", _LINE_NUMBERS))
def describe_lineitem(spark, sf):
    return describe_numeric(table(spark, sf, "lineitem"))


@query(
    "quantiles_many_passes",
    """select 'l_quantity' as "column", round(quantile_cont(cast(l_quantity as double), 0.1), 4) as p10,
         round(quantile_cont(cast(l_quantity as double), 0.999), 4) as p999 from lineitem
       union all select 'l_extendedprice', round(quantile_cont(l_extendedprice, 0.1), 4), round(quantile_cont(l_extendedprice, 0.999), 4) from lineitem
       union all select 'spread', round(quantile_cont(exp(l_quantity), 0.1), 4), round(quantile_cont(exp(l_quantity), 0.999), 4) from lineitem""",
)
def quantiles_many_passes(spark, sf):
    """Brackets divided into slices, forced on a small table."""
    df = table(spark, sf, "lineitem")
    columns = {
        "l_quantity": F.col("l_quantity").cast("double"),
        "l_extendedprice": F.col("l_extendedprice"),
        "spread": F.exp("l_quantity"),
    }
    found = quantiles(df, columns, [0.1, 0.999], few_rows=20)
    rows = [(n, *v) for n, v in found.items()]
    return _rounded(spark.createDataFrame(rows, "column string, p10 double, p999 double"), "p10", "p999")


@query(
    "describe_text_numbers",
    _describe(PART, ("p_code",), STRICT, "({0} is null or {0} = '')"),
)
def describe_text_numbers(spark, sf):
    return describe_numeric(part(spark, sf), ["p_code", "p_name"])


@query(
    "outlier_report",
    f"""with c as (select 'cubed' as n, event_id, cubed as x from {_SKEWED}
          union all select 'user_id', event_id, user_id from events),
        q as (select n, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from c group by 1),
        b as (select n, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q),
        o as (select c.n, c.x, row_number() over (partition by c.n order by event_id) as place
              from c join b on b.n = c.n where x < lo or x > hi)
        select b.n as "column", round(lo, 2) as lower_bound, round(hi, 2) as upper_bound,
          (select count(*) from o where o.n = b.n) as outlier_count,
          coalesce((select string_agg(cast(cast(x as decimal(20, 2)) as varchar), ' ' order by place) from o
             where o.n = b.n and place <= 5), '') as samples from b""",
)
def outlier_report_events(spark, sf):
    out = outlier_report(_skewed(spark, sf), "event_id", ["cubed", "user_id"])
    return out.select(
        "column",
        F.round("lower_bound", 2).alias("lower_bound"),
        F.round("upper_bound", 2).alias("upper_bound"),
        "outlier_count",
        F.array_join(F.transform("sample_outlier_values", lambda x: x.cast("decimal(20,2)").cast("string")), " ").alias("samples"),
    )


@query(
    "correlation_matrix",
    f"""with p as ({PAIRS_SQL}) select column_a, column_b, round(r, 3) as r from p
        union all select column_b, column_a, round(r, 3) from p
        union all select c, c, case when c = 'fixed' then null else 1.0 end from (
          select unnest(['l_quantity','l_extendedprice','l_discount','l_tax','mixed','fixed']) as c)""",
)
def correlation_matrix_lineitem(spark, sf):
    return correlation_matrix(line(spark, sf))


@query(
    "top_correlations",
    f"""with p as ({PAIRS_SQL}), r as (select column_a, column_b, round(r, 3) as coefficient from p where r is not null)
        select *, case when coefficient >= 0.7 then 'strong_positive' when coefficient >= 0.4 then 'moderate_positive'
          when coefficient <= -0.7 then 'strong_negative' when coefficient <= -0.4 then 'moderate_negative'
          else 'weak' end as strength from r""",
)
def top_correlations_lineitem(spark, sf):
    return top_correlations(line(spark, sf))


# -- profiles ---------------------------------------------------------------

_ORDER_TEXTS = {
    "o_orderkey": "cast(o_orderkey as varchar)",
    "o_custkey": "cast(o_custkey as varchar)",
    "o_orderstatus": "o_orderstatus",
    "o_totalprice": "cast(o_totalprice as varchar)",
    "o_orderdate": "cast(o_orderdate as varchar)",
    "o_orderpriority": "o_orderpriority",
}


def _long(texts: dict[str, str], source: str, seq: str) -> str:
    """(c, seq, v): the non-missing cells of all columns as text."""
    parts = " union all ".join(f"select '{c}' as c, {seq} as seq, {t} as v from {source}" for c, t in texts.items())
    return f"(select * from ({parts}) where v is not null and lower(trim(v)) not in ('', 'null'))"


_PROFILE_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "profile_orders",
    f"""with l as {_long(_ORDER_TEXTS, ORDERS, 'o_orderkey')}, r as (select count(*) as rows from {ORDERS}),
        s as (select c, count(*) as n, count(distinct v) as u, min(length(v)) as lo_len, max(length(v)) as hi_len,
               avg(length(v)) as av_len, min(x) as lo, max(x) as hi, avg(x) as mean, median(x) as med
              from (select *, case when c in {_PROFILE_NUMBERS} then try_cast(v as double) end as x from l) group by c)
        select c as column_name, case when c in {_PROFILE_NUMBERS} then 'number' else 'string' end as inferred_type,
          n as non_null_count, rows - n as null_count, round((rows - n) * 100.0 / rows, 1) as missing_percentage,
          u as unique_count, n - u as duplicate_count, round(lo, 2) as min_value, round(hi, 2) as max_value,
          round(mean, 2) as mean, round(med, 2) as median,
          case when c not in {_PROFILE_NUMBERS} then cast(lo_len as integer) end as min_len,
          case when c not in {_PROFILE_NUMBERS} then cast(hi_len as integer) end as max_len,
          case when c not in {_PROFILE_NUMBERS} then round(av_len, 1) end as avg_len,
          cast(100.0 as double) as valid_format_percentage
        from s, r
        union all select 'o_clerk', 'string', 0, rows, 100.0, 0, 0, null, null, null, null, null, null, null, 0.0 from r""",
)
def profile_orders(spark, sf):
    fields = [Field("o_clerk"), Field("o_totalprice", "number")]
    out = profile_columns(orders(spark, sf), "o_orderkey", fields)
    return out.drop("display_label", "top_values", "sample_values")


@query(
    "profile_lineitem",
    f"""select 'l_extendedprice' as column_name, count(*) as non_null_count,
        count(distinct l_extendedprice) as unique_count, round(median(l_extendedprice), 2) as median from lineitem""",
)
def profile_lineitem(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    out = profile_columns(df, "l_orderkey")
    return out.where("column_name = 'l_extendedprice'").select(
        "column_name", "non_null_count", "unique_count", "median"
    )


@query(
    "profile_pages",
    """select column_name, inferred_type, non_null_count, unique_count, min_len, max_len, avg_len, valid_format_percentage
       from (select 'url' as column_name, 'url' as inferred_type, count(*) as non_null_count, count(distinct url) as unique_count,
         cast(min(length(url)) as integer) as min_len, cast(max(length(url)) as integer) as max_len,
         round(avg(length(url)), 1) as avg_len,
         round(count(*) filter (where url like 'http://%' or url like 'https://%') * 100.0 / count(*), 1) as valid_format_percentage
         from pages
         union all select 'html', 'string', count(*), count(distinct html), cast(min(length(html)) as integer),
           cast(max(length(html)) as integer), round(avg(length(html)), 1), 100.0 from pages)""",
)
def profile_pages(spark, sf):
    out = profile_columns(table(spark, sf, "pages"), "page_id")
    return out.where("column_name <> 'page_id'").select(
        "column_name", "inferred_type", "non_null_count", "unique_count", "min_len", "max_len", "avg_len",
        "valid_format_percentage",
    )


@query(
    "profile_top_values",
    f"""select c as "column", v as value, n as count, place from (
          select c, v, n, cast(row_number() over (partition by c order by n desc, v) as integer) as place
          from (select c, v, count(*) as n from {_long(_ORDER_TEXTS, ORDERS, 'o_orderkey')} group by 1, 2))
        where place <= 5""",
)
def profile_top_values(spark, sf):
    df = orders(spark, sf)
    return frequent_values(df, df.columns, "o_orderkey", 5).select(
        "column", F.col("key").alias("value"), F.col("n").alias("count"), "place"
    )


@query(
    "profile_sample_values",
    f"""select c as "column", v as value, place from (
          select c, v, cast(row_number() over (partition by c order by seq, v) as integer) as place
          from (select c, v, min(seq) as seq from {_long(_ORDER_TEXTS, ORDERS, 'o_orderkey')} group by 1, 2))
        where place <= 5""",
)
def profile_sample_values(spark, sf):
    df = orders(spark, sf)
    return first_values(df, df.columns, "o_orderkey", 5).select(
        "column", F.col("key").alias("value"), "place"
    )


@query(
    "profile_documents",
    """with t as (select text as v, min(doc_id) as seq, count(*) as n from documents
         where lower(trim(text)) not in ('', 'null') group by 1)
       select (select cast(sum(n) as bigint) from t) as non_null_count, (select count(*) from t) as unique_count,
         (select string_agg(md5(v), ' ' order by n desc, r) from (
            select v, n, row_number() over (order by n desc, left(v, 256), case when length(v) <= 256 then v else 'sha256:' || sha256(v) end) as r
            from t) where r <= 5) as top_texts,
         (select string_agg(md5(v), ' ' order by seq) from (select v, seq from t order by seq limit 5)) as first_texts""",
)
def profile_documents(spark, sf):
    """Long texts: grouped by hash, put back whole in the report."""
    out = profile_columns(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return out.where("column_name = 'text'").select(
        "non_null_count",
        "unique_count",
        F.array_join(F.transform("top_values", lambda t: F.md5(t["value"])), " ").alias("top_texts"),
        F.array_join(F.transform("sample_values", F.md5), " ").alias("first_texts"),
    )


_STATUSED = """(select *, case when c_custkey % 5 = 0 then 'invalid' when c_custkey % 3 = 0 then 'valid_with_warnings'
    when c_custkey % 7 = 0 then null else 'valid' end as validation_status,
    cast(c_custkey % 4 as integer) as source_count from {0})"""


def statused(df):
    k = F.col("c_custkey")
    return df.withColumn(
        "validation_status",
        F.when(k % 5 == 0, "invalid")
        .when(k % 3 == 0, "valid_with_warnings")
        .when(k % 7 == 0, F.lit(None))
        .otherwise("valid"),
    ).withColumn("source_count", (k % 4).cast("int"))


# Customers with copies, stray spaces and a URL column.
_MESSY = """(select c_custkey, c_name, case when c_custkey % 6 = 0 then ' ' || c_mktsegment when c_custkey % 6 = 1
    then 'a  b' else nullif(c_mktsegment, 'BUILDING') end as c_mktsegment,
    case when c_custkey % 4 = 0 then 'www.example.org' when c_custkey % 4 = 1 then '' else 'https://example.org/' || c_custkey end
      as c_website from customer
    union all select c_custkey, c_name, case when c_custkey % 6 = 0 then ' ' || c_mktsegment when c_custkey % 6 = 1
    then 'a  b' else nullif(c_mktsegment, 'BUILDING') end,
    case when c_custkey % 4 = 0 then 'www.example.org' when c_custkey % 4 = 1 then '' else 'https://example.org/' || c_custkey end
      from customer where c_custkey % 10 = 0)"""


def messy(spark, sf):
    k = F.col("c_custkey")
    one = table(spark, sf, "customer").select(
        "c_custkey",
        "c_name",
        F.when(k % 6 == 0, F.concat(F.lit(" "), F.col("c_mktsegment")))
        .when(k % 6 == 1, "a  b")
        .otherwise(F.nullif("c_mktsegment", F.lit("BUILDING")))
        .alias("c_mktsegment"),
        F.when(k % 4 == 0, "www.example.org")
        .when(k % 4 == 1, "")
        .otherwise(F.concat(F.lit("https://example.org/"), k.cast("string")))
        .alias("c_website"),
    )
    return one.unionByName(one.where(k % 10 == 0))


@query(
    "profile_overview",
    f"""with s as {_STATUSED.format(_MESSY)}
        select count(*) as total_records, cast(4 as bigint) as total_columns, cast(3 as bigint) as total_sources,
          count(*) filter (where validation_status = 'valid') as valid_records,
          count(*) filter (where validation_status = 'valid_with_warnings') as records_with_warnings,
          count(*) filter (where validation_status = 'invalid') as invalid_records,
          count(*) - (select count(*) from (select distinct c_custkey, c_name, c_mktsegment, c_website from s)) as duplicate_records,
          (select count(*) from (select distinct c_custkey, c_name, c_mktsegment, c_website from s)) as unique_records
        from s""",
)
def profile_overview_customers(spark, sf):
    return profile_overview(statused(messy(spark, sf)), sources=3)


_QUALITY = f"""with s as {_STATUSED.format(_MESSY)},
    f as (select count(*) as n,
      sum(cast(c_custkey is not null as integer) + cast(c_name is not null and lower(trim(c_name)) not in ('', 'null') as integer)
        + cast(c_mktsegment is not null and lower(trim(c_mktsegment)) not in ('', 'null') as integer)
        + cast(c_website is not null and lower(trim(c_website)) not in ('', 'null') as integer)) as filled,
      count(*) filter (where c_mktsegment is null or c_website = '') as lacking,
      count(*) filter (where coalesce(validation_status, 'valid') = 'valid') as ok,
      count(*) filter (where validation_status = 'valid_with_warnings') as warned,
      count(*) filter (where validation_status = 'invalid') as broken,
      count(*) filter (where c_mktsegment <> trim(c_mktsegment) or c_mktsegment like '%  %')
        + count(*) filter (where c_website <> '' and c_website not like 'http://%' and c_website not like 'https://%') as odd,
      count(*) filter (where source_count > 0) as backed,
      (select count(*) from (select distinct c_custkey, c_name, c_mktsegment, c_website from s)) as u from s),
    r as (select *, n * 4 as cells, round(filled * 100.0 / (n * 4), 1) as completeness,
      round((ok + 0.5 * warned) * 100.0 / n, 1) as validity, round(u * 100.0 / n, 1) as uniqueness,
      round((n * 4 - odd) * 100.0 / (n * 4), 1) as consistency, round(backed * 100.0 / n, 1) as provenance from f)"""

_FIELDS = [
    Field("c_custkey", "integer", True),
    Field("c_name", "string", True),
    Field("c_mktsegment", "string", True),
    Field("c_website", "url", True),
]


@query(
    "quality_scores",
    _QUALITY
    + """ select 'completeness' as dimension, cast(completeness as double) as score, cast(lacking as bigint) as affected_count from r
        union all select 'validity', validity, broken + warned from r
        union all select 'uniqueness', uniqueness, n - u from r
        union all select 'consistency', consistency, odd from r
        union all select 'provenance', provenance, n - backed from r
        union all select 'overall', round(0.25 * completeness + 0.25 * validity + 0.2 * uniqueness
          + 0.15 * consistency + 0.15 * provenance, 1), 0 from r""",
)
def quality_scores_customers(spark, sf):
    return quality_scores(statused(messy(spark, sf)), _FIELDS).drop("suggestions")


@query(
    "quality_facts_with_links",
    _QUALITY
    + """ select n as records, cast(filled as bigint) as populated, cells, lacking as missing_required, odd as inconsistent,
          least(n, 50) as with_sources, n - u as duplicates from r""",
)
def quality_facts_with_links(spark, sf):
    return quality_facts(statused(messy(spark, sf)), _FIELDS, links=50).select(
        "records", "populated", "cells", "missing_required", "inconsistent", "with_sources", "duplicates"
    )


@query(
    "quality_without_status",
    """select dimension, cast(100.0 as double) as score from (select count(*) as n from orders),
       (select unnest(['validity', 'provenance', 'completeness']) as dimension) where n > 0""",
)
def quality_without_status(spark, sf):
    """Missing status counts as valid; sources without backed rows back the table."""
    out = quality_scores(table(spark, sf, "orders"), sources=2)
    return out.where(F.col("dimension").isin("validity", "provenance", "completeness")).select("dimension", "score")


# -- distributions and charts -----------------------------------------------

_LINE_DISTRIBUTION = ("l_quantity", "l_extendedprice", "l_tax")


@query(
    "field_distributions_numeric",
    " union all ".join(
        f"""select '{c}' as "column", 'numeric' as type, position, cast((select count(*) from lineitem
              where {c} >= s and ({c} < t or position = bins - 1)) as bigint) as count,
              case when t > 100 then format('{{:,}}', cast(round_even(s, 0) as bigint)) || ' - ' || format('{{:,}}', cast(round_even(t, 0) as bigint))
                else format('{{:.1f}}', round_even(s, 1)) || ' - ' || format('{{:.1f}}', round_even(t, 1)) end as label,
              round(s, 4) as bin_min, round(t, 4) as bin_max
            from (select cast(unnest(range(bins)) as integer) as position, * from (
               select min({c}) as lo, max({c}) as hi, least(8, count(distinct {c})) as bins from lineitem)) a,
            lateral (select lo + position * ((hi - lo) / bins) as s,
              case when position = bins - 1 then hi else lo + (position + 1) * ((hi - lo) / bins) end as t)"""
        for c in _LINE_DISTRIBUTION
    ),
)
def field_distributions_numeric(spark, sf):
    out = field_distributions(table(spark, sf, "lineitem"), "l_orderkey", list(_LINE_DISTRIBUTION))
    return _rounded(out, "bin_min", "bin_max")


@query(
    "field_distributions_mixed",
    f"""select 'o_orderstatus' as "column", 'categorical' as type, cast(row_number() over (order by count(*) desc, o_orderstatus) - 1 as integer)
          as position, o_orderstatus as label, count(*) as count from {ORDERS} where o_orderstatus is not null group by o_orderstatus
        union all select 'o_orderpriority', 'categorical', cast(place - 1 as integer), v, n from (
          select v, n, row_number() over (order by n desc, v) as place from (
            select o_orderpriority as v, count(*) as n from {ORDERS}
            where lower(trim(o_orderpriority)) not in ('', 'null') group by 1)) where place <= 10
        union all select 'nothing', 'empty', 0, null, 0""",
)
def field_distributions_mixed(spark, sf):
    df = orders(spark, sf).withColumn("nothing", F.lit(" "))
    out = field_distributions(df, "o_orderkey", ["o_orderstatus", "o_orderpriority", "nothing"])
    return out.select("column", "type", "position", "label", "count")


@query(
    "chart_count",
    f"""select c_mktsegment as name, count(*) as value from {CUSTOMER} where c_mktsegment is not null
        group by 1 order by 2 desc, 1 limit 15""",
)
def chart_count(spark, sf):
    return chart_points(customer(spark, sf), "c_mktsegment", None, "median")


for _agg, _expr in (("sum", "coalesce(sum(x), 0.0)"), ("avg", "avg(x)"), ("min", "min(x)"), ("max", "max(x)")):

    def _chart(agg):
        return lambda spark, sf: chart_points(part(spark, sf), "p_brand", "p_code", agg, 10)

    query(
        f"chart_{_agg}",
        f"""select name, round(v, 2) as value from (select p_brand as name, {_expr} as v from (
            select p_brand, {LOOSE.format('p_code')} as x from {PART}) group by 1)
            where v is not null order by value desc, name limit 10""",
    )(_chart(_agg))


@query(
    "chart_distinct",
    """select event_type as name, count(distinct user_id) as value from events group by 1 order by 2 desc, 1 limit 15""",
)
def chart_distinct(spark, sf):
    return chart_points(table(spark, sf, "events"), "event_type", "user_id", "distinct_count")


@query("chart_distinct_x", "select 'user_id' as name, count(distinct user_id) as value from events")
def chart_distinct_x(spark, sf):
    return chart_points(table(spark, sf, "events"), "user_id", None, "distinct_count")


# -- column kinds -----------------------------------------------------------

@query(
    "column_kinds",
    f"""select 'p_partkey' as "column", 0 as position, 'number' as kind union all select 'p_name', 1, 'string'
        union all select 'p_brand', 2, 'string' union all select 'p_type', 3, 'string' union all select 'p_size', 4, 'number'
        union all select 'p_retailprice', 5, 'number'
        union all select 'p_code', 6, case when count({STRICT.format('p_code')}) > 0.5 * count(p_code) then 'number' else 'string' end
        from {PART}""",
)
def column_kinds_part(spark, sf):
    return column_kinds(part(spark, sf))


@query(
    "column_samples",
    f"""select c as "column", cast(place as integer) as place, v as value from (
          select c, v, row_number() over (partition by c order by seq) as place from (
            select 'p_partkey' as c, p_partkey as seq, cast(p_partkey as varchar) as v from {PART}
            union all select 'p_code', p_partkey, p_code from {PART}
            union all select 'p_name', p_partkey, p_name from {PART}) where v is not null) where place <= 3""",
)
def column_samples_part(spark, sf):
    return column_samples(part(spark, sf).select("p_partkey", "p_code", "p_name"), "p_partkey")


# -- insights ---------------------------------------------------------------


def _evidence(df, category: str, *keys: str):
    """Evidence of one kind of insight, numbers read back from text."""
    texts = ("column", "column_a", "column_b", "strength", "top_category", "top_values", "top_entity", "samples")
    return df.where(F.col("category") == category).select(
        *[
            (F.col("evidence")[k] if k in texts else F.col("evidence")[k].cast("double")).alias(k)
            for k in keys
        ]
    )


@query(
    "insight_overview",
    f"""select cast(n as double) as total_records, cast(5 as double) as total_columns,
          round((n * 5 - gaps) * 100.0 / (n * 5), 1) as completeness_pct, cast(gaps as double) as null_cells_count
        from (select count(*) as n, count(*) filter (where c_acctbal is null) + count(*) filter (where c_mktsegment is null) as gaps
              from {CUSTOMER})""",
)
def insight_overview(spark, sf):
    return _evidence(
        insights(customer(spark, sf), "c_custkey"), "overview",
        "total_records", "total_columns", "completeness_pct", "null_cells_count",
    )


@query(
    "insight_extremes",
    f"""select 'c_custkey' as "column", round(max(c_custkey), 4) as max, round(min(c_custkey), 4) as min, round(avg(c_custkey), 4) as mean,
          round(median(c_custkey), 4) as median, arg_max(c_name, c_custkey) as top_entity from (select cast(c_custkey as double) as c_custkey, c_name from {CUSTOMER})
        union all select 'c_nationkey', round(max(x), 4), round(min(x), 4), round(avg(x), 4), round(median(x), 4),
          (select c_name from customer order by c_nationkey desc, c_custkey limit 1)
          from (select cast(c_nationkey as double) as x from {CUSTOMER})
        union all select 'c_acctbal', round(max(c_acctbal), 4), round(min(c_acctbal), 4), round(avg(c_acctbal), 4), round(median(c_acctbal), 4),
          (select c_name from {CUSTOMER} order by c_acctbal desc nulls last, c_custkey limit 1) from {CUSTOMER}""",
)
def insight_extremes(spark, sf):
    return _evidence(
        insights(customer(spark, sf), "c_custkey"), "extremes", "column", "max", "min", "mean", "median", "top_entity"
    )


@query(
    "insight_categories",
    f"""select 'c_mktsegment' as "column", first(v order by place) as top_category, cast(max(n) as double) as top_count,
          round(max(n) * 100.0 / (select count(*) from customer), 1) as top_percentage,
          cast((select count(distinct c_mktsegment) from {CUSTOMER}) as double) as distinct_categories,
          string_agg(v || '=' || n, ', ' order by place) as top_values
        from (select c_mktsegment as v, count(*) as n, row_number() over (order by count(*) desc, c_mktsegment) as place
              from {CUSTOMER} where c_mktsegment is not null group by 1) where place <= 5""",
)
def insight_categories(spark, sf):
    return _evidence(
        insights(customer(spark, sf), "c_custkey"), "categorical",
        "column", "top_category", "top_count", "top_percentage", "distinct_categories", "top_values",
    )


_TWO = "(select event_id, cubed, cubed + user_id as shifted, event_type from {0})".format(_SKEWED)


def _two(spark, sf):
    return _skewed(spark, sf).select("event_id", "cubed", (F.col("cubed") + F.col("user_id")).alias("shifted"), "event_type")


@query(
    "insight_outliers",
    f"""with q as (select quantile_cont(cubed, 0.25) as q1, quantile_cont(cubed, 0.75) as q3 from {_TWO}),
        b as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)
        select 'cubed' as "column", cast(count(*) as double) as outlier_count,
          round(count(*) * 100.0 / (select count(*) from events), 1) as outlier_percentage,
          round(max(lo), 2) as lower_bound, round(max(hi), 2) as upper_bound
        from {_TWO}, b where cubed < lo or cubed > hi
        union all select 'shifted', cast(count(*) as double), round(count(*) * 100.0 / (select count(*) from events), 1),
          round(max(lo), 2), round(max(hi), 2)
        from {_TWO}, (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (
          select quantile_cont(shifted, 0.25) as q1, quantile_cont(shifted, 0.75) as q3 from {_TWO})) where shifted < lo or shifted > hi""",
)
def insight_outliers(spark, sf):
    df = _two(spark, sf).select("cubed", "event_id", "shifted", "event_type")
    out = _evidence(
        insights(df, "event_id"), "outlier", "column", "outlier_count", "outlier_percentage", "lower_bound", "upper_bound"
    )
    return _rounded(out, "lower_bound", "upper_bound", places=2)


@query(
    "insight_correlations",
    f"""select 'cubed' as column_a, 'shifted' as column_b, round(corr(cubed, shifted), 3) as pearson_r,
        'strong' as strength from {_TWO}""",
)
def insight_correlations(spark, sf):
    return _evidence(
        insights(_two(spark, sf), "event_id"), "correlation", "column_a", "column_b", "pearson_r", "strength"
    )


@query(
    "insight_missing",
    f"""select 'o_orderpriority' as "column", cast(count(*) filter (where p is null or p = '') as double) as missing_count,
          round(count(*) filter (where p is null or p = '') * 100.0 / count(*), 1) as missing_percentage
        from (select case when o_orderkey % 3 = 0 then null else o_orderpriority end as p from {ORDERS})""",
)
def insight_missing(spark, sf):
    k = F.col("o_orderkey")
    df = orders(spark, sf).withColumn("o_orderpriority", F.when(k % 3 != 0, F.col("o_orderpriority")))
    return _evidence(insights(df, "o_orderkey"), "quality", "column", "missing_count", "missing_percentage")


@query(
    "insights_on_no_rows",
    """select 'overview' as category, 'Empty Dataset' as title, 'record_count' as method, cast(count(*) as varchar) as row_count
       from events where event_type = 'no such type'""",
)
def insights_on_no_rows(spark, sf):
    none = table(spark, sf, "events").where(F.col("event_type") == "no such type")
    return insights(none, "event_id").select("category", "title", "method", F.col("evidence")["row_count"].alias("row_count"))


_BUNDLE_NUMBERS = ("c_custkey", "c_nationkey", "c_acctbal")
_BUNDLE_PAIRS = (("c_custkey", "c_nationkey"), ("c_custkey", "c_acctbal"), ("c_nationkey", "c_acctbal"))

_BUNDLE = f"""with c as (select cast(c_custkey as double) as c_custkey, c_name, cast(c_nationkey as double) as c_nationkey, c_acctbal, c_mktsegment from {CUSTOMER}),
    gaps as (select count(*) as n, count(*) filter (where c_acctbal is null) + count(*) filter (where c_mktsegment is null) as g from c),
    seg as (select c_mktsegment as v, count(*) as k, row_number() over (order by count(*) desc, c_mktsegment) as place from c where c_mktsegment is not null group by 1),
    card as (
      select n || ' records across 5 columns' as item, unnest(['total_records', 'total_columns', 'completeness_pct', 'null_cells_count']) as key,
        unnest([n::double, 5, round((n * 5 - g) * 100.0 / (n * 5), 1), g]) as number, null::varchar as text from gaps
      {" ".join(f"""union all select 'Highest and lowest {x}', unnest(['column', 'max', 'min', 'mean', 'median', 'top_entity']),
        unnest([null, round(max({x}), 4), round(min({x}), 4), round(avg({x}), 4), round(median({x}), 4), null]),
        unnest(['{x}', null, null, null, null, first(c_name order by {x} desc nulls last, c_custkey)]) from c""" for x in _BUNDLE_NUMBERS)}
      union all select 'Dominant category in c_mktsegment: ' || first(v order by place), unnest(['column', 'top_category', 'top_count', 'top_percentage', 'distinct_categories', 'top_values']),
        unnest([null, null, max(k)::double, round(max(k) * 100.0 / (select count(*) from c), 1), count(*)::double, null]),
        unnest(['c_mktsegment', first(v order by place), null, null, null, (select string_agg(v || '=' || k, ', ' order by place) from seg where place <= 5)]) from seg),
    stat as ({_describe("c", _BUNDLE_NUMBERS)}),
    pair as ({" union all ".join(f"select '{a} ~ {b}' as item, round(corr({a}, {b}), 3) as r from c" for a, b in _BUNDLE_PAIRS)})
    select 'insights' as section, item, key, round(number, 3) as number, text from card
    union all select 'statistics', "column", unnest(['count', 'mean', 'std', 'min', 'q25', 'median', 'q75', 'max', 'null_count']),
      unnest([round(count::double, 3), round(mean, 3), round(std, 3), round(min, 3), round(q25, 3), round(median, 3), round(q75, 3), round(max, 3), round(null_count::double, 3)]), null from stat
    union all select 'correlations', item, case when r >= 0.7 then 'strong_positive' when r >= 0.4 then 'moderate_positive'
      when r <= -0.7 then 'strong_negative' when r <= -0.4 then 'moderate_negative' else 'weak' end, r, null from pair"""


@query("report_bundle", _BUNDLE)
def report_bundle_customers(spark, sf):
    """All rows of the bundle; values that are numbers are compared as numbers."""
    number = F.col("value").try_cast("double")
    return report_bundle(customer(spark, sf), "c_custkey").select(
        "section", "item", "key", F.round(number, 3).alias("number"), F.when(number.isNull(), F.col("value")).alias("text")
    )
