"""Inputs of the checks: driver tables with nulls, blanks and copies put in.

The driver tables hold no null, so the rules for missing values would go untested.
Every function has a SQL twin of the same shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import table

CUSTOMER = """(select c_custkey, c_name, c_nationkey,
    case when c_custkey % 11 = 0 then null else c_acctbal end as c_acctbal,
    nullif(c_mktsegment, 'BUILDING') as c_mktsegment from customer)"""


def customer(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
    )


ORDERS = """(select o_orderkey, o_custkey,
    case when o_orderkey % 13 = 0 then null else o_orderstatus end as o_orderstatus,
    case when o_orderkey % 9 = 0 then null else o_totalprice end as o_totalprice,
    cast(o_orderdate as date) as o_orderdate,
    case when o_orderkey % 7 = 0 then '  ' when o_orderkey % 7 = 1 then ''
         when o_orderkey % 7 = 2 then 'null' when o_orderkey % 7 = 3 then ' ' || o_orderpriority
         else o_orderpriority end as o_orderpriority from orders)"""


def orders(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(k % 13 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 9 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
        F.when(k % 7 == 0, "  ")
        .when(k % 7 == 1, "")
        .when(k % 7 == 2, "null")
        .when(k % 7 == 3, F.concat(F.lit(" "), F.col("o_orderpriority")))
        .otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"),
    )


# Parts with a text column that mixes numbers, near-numbers and words.
PART = """(select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice,
    case p_partkey % 8 when 0 then cast(p_retailprice as varchar) when 1 then '1,' || cast(p_size + 100 as varchar)
        when 2 then ' ' || cast(p_size as varchar) || ' ' when 3 then cast(p_size as varchar) || 'e2'
        when 4 then 'A-' || cast(p_size as varchar) when 5 then '' when 6 then null
        else p_type end as p_code from part)"""


def part(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    return table(spark, sf, "part").withColumn(
        "p_code",
        F.when(k == 0, F.col("p_retailprice").cast("string"))
        .when(k == 1, F.concat(F.lit("1,"), (F.col("p_size") + 100).cast("string")))
        .when(k == 2, F.concat(F.lit(" "), size, F.lit(" ")))
        .when(k == 3, F.concat(size, F.lit("e2")))
        .when(k == 4, F.concat(F.lit("A-"), size))
        .when(k == 5, F.lit(""))
        .when(k == 6, F.lit(None))
        .otherwise(F.col("p_type")),
    )


STRICT = (
    "(case when regexp_matches(trim({0}), "
    "'(?i)^[+-]?([0-9]+[.]?[0-9]*(e[+-]?[0-9]+)?|[.][0-9]+(e[+-]?[0-9]+)?|inf(inity)?)$') "
    "then try_cast(trim({0}) as double) end)"
)
LOOSE = "(try_cast(regexp_replace({0}, '[^0-9.-]', '', 'g') as double))"

# Customers with every tenth row twice: the copy has a new key and, for some, gaps.
PEOPLE = """(select c_custkey * 2 as record_seq, c_name as company_name, c_mktsegment as job_title,
      c_nationkey, case when c_custkey % 20 = 0 then null else c_acctbal end as c_acctbal from customer
    union all
    select c_custkey * 2 + 1, case when c_custkey % 30 = 0 then upper(c_name) || ' ' else c_name end,
      c_mktsegment, c_nationkey, c_acctbal from customer where c_custkey % 10 = 0)"""


def people(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    first = c.select(
        (k * 2).alias("record_seq"),
        F.col("c_name").alias("company_name"),
        F.col("c_mktsegment").alias("job_title"),
        "c_nationkey",
        F.when(k % 20 != 0, F.col("c_acctbal")).alias("c_acctbal"),
    )
    copies = c.where(k % 10 == 0).select(
        (k * 2 + 1).alias("record_seq"),
        F.when(k % 30 == 0, F.concat(F.upper("c_name"), F.lit(" ")))
        .otherwise(F.col("c_name"))
        .alias("company_name"),
        F.col("c_mktsegment").alias("job_title"),
        "c_nationkey",
        "c_acctbal",
    )
    return first.unionByName(copies)
