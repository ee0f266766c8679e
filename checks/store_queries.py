"""Checks of versions and sinks: written to the shared folder, read back, compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablewise.operators.changes import clean_version, merge_version, restore_version, transform_version
from tablewise.scale import shared_folder
from tablewise.sources import VersionStore, export_csv, export_json, export_latest

from .inputs import ORDERS, orders
from .record_queries import _EXPORTED, _GAPS, _MERGED, _links, _mapping, exported, gaps
from .registry import query


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _store(spark, sf) -> VersionStore:
    store = VersionStore(spark, _folder(spark, "store"))
    store.snapshot(orders(spark, sf), "collect", "first rows")
    return store


@query("version_read", f"select * from {ORDERS}")
def version_read(spark, sf):
    store = _store(spark, sf)
    clean_version(store, "drop_missing_required", {"field_name": "o_orderstatus"}, "o_orderkey")
    return store.read(1)


@query("version_clean", f"select * from {ORDERS} where o_orderstatus is not null")
def version_clean(spark, sf):
    store = _store(spark, sf)
    return clean_version(store, "drop_missing_required", {"field_name": "o_orderstatus"}, "o_orderkey").table


@query("version_restore", f"select * from {ORDERS}")
def version_restore(spark, sf):
    store = _store(spark, sf)
    clean_version(store, "drop_missing_required", {"field_name": "o_orderstatus"}, "o_orderkey")
    return restore_version(store, 1).table


@query(
    "version_log",
    f"""select cast(3 as bigint) as version, 'restore' as change_type, count(*) as row_count from {ORDERS}
        union all select 2, 'filter_records', count(*) from {ORDERS} where o_totalprice > 100000
        union all select 1, 'collect', count(*) from {ORDERS}""",
)
def version_log(spark, sf):
    store = _store(spark, sf)
    config = {"filter_field": "o_totalprice", "operator": ">", "value": 100000}
    transform_version(store, "filter_records", config, "o_orderkey")
    restore_version(store, 1)
    return store.list_versions().select("version", "change_type", "row_count")


@query(
    "version_history",
    f"""select cast(2 as bigint) as version, 'filter_records' as operation, count(*) as records_affected
        from {ORDERS} where coalesce(o_totalprice, 0) <= 100000""",
)
def version_history(spark, sf):
    store = _store(spark, sf)
    config = {"filter_field": "o_totalprice", "operator": ">", "value": 100000}
    transform_version(store, "filter_records", config, "o_orderkey")
    return store.history().select("version", "operation", "records_affected")


@query(
    "version_profile",
    f"""select c as column_name, n as non_null_count, u as unique_count from (
        select 'o_orderkey' as c, count(o_orderkey) as n, count(distinct o_orderkey) as u from {ORDERS} where o_orderstatus is not null
        union all select 'o_custkey', count(o_custkey), count(distinct o_custkey) from {ORDERS} where o_orderstatus is not null
        union all select 'o_orderstatus', count(o_orderstatus), count(distinct o_orderstatus) from {ORDERS} where o_orderstatus is not null
        union all select 'o_totalprice', count(o_totalprice), count(distinct o_totalprice) from {ORDERS} where o_orderstatus is not null)""",
)
def version_profile(spark, sf):
    """The profile stored with a cleaned version."""
    done = clean_version(_store(spark, sf), "drop_missing_required", {"field_name": "o_orderstatus"}, "o_orderkey")
    wanted = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    return done.profile.where(F.col("column_name").isin(wanted)).select("column_name", "non_null_count", "unique_count")


def _merged(spark, sf):
    store = VersionStore(spark, _folder(spark, "merge"))
    store.snapshot(gaps(spark, sf), "collect", "first rows")
    return merge_version(store, _mapping(spark, sf), _links(spark, sf), "record_id", "record_id")


@query(
    "merge_version_rows",
    f"""with t as (select g.*, coalesce(retained_id, g.record_id) as keep from {_GAPS} g left join {_MERGED} m on m.record_id = g.record_id)
        select keep as record_id, coalesce(first(note order by record_id) filter (where note <> ''), max(note) filter (where note = '')) as note,
          first(price order by record_id) filter (where price is not null) as price,
          cast(case when count(*) = 1 then max(source_count) else sum(case when source_count = 0 then 1 else source_count end) end as integer) as source_count
        from t group by keep""",
)
def merge_version_rows(spark, sf):
    return _merged(spark, sf).table.select("record_id", "note", "price", "source_count")


@query(
    "merge_version_links",
    f"""select coalesce(retained_id, l_orderkey) as dataset_record_id, l_suppkey as data_source_id, l_linenumber, l_extendedprice
        from lineitem left join {_MERGED} on record_id = l_orderkey""",
)
def merge_version_links(spark, sf):
    return _merged(spark, sf).links


@query(
    "merge_version_history",
    f"""select keep as retained_id, h.record_id from (
        select retained_id as keep, record_id from {_MERGED} union all select distinct retained_id, retained_id from {_MERGED}) h
        join orders on o_orderkey = h.record_id""",
)
def merge_version_history(spark, sf):
    return _merged(spark, sf).history.select("retained_id", "record_id")


@query(
    "export_csv_file",
    f"""select cast(c_custkey as varchar) as c_custkey, case when c_name like '=%' then '''' || c_name else c_name end as c_name,
        validation_status, cast(source_count as varchar) as source_count from {_EXPORTED} where validation_status = 'valid'""",
)
def export_csv_file(spark, sf):
    path = _folder(spark, "csv")
    export_csv(exported(spark, sf), path, warnings=True, status="valid")
    return spark.read.csv(path, header=True, escape='"')


@query(
    "export_json_file",
    f"""select c_custkey, c_name, cast(source_count as bigint) as source_count, validation_status from {_EXPORTED}""",
)
def export_json_file(spark, sf):
    path = _folder(spark, "json")
    export_json(exported(spark, sf), path)
    back = spark.read.json(path)
    return back.select(
        "c_custkey", "c_name", F.col("_provenance.source_count").alias("source_count"),
        F.col("_provenance.validation_status").alias("validation_status"),
    )


@query(
    "export_latest_file",
    f"""select o_orderkey, o_custkey from {ORDERS} order by o_orderdate desc, o_orderkey""",
)
def export_latest_file(spark, sf):
    path = _folder(spark, "latest")
    df = orders(spark, sf).withColumns({"record_id": F.col("o_orderkey"), "created_at": F.col("o_orderdate")})
    export_latest(df, path, "json")
    return spark.read.json(path).select("o_orderkey", "o_custkey")
