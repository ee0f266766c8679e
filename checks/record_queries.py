"""Checks of tables, sources, duplicates, ingest and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.functions.html import canonical_link
from tablewise.operators import compare, dedup, tables
from tablewise.operators.ingest import complete_evidence, ingest, split_rejected, validate
from tablewise.operators.profile import Field, quality_scores
from tablewise.sources import build_sources, discover, envelope, scan_records, tabulate
from tablewise.sources.export import by_status, csv_rows, json_rows, latest_rows

from .inputs import ORDERS, PEOPLE, customer, orders, people
from .registry import query, table

# -- scans and sinks ------------------------------------------------------------


@query("scan_records", "select doc_id, lang, source, n_chars from documents where source = 'src3'")
def scan_one_dataset(spark, sf):
    out = scan_records(spark, f"{sf}/documents.parquet", "src3", dataset_column="source")
    return out.select("doc_id", "lang", "source", "n_chars")


@query(
    "tabulate_events",
    """select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(null as varchar) as absent from events""",
)
def tabulate_events(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.col("props").alias("record_data"))
    return tabulate(df, {"k": "long", "absent": "string"}).select("event_id", "k", "absent")


@query(
    "tabulate_fallback",
    """select event_id, case when event_id % 3 <> 2 then cast(json_extract(props, '$.k') as bigint) end as k from events""",
)
def tabulate_fallback(spark, sf):
    """Fields found in the data; the normalised record stands in for a missing one."""
    k = F.col("event_id") % 3
    df = table(spark, sf, "events").select(
        "event_id",
        F.when(k == 0, F.col("props")).alias("record_data"),
        F.when(k == 1, F.col("props")).alias("normalized_data"),
    )
    return tabulate(df).select("event_id", "k")


@query(
    "envelope_round_trip",
    "select o_orderkey as record_id, o_custkey, o_orderstatus, o_totalprice from orders",
)
def envelope_round_trip(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("record_id"), "o_custkey", "o_orderstatus", "o_totalprice"
    )
    return tabulate(envelope(df)).select("record_id", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double"))


_EXPORTED = """(select c_custkey, case when c_custkey % 3 = 0 then '=' || c_name when c_custkey % 3 = 1 then null else c_name end as c_name,
    case when c_custkey % 4 = 0 then 'invalid' else 'valid' end as validation_status, cast(c_custkey % 5 as integer) as source_count
    from customer)"""


def exported(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(k % 3 == 0, F.concat(F.lit("="), F.col("c_name"))).when(k % 3 == 1, F.lit(None)).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 4 == 0, "invalid").otherwise("valid").alias("validation_status"),
        (k % 5).cast("int").alias("source_count"),
    )


@query(
    "export_csv_rows",
    f"""select cast(c_custkey as varchar) as c_custkey, case when c_name like '=%' then '''' || c_name else coalesce(c_name, '') end as c_name,
        validation_status, cast(source_count as varchar) as source_count from {_EXPORTED}""",
)
def export_csv_rows(spark, sf):
    return csv_rows(exported(spark, sf), warnings=True)


@query(
    "export_csv_columns",
    f"""select case when c_name like '=%' then '''' || c_name else coalesce(c_name, '') end as c_name, '' as unknown
        from {_EXPORTED} where validation_status = 'valid'""",
)
def export_csv_columns(spark, sf):
    return csv_rows(by_status(exported(spark, sf), "valid"), ["c_name", "unknown"], provenance=False)


@query(
    "export_json_rows",
    f"""select c_custkey, c_name, source_count, validation_status, cast(null as varchar) as record_hash from {_EXPORTED}""",
)
def export_json_rows(spark, sf):
    out = json_rows(exported(spark, sf))
    return out.select("c_custkey", "c_name", "_provenance.*")


@query(
    "export_latest_rows",
    "select o_orderkey as record_id, o_custkey from orders order by o_orderdate desc, o_orderkey",
)
def export_latest_rows(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("record_id"), "o_custkey", F.col("o_orderdate").alias("created_at")
    )
    return latest_rows(df).select("record_id", "o_custkey")


_LINKS = (
    ('<link rel="canonical" href="{}">', True),
    ("<LINK HREF='{}' REL='Canonical'/>", True),
    ('<link href={} rel=canonical>', True),
    ('<link rel="alternate" href="x"><link type="a>b" rel="nofollow canonical" href = "{}" >', True),
    ('<!-- <link rel="canonical" href="{}"> -->', False),
    ('<link rel="canonical"><link title="rel=canonical" href="{}">', False),
    ('<script>var t = \'<link rel="canonical" href="{}">\';</script>', False),
    ('<a rel="canonical" href="{}">canonical</a>', False),
)


@query(
    "canonical_links",
    f"""select page_id, case when page_id % {len(_LINKS)} in ({', '.join(str(i) for i, (_, found) in enumerate(_LINKS) if found)})
        then 'https://canon.example/' || page_id || '?a=1&b=2' end as canonical from pages""",
)
def canonical_links(spark, sf):
    """The pages with a link put into each, in every order and quoting."""
    k = F.col("page_id")
    mark = F.lit("")
    for i, (form, _) in enumerate(_LINKS):
        before, _, after = form.partition("{}")
        target = F.concat(F.lit("https://canon.example/"), k.cast("string"), F.lit("?a=1&amp;b=2"))
        mark = F.when(k % len(_LINKS) == i, F.concat(F.lit(before), target, F.lit(after))).otherwise(mark)
    return table(spark, sf, "pages").select("page_id", canonical_link(F.concat(mark, F.coalesce("html", F.lit("")))).alias("canonical"))


@query(
    "build_sources",
    r"""select page_id, source_url, canonical_url, domain, page_title, 'web' as source_type, retrieval_status, content_hash from (
        select page_id, u as source_url, u as canonical_url, lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)) as domain,
          case when ok then coalesce(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), 'Extracted Page') else 'Blocked URL' end as page_title,
          case when ok then 'retrieved' else 'blocked' end as retrieval_status,
          case when ok and html <> '' then sha256(html) end as content_hash
        from (select page_id, html, page_id % 5 <> 0 as ok, case when page_id % 5 = 0 then 'http://127.0.0.1:' || page_id || '/' else url end as u
              from pages))""",
)
def build_sources_of_pages(spark, sf):
    k = F.col("page_id")
    pages = table(spark, sf, "pages").withColumn(
        "url", F.when(k % 5 == 0, F.concat(F.lit("http://127.0.0.1:"), k.cast("string"), F.lit("/"))).otherwise(F.col("url"))
    )
    return build_sources(pages).drop("error_message")


_HITS = """(select cast(user_id % 20 + 1 as integer) as query_pos, cast(event_id % 12 + 1 as integer) as hit_pos,
    'https://example.org/' || cast(floor(value) as integer) as url, event_id from events)"""


@query(
    "discover",
    f"""select url, query_pos, hit_pos, event_id from (
        select *, row_number() over (partition by url order by query_pos, hit_pos, event_id) as r
        from {_HITS}) where r = 1 order by query_pos, hit_pos, url""",
)
def discover_hits(spark, sf):
    hits = table(spark, sf, "events").select(
        (F.col("user_id") % 20 + 1).cast("int").alias("query_pos"),
        (F.col("event_id") % 12 + 1).cast("int").alias("hit_pos"),
        F.concat(F.lit("https://example.org/"), F.floor("value").cast("int").cast("string")).alias("url"),
        "event_id",
    )
    # Two hits may share a place in this made input; the event decides.
    first = hits.groupBy("query_pos", "hit_pos", "url").agg(F.min("event_id").alias("event_id"))
    return discover(first)


# -- listing and catalogue --------------------------------------------------------


def _listed(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("record_id"),
        "o_custkey",
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "P", "invalid").otherwise("valid").alias("validation_status"),
        F.col("o_orderdate").alias("created_at"),
    )


@query(
    "list_records",
    """select o_orderkey as record_id, o_orderpriority from orders where o_orderstatus <> 'P' and lower(o_orderpriority) like '%urgent%'
       order by o_orderdate desc, o_orderkey limit 50 offset 50""",
)
def list_records(spark, sf):
    out = tables.list_records(_listed(spark, sf), "valid", "URGENT", 2, 50).rows
    return out.select("record_id", "o_orderpriority")


@query(
    "list_records_total",
    """select count(*) as total, cast(greatest(1, ceil(count(*) / 50.0)) as bigint) as pages from orders
       where o_orderstatus <> 'P' and lower(o_orderpriority) like '%urgent%'""",
)
def list_records_total(spark, sf):
    return tables.list_records(_listed(spark, sf), "valid", "URGENT", 2, 50).total


@query("seek_records", "select o_orderkey from orders where o_orderkey > 700 order by o_orderkey limit 60")
def seek_records(spark, sf):
    return tables.seek(table(spark, sf, "orders"), "o_orderkey", 700, 60).select("o_orderkey")


@query(
    "list_sources",
    """select page_id from (select page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as domain from pages)
       where domain = (select lower(regexp_extract(min(url), '^[A-Za-z]+://([^/?#]*)', 1)) from pages) order by page_id desc limit 50""",
)
def list_sources(spark, sf):
    pages = table(spark, sf, "pages")
    sources = build_sources(pages).withColumn("created_at", F.timestamp_seconds("page_id"))
    first = build_sources(pages.orderBy("url").limit(1)).first()["domain"]
    return tables.list_sources(sources, first, "retrieved", tie="page_id").rows.select("page_id")


@query(
    "search_catalog",
    """select s_suppkey as id, s_name as name, s_nationkey as status from supplier
       where s_nationkey = 9 and (s_name ilike '%supplier#0000000%') order by s_suppkey limit 20""",
)
def search_catalog(spark, sf):
    df = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("description"),
        F.col("s_nationkey").alias("status"), F.timestamp_seconds(F.lit(0)).alias("created_at"),
    )
    found = tables.search_catalog(df, "SUPPLIER#0000000", ["name", "description"], {"status": 9})
    return found.rows.select("id", "name", "status")


# -- joins --------------------------------------------------------------------------
# Orders stand for records, customers for datasets, nations for owners, line items
# for evidence links and suppliers for sources.


def _records(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("dataset_id"), "o_totalprice"
    )


def _datasets(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("dataset_id"), F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("name")
    )


def _links(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("dataset_record_id"), F.col("l_suppkey").alias("data_source_id"), "l_linenumber", "l_extendedprice"
    )


def _sources(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("data_source_id"), F.col("s_name").alias("source_url"),
        F.lit("example.org").alias("domain"), F.lit("A page").alias("page_title"),
    )


@query(
    "record_provenance",
    """select l_orderkey as dataset_record_id, l_suppkey as data_source_id, l_linenumber, s_name as source_url from lineitem
       join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
       where l_orderkey = (select min(l_orderkey) from lineitem)
         and c_nationkey = (select c_nationkey from customer join orders on o_custkey = c_custkey where o_orderkey = (select min(l_orderkey) from lineitem))""",
)
def record_provenance(spark, sf):
    links, records, datasets = _links(spark, sf), _records(spark, sf), _datasets(spark, sf)
    wanted = links.agg(F.min("dataset_record_id")).first()[0]
    owner = records.where(F.col("record_id") == wanted).join(datasets, "dataset_id").first()["user_id"]
    out = tables.record_provenance(links, records, datasets, _sources(spark, sf), wanted, owner)
    return out.select("dataset_record_id", "data_source_id", "l_linenumber", "source_url")


@query(
    "count_links",
    "select o_custkey as dataset_id, count(*) as links from lineitem join orders on o_orderkey = l_orderkey group by 1",
)
def count_links(spark, sf):
    return tables.count_links(_links(spark, sf), _records(spark, sf))


@query(
    "job_plan_dataset",
    """select o_orderkey as record_id, o_custkey as dataset_id, c_name as dataset_name, n_name as owner_name from orders
       join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey""",
)
def job_plan_dataset(spark, sf):
    """Each job with the names of its dataset and owner."""
    nations = table(spark, sf, "nation")
    one = tables.with_parent_name(
        _records(spark, sf).select("record_id", "dataset_id"), _datasets(spark, sf), "dataset_id", "name", "dataset_name", "record_id"
    )
    two = one.join(_datasets(spark, sf).select("dataset_id", F.col("user_id").alias("n_nationkey")), "dataset_id")
    out = tables.with_parent_name(two, nations, "n_nationkey", "n_name", "owner_name", "record_id")
    return out.select("record_id", "dataset_id", "dataset_name", "owner_name")


@query(
    "scoped_records",
    "select o_orderkey as record_id, o_custkey as dataset_id, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_nationkey = 7)",
)
def scoped_records(spark, sf):
    return tables.scoped(_records(spark, sf), _datasets(spark, sf), 7).select("record_id", "dataset_id", "o_totalprice")


@query(
    "parent_name",
    """select c_custkey, c_name, n_name as project from customer left join nation on n_nationkey = c_nationkey and n_nationkey < 20""",
)
def parent_name(spark, sf):
    nations = table(spark, sf, "nation").where("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey")
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return tables.with_parent_name(df, nations, "c_nationkey", "n_name", "project", "c_custkey").drop("c_nationkey")


@query(
    "parent_name_spread",
    """select l_orderkey, l_linenumber, l_suppkey as data_source_id, l_extendedprice, s_name as source_url from lineitem join supplier on s_suppkey = l_suppkey""",
)
def parent_name_spread(spark, sf):
    """The join with hot keys split, forced on a small table."""
    out = tables.with_parent_name(
        _links(spark, sf), _sources(spark, sf), "data_source_id", "source_url", "source_url", "l_extendedprice", hot_rows=100
    )
    return out.select(F.col("dataset_record_id").alias("l_orderkey"), "l_linenumber", "data_source_id", "l_extendedprice", "source_url")


_MERGED = "(select o_orderkey as record_id, o_orderkey - o_orderkey % 10 as retained_id from orders where o_orderkey % 10 in (1, 2))"


def _mapping(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").where((k % 10).isin(1, 2)).select(k.alias("record_id"), (k - k % 10).alias("retained_id"))


@query(
    "relink_evidence",
    f"""select coalesce(retained_id, l_orderkey) as dataset_record_id, l_suppkey as data_source_id, l_linenumber, l_extendedprice
        from lineitem left join {_MERGED} on record_id = l_orderkey""",
)
def relink_evidence(spark, sf):
    return tables.relink(_links(spark, sf), _mapping(spark, sf), "l_extendedprice")


@query("delete_records", "select o_orderkey as record_id, o_custkey as dataset_id, o_totalprice from orders where o_orderkey % 10 not in (1, 2)")
def delete_records(spark, sf):
    return tables.delete_records(_records(spark, sf), _mapping(spark, sf).select("record_id"), "record_id").select(
        "record_id", "dataset_id", "o_totalprice"
    )


@query(
    "delete_records_scoped",
    "select o_orderkey as record_id, o_custkey as dataset_id, o_totalprice from orders where not (o_orderkey % 10 in (1, 2) and o_custkey = 7)",
)
def delete_records_scoped(spark, sf):
    out = tables.delete_records(_records(spark, sf), _mapping(spark, sf).select("record_id"), "record_id", 7)
    return out.select("record_id", "dataset_id", "o_totalprice")


@query(
    "update_records",
    """select c_custkey, case when c_custkey % 10 = 3 then 'NEW' else c_mktsegment end as c_mktsegment,
       case when c_custkey % 10 = 3 then sha256('{"c_mktsegment":"NEW"}') else 'old' end as content_hash from customer""",
)
def update_records(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.lit("old").alias("content_hash"))
    ids = table(spark, sf, "customer").where("c_custkey % 10 = 3").select("c_custkey")
    return tables.update_records(df, ids, {"c_mktsegment": "NEW"}, "c_custkey").select("c_custkey", "c_mktsegment", "content_hash")


# -- overviews ----------------------------------------------------------------------


@query(
    "dataset_overview",
    """select c_custkey as dataset_id, count(o_orderkey) as total_records, count(*) filter (where o_orderstatus = 'O') as valid_records,
         count(*) filter (where o_orderstatus = 'P') as records_with_warnings, count(*) filter (where o_orderstatus = 'F') as rejected_records,
         coalesce((select count(*) from events where user_id = c_custkey), 0) as source_count,
         greatest(coalesce((select count(*) from events where user_id = c_custkey), 0) - count(o_orderkey), 0) as duplicate_count,
         (select arg_max(event_type, ts) from events where user_id = c_custkey) as latest_job_status
       from customer left join orders on o_custkey = c_custkey group by c_custkey
       having count(o_orderkey) > 0 or exists (select 1 from events where user_id = c_custkey)""",
)
def dataset_overview(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "valid").when(F.col("o_orderstatus") == "P", "valid_with_warnings").otherwise("invalid")
    records = table(spark, sf, "orders").select(F.col("o_custkey").alias("dataset_id"), status.alias("validation_status"))
    events = table(spark, sf, "events")
    sources = events.select(F.col("user_id").alias("dataset_id"))
    jobs = events.select(F.col("user_id").alias("dataset_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("dataset_id"))
    return tables.dataset_overview(records, sources, jobs).join(customers, "dataset_id", "left_semi")


def _owned(spark, sf):
    c = table(spark, sf, "customer")
    mod = F.col("c_custkey") % 3
    return c.select(
        F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 2).alias("user_id"), F.col("c_mktsegment").alias("status"),
        F.when(mod != 0, F.col("c_custkey")).alias("row_count"), F.timestamp_seconds(F.col("c_custkey")).alias("created_at"),
    )


@query(
    "dashboard_totals",
    """with d as (select * from customer where c_nationkey % 2 = 1), s as (select * from supplier where s_nationkey % 2 = 1)
       select 'total_rows' as metric, coalesce(cast(sum(case when c_custkey % 3 <> 0 then c_custkey end) as bigint), 0) as value from d
       union all select 'projects', count(*) from s union all select 'projects:active', count(*) from s having count(*) > 0
       union all select 'datasets', count(*) from d union all select 'datasets:' || c_mktsegment, count(*) from d group by c_mktsegment
       union all select 'runs', count(*) from d union all select 'runs:' || c_mktsegment, count(*) from d group by c_mktsegment""",
)
def dashboard_totals(spark, sf):
    projects = table(spark, sf, "supplier").select((F.col("s_nationkey") % 2).alias("user_id"), F.lit("active").alias("status"))
    owned = _owned(spark, sf)
    return tables.dashboard_totals(projects, owned, owned, 1)


@query(
    "dashboard_recent",
    "select c_custkey as id, c_mktsegment as status from customer where c_nationkey % 2 = 1 order by c_custkey desc limit 5",
)
def dashboard_recent(spark, sf):
    return tables.recent(_owned(spark, sf), 1, "id").select("id", "status")


@query("child_counts", "select c_nationkey, count(*) as children from customer group by 1")
def child_counts(spark, sf):
    return tables.child_counts(table(spark, sf, "customer"), "c_nationkey")


@query(
    "latest_per_parent",
    """select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1""",
)
def latest_per_parent(spark, sf):
    return tables.latest_per(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("transformation_history", "select event_id, event_type as operation from events order by ts desc, event_id desc")
def transformation_history(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("event_id").alias("entry_id"), F.col("event_type").alias("operation"), F.col("ts").alias("created_at")
    )
    return tables.transformation_history(log).select(F.col("entry_id").alias("event_id"), "operation")


# -- duplicates ---------------------------------------------------------------------

_SEQ = "row_number() over (partition by k order by record_seq)"


@query(
    "dedup_ingest",
    f"""select min(record_seq) as record_seq, first(company_name order by record_seq) as company_name, first(job_title order by record_seq) as job_title,
        first(c_acctbal order by record_seq) filter (where c_acctbal is not null) as c_acctbal, count(*) as copies
        from (select *, lower(trim(company_name)) || '|' || lower(trim(job_title)) as k from {PEOPLE}) group by k""",
)
def dedup_ingest(spark, sf):
    out = dedup.dedup_ingest(people(spark, sf), "record_seq")
    return out.select("record_seq", "company_name", "job_title", "c_acctbal", "copies")


@query(
    "dedup_counts",
    f"""select count(*) as records, count(distinct k) as unique_records, count(*) - count(distinct k) as duplicates
        from (select lower(trim(company_name)) || '|' || lower(trim(job_title)) as k from {PEOPLE})""",
)
def dedup_counts(spark, sf):
    df = people(spark, sf)
    return dedup.dedup_counts(df, ["company_name", "job_title"], df.columns)


# Pages with copies of three kinds: whole record, same URL, same name and place.
_COPIED = """(select page_id * 10 as record_id, url, 'Page ' || page_id as name, 'Town ' || page_id % 7 as location, length(html) as size from pages
    union all select page_id * 10 + 1, url, 'Page ' || page_id, 'Town ' || page_id % 7, length(html) from pages where page_id % 5 = 0
    union all select page_id * 10 + 2, upper(url) || '/', 'Other ' || page_id, 'X', length(html) + 1 from pages where page_id % 3 = 0
    union all select page_id * 10 + 3, 'short', 'PAGE ' || page_id || ' ', 'Town ' || page_id % 7, 0 from pages where page_id % 2 = 0
    union all select 100000000 + page_id, 'https://hot.example.org/', 'Hot', 'Spot', 1 from pages
    union all select 200000000 + page_id, 'https://hot.example.org/', 'Warm', 'Spot', page_id from pages)"""


def copied(spark, sf):
    p = table(spark, sf, "pages")
    k, s = F.col("page_id"), F.col("page_id").cast("string")
    town = F.concat(F.lit("Town "), (k % 7).cast("string"))
    size = F.length("html")

    def rows(df, record_id, url, name, location, size):
        return df.select(
            record_id.alias("record_id"), url.alias("url"), name.alias("name"), location.alias("location"), size.cast("long").alias("size")
        )

    page = F.concat(F.lit("Page "), s)
    hot = F.lit("https://hot.example.org/")
    return (
        rows(p, k * 10, F.col("url"), page, town, size)
        .unionByName(rows(p.where(k % 5 == 0), k * 10 + 1, F.col("url"), page, town, size))
        .unionByName(rows(p.where(k % 3 == 0), k * 10 + 2, F.concat(F.upper("url"), F.lit("/")), F.concat(F.lit("Other "), s), F.lit("X"), size + 1))
        .unionByName(rows(p.where(k % 2 == 0), k * 10 + 3, F.lit("short"), F.concat(F.lit("PAGE "), s, F.lit(" ")), town, F.lit(0)))
        .unionByName(rows(p, k + 100000000, hot, F.lit("Hot"), F.lit("Spot"), F.lit(1)))
        .unionByName(rows(p, k + 200000000, hot, F.lit("Warm"), F.lit("Spot"), k))
    )


_TIERS = f"""with r as (select *, count(*) over (partition by url, name, location, size) as n1 from {_COPIED}),
    r2 as (select *, case when length(trim(url)) > 8 then regexp_replace(lower(trim(url)), '/+$', '') end as u from r where n1 = 1),
    t2 as (select *, case when u is not null then count(*) over (partition by u) else 1 end as n2 from r2),
    r3 as (select *, lower(trim(name)) || '::' || lower(trim(location)) as k from t2 where n2 = 1),
    t3 as (select *, case when length(trim(name)) > 2 and length(trim(location)) > 2 then count(*) over (partition by k) else 1 end as n3 from r3),
    m as (select 'exact_hash' as rule_type, '_record_hash' as match_field, 1.0::double as confidence, h as g, 'hash_' || left(h, 12) as gid, record_id
            from (select *, sha256('{{"location":"' || location || '","name":"' || name || '","size":' || size || ',"url":"' || url || '"}}') as h from r) where n1 > 1
          union all select 'canonical_url', 'url', 0.95, u, 'url_' || left(md5(u), 10), record_id from t2 where n2 > 1
          union all select 'composite_key', 'name+location', 0.9, k, 'comp_' || left(md5(k), 10), record_id from t3 where n3 > 1)"""


@query(
    "duplicate_members",
    _TIERS + " select rule_type, match_field, confidence, gid as group_id, g as match_value, record_id from m",
)
def duplicate_members(spark, sf):
    return dedup.duplicate_members(copied(spark, sf), "record_id")


@query(
    "duplicate_members_spread",
    _TIERS + " select rule_type, match_field, confidence, gid as group_id, g as match_value, record_id from m",
)
def duplicate_members_spread(spark, sf):
    """Hot keys split, forced on a small table."""
    return dedup.duplicate_members(copied(spark, sf), "record_id", hot_rows=50)


@query(
    "duplicate_groups",
    _TIERS + """ select gid as group_id, rule_type, match_field, g as match_value, confidence, count(*) as record_count,
      min(record_id) as first_record_id from m group by rule_type, match_field, confidence, g, gid""",
)
def duplicate_groups(spark, sf):
    members = dedup.duplicate_members(copied(spark, sf), "record_id")
    return dedup.duplicate_groups(members)


@query(
    "exact_hash_ids",
    """with h as (select c_custkey, c_nationkey, sha256('{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}') as h from customer),
       n as (select h, count(*) as n from h group by 1 having count(*) > 1)
       select c_custkey as record_id, 'hash_' || left(h.h, 12) as group_id, h.h as match_value from h join n on n.h = h.h""",
)
def exact_hash_ids(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return dedup.duplicate_members(df, "c_custkey").select("record_id", "group_id", "match_value")


_GAPS = """(select o_orderkey as record_id, case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then null else o_orderpriority end as note,
    case when o_orderkey % 10 = 0 then null else o_totalprice end as price, cast(o_orderkey % 3 as integer) as source_count from orders)"""


def gaps(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("record_id"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("note"),
        F.when(k % 10 != 0, F.col("o_totalprice")).alias("price"),
        (k % 3).cast("int").alias("source_count"),
    )


@query(
    "merge_groups",
    f"""with t as (select g.*, coalesce(retained_id, g.record_id) as keep from {_GAPS} g left join {_MERGED} m on m.record_id = g.record_id)
        select keep as record_id, coalesce(first(note order by record_id) filter (where note <> ''), max(note) filter (where note = '')) as note,
          case when keep = 20 then -1.0 else first(price order by record_id) filter (where price is not null) end as price,
          cast(case when count(*) = 1 then max(source_count) else sum(case when source_count = 0 then 1 else source_count end) end as integer) as source_count
        from t group by keep""",
)
def merge_groups(spark, sf):
    out = dedup.merge_groups(gaps(spark, sf), _mapping(spark, sf), "record_id", "record_id", {20: {"price": -1.0}})
    return out.select("record_id", "note", "price", "source_count")


@query(
    "merge_history",
    f"""select keep as retained_id, h.record_id,
          '{{' || concat_ws(',', '"note":"' || note || '"', '"price":' || cast(price as varchar)) || '}}' as original from (
        select retained_id as keep, record_id from {_MERGED} union all select distinct retained_id, retained_id from {_MERGED}) h
        join {_GAPS} g on g.record_id = h.record_id""",
)
def merge_history(spark, sf):
    return dedup.merge_history(gaps(spark, sf), _mapping(spark, sf), "record_id")


@query(
    "merge_mapping",
    f"""with k as (select *, lower(trim(company_name)) || '::' || lower(trim(job_title)) as k from {PEOPLE})
        select record_seq as record_id, f as retained_id from (select record_seq, min(record_seq) over (partition by k) as f from k) where record_seq <> f""",
)
def merge_mapping(spark, sf):
    """Clusters by name and segment; the first record stays."""
    df = people(spark, sf).select("record_seq", "company_name", "job_title")
    return dedup.first_as_retained(dedup.duplicate_members(df, "record_seq"))


# -- validation and ingest ------------------------------------------------------------

_CANDIDATES = """(select page_id, case when page_id % 9 = 0 then '  ' else 'Page  ' || page_id % 40 end as company_name,
    case page_id % 4 when 0 then 'www.Example.org/a/?utm_source=x' when 1 then url when 2 then 'https:///x' else null end as website,
    case page_id % 5 when 0 then 'n/a' when 1 then '$1,250.50' else cast(page_id as varchar) end as salary,
    case page_id % 3 when 0 then 'Me@Example.org' when 1 then 'nobody' else null end as contact,
    case page_id % 4 when 0 then 'yes' when 1 then 'no' else 'perhaps' end as remote,
    'a, b,, c' || page_id % 2 as tags, url as source_url, 'Title ' || page_id as page_title, 'example.org' as domain from pages)"""

FIELDS = [
    Field("company_name", "string", True),
    Field("website", "url"),
    Field("salary", "number"),
    Field("contact", "email"),
    Field("remote", "boolean"),
    Field("tags", "array"),
    Field("missing", "string"),
]


def candidates(spark, sf):
    k, s = F.col("page_id"), F.col("page_id").cast("string")
    return table(spark, sf, "pages").select(
        "page_id",
        F.when(k % 9 == 0, "  ").otherwise(F.concat(F.lit("Page  "), (k % 40).cast("string"))).alias("Company_Name"),
        F.when(k % 4 == 0, "www.Example.org/a/?utm_source=x").when(k % 4 == 1, F.col("url")).when(k % 4 == 2, "https:///x").alias("website"),
        F.when(k % 5 == 0, "n/a").when(k % 5 == 1, "$1,250.50").otherwise(s).alias("salary"),
        F.when(k % 3 == 0, "Me@Example.org").when(k % 3 == 1, "nobody").alias("contact"),
        F.when(k % 4 == 0, "yes").when(k % 4 == 1, "no").otherwise("perhaps").alias("remote"),
        F.concat(F.lit("a, b,, c"), (k % 2).cast("string")).alias("tags"),
        F.col("url").alias("source_url"),
        F.concat(F.lit("Title "), s).alias("page_title"),
        F.lit("example.org").alias("domain"),
    )


_VALIDATED = f"""(select page_id, case when trim(company_name) = '' then null else regexp_replace(company_name, '\\s+', ' ', 'g') end as company_name,
    case page_id % 4 when 0 then 'https://www.example.org/a' when 1 then url_ok when 2 then 'https:///x' end as website,
    case page_id % 5 when 0 then null when 1 then 1250.5 else cast(page_id as double) end as salary,
    case page_id % 3 when 0 then 'me@example.org' when 1 then 'nobody' end as contact,
    page_id % 4 <> 1 as remote, 'a|b|c' || page_id % 2 as tags, cast(null as varchar) as missing,
    concat_ws(' ', case when trim(company_name) = '' then 'missing_required_field' end, case when page_id % 4 = 2 then 'invalid_url' end,
      case when page_id % 5 = 0 then 'invalid_number' end, case when page_id % 3 = 1 then 'invalid_email' end) as problems,
    case when trim(company_name) = '' then 'invalid' when page_id % 4 = 2 or page_id % 5 = 0 or page_id % 3 = 1 then 'valid_with_warnings'
      else 'valid' end as validation_status, source_url
    from (select c.*, lower(regexp_extract(source_url, '^([A-Za-z]+://[^/?#]*)', 1))
        || rtrim(regexp_extract(source_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/')
        || case when q <> '' then '?' || q else '' end as url_ok
      from (select *, array_to_string(list_filter(string_split(regexp_extract(source_url, '^[^?#]*\\?([^#]*)', 1), '&'),
          lambda p: p <> '' and p not like 'utm_%'), '&') as q from {_CANDIDATES}) c))"""


@query(
    "validate",
    f"select page_id, company_name, website, salary, contact, remote, tags, missing, problems, validation_status from {_VALIDATED}",
)
def validate_candidates(spark, sf):
    out = validate(candidates(spark, sf), FIELDS)
    return out.select(
        "page_id", "company_name", "website", "salary", "contact", "remote",
        F.array_join("tags", "|").alias("tags"), "missing",
        F.array_join(F.transform("validation_errors", lambda e: e["error_type"]), " ").alias("problems"),
        "validation_status",
    )


@query("validate_rejected", f"select page_id from {_CANDIDATES} where trim(company_name) = ''")
def validate_rejected(spark, sf):
    return split_rejected(validate(candidates(spark, sf), FIELDS))[1].select("page_id")


_KEYED = f"(select *, lower(company_name) || '|' || coalesce(lower(website), '') as k from {_VALIDATED} where validation_status <> 'invalid')"


@query(
    "ingest_records",
    f"""select min(page_id) as page_id, first(company_name order by page_id) as company_name, first(website order by page_id) as website,
        first(salary order by page_id) filter (where salary is not null) as salary,
        first(contact order by page_id) filter (where contact is not null) as contact, count(*) as copies,
        cast(count(distinct source_url) as integer) as source_count from {_KEYED} group by k order by 1""",
)
def ingest_records(spark, sf):
    out = ingest(candidates(spark, sf), FIELDS, "page_id").records
    return out.select("page_id", "company_name", "website", "salary", "contact", "copies", "source_count")


_EVIDENCE = """(select page_id, unnest(['company_name', 'website', 'salary', 'contact', 'remote', 'tags']) as field,
    unnest([company_name, website, salary, contact, remote, tags]) as v, page_title, domain, source_url from {0})""".format(_CANDIDATES)


@query(
    "complete_evidence",
    f"""select page_id, case when lower(field) = 'company_name' then 'given' else field end as evidence_field,
        case when field = 'company_name' then 'quoted' else 'Extracted from ' || page_title || ' on ' || domain end as evidence_excerpt
        from {_EVIDENCE} where v is not null""",
)
def complete_evidence_of_candidates(spark, sf):
    given = F.array(F.struct(F.lit("company_name").alias("field_name"), F.lit("quoted").alias("evidence_excerpt")))
    df = candidates(spark, sf).withColumnRenamed("Company_Name", "company_name").withColumn("evidences", given)
    out = complete_evidence(df, [f.name for f in FIELDS])
    return out.select("page_id", F.explode("evidences").alias("e")).select(
        "page_id",
        F.when(F.col("e.field_name") == "company_name", "given").otherwise(F.col("e.field_name")).alias("evidence_field"),
        F.col("e.evidence_excerpt").alias("evidence_excerpt"),
    )


@query(
    "ingest_links",
    f"""with kept as (select k, min(page_id) as record_id from {_KEYED} group by k),
        c as (select e.*, d.k from {_EVIDENCE} e join {_KEYED} d on d.page_id = e.page_id where v is not null)
        select record_id, c.page_id as candidate_id, field as evidence_field, c.source_url, p.page_id as data_source_id
        from c join kept on kept.k = c.k join pages p on p.url = c.source_url""",
)
def ingest_links(spark, sf):
    sources = table(spark, sf, "pages").select(F.col("page_id").alias("data_source_id"), F.col("url").alias("source_url"))
    raw = candidates(spark, sf).withColumnRenamed("Company_Name", "company_name")
    out = ingest(raw, FIELDS, "page_id", None, sources).links
    return out.select("record_id", "candidate_id", "evidence_field", "source_url", "data_source_id")


@query(
    "ingest_metrics",
    f"""select (select count(*) from {_CANDIDATES}) as records_extracted, (select count(*) from {_CANDIDATES} where trim(company_name) = '') as records_rejected,
        count(distinct k) as unique_records, count(*) - count(distinct k) as duplicates_merged, count(distinct k) as records_saved,
        'completed_with_errors' as status from {_KEYED}""",
)
def ingest_metrics(spark, sf):
    return ingest(candidates(spark, sf), FIELDS, "page_id").metrics


# -- comparison ---------------------------------------------------------------------


def _halves(spark, sf):
    o = orders(spark, sf)
    return o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 <> 1").withColumn("extra", F.lit(1))


_ENVELOPE_KEYS = """a as (select distinct unnest(json_keys(props)) as k from events where event_id % 2 = 0),
       b as (select distinct unnest(json_keys(props)) as k from events where event_id % 2 = 1 union select 'extra')"""


def _envelopes(spark, sf):
    e = table(spark, sf, "events")
    more = F.concat(F.lit('{"extra": 1, '), F.expr("substring(props, 2)"))
    return (
        e.where("event_id % 2 = 0").select(F.parse_json("props").alias("record")),
        e.where("event_id % 2 = 1").select(F.parse_json(more).alias("record")),
    )


@query(
    "schema_similarity",
    f"""with {_ENVELOPE_KEYS}, d as (select a.k is not null as in_a, b.k is not null as in_b from a full join b on a.k = b.k)
       select count(*) filter (where in_a and in_b) as common_columns, count(*) filter (where in_a and not in_b) as a_only_columns,
         count(*) filter (where in_b and not in_a) as b_only_columns,
         round(200.0 * count(*) filter (where in_a and in_b) / greatest(count(*) filter (where in_a) + count(*) filter (where in_b), 1), 1)::double as similarity
       from d""",
)
def schema_similarity(spark, sf):
    """Similarity of the keys that the records of two halves of the events hold."""
    return compare.schema_similarity(compare.envelope_schema_diff(*_envelopes(spark, sf)))


@query(
    "envelope_schema_diff",
    f"""with {_ENVELOPE_KEYS}
       select coalesce(a.k, b.k) as "column", a.k is not null as in_a, b.k is not null as in_b from a full join b on a.k = b.k""",
)
def envelope_schema_diff(spark, sf):
    return compare.envelope_schema_diff(*_envelopes(spark, sf))


@query(
    "record_overlap_by_key",
    """with a as (select o_custkey as k, o_orderkey from orders where o_orderkey % 3 <> 0 and o_custkey % 2 = 0),
         b as (select o_custkey as k, o_orderkey from orders where o_orderkey % 3 <> 1 and o_custkey % 3 = 0)
       select (select count(*) from a) as records_a, (select count(*) from b) as records_b,
         (select count(*) from b) - (select count(*) from a) as record_count_delta,
         (select count(*) from (select k from a intersect select k from b)) as common_records,
         (select count(*) from (select k from a except select k from b)) as a_only_records,
         (select count(*) from (select k from b except select k from a)) as b_only_records""",
)
def record_overlap_by_key(spark, sf):
    o = table(spark, sf, "orders")
    a = o.where("o_orderkey % 3 <> 0 and o_custkey % 2 = 0")
    b = o.where("o_orderkey % 3 <> 1 and o_custkey % 3 = 0")
    return compare.record_overlap(a, b, "o_custkey")


@query(
    "record_overlap_by_hash",
    """with a as (select o_custkey, o_orderstatus from orders where o_orderkey % 3 <> 0 and o_custkey % 2 = 0),
         b as (select o_custkey, o_orderstatus from orders where o_orderkey % 3 <> 1 and o_custkey % 3 = 0)
       select (select count(*) from a) as records_a, (select count(*) from b) as records_b,
         (select count(*) from b) - (select count(*) from a) as record_count_delta,
         (select count(*) from (select * from a intersect select * from b)) as common_records,
         (select count(*) from (select * from a except select * from b)) as a_only_records,
         (select count(*) from (select * from b except select * from a)) as b_only_records""",
)
def record_overlap_by_hash(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    a = o.where("o_orderkey % 3 <> 0 and o_custkey % 2 = 0")
    b = o.where("o_orderkey % 3 <> 1 and o_custkey % 3 = 0")
    return compare.record_overlap(a, b, columns=["o_custkey", "o_orderstatus"])


_SIDES = f"""(select 'a' as side, * from {ORDERS} where o_orderkey % 3 <> 0 union all select 'b', * from {ORDERS} where o_orderkey % 3 <> 1)"""


@query(
    "compare_values",
    f"""with l as (select side, c, trim(v) as v from (
          select side, 'o_custkey' as c, cast(o_custkey as varchar) as v from {_SIDES}
          union all select side, 'o_orderdate', cast(o_orderdate as varchar) from {_SIDES}
          union all select side, 'o_orderkey', cast(o_orderkey as varchar) from {_SIDES}
          union all select side, 'o_orderpriority', o_orderpriority from {_SIDES}
          union all select side, 'o_orderstatus', o_orderstatus from {_SIDES}
          union all select side, 'o_totalprice', cast(o_totalprice as varchar) from {_SIDES}) where trim(v) <> ''),
        n as (select side, c, v, count(*) as n, sum(count(*)) over (partition by side, c) as total,
              row_number() over (partition by side, c order by count(*) desc, v) as place from l group by 1, 2, 3)
        select side, c as "column", cast(place as integer) as place, v as value, n as count, cast(total as bigint) as non_null from n where place <= 5""",
)
def compare_values(spark, sf):
    return compare.compare_values(*_halves(spark, sf))


@query(
    "quality_delta",
    f"""with f as (select count(*) as n, count(o_orderstatus) + count(o_totalprice) + count(*) filter (where lower(trim(o_orderpriority)) not in ('', 'null'))
          + 3 * count(*) as filled, count(*) filter (where o_orderpriority <> '' and (o_orderpriority <> trim(o_orderpriority) or o_orderpriority like '%  %')) as odd, s
          from (select *, 'a' as s from {ORDERS} where o_orderkey % 3 <> 0 union all select *, 'b' from {ORDERS} where o_orderkey % 3 <> 1) group by s),
        q as (select s, round(filled * 100.0 / (n * 6), 1) as completeness, round((n * 6 - odd) * 100.0 / (n * 6), 1) as consistency from f)
        select d as dimension, max(v) filter (where s = 'a') as score_a, max(v) filter (where s = 'b') as score_b,
          round(max(v) filter (where s = 'b') - max(v) filter (where s = 'a'), 1) as delta from (
          select s, 'completeness' as d, cast(completeness as double) as v from q union all select s, 'consistency', cast(consistency as double) from q) group by d""",
)
def quality_delta(spark, sf):
    a, b = _halves(spark, sf)
    out = compare.quality_delta(quality_scores(a), quality_scores(b.drop("extra")))
    return out.where(F.col("dimension").isin("completeness", "consistency"))
