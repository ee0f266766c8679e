"""Checks of the cell rules, cleaning and transformations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.functions import (
    bin_index,
    blank_to_null,
    checked_url,
    clean_url,
    comma_list,
    content_hash,
    display,
    domain,
    formula_guard,
    is_email,
    key_hash,
    num_loose,
    num_strict,
    parse_boolean,
    short_id,
    standard_date,
    standard_place,
    title_case,
    url_key,
    url_safety,
)
from tablewise.operators.clean import apply_clean, clean, preview
from tablewise.operators.filters import filter_records
from tablewise.operators.transform import apply_transform, map_by_table, preview as preview_transform, transform

from .inputs import LOOSE, ORDERS, PART, STRICT, orders, part
from .registry import query, table

# -- text ---------------------------------------------------------------------

_SPACED = """(select o_orderkey, case when o_orderkey % 4 = 0 then '  ' || o_orderpriority || '   x' || chr(9) || ' '
    when o_orderkey % 4 = 1 then 'N/A' when o_orderkey % 4 = 2 then ' - ' when o_orderkey % 8 = 3 then null
    else o_orderpriority end as note, o_orderstatus from orders)"""


def spaced(spark, sf):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 4 == 0, F.concat(F.lit("  "), p, F.lit("   x\t ")))
        .when(k % 4 == 1, "N/A")
        .when(k % 4 == 2, " - ")
        .when(k % 8 == 3, F.lit(None))
        .otherwise(p)
        .alias("note"),
        "o_orderstatus",
    )


@query(
    "clean_trim_whitespace",
    f"select o_orderkey, trim(regexp_replace(note, '\\s+', ' ', 'g')) as note, o_orderstatus from {_SPACED}",
)
def clean_trim_whitespace(spark, sf):
    return clean(spaced(spark, sf), "trim_whitespace")


@query(
    "clean_normalize_blanks",
    f"""select o_orderkey, case when lower(trim(note)) in ('', 'n/a', 'na', 'null', 'none', '-', '--', 'undefined')
        then null else note end as note, o_orderstatus from {_SPACED}""",
)
def clean_normalize_blanks(spark, sf):
    return clean(spaced(spark, sf), "normalize_blanks", {"field_name": "note"})


_CASED = "select p_partkey, {0} as p_name, p_brand from part"


@query("clean_case_lower", "select p_partkey, lower(p_name) as p_name, lower(p_brand) as p_brand from part")
def clean_case_lower(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return clean(df, "normalize_case", {"case_type": "lower", "fields": ["p_name", "p_brand"]})


@query("clean_case_upper", _CASED.format("upper(p_name)"))
def clean_case_upper(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return clean(df, "normalize_case", {"case_type": "upper", "field_name": "p_name"})


@query(
    "clean_case_title",
    _CASED.format(
        "array_to_string(list_transform(regexp_extract_all(p_name || '''s 9x' || p_brand, '(\\p{L}+|\\P{L}+)'), "
        "lambda x: upper(x[1]) || lower(x[2:])), '')"
    ),
)
def clean_case_title(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.lit("'s 9x"), "p_brand").alias("p_name"), "p_brand"
    )
    return clean(df, "normalize_case", {"field_name": "p_name"})


# -- numbers ------------------------------------------------------------------


@query("strict_and_loose_numbers", f"select p_partkey, {STRICT.format('p_code')} as strict, {LOOSE.format('p_code')} as loose from {PART}")
def strict_and_loose_numbers(spark, sf):
    c = F.col("p_code")
    return part(spark, sf).select("p_partkey", num_strict(c).alias("strict"), num_loose(c).alias("loose"))


@query(
    "bin_index",
    """with b as (select min(l_tax) as lo, max(l_tax) as hi from lineitem),
       e as (select cast(range as integer) as k, lo + range * ((hi - lo) / 4) as s, lo + (range + 1) * ((hi - lo) / 4) as t
             from b, range(4)),
       n as (select l_tax as v, count(*) as n from lineitem group by 1)
       select v, n, k as bin from n, e where v >= s and (v < t or k = 3)""",
)
def bin_index_of_tax(spark, sf):
    df = table(spark, sf, "lineitem")
    lo, hi = df.agg(F.min("l_tax"), F.max("l_tax")).first()
    return (
        df.groupBy(F.col("l_tax").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin", bin_index(F.col("v"), F.lit(lo), F.lit(hi), F.lit(4)))
    )


@query(
    "display_values",
    """select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 7, 4) as v,
       cast(null as double) as nothing from lineitem""",
)
def display_values(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 7).alias("v"), F.lit(float("nan")).alias("nothing")
    )
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[display(F.col(c), kinds[c]).alias(c) for c in df.columns])


def _convert(name: str, target: str, sql: str):
    @query(f"clean_convert_{name}", f"select p_partkey, {sql} as p_code from {PART}")
    def run_it(spark, sf):
        df = part(spark, sf).select("p_partkey", "p_code")
        return clean(df, "convert_types", {"field_name": "p_code", "target_type": target})

    return run_it


_convert("integer", "integer", f"cast(trunc({LOOSE.format('p_code')}) as bigint)")
_convert("float", "decimal", LOOSE.format("p_code"))
_convert("string", "string", "p_code")


@query(
    "clean_convert_boolean",
    """select l_orderkey, l_linenumber, lower(trim(l_returnflag)) in ('true', '1', 'yes', 't', 'y') as l_returnflag,
       cast(l_linenumber as varchar) in ('true', '1', 'yes', 't', 'y') as first_line from lineitem""",
)
def clean_convert_boolean(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_linenumber").alias("first_line")
    )
    return clean(df, "convert_types", {"fields": ["l_returnflag", "first_line"], "target_type": "bool"})


@query(
    "parse_boolean",
    """select o_orderkey, case when lower(w) in ('true', 'yes', '1', 'y', 't') then true
       when lower(w) in ('false', 'no', '0', 'n', 'f') then false else length(w) > 0 end as flag
       from (select o_orderkey, case o_orderkey % 5 when 0 then 'Yes' when 1 then 'f' when 2 then '' when 3 then 'maybe'
         else o_orderstatus end as w from orders)""",
)
def parse_boolean_words(spark, sf):
    k = F.col("o_orderkey") % 5
    word = F.when(k == 0, "Yes").when(k == 1, "f").when(k == 2, "").when(k == 3, "maybe").otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", parse_boolean(word).alias("flag"))


# -- dates --------------------------------------------------------------------

_DATES = """(select o_orderkey, d, case o_orderkey % 10 when 0 then strftime(d, '%Y-%m-%d') when 1 then strftime(d, '%d/%m/%Y')
    when 2 then strftime(d, '%m/%d/%Y') when 3 then strftime(d, '%d-%m-%Y') when 4 then strftime(d, '%Y/%m/%d')
    when 5 then strftime(d, '%B %d, %Y') when 6 then strftime(d, '%b %d, %Y') when 7 then strftime(d, '%Y-%m-%dT%H:%M:%S')
    when 8 then strftime(d, '%Y-%m-%d %H:%M:%S') || '.123' else strftime(d, '%d.%m.%Y') end as order_date
    from (select o_orderkey, cast(o_orderdate as timestamp) as d from orders))"""


@query(
    "clean_standardize_dates",
    f"""select o_orderkey, case when o_orderkey % 10 = 9 then order_date
          when o_orderkey % 10 = 2 and day(d) <= 12 and month(d) <= 12 then strftime(d, '%Y-%d-%m')
          else strftime(d, '%Y-%m-%d') end as order_date from {_DATES}""",
)
def clean_standardize_dates(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 10
    shapes = (
        "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "MMMM dd, yyyy", "MMM dd, yyyy",
        "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss'.123'", "dd.MM.yyyy",
    )
    text = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        text = F.when(k == i, F.date_format(d, shape)).otherwise(text)
    df = table(spark, sf, "orders").select("o_orderkey", text.alias("order_date"))
    return clean(df, "standardize_dates")


# -- urls ---------------------------------------------------------------------

# Page URLs, some without scheme, in upper case, with port, tracking and blanks.
_URLS = """(select page_id, case page_id % 6 when 0 then replace(url, 'https://', '') when 1 then upper(url)
    when 2 then url || case when url like '%?%' then '&' else '?' end || 'utm_campaign=a&id=' || page_id || '&e=&q=a%20b&id=z'
    when 3 then ' ' || url || '/ ' when 4 then replace(url, '.example', '.example:8080') || '//' else url end as url from pages)"""


def urls(spark, sf):
    u, k = F.col("url"), F.col("page_id") % 6
    more = F.concat(
        u, F.when(u.contains("?"), "&").otherwise("?"), F.lit("utm_campaign=a&id="), F.col("page_id").cast("string"),
        F.lit("&e=&q=a%20b&id=z"),
    )
    return table(spark, sf, "pages").select(
        "page_id",
        F.when(k == 0, F.replace(u, F.lit("https://"), F.lit("")))
        .when(k == 1, F.upper(u))
        .when(k == 2, more)
        .when(k == 3, F.concat(F.lit(" "), u, F.lit("/ ")))
        .when(k == 4, F.concat(F.replace(u, F.lit(".example"), F.lit(".example:8080")), F.lit("//")))
        .otherwise(u)
        .alias("url"),
    )


_FULL = """(select page_id, case when regexp_matches(trim(url), '(?i)^https?://') then trim(url) else 'https://' || trim(url) end as u
    from {0})""".format(_URLS)
_SPLIT = f"""(select page_id, u, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) as scheme,
    lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)) as host, regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path,
    list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.')) as pairs
    from {_FULL})"""
_KEEP = "replace(array_to_string(list_filter(pairs, lambda p: {0}), '&'), '%20', '+')"


@query(
    "clean_normalize_urls",
    f"""select page_id, scheme || '://' || host || rtrim(path, '/') || case when q <> '' then '?' || q else '' end as url from (
        select *, {_KEEP.format("lower(p) not like 'utm_%' and lower(split_part(p, '=', 1)) not in ('ref', 'fbclid', 'gclid')")} as q
        from {_SPLIT})""",
)
def clean_normalize_urls(spark, sf):
    return clean(urls(spark, sf), "normalize_urls")


@query(
    "validator_urls",
    f"""select page_id, scheme || '://' || host || case when path = '/' then path else rtrim(path, '/') end
          || case when q <> '' then '?' || replace(q, '/', '%2F') else '' end as url from (
        select *, replace(array_to_string(list_concat(list_filter(kept, lambda p: split_part(p, '=', 1) <> 'q'),
            list_filter(kept, lambda p: split_part(p, '=', 1) = 'q')), '&'), '%20', '+') as q from (
          select *, list_filter(pairs, lambda p: lower(p) not like 'utm_%') as kept from {_SPLIT}))""",
)
def validator_urls(spark, sf):
    """Repeated parameters come together: ``id=1&q=a&id=z`` becomes ``id=1&id=z&q=a``."""
    return urls(spark, sf).select("page_id", checked_url(F.col("url")).alias("url"))


@query(
    "derive_extract_domain",
    f"""select page_id, nullif(regexp_replace(host, '^www\\.', ''), '') as domain from {_SPLIT}""",
)
def derive_extract_domain(spark, sf):
    out = transform(
        urls(spark, sf), "derive_column",
        {"target_column": "domain", "expression_type": "extract_domain", "source_column": "url"},
    )
    return out.select("page_id", "domain")


_HOSTS = """(select o_orderkey, case o_orderkey % 12
    when 0 then 'http://10.' || o_orderkey % 256 || '.0.1/' when 1 then 'https://172.' || o_orderkey % 40 || '.3.4/a'
    when 2 then 'http://192.168.1.' || o_orderkey % 256 || ':8080/' when 3 then 'http://169.254.169.254/latest'
    when 4 then 'ftp://example.com/x' when 5 then 'http://svc' || o_orderkey || '.local/'
    when 6 then 'https://user@localhost:99/' when 7 then 'http://8.8.' || o_orderkey % 256 || '.8/'
    when 8 then 'http://' || (o_orderkey % 256) || '.1.2.3/' when 9 then 'https://example' || o_orderkey || '.org/'
    when 10 then '' else 'http://100.64.0.1.internal/' end as url from orders)"""


def hosts(spark, sf):
    k = F.col("o_orderkey")
    s = k.cast("string")

    def byte(n):
        return (k % n).cast("string")

    url = (
        F.when(k % 12 == 0, F.concat(F.lit("http://10."), byte(256), F.lit(".0.1/")))
        .when(k % 12 == 1, F.concat(F.lit("https://172."), byte(40), F.lit(".3.4/a")))
        .when(k % 12 == 2, F.concat(F.lit("http://192.168.1."), byte(256), F.lit(":8080/")))
        .when(k % 12 == 3, "http://169.254.169.254/latest")
        .when(k % 12 == 4, "ftp://example.com/x")
        .when(k % 12 == 5, F.concat(F.lit("http://svc"), s, F.lit(".local/")))
        .when(k % 12 == 6, "https://user@localhost:99/")
        .when(k % 12 == 7, F.concat(F.lit("http://8.8."), byte(256), F.lit(".8/")))
        .when(k % 12 == 8, F.concat(F.lit("http://"), byte(256), F.lit(".1.2.3/")))
        .when(k % 12 == 9, F.concat(F.lit("https://example"), s, F.lit(".org/")))
        .when(k % 12 == 10, "")
        .otherwise("http://100.64.0.1.internal/")
    )
    return table(spark, sf, "orders").select("o_orderkey", url.alias("url"))


@query(
    "url_safety",
    f"""with s as (select o_orderkey as k, case o_orderkey % 12 when 1 then o_orderkey % 40 not between 16 and 31 when 7 then true
          when 8 then not (o_orderkey % 256 in (0, 10, 127) or o_orderkey % 256 >= 224) when 9 then true else false end as is_safe
          from orders)
        select k as o_orderkey, is_safe, case when is_safe then null else case k % 12
          when 4 then 'Unsupported URL scheme: ftp. Only HTTP/HTTPS permitted.' when 5 then 'Internal domains are prohibited: svc' || k || '.local'
          when 6 then 'Blocked target host: localhost' when 3 then 'Blocked target host: 169.254.169.254' when 10 then 'URL is empty or invalid' when 11 then 'Internal domains are prohibited: 100.64.0.1.internal'
          else 'Access to private/loopback IP ' || case k % 12 when 0 then '10.' || k % 256 || '.0.1' when 1 then '172.' || k % 40 || '.3.4'
            when 2 then '192.168.1.' || k % 256 else k % 256 || '.1.2.3' end || ' is blocked' end end as reason from s""",
)
def url_safety_of_hosts(spark, sf):
    return hosts(spark, sf).select("o_orderkey", url_safety(F.col("url")).alias("s")).select("o_orderkey", "s.is_safe", "s.reason")


@query(
    "url_safety_ipv6",
    """select o_orderkey, case o_orderkey % 8 when 0 then false when 1 then false when 2 then false when 3 then true when 4 then true
         when 5 then false when 6 then false else true end as is_safe from orders""",
)
def url_safety_ipv6(spark, sf):
    """Loopback, private, link-local, mapped and malformed addresses against global ones."""
    k = F.col("o_orderkey")
    low = F.lower(F.hex(k % 65536))
    forms = ("::1", "fd00::{}", "fe80::{}", "2606:4700::{}", "2a00:1450:4001::{}", "::ffff:10.0.0.1", "1:2:3:{}", "2001:4860:4860::{}")
    host = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        before, _, after = form.partition("{}")
        host = F.when(k % 8 == i, F.concat(F.lit(before), low, F.lit(after)) if "{}" in form else F.lit(form)).otherwise(host)
    url = F.concat(F.lit("https://["), host, F.lit("]/"))
    return table(spark, sf, "orders").select("o_orderkey", url_safety(url)["is_safe"].alias("is_safe"))


@query(
    "url_key",
    f"""select page_id, case when length(trim(url)) > 8 then rtrim(lower(trim(url)), '/') end as key,
        'url_' || left(md5(rtrim(lower(trim(url)), '/')), 10) as group_id from {_URLS}""",
)
def url_key_of_pages(spark, sf):
    key = url_key(F.col("url"))
    return urls(spark, sf).select("page_id", key.alias("key"), short_id("url_", key, 10).alias("group_id"))


# -- other cell rules -----------------------------------------------------------

_PLACES = """(select c_custkey, case c_custkey % 8 when 0 then 'NYC' when 1 then 'sf, CA' when 2 then 'Austin us'
    when 3 then ' Bengaluru ' when 4 then 'near bay area today' when 5 then 'usable place' when 6 then 'Delhi NCR, India'
    else 'Paris' end as home_city from customer)"""


@query(
    "clean_normalize_geo",
    f"""select c_custkey, case c_custkey % 8 when 0 then 'New York City' when 1 then 'San Francisco, CA'
        when 2 then 'Austin United States' when 3 then 'Bangalore' when 4 then 'near San Francisco Bay Area today'
        when 5 then 'usable place' when 6 then 'Delhi-NCR, India' else 'Paris' end as home_city from customer""",
)
def clean_normalize_geo(spark, sf):
    k = F.col("c_custkey") % 8
    words = ("NYC", "sf, CA", "Austin us", " Bengaluru ", "near bay area today", "usable place", "Delhi NCR, India", "Paris")
    text = F.lit(None).cast("string")
    for i, w in enumerate(words):
        text = F.when(k == i, w).otherwise(text)
    return clean(table(spark, sf, "customer").select("c_custkey", text.alias("home_city")), "normalize_geo")


@query(
    "email_check",
    r"""select c_custkey, regexp_matches(mail, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$') as good from (
        select c_custkey, case c_custkey % 4 when 0 then c_name || '@example.org' when 1 then 'c' || c_custkey || '@Example.org'
          when 2 then 'c.' || c_custkey || '+x@mail.example.org' else 'c@nodot' end as mail from customer)""",
)
def email_check(spark, sf):
    k, s = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    mail = (
        F.when(k == 0, F.concat("c_name", F.lit("@example.org")))
        .when(k == 1, F.concat(F.lit("c"), s, F.lit("@Example.org")))
        .when(k == 2, F.concat(F.lit("c."), s, F.lit("+x@mail.example.org")))
        .otherwise("c@nodot")
    )
    return table(spark, sf, "customer").select("c_custkey", is_email(mail).alias("good"))


@query(
    "comma_list",
    """select p_partkey, array_to_string(list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> ''), '|')
       as items from (select p_partkey, p_name || ', ,' || p_brand || ' , ' || p_type as t from part)""",
)
def comma_list_of_parts(spark, sf):
    text = F.concat("p_name", F.lit(", ,"), "p_brand", F.lit(" , "), "p_type")
    return table(spark, sf, "part").select("p_partkey", F.array_join(comma_list(text), "|").alias("items"))


_GUARDED = """(select o_orderkey, case o_orderkey % 6 when 0 then '=1+1' when 1 then '-5' when 2 then '@x' when 3 then chr(9) || 'x'
    when 4 then ' =no' else o_orderpriority end as cell from orders)"""


@query(
    "formula_guard",
    f"""select o_orderkey, case when left(cell, 1) in ('=', '+', '-', '@', chr(9), chr(13)) then '''' || cell else cell end as cell
        from {_GUARDED}""",
)
def formula_guard_of_orders(spark, sf):
    k = F.col("o_orderkey") % 6
    cell = (
        F.when(k == 0, "=1+1").when(k == 1, "-5").when(k == 2, "@x").when(k == 3, "\tx").when(k == 4, " =no")
        .otherwise(F.col("o_orderpriority"))
    )
    return table(spark, sf, "orders").select("o_orderkey", formula_guard(cell).alias("cell"))


@query(
    "content_hash",
    """select c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":' || coalesce('"' || s || '"', 'null')
       || ',"c_name":"' || c_name || '"}') as hash
       from (select *, nullif(c_mktsegment, 'BUILDING') as s from customer)""",
)
def content_hash_of_customers(spark, sf):
    df = table(spark, sf, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return df.select("c_custkey", content_hash(["c_name", "c_custkey", "c_mktsegment"]).alias("hash"))


@query(
    "key_hash",
    """select c_custkey, case when a = '' and b = '' then sha256('{"a":' || coalesce('"' || a0 || '"', 'null') || ',"b":""}')
         else sha256(a || '|' || b) end as hash
       from (select c_custkey, a0, coalesce(lower(trim(a0)), '') as a, lower(trim(b0)) as b from (
         select c_custkey, case c_custkey % 4 when 0 then null when 1 then ' ' || c_name || ' ' else upper(c_name) end as a0,
           case when c_custkey % 8 = 0 then '' else c_mktsegment end as b0 from customer))""",
)
def key_hash_of_customers(spark, sf):
    k = F.col("c_custkey")
    df = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(k % 4 == 0, F.lit(None))
        .when(k % 4 == 1, F.concat(F.lit(" "), "c_name", F.lit(" ")))
        .otherwise(F.upper("c_name"))
        .alias("a"),
        F.when(k % 8 == 0, "").otherwise(F.col("c_mktsegment")).alias("b"),
    )
    return df.select("c_custkey", key_hash(["a", "b"], ["a", "b"]).alias("hash"))


# -- filling, dropping, mapping ---------------------------------------------------


@query(
    "clean_fill_constant",
    f"""select o_orderkey, o_custkey, coalesce(o_orderstatus, 'unknown') as o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        from {ORDERS}""",
)
def clean_fill_constant(spark, sf):
    return clean(orders(spark, sf), "fill_missing_constant", {"field_name": "o_orderstatus", "constant_value": "unknown"})


@query(
    "clean_fill_all",
    f"""select o_orderkey, o_custkey, coalesce(o_orderstatus, '0') as o_orderstatus, coalesce(o_totalprice, 0) as o_totalprice,
        o_orderdate, o_orderpriority from {ORDERS}""",
)
def clean_fill_all(spark, sf):
    return clean(orders(spark, sf), "fill_missing_constant", {"constant_value": "0"})


_DROP = "(o_orderstatus is null or o_orderpriority is null or lower(trim(o_orderpriority)) in ('', 'null', 'none', 'n/a'))"


@query("clean_drop_missing", f"select * from {ORDERS} where not {_DROP}")
def clean_drop_missing(spark, sf):
    return clean(orders(spark, sf), "drop_missing_required", {"required_fields": ["o_orderstatus", "o_orderpriority"]})


@query("clean_drop_missing_ids", f"select o_orderkey from {ORDERS} where {_DROP}")
def clean_drop_missing_ids(spark, sf):
    config = {"required_fields": ["o_orderstatus", "o_orderpriority"]}
    return apply_clean(orders(spark, sf), "drop_missing_required", config, "o_orderkey").dropped


_MAPPED = """case when trim({0}) = '1-URGENT' then 'now' when lower(trim({0})) = '2-high' then 'soon'
    when lower(trim({0})) = 'null' then null else {0} end"""


@query("clean_map_values", f"select o_orderkey, {_MAPPED.format('o_orderpriority')} as o_orderpriority from {ORDERS}")
def clean_map_values(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_orderpriority")
    mapping = {"1-URGENT": "now", "2-High": "soon", "NULL": None}
    return clean(df, "map_values", {"field_name": "o_orderpriority", "mapping": mapping})


_COPIES = """(select o_orderkey * 2 as record_seq, o_custkey, o_orderstatus, o_totalprice from orders
    union all select o_orderkey * 2 + 1, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey % 10 = 0
    union all select 10000000000 + o_orderkey, 1, 'F', 1.5 from orders where o_orderkey % 2 = 0)"""


def copies(spark, sf):
    """Orders with copies, and one record that fills a quarter of the table."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rest = ("o_custkey", "o_orderstatus", "o_totalprice")
    return (
        o.select((k * 2).alias("record_seq"), *rest)
        .unionByName(o.where(k % 10 == 0).select((k * 2 + 1).alias("record_seq"), *rest))
        .unionByName(
            o.where(k % 2 == 0).select(
                (k + 10000000000).alias("record_seq"),
                F.lit(1).cast("long").alias("o_custkey"),
                F.lit("F").alias("o_orderstatus"),
                F.lit(1.5).alias("o_totalprice"),
            )
        )
    )


@query(
    "clean_remove_duplicates",
    f"""select record_seq, o_custkey, o_orderstatus, o_totalprice from (
        select *, row_number() over (partition by o_custkey, o_orderstatus, o_totalprice order by record_seq) as r from {_COPIES})
        where r = 1""",
)
def clean_remove_duplicates(spark, sf):
    return clean(copies(spark, sf), "remove_duplicates")


@query(
    "clean_preview_duplicates",
    f"""select 'remove_duplicates' as operation_type, cast(count(*) as bigint) as records_affected, true as potential_info_loss from (
        select row_number() over (partition by o_custkey, o_orderstatus, o_totalprice order by record_seq) as r from {_COPIES})
        where r > 1""",
)
def clean_preview_duplicates(spark, sf):
    return preview(copies(spark, sf), "remove_duplicates").summary.drop("fields_affected", "warnings")


@query(
    "clean_preview_trim",
    f"""select count(*) as records_affected, 'note' as fields from {_SPACED}
        where note is distinct from trim(regexp_replace(note, '\\s+', ' ', 'g'))""",
)
def clean_preview_trim(spark, sf):
    out = preview(spaced(spark, sf), "trim_whitespace", None, "o_orderkey").summary
    return out.select("records_affected", F.array_join("fields_affected", ",").alias("fields"))


@query(
    "clean_preview_samples",
    f"""select o_orderkey, note as before, trim(regexp_replace(note, '\\s+', ' ', 'g')) as after from {_SPACED}
        where note is distinct from trim(regexp_replace(note, '\\s+', ' ', 'g')) order by o_orderkey limit 5""",
)
def clean_preview_samples(spark, sf):
    out = preview(spaced(spark, sf), "trim_whitespace", None, "o_orderkey").samples
    return out.select("o_orderkey", F.col("original")["note"].alias("before"), F.col("cleaned")["note"].alias("after"))


@query(
    "clean_preview_convert",
    f"""select count(*) filter (where cast({LOOSE.format('p_code')} as varchar) is distinct from p_code) as records_affected,
        count(*) filter (where p_code is not null and {LOOSE.format('p_code')} is null) as failed_conversions, true as potential_info_loss
        from {PART}""",
)
def clean_preview_convert(spark, sf):
    df = part(spark, sf).select("p_partkey", "p_code")
    out = preview(df, "convert_types", {"field_name": "p_code", "target_type": "float"}, "p_partkey").summary
    return out.select("records_affected", "failed_conversions", "potential_info_loss")


@query(
    "clean_rehash",
    """select c_custkey, c_name, case when c_name <> upper(c_name) then sha256('{"c_custkey":' || c_custkey || ',"c_name":"'
       || upper(c_name) || '"}') else 'old' end as content_hash from customer""",
)
def clean_rehash(spark, sf):
    """The stored hash changes with the content, and only then."""
    df = table(spark, sf, "customer").select("c_custkey", "c_name", F.lit("old").alias("content_hash"))
    out = clean(df, "normalize_case", {"field_name": "c_name", "case_type": "upper"})
    return out.select("c_custkey", F.col("c_name").alias("c_name"), "content_hash").withColumn("c_name", F.initcap("c_name"))


# -- transformations ----------------------------------------------------------------


def _derive(name: str, config: dict, sql: str, source: str = PART, frame=part, key: str = "p_partkey"):
    @query(f"derive_{name}", f"select {key}, {sql} as derived from {source}")
    def run_it(spark, sf):
        full = {"target_column": "derived", **config}
        return transform(frame(spark, sf), "derive_column", full).select(key, "derived")

    return run_it


_derive(
    "combine_text",
    {"expression_type": "combine_text", "source_columns": ["p_name", "p_code", "p_size"], "delimiter": " / "},
    "nullif(concat_ws(' / ', nullif(trim(p_name), ''), nullif(trim(p_code), ''), cast(p_size as varchar)), '')",
)
_derive(
    "combine_nothing",
    {"expression_type": "combine_text", "source_columns": ["p_code"]},
    "nullif(trim(p_code), '')",
)
_derive(
    "split_text",
    {"expression_type": "split_text", "source_column": "p_name", "delimiter": " ", "part_index": 1},
    "trim(string_split(p_name, ' ')[2])",
)
_derive(
    "split_text_literal",
    {"expression_type": "split_text", "source_column": "p_brand", "delimiter": "|", "part_index": 1},
    "cast(null as varchar)",
)
for _op, _word in (("+", "plus"), ("-", "minus"), ("*", "times")):
    _derive(
        f"math_{_word}",
        {"expression_type": "math_op", "source_column": "p_code", "operator": _op, "operand": 2.5},
        f"round({LOOSE.format('p_code')} {_op} 2.5, 2)",
    )
_derive(
    "math_divide",
    {"expression_type": "math_op", "source_column": "p_retailprice", "operator": "/", "operand": 4},
    "round(p_retailprice / 4, 2)",
)
_derive(
    "math_divide_by_zero",
    {"expression_type": "math_op", "source_column": "p_retailprice", "operator": "/", "operand": 0},
    "cast(null as double)",
)
_derive(
    "value_map",
    {"expression_type": "value_map", "source_column": "p_type", "mapping": {"PROMO": "p", "economy": "e"}},
    "case when trim(p_type) = 'PROMO' then 'p' when lower(trim(p_type)) = 'economy' then 'e' when lower(trim(p_type)) = 'promo' then 'p' else p_type end",
)
_derive("constant", {"expression_type": "constant", "constant_value": "x"}, "'x'")


@query(
    "derive_value_map_by_table",
    """select l_orderkey, l_linenumber, l_partkey, l_extendedprice, coalesce(p_name, cast(l_partkey as varchar)) as name from lineitem
       left join part on p_partkey = l_partkey and p_partkey % 2 = 0""",
)
def derive_value_map_by_table(spark, sf):
    names = table(spark, sf, "part").where("p_partkey % 2 = 0").select(
        F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("value")
    )
    out = map_by_table(table(spark, sf, "lineitem"), "l_partkey", names, "name", "l_orderkey")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "name")


@query("rename_column", "select o_orderkey as order_id, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as date) as o_orderdate from orders")
def rename_column(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate")
    )
    out = transform(df, "rename_column", {"old_name": "o_orderkey", "new_name": "order_id"})
    return transform(out, "rename_column", {"old_name": "absent", "new_name": "other"})


def _records(name: str, config: dict, where: str):
    @query(f"records_{name}", f"select o_orderkey, o_orderpriority, o_orderstatus, o_totalprice from {ORDERS} where {where}")
    def run_it(spark, sf):
        out = filter_records(orders(spark, sf), **config)
        return out.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")

    return run_it


_P = "lower(trim(o_orderpriority))"
_records("equal", {"field": "o_orderpriority", "operator": "==", "target": " 1-urgent"}, f"{_P} = '1-urgent'")
_records("not_equal", {"field": "o_orderstatus", "operator": "!=", "target": "f"}, "lower(trim(o_orderstatus)) <> 'f'")
_records("contains", {"field": "o_orderpriority", "operator": "contains", "target": "HIGH"}, f"contains({_P}, 'high')")
_records("greater", {"field": "o_totalprice", "operator": ">", "target": "250000"}, "o_totalprice > 250000")
_records("less_equal", {"field": "o_totalprice", "operator": "<=", "target": "1e5"}, "o_totalprice <= 100000")
_records("is_null", {"field": "o_orderpriority", "operator": "is_null"}, f"o_orderpriority is null or {_P} in ('', 'null', 'none')")
_records("not_null", {"field": "o_orderpriority", "operator": "not_null"}, f"o_orderpriority is not null and {_P} not in ('', 'null', 'none')")
_records("drop", {"field": "o_orderstatus", "operator": "==", "target": "F", "action": "drop"}, "o_orderstatus is distinct from 'F'")
_records("drop_not_equal", {"field": "o_orderstatus", "operator": "!=", "target": "F", "action": "drop"}, "coalesce(o_orderstatus, 'F') = 'F'")


@query(
    "transform_preview_filter",
    f"select 'filter_records' as operation_type, count(*) as records_affected, 'o_totalprice' as fields from {ORDERS} where coalesce(o_totalprice, 0) <= 250000",
)
def transform_preview_filter(spark, sf):
    config = {"filter_field": "o_totalprice", "operator": ">", "value": 250000}
    out = preview_transform(orders(spark, sf), "filter_records", config, "o_orderkey").summary
    return out.select("operation_type", "records_affected", F.array_join("fields_affected", ",").alias("fields"))


@query(
    "transform_preview_derive",
    f"select count({LOOSE.format('p_code')}) as records_affected from {PART}",
)
def transform_preview_derive(spark, sf):
    config = {"target_column": "d", "expression_type": "math_op", "source_column": "p_code", "operand": 1}
    return preview_transform(part(spark, sf), "derive_column", config, "p_partkey").summary.select("records_affected")


@query("transform_dropped_ids", f"select o_orderkey from {ORDERS} where coalesce(o_totalprice, 0) <= 250000")
def transform_dropped_ids(spark, sf):
    config = {"filter_field": "o_totalprice", "operator": ">", "value": 250000}
    return apply_transform(orders(spark, sf), "filter_records", config, "o_orderkey").dropped
