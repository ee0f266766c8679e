"""Source catalogue from landed pages, and discovery over search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.html import canonical_link
from ..functions.urls import authority, url_safety
from ..table import col


def build_sources(
    pages: DataFrame, url: str = "url", content: str = "html", max_chars: int | None = None
) -> DataFrame:
    """Pages as sources: domain, canonical URL, title, status, content hash, error.

    Unsafe URLs are blocked and keep no content. Texts stay whole unless
    ``max_chars`` asks for a stored length. One projection over the pages.
    """
    body = col(content) if max_chars is None else F.left(col(content), F.lit(max_chars))
    checked = pages.withColumn("_safety", url_safety(col(url)))
    safe = F.col("_safety.is_safe")
    text = F.when(safe, body).otherwise(F.lit(""))
    canonical = canonical_link(col(content))
    title = F.nullif(F.regexp_extract(col(content), r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    return checked.select(
        *[col(c) for c in pages.columns if c not in (url, content)],
        col(url).alias("source_url"),
        F.when(safe, F.coalesce(canonical, col(url))).otherwise(col(url)).alias("canonical_url"),
        authority(F.trim(col(url))).alias("domain"),
        F.when(safe, F.coalesce(title, F.lit("Extracted Page")))
        .otherwise("Blocked URL")
        .alias("page_title"),
        F.lit("web").alias("source_type"),
        F.when(safe, "retrieved").otherwise("blocked").alias("retrieval_status"),
        F.when(text != "", F.sha2(text, 256)).alias("content_hash"),
        F.col("_safety.reason").alias("error_message"),
    )


def discover(
    results: DataFrame,
    max_queries: int | None = None,
    max_sources: int | None = None,
    max_results: int | None = None,
) -> DataFrame:
    """First hit per URL over all result lists, in query and hit order.

    ``results`` holds (query_pos, hit_pos, url, …), positions from 1. The first hit
    is folded per URL before the shuffle, so a URL found everywhere is no hot group.
    """
    hits = results if max_queries is None else results.where(F.col("query_pos") <= max_queries)
    if max_results is not None:
        hits = hits.where(F.col("hit_pos") <= max_results)
    others = [c for c in results.columns if c != "url"]
    place = F.struct("query_pos", "hit_pos")
    first = hits.groupBy("url").agg(F.min_by(F.struct(*[col(c) for c in others]), place).alias("_hit"))
    ordered = first.select("url", *[F.col(f"_hit.`{c}`").alias(c) for c in others]).orderBy("query_pos", "hit_pos", "url")
    return ordered if max_sources is None else ordered.limit(max_sources)
