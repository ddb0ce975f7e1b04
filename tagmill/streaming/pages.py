"""From a fetched page to the jobs that follow: the next page, enrichment, evaluation, downloads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.lang.bind import bind
from tagmill.plans.catalog import Catalog
from tagmill.plans.compile import search
from tagmill.streaming import files as store
from tagmill.streaming import jobs

# Priorities of the jobs that follow a page.
NEXT, ENRICH, EVALUATE = 30, 20, 5
PAGE = "struct<query:string,page:int,page_size:int,remaining:int>"


def next_page(pages: DataFrame) -> DataFrame:
    """query, page, page_size, remaining of the pages to fetch after pages (those columns and posts, the number that came).

    There is none after a page that was not full, nor once the limit (remaining; null: none) is reached.
    """
    left = F.col("remaining") - F.col("posts")
    rows = pages.where((F.col("posts") >= F.col("page_size")) & (F.col("remaining").isNull() | (left > 0)))
    return rows.select("query", (F.col("page") + 1).alias("page"), F.least("page_size", left).alias("page_size"), left.alias("remaining"))


def _job(kind: Column | str, payload: Column, priority: int) -> list[Column]:
    return [(F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), payload.alias("payload"), F.lit(priority).alias("priority")]


def after_page(page: DataFrame, posts: DataFrame, coverage: DataFrame, text: str, tags=None, now: datetime | None = None) -> DataFrame:
    """kind, payload, priority of the jobs after a page of a query: the next page, what its posts lack, their evaluation.

    page: one row of next_page()'s columns and posts; posts: post_id of the page (320 at most).
    """
    needs = bind(text, tags, now).checked().needs
    onward = next_page(page).select(*_job("fetch_page", F.to_json(F.struct("query", "page", "page_size", "remaining")), NEXT))
    lacking = jobs.fan_out(posts, coverage, needs).select("kind", "payload", F.lit(ENRICH).alias("priority"))
    ids = posts.agg(F.array_sort(F.collect_set("post_id")).alias("post_ids")).where(F.size("post_ids") > 0)
    judged = ids.select(*_job("evaluate_query", F.to_json(F.struct(F.lit(text).alias("query"), "post_ids")), EVALUATE))
    return onward.unionByName(lacking).unionByName(judged)


def downloads(text: str, catalog: Catalog, posts: DataFrame, files: DataFrame, variant: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(files with what the query wants of the posts pending, jobs kind and payload that fetch it).

    posts: post_id, ext, source_url, md5 of the variant; without a URL there is nothing to fetch.
    """
    hits = posts.where("source_url is not null").join(search(text, catalog, now=now, ordered=False), "post_id", "left_semi")
    wanted = hits.withColumn("variant", F.lit(variant)).join(files.where(F.col("state") == store.THERE).select(*store.KEY), store.KEY, "left_anti")
    payload = F.to_json(F.struct("post_id", "variant", "source_url", store.path_of("files").alias("destination"), F.col("md5").alias("expected_md5")))
    return store.want(files, wanted, now), wanted.select(*_job(f"download_{variant}", payload, 0))
