"""The star-schema tables as a media catalogue: orders are posts, parts give tags, events
give sidecars. Posts are assembled from pieces, and only those a query's fields need are
joined, so a filter on a post's own columns reads orders alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions import scalars as S
from tagmill.operators.tags import TagGraph
from tagmill.plans.catalog import Catalog

TYPES = {"1": "png", "2": "jpg", "3": "gif", "4": "webm", "5": "mp4"}
ALIASES = [("tiny", "small"), ("huge", "large"), ("spinner", "gear"), ("whirl", "spinner")]
IMPLICATIONS = [("bolt", "fastener"), ("rod", "fastener"), ("fastener", "hardware"), ("gear", "hardware")]
LOCKED = {"rating_locked": 7, "note_locked": 5, "status_locked": 3, "artist_verified": 2, "is_deleted": 17, "is_pending": 13, "is_flagged": 11, "pending_replacements": 19}
SIDECARS = {"comments": "view", "favorites": "click", "votes": "purchase", "notes": "signup", "deletion_events": "error"}


class Star:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def own(self) -> DataFrame:
        key = F.col("o_orderkey")
        own = self.table("orders").select(
            key.alias("post_id"),
            F.when(F.col("o_orderstatus") == "F", "s").when(F.col("o_orderstatus") == "O", "q").otherwise("e").alias("rating"),
            F.floor(F.col("o_totalprice") / 1000).cast("int").alias("score"),
            F.col("o_custkey").alias("uploader_id"),
            F.when(key % 4 == 0, key % 97).alias("approver_id"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
            S.mapped(F.substring("o_orderpriority", 1, 1), TYPES).alias("file_ext"),
            F.md5(key.cast("string")).alias("md5"),
            F.when(key % 10 != 0, key - key % 10).alias("parent_post_id"),
            *((key % n == 0).alias(c) for c, n in LOCKED.items()),
        )
        return own

    def items(self) -> DataFrame:
        day = F.to_date("l_shipdate")
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("post_id")).agg(
            F.sum("l_quantity").cast("int").alias("width"),
            (F.count("*") * 10).cast("int").alias("height"),
            F.floor(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100).cast("long").alias("file_size"),
            F.datediff(F.max(day), F.min(day)).alias("duration"),
        )

    def post_tags(self) -> DataFrame:
        """post_id, category, tag, each once."""
        return self.edges(whole=True).distinct()

    def edges(self, whole: bool = False) -> DataFrame:
        """post_id, category, tag of every item.

        whole: no filter on tags will follow, so the parts are shuffled and explode after the
        join: Spark's guess of their size leaves out the explode, and it broadcasts what the
        driver cannot hold.
        """
        parts = self.table("part").select("p_partkey", F.split("p_name", " ").alias("words"), "p_type", "p_brand")
        tags = F.explode(F.array(
            F.struct(F.lit("general").alias("category"), F.lower(F.col("words")[0]).alias("tag")),
            F.struct(F.lit("species").alias("category"), F.lower(F.col("words")[1]).alias("tag")),
            F.struct(F.lit("meta").alias("category"), F.lower("p_type").alias("tag")),
            F.struct(F.lit("artist").alias("category"), F.lower("p_brand").alias("tag")),
        )).alias("t")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        if whole:
            rows = lines.join(parts.hint("merge"), lines["l_partkey"] == parts["p_partkey"]).select("l_orderkey", tags)
        else:
            parts = parts.select("p_partkey", tags)
            rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
        return rows.select(F.col("l_orderkey").alias("post_id"), "t.category", "t.tag")

    def tag_columns(self) -> DataFrame:
        """all_tags and tags: sets are gathered straight from the items, with map-side partial sets."""
        words = F.split("p_name", " ")
        parts = self.table("part").select("p_partkey", F.lower(words[0]).alias("general"), F.lower(words[1]).alias("species"), F.lower("p_type").alias("meta"), F.lower("p_brand").alias("artist"))
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        kinds = ("general", "species", "meta", "artist")
        rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy(F.col("l_orderkey").alias("post_id")).agg(*(F.collect_set(k).alias(k) for k in kinds))
        none = F.array().cast("array<string>")
        every = F.struct(*((F.col(c) if c in kinds else none).alias(c) for c in S.TAG_CATEGORIES))
        return rows.select("post_id", F.array_distinct(F.flatten(F.array(*kinds))).alias("all_tags"), every.alias("tags"))

    def posts(self, fields: set[str]) -> DataFrame:
        out = self.own()
        if fields & {"width", "height", "file_size", "duration"}:
            out = out.join(self.items(), "post_id", "left")
        if fields & {"all_tags", "tags"}:
            out = out.join(self.tag_columns(), "post_id", "left")
        if "child_count" in fields:
            key = F.col("o_orderkey")
            counts = self.table("orders").where(key % 10 != 0).groupBy((key - key % 10).alias("post_id")).agg(F.count("*").alias("child_count"))
            out = out.join(counts, "post_id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))
        for name, kind in (("favcount", "click"), ("comment_count", "view")):
            if name in fields:
                counts = self.events(kind).groupBy("post_id").agg(F.count("*").alias(name))
                out = out.join(counts, "post_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
        if "description" in fields:
            out = out.join(self.table("documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("description")), "post_id", "left")
        if "sources" in fields:
            pages = self.table("pages").select(F.col("page_id").alias("post_id"), F.array("url").alias("sources"))
            out = out.join(pages, "post_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
        return out.select(*sorted(fields))

    def events(self, kind: str) -> DataFrame:
        rows = self.table("events").where(F.col("event_type") == kind)
        return rows.select(F.col("event_id").alias("post_id"), "user_id", F.col("ts").alias("created_at"), F.col("props").alias("body"), F.col("props").alias("reason"), F.when(F.col("value") >= 100, 1).otherwise(-1).alias("score"), (F.col("value") >= 100).alias("bumps"))

    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("user_id"), F.lower("c_name").alias("name"))

    def pools(self) -> DataFrame:
        names = self.table("supplier").select("s_suppkey", F.col("s_name").alias("name"))
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
        return lines.join(names, lines["l_suppkey"] == names["s_suppkey"], "left").select(F.col("l_orderkey").alias("post_id"), F.col("l_suppkey").alias("collection_id"), F.col("l_linenumber").alias("sequence"), "name")

    def sets(self) -> DataFrame:
        nations = self.table("nation").select(F.col("n_nationkey").alias("collection_id"), F.col("n_name").alias("name"))
        customers = self.table("customer").select("c_custkey", F.col("c_nationkey").alias("collection_id")).join(nations, "collection_id")
        orders = self.table("orders").select(F.col("o_orderkey").alias("post_id"), "o_custkey")
        return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select("post_id", "collection_id", "name")

    def categories(self) -> DataFrame:
        """name, category of the tags that posts have: tags() without its counts, which take every post's tag once."""
        known = self.edges(whole=True).where(F.col("category").isin("general", "species"))
        return known.groupBy(F.col("tag").alias("name")).agg(F.min("category").alias("category"))

    def tags(self) -> DataFrame:
        words = F.split("p_name", " ")
        counted = self.post_tags().where(F.col("category").isin("general", "species")).groupBy(F.col("tag").alias("name")).agg(F.min("category").alias("category"), F.count("*").alias("post_count"))
        more = self.spark.createDataFrame([("fastener", "species", 0), ("hardware", "species", 0)], "name string, category string, post_count long")
        return counted.unionByName(more.join(counted, "name", "left_anti"))

    def aliases(self) -> DataFrame:
        return self.spark.createDataFrame([(a, b, "active", None) for a, b in ALIASES], "antecedent string, consequent string, status string, updated_at timestamp")

    def implications(self) -> DataFrame:
        return self.spark.createDataFrame([(a, b, "active") for a, b in IMPLICATIONS], "antecedent string, consequent string, status string")

    def graph(self) -> TagGraph:
        return TagGraph(self.tags(), self.aliases(), self.implications())

    def catalog(self, graph: bool = False) -> Catalog:
        sidecars = {name: (lambda kind=kind: self.events(kind)) for name, kind in SIDECARS.items()}
        sidecars |= {"users": self.users, "pools": self.pools, "sets": self.sets, "post_tags": lambda: self.edges().select("post_id", "tag")}
        return Catalog(self.posts, sidecars, self.graph() if graph else None)


TAGS_SQL = """
ptags AS (
  SELECT DISTINCT l_orderkey AS post_id, category, tag FROM lineitem JOIN (
    SELECT p_partkey, 'general' AS category, lower(split_part(p_name, ' ', 1)) AS tag FROM part UNION ALL
    SELECT p_partkey, 'species', lower(split_part(p_name, ' ', 2)) FROM part UNION ALL
    SELECT p_partkey, 'meta', lower(p_type) FROM part UNION ALL
    SELECT p_partkey, 'artist', lower(p_brand) FROM part) ON l_partkey = p_partkey)"""

#: The same catalogue for DuckDB: WITH {POSTS_SQL} SELECT ...
POSTS_SQL = f"""{TAGS_SQL},
items AS (
  SELECT l_orderkey AS post_id, CAST(sum(l_quantity) AS INTEGER) AS width, CAST(count(*) * 10 AS INTEGER) AS height,
         CAST(floor(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100) AS BIGINT) AS file_size,
         date_diff('day', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))) AS duration
  FROM lineitem GROUP BY 1),
posts AS (
  SELECT o_orderkey AS post_id, CASE o_orderstatus WHEN 'F' THEN 's' WHEN 'O' THEN 'q' ELSE 'e' END AS rating,
         CAST(floor(o_totalprice / 1000) AS INTEGER) AS score, o_custkey AS uploader_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 97 END AS approver_id, o_orderdate AS created_at,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'png' WHEN '2' THEN 'jpg' WHEN '3' THEN 'gif' WHEN '4' THEN 'webm' WHEN '5' THEN 'mp4' END AS file_ext,
         md5(CAST(o_orderkey AS VARCHAR)) AS md5,
         CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey - o_orderkey % 10 END AS parent_post_id,
         {", ".join(f"o_orderkey % {n} = 0 AS {c}" for c, n in LOCKED.items())},
         width, height, file_size, duration,
         CAST((200 * CAST(width AS BIGINT) + height) // (2 * height) AS BIGINT) AS ratio,
         (SELECT count(*) FROM orders c WHERE c.o_orderkey % 10 <> 0 AND c.o_orderkey - c.o_orderkey % 10 = o.o_orderkey) AS child_count,
         (SELECT count(*) FROM events WHERE event_type = 'click' AND event_id = o.o_orderkey) AS favcount,
         (SELECT count(*) FROM events WHERE event_type = 'view' AND event_id = o.o_orderkey) AS comment_count,
         (SELECT text FROM documents WHERE doc_id = o.o_orderkey) AS description,
         (SELECT url FROM pages WHERE page_id = o.o_orderkey) AS url
  FROM orders o LEFT JOIN items ON post_id = o_orderkey)"""
