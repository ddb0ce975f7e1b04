"""One query per operator family, each with the SQL that must agree with it."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.functions import scalars as S
from tagmill.operators import merge
from tagmill.operators import tags as T
from tagmill.operators.state import fresh_folder
from tagmill.plans.compile import search
from tagmill.plans.explain import amended, canonical, explain
from tagmill.sources import export, paged, sidecars, snapshot
from tagmill.sources.star import ALIASES, IMPLICATIONS, POSTS_SQL, Star
from tagmill.streaming import events as streams
from tagmill.streaming import files, jobs, pages, runs

NOW = datetime(2001, 8, 1)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def sql(body: str) -> str:
    return f"WITH {POSTS_SQL}\n{body}"


def has(*tags: str) -> str:
    return "post_id IN (SELECT post_id FROM ptags WHERE tag IN ({}))".format(", ".join(f"'{t}'" for t in tags))


def event(kind: str, where: str = "true") -> str:
    return f"post_id IN (SELECT event_id FROM events WHERE event_type = '{kind}' AND {where})"


def found(name: str, text: str, where: str, graph: bool = False, deleted: bool = False, **options) -> None:
    """A search whose result is the ids; where is the same condition in SQL."""
    QUERIES[name] = lambda spark, d: search(text, Star(spark, d).catalog(graph), now=NOW, ordered=False, **options)
    hidden = "" if deleted else " AND NOT is_deleted"
    ORACLES[name] = sql(f"SELECT post_id FROM posts WHERE coalesce({where}, false){hidden}")


def ranked(name: str, text: str, order: str, where: str = "true", column: str = "post_id", limit: int = 20) -> None:
    """A search whose order and limit count: the ids with their places."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = search(f"{text} limit:{limit}", Star(spark, d).catalog(), now=NOW)
        # the limit's rows are one small partition, in order already
        return rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("_id")).cast("long")).select("place", "post_id")

    QUERIES[name] = run
    ORACLES[name] = sql(f"SELECT row_number() OVER (ORDER BY {order}) AS place, post_id FROM posts WHERE ({where}) AND NOT is_deleted QUALIFY place <= {limit}")


FASTENERS = ("bolt", "rod", "fastener")
# tags and groups
found("tag_required", "bolt", has("bolt"))
found("tag_and", "bolt small", f"{has('bolt')} AND {has('small')}")
found("tag_not", "bolt -small", f"{has('bolt')} AND NOT {has('small')}")
found("tag_loose_or", "~bolt ~rod", has("bolt", "rod"))
found("tag_loose_and_required", "small ~bolt ~rod", f"{has('small')} AND {has('bolt', 'rod')}")
found("tag_wildcard", "b*", "post_id IN (SELECT post_id FROM ptags WHERE tag LIKE 'b%' AND category IN ('general', 'species'))", graph=True)
found("tag_wildcard_negated", "-b*", "post_id NOT IN (SELECT post_id FROM ptags WHERE tag LIKE 'b%')")
found("tag_wildcard_loose", "~*ar ~bolt", f"(post_id IN (SELECT post_id FROM ptags WHERE tag LIKE '%ar') OR {has('bolt')})")
found("group_basic", "( ~bolt ~rod ~gear )", has("bolt", "rod", "gear"))
found("group_negated", "-( bolt small )", f"NOT ({has('bolt')} AND {has('small')})")
found("group_nested", "( ~( bolt -small ) ~( rod large ) ) rating:s", f"(({has('bolt')} AND NOT {has('small')}) OR ({has('rod')} AND {has('large')})) AND rating = 's'")
found("group_loose", "~( bolt -small ) ~rating:e", f"({has('bolt')} AND NOT {has('small')}) OR rating = 'e'")
found("group_multiple", "( ~bolt ~rod ) ( ~small ~large )", f"{has('bolt', 'rod')} AND {has('small', 'large')}")
found("alias_match", "tiny", has("small"), graph=True)
found("alias_chain", "whirl", has("gear"), graph=True)
found("implication_match", "fastener", has(*FASTENERS), graph=True)
found("implication_exclude", "hardware -fastener", f"{has('hardware', 'gear', *FASTENERS)} AND NOT {has(*FASTENERS)}", graph=True)
# numbers
found("id_list", "id:1,2,30,44", "post_id IN (1, 2, 30, 44)")
found("score_gt", "score:>100", "score > 100")
found("score_range", "score:25..50", "score BETWEEN 25 AND 50")
found("score_not_lte", "-score:<=100", "NOT coalesce(score <= 100, false)")
found("score_open", "score:100..", "score >= 100")
found("favcount_open", "favcount:1..", "favcount >= 1")
found("comment_count", "comment_count:>=1", "comment_count >= 1")
found("width_gt", "width:>150", "width > 150")
found("width_not", "-width:>150", "NOT coalesce(width > 150, false)")
found("height_lt", "height:<30", "height < 30")
found("tagcount", "tagcount:8..12", "(SELECT count(DISTINCT tag) FROM ptags t WHERE t.post_id = posts.post_id) BETWEEN 8 AND 12")
found("cat_tagcount", "gentags:3", "(SELECT count(*) FROM ptags t WHERE t.post_id = posts.post_id AND category = 'general') = 3")
found("cat_tagcount_zero", "lortags:0 arttags:<2", "(SELECT count(*) FROM ptags t WHERE t.post_id = posts.post_id AND category = 'artist') < 2")
found("cat_tagcount_meta", "metatags:1..2 spectags:>=1", "(SELECT count(*) FROM ptags t WHERE t.post_id = posts.post_id AND category = 'meta') BETWEEN 1 AND 2 AND (SELECT count(*) FROM ptags t WHERE t.post_id = posts.post_id AND category = 'species') >= 1")
found("cat_tagcount_none", "chartags:0 copytags:0 conttags:0 invtags:0 -arttags:0", "(SELECT count(*) FROM ptags t WHERE t.post_id = posts.post_id AND category = 'artist') > 0")
found("mpixels", "mpixels:0.005..0.02", "CAST(width AS DOUBLE) * height / 1e6 BETWEEN 0.005 AND 0.02")
found("ratio", "ratio:2.5..3.5", "ratio BETWEEN 250 AND 350")
found("ratio_pair", "ratio:5:2", "ratio = 250")
found("filesize_range", "filesize:100KB..200KB", "file_size BETWEEN 102400 AND 204800")
found("filesize_tolerance", "filesize:100KB", "file_size BETWEEN 97280 AND 107520", tolerance=True)
found("duration", "duration:>120", "duration > 120")
# equality
found("rating_s", "rating:safe", "rating = 's'")
found("rating_not", "-rating:e", "rating <> 'e'")
found("filetype", "type:png", "file_ext = 'png'")
found("md5", "md5:A87FF679A2F3E71D9181A67B7542122C", "md5 = 'a87ff679a2f3e71d9181a67b7542122c'")
# dates
found("date_day", "date:1998-04-27", "created_at >= DATE '1998-04-27' AND created_at < DATE '1998-04-28'")
found("date_named", "date:april/27/1998..may/3/1998", "created_at >= DATE '1998-04-27' AND created_at < DATE '1998-05-04'")
found("date_month_range", "date:1997-01-01..1997-01-31", "created_at >= DATE '1997-01-01' AND created_at < DATE '1997-02-01'")
found("date_open", "date:2001-01-01..", "created_at >= DATE '2001-01-01'")
found("date_relative", "date:5_yestermonths_ago", "created_at >= DATE '2001-03-01' AND created_at < DATE '2001-04-01'")
found("date_year_to_month", "date:year..month", "created_at >= DATE '2000-08-01' AND created_at < TIMESTAMP '2001-08-01 00:00:00.000001'")
found("date_today", "date:..today -date:..2001-07-01", "created_at < DATE '2001-08-02' AND NOT created_at < DATE '2001-07-02'")
found("date_yesteryear", "date:yesteryear", "created_at >= DATE '2000-01-01' AND created_at < DATE '2001-01-01'")
found("date_weeks_ago", "date:40_weeks_ago..30_weeks_ago", "created_at >= DATE '2000-10-25' AND created_at < DATE '2001-01-04'")
found("date_reversed", "date:1998-05-01..1998-04-20", "created_at >= DATE '1998-04-20' AND created_at < DATE '1998-05-02'")
found("date_yesterweek", "date:yesterweek", "created_at >= DATE '2001-07-23' AND created_at < DATE '2001-07-30'")
# text
found("source_contains", "source:*example.com*", "contains(lower(url), 'example.com')")
found("source_suffix", "source:*.html", "ends_with(lower(url), '.html')")
found("source_prefix", "source:https*", "starts_with(lower(url), 'https')")
found("source_glob", "source:https://*/en/*7", "regexp_full_match(lower(url), 'https://.*/en/.*7')")
found("source_none", "source:none", "url IS NULL")
found("description_contains", 'description:"the re"', "contains(lower(description), 'the re')")
found("hassource", "hassource:true", "url IS NOT NULL")
found("hasdescription", "hasdescription:false", "coalesce(length(description), 0) = 0")
found("note_text", 'note:"k"', event("signup", "contains(lower(props), 'k')"))
found("delreason", "delreason:*1*", event("error", "contains(lower(props), '1')"), deleted=True)
# relations, flags, status
found("ischild", "ischild:true", "parent_post_id IS NOT NULL")
found("isparent", "isparent:true", "child_count > 0")
found("parent_id", "parent:10", "parent_post_id = 10")
found("parent_none", "parent:none", "parent_post_id IS NULL")
found("child_none", "child:none", "child_count = 0")
found("locked_rating", "locked:rating", "rating_locked")
found("locked_not", "-locked:rating", "NOT rating_locked")
found("notelocked", "notelocked:false", "NOT note_locked")
found("statuslocked", "statuslocked:true", "status_locked")
found("artverified", "artverified:true", "artist_verified")
found("pending_replacements", "pending_replacements:true", "pending_replacements")
found("deleted_default", "rating:q", "rating = 'q'")
found("status_deleted", "status:deleted", "is_deleted", deleted=True)
found("status_not_deleted", "-status:deleted", "NOT is_deleted", deleted=True)
found("status_active", "status:active", "NOT is_deleted AND NOT is_pending AND NOT is_flagged", deleted=True)
found("status_modqueue", "status:modqueue", "is_pending OR is_flagged")
found("status_any", "status:any score:>300", "score > 300", deleted=True)
found("status_in_group", "status:any ( ~( status:pending ) ~( status:flagged ) )", "is_pending OR is_flagged", deleted=True)
# users and collections
found("user_name", "user:Customer#000000005", "uploader_id IN (SELECT c_custkey FROM customer WHERE lower(c_name) = 'customer#000000005')")
found("user_id", "user_id:17", "uploader_id = 17")
found("user_bang", "user:!17", "uploader_id = 17")
found("approver_id", "approver:!5", "approver_id = 5")
found("approver_name", "approver:Customer#000000007 -rating:s", "approver_id IN (SELECT c_custkey FROM customer WHERE lower(c_name) = 'customer#000000007') AND rating <> 's'")
found("user_name_or", "~user:Customer#000000005 ~score:>450", "uploader_id IN (SELECT c_custkey FROM customer WHERE lower(c_name) = 'customer#000000005') OR score > 450")
found("user_me", "user:me", "uploader_id = 21", viewer=21)
found("commenter", "commenter:!5", event("view", "user_id = 5"))
found("commenter_or", "~commenter:!5 ~score:>400", f"{event('view', 'user_id = 5')} OR score > 400")
found("noter", "noter:!7", event("signup", "user_id = 7"))
found("fav", "fav:!3", event("click", "user_id = 3"))
found("fav_not", "-fav:!3 rating:s", f"NOT {event('click', 'user_id = 3')} AND rating = 's'")
found("deletedby", "deletedby:!9", event("error", "user_id = 9"), deleted=True)
found("voted", "voted:anything", event("purchase"))
found("voted_up", "votedup:anything", event("purchase", "value >= 100"))
found("voted_down", "-votedup:x voted:x", f"{event('purchase')} AND NOT {event('purchase', 'value >= 100')}")
found("pool_id", "pool:4", "post_id IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 4)")
found("pool_name", "pool:supplier#000000004", "post_id IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE lower(s_name) = 'supplier#000000004')")
found("inpool", "inpool:true", "post_id IN (SELECT l_orderkey FROM lineitem)")
found("inpool_false", "inpool:false", "post_id NOT IN (SELECT l_orderkey FROM lineitem)")
found("set_name", "set:nation_3", "uploader_id IN (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE lower(replace(n_name, ' ', '_')) = 'nation_3')")
found("set_id", "set:3", "uploader_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
found("unknown_metatag", "frobnicate:yes", "false")
# orders and limits
ranked("order_default", "bolt", "post_id DESC", has("bolt"))
ranked("order_score", "order:score", "score DESC NULLS LAST, post_id DESC")
ranked("order_score_reversed", "-order:score", "score ASC NULLS FIRST, post_id")
ranked("order_ratio", "order:ratio", "ratio DESC NULLS LAST, post_id DESC")
ranked("order_portrait", "order:portrait width:>0", "ratio ASC NULLS FIRST, post_id", "width > 0")
ranked("order_tagcount", "order:tagcount width:>0", "coalesce((SELECT count(DISTINCT tag) FROM ptags t WHERE t.post_id = posts.post_id), 0) DESC, post_id DESC", "width > 0")
ranked("order_created_asc", "order:created_asc", "created_at ASC NULLS FIRST, post_id")
ranked("order_duration", "order:duration", "duration DESC NULLS LAST, post_id DESC")
ranked("order_filesize_asc", "order:filesize_asc filesize:>0", "file_size ASC NULLS FIRST, post_id", "file_size > 0")
ranked("order_gentags", "order:gentags", "(SELECT count(*) FROM ptags t WHERE t.post_id = posts.post_id AND category = 'general') DESC, post_id DESC")
ranked("order_md5", "order:md5", "md5 DESC, post_id DESC")
ranked("order_comment", "order:comment", "(SELECT max(ts) FROM events WHERE event_type = 'view' AND event_id = posts.post_id) DESC NULLS LAST, post_id DESC")
ranked("order_random_seeded", "order:random randseed:123", "md5(post_id || ':123'), post_id")
ranked("order_random_unseeded", "order:random", "md5(post_id || ':0'), post_id")
ranked("order_mpixels", "order:mpixels width:>0", "CAST(width AS DOUBLE) * height / 1e6 DESC, post_id DESC", "width > 0")
ranked("order_change", "order:change", "created_at DESC, post_id DESC")
ranked("order_updated_asc", "order:updated_asc", "created_at ASC, post_id")
ranked("order_note", "order:note", "(SELECT max(ts) FROM events WHERE event_type = 'signup' AND event_id = posts.post_id) DESC NULLS LAST, post_id DESC")
ranked("order_comment_bumped", "order:comment_bumped", "(SELECT max(ts) FROM events WHERE event_type = 'view' AND value >= 100 AND event_id = posts.post_id) DESC NULLS LAST, post_id DESC")
ranked("order_spectags_asc", "order:spectags_asc", "(SELECT count(*) FROM ptags t WHERE t.post_id = posts.post_id AND category = 'species') ASC, post_id")
ranked("order_landscape", "order:landscape width:>0", "ratio DESC, post_id DESC", "width > 0")
ranked("order_limit", "order:favcount limit:5", "favcount DESC, post_id DESC", limit=5)


def keyed(name: str, oracle: str | None):
    def add(run):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


found("candidate_superset", "score:>100 -fav:!3 ( ~commenter:!5 ~rating:s )", "score > 100")


def _candidate(spark: SparkSession, d: str) -> DataFrame:
    """No sidecar at hand: what they would decide is left open."""
    catalog = Star(spark, d).catalog()
    catalog.sidecars = {}
    return search("score:>100 -fav:!3 ( ~commenter:!5 ~rating:s )", catalog, now=NOW, candidate=True, ordered=False)


QUERIES["candidate_superset"] = _candidate
_VALUES = {"aliases": ", ".join(f"('{a}', '{b}')" for a, b in ALIASES), "implications": ", ".join(f"('{a}', '{b}')" for a, b in IMPLICATIONS)}
_CLOSED = f"""RECURSIVE e(a, b) AS (VALUES {_VALUES["implications"]}),
c(a, b, depth) AS (SELECT a, b, 1 FROM e UNION ALL SELECT c.a, e.b, depth + 1 FROM c JOIN e ON c.b = e.a WHERE depth < 16)"""


@keyed("closure_table", f"WITH {_CLOSED} SELECT a AS antecedent, b AS consequent, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY a, b")
def _closure(spark, d):
    return T.closure(Star(spark, d).implications())


@keyed("closure_descendants", f"WITH {_CLOSED} SELECT a AS name, CAST(min(depth) AS INTEGER) AS depth FROM c WHERE b = 'hardware' GROUP BY a")
def _descendants(spark, d):
    star = Star(spark, d)
    return T.descendants(T.closure(star.implications()), star.tags(), "hardware").select("name", "depth")


@keyed("alias_canonical", f"""WITH RECURSIVE e(a, b) AS (VALUES {_VALUES["aliases"]}),
c(a, b, hops) AS (SELECT a, b, 1 FROM e UNION ALL SELECT c.a, e.b, hops + 1 FROM c JOIN e ON c.b = e.a WHERE hops < 16)
SELECT a AS antecedent, arg_max(b, hops) AS canonical, CAST(max(hops) AS INTEGER) AS hops FROM c GROUP BY a""")  # fmt: skip
def _aliases(spark, d):
    return T.canonical_aliases(Star(spark, d).aliases())


@keyed("wildcard_expand", sql("SELECT tag AS name, count(DISTINCT post_id) AS post_count FROM ptags WHERE category IN ('general', 'species') AND tag LIKE '%r%' GROUP BY tag ORDER BY 2 DESC, 1 LIMIT 5"))
def _expand(spark, d):
    return T.expand(Star(spark, d).tags(), "*r*", 4).select("name", "post_count")


@keyed("implied_membership", sql("""SELECT DISTINCT post_id, t.tag FROM (SELECT post_id, tag FROM ptags UNION ALL
SELECT post_id, c.b FROM ptags JOIN (VALUES ('bolt', 'fastener'), ('rod', 'fastener'), ('bolt', 'hardware'), ('rod', 'hardware'), ('gear', 'hardware'), ('fastener', 'hardware')) c(a, b) ON tag = c.a) t"""))
def _implied_all(spark, d):
    star = Star(spark, d)
    return T.implied_membership(star.edges(whole=True), T.closure(star.implications()))  # made distinct once, at the end


@keyed("tags_of_posts", sql("SELECT post_id, k.category, string_agg(DISTINCT tag, ',' ORDER BY tag) AS names FROM ptags JOIN (SELECT tag, min(category) AS category FROM ptags WHERE category IN ('general', 'species') GROUP BY 1) k USING (tag) GROUP BY 1, 2"))
def _tags_of(spark, d):
    star = Star(spark, d)
    rows = T.tags_of_posts(star.edges(whole=True).select("post_id", "tag"), star.categories())
    return rows.withColumn("names", F.array_join("names", ","))


@keyed("tag_unresolved", "SELECT * FROM (VALUES ('tiny', 'small'), ('huge', 'large'), ('spinner', 'gear'), ('whirl', 'spinner')) t(antecedent, consequent)")
def _unresolved(spark, d):
    star = Star(spark, d)
    return T.unresolved(star.aliases().select("antecedent", "consequent"), star.tags())


# a tag graph made from the customers: two ways on from every tag, cycles, inactive edges, ties
_GRAPH = """RECURSIVE e AS (SELECT DISTINCT 't' || (c_custkey % 300) AS a, 't' || ((c_custkey % 300) * 2 + 1 + CASE WHEN c_custkey % 7 = 0 THEN 5 ELSE 0 END) % 300 AS b FROM customer WHERE c_custkey % 11 <> 0),
c(a, b, depth) AS (SELECT a, b, 1 FROM e WHERE a <> b UNION SELECT c.a, e.b, depth + 1 FROM c JOIN e ON c.b = e.a AND e.a <> e.b WHERE depth < 40),
closed AS (SELECT a, b, CAST(min(depth) AS INTEGER) AS depth FROM c WHERE a <> b GROUP BY a, b),
tags AS (SELECT 't' || (c_custkey % 300) AS name, count(*) AS post_count FROM customer GROUP BY 1)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tags, aliases, implications."""
    k = F.col("c_custkey")
    rows = Star(spark, d).table("customer").select(k, (k % 300).alias("t"), (k % 200).alias("a"))
    name = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    tags = rows.groupBy(name("t", F.col("t")).alias("name")).agg(F.count("*").alias("post_count"))
    onward = (F.col("t") * 2 + 1 + F.when(k % 7 == 0, 5).otherwise(0)) % 300
    status = F.when(k % 11 == 0, "deleted").otherwise("active").alias("status")
    implications = rows.select(name("t", F.col("t")).alias("antecedent"), name("t", onward).alias("consequent"), status)
    when = F.when(k % 5 > 0, F.timestamp_seconds(k % 5 * 3600)).alias("updated_at")
    aliases = rows.select(name("a", F.col("a")).alias("antecedent"), name("a", (F.col("a") * 3 + 1 + k % 2) % 200).alias("consequent"), status, when)
    return tags, aliases, implications


@keyed("closure_cycles", f"WITH {_GRAPH} SELECT a AS antecedent, b AS consequent, depth FROM closed")
def _closure_cycles(spark, d):
    return T.closure(_graph(spark, d)[2])


@keyed("closure_ancestors", f"WITH {_GRAPH} SELECT row_number() OVER (ORDER BY depth, post_count DESC, name) AS place, name, depth, post_count FROM closed JOIN tags ON name = b WHERE a = 't7'")
def _ancestors(spark, d):
    tags, _, implications = _graph(spark, d)
    rows = T.ancestors(T.closure(implications), tags, "t7")  # at most 300
    return rows.select(F.row_number().over(Window.orderBy("depth", F.desc("post_count"), "name")).cast("long").alias("place"), "name", "depth", "post_count")


@keyed("alias_cycles", """WITH RECURSIVE rows AS (SELECT 'a' || (c_custkey % 200) AS a, 'a' || ((c_custkey % 200) * 3 + 1 + c_custkey % 2) % 200 AS b, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 END AS stamp FROM customer WHERE c_custkey % 11 <> 0),
e AS (SELECT a, b FROM rows QUALIFY row_number() OVER (PARTITION BY a ORDER BY stamp DESC NULLS LAST, b) = 1),
c(a, b, hops, seen) AS (SELECT a, b, 1, [a, b] FROM e UNION ALL SELECT c.a, e.b, hops + 1, list_append(seen, e.b) FROM c JOIN e ON c.b = e.a AND NOT list_contains(seen, e.b) WHERE hops < 16)
SELECT a AS antecedent, arg_max(b, hops) AS canonical, CAST(max(hops) AS INTEGER) AS hops FROM c GROUP BY a""")
def _alias_cycles(spark, d):
    return T.canonical_aliases(_graph(spark, d)[1])


@keyed("graph_report", f"""WITH {_GRAPH} SELECT (SELECT count(*) FROM tags) AS tags, (SELECT count(*) FROM customer) AS implications, (SELECT count(*) FROM closed) AS closure""")
def _graph_report(spark, d):
    report = T.TagGraph(*_graph(spark, d)).report()
    return spark.createDataFrame([(report["tags"], report["implications"], report["closure"])], "tags long, implications long, closure long")


@keyed("packed_ids", """SELECT l_orderkey AS post_id, string_agg(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2), '' ORDER BY id) AS packed, count(*) AS n
FROM (SELECT DISTINCT l_orderkey, l_partkey AS id, printf('%08X', l_partkey) AS h FROM lineitem) GROUP BY 1""")
def _packed(spark, d):
    lines = Star(spark, d).table("lineitem").groupBy(F.col("l_orderkey").alias("post_id")).agg(S.pack_ids(F.collect_set("l_partkey")).alias("packed"))
    return lines.select("post_id", F.hex("packed").alias("packed"), F.size(S.unpack_ids(F.col("packed"))).cast("long").alias("n"))


# joins, merges, set operations over the raw tables
@keyed("hash_collisions", "SELECT p_name AS name, p_brand, b.stored FROM part JOIN (SELECT p_name AS n, min(p_brand) AS stored FROM part GROUP BY 1) b ON n = p_name AND p_brand <> stored GROUP BY ALL")
def _collisions(spark, d):
    part = Star(spark, d).table("part").select(F.col("p_name").alias("name"), "p_brand")
    return merge.collisions(part, part.groupBy("name").agg(F.min("p_brand").alias("p_brand")), "name", "p_brand")


@keyed("existing_only", "SELECT event_id AS post_id, user_id FROM events WHERE event_type = 'view' AND event_id IN (SELECT o_orderkey FROM orders)")
def _existing(spark, d):
    star = Star(spark, d)
    return merge.existing_only(star.events("view").select("post_id", "user_id"), star.own())


@keyed("hashed_urls", "SELECT sha256(url) AS url_hash, min(url) AS url FROM pages WHERE url IS NOT NULL GROUP BY 1")
def _urls(spark, d):
    pages = Star(spark, d).table("pages").select(F.array_compact(F.array("url")).alias("sources"))
    return sidecars.hashed_urls(pages).select(F.lower(F.col("url_hash")).alias("url_hash"), "url")


@keyed("count_matching", sql("SELECT count(*) AS n FROM posts WHERE score > 100 AND rating = 's' AND NOT is_deleted"))
def _counted(spark, d):
    return search("score:>100 rating:s", Star(spark, d).catalog(), now=NOW, ordered=False).agg(F.count("*").alias("n"))


@keyed("replace_members", """SELECT l_suppkey AS collection_id, CAST(l_linenumber AS INTEGER) AS sequence, l_orderkey AS post_id FROM lineitem WHERE l_suppkey % 3 <> 0
UNION ALL SELECT c_custkey, CAST(c_custkey % 4 AS INTEGER), c_nationkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey <= (SELECT max(s_suppkey) FROM supplier)""")
def _members(spark, d):
    star = Star(spark, d)
    edges = star.table("lineitem").select(F.col("l_suppkey").alias("collection_id"), F.col("l_linenumber").cast("int").alias("sequence"), F.col("l_orderkey").alias("post_id"))
    owners = star.table("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("collection_id"))
    lists = owners.join(star.table("customer"), F.col("collection_id") == F.col("c_custkey"), "left")
    empty = F.array().cast("array<bigint>")
    filler = F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 4).cast("int")), lambda k: F.when(k == F.col("c_custkey") % 4, F.col("c_nationkey").cast("long")))
    incoming = lists.select("collection_id", F.when(F.col("c_custkey").isNull(), empty).otherwise(filler).alias("post_ids"))
    return sidecars.replace_members(edges, incoming).where("post_id is not null").select("collection_id", "sequence", "post_id")


@keyed("ingest_merge_latest", """SELECT c_custkey AS user_id, coalesce(e.n, 0) AS n, CASE WHEN e.n IS NULL THEN 'old' ELSE 'new' END AS origin FROM customer
LEFT JOIN (SELECT user_id, arg_max(CAST(floor(value) AS BIGINT), event_id) AS n FROM events GROUP BY 1) e ON e.user_id = c_custkey""")  # fmt: skip
def _upsert(spark, d):
    star = Star(spark, d)
    old = star.users().select("user_id", F.lit(0).cast("long").alias("n"), F.lit("old").alias("origin"))
    new = star.table("events").select("user_id", F.floor("value").cast("long").alias("n"), F.lit("new").alias("origin"), "event_id")
    return merge.upsert(old, new, ["user_id"], "event_id")


@keyed("edge_replace", """SELECT l_orderkey AS post_id, CAST(l_suppkey AS BIGINT) AS tag FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_linenumber = 1
UNION ALL SELECT DISTINCT l_orderkey, CAST(l_partkey AS BIGINT) FROM lineitem WHERE l_orderkey % 7 = 0""")  # fmt: skip
def _edges(spark, d):
    rows = Star(spark, d).table("lineitem")
    old = rows.where("l_linenumber = 1").select(F.col("l_orderkey").alias("post_id"), F.col("l_suppkey").cast("long").alias("tag"))
    new = rows.where("l_orderkey % 7 = 0").select(F.col("l_orderkey").alias("post_id"), F.col("l_partkey").cast("long").alias("tag"))
    return merge.replace_edges(old, new, "post_id")


@keyed("insert_or_ignore", "SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT k, v FROM (SELECT c_custkey % 40 AS k, min(c_mktsegment) AS v FROM customer GROUP BY 1) WHERE k NOT IN (SELECT n_nationkey FROM nation)")
def _ignore(spark, d):
    star = Star(spark, d)
    old = star.table("nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"))
    new = star.table("customer").groupBy((F.col("c_custkey") % 40).alias("k")).agg(F.min("c_mktsegment").alias("v"))
    return merge.insert_missing(old, new, ["k"])


@keyed("dup_hash_check", "SELECT p_name AS name, count(DISTINCT p_brand) AS kinds, min(p_brand) AS first FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def _conflicts(spark, d):
    return merge.conflicting_hashes(Star(spark, d).table("part").withColumnRenamed("p_name", "name"), "name", "p_brand")


@keyed("new_vs_existing", "SELECT event_id AS post_id FROM events WHERE event_type = 'signup' AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'signup' AND event_id % 3 = 0)")
def _new(spark, d):
    rows = Star(spark, d).events("signup").select("post_id")
    return merge.new_rows(rows, rows.where("post_id % 3 = 0"), ["post_id"])


@keyed("import_report", "SELECT count(*) AS seen, count(*) FILTER (value >= 10) AS accepted, count(*) FILTER (NOT value >= 10) AS rejected, count(*) FILTER (value >= 10 AND event_id % 2 = 1) AS inserted, count(*) FILTER (value >= 10 AND event_id % 2 = 0) AS matched FROM events")
def _report(spark, d):
    rows = Star(spark, d).table("events").select("event_id", (F.col("value") >= 10).alias("valid"))
    return merge.import_report(rows, rows.where("event_id % 2 = 0"), "valid", ["event_id"])


@keyed("candidate_merge", "SELECT post_id, min(list) AS list FROM (SELECT event_id AS post_id, 0 AS list FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 1 FROM events WHERE event_id % 5 = 0) GROUP BY 1")
def _merged(spark, d):
    rows = Star(spark, d).table("events").select(F.col("event_id").alias("post_id"), "event_type", F.col("event_id").alias("position"))
    out = merge.merge_candidates(rows.where("event_type = 'click'").drop("event_type"), rows.where("post_id % 5 = 0").drop("event_type"))
    return out.select("post_id", F.col("_list").alias("list"))


@keyed("child_counts", "SELECT o_orderkey AS post_id, (SELECT count(*) FROM orders c WHERE c.o_orderkey % 10 <> 0 AND c.o_orderkey - c.o_orderkey % 10 = o.o_orderkey) AS child_count FROM orders o")
def _children(spark, d):
    return merge.child_counts(Star(spark, d).own().select("post_id", "parent_post_id")).select("post_id", "child_count")


@keyed("pool_order", "SELECT l_suppkey AS pool, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey) - 1 AS INTEGER) AS position, l_orderkey AS post_id FROM lineitem")
def _pool_all(spark, d):
    rows = Star(spark, d).pools().select(F.col("collection_id").alias("pool"), "sequence", "post_id")
    return rows.select("pool", (F.row_number().over(Window.partitionBy("pool").orderBy("sequence", "post_id")) - 1).alias("position"), "post_id")


@keyed("embedded_ids_join", "SELECT o_custkey AS owner_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS position, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders")
def _embedded_all(spark, d):
    orders = Star(spark, d).table("orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").cast("long").alias("price"))
    lists = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return merge.embedded(lists, "id", "ids", orders.select("o_orderkey", "price"), "o_orderkey").select("owner_id", "position", "price")


@keyed("scalar_functions", """SELECT o_orderkey AS post_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '/original.png' AS path,
substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2) || '/' || substr(md5(CAST(o_orderkey AS VARCHAR)), 3, 2) || '/' || md5(CAST(o_orderkey AS VARCHAR)) || '.png' AS cdn,
sha256(CAST(o_orderkey AS VARCHAR)) AS digest, epoch_ms(o_orderdate) AS ms,
CAST((o_orderkey % 17 = 0)::INT + 2 * (o_orderkey % 13 = 0)::INT + 4 * (o_orderkey % 11 = 0)::INT + 8 * (o_orderkey % 7 = 0)::INT + 16 * (o_orderkey % 5 = 0)::INT + 32 * (o_orderkey % 3 = 0)::INT + 64 * (o_orderkey % 2 = 0)::INT AS INTEGER) AS flags FROM orders""")  # fmt: skip
def _scalars(spark, d):
    posts = Star(spark, d).own()
    return posts.select(
        "post_id",
        S.file_path(F.col("post_id"), F.lit("original"), F.lit("png")).alias("path"),
        S.md5_path(F.col("md5"), F.lit("png")).alias("cdn"),
        F.sha2(F.col("post_id").cast("string").cast("binary"), 256).alias("digest"),
        S.epoch_ms(F.col("created_at")).alias("ms"),
        S.packed_flags(*(F.col(c) for c in S.FLAG_BITS)).alias("flags"),
    )


# ingest
_PAYLOAD_SQL = """SELECT o_orderkey AS post_id, CASE o_orderstatus WHEN 'F' THEN 's' WHEN 'O' THEN 'q' ELSE 'x' END AS rating,
CAST(floor(o_totalprice / 1000) AS INTEGER) AS score, o_orderkey % 9 <> 0 AS has_file FROM orders"""


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Orders as JSON payloads, some without a file, some with an unknown rating, some that are no JSON."""
    o = Star(spark, d).table("orders")
    file = F.when(F.col("o_orderkey") % 9 != 0, F.struct(F.lit("png").alias("ext"), F.lit(4).alias("width"), F.lit(3).alias("height")))
    rating = F.when(F.col("o_orderstatus") == "F", "s").when(F.col("o_orderstatus") == "O", "questionable").otherwise("x")
    total = F.struct(F.floor(F.col("o_totalprice") / 1000).cast("int").alias("total"))
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), rating.alias("rating"), file.alias("file"), total.alias("score"), (-F.col("o_orderkey") % 3).alias("fav_count")))
    wrapped = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"post":'), body, F.lit("}"))).otherwise(body)
    return o.select(F.when(F.col("o_orderkey") % 50 == 0, "not json").otherwise(wrapped).alias("value"))


@keyed("ingest_payloads", f"SELECT post_id, rating, score, CAST(0 AS BIGINT) AS favcount FROM ({_PAYLOAD_SQL}) WHERE post_id % 50 <> 0 AND has_file AND rating <> 'x'")
def _ingested(spark, d):
    return snapshot.accepted(snapshot.from_payloads(_payloads(spark, d))).select("post_id", "rating", "score", F.col("favcount").cast("long").alias("favcount"))


@keyed("ingest_rejects", f"""SELECT CASE WHEN post_id % 50 = 0 THEN 'post id is no number' WHEN NOT has_file THEN 'file is missing' ELSE 'rating is unknown' END AS reason, count(*) AS n
FROM ({_PAYLOAD_SQL}) WHERE post_id % 50 = 0 OR NOT has_file OR rating = 'x' GROUP BY 1""")  # fmt: skip
def _rejected(spark, d):
    return snapshot.rejections(snapshot.from_payloads(_payloads(spark, d))).groupBy("reason").agg(F.count("*").alias("n"))


@keyed("latest_shared_date", """SELECT CAST(max(day) AS VARCHAR) AS date FROM (SELECT CAST(ts AS DATE) AS day FROM events
WHERE event_type IN ('click', 'view', 'error') GROUP BY 1 HAVING count(DISTINCT event_type) = 3)""")  # fmt: skip
def _shared(spark, d):
    files = Star(spark, d).table("events").select(F.col("event_type").alias("kind"), F.to_date("ts").cast("string").alias("date"))
    return snapshot.latest_shared(files, ("click", "view", "error"))


@keyed("unknown_tags", sql("SELECT tag AS name, count(*) AS posts FROM (SELECT DISTINCT post_id, tag FROM ptags) WHERE tag NOT IN (SELECT DISTINCT tag FROM ptags WHERE category IN ('general', 'species')) GROUP BY 1"))
def _unknown(spark, d):
    star = Star(spark, d)
    return snapshot.unknown_tags(star.posts({"post_id", "all_tags"}), star.tags())


# jobs and coverage
AT = datetime(2024, 1, 1, 12)
_JOBS_SQL = """jobs AS (SELECT event_id AS job_id, user_id % 7 AS run_id,
CASE event_type WHEN 'click' THEN 'fetch_page' WHEN 'view' THEN 'enrich_notes' WHEN 'purchase' THEN 'download_sample' ELSE 'evaluate_query' END AS kind,
CASE event_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'leased' WHEN 2 THEN 'done' ELSE CASE WHEN user_id % 7 < 3 THEN 'failed' ELSE 'done' END END AS state,
CAST(event_id % 5 AS INTEGER) AS priority, TIMESTAMP '2024-01-01 12:00:00' + to_minutes(CAST(event_id % 21 - 10 AS INTEGER)) AS due FROM events)"""


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    e = Star(spark, d).table("events")
    shift = F.expr("make_interval(0, 0, 0, 0, 0, cast(event_id % 21 - 10 as int))")
    due = F.lit(AT) + shift
    kind = F.when(F.col("event_type") == "click", "fetch_page").when(F.col("event_type") == "view", "enrich_notes").when(F.col("event_type") == "purchase", "download_sample").otherwise("evaluate_query")
    state = F.when(F.expr("event_id % 4 = 0"), "ready").when(F.expr("event_id % 4 = 1"), "leased").when(F.expr("event_id % 4 = 3 and user_id % 7 < 3"), "failed").otherwise("done")
    none = F.lit(None)
    return e.select(
        F.col("event_id").alias("job_id"), (F.col("user_id") % 7).alias("run_id"), kind.alias("kind"), F.to_json(F.struct(F.col("event_id").alias("post_id"))).alias("payload"), state.alias("state"),
        (F.col("event_id") % 5).cast("int").alias("priority"), due.alias("available_at"), F.lit(1).alias("attempts"), F.lit(3).alias("max_attempts"),
        none.cast("string").alias("locked_by"), due.alias("lease_until"), none.cast("string").alias("last_error"), F.lit(AT).alias("updated_at"),
    )


_CLAIMABLE = "state IN ('ready', 'leased') AND due <= TIMESTAMP '2024-01-01 12:00:00'"


@keyed("queue_claim", f"WITH {_JOBS_SQL} SELECT job_id, priority FROM jobs WHERE {_CLAIMABLE} ORDER BY priority DESC, due, job_id LIMIT 25")
def _claim(spark, d):
    return jobs.claim(_jobs(spark, d), AT, "w1", n=25).where("locked_by = 'w1'").select("job_id", "priority")


@keyed("queue_events", f"""WITH {_JOBS_SQL}, taken AS (SELECT job_id FROM jobs WHERE {_CLAIMABLE} ORDER BY priority DESC, due, job_id LIMIT 25)
SELECT job_id, 'claimed' AS event, 'w1' AS message FROM taken UNION ALL
SELECT job_id, 'cancelled', NULL FROM jobs WHERE state IN ('ready', 'leased') AND run_id = 3 AND job_id NOT IN (SELECT job_id FROM taken)""")
def _events(spark, d):
    before = _jobs(spark, d)
    after = jobs.claim(before, AT, "w1", n=25)
    after = jobs.cancel(after, (F.col("run_id") == 3) & F.col("locked_by").isNull(), AT)
    return jobs.events(before, after).select("job_id", "event", "message")


@keyed("next_pages", """SELECT CAST(o_custkey AS VARCHAR) AS query, CAST(o_orderkey % 50 + 1 AS INTEGER) AS page, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 320 ELSE least(320, o_orderkey % 1000 - 320) END AS INTEGER) AS page_size
FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 1000 > 320)""")
def _pages(spark, d):
    k = F.col("o_orderkey")
    fetched = Star(spark, d).table("orders").select(F.col("o_custkey").cast("string").alias("query"), (k % 50).cast("int").alias("page"), F.lit(320).alias("page_size"), F.when(k % 3 != 0, (k % 1000).cast("int")).alias("remaining"), F.when(k % 7 != 0, 320).otherwise(319).alias("posts"))
    return pages.next_page(fetched).select("query", "page", "page_size")


@keyed("file_claims", """SELECT o_orderkey AS post_id, CASE WHEN place <= 40 THEN 'downloading' ELSE 'pending' END AS state FROM (
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey % 4 = 1) UNION ALL SELECT o_orderkey, 'downloaded' FROM orders WHERE o_orderkey % 4 = 2""")
def _files(spark, d):
    posts = Star(spark, d).own().select("post_id", F.lit("original").alias("variant"), F.col("file_ext").alias("ext"), F.lit("u").alias("source_url"), "md5")
    table = files.want(spark.createDataFrame([], files.SCHEMA), posts.where("post_id % 4 = 2"), AT)
    done = posts.where("post_id % 4 = 2").select("post_id", "variant", F.lit("p").alias("local_path"), F.lit(7).cast("long").alias("bytes_written"), F.upper("md5").alias("checksum"))
    table = files.fetched(table, done, AT)
    table = files.want(table, posts.where("post_id % 4 in (1, 2)"), AT)
    return files.claim(table, AT, 40).select("post_id", "state")


@keyed("queue_claim_kinds", f"WITH {_JOBS_SQL} SELECT job_id, priority FROM jobs WHERE {_CLAIMABLE} AND kind = 'fetch_page' ORDER BY priority DESC, due, job_id LIMIT 8")
def _claim_kinds(spark, d):
    return jobs.next_jobs(_jobs(spark, d), AT, 8, ["fetch_page"]).select("job_id", "priority")


@keyed("queue_metrics", f"""WITH {_JOBS_SQL} SELECT run_id, count(*) AS jobs, count(*) FILTER (state IN ('ready', 'leased')) AS pending, count(*) FILTER (state = 'done') AS done,
count(*) FILTER (state = 'failed') AS failed, CASE WHEN count(*) FILTER (state = 'failed') > 0 THEN 'paused' WHEN count(*) FILTER (state IN ('ready', 'leased')) > 0 THEN 'pending' ELSE 'success' END AS state FROM jobs GROUP BY 1""")  # fmt: skip
def _metrics(spark, d):
    return jobs.metrics(_jobs(spark, d)).select("run_id", "jobs", "pending", "done", "failed", "state")


@keyed("job_family_counts", f"WITH {_JOBS_SQL} SELECT CASE kind WHEN 'fetch_page' THEN 1 WHEN 'enrich_notes' THEN 2 WHEN 'download_sample' THEN 4 ELSE 3 END AS place, CASE kind WHEN 'fetch_page' THEN 'fetch' WHEN 'enrich_notes' THEN 'enrich' WHEN 'download_sample' THEN 'download' ELSE 'evaluate' END AS family, count(*) AS jobs FROM jobs GROUP BY 1, 2")
def _families(spark, d):
    return jobs.family_counts(_jobs(spark, d))


@keyed("queue_clear_by_query", sql(f"SELECT job_id FROM (WITH {_JOBS_SQL} SELECT * FROM jobs) WHERE state IN ('ready', 'leased') AND job_id IN (SELECT post_id FROM posts WHERE score > 200 AND NOT is_deleted)"))
def _clear(spark, d):
    hits = search("score:>200", Star(spark, d).catalog(), now=NOW, ordered=False)
    return jobs.cancel_matching(_jobs(spark, d), hits, AT).where("state = 'cancelled'").select("job_id")


@keyed("rolling_rate", """SELECT event_id, CAST(count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM events""")
def _rate(spark, d):
    rows = Star(spark, d).table("events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("started_at"))
    return jobs.rolling_rate(rows, 600, ["event_type"]).select("event_id", "in_window")


@keyed("coverage_missing", "SELECT event_id AS key FROM events WHERE event_type = 'view' AND event_id % 3 <> 0")
def _uncovered(spark, d):
    e = Star(spark, d).table("events")
    views = e.where("event_type = 'view'").select(F.col("event_id").alias("key"))
    none = spark.createDataFrame([], "scope string, key long, dependency string, state string")
    return jobs.uncovered(views, jobs.cover(none, e.where("event_id % 3 = 0").select(F.col("event_id").alias("key")), "notes", "ready"), "notes")


@keyed("job_fan_out", "SELECT k AS kind, '{\"post_id\":' || o_orderkey || '}' AS payload FROM orders, (VALUES ('enrich_notes'), ('enrich_note_versions')) t(k) WHERE o_orderkey % 2 = 1")
def _fan_all(spark, d):
    posts = Star(spark, d).own().select("post_id")
    none = spark.createDataFrame([], "scope string, key long, dependency string, state string")
    coverage = jobs.cover(none, posts.where("post_id % 2 = 0").select(F.col("post_id").alias("key")), "notes", "pending")
    return jobs.fan_out(posts, coverage, {"notes", "users"}).select("kind", "payload")


# reports and sinks
@keyed("export_json", sql("""SELECT lpad(CAST(post_id AS VARCHAR), 12, '0') || '/post.json' AS path,
'{"post_id":' || post_id || ',"rating":"' || rating || '","score":' || score || ',"width":' || coalesce(CAST(width AS VARCHAR), 'null') || '}' AS json FROM posts WHERE score > 300 AND NOT is_deleted"""))
def _export(spark, d):
    return export.documents(search("score:>300", Star(spark, d).catalog(), now=NOW, columns=("post_id", "rating", "score", "width"), ordered=False))


@keyed("stale_files", "SELECT o_orderkey AS post_id FROM orders WHERE o_orderkey % 6 = 0")
def _stale(spark, d):
    posts = Star(spark, d).own().select("post_id", "md5", F.when(F.col("post_id") % 6 == 0, F.md5(F.lit("x"))).otherwise(F.upper("md5")).alias("checksum"))
    return export.stale_files(posts).select("post_id")


_EXPLAINED = ["cat -dog ~a ~b", "( ~x ~( y z ) ) score:>3 order:score", "rating:s type:png status:any"]


@keyed("explain_counts", "SELECT * FROM (VALUES ('cat -dog ~a ~b', 4, 4, 0, 0), ('( ~x ~( y z ) ) score:>3 order:score', 5, 3, 2, 2), ('rating:s type:png status:any', 3, 0, 3, 0)) t(query, terms, tags, metatags, groups)")
def _explained(spark, d):
    rows = [explain(x, now=NOW) for x in _EXPLAINED]
    return spark.createDataFrame([(r["query"], r["parse"]["terms"], r["parse"]["tags"], r["parse"]["metatags"], r["groups"]) for r in rows], "query string, terms int, tags int, metatags int, groups int")


# streams over events
@keyed("stream_windowed", """SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2""")
def _windowed(spark, d):
    rows = streams.windowed(Star(spark, d).table("events"))
    return rows.withColumn("start", F.unix_seconds("start"))


@keyed("stream_sessions", """SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k""")  # fmt: skip
def _sessions(spark, d):
    rows = streams.sessions(Star(spark, d).table("events"))
    return rows.withColumn("start", F.unix_seconds("start"))


# more forms of the language
found("date_yesterday", "date:yesterday", "created_at >= DATE '2001-07-31' AND created_at < DATE '2001-08-01'")
found("date_days_ago", "date:40_days_ago", "created_at >= DATE '2001-06-22' AND created_at < DATE '2001-06-23'")
found("date_decade", "date:decade -date:year", "created_at >= DATE '1991-08-01' AND created_at < DATE '2000-08-01'")
found("date_yesteryears_ago", "date:3_yesteryears_ago", "created_at >= DATE '1998-01-01' AND created_at < DATE '1999-01-01'")
found("date_short_month", "date:feb/11/1999", "created_at >= DATE '1999-02-11' AND created_at < DATE '1999-02-12'")
found("date_months_ago", "date:..20_months_ago", "created_at < DATE '1999-12-02'")
found("width_list", "width:100,150,200", "width IN (100, 150, 200)")
found("status_last_wins", "status:deleted status:active", "NOT is_deleted AND NOT is_pending AND NOT is_flagged", deleted=True)
found("voted_down_only", "voteddown:x", event("purchase", "value < 100"))


def _catalogued(name: str, text: str, where: str, **tables) -> None:
    """found() with further sidecar tables, each made from the star."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        star = Star(spark, d)
        catalog = star.catalog()
        catalog.sidecars |= {k: (lambda make=make: make(star)) for k, make in tables.items()}
        return search(text, catalog, now=NOW, ordered=False)

    QUERIES[name] = run
    ORACLES[name] = sql(f"SELECT post_id FROM posts WHERE ({where}) AND NOT is_deleted")


_catalogued("noter_versions", "noter:!7", event("signup", "user_id IN (6, 7)"), note_versions=lambda star: star.events("signup").select("post_id", (F.col("user_id") + 1).alias("user_id")))
_catalogued(
    "set_shortname", "set:n3", "uploader_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    sets=lambda star: star.sets().withColumn("shortname", F.concat(F.lit("N"), F.col("collection_id").cast("string"))),
)


@keyed("query_amended", sql("SELECT post_id FROM posts WHERE score > 100 AND NOT (rating = 's' AND width > 150) IS TRUE AND NOT is_deleted"))
def _amended(spark, d):
    return search(amended("score:>100", "rating:s width:>150"), Star(spark, d).catalog(), now=NOW, ordered=False)


@keyed("query_canonical", sql(f"SELECT post_id FROM posts WHERE {has('small')} AND NOT ({has('gear')} OR {has('large')}) AND NOT is_deleted"))
def _canonical(spark, d):
    star = Star(spark, d)
    return search(canonical("tiny -( ~whirl ~huge )", star.graph()), star.catalog(), now=NOW, ordered=False)


# scalar functions over whole columns
@keyed("text_functions", r"""SELECT p_partkey AS id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ',') AS tags, p_brand || '|' || p_type AS lines,
p_partkey || ',' || p_partkey % 7 AS ids, replace(lower(p_type), ' ', '_') AS name, p_partkey % 3 = 0 AS truth, greatest(CAST(floor(p_retailprice) AS BIGINT) - 1500, 0) AS counter
FROM (SELECT *, string_split(lower(p_name || ' ' || p_type || ' ' || p_name), ' ') AS w FROM part)""")
def _texts(spark, d):
    k = F.col("p_partkey").cast("string")
    return Star(spark, d).table("part").select(
        F.col("p_partkey").alias("id"),
        F.array_join(S.tag_list(F.concat_ws("  ", "p_name", "p_type", "p_name")), ",").alias("tags"),
        F.array_join(S.lines(F.concat("p_brand", F.lit("\n\r\n  "), "p_type", F.lit(" \n"))), "|").alias("lines"),
        F.array_join(S.id_list(F.concat(F.lit("{"), k, F.lit(", x "), (F.col("p_partkey") % 7).cast("string"), F.lit("}"))), ",").alias("ids"),
        S.normal_tag(F.concat(F.lit(" \t"), "p_type", F.lit("\x01 "))).alias("name"),
        S.truthy(F.get(F.array(F.lit(" Yes"), F.lit("no"), F.lit(None)), (F.col("p_partkey") % 3).cast("int"))).alias("truth"),
        S.count_of((F.floor("p_retailprice") - 1500 + 0.5).cast("string")).alias("counter"),
    )


@keyed("url_extensions", r"SELECT page_id, nullif(lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)), '') AS ext FROM pages")
def _extensions(spark, d):
    return Star(spark, d).table("pages").select("page_id", S.url_extension(F.col("url")).alias("ext"))


@keyed("instants", "SELECT event_id, epoch_us(ts) AS us, epoch_us(date_trunc('second', ts)) + 14400000000 AS shifted FROM events")
def _instants(spark, d):
    at = lambda form, zone: F.unix_micros(S.instant(F.concat(F.date_format("ts", form), F.lit(zone)).cast("string")))
    return Star(spark, d).table("events").select("event_id", at("yyyy-MM-dd HH:mm:ss.SSSSSS", "+00").alias("us"), at("yyyy-MM-dd'T'HH:mm:ss", "-04:00").alias("shifted"))


@keyed("flag_bits", "SELECT o_orderkey AS post_id, o_orderkey % 17 = 0 AS is_deleted, o_orderkey % 7 = 0 AS rating_locked, o_orderkey % 2 = 0 AS artist_verified FROM orders")
def _flags(spark, d):
    rows = Star(spark, d).own().select("post_id", S.packed_flags(*(F.col(c) for c in S.FLAG_BITS)).alias("flags"))
    return rows.select("post_id", *(S.flag(F.col("flags"), c).alias(c) for c in ("is_deleted", "rating_locked", "artist_verified")))


@keyed("formatters", """SELECT o_orderkey AS post_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024) || ' KB' ELSE printf('%.1f', n / 1048576) || ' MB' END AS size,
CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN printf('%.1f', n / 1000) || 'k' ELSE printf('%.1f', n / 1000000) || 'M' END AS number,
CASE WHEN n >= 3600 THEN n // 3600 || ':' || lpad(CAST(n // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(n // 60 AS VARCHAR) END || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') AS time
FROM (SELECT o_orderkey, o_orderkey * 64 + 32 AS n FROM orders)""")
def _formatted(spark, d):
    n = F.col("post_id") * 64 + 32
    return Star(spark, d).own().select("post_id", S.human_bytes(n).alias("size"), S.human_count(n).alias("number"), S.human_duration(n).alias("time"))


# snapshot files: written as gzip CSV, found by name, scanned
def _snapshot(df: DataFrame, kind: str) -> DataFrame:
    spark, path = df.sparkSession, fresh_folder(df.sparkSession, "snapshot")
    df.write.csv(f"{path}/{kind}-2024-05-01.csv", header=True, compression="gzip", quote='"', escape='"')
    return snapshot.read_csv(spark, f"{path}/{kind}-2024-05-01.csv")


@keyed("snapshot_posts", """SELECT o_orderkey AS post_id, CASE o_orderstatus WHEN 'F' THEN 's' WHEN 'O' THEN 'q' ELSE 'e' END AS rating, 'a,"b",c' AS all_tags, CAST(trunc(o_totalprice) AS INTEGER) AS score,
o_orderkey % 9 = 0 AS is_deleted, epoch_us(o_orderdate) AS us, 2 AS sources, o_orderkey || ' "x"' || chr(10) || 'next, line' AS description FROM orders WHERE o_orderkey % 10 <> 3""")
def _snapshot_posts(spark, d):
    o, k = Star(spark, d).table("orders"), F.col("o_orderkey")
    raw = o.select(
        F.when(k % 20 == 3, F.concat(F.lit("no"), k.cast("string"))).otherwise(k.cast("string")).alias("id"),
        F.when(k % 20 == 13, "?").when(F.col("o_orderstatus") == "F", "S").when(F.col("o_orderstatus") == "O", "questionable").otherwise("e").alias("rating"),
        F.lit('A "b" a c').alias("tag_string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("score"),
        F.when(k % 9 == 0, "t").otherwise("f").alias("is_deleted"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss+00").alias("created_at"),
        F.lit("http://x\nhttp://y").alias("source"), F.concat(k.cast("string"), F.lit(' "x"\nnext, line')).alias("description"),
    )
    rows = snapshot.accepted(snapshot.parse_posts(_snapshot(raw, "posts")))
    return rows.select("post_id", "rating", F.array_join("all_tags", ",").alias("all_tags"), "score", "is_deleted", F.unix_micros("created_at").alias("us"), F.size("sources").alias("sources"), "description")


@keyed("snapshot_tags", """SELECT CAST(p_partkey AS BIGINT) AS source_tag_id, lower(replace(p_name, ' ', '_')) AS name, ['general', 'artist', 'contributor', 'copyright', 'character', 'species', 'invalid', 'meta', 'lore'][1 + CASE WHEN p_partkey % 12 < 9 THEN p_partkey % 12 ELSE 0 END] AS category,
CAST(floor(p_retailprice) AS BIGINT) AS post_count, p_partkey % 5 = 0 AS is_deprecated FROM part""")
def _snapshot_tags(spark, d):
    k = F.col("p_partkey")
    raw = Star(spark, d).table("part").select(k.cast("string").alias("id"), F.concat(F.lit(" "), "p_name").alias("name"), (k % 12).cast("string").alias("category"), F.floor("p_retailprice").cast("string").alias("post_count"), F.when(k % 5 == 0, "t").otherwise("f").alias("is_deprecated"))
    return snapshot.parse_tags(_snapshot(raw, "tags"))


@keyed("snapshot_pools", """SELECT s_suppkey AS collection_id, lower(replace(s_name, ' ', '_')) AS name, CAST(i AS INTEGER) AS sequence, CAST(s_nationkey + 10 * i AS BIGINT) AS post_id
FROM supplier, range(3) t(i) WHERE s_nationkey + 10 * i IN (SELECT o_orderkey FROM orders)""")
def _snapshot_pools(spark, d):
    star, n = Star(spark, d), F.col("s_nationkey")
    ids = F.concat(F.lit("{"), F.concat_ws(",", *((n + 10 * i).cast("string") for i in range(3))), F.lit("}"))
    raw = star.table("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit("Series").alias("category"), ids.alias("post_ids"))
    return merge.existing_only(snapshot.pool_posts(snapshot.parse_pools(_snapshot(raw, "pools"))), star.own()).select("collection_id", "name", "sequence", "post_id")


@keyed("snapshot_aliases", """SELECT 't' || c_custkey AS antecedent, 't' || c_nationkey AS consequent, CASE c_custkey % 3 WHEN 0 THEN 'pending' ELSE 'active' END AS status FROM customer WHERE c_custkey % 13 <> 0""")
def _snapshot_aliases(spark, d):
    k = F.col("c_custkey")
    raw = Star(spark, d).table("customer").select(F.concat(F.lit(" T"), k.cast("string")).alias("antecedent_name"), F.when(k % 13 != 0, F.concat(F.lit("t"), F.col("c_nationkey").cast("string"))).alias("consequent_name"), F.when(k % 3 == 0, "Pending").when(k % 3 == 1, "active").otherwise("odd").alias("status"))
    return snapshot.parse_edges(_snapshot(raw, "tag_aliases")).select("antecedent", "consequent", "status")


@keyed("snapshot_wiki", "SELECT c_custkey AS wiki_id, lower(c_mktsegment) || '_' || c_custkey AS title, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS body, c_custkey % 2 = 1 AS is_locked FROM customer")
def _snapshot_wiki(spark, d):
    k = F.col("c_custkey")
    raw = Star(spark, d).table("customer").select(k.cast("string").alias("id"), F.concat_ws(" ", "c_mktsegment", k.cast("string")).alias("title"), F.when(k % 4 != 0, F.col("c_name")).alias("body"), F.when(k % 2 == 1, "t").otherwise("f").alias("is_locked"))
    return snapshot.parse_wiki_pages(_snapshot(raw, "wiki_pages")).select("wiki_id", "title", "body", "is_locked")


@keyed("merged_tags", "SELECT c_mktsegment AS name, 'general' AS category FROM customer GROUP BY 1 UNION ALL SELECT n_name, min(CASE WHEN n_nationkey % 2 = 0 THEN 'meta' ELSE 'artist' END) FROM nation GROUP BY 1")
def _merged_tags(spark, d):
    star = Star(spark, d)
    known = star.table("customer").select(F.col("c_mktsegment").alias("name"), F.lit("general").alias("category")).distinct()
    staged = star.table("nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "meta").otherwise("artist").alias("category"))
    return snapshot.merged_tags(known, staged.unionByName(known.withColumn("category", F.lit("lore"))))


@keyed("tag_ids", "SELECT DISTINCT lower(p_type) AS name, t.id AS tag_id FROM part p JOIN (SELECT lower(p_type) AS n, min(p_partkey) AS id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) t ON t.n = lower(p.p_type) WHERE lower(p_type) NOT LIKE '% %'")
def _tag_ids(spark, d):
    part = Star(spark, d).table("part")
    tags = part.where("p_partkey % 2 = 0").groupBy(F.lower("p_type").alias("name")).agg(F.min("p_partkey").alias("tag_id"))
    return T.ids_of(part.select(F.concat(F.lit(" "), F.upper("p_type")).alias("name")), tags)


@keyed("unresolved_edges", f"WITH {_GRAPH}, own AS (SELECT DISTINCT 't' || (c_custkey % 300) AS a, 't' || ((c_custkey % 300) * 2 + 1 + CASE WHEN c_custkey % 7 = 0 THEN 5 ELSE 0 END) % 300 AS b FROM customer), known AS (SELECT name FROM tags WHERE ends_with(name, '7') OR ends_with(name, '5')) SELECT a AS antecedent, b AS consequent FROM own WHERE a NOT IN (SELECT name FROM known) OR b NOT IN (SELECT name FROM known)")
def _unresolved_edges(spark, d):
    tags, _, implications = _graph(spark, d)
    return T.unresolved(implications.select("antecedent", "consequent"), tags.where("name like '%7' or name like '%5'"))


# sidecars, pages, stores
@keyed("sidecar_comments", """WITH c AS (SELECT *, event_id % 400 AS id, event_id % 400 % 50 AS post FROM events WHERE event_type IN ('view', 'click')),
kept AS (SELECT id, post, user_id, props, ts, event_id < 400 AS old FROM c WHERE event_id < 400 OR post IN (SELECT o_orderkey FROM orders))
SELECT id AS comment_id, post AS post_id, arg_max(user_id, (NOT old, ts)) AS user_id, arg_max(props, (NOT old, ts)) AS body FROM kept GROUP BY 1, 2""")
def _comments(spark, d):
    star, e = Star(spark, d), F.col("event_id")
    body = F.struct((e % 400).alias("id"), (e % 400 % 50).alias("post_id"), F.col("user_id").alias("creator_id"), F.col("props").alias("body"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("updated_at"))
    lines = star.table("events").where("event_type in ('view', 'click')").select("event_id", F.to_json(body).alias("value"))
    old, new = (sidecars.parse(lines.where(w).select("value"), "comments") for w in ("event_id < 400", "event_id >= 400"))
    return sidecars.merge(old, new, "comments", star.own()).select("comment_id", "post_id", "user_id", "body")


@keyed("users_resolved", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE c_custkey END AS user_id FROM events LEFT JOIN customer ON lower(c_name) = 'customer#' || lpad(CAST(user_id * 3 AS VARCHAR), 9, '0')")
def _resolved(spark, d):
    star = Star(spark, d)
    name = F.concat(F.lit("customer#"), F.lpad((F.col("user_id") * 3).cast("string"), 9, "0"))
    rows = star.table("events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user_id"), name.alias("user_name"))
    return sidecars.resolve_users(rows, star.users()).select("event_id", "user_id")


@keyed("replacements_pending", "SELECT o_orderkey AS post_id, o_orderkey IN (SELECT event_id FROM events WHERE event_type = 'signup') AS pending_replacements FROM orders")
def _open_replacements(spark, d):
    star = Star(spark, d)
    body = F.struct(F.col("event_id").alias("id"), F.col("event_id").alias("post_id"), F.when(F.col("event_type") == "signup", "Pending").otherwise("rejected").alias("status"))
    rows = sidecars.parse(star.table("events").select(F.to_json(body).alias("value")), "replacements")
    return sidecars.pending_replacements(star.own().select("post_id"), rows)


@keyed("paged_rows", "SELECT CAST(i // 40 + 1 AS INTEGER) AS page, CAST(i % 40 AS INTEGER) AS place, i AS id FROM range(1013) t(i)")
def _paged(spark, d):
    def fetch(resource, page, size):
        return [{"id": k} for k in range(1013)][(page - 1) * size : page * size]

    return paged.paged(spark, fetch, "posts", size=40).select("page", "place", F.get_json_object("value", "$.id").cast("long").alias("id"))


@keyed("store_generations", "SELECT 2 AS generation, (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM region) AS regions, (SELECT count(*) FROM nation) AS kept")
def _generations(spark, d):
    star, path = Star(spark, d), fresh_folder(spark, "store")
    export.write_store({"nation": star.table("region"), "region": star.table("region")}, path, 1)
    export.write_store({"nation": star.table("nation"), "region": star.table("region")}, path, 2)
    # a generation that crashed before its manifest is not the store's
    star.table("region").write.parquet(f"{path}/nation-3")
    found_ = export.manifest(spark, path)
    return export.read_store(spark, path, "nation").agg(F.count("*").alias("kept")).select(F.lit(found_["generation"]).alias("generation"), *(F.lit(found_["counts"][n]).cast("long").alias(f"{n}s") for n in ("nation", "region")), "kept")


@keyed("export_links", "SELECT o_orderkey AS post_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '/sample.png' AS path, '/f/' || o_orderkey AS target FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def _links(spark, d):
    k = F.col("post_id")
    own = Star(spark, d).own().select("post_id")
    rows = own.select("post_id", F.lit("sample").alias("variant"), F.lit("png").alias("ext"), F.when(k % 2 == 0, F.concat(F.lit("/f/"), k.cast("string"))).alias("local_path"))
    return export.links(own.where("post_id % 3 = 0"), rows)


# the life of a job
@keyed("job_refusals", "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'the payload is no JSON object' WHEN o_orderkey % 5 = 1 THEN 'max_attempts must be at least 1' WHEN o_orderkey % 5 = 2 THEN 'a job needs a kind' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def _refusals(spark, d):
    return _new_jobs(spark, d).groupBy(jobs.refused(_new_jobs(spark, d)).alias("reason")).agg(F.count("*").alias("n"))


def _new_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of the orders, three fifths of which cannot be taken."""
    k = F.col("o_orderkey")
    payload = F.when(k % 10 == 0, "[1]").when(k % 10 == 5, "{no").otherwise(F.to_json(F.struct(k.alias("post_id"))))
    return Star(spark, d).table("orders").select(k.alias("job_id"), (k % 9).alias("run_id"), F.when(k % 5 != 2, "enrich_notes").alias("kind"), payload.alias("payload"), F.when(k % 5 == 1, 0).otherwise(2).alias("max_attempts"))


@keyed("job_enqueue", "SELECT o_orderkey AS job_id, o_orderkey % 9 AS run_id, 'ready' AS state, 0 AS priority, 0 AS attempts, 2 AS max_attempts FROM orders WHERE o_orderkey % 5 >= 3")
def _enqueued(spark, d):
    new = _new_jobs(spark, d)
    return jobs.enqueue(spark.createDataFrame([], jobs.SCHEMA), new.where(jobs.refused(new).isNull()), AT).select("job_id", "run_id", "state", "priority", "attempts", "max_attempts")


@keyed("job_failures", f"""WITH {_JOBS_SQL} SELECT job_id, CASE WHEN state <> 'leased' THEN state WHEN job_id % 3 = 0 THEN 'failed' ELSE 'ready' END AS state,
CASE WHEN state = 'leased' THEN 'lost' END AS last_error, epoch_us(CASE WHEN state = 'leased' THEN TIMESTAMP '2024-01-01 12:01:30' ELSE due END) AS due FROM jobs""")
def _failures(spark, d):
    rows = _jobs(spark, d).withColumn("attempts", F.when(F.col("job_id") % 3 == 0, 3).otherwise(1))
    return jobs.fail_all(rows, F.col("state") == jobs.LEASED, "lost", AT, 90).select("job_id", "state", "last_error", F.unix_micros("available_at").alias("due"))


@keyed("job_leases", f"""WITH {_JOBS_SQL}, mine AS (SELECT job_id FROM jobs WHERE {_CLAIMABLE} ORDER BY priority DESC, due, job_id LIMIT 3),
again AS (SELECT job_id, row_number() OVER (ORDER BY priority DESC, due, job_id) AS place FROM jobs WHERE {_CLAIMABLE.replace("12:00:00", "12:15:00")} AND job_id <> (SELECT min(job_id) FROM mine))
SELECT job_id, CASE WHEN job_id = (SELECT min(job_id) FROM mine) THEN 'w1' ELSE 'w2' END AS worker FROM (SELECT min(job_id) AS job_id FROM mine UNION ALL SELECT job_id FROM again WHERE place <= 5)""")
def _leases(spark, d):
    """Three jobs of a worker, one kept by a heartbeat; the others' leases run out and another worker may have them."""
    rows = jobs.claim(_jobs(spark, d), AT, "w1", 600, 3)
    first = rows.where("locked_by = 'w1'").agg(F.min("job_id")).first()[0]
    if first is not None:
        rows = jobs.heartbeat(rows, first, "w1", AT + timedelta(minutes=9), 600)
    rows = jobs.claim(rows, AT + timedelta(minutes=15), "w2", 600, 5)
    held = rows.where((F.col("locked_by") == "w2") | ((F.col("locked_by") == "w1") & (F.col("lease_until") > F.lit(AT + timedelta(minutes=15)))))
    return held.select("job_id", F.col("locked_by").alias("worker"))


@keyed("evaluate_query", sql("SELECT post_id FROM posts WHERE post_id % 2 = 0 AND score > 100 AND NOT is_deleted AND post_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')"))
def _evaluated(spark, d):
    star = Star(spark, d)
    return runs.evaluate("score:>100", star.catalog(), star.own().where("post_id % 2 = 0"), star.events("error").select("post_id"), NOW)


@keyed("run_states", "SELECT * FROM (VALUES (3, 3, 'running', -1), (1, 2, 'failed', -1), (2, 1, 'done', (SELECT count(*) FROM orders WHERE floor(o_totalprice / 1000) > 100 AND o_orderkey % 17 <> 0))) t(place, run_id, state, total)")
def _run_states(spark, d):
    table = spark.createDataFrame([], runs.RUNS)
    for k, text in enumerate(("score:>100", "bolt", "rating:s"), 1):
        table = runs.start(table, k, text, AT)
    n = search("score:>100", Star(spark, d).catalog(), now=NOW, ordered=False).count()
    table = runs.complete(table, 1, n, AT + timedelta(minutes=1))
    table = runs.fail(table, 2, "gone", AT + timedelta(minutes=2))
    return runs.listed(table).select(F.when(F.col("state") == "done", 2).when(F.col("state") == "failed", 1).otherwise(3).alias("place"), F.col("run_id").cast("int").alias("run_id"), "state", F.coalesce("total", F.lit(-1)).alias("total"))


# streams, run to the end of what is there
@keyed("stream_ingest", f"SELECT post_id, rating, score FROM ({_PAYLOAD_SQL}) WHERE post_id % 50 <> 0 AND has_file AND rating <> 'x'")
def _stream_ingest(spark, d):
    path = fresh_folder(spark, "ingest")
    _payloads(spark, d).write.text(f"{path}/in")
    state = {"at": 0}
    export.write_store(snapshot.accepted(snapshot.from_payloads(spark.createDataFrame([], "value string"))), f"{path}/store", 0)

    def write(rows, number):
        export.write_store(rows, f"{path}/store", number + 1)
        state["at"] = number + 1

    lines = spark.readStream.text(f"{path}/in")
    streams.ingest(spark, lines, f"{path}/checkpoint", lambda: export.read_store(spark, f"{path}/store"), write).start().awaitTermination()
    return export.read_store(spark, f"{path}/store").select("post_id", "rating", "score")


@keyed("stream_watermark", """SELECT CAST(epoch(start) AS BIGINT) AS start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def _watermark(spark, d):
    """Only windows that the watermark has passed are written."""
    path = fresh_folder(spark, "windows")
    rows = Star(spark, d).table("events").select("ts", "event_type", "value")
    rows.write.parquet(f"{path}/in")
    found_ = streams.windowed(streams.stream(spark, f"{path}/in", "ts timestamp, event_type string, value double", files=1 << 20))
    found_.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(found_.schema).parquet(f"{path}/out").select(F.unix_seconds("start").alias("start"), "event_type", "n")


@keyed("standing_search", sql("SELECT post_id FROM posts WHERE score > 250 AND rating <> 's' AND NOT is_deleted"))
def _standing(spark, d):
    path = fresh_folder(spark, "standing")
    Star(spark, d).own().select("post_id", "score", "rating", "is_deleted").write.parquet(f"{path}/in")
    posts = streams.stream(spark, f"{path}/in", "post_id long, score int, rating string, is_deleted boolean")
    hits = streams.standing_search(posts, "score:>250 -rating:s").select("post_id")
    hits.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema("post_id long").parquet(f"{path}/out")
