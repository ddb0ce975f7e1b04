"""Daily snapshot files (gzip CSV with a header, all strings) and JSON payloads, validated."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions import scalars as S

# Kinds of snapshot files and the payload's field names.
KINDS = ("tags", "tag_aliases", "tag_implications", "wiki_pages", "pools", "posts")
CATEGORY_IDS = ("general", "artist", "contributor", "copyright", "character", "species", "invalid", "meta", "lore")

_SIZED = "struct<url:string,width:int,height:int>"
PAYLOAD = (
    "id string, rating string, created_at string, updated_at string, description string, uploader_id bigint, uploader_name string, approver_id bigint, "
    "fav_count bigint, comment_count bigint, duration double, has_notes boolean, pending_replacements boolean, artist_verified boolean, "
    "file struct<ext:string,height:int,width:int,md5:string,size:bigint,url:string>, "
    f"sample {_SIZED}, preview {_SIZED}, score struct<up:int,down:int,total:int>, "
    "flags struct<deleted:boolean,pending:boolean,flagged:boolean,rating_locked:boolean,note_locked:boolean,status_locked:boolean>, "
    "relationships struct<parent_id:bigint,children:array<bigint>,has_children:boolean>, "
    "tags struct<" + ",".join(f"{c}:array<string>" for c in CATEGORY_IDS) + ">, sources array<string>, pools array<bigint>"
)


def _fields(schema: str) -> str:
    """Columns of a DDL schema as fields of a struct."""
    depth, out = 0, []
    for word in re.split(r"([<>,])", schema):
        depth += (word == "<") - (word == ">")
        out.append(word.strip().replace(" ", ":", 1) if depth == 0 and word.strip() and word not in "<>," else word.strip() if depth == 0 else word)
    return "".join(out)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a snapshot file by its header; rows without any value are left out."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    filled = [F.length(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))) > 0 for c in raw.columns]
    return raw.where(F.greatest(*filled) if len(filled) > 1 else filled[0])


def column(df: DataFrame, name: str) -> Column:
    """A column that may be missing from the file."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def file_dates(names: list[str]) -> list[tuple[str, str]]:
    """(kind, date) of the snapshot files in a listing."""
    return [(m[1], m[2]) for x in names if (m := re.search(rf"\b({'|'.join(KINDS)})-(\d{{4}}-\d{{2}}-\d{{2}})\.csv", x))]


def latest_shared(files: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The newest date that has a file of every kind (files: kind, date)."""
    whole = files.where(F.col("kind").isin(*kinds)).groupBy("date").agg(F.count_distinct("kind").alias("_n"))
    return whole.where(F.col("_n") == len(kinds)).agg(F.max("date").alias("date"))


def parse_tags(raw: DataFrame) -> DataFrame:
    """name, category, post_count, is_deprecated; names of nothing but white space are left out, ids must be numbers."""
    ident = column(raw, "id").try_cast("bigint")
    category = column(raw, "category").try_cast("int")
    rows = raw.select(
        ident.alias("source_tag_id"),
        S.normal_tag(column(raw, "name")).alias("name"),
        F.coalesce(F.get(F.array(*(F.lit(c) for c in CATEGORY_IDS)), category), F.lit("general")).alias("category"),
        F.coalesce(S.count_of(column(raw, "post_count")), F.lit(0)).alias("post_count"),
        S.truthy(column(raw, "is_deprecated")).alias("is_deprecated"),
    )
    bad = F.raise_error(F.lit("a tag's id is no number"))
    return rows.where("name is not null").withColumn("source_tag_id", F.when(F.col("source_tag_id").isNull(), bad.cast("bigint")).otherwise(F.col("source_tag_id")))


def parse_edges(raw: DataFrame) -> DataFrame:
    """antecedent, consequent, status of aliases or implications."""
    return raw.select(
        S.normal_tag(column(raw, "antecedent_name")).alias("antecedent"),
        S.normal_tag(column(raw, "consequent_name")).alias("consequent"),
        S.alias_status(column(raw, "status")).alias("status"),
        S.instant(column(raw, "updated_at")).alias("updated_at"),
    ).where("antecedent is not null and consequent is not null")


def parse_pools(raw: DataFrame) -> DataFrame:
    """collection_id, name, category, post_ids."""
    return raw.select(
        column(raw, "id").try_cast("bigint").alias("collection_id"),
        S.normal_tag(column(raw, "name")).alias("name"),
        F.lower(column(raw, "category")).alias("category"),
        S.id_list(column(raw, "post_ids")).alias("post_ids"),
    ).where("collection_id is not null")


def parse_wiki_pages(raw: DataFrame) -> DataFrame:
    """wiki_id, title (as a tag's name), body, is_locked, created_at, updated_at."""
    return raw.select(
        column(raw, "id").try_cast("bigint").alias("wiki_id"),
        S.normal_tag(column(raw, "title")).alias("title"),
        F.coalesce(column(raw, "body"), F.lit("")).alias("body"),
        S.truthy(column(raw, "is_locked")).alias("is_locked"),
        S.instant(column(raw, "created_at")).alias("created_at"),
        S.instant(column(raw, "updated_at")).alias("updated_at"),
    ).where("wiki_id is not null and title is not null")


def pool_posts(pools: DataFrame) -> DataFrame:
    return pools.select("collection_id", "name", F.posexplode("post_ids").alias("sequence", "post_id"))


def reason(*tests: tuple[str, Column]) -> Column:
    """The first test that fails names the rejection; null if all hold."""
    return F.coalesce(*(F.when(~S.never_null(ok), F.lit(name)) for name, ok in tests))


def parse_posts(raw: DataFrame) -> DataFrame:
    """Posts of a snapshot, with rejected (a reason, or null)."""
    n = lambda name: column(raw, name)
    by_category = [f"tag_string_{c}" for c in CATEGORY_IDS if f"tag_string_{c}" in raw.columns]
    none = F.array().cast("array<string>")
    tags = F.struct(*((S.tag_list(n(f"tag_string_{c}")) if by_category else S.tag_list(n("tag_string")) if c == "general" else none).alias(c) for c in CATEGORY_IDS))
    rows = raw.select(
        n("id").try_cast("bigint").alias("post_id"),
        S.rating_code(n("rating")).alias("rating"),
        tags.alias("tags"),
        S.whole(n("score")).cast("int").alias("score"),
        F.coalesce(S.count_of(n("fav_count")), F.lit(0)).alias("favcount"),
        F.coalesce(S.count_of(n("comment_count")), F.lit(0)).alias("comment_count"),
        F.lower(n("file_ext")).alias("file_ext"),
        F.lower(n("md5")).alias("md5"),
        S.whole(n("image_width")).cast("int").alias("width"),
        S.whole(n("image_height")).cast("int").alias("height"),
        S.whole(n("file_size")).alias("file_size"),
        S.whole(n("duration")).alias("duration"),
        *(S.truthy(n(c)).alias(c) for c in ("is_deleted", "is_pending", "is_flagged")),
        *(S.truthy(n(f"is_{c}")).alias(c) for c in ("rating_locked", "note_locked", "status_locked", "artist_verified")),
        S.instant(n("created_at")).alias("created_at"),
        S.instant(n("updated_at")).alias("updated_at"),
        n("uploader_id").try_cast("bigint").alias("uploader_id"),
        n("approver_id").try_cast("bigint").alias("approver_id"),
        n("parent_id").try_cast("bigint").alias("parent_post_id"),
        F.coalesce(n("description"), F.lit("")).alias("description"),
        S.lines(n("source")).alias("sources"),
    )
    rows = rows.withColumn("all_tags", F.array_distinct(F.flatten(F.array(*(F.col(f"tags.{c}") for c in CATEGORY_IDS)))))
    return rows.withColumn("rejected", reason(("post id is no number", F.col("post_id").isNotNull()), ("rating is unknown", F.col("rating").isNotNull())))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One payload a line; what does not parse becomes a rejected row."""
    return from_payloads(spark.read.text(path).where("trim(value) <> ''").select("value"))


def from_payloads(lines: DataFrame) -> DataFrame:
    """Canonical posts of JSON payloads (value), with rejected (a reason, or null)."""
    # one parse: a payload may be wrapped into {"post": ...}, so that is a field beside the others;
    # the array keeps the optimiser from copying the parse into every expression that reads it
    parsed = F.from_json("value", f"{PAYLOAD}, post struct<{_fields(PAYLOAD)}>", {"mode": "PERMISSIVE"})
    rows = lines.select(F.explode(F.array(parsed)).alias("r")).select(F.when(F.col("r.post").isNotNull(), F.col("r.post")).otherwise(F.col("r").dropFields("post")).alias("p"))
    every = F.array_distinct(F.transform(F.flatten(F.array(*(F.coalesce(F.col(f"p.tags.{c}"), F.array().cast("array<string>")) for c in CATEGORY_IDS))), F.lower))
    rows = rows.select(
        F.col("p.id").try_cast("bigint").alias("post_id"),
        S.rating_code(F.col("p.rating")).alias("rating"),
        F.col("p.tags").alias("tags"),
        every.alias("all_tags"),
        F.col("p.score.total").alias("score"),
        F.greatest(F.coalesce("p.fav_count", F.lit(0)), F.lit(0)).alias("favcount"),
        F.greatest(F.coalesce("p.comment_count", F.lit(0)), F.lit(0)).alias("comment_count"),
        F.col("p.file.ext").alias("file_ext"),
        F.lower("p.file.md5").alias("md5"),
        F.col("p.file.width").alias("width"),
        F.col("p.file.height").alias("height"),
        F.col("p.file.size").alias("file_size"),
        F.floor("p.duration").alias("duration"),
        *(F.coalesce(F.col(f"p.flags.{c}"), F.lit(False)).alias(f"is_{c}") for c in ("deleted", "pending", "flagged")),
        *(F.coalesce(F.col(f"p.flags.{c}"), F.lit(False)).alias(c) for c in ("rating_locked", "note_locked", "status_locked")),
        F.coalesce("p.artist_verified", F.lit(False)).alias("artist_verified"),
        F.col("p.pending_replacements").alias("pending_replacements"),
        S.instant(F.col("p.created_at")).alias("created_at"),
        S.instant(F.col("p.updated_at")).alias("updated_at"),
        F.col("p.uploader_id").alias("uploader_id"),
        F.lower(F.trim("p.uploader_name")).alias("uploader_name"),
        F.col("p.approver_id").alias("approver_id"),
        F.col("p.relationships.parent_id").alias("parent_post_id"),
        F.coalesce(F.size("p.relationships.children"), F.lit(0)).cast("long").alias("child_count"),
        F.coalesce("p.description", F.lit("")).alias("description"),
        F.filter(F.coalesce("p.sources", F.array().cast("array<string>")), lambda s: s != "").alias("sources"),
        F.coalesce("p.pools", F.array().cast("array<bigint>")).alias("pools"),
        F.col("p.file").isNotNull().alias("_file"),
    )
    why = reason(("post id is no number", F.col("post_id").isNotNull()), ("file is missing", F.col("_file")), ("rating is unknown", F.col("rating").isNotNull()))
    return rows.withColumn("rejected", why).drop("_file")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("rejected is null").drop("rejected")


def rejections(rows: DataFrame) -> DataFrame:
    return rows.where("rejected is not null").select("post_id", F.col("rejected").alias("reason"))


def unknown_tags(posts: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags of posts that the catalogue lacks: recorded, not rejected."""
    rows = posts.select("post_id", F.explode("all_tags").alias("name"))
    return rows.join(tags.select("name"), "name", "left_anti").groupBy("name").agg(F.count("*").alias("posts"))


def merged_tags(catalogue: DataFrame, staged: DataFrame) -> DataFrame:
    """The catalogue's categories win; a staged one (the least, last cached) holds for new names only."""
    cached = [F.max("cached_at").alias("cached_at")] if "cached_at" in staged.columns else []
    new = staged.groupBy("name").agg(F.min("category").alias("category"), *cached).join(catalogue.select("name"), "name", "left_anti")
    return catalogue.unionByName(new, allowMissingColumns=True)
