"""Files of posts: what is wanted, being fetched, there or failed, as a table.

Every operation gives a new snapshot of the table for many files at once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import scalars as S

SCHEMA = (
    "post_id bigint, variant string, ext string, source_url string, md5 string, state string, local_path string, "
    "bytes_written bigint, checksum string, downloaded_at timestamp, updated_at timestamp"
)
PENDING, FETCHING, THERE, FAILED = "pending", "downloading", "downloaded", "failed"
KEY = ["post_id", "variant"]
# The variants, and the payload fields each is described by.
VARIANTS = ("original", "sample", "preview")


def path_of(root: str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), S.file_path(F.col("post_id"), F.col("variant"), F.coalesce("ext", F.lit("bin"))))


def _changed(files: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
    """files with the columns of rows (key and new values) in place of their own; other files stay."""
    new = [c for c in rows.columns if c not in KEY]
    renamed = rows.dropDuplicates(KEY).select(*KEY, *(F.col(c).alias(f"_{c}") for c in new), F.lit(True).alias("_hit"))
    joined = files.join(renamed, KEY, "left")
    values = {c: F.when(F.col("_hit"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in new}
    values["updated_at"] = F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updated_at"))
    return joined.select(*((values[c] if c in values else F.col(c)).alias(c) for c in files.columns))


def want(files: DataFrame, wanted: DataFrame, now: datetime, root: str = "files") -> DataFrame:
    """files with the wanted ones (post_id, variant, ext, source_url, md5) pending; what is there stays."""
    there = files.where(F.col("state") == THERE).select(*KEY)
    new = wanted.dropDuplicates(KEY).join(there, KEY, "left_anti")
    none = {c: t for c, t in (f.split() for f in SCHEMA.split(", "))}
    rows = new.withColumn("state", F.lit(PENDING)).withColumn("local_path", path_of(root)).withColumn("updated_at", F.lit(now))
    rows = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(none[c]).alias(c) for c in none))
    return files.join(new.select(*KEY), KEY, "left_anti").unionByName(rows)


def pending(files: DataFrame, n: int, variant: str | None = None) -> DataFrame:
    """The n files to fetch next: longest pending first, then by post and variant."""
    if n <= 0:
        raise ValueError("n must be positive")
    rows = files.where(F.col("state") == PENDING)
    if variant:
        rows = rows.where(F.col("variant") == variant)
    return rows.orderBy("updated_at", "post_id", "variant").limit(n)


def claim(files: DataFrame, now: datetime, n: int = 1, variant: str | None = None) -> DataFrame:
    """files with the next n being fetched."""
    return _changed(files, pending(files, n, variant).select(*KEY, F.lit(FETCHING).alias("state")), now)


def fetched(files: DataFrame, done: DataFrame, now: datetime) -> DataFrame:
    """files with those done (post_id, variant, local_path, bytes_written, checksum) there; a negative size raises when run."""
    size = F.when(F.col("bytes_written") < 0, F.raise_error(F.lit("bytes_written must not be negative")).cast("bigint")).otherwise(F.col("bytes_written"))
    rows = done.select(*KEY, "local_path", size.alias("bytes_written"), F.lower("checksum").alias("checksum"), F.lit(THERE).alias("state"), F.lit(now).alias("downloaded_at"))
    return _changed(files, rows, now)


def failed(files: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
    return _changed(files, rows.select(*KEY, F.lit(FAILED).alias("state")), now)


def there(files: DataFrame, variant: str | None = None) -> DataFrame:
    """post_id of the posts with a file that is there."""
    rows = files.where(F.col("state") == THERE)
    return (rows.where(F.col("variant") == variant) if variant else rows).select("post_id").distinct()


def counts(files: DataFrame) -> DataFrame:
    return files.groupBy("variant", "state").agg(F.count("*").alias("files"))
