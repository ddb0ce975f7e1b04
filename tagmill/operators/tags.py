"""The tag graph: aliases, implications, wildcard expansion."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions import scalars as S
from tagmill.operators.state import cut

HOPS = 16
#: Names of a closure that reach the driver; a larger one stays a table.
MAX_NAMES = 10_000
#: Edges up to which the names of queries are resolved on the driver; larger graphs are joined, with the same result.
LOCAL_EDGES = 200_000
#: Tags that may be broadcast with their categories; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000


def latest_aliases(aliases: DataFrame) -> DataFrame:
    """One active target per antecedent: the last updated, nulls last, then the smallest name."""
    newest = Window.partitionBy("antecedent").orderBy(F.col("updated_at").desc_nulls_last(), "consequent")
    active = aliases.where(F.col("status") == "active").withColumn("_k", F.row_number().over(newest))
    return active.where("_k = 1").select("antecedent", "consequent")


def canonical_aliases(aliases: DataFrame, hops: int = HOPS) -> DataFrame:
    """antecedent, canonical, hops: aliases followed until there is no next or a name comes again."""
    step = cut(latest_aliases(aliases))
    now = step.select("antecedent", F.col("consequent").alias("canonical"), F.lit(1).alias("hops"), F.array("antecedent", "consequent").alias("_seen"))
    nxt = step.toDF("_from", "_to")
    for k in range(2, hops + 1):
        joined = now.join(nxt, (F.col("canonical") == F.col("_from")) & ~F.array_contains("_seen", F.col("_to")), "left")
        now = joined.select(
            "antecedent",
            F.coalesce("_to", "canonical").alias("canonical"),
            F.when(F.col("_to").isNotNull(), k).otherwise(F.col("hops")).alias("hops"),
            F.when(F.col("_to").isNotNull(), F.concat("_seen", F.array("_to"))).otherwise(F.col("_seen")).alias("_seen"),
        )
        now = cut(now)
        if now.where(F.col("hops") == k).isEmpty():
            break
    return now.select("antecedent", "canonical", "hops")


def closure(implications: DataFrame) -> DataFrame:
    """antecedent, consequent, depth (shortest): all that each tag implies; cycles end, no tag implies itself."""
    edges = cut(implications.where(F.col("status") == "active").select("antecedent", "consequent").where("antecedent <> consequent").distinct())
    front = edges.withColumn("depth", F.lit(1))
    found, depth, steps = front, 1, edges.toDF("_mid", "consequent")
    while not front.isEmpty():
        depth += 1
        onward = front.select("antecedent", F.col("consequent").alias("_mid")).join(steps, "_mid").where("antecedent <> consequent")
        front = cut(onward.select("antecedent", "consequent").distinct().join(found, ["antecedent", "consequent"], "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(front)  # of checkpointed parts
    return found


def ancestors(closed: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    """What a tag implies, by depth, then use, then name."""
    return closed.where(F.col("antecedent") == name).join(tags, closed["consequent"] == tags["name"]).select("name", "depth", "post_count").orderBy("depth", F.desc("post_count"), "name")


def descendants(closed: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    return closed.where(F.col("consequent") == name).join(tags, closed["antecedent"] == tags["name"]).select("name", "depth", "post_count").orderBy("depth", F.desc("post_count"), "name")


def expand(tags: DataFrame, glob: str, limit: int) -> DataFrame:
    """The most used tags that match, one more than the limit to show there are more."""
    return tags.where(F.col("name").rlike(S.glob_regex(glob)) & (F.col("post_count") > 0)).orderBy(F.desc("post_count"), "name").limit(limit + 1)


def unresolved(edges: DataFrame, tags: DataFrame) -> DataFrame:
    """Edges with an end that is no known tag."""
    names = tags.select("name")
    left = edges.join(names, edges["antecedent"] == names["name"], "left_anti")
    right = edges.join(names, edges["consequent"] == names["name"], "left_anti")
    return left.unionByName(right).distinct()


def ids_of(names: DataFrame, tags: DataFrame) -> DataFrame:
    """name, tag_id of the names (name) that are known tags."""
    return names.select(S.normal_tag(F.col("name")).alias("name")).distinct().join(tags.select("name", "tag_id"), "name")


def packed_tags(post_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """post_id, tag_ids: the ids of each post's tags, packed."""
    rows = post_tags.join(tags.select("name", "tag_id"), post_tags["tag"] == tags["name"])
    return rows.groupBy("post_id").agg(S.pack_ids(F.collect_set("tag_id")).alias("tag_ids"))


def tags_of_posts(post_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """post_id, category, names (sorted) of each post's known tags; a tag may come several times."""
    tags = cut(tags.select("name", "category"))
    tags = tags.hint("broadcast" if tags.count() <= MAX_BROADCAST_ROWS else "merge")
    rows = post_tags.join(tags, post_tags["tag"] == tags["name"])
    return rows.groupBy("post_id", "category").agg(F.array_sort(F.collect_set("name")).alias("names"))


def implied_membership(post_tags: DataFrame, closed: DataFrame) -> DataFrame:
    """post_id, tag with every implied tag added."""
    more = post_tags.join(closed, post_tags["tag"] == closed["antecedent"]).select("post_id", F.col("consequent").alias("tag"))
    return post_tags.select("post_id", "tag").unionByName(more).distinct()


class TagGraph:
    """Resolution of the names in a query. What reaches the driver is the answer for one
    name: its canonical name, the tags that imply it, or at most limit + 1 expansions."""

    def __init__(self, tags: DataFrame, aliases: DataFrame, implications: DataFrame):
        self.tags, self.aliases, self.implications = tags, aliases, implications
        self._names: dict[str, list[str]] = {}
        self._own: dict[str, str] = {}

    @cached_property
    def canonical(self) -> DataFrame:
        return canonical_aliases(self.aliases)

    @cached_property
    def closed(self) -> DataFrame:
        return closure(self.implications)

    def resolve(self, name: str) -> tuple[str, bool]:
        """(canonical name, whether it is a known tag); an alias to an unknown tag stays as it is."""
        row = self.canonical.where(F.col("antecedent") == name).select("canonical").first()
        target = row.canonical if row else name
        return target, not self.tags.where(F.col("name") == target).isEmpty()

    @cached_property
    def local(self) -> tuple[dict, dict] | None:
        """Aliases (name to next) and implications (name to those that imply it) of graphs of at most LOCAL_EDGES edges."""
        edges = self.implications.where((F.col("status") == "active") & (F.col("antecedent") != F.col("consequent")))
        rows = [df.select("antecedent", "consequent").limit(LOCAL_EDGES + 1).collect() for df in (latest_aliases(self.aliases), edges)]
        if max(map(len, rows)) > LOCAL_EDGES:
            return None
        below: dict[str, set] = {}
        for r in rows[1]:
            below.setdefault(r.consequent, set()).add(r.antecedent)
        return {r.antecedent: r.consequent for r in rows[0]}, below

    def _walk(self, name: str) -> tuple[str, list[str]]:
        """The canonical name and all that imply it, from the local graphs."""
        nxt, below = self.local
        seen = [name]
        while len(seen) <= HOPS and (then := nxt.get(seen[-1])) is not None and then not in seen:
            seen.append(then)
        found, todo = {seen[-1]}, [seen[-1]]
        while todo:
            fresh = below.get(todo.pop(), set()) - found
            found |= fresh
            todo += fresh
        return seen[-1], sorted(found)[: MAX_NAMES + 1]

    def prefetch(self, names: list[str]) -> None:
        """Closures of all the names, by one job at most; of a name that more than MAX_NAMES imply, only that it is so."""
        todo = sorted(set(names) - self._names.keys())
        if not todo:
            return
        if self.local is not None:
            for n in todo:
                self._own[n], self._names[n] = self._walk(n)
            return
        asked = F.broadcast(self.tags.sparkSession.createDataFrame([(n,) for n in todo], "name string"))
        own = F.coalesce("canonical", "name").alias("own")
        targets = self.canonical.join(asked, F.col("antecedent") == F.col("name"), "right").select("name", own)
        below = self.closed.join(F.broadcast(targets), F.col("consequent") == F.col("own"), "right").select("name", "own", "antecedent")
        place = F.row_number().over(Window.partitionBy("name").orderBy("antecedent"))
        found: dict[str, set] = {}
        for r in below.withColumn("_k", place).where(F.col("_k") <= MAX_NAMES + 1).collect():
            found.setdefault(r["name"], {r.own}).update({r.antecedent} - {None})
            self._own[r["name"]] = r.own
        self._names |= {n: sorted(x) for n, x in found.items()}

    def closure(self, name: str) -> list[str]:
        """The tag itself and all that imply it (up to MAX_NAMES and one more)."""
        self.prefetch([name])
        return self._names[name]

    def many(self, name: str) -> str | None:
        """The canonical name of a tag that more than MAX_NAMES others imply."""
        return self._own[name] if len(self.closure(name)) > MAX_NAMES else None

    def names_below(self, own: str) -> DataFrame:
        """The tag itself and all that imply it, as rows (tag, lower-cased)."""
        below = self.closed.where(F.col("consequent") == own).select(F.lower("antecedent").alias("tag"))
        return below.unionByName(below.sparkSession.createDataFrame([(own.lower(),)], "tag string"))

    def expand(self, glob: str, limit: int) -> tuple[list[str], bool]:
        names = [r.name for r in expand(self.tags, glob, limit).select("name").collect()]
        return names[:limit], len(names) > limit

    def report(self) -> dict:
        """Counts of the graph's tables, and whether tags are there at all."""
        out = {"tags": self.tags.count(), "aliases": self.aliases.count(), "implications": self.implications.count(), "closure": self.closed.count(), "unresolved": unresolved(self.implications.select("antecedent", "consequent"), self.tags).count()}
        return out | {"ready": out["tags"] > 0}
