"""A bound query to one lazy DataFrame.

Every condition becomes a boolean expression that is never null. Conditions on sidecar
tables become semi and anti joins where they stand alone at the top, else existence flags:
one left join per distinct sidecar condition, shared wherever it occurs. Tags are looked
up among the filtered edges of posts and tags, if the catalogue has them: a lone condition
by a semi join, several by one pass that gives each post a flag a condition. The rest is
left to Catalyst: filters, semi joins and the top-k sort are one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import scalars as S
from tagmill.lang.bind import Bounds, Condition, Query, Scope, Term, bind
from tagmill.lang.syntax import MUST, NOT
from tagmill.plans.catalog import Catalog

#: Up to so many names a tag's closure is a literal; more are joined (names compare without case either way).
LITERAL_NAMES = 64
#: columns of common results, for search(columns=...)
PROFILES = {
    "ids": ("post_id",),
    "summary": ("post_id", "rating", "score", "created_at"),
    "card": ("post_id", "rating", "score", "favcount", "file_ext", "md5", "width", "height"),
    "result": ("post_id", "rating", "score", "favcount", "comment_count", "file_ext", "md5", "width", "height", "all_tags", "created_at", "is_deleted"),
}


def tag_field(name: str) -> str:
    return name.removesuffix("_tags")


#: numeric field: (expression, columns it needs)
FIELDS = {
    "id": ("post_id", ("post_id",)),
    "score": ("score", ("score",)),
    "favcount": ("favcount", ("favcount",)),
    "comment_count": ("comment_count", ("comment_count",)),
    "width": ("width", ("width",)),
    "height": ("height", ("height",)),
    "duration": ("duration", ("duration",)),
    "filesize": ("file_size", ("file_size",)),
}


def value_of(name: str) -> tuple[Column, set[str]]:
    """Expression and columns of a numeric field or order key of the posts."""
    if name in FIELDS:
        column, needed = FIELDS[name]
        return F.col(column), set(needed)
    if name == "mpixels":
        return S.megapixels(F.col("width"), F.col("height")), {"width", "height"}
    if name == "tagcount":
        return F.size(F.array_distinct(F.transform("all_tags", F.lower))), {"all_tags"}
    if name == "aspect_ratio":
        return S.ratio_hundredths(F.col("width"), F.col("height")), {"width", "height"}
    if name.endswith("_tags"):
        return F.coalesce(F.size(F.col(f"tags.{tag_field(name)}")), F.lit(0)), {"tags"}
    if name == "change":
        return F.col("updated_at"), {"updated_at"}
    return F.col(name), {name}


def within(value: Column, b: Bounds) -> Column:
    if b.values:
        return value == b.values[0] if len(b.values) == 1 else value.isin(*b.values)
    out = []
    if b.low is not None:
        out.append(value >= b.low if b.low_in else value > b.low)
    if b.high is not None:
        out.append(value <= b.high if b.high_in else value < b.high)
    return reduce(Column.__and__, out)


def text_test(value: Column, pattern: tuple[str, str]) -> Column:
    mode, text = pattern
    low = F.lower(value)
    if mode == "glob":
        return low.rlike(S.glob_regex(text))
    return {"contains": low.contains, "prefix": low.startswith, "suffix": low.endswith}[mode](text)


STATUS = {
    "pending": lambda: F.col("is_pending"),
    "active": lambda: ~S.never_null(F.col("is_deleted")) & ~S.never_null(F.col("is_pending")) & ~S.never_null(F.col("is_flagged")),
    "deleted": lambda: F.col("is_deleted"),
    "flagged": lambda: F.col("is_flagged"),
    "modqueue": lambda: S.never_null(F.col("is_pending")) | S.never_null(F.col("is_flagged")),
}


@dataclass
class Lookup:
    """Rows of a sidecar that a condition holds for: key names the column they share with the posts."""

    rows: DataFrame
    key: str = "post_id"


@dataclass
class Compiled:
    query: Query
    filter: Column
    fields: set[str] = field(default_factory=set)
    flags: dict[str, Lookup] = field(default_factory=dict)
    joins: list[tuple[Lookup, bool]] = field(default_factory=list)
    tag_flags: DataFrame | None = None


def tag_conditions(scope: Scope) -> list[Condition]:
    out = []
    for term in [*scope.required, *scope.loose]:
        if isinstance(term.node, Scope):
            out += tag_conditions(term.node)
        elif term.node.kind == "tags":
            out.append(term.node)
    return out


def merged(scope: Scope) -> Scope:
    """The scope with every bucket of nothing but tags as one condition on all their names."""
    required = [Term(t.occurrence, merged(t.node)) if isinstance(t.node, Scope) else t for t in scope.required]
    required = [Term(t.occurrence, n.required[0].node) if isinstance(n := t.node, Scope) and n.status is None and not n.loose and len(n.required) == 1 and n.required[0].occurrence == MUST else t for t in required]
    loose = [Term(t.occurrence, merged(t.node)) if isinstance(t.node, Scope) else t for t in scope.loose]
    if loose and all(isinstance(t.node, Condition) and t.node.kind == "tags" and t.node.extra is None for t in loose):
        names = sorted({n for t in loose for n in t.node.value})
        one = Condition("tags", " ".join(t.node.field for t in loose), tuple(names))
        required, loose = [*required, Term(MUST, one)], []
    return Scope(required, loose, scope.status)


class Compiler:
    def __init__(self, catalog: Catalog, viewer: int | None = None, tolerance: bool = False, candidate: bool = False):
        self.catalog, self.viewer, self.tolerance, self.candidate = catalog, viewer, tolerance, candidate
        self.fields: set[str] = {"post_id"}
        self.flags: dict = {}
        self.joins: list = []
        self.tags: dict[tuple, str] = {}
        self.by_edge = "post_tags" in catalog.sidecars
        self.lone = False

    def run(self, query: Query) -> Compiled:
        tests = []
        root = merged(query.root)
        self.lone = len({c.value for c in tag_conditions(root)}) == 1
        rest = Scope([], root.loose, root.status)
        for term in root.required:
            found = self.lookup(term.node) if isinstance(term.node, Condition) else None
            if found is not None:
                self.joins.append((found, term.occurrence != NOT))
            else:
                rest.required.append(term)
        tests.append(self.scope(rest, True))
        if query.hide_deleted:
            self.fields.add("is_deleted")
            tests.append(~S.never_null(F.col("is_deleted")))
        for found in [*(x for _, x in self.flags.values()), *(x for x, _ in self.joins)]:
            self.fields.add(found.key)
        return Compiled(query, reduce(Column.__and__, tests), self.fields, {k: v for k, v in self.flags.values()}, self.joins, self.tag_table())

    def tag_table(self) -> DataFrame | None:
        """post_id and a flag for each tag condition, of the posts that any holds for: one pass over the edges."""
        if not self.tags:
            return None
        edges = self.catalog.table("post_tags").select("post_id", F.lower("tag").alias("tag"))
        every = sorted({n for names in self.tags for n in names})
        return edges.where(F.col("tag").isin(*every)).groupBy("post_id").agg(*(F.max(F.col("tag").isin(*names)).alias(c) for names, c in self.tags.items()))

    def scope(self, scope: Scope, wide: bool) -> Column:
        """wide: where something cannot be decided, err towards matching (else towards not matching)."""
        tests = []
        if scope.status and scope.status[0] not in ("any", "all"):
            name, wanted = scope.status
            self.fields |= {"is_deleted", "is_pending", "is_flagged"}
            test = S.never_null(STATUS[name]())
            tests.append(test if wanted else ~test)
        elif scope.status and not scope.status[1]:
            tests.append(F.lit(False))
        for term in scope.required:
            tests.append(~self.node(term.node, not wide) if term.occurrence == NOT else self.node(term.node, wide))
        if scope.loose:
            tests.append(reduce(Column.__or__, [self.node(t.node, wide) for t in scope.loose]))
        return reduce(Column.__and__, tests) if tests else F.lit(True)

    def node(self, node, wide: bool) -> Column:
        if isinstance(node, Scope):
            return self.scope(node, wide)
        if self.candidate and self.unknown(node):
            return F.lit(wide)
        if node.kind == "tags" and self.by_edge and node.extra is None and 0 < len(node.value) <= LITERAL_NAMES:
            names = tuple(n.lower() for n in node.value)
            return S.never_null(F.col(self.tags.setdefault(names, f"_tag{len(self.tags)}")))
        found = self.lookup(node)
        if found is not None:
            key = repr(node)
            if key not in self.flags:
                self.flags[key] = (f"_has{len(self.flags)}", found)
            return S.never_null(F.col(self.flags[key][0]))
        return S.never_null(self.leaf(node))

    def unknown(self, c: Condition) -> bool:
        """Whether the tables at hand cannot decide a condition."""
        needed = {"user": c.extra, "vote": "votes", "member": c.field}.get(c.kind, "")
        if c.kind == "text":
            needed = {"note": "notes", "delreason": "deletion_events"}.get(c.field, "")
        if c.kind == "present" and c.field == "pools":
            needed = "pools"
        if c.kind == "user" and isinstance(c.value, str) and "users" not in self.catalog.sidecars:
            return True
        return bool(needed) and needed not in self.catalog.sidecars

    def lookup(self, c: Condition) -> Lookup | None:
        """The rows of a sidecar that a condition holds for; None if the post itself decides."""
        if self.candidate and self.unknown(c):
            return None
        table = self.catalog.table
        if c.kind == "tags" and self.by_edge and c.value:
            edges = table("post_tags").select("post_id", F.lower("tag").alias("tag"))
            if c.extra is not None:
                return Lookup(edges.join(self.catalog.tags.names_below(c.extra), "tag", "left_semi"))
            if len(c.value) > LITERAL_NAMES:
                names = edges.sparkSession.createDataFrame([(n.lower(),) for n in c.value], "tag string")
                return Lookup(edges.join(names, "tag", "left_semi"))
            return Lookup(edges.where(F.col("tag").isin(*(n.lower() for n in c.value)))) if self.lone else None
        if c.kind == "tags" and c.extra is not None:
            raise ValueError(f"{c.field} stands for more names than a literal holds: the catalog needs post_tags")
        if c.kind == "text" and c.field in ("note", "delreason"):
            name, column = {"note": ("notes", "body"), "delreason": ("deletion_events", "reason")}[c.field]
            return Lookup(table(name).where(text_test(F.col(column), c.value)))
        if c.kind == "present" and c.field == "pools" and c.value:
            return Lookup(table("pools"))
        if c.kind == "vote":
            votes = table("votes")
            if self.viewer is not None:
                votes = votes.where(F.col("user_id") == self.viewer)
            return Lookup(votes.where({0: F.lit(True), 1: F.col("score") > 0, -1: F.col("score") < 0}[c.value]))
        if c.kind == "member":
            rows = table(c.field)
            if isinstance(c.value, int):
                return Lookup(rows.where(F.col("collection_id") == c.value))
            own = F.col("name") if "shortname" not in rows.columns else F.coalesce("name", "shortname")
            test = S.normal_tag(own) == c.value
            if "shortname" in rows.columns:
                test = test | (S.normal_tag(F.col("shortname")) == c.value)
            return Lookup(rows.where(S.never_null(test)))
        if c.kind == "user" and c.extra and not (c.value == "me" and self.viewer is None):
            rows = table(c.extra)
            if c.extra == "notes" and "note_versions" in self.catalog.sidecars:
                rows = rows.select("post_id", "user_id").unionByName(table("note_versions").select("post_id", "user_id"))
            return Lookup(self.by_user(rows, "user_id", c.value))
        if c.kind == "user" and c.value != "me" and not isinstance(c.value, int):
            column = {"uploader": "uploader_id", "approver": "approver_id"}[c.field]
            return Lookup(self.named(c.value, column), column)
        return None

    def named(self, name: str, column: str) -> DataFrame:
        return self.catalog.table("users").where(F.lower(F.trim("name")) == name).select(F.col("user_id").alias(column))

    def by_user(self, rows: DataFrame, column: str, who) -> DataFrame:
        if who == "me":
            return rows.where(F.col(column) == self.viewer)
        if isinstance(who, int):
            return rows.where(F.col(column) == who)
        return rows.join(self.named(who, column), column, "left_semi")

    def need(self, *names: str) -> None:
        self.fields.update(names)

    def leaf(self, c: Condition) -> Column:
        if c.kind == "never" or (c.kind == "user" and c.value == "me" and self.viewer is None):
            return F.lit(False)
        if c.kind == "tags":
            self.need("all_tags")
            return F.arrays_overlap(F.transform("all_tags", F.lower), F.array(*(F.lit(n.lower()) for n in c.value))) if c.value else F.lit(False)
        if c.kind == "glob":
            self.need("all_tags")
            regex = S.glob_regex(c.field)
            return F.exists("all_tags", lambda t: F.lower(t).rlike(regex))
        if c.kind in ("number", "size", "ratio"):
            value, needed = value_of({"size": "filesize", "ratio": "aspect_ratio"}.get(c.kind, c.field))
            self.fields |= needed
            if c.kind == "size" and self.tolerance and c.value.values:
                x = c.value.values[0]
                return value.between(int(x * 0.95), int(x * 1.05))
            return within(value, c.value)
        if c.kind == "equal":
            self.need(c.field)
            return F.lower(F.col(c.field)) == c.value if isinstance(c.value, str) else F.col(c.field) == c.value
        if c.kind == "date":
            self.need(c.field)
            start, end = c.value
            tests = [F.col(c.field) >= F.lit(start)] * (start is not None) + [F.col(c.field) < F.lit(end)] * (end is not None)
            return reduce(Column.__and__, tests)
        if c.kind == "text":
            if c.field == "source":
                self.need("sources")
                return F.exists("sources", lambda s: text_test(s, c.value))
            self.need("description")
            return text_test(F.col("description"), c.value)
        if c.kind == "present":
            if c.field == "pools":
                return ~self.node(Condition("present", "pools", True), False)
            self.need(c.field)
            here = F.size("sources") > 0 if c.field == "sources" else F.length("description") > 0
            return S.never_null(here) == F.lit(c.value)
        if c.kind == "flag":
            if c.field == "is_child":
                self.need("parent_post_id")
                here = F.col("parent_post_id").isNotNull()
            elif c.field == "is_parent":
                self.need("child_count")
                here = F.col("child_count") > 0
            else:
                self.need(c.field)
                return F.col(c.field) == F.lit(c.value)
            return S.never_null(here) == F.lit(c.value)
        if c.kind == "user":
            column = {"uploader": "uploader_id", "approver": "approver_id"}[c.field]
            self.need(column)
            return F.col(column) == (self.viewer if c.value == "me" else c.value)
        if c.kind == "own":
            column, needed = c.extra
            self.fields |= set(needed)
            return column(c.value)
        raise ValueError(c.kind)


def shuffled(ident: Column, seed: int | None) -> Column:
    """A key that puts ids in an order of its own for each seed (MD5, so that other engines can follow)."""
    return F.md5(F.concat_ws(":", ident.cast("string"), F.lit(str(seed or 0))))


def order_columns(query: Query, catalog: Catalog) -> tuple[list[Column], set[str], DataFrame | None]:
    """Sort columns (ties by id, same direction), the posts' columns they need, a sidecar of keys to join."""
    key, direction = query.order
    down = direction != "asc"
    turn = lambda c: c.desc_nulls_last() if down else c.asc_nulls_first()
    ident = F.col("post_id").desc() if down else F.col("post_id").asc()
    if key == "id":
        return [ident], {"post_id"}, None
    if key == "random":
        return [shuffled(F.col("post_id"), query.seed).asc(), F.col("post_id").asc()], {"post_id"}, None
    if key == "hot":
        # an extension: newer and better scored first
        heat = F.ln(F.greatest(F.col("score"), F.lit(1)).cast("double")) / F.ln(F.lit(10.0)) + F.unix_timestamp("created_at") / 45000.0
        return [heat.desc(), F.col("post_id").desc()], {"score", "created_at"}, None
    if key in ("comment", "comment_bumped", "note"):
        name = "notes" if key == "note" else "comments"
        rows = catalog.table(name)
        if key == "comment_bumped" and "bumps" in rows.columns:
            rows = rows.where("bumps")  # comments that do not bump their post do not count
        latest = rows.groupBy("post_id").agg(F.max("created_at").alias("_latest"))
        return [turn(F.col("_latest")), ident], {"post_id"}, latest
    value, needed = value_of(key)
    return [turn(value), ident], needed, None


def search(text: str, catalog: Catalog, now: datetime | None = None, viewer: int | None = None, limit: int | None = None, columns: tuple[str, ...] = ("post_id",), tolerance: bool = False, candidate: bool = False, ordered: bool = True) -> DataFrame:
    """The posts that match, in the query's order, as one lazy DataFrame.

    limit: None for the query's own, 0 for none at all. candidate: a superset that needs
    no table the catalog lacks.
    """
    query = bind(text, catalog.tags, now).checked()
    compiled = Compiler(catalog, viewer, tolerance, candidate).run(query)
    sort, needed, latest = order_columns(query, catalog) if ordered else ([], set(), None)
    if query.hot_from and query.hot_from[0]:
        needed = needed | {"created_at"}
        compiled.filter = compiled.filter & S.never_null(F.col("created_at") >= F.lit(query.hot_from[0]))
    posts = catalog.posts(compiled.fields | needed | set(columns))
    for name, found in compiled.flags.items():
        posts = posts.join(found.rows.select(found.key).distinct().withColumn(name, F.lit(True)), found.key, "left")
    if compiled.tag_flags is not None:
        posts = posts.join(compiled.tag_flags, "post_id", "left")
    out = posts.where(compiled.filter)
    for found, wanted in compiled.joins:
        out = out.join(found.rows.select(found.key), found.key, "left_semi" if wanted else "left_anti")
    if latest is not None:
        out = out.join(latest, "post_id", "left")
    n = limit if limit is not None else query.limit
    if sort and n is not None:
        out = out.orderBy(*sort).limit(n)
    elif sort:
        out = out.orderBy(*sort)
    elif n is not None:
        out = out.limit(n)
    return out.select(*columns)


def matches(text: str, catalog: Catalog, posts: DataFrame, **options) -> DataFrame:
    """Of given post_id, those that match (for re-evaluation of queued work)."""
    return posts.join(search(text, catalog, ordered=False, **options), "post_id", "left_semi")
