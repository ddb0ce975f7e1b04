"""What a search runs on: posts, sidecar tables, the tag graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tagmill.operators.tags import TagGraph


@dataclass
class Catalog:
    """posts(fields) gives the posts with at least those columns: a source that has to
    assemble posts joins only what the fields need. sidecars give tables by name, with
    post_id and user_id, created_at, score, body, reason, collection_id or name.
    """

    posts: Callable[[set[str]], DataFrame]
    sidecars: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    tags: TagGraph | None = None

    @staticmethod
    def of(posts: DataFrame, sidecars: dict[str, DataFrame] | None = None, tags: TagGraph | None = None) -> Catalog:
        return Catalog(lambda fields: posts, {k: (lambda v=v: v) for k, v in (sidecars or {}).items()}, tags)

    def table(self, name: str) -> DataFrame:
        if name not in self.sidecars:
            raise ValueError(f"the catalog has no table {name}")
        return self.sidecars[name]()

    def missing(self, required: set[str]) -> set[str]:
        """Diagnostics for callers: tables a query needs that are not there."""
        return {x for x in required if x != "tags" and x not in self.sidecars} | ({"tags"} if "tags" in required and self.tags is None else set())
