"""What a query means, as data and in words."""

from __future__ import annotations

from tagmill.lang.bind import Condition, Query, Scope, bind
from tagmill.lang.syntax import NOT
from tagmill.lang.syntax import tokens as tokenize


def walk(scope: Scope, negated: bool = False):
    """(term, loose, negated) of every condition."""
    for term in [*scope.required, *scope.loose]:
        inner = negated != (term.occurrence == NOT)
        if isinstance(term.node, Scope):
            yield from walk(term.node, inner)
        else:
            yield term, term in scope.loose, inner


def explain(text: str, catalog=None, now=None) -> dict:
    q = bind(text, catalog, now)
    terms = list(walk(q.root))
    tags = [(t.node.field, loose, negated) for t, loose, negated in terms if t.node.kind in ("tags", "glob")]
    return {
        "query": text,
        "ok": q.ok,
        "parse": {"tokens": len(tokenize(text)), **q.stats},
        "groups": q.stats["groups"],
        "required_tags": [t for t, loose, no in tags if not loose and not no],
        "excluded_tags": [t for t, loose, no in tags if no],
        "loose_or_buckets": buckets(q.root),
        "metatags": [{"kind": t.node.kind, "field": t.node.field, "negated": no} for t, _, no in terms if t.node.kind not in ("tags", "glob")],
        "query_options": {"order": {"key": q.order[0], "direction": q.order[1], "default": q.default_order}, "limit": q.limit, "randseed": q.seed},
        "compatibility": {"deleted_hidden": q.hide_deleted},
        "data_dependencies": sorted(q.needs),
        "backend_support": "dataframe",
        "diagnostics": [{"severity": n.severity, "code": n.code, "message": n.text, "span": list(n.span)} for n in q.notes],
        "description": describe(q),
    }


def buckets(scope: Scope) -> list[list[str]]:
    own = [[name(t.node) for t in scope.loose]] if scope.loose else []
    return own + [b for t in [*scope.required, *scope.loose] if isinstance(t.node, Scope) for b in buckets(t.node)]


def name(node) -> str:
    return "group" if isinstance(node, Scope) else node.field or node.kind


def _said(node) -> str:
    if isinstance(node, Scope):
        return f"({_scope(node)})"
    c: Condition = node
    if c.kind in ("tags", "glob"):
        return f"tagged {c.field}"
    return f"{c.field or c.kind} {c.value}" if c.value is not None else c.kind


def _scope(scope: Scope) -> str:
    parts = [("not " if t.occurrence == NOT else "") + _said(t.node) for t in scope.required]
    if scope.loose:
        parts.append("any of " + " or ".join(_said(t.node) for t in scope.loose))
    if scope.status:
        parts.append(("" if scope.status[1] else "not ") + f"status {scope.status[0]}")
    return " and ".join(parts) or "everything"


def describe(q: Query) -> str:
    key, way = q.order
    order = {"": f"in {key} order"}.get(way, f"by {key}, {'largest' if way == 'desc' else 'smallest'} first")
    return f"Posts: {_scope(q.root)}; {order}" + (f"; {q.limit} at most" if q.limit else "") + ("; without deleted ones." if q.hide_deleted else ".")


def canonical(text: str, catalog) -> str:
    """The query with every tag that is an alias replaced by its canonical name."""
    from tagmill.lang.notes import Notes
    from tagmill.lang.syntax import parse

    spans = []

    def collect(raws):
        for r in raws:
            collect(r.terms)
            if r.kind == "tag":
                target, known = catalog.resolve(r.text.lower())
                if known and target != r.text.lower():
                    spans.append((r.span, r.prefix + target))

    collect(parse(text, Notes()))
    for (a, b), new in sorted(spans, reverse=True):
        text = text[:a] + new + text[b:]
    return text


def amended(text: str, exclude: str) -> str:
    """The query without what another query matches."""
    return f"{text} -( {exclude} )" if exclude.strip() else text
