from datetime import datetime

import pytest

from tagmill.lang import dates
from tagmill.lang.bind import Bounds, Scope, bind, pattern, ratio
from tagmill.lang.notes import QueryError
from tagmill.lang.syntax import tokens
from tagmill.lang.words import CATEGORIES, ORDERS, order
from tagmill.plans.explain import amended, describe, explain

NOW = datetime(2001, 8, 1, 15, 30)



def shape(scope):
    """A bound scope as nested tuples: (prefix and name, or a group's shape)."""
    part = lambda t: (t.occurrence, shape(t.node)) if isinstance(t.node, Scope) else t.occurrence + t.node.field
    return [part(t) for t in scope.required], [part(t) for t in scope.loose], scope.status


# grammar: what a query's terms are bound to (required, loose, status)
@pytest.mark.parametrize(("text", "want"), [
    ("lighthouse", (["lighthouse"], [], None)),
    ("Stone_Bridge  RIVER", (["stone_bridge", "river"], [], None)),
    ("river -fog", (["river", "-fog"], [], None)),
    ("~snow ~rain river", (["river"], ["~snow", "~rain"], None)),
    ("status:flagged river", (["river"], [], ("flagged", True))),
    ("-status:pending", ([], [], ("pending", False))),
    ("status:pending status:active", ([], [], ("active", True))),
    ("( river fog )", ([("", (["river", "fog"], [], None))], [], None)),
    ("-( ~river ~fog ) boat", ([("-", ([], ["~river", "~fog"], None)), "boat"], [], None)),
    ("~( boat -sail ) ~tide", ([], [("~", (["boat", "-sail"], [], None)), "~tide"], None)),
    ("( a ( b ( c ) ) )", ([("", (["a", ("", (["b", ("", (["c"], [], None))], [], None))], [], None))], [], None)),
    ("( status:deleted tide )", ([("", (["tide"], [], ("deleted", True)))], [], None)),
    ("order:score limit:3 tide", (["tide"], [], None)),
    ("", ([], [], None)),
])
def test_terms_are_bound_by_prefix_and_group(text, want):
    assert shape(bind(text, now=NOW).root) == want


# metatags: kind, field and value
@pytest.mark.parametrize(("text", "want"), [
    ("id:7", ("number", "id", Bounds((7,)))), ("comm_count:1", None), ("favcount:>=12", ("number", "favcount", Bounds(low=12))), ("tagcount:3,9", ("number", "tagcount", Bounds((3, 9)))),
    ("rating:q", ("equal", "rating", "q")), ("rating:Explicit", ("equal", "rating", "e")), ("ext:GIF", ("equal", "file_ext", "gif")), ("type:png", ("equal", "file_ext", "png")),
    ("md5:" + "Ab" * 16, ("equal", "md5", "ab" * 16)), ("mpixels:..2.5", ("number", "mpixels", Bounds(high=2.5))), ("duration:<61", ("number", "duration", Bounds(high=61, high_in=False))),
    ("ratio:16:9", ("ratio", "ratio", Bounds((178,)))), ("filesize:3kb..1MB", ("size", "file_size", Bounds(low=3072, high=1048576))), ("filesize:77", ("size", "file_size", Bounds((77,)))),
    ("date:1999-12-31", ("date", "created_at", (datetime(1999, 12, 31), datetime(2000, 1, 1)))),
    ("source:none", ("present", "sources", False)), ("source:*.org/x*", ("text", "source", ("contains", ".org/x"))), ('description:"Two Words"', ("text", "description", ("contains", "two words"))),
    ("note:ab*", ("text", "note", ("prefix", "ab"))), ("delreason:*z", ("text", "delreason", ("suffix", "z"))),
    ("ischild:perhaps", None), ("ischild:false", ("flag", "is_child", False)), ("isparent:true", ("flag", "is_parent", True)), ("parent:31", ("equal", "parent_post_id", 31)), ("parent:none", ("flag", "is_child", False)),
    ("child:any", ("flag", "is_parent", True)), ("locked:status", ("flag", "status_locked", True)), ("notelocked:true", ("flag", "note_locked", True)), ("hasdescription:true", ("present", "description", True)),
    ("inpool:false", ("present", "pools", False)), ("artverified:true", ("flag", "artist_verified", True)), ("pending_replacements:false", ("flag", "pending_replacements", False)),
    ("pool:88", ("member", "pools", 88)), ("set:Harbour_Views", ("member", "sets", "harbour_views")), ("user:Nadia", ("user", "uploader", "nadia")), ("user:!52", ("user", "uploader", 52)), ("user_id:52", ("user", "uploader", 52)),
    ("approver:Nadia", ("user", "approver", "nadia")), ("commenter:!3", ("user", "commenter", 3)), ("noter:me", ("user", "noter", "me")), ("fav:Nadia", ("user", "favorite", "nadia")), ("deletedby:!3", ("user", "deleter", 3)),
    ("voted:any", ("vote", "votes", 0)), ("upvote:any", ("vote", "votes", 1)), ("downvote:any", ("vote", "votes", -1)), ("blacklisted:x", ("never", "", None)), ("colour:blue", ("never", "", None)),
])
def test_metatags_bind_to_conditions(text, want):
    nodes = [t.node for t in bind(text, now=NOW).root.required]
    if want is None:
        assert [n.kind for n in nodes] == ["never"]
    else:
        assert [(n.kind, n.field, n.value) for n in nodes] == [want]


# diagnostics: the code, and the text of its place
@pytest.mark.parametrize(("text", "code", "place"), [
    ("tide colour:blue", "UNKNOWN_METATAG", "colour:blue"), ("rating:mild", "INVALID_METATAG_VALUE", "rating:mild"), ("tide favcount:many", "INVALID_RANGE", "favcount:many"), ("width:..", "INVALID_RANGE", "width:.."),
    ("date:2001-02-30", "INVALID_DATE", "date:2001-02-30"), ("filesize:4TB", "INVALID_SIZE", "filesize:4TB"), ("ratio:wide", "INVALID_RATIO", "ratio:wide"), ("hassource:perhaps", "INVALID_BOOLEAN", "hassource:perhaps"),
    ("user:!nadia", "INVALID_USER_REF", "user:!nadia"), ("set:", "INVALID_COLLECTION_REF", "set:"), ("order:colour", "INVALID_ORDER", "order:colour"), ("limit:-4", "INVALID_LIMIT", "limit:-4"),
    ("randseed:7x", "INVALID_RANDSEED", "randseed:7x"), ("hot_from:soon", "INVALID_HOT_FROM", "hot_from:soon"), ("~status:flagged", "STATUS_TILDE_UNSUPPORTED", "~status:flagged"),
    ("status:pending status:active", "STATUS_SCOPE_CONFLICT", "status:pending"), ("~*boat", "WILDCARD_TILDE_NOT_EXPANDED", "~*boat"), ("~order:favcount", "OPTION_IN_LOOSE_OR_BUCKET", "~order:favcount"),
    ("status:all", "IMPLICIT_DELETED_FILTER_SUPPRESSED", "status:all"), ("commenter:Nadia", "AUXILIARY_DATA_REQUIRED", "commenter:Nadia"), ("voted:any", "PERMISSION_GATED_FEATURE", "voted:any"),
    ("blacklisted:x", "BLACKLIST_PROFILE_UNSUPPORTED", "blacklisted:x"), ("order:id", "COMPATIBILITY_AMBIGUITY", "order:id"),
])
def test_diagnostics_have_codes_and_places(text, code, place):
    found = [n for n in bind(text, now=NOW).notes if n.code == code]
    assert found and text[slice(*found[0].span)] == place


@pytest.mark.parametrize(("text", "code"), [("( boat", "UNCLOSED_GROUP"), ("boat )", "UNEXPECTED_CLOSE_GROUP"), ("( boat)", "GROUP_SPACING_INVALID"), ('note:"half', "MALFORMED_QUOTED_VALUE"), ("*boat sail*", "POSITIVE_WILDCARD_LIMIT_EXCEEDED")])
def test_broken_queries_have_codes(text, code):
    assert code in {n.code for n in bind(text, now=NOW).notes}


def test_limits_count_terms_and_depth():
    words = [f"w{k}" for k in range(41)]
    assert bind(" ".join(words[:40])).ok and {n.code for n in bind(" ".join(words)).notes} == {"TERM_LIMIT_EXCEEDED"}
    deep = lambda n: "( " * n + "x" + " )" * n
    assert bind(deep(10)).ok and {n.code for n in bind(deep(11)).notes} == {"GROUP_DEPTH_EXCEEDED"}


def test_errors_stop_a_query():
    with pytest.raises(QueryError, match="INVALID_RANGE at 5-13"):
        bind("tide height:x").checked()


def test_parentheses_in_names_and_groups():
    root = bind("tide_(sea) (boat) ( red rope_(long ) mast").root
    assert [t.node.field for t in root.required if not isinstance(t.node, Scope)] == ["tide_(sea)", "(boat)", "mast"]
    group = next(t.node for t in root.required if isinstance(t.node, Scope))
    assert [t.node.field for t in group.required] == ["red", "rope_(long"]


def test_wildcards_join_the_loose_bucket():
    root = bind("tide ~a *_b").root
    assert [t.node.kind for t in root.loose] == ["tags", "glob"] and len(root.required) == 1
    assert bind("-*_b").root.required[0].occurrence == "-"


@pytest.mark.parametrize(("text", "want"), [
    ("id:100", Bounds((100,))), ("id:1,2", Bounds((1, 2))), ("id:25..50", Bounds(low=25, high=50)), ("id:>=1.5", Bounds(low=1.5)),
    ("id:>1", Bounds(low=1, low_in=False)), ("id:..9", Bounds(high=9)), ("id:<9", Bounds(high=9, high_in=False)), ("filesize:1.5KB", Bounds((1536,))), ("ratio:4:3", Bounds((133,))),
])
def test_ranges(text, want):
    assert bind(text).root.required[0].node.value == want


def test_ratio_rounds_half_up():
    assert ratio("2.675") == 268 and ratio("0.125") == 13


def test_text_patterns():
    assert [pattern(x) for x in ("A", "*a*", "a*", "*a", "a*b", "*a*b*")] == [("contains", "a"), ("contains", "a"), ("prefix", "a"), ("suffix", "a"), ("glob", "a*b"), ("glob", "*a*b*")]


@pytest.mark.parametrize(("text", "start", "end"), [
    ("2001-02-28", (2001, 2, 28), (2001, 3, 1)), ("feb/3/2000", (2000, 2, 3), (2000, 2, 4)), ("today", (2001, 8, 1), (2001, 8, 2)), ("yesterday", (2001, 7, 31), (2001, 8, 1)),
    ("yesterweek", (2001, 7, 23), (2001, 7, 30)), ("yestermonth", (2001, 7, 1), (2001, 8, 1)), ("yesteryear", (2000, 1, 1), (2001, 1, 1)), ("2_weeks_ago", (2001, 7, 18), (2001, 7, 19)),
    ("18_months_ago", (2000, 2, 1), (2000, 2, 2)), ("2_yestermonths_ago", (2001, 6, 1), (2001, 7, 1)), ("2001-05-01..2001-04-01", (2001, 4, 1), (2001, 5, 2)),
])
def test_dates(text, start, end):
    assert dates.interval(text, NOW) == (datetime(*start), datetime(*end))


def test_open_dates_and_no_dates():
    assert dates.interval("..2001-01-01", NOW) == (None, datetime(2001, 1, 2))
    assert dates.plus_months(datetime(2001, 3, 31), -1) == datetime(2001, 2, 28)
    for bad in ("..", "2001-13-01", "smarch/1/2001", "x", "99999_days_ago"):
        with pytest.raises(ValueError):
            dates.interval(bad, NOW)


def test_orders():
    for name, key in ORDERS.items():
        assert order(name, False) == (key, "desc") == order(f"{name}_desc", False) == order(f"{name}_asc", True)
        assert order(name, True) == (key, "asc") == order(f"{name}_asc", False)
    assert order("portrait", False) == ("aspect_ratio", "asc") == order("landscape", True)
    assert order("random", True) == ("random", "") and order("nope", False) is None and order("nope_asc", False) is None
    assert all(order(f"{c}_tags", False) for c in CATEGORIES)


def test_options_hold_for_the_whole_query():
    q = bind("( order:score limit:5 ) limit:7 limit:x randseed:3")
    assert (q.order, q.limit, q.seed, q.default_order) == (("score", "desc"), 7, 3, False) and not q.ok


def test_tokens_keep_places():
    assert tokens('-cat score:>=3..5 ( "x" )')[0] == ("not", "-", 0)
    assert "".join(t[1] for t in tokens('a-b ~c x:1,2 "q" ( y )')) == 'a-b ~c x:1,2 "q" ( y )'


def test_explain():
    data = explain("harbour -night ~fog ~rain rating:q order:favcount limit:6 note:x")
    assert data["required_tags"] == ["harbour"] and data["excluded_tags"] == ["night"] and data["loose_or_buckets"] == [["fog", "rain"]]
    assert data["query_options"]["order"]["key"] == "favcount" and data["query_options"]["limit"] == 6 and "notes" in data["data_dependencies"]
    assert "without deleted" in describe(bind("a")) and amended("a", "b ~c") == "a -( b ~c )"
