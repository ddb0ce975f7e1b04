"""What the language's words mean: metatags, orders and values.

Fixed values: the spellings below are what users type.
"""

from __future__ import annotations

TERM_LIMIT, WILDCARD_LIMIT, EXPANSION_LIMIT, DEPTH_LIMIT = 40, 1, 40, 10

CATEGORIES = ("general", "artist", "contributor", "copyright", "character", "species", "invalid", "meta", "lore")
_SHORT = {"general": "gen", "artist": "art", "contributor": "cont", "copyright": "copy", "character": "char", "species": "spec", "invalid": "inv", "meta": "meta", "lore": "lor"}

#: metatag: numeric field
NUMBERS = {x: x for x in ("id", "score", "favcount", "comment_count", "tagcount", "width", "height", "mpixels", "duration")}
NUMBERS["commentcount"] = "comment_count"
NUMBERS |= {f"{c}_tags": f"{c}_tags" for c in CATEGORIES} | {f"{s}tags": f"{c}_tags" for c, s in _SHORT.items()}

RATINGS = {"s": "s", "safe": "s", "q": "q", "questionable": "q", "e": "e", "explicit": "e"}
FILE_TYPES = ("jpg", "png", "gif", "webp", "mp4", "swf", "webm")
STATUSES = ("pending", "active", "deleted", "flagged", "modqueue", "any", "all")
#: statuses that lift the implicit exclusion of deleted posts
LIFTING = ("active", "deleted", "any", "all")
TRUE, FALSE = ("true", "yes", "1"), ("false", "no", "0")

#: metatag: (role, table the role is looked up in; "" for the post itself)
USERS = {
    "user": ("uploader", ""), "user_id": ("uploader", ""), "approver": ("approver", ""),
    "commenter": ("commenter", "comments"), "comm": ("commenter", "comments"),
    "noter": ("noter", "notes"), "noteupdater": ("noter", "notes"),
    "fav": ("favorite", "favorites"), "favoritedby": ("favorite", "favorites"),
    "deletedby": ("deleter", "deletion_events"),
}
#: metatag: sign of the vote, 0 for any
VOTES = {"voted": 0, "votedup": 1, "upvote": 1, "voteddown": -1, "downvote": -1}
LOCKS = {"rating": "rating_locked", "note": "note_locked", "notes": "note_locked", "status": "status_locked"}

#: order name: key
ORDERS = {
    "id": "id", "score": "score", "favcount": "favcount", "comment_count": "comment_count", "comm_count": "comment_count",
    "comm": "comment", "comment": "comment", "comm_bumped": "comment_bumped", "comment_bumped": "comment_bumped",
    "created_at": "created_at", "created": "created_at", "updated_at": "updated_at", "updated": "updated_at",
    "filesize": "filesize", "size": "filesize", "ratio": "aspect_ratio", "aspect_ratio": "aspect_ratio",
    "mpixels": "mpixels", "duration": "duration", "tagcount": "tagcount", "md5": "md5", "change": "change", "note": "note",
}
ORDERS |= {f"{c}_tags": f"{c}_tags" for c in CATEGORIES} | {f"{s}tags": f"{c}_tags" for c, s in _SHORT.items()}

#: what a key or predicate needs besides the posts
NEEDS = {"comment": "comments", "comment_bumped": "comments", "note": "notes"}


def order(name: str, turned: bool) -> tuple[str, str] | None:
    """(key, direction) of an order's name; direction "" where there is none."""
    name = name.lower()
    if name in ("random", "hot"):
        return name, ""
    if name in ("portrait", "landscape"):
        return "aspect_ratio", "asc" if (name == "portrait") != turned else "desc"
    down = True
    if name not in ORDERS:
        stem, _, end = name.rpartition("_")
        if end not in ("asc", "desc") or stem not in ORDERS:
            return None
        name, down = stem, end == "desc"
    return ORDERS[name], "desc" if down != turned else "asc"
