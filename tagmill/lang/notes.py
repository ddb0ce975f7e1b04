"""Diagnostics that carry a code, a severity and a place in the query."""

from __future__ import annotations

from dataclasses import dataclass

ERROR, WARNING, INFO = "error", "warning", "info"

# The codes that callers match on.
CODES = (
    "UNKNOWN_METATAG INVALID_METATAG_VALUE INVALID_RANGE INVALID_DATE INVALID_SIZE INVALID_RATIO INVALID_BOOLEAN "
    "INVALID_USER_REF INVALID_COLLECTION_REF INVALID_ORDER INVALID_LIMIT INVALID_RANDSEED INVALID_HOT_FROM "
    "GROUP_DEPTH_EXCEEDED GROUP_SPACING_INVALID UNCLOSED_GROUP UNEXPECTED_CLOSE_GROUP TERM_LIMIT_EXCEEDED "
    "POSITIVE_WILDCARD_LIMIT_EXCEEDED STATUS_TILDE_UNSUPPORTED STATUS_SCOPE_CONFLICT WILDCARD_TILDE_NOT_EXPANDED "
    "WILDCARD_RESULTS_TRUNCATED IMPLICIT_DELETED_FILTER_SUPPRESSED AUXILIARY_DATA_REQUIRED PERMISSION_GATED_FEATURE "
    "BLACKLIST_PROFILE_UNSUPPORTED COMPATIBILITY_AMBIGUITY "
    "OPTION_IN_LOOSE_OR_BUCKET MALFORMED_QUOTED_VALUE "
    "UNRESOLVED_EXTERNAL_DEPENDENCY"
).split()


@dataclass(frozen=True)
class Note:
    severity: str
    code: str
    text: str
    span: tuple[int, int]


class QueryError(ValueError):
    """A query that must not run; notes say why and where."""

    def __init__(self, notes: list[Note]):
        self.notes = notes
        super().__init__("; ".join(f"{n.code} at {n.span[0]}-{n.span[1]}: {n.text}" for n in notes))


class Notes(list):
    def add(self, severity: str, code: str, text: str, span: tuple[int, int]) -> None:
        assert code in CODES, code
        self.append(Note(severity, code, text, span))

    def error(self, code: str, text: str, span: tuple[int, int]) -> None:
        self.add(ERROR, code, text, span)

    def warn(self, code: str, text: str, span: tuple[int, int]) -> None:
        self.add(WARNING, code, text, span)

    @property
    def errors(self) -> list[Note]:
        return [n for n in self if n.severity == ERROR]
