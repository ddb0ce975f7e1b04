"""Dates of the language, resolved against a given now to half-open intervals (UTC)."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

# The names of months in dates like april/27/2012.
MONTHS = "january february march april may june july august september october november december".split()


def midnight(t: datetime) -> datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def plus_months(t: datetime, n: int) -> datetime:
    """The same day n months on, or that month's last day."""
    year, month = divmod(t.year * 12 + t.month - 1 + n, 12)
    first = t.replace(year=year, month=month + 1, day=1)
    after = first.replace(year=year + (month == 11), month=(month + 1) % 12 + 1)
    return first.replace(day=min(t.day, (after - first).days))


def back(t: datetime, n: int, unit: str) -> datetime:
    days = {"day": 1, "week": 7}.get(unit)
    return t - timedelta(days=days * n) if days else plus_months(t, -n * {"month": 1, "year": 12, "decade": 120}[unit])


def period(t: datetime, unit: str, n: int) -> tuple[datetime, datetime]:
    """The n-th calendar week (from Monday), month or year before the one of t."""
    day = midnight(t)
    if unit == "week":
        start = day - timedelta(days=day.weekday() + 7 * n)
        return start, start + timedelta(days=7)
    step = {"month": 1, "year": 12}[unit]
    first = day.replace(day=1, month=1 if unit == "year" else day.month)
    start = plus_months(first, -step * n)
    return start, plus_months(start, step)


def day_of(t: datetime) -> tuple[datetime, datetime]:
    return midnight(t), midnight(t) + timedelta(days=1)


def single(text: str, now: datetime) -> tuple[datetime, datetime]:
    """Interval of one date; ValueError if it is none."""
    text = text.strip().lower()
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return day_of(datetime.strptime(text, "%Y-%m-%d"))
    if m := re.fullmatch(r"([a-z]+)/(\d{1,2})/(\d{4})", text):
        months = [k for k, name in enumerate(MONTHS, 1) if name == m[1] or (len(m[1]) == 3 and name.startswith(m[1]))]
        return day_of(datetime(int(m[3]), months[0] if months else 0, int(m[2])))
    if text in ("today", "yesterday"):
        return day_of(now - timedelta(days=text == "yesterday"))
    if text in ("day", "week", "month", "year", "decade"):
        return back(now, 1, text), now + timedelta(microseconds=1)
    if m := re.fullmatch(r"yester(week|month|year)", text):
        return period(now, m[1], 1)
    if m := re.fullmatch(r"(\d{1,4})_(day|week|month|year)s_ago", text):
        return day_of(back(now, int(m[1]), m[2]))
    if m := re.fullmatch(r"(\d{1,4})_yester(week|month|year)s_ago", text):
        return period(now, m[2], int(m[1]))
    raise ValueError(text)


def interval(text: str, now: datetime) -> tuple[datetime | None, datetime | None]:
    """[start, end) of a date or range; None where it is open. Reversed ranges are turned."""
    if ".." not in text:
        return single(text, now)
    left, right = text.split("..", 1)
    if not left and not right:
        raise ValueError(text)
    a = single(left, now) if left else None
    b = single(right, now) if right else None
    if a and b and a[0] > b[1]:
        a, b = b, a
    return a[0] if a else None, b[1] if b else None
