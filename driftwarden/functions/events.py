"""Row-level expressions over event logs (EXP-1..13).

Predicates are never NULL: a missing value makes every predicate false, except
that a missing recipient is external and a missing device is unknown.
"""

from __future__ import annotations

from collections.abc import Sequence

from .. import fixed
from .text import text


def _known(predicate: str) -> str:
    return f"coalesce({predicate}, false)"


def _one_of(values: Sequence[str]) -> str:
    return ", ".join(map(text, values))


def parse_date(column: str, strict: bool = True, pattern: str | None = None) -> str:
    """Text to timestamp, ISO without a pattern; unparseable text raises, or is NULL if
    not strict."""
    if pattern is None:
        return f"{'cast' if strict else 'try_cast'}({column} as timestamp_ntz)"
    parse = "to_timestamp" if strict else "try_to_timestamp"
    return f"cast({parse}({column}, {text(pattern)}) as timestamp_ntz)"


def event_hour(date: str) -> str:
    return f"hour({date})"


def event_weekday(date: str) -> str:
    """Monday is 0."""
    return f"weekday({date})"


def late_night(date: str, start: int = fixed.LATE_FROM, end: int = fixed.LATE_UNTIL) -> str:
    """Whole hours, both ends included: 05:59 is still late at night."""
    return _known(f"(hour({date}) >= {start} or hour({date}) <= {end})")


def after_hours(date: str, start: int = fixed.WORK_FROM, end: int = fixed.WORK_UNTIL) -> str:
    """Outside the working hours, which include the whole end hour."""
    return _known(f"hour({date}) not between {start} and {end}")


def weekend(date: str) -> str:
    return _known(f"weekday({date}) >= 5")


def external_recipient(to: str, domain: str = fixed.COMPANY_DOMAIN) -> str:
    """``domain`` is a case-insensitive regular expression found anywhere."""
    return f"not {_known(f'{to} rlike ' + text('(?i)' + domain))}"


def contains_word(column: str, word: str) -> str:
    """Failed logins, file copies and USB use: a word found in any case."""
    return _known(f"contains(lower({column}), {text(word.lower())})")


def sensitive_file(
    file_name: str, extensions: Sequence[str] = fixed.SENSITIVE_EXTENSIONS
) -> str:
    ends = [f"endswith(lower({file_name}), {text(e)})" for e in extensions]
    return _known(f"({' or '.join(ends)})")


def unknown_device(device: str, trusted: Sequence[str] = fixed.TRUSTED_DEVICES) -> str:
    return f"not {_known(f'lower({device}) in ({_one_of(trusted)})')}"


def critical_activity(activity: str, critical: Sequence[str] = fixed.CRITICAL_ACTIVITIES) -> str:
    return _known(f"lower({activity}) in ({_one_of(critical)})")
