"""Versions by the rules of SemVer 2.0.0, as values and as a sort key column."""

from __future__ import annotations

import re
from functools import total_ordering
from typing import NamedTuple

_NUMBER = r"(0|[1-9][0-9]*)"
_WORD = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
_FORM = re.compile(rf"[vV]?{_NUMBER}\.{_NUMBER}\.{_NUMBER}(?:-({_WORD}(?:\.{_WORD})*))?(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?")


@total_ordering
class Version(NamedTuple):
    """Build metadata takes no part in precedence; a pre-release comes before its release."""

    major: int
    minor: int
    patch: int
    pre: str = ""
    build: str = ""

    def rank(self):
        parts = [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in self.pre.split(".")] if self.pre else []
        return self[:3], not self.pre, parts

    def __lt__(self, other) -> bool:
        return self.rank() < other.rank()

    def __gt__(self, other) -> bool:
        return self.rank() > other.rank()

    def __le__(self, other) -> bool:
        return self.rank() <= other.rank()

    def __ge__(self, other) -> bool:
        return self.rank() >= other.rank()

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}" + (f"-{self.pre}" if self.pre else "") + (f"+{self.build}" if self.build else "")


def parse(text: str) -> Version:
    """A version or a tag of one, with at most one leading v; anything else is a ValueError."""
    found = _FORM.fullmatch(text.strip())
    if not found:
        raise ValueError(f"not a version of SemVer 2.0.0: {text!r}")
    return Version(int(found[1]), int(found[2]), int(found[3]), found[4] or "", found[5] or "")


def is_upgrade(current: str, following: str) -> bool:
    return parse(following) > parse(current)
