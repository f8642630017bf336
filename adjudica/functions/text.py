"""Text predicates and clean-ups shared by the converters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Option wordings that mean "none of these", the neutral wording shown instead, and the forms of level numbers.
ABSTAIN_PREFIXES = ("none of the above", "none of these", "not listed", "no suitable", "does not apply", "cannot tell")
ABSTAIN_EXACT = ("other", "unsure", "something else", "neither of these", "other / not covered")
ABSTAIN_WORDINGS = (
    "none of the above", "none of these", "not listed here", "other", "something else", "unsure",
    "does not apply", "no suitable option", "neither of these", "cannot tell from the text",
    "none of the above (out of scope)", "other / not covered",
)
NEUTRAL_NONE = "not listed here"
NEUTRAL_RE = "^none of the above|^(none|n/a|none of these)$"
SCALE_RE = r"^-?\d+:"
LEVEL_NUMBER_RE = r"^\s*-?\d+\s*:\s*"

ABSTAIN_RE = "^(" + "|".join(ABSTAIN_PREFIXES) + ")|^(" + "|".join(ABSTAIN_EXACT) + ")$"


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space (trim() removes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def nice_label(c: Column) -> Column:
    return strip(F.regexp_replace(c, "_", " "))


def camel_label(c: Column) -> Column:
    """'SoccerPlayer' -> 'soccer player'."""
    return F.lower(F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2"))


def clip(c: Column, n: int) -> Column:
    """The whole text when it has at most n characters, else its first n and ' ...'."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit(" ...")))


def is_abstain(option: Column) -> Column:
    return F.lower(strip(option)).rlike(ABSTAIN_RE)


def is_scale(options: Column) -> Column:
    return F.forall(options, lambda o: o.rlike(SCALE_RE))


def strip_level(option: Column) -> Column:
    return F.regexp_replace(option, LEVEL_NUMBER_RE, "")
