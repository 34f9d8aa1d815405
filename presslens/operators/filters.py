"""Row filters as predicates; null never passes unless said so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.functions.text import match_count, matches
from presslens.functions.values import timestamp

#: Words that are surnames too, for which no alias is made.
AMBIGUOUS_SURNAMES = """
    may march august january april june
    price young king long short green brown black white grey gray fox hunt field ball bell bird bond bush camp church cook cross dale dean drew duke wood heath hill hope lamb
    law lee love page park pike potter power rice rich rose rule rush sharp smart smith snow stone strong swift ward waters winter wise noble cash best frost grant glass banks
    berry bolt brake burn close cole cotton crane day fair farmer fisher ford gold grove hand hardy hart horn house lake lane little mark marsh miller more new north odd old palm
    post prime ray read reed rest root sale shell shore silk spring steel still storm sweet vine wall way west wild will wolf worth bacon barton mason mills moon
""".split()
#: Relative and interrogative words that are no persona.
NO_PERSONA = ["that", "which", "who", "what"]
#: Terms whose number makes an article political, and phrases that rule it out.
POLITICAL_TERMS = [
    r"\belection(s)?\b", r"\bvot(e|ing|ers)?\b", r"\bballot(s)?\b", r"\bcampaign\b", r"\breferendum\b", r"\bparliament\b", r"\bcongress\b", r"\bgovernment\b", r"\bminister(s)?\b", r"\bmp(s)?\b", r"\bsenator(s)?\b",
    r"\bpresident\b", r"\bprime minister\b", r"\bwhite house\b", r"\bsupreme court\b", r"\blegislat(ion|ive|ure)\b", r"\bpolicy\b", r"\bimmigration\b", r"\btax(es|ation)?\b", r"\bparty\b", r"\bcoalition\b",
    r"\bconservative(s)?\b", r"\blabou?r\b", r"\bdemocrat(s|ic)?\b", r"\brepublican(s)?\b",
]
NOT_POLITICAL = [r"\boffice politics\b", r"\bworkplace politics\b", r"\bcampus politics\b"]


def among(c: Column, values: list[str]) -> Column:
    """Trimmed, whatever the case."""
    return F.lower(F.trim(c)).isin([v.strip().lower() for v in values])


def year_between(c: Column, first: int, last: int) -> Column:
    return F.coalesce(F.year(timestamp(c)).between(first, last), F.lit(False))


def filled(c: Column, reject_nan: bool = False) -> Column:
    ok = F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    return ok & (F.lower(F.trim(c)) != "nan") if reject_nan else ok


def all_match(c: Column, *patterns: str) -> Column:
    return reduce(lambda a, b: a & b, [matches(c, p) for p in patterns])


def relevance(c: Column, positive: list[str], negative: list[str]) -> Column:
    """Matches of the positive terms, 0 where a negative phrase is found or the text is null."""
    return F.when(matches(c, "|".join(negative)), F.lit(0)).otherwise(match_count(c, "|".join(positive))).cast("long")


def keyword_relevance(df: DataFrame, text: str, positive: list[str], negative: list[str], threshold: int = 5) -> DataFrame:
    return df.where(relevance(F.col(text), positive, negative) >= threshold)


def overlaps(start: Column, end: Column, first: Column, last: Column, strict: bool = False) -> Column:
    """Whether [start, end] meets [first, last]. An unknown bound is open; strict asks for one that is known."""
    meets = F.coalesce(start <= last, F.lit(True)) & F.coalesce(end >= first, F.lit(True))
    return meets & (start.isNotNull() | end.isNotNull()) if strict else meets


def any_overlap(memberships: Column, first: Column, last: Column, now: Column) -> Column:
    """Whether one of the memberships (start, end) meets [first, last]: its start must be known, an open end is now."""
    return F.exists(memberships, lambda m: F.coalesce((m["start"] <= last) & (F.coalesce(m["end"], now) >= first), F.lit(False)))


def year_or_fallback(published: Column, stamp: Column) -> Column:
    """The year of publication, else that of the capture."""
    return F.coalesce(F.year(published), F.substring(stamp, 1, 4).try_cast("int"))


def longer(c: Column, least: int) -> Column:
    return F.when(F.length(c) > least, c)
