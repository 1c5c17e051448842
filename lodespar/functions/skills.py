"""Skill lists as native columns: canonical names, display names, vocabulary matches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodespar.functions.vocabulary import DISPLAY, PER_YEAR, SKILLS, SYNONYMS


def _lookup(table: dict[str, str], key: Column) -> Column:
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(found, key), key)


def _no_skills() -> Column:
    return F.array().cast("array<string>")


def canonical(skills: Column) -> Column:
    """Trimmed, lower-cased, synonyms merged, distinct and sorted; null is empty."""
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(skills, _no_skills()), lambda s: _lookup(SYNONYMS, F.lower(F.trim(s))))))


def displayed(skills: Column) -> Column:
    """Display names, in the order of the canonical ones."""
    return F.transform(canonical(skills), lambda s: _lookup(DISPLAY, s))


def vocabulary_pattern(term: str) -> str:
    """A term between characters that cannot belong to a name, for Java's regular expressions."""
    return r"(?U)(?<![\w.+#])" + "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in term) + r"(?![\w+#])"


def terms(text: Column, vocabulary: list[str] | None = None) -> Column:
    """The vocabulary's terms that occur in a free text, in the vocabulary's order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array(*[F.when(low.rlike(vocabulary_pattern(s)), F.lit(s)) for s in (vocabulary or SKILLS)])
    return F.filter(found, lambda s: s.isNotNull())


def name_of(term: Column) -> Column:
    return _lookup(SYNONYMS, term)


def in_text(text: Column, vocabulary: list[str] | None = None) -> Column:
    """Canonical names of the vocabulary's terms that occur in a free text."""
    return canonical(terms(text, vocabulary))


def in_text_local(text: str | None, vocabulary: list[str] | None = None) -> list[str]:
    """The same for one request's text, without a job."""
    low = (text or "").lower()
    found = {SYNONYMS.get(s, s) for s in (vocabulary or SKILLS) if re.search(rf"(?<![\w.+#]){re.escape(s)}(?![\w+#])", low)}
    return sorted(found)


def display_local(skills: list[str]) -> list[str]:
    return [DISPLAY.get(s, s) for s in sorted({SYNONYMS.get(s.strip().lower(), s.strip().lower()) for s in skills})]


def to_annual(amount: Column, period: Column) -> Column:
    """Pay per year; null if either is missing or the period is unknown."""
    rate = F.create_map(*[F.lit(x) for pair in PER_YEAR.items() for x in pair])
    return amount * F.element_at(rate, period)


_KNOWN = {*SKILLS, *SYNONYMS.values()}
_REASONS = ("empty term", "not in the vocabulary: only if the post clearly names it as a technology")


def canonical_skill(term: Column) -> Column:
    """struct<known, canonical, reason>: whether the vocabulary has the term, under which name, or why not."""
    key = F.lower(F.trim(F.coalesce(term, F.lit(""))))
    name = _lookup(SYNONYMS, key)
    known = (key != "") & name.isin(sorted(_KNOWN))
    reason = F.when(key == "", _REASONS[0]).when(~known, _REASONS[1])
    return F.struct(known.alias("known"), F.when(known, name).alias("canonical"), reason.alias("reason"))


def canonical_local(term: str | None) -> dict:
    """The same for a model's tool; no reason where the term is known."""
    key = " ".join((term or "").lower().split(" ")).strip()
    name = SYNONYMS.get(key, key)
    if name in _KNOWN:
        return {"known": True, "canonical": name}
    return {"known": False, "canonical": None, "reason": _REASONS[bool(key)]}
