"""Bounded lexical matching with phrase suppression.

A term matches where no ASCII letter, digit or underscore touches it; neighbours of other scripts don't
block it. White space in a term matches any run. A hit that overlaps one of the term's suppressing
phrases doesn't count, other hits of the term do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import casefolded, fold_phrase

_EDGE = "A-Za-z0-9_"


@dataclass(frozen=True)
class Term:
    """A term and the phrases whose spans suppress it."""

    term_id: str
    phrase: str
    unless: tuple[str, ...] = ()


def folded(text: Column, full: bool = False) -> Column:
    """Lower case, or ``full`` case folding, with dotted and dotless I as i, white space as single spaces."""
    plain = F.translate(text, "İı", "ii")
    return F.trim(F.regexp_replace(casefolded(plain) if full else F.lower(plain), r"(?U)\s+", " "))


def _folded_terms(terms: Sequence[Term]) -> list[Term]:
    return [replace(t, phrase=fold_phrase(t.phrase), unless=tuple(map(fold_phrase, t.unless))) for t in terms]


def _literal(phrase: str) -> str:
    return r"\s+".join("".join(c if c.isalnum() else "\\" + c for c in word) for word in phrase.lower().split())


def _bounded(phrase: str) -> str:
    return f"(?<![{_EDGE}])(?:{_literal(phrase)})(?![{_EDGE}])"


def matches(text: Column, term: Term) -> Column:
    """Whether a folded text has a hit of the term outside all its suppressing phrases.

    A bounded phrase that contains the term is consumed whole before the term alone is tried, so a hit inside
    it is never seen; a phrase that overlaps the term's edge is excluded by a look-around.
    """
    if not term.unless:
        return text.rlike(_bounded(term.phrase))
    whole = "|".join(_bounded(p) for p in sorted(term.unless, key=lambda p: (-len(p), p)))
    masked = F.regexp_replace(text, whole, " \u0001 ")
    return masked.rlike(_bounded(term.phrase))


def hits(rows: DataFrame, text: str, terms: Sequence[Term], excluded: Sequence[str] = (), full: bool = False) -> DataFrame:
    """``rows`` with ``term_ids``, the sorted ids of matching terms; none for a text equal to an excluded one."""
    low = folded(F.col(text), full)
    if full:
        terms, excluded = _folded_terms(terms), [fold_phrase(e) for e in excluded]
    found = F.array_compact(F.array(*[F.when(matches(F.col("_folded"), t), F.lit(t.term_id)) for t in terms]))
    ids = F.array_sort(F.array_distinct(found))
    if excluded:
        ids = F.when(F.col("_folded").isin(*[e.lower() for e in excluded]), F.array().cast("array<string>")).otherwise(ids)
    return rows.withColumn("_folded", low).withColumn("term_ids", ids).drop("_folded")


def hits_by_automaton(rows: DataFrame, key: str, text: str, terms: Sequence[Term], full: bool = False) -> DataFrame:
    """``(key, term_ids)`` by one Aho-Corasick pass over each text: for hundreds of terms."""
    import ahocorasick

    if full:
        terms = _folded_terms(terms)

    automaton = ahocorasick.Automaton()
    by_phrase: dict[str, list[Term]] = {}
    for t in terms:
        by_phrase.setdefault(" ".join(t.phrase.lower().split()), []).append(t)
    for phrase, own in by_phrase.items():
        automaton.add_word(phrase, (len(phrase), own))
    automaton.make_automaton()
    edge = re.compile(f"[{_EDGE}]")

    def spans(low: str, phrase: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.finditer(_bounded(phrase), low)]

    def found(low: str) -> list[str]:
        out = set()
        for last, (length, own) in automaton.iter(low):
            a, b = last - length + 1, last + 1
            if (a and edge.match(low[a - 1])) or (b < len(low) and edge.match(low[b])):
                continue
            for t in own:
                if not any(a < y and x < b for p in t.unless for x, y in spans(low, p)):
                    out.add(t.term_id)
        return sorted(out)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "term_ids": [found(t) for t in batch["low"]]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, F.coalesce(folded(F.col(text), full), F.lit("")).alias("low")).mapInPandas(match, f"{key} {kind}, term_ids array<string>")
