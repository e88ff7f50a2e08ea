"""Literal words of a rule table inside many texts, without a cross join."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.text import let
from caseweave.operators.automaton import find_terms


def grams(c: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters of a text, in one pass over its characters."""
    if n == 1:
        return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    return let(
        F.split(c, ""),
        lambda ch: F.array_distinct(
            F.filter(
                F.transform(ch, lambda x, i: F.concat(x, *[F.get(ch, i + k) for k in range(1, n)])),
                lambda r: F.length(r) == n,
            )
        ),
    )


def match_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """(key, term) for every term literally inside the text, by one automaton over all terms."""
    return find_terms(texts, key, text, terms, term).select(key, "term")
