"""Rule tables supplied by the user as DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.operators.keywords import match_terms


def first_rule(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, name, priority): the matching rule with the lowest priority.

    rules: priority, name, keywords. Works for a rule table of any size: the words are
    matched first, the best rule per text is a plain aggregation.
    """
    words = rules.select("priority", "name", F.explode("keywords").alias("term"))
    hits = match_terms(texts, key, text, words).join(words, "term")
    best = hits.groupBy(key).agg(F.min(F.struct("priority", "name")).alias("b"))
    return best.select(key, F.col("b.name").alias("name"), F.col("b.priority").alias("priority"))
