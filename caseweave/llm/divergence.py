"""Divergence of every (lang, source) group from its lang and from the lang's other sources.

Values depend on a term's counts alone, so they are evaluated per count cell, not per term:
the terms of a group fall into cells (count in the group, count in the lang), cells are ranked by
their value with their multiplicity, equal values merge, and only the cells that reach the last
rank wanted are expanded into terms, in UTF-8 order. Pairs of sources sum cells of two counts
over the terms that both hold; terms that only one holds, or neither, enter by each source's own
cells and the number of terms.

Tasks count their texts' terms before anything is shuffled, one row per lang and term.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.common import kept
from caseweave.llm.words import LETTERS, coded, text_slices, words_of

LEAST_DOCS, UNIT, RANKS = 3, 1_000_000_000, 200
HELD = 32 << 20


def _unique(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct combinations of non-negative numbers, ascending, and how often each occurs."""
    sizes = [int(k.max()) + 1 if len(k) else 1 for k in keys]
    one = np.zeros(len(keys[0]), np.int64)
    for k, n in zip(keys, sizes, strict=True):
        one = one * n + k
    one, count = np.unique(one, return_counts=True)
    out = []
    for n in reversed(sizes[1:]):
        one, last = np.divmod(one, n)
        out.append(last)
    return one, *reversed(out), count


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: (lang, source, text) to (lang, term, docs, sources, counts), a row per lang and term of about 32 MB of text."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        lang, source, text = pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns
        (lang_of, langs), (source_of, sources) = coded(lang), coded(source)
        words, sizes = words_of(text, LETTERS)
        word, distinct = coded(words)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        own_lang, own_word, own_source, counts = _unique(lang_of[doc], word, source_of[doc])
        by_doc, doc_word, _ = _unique(doc, word)
        _, _, docs = _unique(lang_of[by_doc], doc_word)  # as many rows, in the same order, as lang and word have below
        first = np.flatnonzero((np.diff(own_lang, prepend=-1) != 0) | (np.diff(own_word, prepend=-1) != 0))
        offsets = pa.array(np.append(first, len(own_word)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                langs.take(pa.array(own_lang[first])),
                distinct.take(pa.array(own_word[first])),
                pa.array(docs),
                pa.ListArray.from_arrays(offsets, sources.take(pa.array(own_source))),
                pa.ListArray.from_arrays(offsets, pa.array(counts)),
            ],
            ["lang", "term", "docs", "sources", "counts"],
        )

    held, size = [], 0
    for batch in batches:
        for part in text_slices(batch, 2, HELD):
            held.append(part)
            size += part.nbytes
            if size >= HELD:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def kept_terms(texts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, text) without nulls to lang, term, source, count, lang_count, lead: the terms in ``least_docs`` documents of the lang.

    ``lead`` marks one row of each lang and term.
    """
    rows = texts.mapInArrow(term_counts, "lang string, term string, docs long, sources array<string>, counts array<long>")
    rows = rows.repartition("lang", "term").select("lang", "term", F.posexplode(F.arrays_zip("sources", "counts")).alias("at", "s"), "docs")
    once = F.when(F.col("at") == 0, F.col("docs")).otherwise(0)  # a task's document count goes with its first source
    groups = rows.groupBy("lang", "term", F.col("s.sources").alias("source")).agg(F.sum("s.counts").alias("count"), F.sum(once).alias("docs"))
    whole = Window.partitionBy("lang", "term")
    all_ = groups.withColumn("lang_count", F.sum("count").over(whole)).withColumn("lang_docs", F.sum("docs").over(whole))
    lead = F.row_number().over(whole.orderBy("source")) == 1
    return all_.withColumn("lead", lead).where(F.col("lang_docs") >= least_docs).select("lang", "term", "source", "count", "lang_count", "lead")


def share(count: str | Column, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)) in whole numbers; null where there are no terms."""
    count = F.col(count) if isinstance(count, str) else count
    top = (count + 1).cast("decimal(27,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = F.when(F.col(terms) > 0, F.col(total) + F.col(terms)).cast("decimal(38,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), below) + 1


def gap(p: str, q: str) -> Column:
    """floor((p - q) ** 2 / q) in whole numbers; shares up to 3e9 fit 64 bits."""
    return F.call_function("div", (F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(q))


def top_terms(terms: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """lang, source, item, value, rank: the terms above their lang's share, the ``ranks`` first of each group."""
    of_group, cell = ["lang", "source"], ["lang", "source", "count", "lang_count"]
    cells = terms.groupBy(*cell).agg(F.count("*").alias("m")).join(groups, of_group)
    cells = cells.select(*cell, "m", share("count", "total", "n_terms").alias("p"), share("lang_count", "lang_total", "n_terms").alias("q"))
    cells = kept(cells.where("p > q").select(*cell, "m", gap("p", "q").alias("value")), "cells")
    best = Window.partitionBy(*of_group).orderBy(F.col("value").desc())
    # every value has a term at least, so no more than ``ranks`` values of a group are summed in order
    values = cells.groupBy(*of_group, "value").agg(F.sum("m").alias("m")).withColumn("at", F.row_number().over(best)).where(F.col("at") <= ranks)
    values = values.withColumn("before", F.sum("m").over(best.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).where(F.col("before") < ranks)
    reached = kept(cells.join(values.drop("m", "at"), [*of_group, "value"]).select(*cell, "value", "before"), "reached")
    names = Window.partitionBy(*of_group, "value").orderBy("term")
    found = terms.join(reached, cell).withColumn("at", F.row_number().over(names)).where(F.col("at") <= ranks)
    return found.select(*of_group, F.col("term").alias("item"), "value", (F.col("before") + F.col("at")).cast("int").alias("rank")).where(F.col("rank") <= ranks)


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: every other source of the lang, by the gap summed over all kept terms.

    With z the share of a term that a source lacks, the sum over all terms is that over the terms
    both hold, of gap(p, q) - gap(p, z) - gap(z, q) + gap(z, z), and each source's own cells
    against the other's z, and gap(z, z) for as many terms as are left. The sums stay below 5e18.
    """
    of_group, pair = ["lang", "source"], ["lang", "source", "other"]
    own = groups.select(*of_group, "held", "n_terms", share(F.lit(0), "total", "n_terms").alias("z"))
    theirs = own.select("lang", F.col("source").alias("other"), F.col("held").alias("other_held"), F.col("z").alias("other_z"))
    pairs = kept(own.join(theirs, "lang").where("source <> other"), "pairs")
    shares = terms.join(groups.select(*of_group, "total", "n_terms"), of_group).select("lang", "term", "source", share("count", "total", "n_terms").alias("p"))
    right = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"))
    both = shares.join(right, ["lang", "term"]).where("source < other").groupBy(*pair, "p", "q").agg(F.count("*").alias("m"))
    ways = F.array(F.struct("source", "other", "p", "q"), F.struct(F.col("other").alias("source"), F.col("source").alias("other"), F.col("q").alias("p"), F.col("p").alias("q")))
    both = both.select("lang", "m", F.inline(ways)).join(pairs, pair)
    both = both.select(*pair, (F.col("m") * (gap("p", "q") - gap("p", "other_z") - gap("z", "q") + gap("z", "other_z"))).alias("v"))
    cells = kept(shares.groupBy(*of_group, "p").agg(F.count("*").alias("m")), "own")
    alone = cells.join(pairs, of_group).select(*pair, (F.col("m") * gap("p", "other_z")).alias("v"))
    against = cells.withColumnRenamed("source", "other").join(pairs, ["lang", "other"]).select(*pair, (F.col("m") * gap("z", "p")).alias("v"))
    rest = pairs.select(*pair, ((F.col("n_terms") - F.col("held") - F.col("other_held")) * gap("z", "other_z")).alias("v"))
    sums = both.unionByName(alone).unionByName(against).unionByName(rest).groupBy(*pair).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("value"))
    order = Window.partitionBy(*of_group).orderBy(F.col("value").desc(), "other")
    return sums.select(*of_group, F.col("other").alias("item"), "value", F.row_number().over(order).alias("rank"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of ``docs``; parts are `pair` and `term`.

    Null texts, langs and sources count as ''. Terms are runs of letters A-Z and of signs beyond
    ASCII; only A-Z are lower-cased. Ties rank by UTF-8 order of the item. A lang without kept
    terms has pairs of value 0 and no terms; a lang with one source has no pairs; a document
    without terms still makes its group occur. Repeated rows count as often as they occur. An
    empty table gives no rows; other columns are not read.
    """
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    terms = kept(kept_terms(texts, least_docs), "terms")
    langs = terms.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.sum(F.col("lead").cast("long")).alias("n_terms"))
    own = terms.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("held"))
    groups = texts.select("lang", "source").distinct().join(langs, "lang", "left").join(own, ["lang", "source"], "left")
    groups = kept(groups.na.fill(0, ["lang_total", "n_terms", "total", "held"]), "groups")
    parts = [source_pairs(terms, groups).withColumn("part", F.lit("pair")), top_terms(terms, groups, ranks).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


#: Every term of every pair, without cells.
DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
l AS (SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, sum(c)::HUGEINT AS n, count(*)::HUGEINT AS v FROM l GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS c FROM t JOIN l USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM k GROUP BY ALL),
p AS (SELECT g.lang, g.source, l.term, coalesce(k.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(k.c, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p,
             1 + (1000000000::HUGEINT * (l.c + 1)) // (v.n + v.v) AS q
      FROM g JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN k USING (lang, source, term) LEFT JOIN n USING (lang, source)),
a AS (SELECT x.lang, x.source, x.term, 'term' AS part, ((p - q) * (p - q)) // q AS f FROM p x WHERE c > 0 AND p > q),
s AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS f
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
o AS (SELECT x.lang, x.source, y.source AS item, coalesce(s.f, 0) AS f FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
      LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
r AS (SELECT lang, source, 'pair' AS part, item, f, row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, item) AS rank FROM o
      UNION ALL
      SELECT lang, source, part, term, f, row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, term) FROM a)
SELECT lang, source, part, item, f::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
