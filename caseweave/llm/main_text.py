"""Main text of web pages: markup rules, and a suffix array per host for repeated text.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts and
comments are left out by tag, class, id and role. Where article and main elements hold at least
half of what is left, their text is the main text (the page is closed); of other, open pages it is
all that is left. Of both, runs of ``RUN`` words or more that a clear share of the host's pages
holds are boilerplate and are cut out: ``SHARE`` of its distinct pages and ``LEAST`` at least. In
a closed page only what stands in so many closed pages is cut, so a line that other pages repeat
around their text, or a passage that a few articles quote, stays in an article.

A host's distinct pages are concatenated in chunks of bounded size. Prefix doubling sorts the
suffixes of a chunk by their first ``RUN`` words. What a share of all pages holds is held by that
share of some chunk's pages, so each chunk names its prefixes that are as frequent, and only those
are looked up and counted in all chunks of the host. The cut is therefore the same however the
host is split.
"""
from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import kept

RUN, CHUNK = 10, 1 << 20
SHARE, LEAST = 0.3, 3

TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+>?|/[^a-zA-Z][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)|/?\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
DROPPED = frozenset("nav header footer aside form noscript template svg math object select button dialog menu canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SHUNNED = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing "
    "social related recommended recommendations comment comments disqus replies respond discussion pagination pager toolbar login search widget copyright disclaimer".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar note".split())
SETTING = frozenset("has with without no is js not".split())
#: Inside an article, and for articles: words that are also headings and topics say nothing in an id or beside other words.
TOPICS = frozenset("header masthead banner menu navigation notice notices notification alert social discussion search login copyright disclaimer replies subscription advertising promotion".split())
SURE = SHUNNED - TOPICS
BESIDE = frozenset("area article articles bar block body bottom box button buttons container content form group inline inner item items label left link links list outer post posts right section slot stories story thread top unit widget wrap wrapper".split())
#: Start tags that end an open paragraph; for others, what they end and what stops the search for it.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select datalist"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table"), "tbody": ("tbody thead tfoot", "table"), "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table"),
}
ENDS = {k: tuple(frozenset(x.split()) for x in v) for k, v in ENDS.items()}
PARAGRAPH = frozenset(("p",))
THROUGH = frozenset("article main table caption thead tbody tfoot tr td th".split())
CELLS = frozenset("table caption td th".split())
LIST = CELLS | {"ul", "ol"}
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")


def _telling(key: str, one: str) -> bool:
    """Does a whole class or id say that an element inside an article, or an article, holds no main text?"""
    if one in SURE or key == "class" and one in SHUNNED and one not in ("header", "discussion"):
        return True
    parts = set(re.split(r"[-_]+", one)) - {""}
    return not parts.isdisjoint(SURE) and parts <= SURE | BESIDE


def _shunned(name: str, attributes: str, inside: bool) -> bool:
    """Does an element with these attributes hold no main text? ``inside``: it stands in an article."""
    if not attributes or name in ("html", "body", "main"):
        return False
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "").lower()
        if key in ("class", "id"):
            for one in value.split():
                if inside or name == "article":
                    if _telling(key, one):
                        return True
                    continue
                parts = re.split(r"[-_]+", one)
                words.update(parts if parts[0] not in SETTING else ())
        elif key == "role" and value.strip() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return not words.isdisjoint(SHUNNED)


def _within(opened: list[str], floor: int, to: int, ended: frozenset[str], stops: frozenset[str] | None) -> int:
    """Where the innermost of ``ended`` stands in ``opened[floor:to]``, unless one of ``stops`` (None: all but inline ones) stands further in; else ``to``."""
    for k in range(to - 1, floor - 1, -1):
        if opened[k] in ended:
            return k
        if opened[k] not in INLINE if stops is None else opened[k] in stops:
            return to
    return to


def blocks_of(page: str) -> tuple[list[str], bool]:
    """Text blocks in page order, and whether they are those of article and main elements.

    They are if such elements, outside comments, scripts and left-out parts, hold at least half of
    the text that the rules leave; else the page is open and all of that text is given.
    """
    blocks: list[tuple[str, bool]] = []
    run: list[str] = []
    opened: list[str] = []  # open elements; an end tag closes all that were opened after its own
    count: Counter[str] = Counter()  # of their names
    mains: list[int] = []  # where accepted articles and mains stand among them
    dropped = -1  # where the element that is being left out stands among them
    seen_main = False
    at, n = 0, len(page)

    def close() -> None:
        if text := " ".join("".join(run).split()):
            blocks.append((text, bool(mains)))
        run.clear()

    while at < n:
        m = TAG.search(page, at)
        start = m.start() if m else n
        if start > at and dropped < 0:
            text = page[at:start]
            run.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not m[4]:
            break  # cut off, or a quote that never ends: the rest is markup
        if name in RAW and not closing:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            continue
        if name not in INLINE and dropped < 0:
            close()
        floor = mains[-1] + 1 if mains and name not in ("article", "main") else 0  # only its own kind ends an article
        to = len(opened)
        if closing:
            last = to
            if count[name] > 0:
                to = _within(opened, floor, to, frozenset((name,)), None if name in INLINE else frozenset() if name in THROUGH else LIST if name == "li" else CELLS)
            if to == last and dropped >= floor and opened[dropped] == name:
                to = dropped
        else:
            if name in ENDS_P and count["p"]:
                to = _within(opened, floor, to, PARAGRAPH, None)
            if name in ENDS:
                to = _within(opened, floor, to, *ENDS[name])
        if to < len(opened):
            count.subtract(opened[to:])
            del opened[to:]
        while mains and mains[-1] >= to:
            mains.pop()
        if dropped >= to:
            dropped = -1
        if closing or name in VOID or name in ("html", "head", "body") or m[3].endswith("/") and SELF_CLOSED.search(m[3]):
            continue
        opened.append(name)
        count[name] += 1
        if name in ("article", "main") and (dropped < 0 or not seen_main) and not _shunned(name, m[3], bool(mains)):
            dropped = -1  # an element left open before the first article does not swallow it
            close()
            mains.append(to)
            seen_main = True
        elif dropped < 0 and (name in DROPPED and not (name == "header" and mains) or name == "article" or _shunned(name, m[3], bool(mains))):
            dropped = to
    close()
    inside = [text for text, main in blocks if main]
    if inside and 2 * sum(map(len, inside)) >= sum(len(text) for text, _ in blocks):
        return inside, True
    return [text for text, _ in blocks], False


def _word_numbers(words: list[str]) -> np.ndarray:
    number = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in set(words)}
    return np.fromiter(map(number.__getitem__, words), np.uint64, len(words))


def _drop_rare(rank: np.ndarray, least: float) -> np.ndarray:
    n = np.bincount(rank[rank >= 0], minlength=1)
    rank[(rank >= 0) & (n[rank] < least)] = -1
    return rank


def prefix_ranks(tokens: np.ndarray, left: np.ndarray, run: int, least: float = 1) -> np.ndarray:
    """Rank of every suffix by its first ``run`` tokens (prefix doubling).

    -1 where fewer are ``left`` on the page, or where the prefix stands at fewer than ``least`` places.
    """
    rank = _drop_rare(np.unique(tokens, return_inverse=True)[1].astype(np.int64), least)
    depth = 1
    while depth < run:
        step = min(depth, run - depth)  # prefixes may overlap in the last round
        ahead = np.full(len(rank), -1, np.int64)
        ahead[: max(0, len(rank) - step)] = rank[step:]
        depth += step
        at = np.flatnonzero((rank >= 0) & (ahead >= 0) & (left >= depth))
        key = rank[at] * (len(rank) + 1) + ahead[at]
        rank = np.full(len(rank), -1, np.int64)
        rank[at] = np.unique(key, return_inverse=True)[1]
        rank = _drop_rare(rank, least)
    rank[left < run] = -1
    return rank


def _streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers, tokens left on the page, page row and position, of the concatenated pages."""
    words = [t.split(" ") for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    page = np.repeat(np.arange(len(words)), size)
    pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return _word_numbers([w for ws in words for w in ws]), np.repeat(size, size) - pos, page, pos


def _prefix_hash(tokens: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k in range(run):
        h = (h ^ tokens[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies that a task has seen go; which task saw them does not matter, as later steps count contents."""
    seen: set[tuple] = set()
    for b in batches:
        keep = []
        for key in zip(*(b.column(c).to_pylist() for c in ("host", "content", "closed")), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        if len(seen) > 1 << 18:
            seen.clear()
        yield b.filter(pa.array(keep, pa.bool_()))


def frequent(run: int, share: float, least: int):
    """Arrow function for a chunk of a host: its distinct pages (prefix null), and the prefixes that a share of them holds."""

    def each(rows: pa.Table) -> pa.Table:
        tokens, left, page, _ = _streams(rows["text"].to_pylist())
        distinct, number = np.unique(rows["content"].to_numpy(), return_inverse=True)
        closed = np.zeros(len(distinct), np.int64)
        np.maximum.at(closed, number, rows["closed"].to_numpy().astype(np.int64))
        n, n_closed = len(distinct), int(closed.sum())
        lowest = 1 if rows["parts"][0].as_py() > 1 else least
        of_all, of_closed = (max(lowest, share * k - 1e-9) if k else np.inf for k in (n, n_closed))
        rank = prefix_ranks(tokens, left, run, min(of_all, of_closed))
        at = np.flatnonzero(rank >= 0)
        pairs, first = np.unique(rank[at] * n + number[page[at]], return_index=True)
        ranks, begin = np.unique(pairs // n, return_index=True)
        holding, holding_closed = (np.add.reduceat(v, begin) if len(begin) else begin for v in (np.ones(len(pairs), np.int64), closed[pairs % n]))
        chosen = first[begin[(holding >= of_all) | (holding_closed >= of_closed)]]
        prefix = [None, *_prefix_hash(tokens, at[chosen], run).tolist()]
        k = len(prefix)
        return pa.table({"host": pa.array([rows["host"][0].as_py()] * k, pa.string()), "prefix": pa.array(prefix, pa.int64()), "n": pa.array([n] * k, pa.int64()), "n_closed": pa.array([n_closed] * k, pa.int64())})

    return each


def places(run: int):
    """Arrow function for a chunk of a host and prefixes: where they stand in each distinct page."""

    def each(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if rows.num_rows:
            _, first = np.unique(np.column_stack([rows["content"].to_numpy(), rows["closed"].to_numpy().astype(np.int64)]), axis=0, return_index=True)
            rows = rows.take(pa.array(first))
        tokens, left, page, pos = _streams(rows["text"].to_pylist())
        at = np.flatnonzero(left >= run)
        prefix = _prefix_hash(tokens, at, run)
        hit = np.isin(prefix, wanted["prefix"].to_numpy())
        at, prefix = at[hit], prefix[hit]
        order = np.lexsort((pos[at], prefix, page[at]))
        at, prefix = at[order], prefix[order]
        new = np.flatnonzero((np.diff(page[at], prepend=-1) != 0) | (prefix != np.roll(prefix, 1)))
        starts = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array(pos[at].astype(np.int32)))
        of = rows.take(pa.array(page[at[new]]))
        return pa.table({"host": of["host"], "content": of["content"], "closed": of["closed"], "prefix": pa.array(prefix[new]), "starts": starts})

    return each


def unique_runs(text: str, starts: list[int], run: int) -> str:
    """The words of ``text`` that no repeated run covers; ``starts`` are the runs' first words."""
    words = text.split(" ")
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.array(starts, np.int64))
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + run, len(words)), -1)
    return " ".join(w for w, c in zip(words, np.cumsum(cover), strict=False) if not c)


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("closed", T.BooleanType()), T.StructField("content", T.LongType())]))
def _parsed(page: pd.Series) -> pd.DataFrame:
    rows = []
    for p in page:
        blocks, closed = blocks_of(p or "")
        text = " ".join(blocks)
        rows.append((text, closed, xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)))
    return pd.DataFrame(rows, columns=["text", "closed", "content"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, chunk: int = CHUNK, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null and empty pages give an empty text. Pages of equal text are one page to the suffix
    array, so copies do not make each other boilerplate. Pages without a readable host form one
    host. Repeated rows are extracted each. Other columns are not read; an empty table gives an
    empty result. Pages are parsed anew in each pass, which is cheaper than to keep their text.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), _host(url_col).alias("host"), F.col(html_col).alias("html"))
    parsed = rows.select("page_id", "url", "host", _parsed("html").alias("p")).select("page_id", "url", "host", "p.text", "p.closed", "p.content")
    size = F.ceil(F.sum(F.length("html")) / F.lit(6 * chunk)).cast("int")
    parts = kept(rows.groupBy("host").agg(size.alias("parts")).where("parts > 1"), "parts")

    def split(df: DataFrame) -> DataFrame:
        return df.join(parts, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))

    texts = rows.select("host", _parsed("html").alias("p")).select("host", "p.text", "p.closed", "p.content").where("text <> ''")
    texts = texts.mapInArrow(first_seen, texts.schema)
    kind = "host string, prefix long, n long, n_closed long"
    dealt = split(texts).withColumn("part", F.pmod("content", "parts").cast("int"))
    found = kept(dealt.groupBy("host", "part").applyInArrow(frequent(run, share, least), kind), "frequent")
    named = found.where("prefix is not null").select("host", "prefix").distinct()
    if named.isEmpty():
        return parsed.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))
    named = kept(named, "prefixes")
    wanted = split(named).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).groupBy("host", "part")
    searched = split(texts.join(kept(named.select("host").distinct(), "hosts"), "host", "left_semi")).withColumn("part", F.pmod("content", "parts").cast("int"))
    kind = "host string, content long, closed boolean, prefix long, starts array<int>"
    hits = kept(searched.groupBy("host", "part").cogroup(wanted).applyInArrow(places(run), kind), "places")
    one = hits.groupBy("host", "prefix", "content").agg(F.max(F.col("closed").cast("long")).alias("closed"))
    held = one.groupBy("host", "prefix").agg(F.count("*").alias("holding"), F.sum("closed").alias("holding_closed"))
    total = found.where("prefix is null").groupBy("host").agg(F.sum("n").alias("n"), F.sum("n_closed").alias("n_closed"))
    enough = [(F.col(f"holding{c}") >= least) & (F.col(f"holding{c}") >= F.col(f"n{c}") * share - 1e-9) for c in ("", "_closed")]
    cut_in = held.join(total, "host").select("host", "prefix", enough[0].alias("in_open"), enough[1].alias("in_closed")).where("in_open or in_closed")
    covered = hits.join(kept(cut_in, "cut"), ["host", "prefix"]).where("if(closed, in_closed, in_open)")
    covered = kept(covered.groupBy("host", "content", "closed").agg(F.flatten(F.collect_list("starts")).alias("starts")), "covered")

    @F.pandas_udf(T.StringType())
    def cut(text: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([t if a is None else unique_runs(t, list(a), run) for t, a in zip(text, at, strict=True)], dtype=object)

    out = parsed.join(covered, ["host", "content", "closed"], "left").select("page_id", "url", cut("text", "starts").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
