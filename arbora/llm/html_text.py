"""Main text of web pages, with a suffix array over the pages of each host.

A tolerant one-pass reader gives the blocks of a page in order and a zone for each: inside
the article; marked (menus, headers, footers, sidebars, notices, adverts, forms, comments,
by element, role, class or id); or open, where the markup says nothing. The text of a page
is its articles. For pages without one it is what is left of the open blocks after
boilerplate is removed: the token streams of a host's pages (all blocks outside articles)
are concatenated, a suffix array with longest common prefixes finds the stretches of at
least RUN tokens that occur on distinct pages, and open blocks of which they cover half or
more are removed; unique runs stay.

A host's pages are taken in slices of about SLICE characters of html, each with its own array
in a task of its own. For hosts of more slices the RUN-token windows of all slices are counted
together, so that a stretch that repeats only across slices is found all the same: coverage
is exact for any host. Equal pages share a slice, and one page is never split.

Defined results: null html gives the empty text; a null url belongs to the empty host;
an article without text gives the empty text; articles side by side are all returned;
repeated rows are extracted one by one; very long pages are read whole, in time in proportion
to them; pages of equal text count as one page of the host,
whatever their page_id, and do not make each other's text boilerplate; extra columns are
ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, settle
from .url_filter import host_of

RUN, SLICE, COVER = 8, 2 << 20, 0.5
MAIN = 1 << 30

_OPEN = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_ROLE_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
_PART = re.compile(r"[^a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title".split())
_CLOSE = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in _RAW}
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split())
#: Elements, roles and names that mark what is not the article's own text.
_DROP = frozenset("nav header footer aside form menu dialog button select input label fieldset search head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status note".split())
_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside widget widgets notice notices cookie cookies consent gdpr banner alert popup modal overlay "
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promoted promotion related recommended recommendations share sharing social newsletter subscribe subscription signup login search "
    "comment comments reply replies respond discussion disqus toolbar pagination pager paywall disclaimer".split()
)
_OWN = frozenset("post article entry content story".split())


def _marked(tag: str, attrs: str) -> bool:
    if tag in _DROP:
        return True
    if not attrs or attrs.isspace():
        return False
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        if name == "hidden":
            return True
        if name == "role" and value.strip("\"'").lower() in _ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            for word in value.strip("\"'").lower().split():
                parts = set(_PART.split(word))
                if parts & _NAMES and not (parts & _OWN and parts & _NAMES <= {"header"}):
                    return True
    return False


def _comment(attrs: str) -> bool:
    return any(n.lower() in ("class", "id") and set(_PART.split(v.lower())) & {"comment", "comments", "reply", "replies"} for n, v in _ATTR.findall(attrs))


class _Tags:
    """The comments, declarations and tags of a page in order, in time in proportion to it."""

    def __init__(self, page: str):
        self.page, self.ends, self.none = page, {}, {}

    def find(self, what: str, at: int) -> int:
        """str.find that looks only once for what is not there any more."""
        if at >= self.none.get(what, len(self.page) + 1):
            return -1
        out = self.page.find(what, at)
        if out < 0:
            self.none[what] = at
        return out

    def end(self, at: int) -> int:
        """The place of the next `>` outside quotes, or -1. Whatever tag a walk over quotes
        begins in, it goes on from a quote in one way: its outcome is kept for each."""
        passed, out = [], -1
        stop = getattr(self, "stop", -1)
        if stop < at or at < self.stop_from:
            m = _STOP.search(self.page, at)
            self.stop_from, self.stop = at, m.start() if m else len(self.page)
            stop = self.stop
        while stop < len(self.page):
            if self.page[stop] == ">":
                out = stop
                break
            if stop in self.ends:
                out = self.ends[stop]
                break
            passed.append(stop)
            close = self.find(self.page[stop], stop + 1)
            if close < 0:
                break
            m = _STOP.search(self.page, close + 1)
            stop = m.start() if m else len(self.page)
        self.ends.update(dict.fromkeys(passed, out))
        return out

    def __iter__(self):
        """(start, end, closing, tag, attributes); tag is empty for what is no tag."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
                yield at, end, "", "", ""
            elif page[at + 1 : at + 2] in ("!", "?"):
                end = self.find(">", at + 2) + 1
                if end:
                    yield at, end, "", "", ""
            else:
                m = _OPEN.match(page, at + 1)
                end = self.end(m.end()) + 1 if m else 0
                if end:
                    yield at, end, m.group(1), m.group(2).lower(), page[m.end() : end - 1]
            at = end or at + 1


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text): zone k > 0 inside the k-th article, MAIN in a main element outside of
    articles, 0 open, -1 marked."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, marks, is an article, is the main part
    inside: Counter = Counter()  # open elements by tag
    marks = articles = mains = seen = 0
    at = 0

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((-1 if marks else seen if articles else MAIN if mains else 0, text))

    def pop() -> None:
        nonlocal marks, articles, mains
        tag, m, a, p = stack.pop()
        inside[tag] -= 1
        marks -= m
        articles -= a
        mains -= p

    for start, stop, closing, tag, attrs in _Tags(page):
        if start < at:
            continue
        if start > at:
            held.append(_html.unescape(page[at:start]))
        at = stop
        if not tag:
            continue
        if closing:
            if inside[tag] and (tag in _BLOCK or any(x[0] == tag for x in stack[-8:])):
                flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _RAW:
            end = _CLOSE[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br" or tag in ("td", "th"):
            held.append(" ")
            continue
        if tag in _VOID and tag != "hr":
            continue
        mark = _marked(tag, attrs)
        is_article = tag == "article"
        if is_article and articles:
            mark = mark or _comment(attrs)
        if tag in _BLOCK or mark:
            flush()
            if tag in ("hr", "input"):
                continue
            if tag == "p" and stack and stack[-1][0] == "p":
                pop()
            if is_article and not articles and not marks:
                seen += 1
            is_main = tag == "main" or "main" in attrs and bool(_ROLE_MAIN.search(attrs))
            stack.append((tag, mark, is_article, is_main))
            inside[tag] += 1
            marks += mark
            articles += is_article
            mains += is_main
    if at < len(page):
        held.append(_html.unescape(page[at:]))
    flush()
    return out


def article(parts: list[tuple[int, str]]) -> list[str] | None:
    """The blocks of all articles in order, or of the main element; None without either."""
    for fits in (lambda z: 0 < z < MAIN, lambda z: z == MAIN):
        if own := [text for zone, text in parts if fits(zone)]:
            return own
    return None


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of an integer sequence in order, by prefix doubling."""
    n, k = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[: n - k] = rank[k:]
        order = np.lexsort((nxt, rank))
        a, b = rank[order], nxt[order]
        fresh = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or k > n:
            return order
        k *= 2


def common_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For neighbours in the suffix array, the length of the common prefix up to `most`."""
    n = len(s)
    out = np.zeros(max(0, n - 1), np.int64)
    live = np.arange(n - 1)
    for d in range(most):
        i, j = order[live] + d, order[live + 1] + d
        ok = (i < n) & (j < n)
        live, i, j = live[ok], i[ok], j[ok]
        live = live[s[i] == s[j]]
        out[live] += 1
    return out


def repeated(streams: list[list[str]], owner: list) -> list[np.ndarray]:
    """For each stream the starts of its RUN-token windows that occur on another page."""
    ids: dict[str, int] = {}
    flat: list[int] = []
    of: list[int] = []
    for k, tokens in enumerate(streams):
        flat += [ids.setdefault(t, len(ids)) for t in tokens]
        flat.append(-1 - k)  # a mark of its own ends each stream
        of += [k] * (len(tokens) + 1)
    if not flat:
        return [np.empty(0, np.int64) for _ in streams]
    s, of_ = np.array(flat, np.int64), np.array(of)
    order = suffix_array(s)
    lcp = common_prefixes(s, order, RUN)
    group = np.concatenate(([0], np.cumsum(lcp < RUN)))  # suffixes that share RUN tokens
    page = np.unique(np.array(owner, object).astype(str), return_inverse=True)[1][of_[order]]
    low = np.full(group[-1] + 1, 2**62)
    high = np.full(group[-1] + 1, -1)
    np.minimum.at(low, group, page)
    np.maximum.at(high, group, page)
    hit = order[(low < high)[group]]
    start = np.cumsum([0] + [len(t) + 1 for t in streams])
    hit.sort()
    cut = np.searchsorted(hit, start)
    return [hit[cut[k] : cut[k + 1]] - start[k] for k in range(len(streams))]


def _cover(n: int, starts: np.ndarray) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    if len(starts):
        np.add.at(mark, starts, 1)
        np.add.at(mark, np.minimum(starts + RUN, n), -1)
    return np.cumsum(mark)[:n] > 0


def _read(batches):
    """Per page: the text of its article (null: none), and its open blocks."""
    for b in batches:
        text, open_ = [], []
        for v in b.column(3):
            parts = blocks(v.as_py() or "")
            own = article(parts)
            text.append(None if own is None else "\n\n".join(own))
            open_.append([t for z, t in parts if z == 0] if own is None else [])
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(text, pa.string()), pa.array(open_, pa.list_(pa.string()))], ["key", "page_id", "url", "text", "open"])


def _stream(batches):
    """Per page: tokens outside articles, the lengths of its open blocks (-n: marked), and a
    hash of all of its text, which equal pages share."""
    for b in batches:
        tokens, sizes, page = [], [], []
        for v in b.column(1):
            parts = blocks(v.as_py() or "")
            none = article(parts) is None
            page.append(xxhash.xxh3_128_hexdigest("\x1f".join(t for _, t in parts)))
            outside = [(z == 0 and none, t.split(" ")) for z, t in parts if z <= 0]
            tokens.append([w for _, t in outside for w in t])
            sizes.append([len(t) if o else -len(t) for o, t in outside])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.list_(pa.string())), pa.array(sizes, pa.list_(pa.int32())), pa.array(page, pa.string()), *b.columns[2:]], ["key", "tokens", "sizes", "page", *b.schema.names[2:]])


def _slices(table: pa.Table) -> pa.Table:
    """One slice of a host: starts of repeated windows; of hosts with more slices also a
    hash of each distinct window, with the page and start of those not repeated here."""
    tokens = table["tokens"].to_pylist()
    starts = repeated(tokens, table["page"].to_pylist())
    windows = []
    many = table.num_rows > 0 and table["slices"][0].as_py() > 1
    done: set[int] = set()
    for t, hit in zip(tokens, starts):
        w, inside = [], set(hit.tolist())
        for i in range(len(t) - RUN + 1) if many else ():
            h = xxhash.xxh3_64_intdigest("\x1f".join(t[i : i + RUN])) - 2**63
            if i not in inside or h not in done:
                w.append({"h": h, "at": i})
                done.add(h)
        windows.append(w)
    kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))
    return pa.table({"key": table["key"], "host": table["host"], "page": table["page"], "sizes": table["sizes"], "starts": pa.array([x.tolist() for x in starts], pa.list_(pa.int32())), "windows": pa.array(windows, kind)})


def _judge(batches):
    """From starts to: is each open block kept, and tokens outside the article covered."""
    for b in batches:
        keep, covered = [], []
        for sizes, own, more in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            starts = np.unique(np.array((own or []) + (more or []), np.int64))
            mask = _cover(sum(map(abs, sizes)), starts)
            at, k = 0, []
            for n in sizes:
                if n > 0:
                    k.append(bool(mask[at : at + n].mean() < COVER))
                at += abs(n)
            keep.append(k)
            covered.append(int(mask.sum()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keep, pa.list_(pa.bool_())), pa.array(covered, pa.int64())], ["key", "keep", "n_repeated"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated (tokens outside the article that other pages
    of the host repeat) of every row of pages."""
    keyed = pages.select("page_id", "url", "html", F.struct(F.col("page_id").alias("p"), F.xxhash64("url", "html").alias("h")).alias("k"))
    key = F.xxhash64("k")
    host = F.coalesce(host_of(F.col("url")), F.lit(""))
    base = keyed.select(key.alias("key"), "html", host.alias("host"))
    per_host = base.groupBy("host").agg(F.sum(F.coalesce(F.length("html"), F.lit(0)) + 1).alias("n")).select("host", F.greatest(F.lit(1), F.ceil(F.col("n") / SLICE)).cast("int").alias("slices"))
    streams = base.mapInArrow(lean(_stream), "key long, tokens array<string>, sizes array<int>, page string, host string")
    # the slice's own key: what is dealt by host is not dealt by slice yet
    streams = streams.join(per_host, "host").withColumn("slice", F.xxhash64("host", F.pmod(F.xxhash64("page"), F.col("slices"))))
    kind = "key long, host string, page string, sizes array<int>, starts array<int>, windows array<struct<h:long,at:int>>"
    found = settle(streams.groupBy("slice").applyInArrow(_slices, kind))
    across = found.where(F.size("windows") > 0).select("key", "host", "page", F.explode("windows").alias("w")).select("key", "host", "page", "w.h", "w.at")
    twice = across.groupBy("host", "h").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).where("lo <> hi").select("host", "h")
    more = across.join(twice, ["host", "h"]).groupBy("key").agg(F.collect_set("at").alias("more"))
    judged = found.select("key", "sizes", "starts").join(more, "key", "left").mapInArrow(lean(_judge), "key long, keep array<boolean>, n_repeated long")
    judged = judged.groupBy("key").agg(F.first("keep").alias("keep"), F.max("n_repeated").alias("n_repeated"))
    id_type = pages.schema["page_id"].dataType.simpleString()
    read = keyed.select(key.alias("key"), "page_id", "url", "html").mapInArrow(lean(_read), f"key long, page_id {id_type}, url string, text string, open array<string>")
    kept = F.transform(F.filter(F.arrays_zip("open", "keep"), lambda x: x["keep"]), lambda x: x["open"])
    out = read.join(judged, "key").select("page_id", "url", F.coalesce("text", F.array_join(kept, "\n\n")).alias("text"), "n_repeated")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
