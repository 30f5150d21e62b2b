"""Main text of web pages by nearest-URL page differencing.

Pages of a host are sorted by URL path, and each is paired with the neighbour whose path
shares more leading parts. Pages with equal lines, or on one path, share a partner. The
text lines of the two are aligned by their longest common subsequence, and what they
share is deleted: it is the site's, not the page's.

A line is a block of the page with white space made single. Markup that names its purpose
corrects differencing both ways, as differencing alone gives few whole articles (README has
figures): a shared line inside an `article` or `main` element is put back, since articles
quote each other and repeat sentences, and a line that only this page has is deleted
nevertheless where markup names a menu, header, footer, sidebar, form, notice, advert or
comment, or where it lies outside the page's article. What markup says nothing about,
differencing decides. `decided` tells how many lines each of them decided.

An element is named by its tag, or by a whole part (`site-footer`: site, footer) of its
class, id or role, unless that begins with `has`, `no`, `with` or `without`. An article or main
element within a layout element that only a class names is the page's text again.

The order of pages comes from slim rows only (host, path, key), sorted by range, so a
host with a third of all pages is spread over many tasks; the lines' hashes go to the
partner, and the lines themselves are shuffled once.

Defined results: a null html or one without text gives an empty text and 0; a null url
is a host of its own; a host's only page has no partner and nothing to delete; rows that
repeat all of page_id, url and html get the same result each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.shared import checkpoint, join_small, release_memory
from eventloom.session import ship_package

#: Elements without content, elements that begin and end a line, elements that are never text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
NEVER = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video "
    "nav header footer aside form button select textarea menu dialog".split()
)
CONTENT = frozenset(("article", "main"))
#: Words in class, id or role that name layout, within which an article is text again, or what is never text.
LAYOUT = frozenset(
    "header footer masthead menu nav navbar navigation sidebar banner breadcrumb breadcrumbs search share sharing social toolbar widget "
    "contentinfo complementary pagination".split()
)
NOT_TEXT = frozenset(
    "ad ads advert adverts advertisement advertising comment comments consent cookie cookies disqus dialog modal newsletter notice notices "
    "popup promo promotion related reply replies sponsor sponsored subscribe".split()
)
NEGATIONS = frozenset("has no not with without".split())
#: Elements that the start of another one ends, up to the nearest of the elements that hold them.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot select optgroup".split())
HEAD_ONLY = frozenset("head title meta link style script base noscript template html".split())
COMMENT = regex.compile(r"(<(script|style)\b.*?</\2\s*>)|<!--(?:>|->|.*?--!?>)", regex.IGNORECASE | regex.DOTALL)
TOKEN = regex.compile(r"[\s]+")

CHROME, OTHER, MAIN = 0, 1, 2
#: Bits of an alignment that are kept at once.
BITS_KEPT = 1 << 22


def named_words(attrs: dict[str, str]) -> set[str]:
    """Parts of class, id and role of an element."""
    found: set[str] = set()
    for name in ("class", "id", "role"):
        for token in TOKEN.split(attrs.get(name, "").lower()):
            parts = token.replace("_", "-").split("-")
            if parts[0] not in NEGATIONS:
                found.update(parts)
    return found


class _Lines(HTMLParser):
    """Collects (region, text) of a page's lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Open elements: tag, region, and whether an article within is text although the region is not.
        self.open: list[tuple[str, int, bool]] = []
        self.lines: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.region = OTHER

    def _flush(self):
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append((self.region, text))
            self.parts = []

    def _close(self, at: int):
        before = self.open[at - 1][1] if at else OTHER
        if before != self.region:
            self._flush()
        del self.open[at:]
        self.region = before

    def _end_implied(self, tag: str):
        """Close what the start of `tag` ends."""
        if tag not in HEAD_ONLY:
            for at, (name, *_) in enumerate(self.open[:2]):
                if name == "head":
                    self._flush()
                    self._close(at)
                    break
        if ended := ENDED_BY.get(tag):
            for at in range(len(self.open) - 1, -1, -1):
                name = self.open[at][0]
                if name in ended:
                    if name in BLOCKS:
                        self._flush()
                    self._close(at)
                    break
                if name in HOLDERS and not (tag == "tr" and name == "tr"):
                    break
        if tag in BLOCKS:
            for at in range(len(self.open) - 1, -1, -1):  # a block ends an open paragraph
                name = self.open[at][0]
                if name == "p":
                    self._close(at)
                if name in BLOCKS:
                    break

    def _region(self, tag: str, attrs: dict[str, str]) -> tuple[int, bool]:
        """Region of an element, and whether an article within is text again."""
        inside = self.open[-1][2] if self.open else False
        if self.region == CHROME and not inside:
            return CHROME, False
        words = named_words(attrs) if tag not in ("html", "body") else set()
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true"
        if hidden or words & NOT_TEXT or (tag in NEVER and not (tag == "header" and self.region == MAIN)):
            return CHROME, False
        if tag in CONTENT or attrs.get("role") == "main":
            return MAIN, False
        if self.region == CHROME or words & LAYOUT and not (tag == "header" and self.region == MAIN):
            return CHROME, True
        return self.region, False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()
        self._end_implied(tag)
        if tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        region, inside = self._region(tag, {k: v or "" for k, v in attrs})
        if region != self.region:
            self._flush()
        self.open.append((tag, region, inside))
        self.region = region

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                break

    def handle_data(self, data):
        self.parts.append(data)


def page_lines(html: str) -> list[tuple[int, str]]:
    """(region, text) of each line of a page."""
    parser = _Lines()
    if "--!>" in html:  # ends a comment, which the parser doesn't know
        html = COMMENT.sub(lambda m: m[1] or "", html)
    parser.feed(html)
    parser.close()
    parser._flush()
    return parser.lines


def _walked(own: list[int], other: list[int]) -> list[int]:
    """Places in `own` of a longest common subsequence, with a bit vector kept for each line of `own`."""
    places: dict[int, int] = {}
    for j, h in enumerate(other):
        places[h] = places.get(h, 0) | 1 << j
    # One bit per line of the partner; a zero marks where the subsequence grows.
    full, state, states = (1 << len(other)) - 1, (1 << len(other)) - 1, []
    for h in own:
        hit = state & places.get(h, 0)
        state = ((state + hit) | (state - hit)) & full
        states.append(state)
    row, column, found = len(own), len(other), []
    while row and column:
        bit = 1 << (column - 1)
        if states[row - 1] & bit:
            column -= 1
            continue
        row -= 1
        if not row or states[row - 1] & bit:
            found.append(row)
            column -= 1
    return found[::-1]


def _prefix_lengths(own: list[int], other: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of `own` and the first 0, 1, 2 ... lines of `other`."""
    places: dict[int, int] = {}
    for j, h in enumerate(other):
        places[h] = places.get(h, 0) | 1 << j
    full = (1 << len(other)) - 1
    state = full
    for h in own:
        hit = state & places.get(h, 0)
        state = ((state + hit) | (state - hit)) & full
    bits = np.unpackbits(np.frombuffer((state ^ full).to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate(([0], np.cumsum(bits[: len(other)], dtype=np.int64)))


def _common(own: list[int], other: list[int]) -> list[int]:
    """Places in `own` of a longest common subsequence. Long inputs are halved, so memory stays linear."""
    if len(own) < 2 or len(own) * len(other) <= BITS_KEPT:
        return _walked(own, other) if own and other else []
    half = len(own) // 2
    split = int(np.argmax(_prefix_lengths(own[:half], other) + _prefix_lengths(own[half:][::-1], other[::-1])[::-1]))
    return _common(own[:half], other[:split]) + [half + at for at in _common(own[half:], other[split:])]


def shared_lines(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the page's line hashes are in the longest common subsequence with the partner's."""
    shared = np.zeros(len(own), bool)
    mine = np.flatnonzero(np.isin(own, other))
    shared[mine[_common(own[mine].tolist(), other[np.isin(other, own)].tolist())]] = True
    return shared


def kept_lines(regions: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, dict[str, int]]:
    """Which lines are the page's text, and how many lines were decided by what.

    Differencing deletes the shared lines. Of these markup puts back those of the article, and of
    the others it deletes those that it names, or that lie outside an article that the page has.
    """
    main = regions == MAIN
    beside = (regions == CHROME) | (~main & main.any())
    return (~shared & ~beside) | main, {"shared": int(shared.sum()), "put_back": int((shared & main).sum()), "named": int((~shared & beside).sum())}


def _parsed(with_text: bool):
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor().compress
        for batch in batches:
            pages = [page_lines(html or "") for html in batch]
            hashes = [[xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for _, t in p] for p in pages]
            if not with_text:
                yield pd.Series(hashes)
            else:
                # Lines that are never text travel as their hashes only, the others compressed.
                yield pd.DataFrame(
                    {
                        "lines": [pack("\n".join(t if r != CHROME else "" for r, t in p).encode("utf-8", "surrogatepass")) for p in pages],
                        "regions": [[r for r, _ in p] for p in pages],
                        "hashes": hashes,
                    }
                )
        release_memory()

    kind = "lines binary, regions array<int>, hashes array<bigint>" if with_text else "array<bigint>"
    return F.pandas_udf(parse, kind)


def _texts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for lines, regions, hashes, others in batches:
        rows = []
        for t, r, h, o in zip(lines, regions, hashes, others):
            keep, decided = kept_lines(np.asarray(r, int), shared_lines(np.asarray(h, np.int64), np.asarray([] if o is None else o, np.int64)))
            own = zstandard.decompress(t).decode("utf-8", "surrogatepass").split("\n")
            rows.append({"text": "\n\n".join(line for line, kept in zip(own, keep) if kept), "decided": decided})
        yield pd.DataFrame(rows, columns=["text", "decided"])
    release_memory()


def nearest_pages(places: DataFrame) -> DataFrame:
    """(key, partner) of distinct rows (host, path, key)."""
    at = F.struct("host", "path", "key").alias("at")
    ranged = checkpoint(
        places.repartitionByRange("host", "path", "key").select(at, F.spark_partition_id().alias("part"))
    )
    # One row per partition: its neighbours are the ends of the partitions beside it.
    order = Window.orderBy("part")
    ends = checkpoint(
        ranged.groupBy("part").agg(F.min("at").alias("low"), F.max("at").alias("high"))
        .select("part", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    )
    within = Window.partitionBy("part").orderBy("at")
    rows = join_small(ranged, ends, "part").select(
        "at",
        F.coalesce(F.lag("at").over(within), "before").alias("before"),
        F.coalesce(F.lead("at").over(within), "after").alias("after"),
    )

    def common(other: str) -> Column:
        a, b = F.split("at.path", "/"), F.split(F.col(other)["path"], "/")
        same = F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i))
        return F.when(F.col(other)["host"] == F.col("at.host"), F.size(same)).otherwise(-1)

    scored = rows.select("at", "before", "after", F.coalesce(common("before"), F.lit(-1)).alias("b"), F.coalesce(common("after"), F.lit(-1)).alias("a"))
    nearer = F.when(F.col("a") > F.col("b"), F.col("after.key")).when(F.col("b") >= 0, F.col("before.key"))
    return scored.select(F.col("at.key").alias("key"), nearer.alias("partner")).where("partner IS NOT NULL")


def partners_of_other_content(places: DataFrame) -> DataFrame:
    """(key, partner) of rows (host, path, key, content).

    Of a host's pages with equal lines the first in order stands for all, and of those that
    stand on one path again the first, so that no copy and no other crawl is a page's partner.
    """
    places = checkpoint(places)
    stands = places.groupBy("host", "content").agg(F.min(F.struct("path", "key")).alias("at")).select("host", "content", F.col("at.path").alias("stand"))
    firsts = places.join(stands, ["host", "content"]).where(F.col("path") == F.col("stand"))
    firsts = checkpoint(firsts.groupBy("host", "path").agg(F.min("key").alias("key")))
    named = nearest_pages(firsts).join(firsts, "key").select("host", F.col("path").alias("stand"), "partner")
    return places.join(stands, ["host", "content"]).join(named, ["host", "stand"]).select("key", "partner")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars, and `decided`: how many lines were shared, put back, and deleted by name."""
    ship_package(pages.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keyed = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"),
        F.md5(F.concat_ws("\n", text(id_col), text(url_col), text(html_col))).alias("key"),
    )
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    slim = checkpoint(
        keyed.select(
            F.lower(F.regexp_extract(url, parts, 1)).alias("host"), F.regexp_extract(url, parts, 2).alias("path"), "key",
            _parsed(False)("html").alias("others"),
        )
    )
    places = slim.select("host", "path", "key", F.xxhash64("others").alias("content")).distinct()
    hashes = slim.select(F.col("key").alias("partner"), "others").dropDuplicates(["partner"])
    partners = partners_of_other_content(places).join(hashes, "partner").select("key", "others")
    lines = keyed.select("page_id", "url", "key", _parsed(True)("html").alias("parsed")).select("page_id", "url", "key", "parsed.*")
    whole = lines.join(partners, "key", "left")
    found = F.pandas_udf(_texts, "text string, decided struct<shared: int, put_back: int, named: int>")("lines", "regions", "hashes", "others")
    return whole.select("page_id", "url", found.alias("found")).select(
        "page_id", "url", "found.text", F.length("found.text").cast("long").alias("n_chars"), "found.decided"
    )
