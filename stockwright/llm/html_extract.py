"""Main text of web pages by consensus host paths.

Pages of one host share a template. A page is read into blocks of text, each in
a container; a container is named by its generalised path of tags and classes
(digits and ids left out). Each page scores its containers' paths: characters of
text and of links, and a digest of what stands there. Scores are summed per
(host, path) in Spark with a map-side combine, so a host with a third of all
pages is no hot group, and each host's sums decide three things:

* the winning path: an article or main element that holds most of the host's
  text, else the deepest path that holds nearly all of it, so that an article in
  several sibling containers keeps all of them;
* paths that are left out: those with the same text on every page that has
  them, and those that are mostly links, outside articles;
* marked paths that are kept after all. Class words only mark a container as a
  likely menu, advert or notice. One that holds most of the text in article and
  main elements, or, where there are none, half of all text and three times what
  is unmarked, is no such thing, whatever its class says.

Every page is then extracted again with its host's decisions: the text of the
containers on the winning path, and a title before it. A page that does not have
that path, or little of its text there, and pages without a host decide for
themselves by the same rules.

Left out wherever they stand: script, style, markup and comments in it, menus,
footers, sidebars, forms' fields, hidden elements, reader comments, and headers
but for the headings of an article's own. Character references are decoded,
white space inside a block becomes one space, blocks are joined in page order by
one newline, nothing else is dropped or capped. Broken markup is read as
browsers do: open paragraphs end at the next block, unknown end tags are
skipped, unfinished pages end where they end. Reading is linear in the page's
length, however deep its elements are nested.

Defined results: null html is an empty page (text "", 0 characters); ties
between paths go to the lesser digest of the path; repeated rows give repeated
rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Elements whose text is never main text (fixed list).
SKIPPED = frozenset("nav footer aside script style noscript template iframe svg canvas button select option textarea input label head title menu dialog object embed audio video".split())
#: Elements that a parser reads as raw text up to their end tag (fixed list).
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
#: Elements that have no end tag (fixed list).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements inside a line of text (fixed list); all others bound a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may be a container of main text (fixed list).
CONTAINERS = frozenset("article main section div body td form".split())
#: Start tags that end an open paragraph (fixed list).
ENDS_P = frozenset("p header footer nav aside figure ul ol dl table blockquote pre".split()) | HEADINGS | CONTAINERS
#: Class, id and role words of reader comments (fixed lists).
COMMENT = frozenset("comment comments commentlist disqus respond replies discussion".split())
COMMENT_WITH = frozenset("list lists section area wrapper wrap box thread body item items form user users reader readers block container content feed count".split())
#: Words that mark a container wherever they stand in a class name (fixed list).
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc masthead topbar footer contentinfo sidebar rail complementary "
    "widget widgets share sharing social related recommended recommendations cookie cookies consent gdpr newsletter subscribe subscription".split()
)
#: Words that mark a container as a whole class name (fixed list).
WEAK = frozenset("header head foot bottom side top search login signup form legal notice notices alert alerts disclaimer copyright popular trending reply".split())
#: Elements that no class marks.
NEVER_MARKED = frozenset("html body article main".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SHOWN_NOT = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Shares of a host's text: of an article or main element that wins, of another
#: path that wins, of a marked path that is kept, of a page on its host's path.
ARTICLE, NEARLY_ALL, RESCUED, PRESENT = 0.5, 0.9, 0.5, 0.2
#: How often a marked path that is kept holds the unmarked text.
OUTWEIGHS = 3
#: Share of links from which a path is left out, and pages that must agree on it.
LINKED, PAGES, OF_PAGES = 0.6, 3, 0.01
PLAIN, MAIN, OWN = 0, 1, 2


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without a leading www. or port; null if none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1))
    return F.nullif(host, F.lit(""))


@lru_cache(maxsize=4096)
def _word(token: str) -> tuple[bool, bool]:
    """(names reader comments, marks its element) of one class, id or role."""
    parts = [p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if p]
    if not parts:
        return False, False
    others = [p for p in parts if p not in COMMENT]
    comments = len(others) < len(parts) and all(p in COMMENT_WITH for p in others)
    return comments, any(p in STRONG for p in parts) or len(parts) == 1 and parts[0] in WEAK


@lru_cache(maxsize=4096)
def _attributes(raw: str) -> tuple[str, bool, bool]:
    """(generalised class, skipped for sure, marked) of a start tag."""
    names, skipped, marked = "", False, False
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "style":
            skipped = skipped or bool(SHOWN_NOT.search(value))
        elif name == "hidden" or name == "aria-hidden":
            skipped = skipped or name == "hidden" or value.lower() == "true"
        else:
            for word in value.split():
                comments, mark = _word(word)
                skipped, marked = skipped or comments, marked or mark
            if name == "class":
                names = ".".join(sorted({re.sub(r"\d+", "#", w) for w in value.lower().split()}))
    return names, skipped, marked


class _Page:
    """Blocks of a page in order, and the tree of its containers' paths."""

    def __init__(self, source: str):
        #: (text, characters in links, path, heading level or 0)
        self.blocks: list[tuple[str, int, int, int]] = []
        # paths: parent, digest, marked, kind (the last two of the path's end)
        self.parent, self.digest, self.marked, self.kind = [-1], [0], [False], [PLAIN]
        self.below: dict[tuple[int, str], int] = {}
        self.open: list[tuple[str, int, bool, int]] = []  # tag, path before, skipped, heading level before
        self.places: dict[str, list[int]] = defaultdict(list)  # of open tags, by tag
        self.path = self.heading = self.linked = self.in_link = self.skipping = 0
        self.text: list[str] = []
        self._read(source)

    # -------------------------------------------------------------- reading

    def _flush(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            if text:
                self.blocks.append((text, self.linked, self.path, self.heading))
            self.text = []
        self.linked = 0

    def _push(self, tag: str, skipped: bool) -> None:
        self.places[tag].append(len(self.open))
        self.open.append((tag, self.path, skipped, self.heading))
        self.skipping += skipped

    def _end(self, at: int) -> None:
        """Close the open elements from a place on."""
        self._flush()
        while len(self.open) > at:
            tag, self.path, skipped, self.heading = self.open.pop()
            self.places[tag].pop()
            self.skipping -= skipped
        self.in_link = 0

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, tag: str, until: frozenset[str]) -> None:
        """Close the last open element of this tag, if none of ``until`` is nearer."""
        places = self.places.get(tag)
        if places and places[-1] > self._last(until):
            self._end(places[-1])

    def _said(self, text: str) -> None:
        if text and not self.skipping:
            self.text.append(text)
            if self.in_link:
                self.linked += len(text)

    def _read(self, source: str) -> None:
        at, n = 0, source.rfind(">") + 1
        while at < n:
            m = TOKEN.search(source, at, n)
            if not m:
                break
            self._said(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end_tag(tag)
                continue
            self._start_tag(tag, m[3])
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._close(tag, frozenset())
        # a tag that the page's end cuts is no text
        cut = re.search(r"<[/!?a-zA-Z]", source[at:]) if at < len(source) else None
        self._said(source[at:][: cut.start()] if cut else source[at:])
        self._end(0)

    def _start_tag(self, tag: str, raw: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self._said(" ")
            elif tag == "a":
                self.in_link += 1
            elif tag not in VOID and raw.strip():
                _, skipped, marked = _attributes(raw)
                if skipped or marked:
                    self._push(tag, True)
            return
        self._flush()
        if tag in VOID:
            return
        if tag in ENDS_P:
            self._close("p", frozenset(("td", "li", "div", "article", "section", "blockquote")))
        if tag == "li":
            self._close("li", frozenset(("ul", "ol")))
        elif tag in ("dt", "dd"):
            self._close("dt", frozenset(("dl",)))
            self._close("dd", frozenset(("dl",)))
        elif tag in ("td", "th"):
            self._close("td", frozenset(("table", "tr")))
            self._close("th", frozenset(("table", "tr")))
        elif tag == "tr":
            self._close("tr", frozenset(("table",)))
        elif tag in HEADINGS:
            for h in HEADINGS:
                self._close(h, CONTAINERS)
        names, skipped, marked = _attributes(raw) if raw.strip() else ("", False, False)
        skipped = skipped or tag in SKIPPED
        if tag == "header":  # of an article: its headings are the article's
            skipped = skipped or self._last(("article", "main")) < 0
        elif not skipped and self.places.get("header") and self.places["header"][-1] > self._last(("article", "main")) >= 0:
            skipped = tag not in HEADINGS and tag not in CONTAINERS and tag != "hgroup"
        self._push(tag, skipped)
        if tag in CONTAINERS or marked or tag == "body":
            self.path = self._step(f"{tag}.{names}" if names else tag, (marked or tag == "form") and tag not in NEVER_MARKED, OWN if tag == "article" else MAIN if tag == "main" else PLAIN)
        if tag in HEADINGS:
            self.heading = int(tag[1])

    def _step(self, name: str, marked: bool, kind: int) -> int:
        """The path one container deeper."""
        import xxhash

        at = self.below.get((self.path, name))
        if at is None:
            at = self.below[self.path, name] = len(self.parent)
            self.parent.append(self.path)
            # signed, and never the root's
            digest = xxhash.xxh64_intdigest(name, self.digest[self.path] & (1 << 64) - 1) - (1 << 63)
            self.digest.append(digest or 1)
            self.marked.append(marked)
            self.kind.append(kind)
        return at

    def _end_tag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        elif tag in INLINE:
            if self.open and self.open[-1][0] == tag:
                self.skipping -= self.open.pop()[2]
                self.places[tag].pop()
        elif tag not in ("html", "body"):
            self._flush()
            self._close(tag, CONTAINERS - {tag} if tag not in CONTAINERS else frozenset())

    # --------------------------------------------------------------- scores

    def sums(self, own: list[int], blocked: list[bool] | None = None) -> list[int]:
        """Sums of own over each path and all below it; blocked paths give
        nothing to those above them."""
        out = list(own)
        for i in range(len(out) - 1, 0, -1):
            if not (blocked and blocked[i]):
                out[self.parent[i]] += out[i]
        return out

    def scores(self) -> list[tuple]:
        """(path, depth, marked, kind, characters below, of them unmarked, of
        them in article and main elements, own characters, own linked characters,
        digest of the own text)."""
        import xxhash

        n = len(self.parent)
        own, linked, texts = [0] * n, [0] * n, [[] for _ in range(n)]
        for text, link, path, _ in self.blocks:
            own[path] += len(text)
            linked[path] += min(link, len(text))
            texts[path].append(text)
        depth, within = [0] * n, [False] * n
        for i in range(1, n):
            depth[i] = depth[self.parent[i]] + 1
            within[i] = within[self.parent[i]] or self.kind[i] > 0
        whole, good, element = self.sums(own), self.sums(own, self.marked), self.sums([x * w for x, w in zip(own, within, strict=True)])
        said = [xxhash.xxh64_intdigest("\n".join(t)) - (1 << 63) for t in texts]
        return [(self.digest[i], depth[i], self.marked[i], self.kind[i], whole[i], good[i], element[i], own[i], linked[i], said[i]) for i in range(n) if whole[i]]

    # -------------------------------------------------------------- extract

    def take(self, decided: Decision | None) -> str:
        """The page's text under a host's decisions, or under its own."""
        found = self._on(decided) if decided else None
        if found is not None and len(found) >= PRESENT * sum(len(text) for text, *_ in self.blocks):
            return found
        own = self._on(decide(self.scores())) or ""
        return found if found is not None and len(found) >= PRESENT * len(own) else own

    def _on(self, d: Decision) -> str | None:
        """Text on a winning path; None if the page does not have it."""
        n = len(self.parent)
        inside, gone = [False] * n, [False] * n
        for i in range(n):
            up = self.parent[i]
            inside[i] = self.digest[i] == d.path or up >= 0 and inside[up]
            gone[i] = up >= 0 and gone[up] or self.digest[i] in d.left_out or self.marked[i] and self.digest[i] not in d.kept
        if not any(inside):
            return None
        out, titles, begun = [], [], False
        for text, _, path, heading in self.blocks:
            if gone[path]:
                continue
            if inside[path]:
                out.append(text)
                begun = True
            elif heading == 1 and not begun:
                titles.append(text)
        return "\n".join(titles + out) if out else None


class Decision:
    """What a host, or a page alone, decided."""

    def __init__(self, path: int, left_out: Iterable[int] = (), kept: Iterable[int] = ()):
        self.path, self.left_out, self.kept = path, frozenset(left_out), frozenset(kept)


def decide(rows: list[tuple]) -> Decision:
    """The decision of one page's scores, by the rules of ``host_paths``."""
    votes = [dict(zip(FIELDS, r, strict=True)) for r in rows]
    root = next((v for v in votes if v["path"] == 0), None)
    if root is None:
        return Decision(0)

    def rescued(v: dict) -> bool:
        if root["element"]:
            return v["marked"] and v["element"] >= RESCUED * root["element"]
        return v["marked"] and v["whole"] >= RESCUED * root["whole"] and v["whole"] >= OUTWEIGHS * root["good"]

    kept = [v["path"] for v in votes if rescued(v)]
    score = "whole" if kept else "good"
    best = min(((-_rank(v["kind"], v["depth"], v[score], root[score]), v["path"]) for v in votes if not v["marked"] or v["path"] in kept), default=(0, 0))
    left = [v["path"] for v in votes if not v["kind"] and v["own"] and v["linked"] >= LINKED * v["own"] and v["whole"] < RESCUED * root["whole"]]
    return Decision(best[1] if best[0] < 0 else 0, left, kept)


def _rank(kind: int, depth: int, score: int, most: int) -> int:
    """How good a path is: an article, then a main element, that holds enough,
    the shallowest; else the deepest path with nearly all text."""
    if kind and score >= ARTICLE * most and score:
        return kind * (1 << 40) - depth
    return depth + 1 if score >= NEARLY_ALL * most else 0


def votes_of(source: str) -> list[tuple]:
    """A page's scores."""
    return _Page(source).scores()


def extract(source: str, decided: Decision | None = None) -> str:
    return _Page(source).take(decided)


# -------------------------------------------------------------------- operator

FIELDS = ["path", "depth", "marked", "kind", "whole", "good", "element", "own", "linked", "said"]
VOTE = T.StructType([T.StructField(n, T.BooleanType() if n == "marked" else T.LongType()) for n in FIELDS])

#: Pages whose results are Python objects at a time.
SOME = 256


def _in_parts(n: int, make: Callable[[int, int], list], kind: pa.DataType) -> pa.Array:
    """An Arrow array of n results, made some rows at a time."""
    parts = [pa.array(make(at, min(n, at + SOME)), kind) for at in range(0, n, SOME)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def votes_column(source: Column) -> Column:
    @F.arrow_udf(T.ArrayType(VOTE))
    def vote(pages: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(n, pa.bool_() if n == "marked" else pa.int64()) for n in FIELDS]))
        return _in_parts(len(pages), lambda a, b: [[dict(zip(FIELDS, v, strict=True)) for v in votes_of(pages[i].as_py())] for i in range(a, b)], kind)

    return vote(F.coalesce(source, F.lit("")))


def extract_column(source: Column, path: Column, left_out: Column, kept: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def texts(pages: pa.Array, paths: pa.Array, left: pa.Array, keep: pa.Array) -> pa.Array:
        def one(i: int) -> str:
            p = paths[i].as_py()
            return extract(pages[i].as_py(), None if p is None else Decision(p, left[i].as_py() or (), keep[i].as_py() or ()))

        return _in_parts(len(pages), lambda a, b: [one(i) for i in range(a, b)], pa.string())

    return texts(F.coalesce(source, F.lit("")), path, left_out, kept)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, left_out, kept): each host's decisions. A path counts as left
    out if at least ``PAGES`` pages and one in a hundred of the host's have it, so
    the list is at most a hundred times as long as a page has paths."""
    scratch = Scratch(pages.sparkSession, "html")
    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.explode(votes_column(F.col(html_col))).alias("v")).where("host IS NOT NULL").select("host", "v.*")
    total = [F.sum(c).alias(c) for c in ("whole", "good", "element", "own", "linked")]
    sums = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.max("depth").alias("depth"), F.max("marked").alias("marked"), F.max("kind").alias("kind"), *total, F.min("said").alias("low"), F.max("said").alias("high"))
    sums = scratch.keep(sums, "sums")
    # the root's path is 0 and holds everything
    hosts = sums.where("path = 0").select("host", F.col("whole").alias("host_whole"), F.col("good").alias("host_good"), F.col("element").alias("host_element"), F.col("pages").alias("host_pages"))
    s = sums.join(hosts, "host")
    in_elements = F.col("element") >= RESCUED * F.col("host_element")
    outweighs = (F.col("whole") >= RESCUED * F.col("host_whole")) & (F.col("whole") >= OUTWEIGHS * F.col("host_good"))
    rescued = F.col("marked") & F.when(F.col("host_element") > 0, in_elements).otherwise(outweighs)
    any_kept = s.groupBy("host").agg(F.max(rescued).alias("any_kept"))
    s = s.join(any_kept, "host")
    score, most = F.when(F.col("any_kept"), F.col("whole")).otherwise(F.col("good")), F.when(F.col("any_kept"), F.col("host_whole")).otherwise(F.col("host_good"))
    element = (F.col("kind") > 0) & (score >= ARTICLE * most) & (score > 0)
    rank = F.when(element, F.col("kind") * (1 << 40) - F.col("depth")).when(score >= NEARLY_ALL * most, F.col("depth") + 1).otherwise(0)
    best = F.min(F.when(~F.col("marked") | rescued, F.struct((-rank).alias("order"), "path"))).alias("best")
    agreed = (F.col("pages") >= PAGES) & (F.col("pages") >= OF_PAGES * F.col("host_pages"))
    same = agreed & (F.col("low") == F.col("high"))
    left = (F.col("kind") == 0) & (F.col("own") > 0) & (F.col("whole") < RESCUED * F.col("host_whole")) & (same | agreed & (F.col("linked") >= LINKED * F.col("own")))
    out = s.groupBy("host").agg(best, F.collect_set(F.when(left, F.col("path"))).alias("left_out"), F.collect_set(F.when(rescued, F.col("path"))).alias("kept"))
    return out.select("host", F.when(F.col("best.order") < 0, F.col("best.path")).otherwise(F.lit(0)).alias("path"), "left_out", "kept")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    scratch = Scratch(pages.sparkSession, "html")
    # a table of its own: Spark knows its size, and broadcasts it only if it is small
    paths = scratch.keep(host_paths(pages, url_col, html_col).withColumnRenamed("host", "_host"), "paths")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.join(paths, host_of(F.col("url")) == F.col("_host"), "left")
    out = rows.select("page_id", "url", extract_column(F.col("html"), F.col("path"), F.col("left_out"), F.col("kept")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
