"""Main text of web pages by consensus paths of their hosts.

Every page's containers are scored by the text of their blocks.  The best one of a
page votes, with its text, for its generalised path (tags with their classes, digits
removed) among the pages of the host; Spark sums the votes.  The blocks of the pages
are then read again along the winning paths of their host; a page that has none of
them uses its own best container.

Inside a container all blocks are kept in page order except boilerplate, told by tag
or by the words of ``class``, ``id`` and ``role`` (ids of headings, and of sections
inside an article, name topics), or hidden (``hidden``, ``aria-hidden=true``, ``display:none``).
A header element is the page's unless it is in an article, main or section element; classes like
``entry-header`` inside an article or main element name its own head.  Character references are decoded,
white space inside a block becomes one space, blocks are joined by a line feed.

Null or empty html gives an empty text; null urls and urls without a host share one
empty host.  Unclosed tags, comments and quotes end with the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.llm.common import thrifty
from tidyledger.session import stored

LEAST_SHARE = 0.1  # of a host's votes that a winning path needs

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']*(?:"[^"]*"|'[^']*'))*[^>"']*|[^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_TOKEN = re.compile(r"[a-z]+", re.I)

RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("nav footer aside form menu dialog button select template svg object canvas head".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu header masthead topbar footer colophon sidebar aside notice notices cookie cookies "
    "consent gdpr banner ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "comment comments commentlist disqus respond replies discussion newsletter subscribe signup login share sharing "
    "social related recommended breadcrumb breadcrumbs pagination pager popup modal overlay toolbar widget search "
    "contentinfo complementary alert disclaimer skip".split()
)
CONTAINERS = frozenset("html body article main section div td header blockquote center details figure".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre table thead tbody tfoot tr th caption hr address summary figcaption "
    "fieldset legend nav footer aside form menu dialog template option select button head title".split()
)
OWN_HEAD = frozenset("header masthead topbar".split())  # in an article: its own head, not the page's
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = BLOCKS - {"option", "button", "select"}
_SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
_SCOPES = frozenset("html body article main section div table ul ol dl td th aside nav footer header form".split())


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for key, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(key.lower(), a or b or c)
    return found


def _hidden(marks: dict[str, str]) -> bool:
    return (
        "hidden" in marks
        or marks.get("aria-hidden", "").strip().lower() == "true"
        or bool(_UNSEEN.search(marks.get("style", "")))
    )


def _dropped(tag: str, marks: dict[str, str], inside: bool, sectioned: bool) -> bool:
    """Whether a block is boilerplate.

    ``inside`` an article or main element the id of a section is its topic and headers are its own;
    ``sectioned`` tells that it is in one of them or in a section.
    """
    if tag in DROPPED_TAGS or (tag == "header" and not sectioned):
        return True
    if not marks or tag in ("html", "body", "article", "main"):
        return False
    topic = tag in HEADINGS or (inside and tag == "section")
    names = " ".join(marks.get(x, "") for x in (("class", "role") if topic else ("class", "id", "role")))
    words = {x.lower() for x in _TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names))}
    return not words.isdisjoint(DROPPED_WORDS - OWN_HEAD if inside else DROPPED_WORDS)


class Page:
    """Containers and blocks of a page.

    ``parent``, ``tag`` and ``path`` by container; ``blocks`` has ``(container, text, link characters,
    whether it is a heading)`` in page order.
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.path = [-1], [""], [""]
        self.blocks: list[tuple[int, str, int, bool]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        # Tag, container, dropped, within an article or main element, within one of them or a section.
        stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        text: list[str] = []
        links = depth = at = 0

        def flush() -> None:
            nonlocal links
            if text:
                tag, container, drop = stack[-1][:3]
                if not drop and (joined := " ".join(unescape("".join(text)).split())):
                    self.blocks.append((container, joined, links, tag in HEADINGS))
                text.clear()
            links = 0

        def pop(tags: set[str] | frozenset[str], limit: frozenset[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    flush()
                    del stack[k:]
                    return
                if stack[k][0] in limit:
                    return

        while m := _TAG.search(html, at):
            if m.start() > at:
                piece = html[at : m.start()]
                text.append(piece)
                links += len(piece) if depth else 0
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag == "a":
                    depth = 0
                elif tag in BLOCKS:
                    pop({tag}, frozenset({"article", "main", "body"}) - {tag})
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                depth = 1
            elif tag in BLOCKS:
                flush()
                if tag in _CLOSES_P:
                    pop({"p"}, _SCOPES)
                if tag in _SIBLINGS:
                    pop(_SIBLINGS[tag], _SCOPES - _SIBLINGS[tag])
                if tag in VOID or m[3].endswith("/"):
                    continue
                marks = _attributes(m[3])
                _, container, drop, inside, sectioned = stack[-1]
                drop = drop or _dropped(tag, marks, inside, sectioned) or _hidden(marks)
                inside = inside or tag in ("article", "main")
                sectioned = inside or sectioned or tag == "section"
                if tag in CONTAINERS and not drop:
                    if tag != "html":
                        container = self._add(container, tag, marks)
                stack.append((tag, container, drop, inside, sectioned))
        if at < len(html):
            text.append(html[at:])
        flush()
        del stack[1:]

    def _add(self, parent: int, tag: str, marks: dict[str, str]) -> int:
        words = sorted({re.sub(r"\d+", "", x).lower() for x in marks.get("class", "").split()} - {""})
        name = tag + "".join(f".{x}" for x in words)
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(f"{self.path[parent]}/{name}")
        return len(self.parent) - 1

    def scores(self) -> list[float]:
        """Of each container: the text outside links of its blocks, half of it for the container around it.

        The article or main element around a container has its score as well.
        """
        scores = [0.0] * len(self.parent)
        for container, text, links, heading in self.blocks:
            value = max(0, len(text) - 2 * links) * (0.2 if heading else 1.0)
            scores[container] += value
            if self.parent[container] >= 0:
                scores[self.parent[container]] += value / 2
        below = [0.0] * len(self.parent)  # best score inside; containers come after those around them
        for k in range(len(self.parent) - 1, 0, -1):
            if self.tag[k] in ("article", "main"):
                scores[k] = max(scores[k], 1.01 * below[k])
            around = self.parent[k]
            below[around] = max(below[around], below[k], scores[k])
        return scores


def choose(paths: list[str], scores: list[float], winners: list[str]) -> str:
    """The first of the host's winning paths that the page has, else the path of its best container."""
    sums: dict[str, float] = {}
    for path, score in zip(paths, scores, strict=True):
        sums[path] = sums.get(path, 0.0) + score
    for path in winners:
        if sums.get(path, 0.0) > 0:
            return path
    return paths[max(range(len(scores)), key=lambda k: (scores[k], -k))]


def below(path: str, paths: list[str], parents: list[int], at: list[int], texts: list[str]) -> str:
    """All blocks below the containers with that path, in page order."""
    inside = set()
    for k, parent in enumerate(parents):
        if paths[k] == path or parent in inside:
            inside.add(k)
    return "\n".join(text for container, text in zip(at, texts, strict=True) if container in inside)


def _host(url: str) -> Column:
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), pattern, 1))


def read_pages(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Containers (path, parent, score) and blocks (container, text) of every page, and its own best path."""
    names = ["page_id", "url", "host", "paths", "parents", "scores", "at", "texts", "best", "votes"]
    floats, ints, strings = pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.string())
    kinds = [strings, ints, floats, ints, strings, pa.string(), pa.int64()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for value in part.column(3):
                page = Page(value.as_py() or "")
                scores = page.scores()
                best = choose(page.path, scores, [])
                vote = round(max(scores))
                rows.append(
                    (page.path, page.parent, scores, [x[0] for x in page.blocks], [x[1] for x in page.blocks], best, vote)
                )
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *arrays], names=names)

    kind = dict(pages.dtypes)[id_column]
    rows = pages.select(
        F.col(id_column).alias("page_id"), F.col(url).alias("url"), _host(url).alias("host"), F.col(html).alias("html")
    )
    return rows.mapInArrow(
        thrifty(run),
        f"page_id {kind}, url string, host string, paths array<string>, parents array<int>, scores array<double>, "
        "at array<int>, texts array<string>, best string, votes long",
    )


def winners(read: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """``(host, winners)``: at most ``1 / least_share`` paths of each host, most votes first.

    The votes of a host meet as one row for each task and path.
    """
    cast = read.where("votes > 0").groupBy("host", F.col("best").alias("path")).agg(F.sum("votes").alias("votes"))
    total = Window.partitionBy("host")
    shares = cast.withColumn("share", F.col("votes") / F.sum("votes").over(total)).where(F.col("share") >= least_share)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return shares.groupBy("host").agg(F.transform(listed, lambda x: x["path"]).alias("winners"))


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page.

    The page is parsed once; the second pass reads the written blocks.
    """
    read = stored(read_pages(pages, id_column, url, html), "html-read")
    # The written winners have a known size: Spark broadcasts them only if that is small.
    chosen = stored(winners(read), "html-winners")
    rows = read.join(chosen, "host", "left").select(
        "page_id", "url", "paths", "parents", "scores", "at", "texts", F.coalesce("winners", F.array()).alias("winners")
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [
                below(choose(paths, scores, known), paths, parents, at, blocks)
                for paths, parents, scores, at, blocks, known in zip(
                    *(x.to_pylist() for x in part.columns[2:]), strict=True
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(x) for x in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = dict(pages.dtypes)[id_column]
    return rows.mapInArrow(thrifty(run), f"page_id {kind}, url string, text string, n_chars long")
