"""HTML extraction (operator 10) by consensus host paths.

Each page is read as a stream of tags and cut into blocks. A block's path is the chain of its containers, each generalised
to tag and classes without digits. On its own page, a container scores by the text that it holds outside links against the
text in links, and by what its tag and classes say. Spark adds up, over all pages of a host, how often each generalised path
is a page's best container, and its score; the host's winning path is the one with most votes. The text is then extracted
again from the blocks: those under the host's winning path. A page keeps its own best container where that is an article by its
tag or name and the winner only a part of it, or where the winner holds less than LEAST_SHARE of its text.

A page is read in one pass, in time linear in its length: a tag whose quotes never close ends at the first ">", and so do all
after it; a "<" that no ">" follows is text; a comment or script that isn't closed reaches to the page's end.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import prepare, stored, table
from .words import bounded

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
DROPPED_TAGS = frozenset("nav header footer aside form button select menu dialog fieldset head".split())
CONTAINERS = frozenset("article body center div main section td".split())
#: Parts of class and id names that mark what is no article text.
DROPPED_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|header|footer|masthead|side-?bar\w*|aside|widget\w*|related|recommend\w*|share\w*|sharing|social\w*|comment\w*|disqus\w*|repl(?:y|ies)|cookie\w*|consent\w*|gdpr|notice\w*|popup\w*|modal\w*|overlay\w*|newsletter\w*|subscri\w*|signup|login|toolbar|pagination|pager|skip\w*)(?:$|[-_ ])",
    re.I,
)
GOOD_NAMES = re.compile(r"(?:^|[-_ ])(?:article\w*|content|main|body|post|entry|story|text)(?:$|[-_ ])", re.I)
#: Elements whose end tag may be left out, with the start tags that end them.
CLOSED_BY = {"p": BLOCKS - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend", "summary", "figcaption", "button"} | {"li", "dd", "dt", "td", "th", "tr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}

#: A tag; only a value after "=" may hold ">" in quotes.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>""")
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Tags whose text is a container of many blocks; others are dropped for a name only if it is one of the dropped names itself.
NAMED = frozenset("div section aside ul ol dl table main article center body figure details".split())
#: What a dropped name may be part of inside an article.
TITLE_NAMES = re.compile(r"^(?:article|post|entry|story|content|page|main|title)[-_](?:header|heading)$|^(?:header|heading)[-_](?:title|content)$", re.I)
#: Containers that a path tells at most, and the share of a page's own text that its host's winning path must hold.
DEPTH, LEAST_SHARE = 64, 0.5
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
DIGITS = re.compile(r"\d+")


def _names(attributes: str) -> tuple[str, bool]:
    """Classes and id as one string, and whether the element is hidden."""
    names, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "hidden":
            hidden = True
        else:
            names.append(value)
    return " ".join(names), hidden


def unwanted(tag: str, names: str) -> bool:
    """Whether a tag's classes and id mark it as no article text: a container by a part of one of them, other tags by a whole one."""
    if tag in NAMED:
        return any(DROPPED_NAMES.search(c) and not TITLE_NAMES.search(c) for c in names.split())
    return any(DROPPED_NAMES.fullmatch(c) for c in names.split())


#: Bytes of hosts and paths up to which they are sent to every task.
SMALL = 8 << 20
BLOCKS_TYPE = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))


class Page:
    """Blocks of a page in order: path of containers, whether dropped, text and characters in links."""

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple, bool, str, int]] = []
        self.stack: list[tuple[str, bool, bool]] = [("", False, False)]  # tag, whether it is a step of the path, dropped
        self.path: list[tuple[str, int]] = [("page", 0)]  # steps, and the numbers of their containers
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked, self.in_link, self.count = 0, 0, 0
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, size, tag_pattern = 0, len(source), TAG
        last = source.rfind(">")
        while at < size:
            start = source.find("<", at)
            if start < 0 or start > last:
                break
            ahead = source[start + 1 : start + 2]
            if source.startswith("<!--", start):
                self._text(source[at:start])
                end = source.find("-->", start + 2)
                at = size if end < 0 else end + 3
                continue
            if source.startswith("<![CDATA[", start):
                end = source.find("]]>", start)
                self._text(source[at:start] + source[start + 9 : size if end < 0 else end])
                at = size if end < 0 else end + 3
                continue
            if ahead in ("!", "?"):
                self._text(source[at:start])
                at = source.find(">", start) + 1
                continue
            m = tag_pattern.match(source, start) if ahead == "/" or ahead.isalpha() else None
            if m is None and ahead.isalpha() and tag_pattern is TAG:
                tag_pattern = BARE_TAG  # quotes are broken from here on
                continue
            if m is None:
                self._text(source[at : start + 1])
                at = start + 1
                continue
            self._text(source[at:start])
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in RAW and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else size
            else:
                self._open(tag, m[3])
        self._text(source[at:])

    def _text(self, raw: str) -> None:
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.in_link:
            self.linked += len(text.strip())

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((tuple(self.path), self.stack[-1][2], text, self.linked))
            self.parts, self.linked = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.in_link += 1
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        if tag not in BLOCKS:
            if attributes and ("class" in attributes.lower() or "hidden" in attributes):  # inline notices and adverts
                names, hidden = _names(attributes)
                if hidden or unwanted(tag, names):
                    self._flush()
                    self._push(tag, "", True)
            return
        self._flush()
        while len(self.stack) > 1 and tag in CLOSED_BY.get(self.stack[-1][0], ()):
            self._pop()
        names, hidden = _names(attributes) if attributes else ("", False)
        in_article = self.open["article"] or self.open["main"]
        dropped = hidden or tag in DROPPED_TAGS and not (tag == "header" and in_article) or bool(names and tag not in ("body", "html") and unwanted(tag, names))
        step = ""
        if tag in CONTAINERS or names:
            step = tag + "".join(f".{c}" for c in sorted({DIGITS.sub("", c) for c in names.lower().split()} - {""}))
        self._push(tag, step if len(self.path) < DEPTH else "", dropped)

    def _push(self, tag: str, step: str, dropped: bool) -> None:
        self.count += 1
        if step:
            self.path.append((step, self.count))
        self.open[tag] += 1
        self.stack.append((tag, bool(step), dropped or self.stack[-1][2]))

    def _pop(self) -> None:
        tag, is_step, _ = self.stack.pop()
        self.open[tag] -= 1
        if is_step:
            self.path.pop()

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if not self.open[tag]:
            return
        k = len(self.stack) - 1
        if tag not in BLOCKS:  # doesn't close the blocks in it
            while self.stack[k][0] != tag:
                if self.stack[k][0] in BLOCKS:
                    return
                k -= 1
        self._flush()
        while self.stack[-1][0] != tag:
            self._pop()
        self._pop()

    def scores(self) -> dict[tuple, float]:
        """Score of each container's generalised path; nested containers share a block's text, the outer ones less of it."""
        out: dict[tuple, float] = {}
        for path, dropped, text, linked in self.blocks:
            if dropped or not path:
                continue
            gain, steps = len(text) - 2.0 * linked, [s for s, _ in path]
            for k in range(len(path)):
                own = tuple(steps[: k + 1])
                tag = own[-1].split(".")[0]
                weight = {"article": 1.6, "main": 1.4}.get(tag, 1.0) * (1.2 if GOOD_NAMES.search(own[-1].replace(".", " ")) else 1.0) * 0.9 ** (len(path) - 1 - k)
                out[own] = out.get(own, 0.0) + gain * weight
        return out

    def kept(self) -> list[tuple[str, str]]:
        """Path and text of the blocks that count as text, in order."""
        return [("\t".join(s for s, _ in path), text) for path, dropped, text, _ in self.blocks if not dropped and path]


def best(scores: dict[tuple, float]) -> tuple:
    """Highest score; ties go to the longer, then the first path."""
    return min(scores, key=lambda p: (-scores[p], -len(p), p)) if scores else ()


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, html to page_id, url, text, n_chars, host and the path used; a row for each row of pages.

    A null or empty html gives an empty text; a null url belongs to the host ''; broken markup is read as it stands;
    repeated rows and page_ids vote and return as often as they occur. Other columns are not read.
    """
    spark = pages.sparkSession
    prepare(spark)
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    key = f"page_id {dict(pages.dtypes)['page_id']}, url string"

    def parse(batches):
        for b in bounded(batches, "html"):
            hosts, paths, scores, blocks, whole = [], [], [], [], []
            for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = Page(h)
                found = page.scores()
                path = best(found)
                hosts.append(host(u))
                paths.append("\t".join(path))
                scores.append(max(0, round(found.get(path, 0.0))))
                blocks.append([{"path": p, "text": t} for p, t in page.kept()])
                whole.append(bool(path) and (path[-1].split(".")[0] in ("article", "main") or bool(GOOD_NAMES.search(path[-1].replace(".", " ")))))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(hosts, type=pa.string()), pa.array(paths, type=pa.string()), pa.array(scores, type=pa.int64()), pa.array(whole, type=pa.bool_()), pa.array(blocks, type=BLOCKS_TYPE)], names=["page_id", "url", "host", "own", "score", "whole", "blocks"])

    parsed = stored(pages.mapInArrow(parse, f"{key}, host string, own string, score long, whole boolean, blocks array<struct<path:string,text:string>>"), "pages")
    votes = parsed.where("score > 0").groupBy("host", F.col("own").alias("path")).agg(F.count("*").alias("votes"), F.sum("score").alias("total"))
    winners = stored(votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "total", "path")).alias("winner")), "host-paths")
    size = winners.agg(F.sum(F.length("host") + F.length("winner"))).first()[0] or 0
    if size <= SMALL:  # else a shuffled join, which Spark splits where a host is hot
        winners = F.broadcast(winners)

    def under(path: Column) -> Column:
        return F.filter("blocks", lambda b: (b.path == path) | b.path.startswith(F.concat(path, F.lit("\t"))))

    def size_of(blocks: str) -> Column:
        return F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b.text))

    voted = parsed.join(winners, "host", "left").withColumn("winning", F.coalesce(under(F.col("winner")), F.array().cast("array<struct<path:string,text:string>>"))).withColumn("mine", under(F.col("own")))
    a_part = F.col("whole") & F.coalesce(F.col("winner").startswith(F.concat("own", F.lit("\t"))), F.lit(False))
    wins = (F.size("winning") > 0) & ~a_part & (size_of("winning") >= LEAST_SHARE * size_of("mine"))
    voted = voted.withColumn("wins", wins)
    text = F.array_join(F.transform(F.when(F.col("wins"), F.col("winning")).otherwise(F.col("mine")), lambda b: b.text), "\n\n")
    path = F.when(F.col("wins"), F.col("winner")).otherwise(F.col("own"))
    return voted.select("page_id", "url", text.alias("text"), "host", path.alias("path")).withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
