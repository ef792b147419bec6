"""Main text of web pages by paths on which the pages of a host agree.

Every element of a page that can hold an article is scored by the text in it that is neither link nor page furniture,
and by that text's share of all text in it. The elements vote for their path, a chain of tags and classes in which
numbers are generalised; votes are summed per host in Spark, and each page is read again at the path that won on its
host. A page without text at that path is read at its own best element.

Votes are summed inside tasks before the shuffle, so a host with a third of all pages costs a row per path and task.
Hosts with their paths are broadcast while they are fewer than ``BROADCAST_HOSTS`` and joined by a shuffle beyond.

Defined results: NULL and empty html give an empty text. Pages without a host vote together. Repeated rows vote once
each and stay repeated. Blocks end where elements displayed as blocks begin or end; ``br`` is white space.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, pick, small_batches
from .url_filter import split_url

BROADCAST_HOSTS = 200_000

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?>[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Elements by what they are for.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset(["", *"article body blockquote div main section td center".split()])  # "": the whole page
FURNITURE = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input label map menu nav noscript object "
    "script select style svg template textarea title video".split()
)
NAMES = frozenset(
    "ad ads adbox advert advertisement advertisements adverts alert banner breadcrumb breadcrumbs captcha comment "
    "commentlist comments consent cookie cookies dialog discussion disqus footer form gdpr header login masthead menu "
    "menubar modal nav navbar navigation navigator newsletter notice notices notification overlay pager pagination "
    "popup promo promoted promotion recommended related replies respond search share sharing sidebar signup sitemap "
    "skip social sponsor sponsored subscribe subscription survey teaser toolbar topbar tracking warning widget "
    "widgets".split()
)
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar"
    .split()
)
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
BOUNDS = frozenset("ul ol menu dl table tbody thead tfoot select article section div body".split())
#: Paths of more characters are named by a digest of the parent's name and the last step.
LONGEST_PATH = 1000
WEIGHT = {"article": 1.2, "main": 1.1, "body": 0.8, "": 0.5}


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    path: str
    parent: Node | None
    furniture: bool
    link: bool
    items: list = field(default_factory=list)  # texts and nodes in page order
    content: int = 0  # characters that are neither link nor furniture
    total: int = 0
    links: int = 0


def _attributes(text: str) -> dict[str, str]:
    return {
        m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)
    } if text and not text.isspace() else {}


def _is_furniture(tag: str, own: dict[str, str]) -> bool:
    if tag in FURNITURE:
        return True
    if not own or tag in ("html", "body"):
        return False
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True
    if tag in ("main", "article") and "comment" not in own.get("class", ""):
        return False
    names = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{own.get('class', '')} {own.get('id', '')}")
    return not NAMES.isdisjoint(re.split(r"[^a-z]+", names.lower()))


def _step(tag: str, own: dict[str, str]) -> str:
    names = {re.sub(r"\d+", "#", x.lower()) for x in own.get("class", "").split()}
    return ".".join([tag, *sorted(names)])


def _below(path: str, step: str) -> str:
    """The path of a child; a long one as a digest, so that deep nesting costs the same per element as flat pages."""
    path = f"{path}/{step}"
    return path if len(path) <= LONGEST_PATH else "#" + blake2b(path.encode("utf-8"), digest_size=16).hexdigest()


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are mended as far as blocks need it."""
    root = Node("", "", None, False, False)
    at, node = 0, root
    stack: list[Node] = [root]

    def close(tags: frozenset[str] | set[str], bounds: frozenset[str] = frozenset()) -> None:
        """Ends the nearest open element of these tags, unless a bound stands before it."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in bounds:
                return

    while m := TAG.search(page, at):
        if m.start() > at:
            stack[-1].items.append(page[at:m.start()])
        at = m.end()
        if m["end"]:
            close({m["end"].lower()})
        elif m[0].startswith("<![CDATA["):
            stack[-1].items.append(entities.escape(m[0][9:].removesuffix("]]>")))
        elif tag := (m["start"] or m["open"] or "").lower():
            own = _attributes(m["attributes"] or m["rest"] or "")
            if tag in BLOCKS:
                close({"p"}, BOUNDS | {"td", "th", "li"})
            if tag in HEADINGS:
                close(HEADINGS, BOUNDS | {"td", "th", "li"})
            if tag in CLOSES:
                close(set(CLOSES[tag].split()), BOUNDS - ({"tbody", "thead", "tfoot"} if tag == "tr" else set()))
            top = stack[-1]
            node = Node(
                tag, _below(top.path, _step(tag, own)), top, top.furniture or _is_furniture(tag, own),
                top.link or tag == "a",
            )
            if tag == "header":  # inside an article a header may hold its headings
                node.furniture = top.furniture or not any(x.tag in ("article", "main") for x in stack)
            top.items.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID:
                stack.append(node)
    if at < len(page):
        stack[-1].items.append(page[at:])
    return root


def measure(root: Node) -> list[Node]:
    """Counts characters bottom up; returns the elements in page order."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    for node in reversed(nodes):
        for x in node.items:
            if isinstance(x, str):
                size = len(x.strip())
                node.total += size
                node.links += size * node.link
                node.content += size * (not node.link and not node.furniture)
        if node.tag in ("ul", "ol") and _is_menu(node):
            node.furniture, node.content = True, 0
        if node.parent is not None:
            node.parent.total += node.total
            node.parent.links += node.links
            node.parent.content += node.content
    return nodes


def _is_menu(node: Node) -> bool:
    """A list of at least three items whose text is links."""
    items = sum(1 for x in node.items if isinstance(x, Node) and x.tag == "li")
    return items >= 3 and node.links >= 0.9 * node.total


def score(node: Node) -> float:
    if not node.content or node.tag not in CONTAINERS or node.furniture:
        return 0.0
    return WEIGHT.get(node.tag, 1.0) * node.content * (node.content / node.total) ** 2


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under an element, without furniture."""
    out, open_ = [], []

    def end() -> None:
        text = " ".join(entities.unescape("".join(open_)).split())
        if text:
            out.append(text)
        open_.clear()

    todo: list[tuple[Node | str | None, bool]] = [(node, False)]
    while todo:
        x, heading = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if not heading:
                open_.append(x)
        elif x.furniture and x is not node:
            if x.tag in BLOCKS:
                end()
            else:
                open_.append(" ")
        elif x.tag in ("br", "td", "th", "wbr", "img", "hr") and not x.items:
            open_.append("" if x.tag == "wbr" else " ")
        else:
            inside = (heading or x.tag == "header") and x.tag not in HEADINGS
            if x.tag in BLOCKS:
                end()
                todo.append((None, False))
            elif x.tag in ("td", "th"):
                open_.append(" ")
            todo += [(y, inside) for y in reversed(x.items)]
    end()
    return out


def page_votes(page: str | None) -> list[dict]:
    """Paths of a page's elements with their scores as shares of the best."""
    nodes = measure(parse(page or ""))
    found: dict[str, float] = {}
    for node in nodes:
        if s := score(node):
            found[node.path] = found.get(node.path, 0.0) + s
    best = max(found.values(), default=0.0)
    return [{"path": p, "vote": s / best} for p, s in found.items() if s >= 0.25 * best]


def page_text(page: str | None, path: str | None) -> str:
    """The text at a path, or at the page's best element if there is none."""
    nodes = measure(parse(page or ""))
    if path is not None:
        inside, out = set(), []
        for node in nodes:
            if id(node.parent) in inside:
                inside.add(id(node))
            elif node.path == path and not node.furniture:
                inside.add(id(node))
                out += blocks(node)
        if out:
            return "\n".join(out)
    best = max(nodes, key=score)
    return "\n".join(blocks(best)) if score(best) else ""


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): per host the path with most votes, the first by name among equals."""
    @F.pandas_udf("array<struct<path: string, vote: double>>")
    def votes_of(htmls: pd.Series) -> pd.Series:
        return pd.Series([page_votes(x) for x in htmls], dtype=object)

    small_batches(pages.sparkSession)
    host, _ = split_url(F.col("url"))
    votes = pick(pages, "url", "html").select(host.alias("host"), F.explode(votes_of("html")).alias("v"))
    sums = votes.groupBy("host", "v.path").agg(F.round(F.sum("v.vote"), 6).alias("votes"))
    return sums.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("n"), "path"))["path"].alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, text) of every row of (page_id, url, html)."""
    @F.pandas_udf("string")
    def text_of(htmls: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([page_text(x, at) for x, at in zip(htmls, paths, strict=True)], dtype=object)

    paths = checkpointed(host_paths(pages))
    if paths.count() <= BROADCAST_HOSTS:
        paths = F.broadcast(paths)
    host, _ = split_url(F.col("url"))
    rows = pick(pages, "page_id", "url", "html").withColumn("host", host)
    return rows.join(paths, "host", "left").select("page_id", "url", "host", "path", text_of("html", "path").alias("text"))
