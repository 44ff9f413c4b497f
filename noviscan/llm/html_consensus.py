"""Main text of web pages by the container paths a host's pages agree on.

Each page scores its containers and votes for the generalised tag-class path of the best one. Spark sums the
votes per host and path; every page is then extracted again from the winning path that holds its text, united
with the page's own best container.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from noviscan.llm.base import query, slices, table, text_of, written

PATHS_PER_HOST = 8
LEAST_SHARE = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body center html".split())
#: Elements that never hold the article.
NOISE_TAGS = frozenset(
    "nav footer aside form script style noscript iframe object embed svg canvas audio video button select textarea "
    "template dialog menu head title datalist map".split()
)
#: Words of class, id or role that mark menus, notices, adverts, reader comments and the like.
NOISE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside rail widget widgets ad ads adv "
    "advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations comment comments commentlist respond reply replies disqus "
    "discussion pager pagination copyright legal toolbar search searchbox form complementary contentinfo".split()
)
NOT_A_MARK = frozenset("has with no without is js".split())
NEVER_NOISE = frozenset("html body article main".split())
CONTENT_WORDS = frozenset("content article post entry story text articlebody main".split())
#: An open element on the left is closed by a start tag on the right.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "thead", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}
SCOPE = frozenset("table td th ul ol dl select html body".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    __slots__ = ("tag", "parent", "path", "noise", "value", "weight", "container")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent, self.value = tag, parent, 0.0
        classes = [re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()]
        self.path = (parent.path if parent else "") + "/" + ".".join([tag, *sorted(set(classes))])
        self.container = tag in CONTAINERS
        words = set()
        noise = tag in NOISE_TAGS or (tag == "header" and not _inside(parent, ("article", "main")))
        for mark in (*attributes.get("class", "").split(), attributes.get("id", ""), attributes.get("role", "")):
            found = [w.lower() for w in WORD.findall(mark)]
            words.update(found)
            if found and found[0] not in NOT_A_MARK and not NOISE_WORDS.isdisjoint((found[0], found[-1])):
                noise = noise or tag not in NEVER_NOISE or (tag == "article" and found[0] in ("comment", "reply"))
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
            noise = True
        self.noise = bool(noise or (parent and parent.noise))
        self.weight = 1.5 if tag == "article" else 1.4 if tag == "main" else 0.9 if tag in ("body", "html") else 1.0
        if self.weight == 1.0 and not CONTENT_WORDS.isdisjoint(words):
            self.weight = 1.25


def _inside(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Elements that may hold blocks, and the blocks that are no noise with the element they stand in."""
    root = Node("#", None, {})
    root.path = ""
    nodes, blocks, stack = [], [], [root]
    held: list[str] = []
    linked, in_link = 0, 0

    def close_block() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text and not stack[-1].noise:
                blocks.append((stack[-1], text))
                value, node = max(0.0, len(text) - 2.0 * linked), stack[-1]
                while node is not None:
                    node.value += value
                    node = node.parent
            held.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            held.append(references.unescape(raw) if "&" in raw else raw)
            if in_link:
                linked += len(held[-1].strip())

    at, size = 0, len(page)
    for found in TOKEN.finditer(page):
        if found.start() < at:
            continue  # inside raw text
        add(page[at : found.start()])
        at = found.end()
        closing, tag = found[1] if found[2] else found[4], (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            held.append(" ")
        if closing:
            if tag in BLOCKS or tag in NOISE_TAGS:
                depth = len(stack) - 1
                while depth > 0 and stack[depth].tag != tag:
                    depth -= 1
                if depth:
                    close_block()
                    in_link = 0
                    del stack[depth:]
                elif tag == "p":
                    close_block()
            continue
        attributes = found[3] if found[2] else found[6]
        if tag in RAW:
            end = re.compile(rf"</{tag}(?![a-z0-9])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag not in BLOCKS and tag not in NOISE_TAGS:
            continue
        if tag in BLOCKS:
            close_block()
            if stack[-1].tag == "p" or stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                stack.pop()
        if tag in VOID:
            continue
        depth = len(stack) - 1
        while depth > 0 and stack[depth].tag not in SCOPE | {tag} and tag not in CLOSED_BY.get(stack[depth].tag, ()):
            depth -= 1
        if depth > 0 and tag in CLOSED_BY.get(stack[depth].tag, ()):
            del stack[depth:]
        named = {k.lower(): references.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        stack.append(Node(tag, stack[-1], named))
        nodes.append(stack[-1])
    add(page[at:])
    close_block()
    return nodes, blocks


def best_container(nodes: list[Node]) -> Node | None:
    """The container of the highest text value times weight, the outermost among equals."""
    best = None
    for node in nodes:
        if node.container and not node.noise and node.value > 0 and (best is None or node.value * node.weight > best.value * best.weight):
            best = node
    return best


def text_under(blocks: list[tuple[Node, str]], chosen: set[int]) -> str:
    def under(node: Node | None) -> bool:
        while node is not None:
            if id(node) in chosen:
                return True
            node = node.parent
        return False

    return "\n\n".join(text for node, text in blocks if under(node))


def main_text(page: str, paths: list[str]) -> str:
    """Text of the first winning path that holds its share of the page, and of the page's own best container.

    Both are kept, in the order of the page, as either may hold a part of the article that the other lacks. Pages without container, such as plain text, give all their blocks.
    """
    nodes, blocks = parse(page)
    best = best_container(nodes)
    if best is None:
        return "\n\n".join(text for _, text in blocks)
    for path in paths:
        chosen = [n for n in nodes if n.path == path and not n.noise]
        if chosen and sum(n.value for n in chosen if not _inside_of(n, chosen)) >= LEAST_SHARE * best.value:
            return text_under(blocks, {id(best), *(id(n) for n in chosen)})
    return text_under(blocks, {id(best)})


def _inside_of(node: Node, others: list[Node]) -> bool:
    known, up = {id(x) for x in others}, node.parent
    while up is not None:
        if id(up) in known:
            return True
        up = up.parent
    return False


def host_of(url):
    """Lower-case host of a URL without user, port and www; empty where there is none."""
    authority = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(authority, r"^(?:.*@)?(?:www\.)?|:\d*$", ""))


def host_paths(pages: DataFrame, paths_per_host: int = PATHS_PER_HOST) -> DataFrame:
    """(host, paths): the winning paths of each host, most votes first.

    A page's vote is the share of its text that its best container holds. Votes are summed before anything
    is shuffled by host; a page that none of the winners fits is extracted from its own best container.
    """

    def vote(batches):
        for batch in slices(batches, 128):
            out = []
            for host, page in zip(*[c.to_pylist() for c in batch.columns]):
                nodes, blocks = parse(page)
                best = best_container(nodes)
                if best is not None:
                    total = sum(len(text) for _, text in blocks)
                    out.append((host, best.path, min(1.0, best.value / max(total, 1))))
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()))], ["host", "path", "vote"]
            )

    source = pages.select(host_of(F.col("url")).alias("host"), text_of("html").alias("html")).filter("host != ''")
    votes = source.mapInArrow(vote, "host string, path string, vote double").groupBy("host", "path")
    votes = votes.agg(F.round(F.sum("vote"), 3).alias("votes"))
    ranked = votes.withColumn("rank", F.row_number().over(W.partitionBy("host").orderBy(F.desc("votes"), "path")))
    top = ranked.filter(F.col("rank") <= paths_per_host).groupBy("host")
    return top.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``text``, empty where there is none.

    A null html is empty; a page without host has no consensus and uses its own best container. Repeated
    rows are extracted each. The winners are written first: Spark then sees their size and chooses between
    a broadcast and a join whose large partitions (a host with a third of all pages) it splits.
    """
    winners = written(host_paths(pages), "host-paths")
    source = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), text_of("html").alias("html"))
    joined = source.join(winners, "host", "left").select("page_id", "url", "paths", "html")

    def run(batches):
        for batch in slices(batches, 128):
            texts = [main_text(page, paths or []) for paths, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    fields = joined.select("page_id", "url").schema.add("text", T.StringType())
    return joined.mapInArrow(run, fields)


@query("op6_html_consensus")
def op6_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
