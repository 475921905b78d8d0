"""HTML extraction by site template removal.

Every page is parsed into a tree of elements. A subtree's hash covers its tags, classes and text; Spark counts on how
many pages of a host each hash stands, and subtrees that recur on many of them are the site's template and go. Element
roles (nav, footer, aside, form ..., or a class that names such a role) remove what differs from page to page; an element
that holds a main, the longest article or most of the page's text is the page's frame, whatever its class says.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, written

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I) for tag in RAW}
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset(["br", "body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot"])
#: An open element of the first set ends where one of the second begins, looking no further than the barrier.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
DROP = frozenset("head nav footer aside form script style textarea title noscript template iframe noembed noframes select button input dialog object svg canvas audio video map menu".split())
ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of a class or id that name a part which is not the article, and words that say no more beside them.
BESIDE = frozenset("area bar block bottom box button buttons container content form group holder inner item items left link links list message panel posts right row section site slot strip text title top unit widget wrap wrapper x".split())
PART = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar share sharing social comment comments reply replies respond disqus related recommended newsletter subscribe subscription signup popup modal overlay widget pagination pager toolbar login search skip".split()
)
#: Tags that frame a page as well as parts of it.
FRAME = frozenset(["form", "dialog", "header"])
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption b i em strong a span code u s sub sup small br hr img".split())
COMMENTS = re.compile(r"\b(?:comments?|reply|replies|respond|disqus)\b", re.I)
NAMED = re.compile(r"\b(?:class|id)\s*=", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Node:
    __slots__ = ("tag", "parts", "kept", "hash", "up", "label", "frame")

    def __init__(self, tag: str, up: Node | None, label: str = ""):
        self.tag, self.up, self.label, self.parts, self.kept, self.hash, self.frame = tag, up, label, [], True, b"", False


def parse(page: str) -> Node:
    """The page's tree. parts of a node: text and nodes, in order; open elements end as the standard implies."""
    root = node = Node("#root", None)
    at, open_p = 0, 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at = m.end()
        end, tag = m[1], m[2] or m[4]
        if end:
            end, up = end.lower(), node
            while up is not root and up.tag != end:
                up = up.up
            if up is not root:
                while node is not up:
                    open_p -= node.tag == "p"
                    node = node.up
                open_p -= node.tag == "p"
                node = node.up
            elif end == "br":
                node.parts.append(Node("br", node))
        elif tag:
            tag = tag.lower()
            closes, barrier = ENDS.get(tag, ((), ()))
            if open_p and tag in CLOSES_P:
                up = node
                while up is not root and up.tag != "p" and up.tag not in ("button", "table", "object"):
                    up = up.up
                if up.tag == "p":
                    while node is not up.up:
                        open_p -= node.tag == "p"
                        node = node.up
            if closes:
                up, last = node, None
                while up is not root and up.tag not in barrier:
                    if up.tag in closes:
                        last = up
                    up = up.up
                if last is not None:
                    while node is not last.up:
                        open_p -= node.tag == "p"
                        node = node.up
            child = Node(tag, node, m[3] or m[5] or "")
            node.parts.append(child)
            if tag in VOID:
                continue
            if tag in RAW:
                found = RAW_END[tag].search(page, at)
                close = found.start() if found else len(page)
                child.parts.append(page[at:close])
                at = page.find(">", close) + 1 or len(page)
                continue
            node = child
            open_p += tag == "p"
    if at < len(page):
        node.parts.append(page[at:])
    return root


def attributes(label: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(label):
        out.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    return out


def named_part(names: str) -> bool:
    """Whether a whole name of a class or id list is made of PART's words, and of BESIDE's at most."""
    for name in names.split():
        words = re.findall("[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if not PART.isdisjoint(words) and all(w in PART or w in BESIDE for w in words):
            return True
    return False


def is_part(node: Node, inside: bool) -> bool:
    """Whether an element's tag, role, class or id says that it is not of the article."""
    tag = node.tag
    if tag in DROP or tag == "header" and not inside:
        return not (node.frame and tag in FRAME)
    if not node.label or node.frame or tag in ("html", "body", "main"):
        return False
    a = attributes(node.label)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if a.get("role", "").lower() in ROLE:
        return True
    return not (tag == "article" and not inside) and named_part(f"{a.get('class', '')} {a.get('id', '')}")


def mark_frames(root: Node) -> None:
    """Marks what holds a main or the longest article, and what has more than half of the page's text; raw text and that of
    DROP's tags do not count."""
    order, size = walk(root), {}
    for node in reversed(order):
        own = sum(size[id(x)] if isinstance(x, Node) else len(x) - x.count(" ") for x in node.parts)
        size[id(node)] = 0 if node.tag in DROP and node.tag not in FRAME else own
    articles = [n for n in order if n.tag == "article"]
    for node in [n for n in order if n.tag == "main"] + ([max(articles, key=lambda n: size[id(n)])] if articles else []):
        while (node := node.up) is not None and not node.frame:
            node.frame = True
    for node in order:
        if 2 * size[id(node)] > size[id(root)] and not (node.label and COMMENTS.search(node.label)):
            node.frame = True


def roots(root: Node) -> list[Node]:
    """The outermost articles, else mains, else the whole page; frames are marked."""
    mark_frames(root)
    for wanted in ("article", "main"):
        out, todo = [], [root]
        while todo:
            node = todo.pop()
            for x in reversed(node.parts):
                if isinstance(x, Node):
                    todo.append(x)
            if node.tag == wanted or wanted == "main" and node.label and attributes(node.label).get("role") == "main":
                up = node.up
                while up is not None and up.tag != wanted and not is_part(up, False):
                    up = up.up
                if up is None:
                    out.append(node)
        if out:
            return out
    return [root]


def walk(root: Node) -> list[Node]:
    """Nodes, parents first, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.parts) if isinstance(x, Node)]
    return out


def candidates(page: str) -> tuple[list[Node], list[Node]]:
    """Where the main text is, and the hashed elements there that may be template. Hashes of text elements in an article
    that have neither class nor id begin with 1: passages may recur there."""
    tops, out = roots(parse(page)), []
    for top in tops:
        article = top.tag in ("article", "main")
        for node in reversed(walk(top)):
            h = hashlib.blake2b(f"{node.tag} {node.label}".encode(errors="replace"), digest_size=8)
            for x in node.parts:
                h.update(x.hash if isinstance(x, Node) else b"\0" + " ".join(x.split()).encode(errors="replace"))
            node.hash = (b"\1" if article and node.tag in TEXT_TAGS and not NAMED.search(node.label) else b"\0") + h.digest()
            if node is not top and node.tag not in ("html", "body", "br", "hr", "img"):
                out.append(node)
    return tops, out


def main_text(page: str, template: frozenset[bytes] = frozenset()) -> str:
    """The page's main text, without elements whose hash is in template."""
    tops, maybe = candidates(page) if template else (roots(parse(page)), [])
    for node in maybe:
        node.kept = node.hash not in template
    return text_of(tops)


def text_of(tops: list[Node]) -> str:
    """The text of what is kept below tops."""
    blocks: list[str] = []
    text: list[str] = []

    def flush() -> None:
        if text and (block := " ".join(html.unescape("".join(text)).split())):
            blocks.append(block)
        text.clear()

    for top in tops:
        inside = top.tag in ("article", "main") or bool(top.label)
        todo: list[Node | str | None] = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                text.append(x)
            elif x.kept and (x is top or not is_part(x, inside)):
                parts = x.parts
                if x.tag == "header" and inside:
                    parts = [n for n in walk(x) if n.tag in HEADINGS]
                if x.tag in BLOCK:
                    flush()
                    todo.append(None)
                todo += reversed(parts)
        flush()
    return "\n".join(blocks)


def site_templates(pages: DataFrame, least: int = 3, share: float = 0.2, text_least: int = 10, text_share: float = 0.8) -> DataFrame:
    """Hashes of subtrees that stand on at least `least` page bodies and on `share` of the page bodies of a host, as an
    array for each host. A text element of an article that has neither class nor id must stand on `text_least` bodies and
    on `text_share` of them, as passages recur there. Pages of one main text are one body, that of the least structure:
    copies of a page count once, however many they are. A page with E elements adds E hashes, so a host has at most
    E / share of them."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for host, page in zip(b["host"], b["html"], strict=True):
                tops, maybe = candidates(page)
                body = hashlib.blake2b(text_of(tops).encode(errors="replace"), digest_size=16).digest()
                out.append((host, body, sorted({n.hash for n in maybe})))
            yield pd.DataFrame(out, columns=["host", "body", "hs"])

    rows = pages.select(_host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    bodies = rows.mapInPandas(hashes, "host string, body binary, hs array<binary>").groupBy("host", "body").agg(F.min("hs").alias("hs"))
    bodies = written(bodies, "html-bodies")
    sizes = bodies.groupBy("host").agg(F.count("*").alias("pages"))
    counts = bodies.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    plain = F.substring("h", 1, 1) == F.lit(b"\1")
    enough = F.when(plain, (F.col("n") >= text_least) & (F.col("n") >= F.col("pages") * text_share)).otherwise(F.col("n") >= F.col("pages") * share)
    many = counts.join(sizes, "host").where(enough)
    return many.groupBy("host").agg(F.collect_list("h").alias("template"))


def _host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))


def extract(pages: DataFrame, least: int = 3, share: float = 0.2, part: int = 64) -> DataFrame:
    """Main text of every row of pages (page_id, url, html): page_id, url, text, n_chars.

    Null html, and pages without text, give an empty text. A null url, or one without a host, counts as the host "".
    Repeated rows are pages each. White space is what str.split() splits at; br ends a block. A host's pages are dealt to
    parts of `part` pages, or of a ten-thousandth of all pages where that is more, each with a copy of the host's template:
    a host with a third of all pages is no one task's, and at most 10,000 hosts have parts (they are broadcast).
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [main_text(p, frozenset(map(bytes, t)) if t is not None else frozenset()) for p, t in zip(b["html"], b["template"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out, "n_chars": [len(x) for x in out]})

    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"), F.monotonically_increasing_id().alias("place"))
    most = max(part, -(-pages.count() // 10_000))
    large = pages.groupBy(_host().alias("host")).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    large = F.broadcast(written(large, "html-large-hosts"))  # 10,000 hosts at most, as each has more than a 10,000th of the pages
    template = site_templates(pages, least, share).join(large, "host", "left")
    template = template.select("host", "template", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    rows = rows.join(large, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "place"), F.coalesce("parts", F.lit(1))).cast("int"))
    rows = rows.join(template, ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "template").mapInPandas(texts, "page_id long, url string, text string, n_chars long")
