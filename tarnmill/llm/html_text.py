"""Main text of web pages by site template removal.

Each page is parsed into a tree, and the subtrees that a template may have made are hashed: all
outside the article, and inside it the containers, lists and tables that hold less than half of its
text, and whatever a class or id hints at. On a page without an article they are its containers, lists
and tables alone: no paragraph, table cell or inline element. Spark counts on how many pages of its host
each hash occurs; pages with one article count once, so that copies of a page don't make a template of
its parts. Subtrees that recur on many pages are deleted (without an article, not those in the midst of
the page's own text), together with the elements whose tag, role or whole class or id says that they
aren't the article. What is left of the article is cut into blocks.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Scratch, apart, free_others, texts_of, with_fields

#: A template: on so many different pages of a host at least, and on as many as the square root of its pages.
LEAST_PAGES = 5
#: Up to so many template hashes (8 bytes each) are broadcast; beyond, they are joined to the pages.
BROADCAST_HASHES = 2_000_000

# HTML's element kinds.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed iframe noframes".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
_ENDS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "html", "body"}
_SCOPE = frozenset("html body table td th caption button object".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_LIST_SCOPE = frozenset("ul ol dl table select html body".split())
_DROP = frozenset("script style noscript template head title meta link nav footer aside form button select textarea input iframe svg canvas dialog menu object embed applet audio video map noframes noembed".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_DROP_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies share sharing social related recommended widget skip pagination pager masthead topbar toolbar".split())
_PART_WORDS = frozenset("area bar block body box button buttons container content form group header heading icon icons inner item items global our page reader readers site user users visitor left link links list message panel post posts right section slot title top unit wrap wrapper".split())
_HEAD = frozenset("title meta link script style base noscript template".split())
_CONTAINERS = frozenset("article aside center details div dl fieldset figure main ol section span table ul".split())
_DROP_OUTSIDE = frozenset("header footer hd ft".split())
#: Blocks of text, which a class can say something of, but no id.
_TEXTS = frozenset("p li td th dd dt blockquote pre address".split())

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "hash", "links", "size", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(self.attrs)}


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are mended as browsers do for the common cases."""
    root = Node("html")
    stack, at, size = [root], 0, len(page)

    def close(tags, scope) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            if stack[-1].tag == "head" and not page[at:lt].isspace():
                stack.pop()
            stack[-1].children.append(html.unescape(page[at:lt]))
        if lt == size:
            break
        m = _TOKEN.match(page, lt)
        if not m:  # a lone less-than sign, or a tag that never ends
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
                continue
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            close({tag}, _SCOPE if tag not in _SCOPE else ())
            continue
        if stack[-1].tag == "head" and tag not in _HEAD:  # its end may be left out
            stack.pop()
        if tag in ("html", "body"):
            continue
        if tag in _ENDS_P:
            close({"p"}, _SCOPE)
        if tag in _CLOSES:
            close(_CLOSES[tag], _LIST_SCOPE)
        if tag[0] == "h" and len(tag) == 2 and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            stack.pop()
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in _VOID:
            stack.append(node)
    return root


def _names(text: str) -> list[list[str]]:
    """The names of a class or id attribute, each as its words."""
    return [[w for w in re.split(r"[-_]+", name) if w] or [name] for name in text.lower().split()]


def _dropped(node: Node, inside: bool) -> bool:
    """Whether tag, role, hiding, or the whole of a class or id says that an element isn't part of the article."""
    if node.tag in _DROP or node.tag == "header" and not inside:
        return True
    if not node.attrs:
        return False
    a = node.attributes()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if a.get("role", "").lower() in _DROP_ROLES:
        return True
    if node.tag not in _CONTAINERS and node.tag not in _TEXTS:
        return False
    drop = _DROP_WORDS if inside else _DROP_WORDS | _DROP_OUTSIDE
    told = a.get("class", "") + (f" {a.get('id', '')}" if node.tag in _CONTAINERS else "")
    return any(not drop.isdisjoint(words) and all(w in drop or w in _PART_WORDS or w.isdigit() for w in words) for words in _names(told))


def _hinted(node: Node) -> bool:
    """Whether a class or id has a word of what isn't the article: no proof, but such an element may be a template's."""
    if not node.attrs:
        return False
    a = node.attributes()
    return any(not _DROP_WORDS.isdisjoint(words) for words in _names(f"{a.get('class', '')} {a.get('id', '')}"))


def _articles(node: Node) -> list[Node]:
    """The outermost article elements that aren't dropped, else main elements, else the whole page."""

    def outermost(test) -> list[Node]:
        found, todo = [], [node]
        while todo:
            x = todo.pop()
            if x is not node and _dropped(x, False):
                continue
            if test(x):
                found.append(x)
            else:
                todo += [c for c in reversed(x.children) if isinstance(c, Node)]
        return found

    return outermost(lambda x: x.tag == "article") or outermost(lambda x: x.tag == "main" or 'role="main"' in x.attrs) or [node]


def _measure(root: Node) -> list[Node]:
    """Hash, text size and size within links of every subtree, children first; returns all nodes."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if isinstance(c, Node)]
    for x in reversed(order):
        h = xxhash.xxh3_64(x.tag)
        x.size = x.links = 0
        for c in x.children:
            if isinstance(c, Node):
                h.update(c.hash.to_bytes(8, "little"))
                x.size, x.links = x.size + c.size, x.links + c.links
            elif t := _SPACE.sub(" ", c).strip():
                h.update(t)
                x.size += len(t)
        if x.tag == "a":
            x.links = x.size
        x.hash = h.intdigest()
    return order


def _candidates(root: Node) -> tuple[list[Node], int]:
    """The subtrees that a template may have made, and a number that pages with one article share.

    That number is the hash of the articles, or of the whole page if there is none.
    """
    nodes, articles = _measure(root), _articles(root)
    if articles[0] is root:
        return [x for x in nodes if x is not root and x.size and x.tag in _CONTAINERS and x.tag != "span"], root.hash
    inside: dict[int, Node] = {id(a): a for a in articles}
    own = set(inside)
    for x in nodes:  # parents come before children
        if id(x) in inside:
            inside.update((id(c), inside[id(x)]) for c in x.children if isinstance(c, Node))
    def may(x: Node) -> bool:
        if id(x) not in inside:
            return True
        return id(x) not in own and 2 * x.size < inside[id(x)].size and (x.tag in _CONTAINERS and x.tag != "span" or _hinted(x))

    return [x for x in nodes if x is not root and x.size and may(x)], xxhash.xxh3_64_intdigest(b"".join(a.hash.to_bytes(8, "little") for a in articles))


def _amid(root: Node, gone: set[int]) -> set[int]:
    """Recurring subtrees of a page without an article that stand amid its own text, and all within them: they stay.

    The text's container is found by going down from the page as long as one container holds over half
    of what isn't recurring. In it, a recurring subtree between two neighbours that don't recur belongs to
    the text, unless its class or id hints at something else.
    """
    own: dict[int, int] = {}
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if isinstance(c, Node) and id(c) not in gone]
    for x in reversed(order):
        own[id(x)] = sum(own[id(c)] if isinstance(c, Node) else len(c.strip()) for c in x.children if not isinstance(c, Node) or id(c) in own)
    main = root
    while True:
        below = max((c for c in main.children if isinstance(c, Node) and c.tag in _CONTAINERS and id(c) in own), key=lambda c: own[id(c)], default=None)
        if below is None or 2 * own[id(below)] <= own[id(main)]:
            break
        main = below
    stay, todo = set(), [main]
    while todo:
        x = todo.pop()
        parts = [c for c in x.children if isinstance(c, Node) or c.strip()]
        for k, c in enumerate(parts):
            if not isinstance(c, Node):
                continue
            if id(c) not in gone:
                todo.append(c)
            elif 0 < k < len(parts) - 1 and id(parts[k - 1]) not in gone and id(parts[k + 1]) not in gone and not _hinted(c):
                within = [c]
                while within:
                    y = within.pop()
                    stay.add(id(y))
                    within += [z for z in y.children if isinstance(z, Node)]
    return stay


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _key(host: str, node_hash: int) -> int:
    return xxhash.xxh3_64_intdigest(host.encode() + node_hash.to_bytes(8, "little"))


def main_text(page: str, host: str = "", templates: np.ndarray | None = None) -> str:
    """The article's blocks, joined by two line feeds; ``templates`` has sorted keys of the host's templates."""
    root = parse(page)
    gone: set[int] = set()
    if templates is not None and len(templates):
        found, _ = _candidates(root)
        keys = np.array([_key(host, x.hash) for x in found], np.uint64)
        at = np.minimum(np.searchsorted(templates, keys), len(templates) - 1)
        gone = {id(x) for x, k in zip(found, templates[at] == keys, strict=True) if k}
        if gone and _articles(root)[0] is root:
            gone -= _amid(root, gone)
    blocks, text = [], []

    def flush() -> None:
        if t := _SPACE.sub(" ", "".join(text)).strip():
            blocks.append(t)
        text.clear()

    for article in _articles(root):
        flush()
        todo: list = [iter(article.children)]
        ends = [True]
        inside = article is not root
        while todo:
            x = next(todo[-1], None)
            if x is None:
                todo.pop()
                if ends.pop():
                    flush()
            elif isinstance(x, str):
                text.append(x)
            elif id(x) not in gone and not _dropped(x, inside):
                if x.tag == "br":
                    text.append(" ")
                block = x.tag in _BLOCK
                if block:
                    flush()
                todo.append(iter(x.children))
                ends.append(block)
    flush()
    return "\n\n".join(blocks)


def _hashes(batches):
    """Per page its host (key 0) and each distinct candidate subtree, with what tells its article from others."""
    free_others()
    for batch in batches:
        hosts, keys, articles = [], [], []
        for url, page in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            host = host_of(url)
            found, article = _candidates(parse(page))
            mine = {0} | {_key(host, x.hash) or 1 for x in found}
            hosts.append(np.full(len(mine), xxhash.xxh3_64_intdigest(host), np.uint64))
            keys.append(np.fromiter(mine, np.uint64, len(mine)))
            articles.append(np.full(len(mine), article, np.uint64))
        none = [np.zeros(0, np.uint64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or none).view(np.int64)) for c in (hosts, keys, articles)], names=["host", "key", "article"])


def _templates(counts: DataFrame) -> DataFrame:
    """Keys that recur on many pages of their host."""
    pages = counts.where("key = 0").select("host", F.col("n").alias("pages"))
    return counts.where(f"key <> 0 and n >= {LEAST_PAGES}").join(pages, "host").where("n * n >= pages").select("host", "key")


def _texts(templates):
    def texts(batches):
        free_others()
        for batch in batches:
            own = batch.column("_templates").to_pylist() if templates is None else None
            rows = zip(batch.column("url").to_pylist(), texts_of(batch.column("html")), strict=True)
            out = []
            for k, (url, page) in enumerate(rows):
                keys = templates.value if templates is not None else np.sort(np.array(own[k] or [], np.int64).view(np.uint64))
                out.append(main_text(page, host_of(url), keys))
            yield batch.drop_columns(["html", *(["_templates"] if templates is None else [])]).append_column("text", pa.array(out, pa.string()))

    return texts


def _page_keys(batches):
    """Each page's distinct candidate subtrees, by the page's digest."""
    free_others()
    for batch in batches:
        pages, keys = [], []
        for url, page, digest in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            mine = {_key(host_of(url), x.hash) or 1 for x in _candidates(parse(page))[0]}
            pages += [digest] * len(mine)
            keys.append(np.fromiter(mine, np.uint64, len(mine)))
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.string()), pa.array(np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64))], names=["_page", "key"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages(url, html, ...)`` -> all columns but ``html``, and ``text``, the page's main text.

    A null or empty page has an empty text. Hosts are taken from the urls; pages without one form a host
    of their own. Pages with one article (repeated ones among them) count once. Deeply nested, unclosed
    and very long pages are read whole. An empty table gives an empty result; a column ``text`` of the
    input is replaced, others stay as they are, whatever their names.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    counts = pages.select("url", "html").mapInArrow(_hashes, "host long, key long, article long").groupBy("host", "key").agg(F.count_distinct("article").alias("n"))
    counts = scratch.save(counts.where(f"key = 0 or n >= {LEAST_PAGES}"), "counts")
    templates = scratch.save(_templates(counts), "templates")
    columns = [c for c in pages.columns if c not in ("html", "text")]
    rows = apart(pages.select("html", *(F.col(f"`{c}`") for c in columns)), "url", "html")
    if templates.count() <= BROADCAST_HASHES:
        keys = np.array([r.key for r in templates.select("key").collect()], np.int64).view(np.uint64)
        texts = _texts(spark.sparkContext.broadcast(np.sort(keys)))
    else:
        # By key, not by host: a page gets the templates that are on it, and a large host is many keys. Equal pages share a digest.
        rows = rows.withColumn("_page", F.md5(F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit("")))))
        asked = rows.select("url", "html", "_page").mapInArrow(_page_keys, "_page string, key long").distinct()
        hits = asked.join(templates.select("key").distinct(), "key").groupBy("_page").agg(F.collect_list("key").alias("_templates"))
        rows = rows.join(hits, "_page", "left").drop("_page")
        texts = _texts(None)
    done = rows.mapInArrow(texts, with_fields(rows.drop("html", "_templates").schema, text=StringType()))
    return done.select(*(F.col(c) if c == "url" else F.col(f"row.`{c}`") for c in columns), "text")
