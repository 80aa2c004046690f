"""HTML main-text extraction with site style trees.

Pages of one host are merged into a style tree: a node is a path of elements (tag and class or id) from the
root.  Each page contributes to a node its presentation (the sequence of the node's child elements, runs
of equal ones taken as one) and its content (the text blocks right under it).  Over the m pages that have
the node, with c pages for a presentation or a block,
  importance by presentation = - sum p * log_m p, with p = c / m for each presentation,
  importance by content = 1 - mean of log_m c over the distinct blocks,
and both are 1 if m = 1.  Copies of a page (equal html) on one host count once.  The counts are partial aggregations, so that a host with a third of all pages
is no larger a task than another.  Only nodes with an importance below 1 are kept.  A host with at most MAP_NODES of them
has them in one row, joined to its pages; pages of other hosts are joined to the nodes that they hold themselves, so that no row grows with a host.

In the second pass each page's branches get a composite importance, (1 - G^l) * own + G^l * mean of the
children's, l their number; a branch goes if it and all within it are below LEAST.  Elements whose tag, role, class or id says what they are weigh in as
prior: menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader comments have
importance 0 (a form that holds half of the page's words or more is a wrapper, and none); an article (or `main`) has 1, and the rest of such a page has 0, as the article is what is asked for.
What an article holds inherits its 1 as a prior that only the tree's own evidence outweighs: nodes that MANY
distinct pages have count with their importance, and a branch goes if its composite and all within are below INSIDE.
An article of which nothing would be left stays whole.  Class and id names count as whole tokens.  Those of adverts and comments give
0; other telling names only weaken a branch: its importance times w / (w + WEAK_WORDS), with w words, has to
reach LEAST.  No branch that holds an article is left out.

Character references are decoded, white space within a block becomes one space, blocks are joined
by a line feed.  A header within an article stays if it holds the heading.  Unclosed and
misnested tags end with the element around them; scripts and styles run to their own end tags.  A quoted value
that isn't closed ends with its tag.
A null page is empty text, a page without markup is one block.  Equal rows give equal results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .steps import stored
from .url_cascade import host_and_path

GAMMA = 0.9
LEAST = 0.35
INSIDE = 0.1  #: LEAST within an article
MANY = 5  #: pages
MAP_NODES = 500  #: of a host, in one row

#: What tags and names mean.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("script style template noscript iframe object svg math canvas audio video textarea select button head title".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav footer aside menu dialog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar side aside widget widgets related recommended recommendations share sharing social footer comment comments respond replies disqus form search skip toolbar masthead topbar header".split()
)
SPECIAL = frozenset({"article", "main"})
CLOSED_BY = {"p": BLOCKS - {"html", "body", "head"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option", "optgroup"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")  # each name with its value, in order
ADVERT_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored comment comments respond replies disqus".split())
WEAK = 0.5  #: prior of a name that may also be an article's; the branch's importance and words decide
WEAK_WORDS = 20
FORM = 0.25  #: prior of a form, which is left out unless it is wrapped around the page
FORM_SHARE = 0.5  #: of the page's words, from which on it is


class Node:
    """An element of a page: children are nodes and, as strings, blocks of text.  path is a 64-bit code of the elements
    from the root down to it, so that deep nesting costs no more than flat pages."""

    __slots__ = ("tag", "name", "path", "kids", "prior")

    def __init__(self, tag: str, name: str, path: int, prior: float | None):
        self.tag, self.name, self.path, self.prior, self.kids = tag, name, path, prior, []


def _prior(tag: str, attributes: str) -> tuple[str, float | None]:
    """(name, importance that the element's kind gives it) of an element."""
    names, prior = [], None
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role":
            prior = 0.0 if value in NOISE_ROLES else 1.0 if value in ("main", "article") else prior
        elif key == "hidden":
            prior = 0.0
        elif key in ("class", "id"):
            names.append(value)
    if tag in NOISE_TAGS or tag == "header":
        prior = 0.0
    elif tag in SPECIAL:
        prior = 1.0
    elif tag == "form" and prior is None:
        prior = FORM
    elif prior is None and names and tag not in ("html", "body"):
        tokens = set(" ".join(names).split())
        prior = 0.0 if tokens & ADVERT_NAMES else WEAK if tokens & NOISE_NAMES else None
    return ".".join(" ".join(names).split()), prior


def parse(page: str) -> Node:
    """The page's tree of block elements."""
    root = Node("", "", 0, None)
    stack, words = [root], []
    unclosed: set[str] = set()  # tags that don't end any more, so that a page is searched for each of them once
    at = 0

    def flush():
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text:
                stack[-1].kids.append(text)

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            words.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in BLOCKS:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    flush()
                    del stack[k:]
                    break
                if stack[k].tag in SPECIAL and tag not in ("body", "html", "main"):
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag not in SKIPPED:
                words.append(page[m.end() : end.start() if end else len(page)])
            continue
        if tag == "br":
            words.append(" ")
        elif tag in SKIPPED and tag not in VOID:
            if tag in ("head",):
                continue
            end = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else at
            if not end:
                unclosed.add(tag)
        elif tag in BLOCKS:
            flush()
            while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
                stack.pop()
            if tag in VOID:
                continue
            name, prior = _prior(tag, m[3])
            node = Node(tag, name, code(f"{stack[-1].path}/{tag}.{name}"), prior)
            stack[-1].kids.append(node)
            stack.append(node)
    flush()
    return root


def _walk(node: Node):
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += [k for k in n.kids if isinstance(k, Node)]


def code(text: str) -> int:
    """A signed 64-bit code of a string."""
    got = xxhash.xxh64_intdigest(text.encode(errors="surrogatepass"))
    return got - (1 << 64) if got >> 63 else got


def page_features(page: str) -> set[tuple[int, str, int]]:
    """(path, kind, value's code): kind p for a presentation, c for a block of content; each once a page."""
    out = set()
    for n in _walk(parse(page)):
        last, parts = None, []
        for k in n.kids:
            name = f"{k.tag}.{k.name}" if isinstance(k, Node) else "#"
            if name != last:
                parts.append(name)
            last = name
        out.add((n.path, "p", code(" ".join(parts))))
        out.update((n.path, "c", code(k)) for k in n.kids if isinstance(k, str))
    return out


def _features(batches):
    for batch in batches:
        hosts, paths, kinds, values, copies = [], [], [], [], []
        for host, page, same in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "page")), strict=True):
            for path, kind, value in page_features(page or ""):
                hosts.append(host)
                paths.append(path)
                kinds.append(kind)
                values.append(value)
                copies.append(same)
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.int64()), pa.array(copies, pa.int64())], names=["host", "node", "kind", "value", "page"])


def _feature_rows(pages: DataFrame) -> DataFrame:
    """(host, node, kind, value, page: the html's code) from pages(host, html)."""
    keyed = pages.select("host", "html", F.xxhash64(F.coalesce("html", F.lit(""))).alias("page"))
    return keyed.mapInArrow(_features, "host string, node long, kind string, value long, page long")


def node_importances(pages: DataFrame) -> DataFrame:
    """(host, node, importance, often: on MANY pages) from pages(host, html); nodes with importance 1 are left out."""
    rows = _feature_rows(pages).distinct()
    counts = rows.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"))
    # every page has one presentation of each of its nodes: their counts add up to m
    sums = counts.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == "p", F.col("c"))).alias("m"),
        F.sum(F.when(F.col("kind") == "p", F.col("c") * F.log("c"))).alias("presentation"),
        F.avg(F.when(F.col("kind") == "c", F.log("c"))).alias("content"),
    )
    log_m = F.log(F.col("m").cast("double"))
    shown = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("presentation") / F.col("m") / log_m)  # - sum p log_m p
    told = F.lit(1.0) - F.col("content") / log_m
    importance = F.when(F.col("m") <= 1, 1.0).otherwise(F.coalesce(told, shown))
    return sums.select("host", "node", importance.alias("importance"), (F.col("m") >= MANY).alias("often")).filter("importance < 0.999")


def _gathered(known: DataFrame, *keys: str) -> DataFrame:
    """(keys, nodes: map of a path's code to its importance, many: those on MANY pages)."""
    nodes = F.map_from_entries(F.collect_list(F.struct("node", "importance"))).alias("nodes")
    return known.groupBy(*keys).agg(nodes, F.collect_list(F.when(F.col("often"), F.col("node"))).alias("many"))


def site_trees(pages: DataFrame) -> DataFrame:
    """(host, nodes, many) from pages(host, html), a row per host."""
    return _gathered(node_importances(pages), "host")


def composite(node: Node, own: dict[int, float]) -> dict[int, float]:
    """Composite importance of each node of a page, by id(), children before parents."""
    out: dict[int, float] = {}
    for n in reversed(list(_walk(node))):
        below = [out[id(k)] for k in n.kids if isinstance(k, Node)]
        weight = GAMMA ** len(below)
        mine = own.get(n.path, 1.0)
        out[id(n)] = (1 - weight) * mine + weight * (sum(below) / len(below)) if below else mine
    return out


def _has_heading(node: Node) -> bool:
    return any(n.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for n in _walk(node))


def _alive(root: Node, score: dict[int, float], least: float) -> dict[int, bool]:
    """Whether a branch stays, by id(): it goes if nothing in it is important."""
    alive: dict[int, bool] = {}
    for n in reversed(list(_walk(root))):
        alive[id(n)] = score[id(n)] >= least or any(alive[id(k)] for k in n.kids if isinstance(k, Node))
    return alive


def main_blocks(page: str, own: dict[int, float], many: Iterable[int] = ()) -> list[str]:
    """The blocks of the branches that stay, in page order; own: importance of paths of the page's host, many: those
    of them that also decide within an article."""
    root = parse(page)
    score = composite(root, own)
    alive = _alive(root, score, LEAST)
    known = {p: own[p] for p in many}
    alive_inside = _alive(root, composite(root, known), INSIDE)
    holds: dict[int, bool] = {}  # a landmark, at or below the node
    words: dict[int, int] = {}
    for n in reversed(list(_walk(root))):
        holds[id(n)] = n.prior == 1.0 or any(holds[id(k)] for k in n.kids if isinstance(k, Node))
        words[id(n)] = sum(words[id(k)] if isinstance(k, Node) else len(k.split()) for k in n.kids)
    landmark = holds[id(root)]
    out: list[str] = []
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        n, inside = todo.pop()
        if isinstance(n, str):
            if inside or not landmark:
                out.append(n)
            continue
        heading = inside and (n.tag == "header" or n.prior == WEAK) and _has_heading(n)
        if n.prior == 0.0 and not holds[id(n)] and not heading:
            continue
        if n.prior == FORM and not holds[id(n)] and words[id(n)] < FORM_SHARE * words[id(root)]:
            continue
        weighed = score[id(n)] * words[id(n)] / (words[id(n)] + WEAK_WORDS)
        if n.prior == WEAK and not holds[id(n)] and not heading and weighed < LEAST:
            continue
        inside = inside or n.prior == 1.0
        if not landmark and n.path and not alive[id(n)]:
            continue
        if inside and not holds[id(n)] and not alive_inside[id(n)]:
            continue
        todo += [(k, inside) for k in reversed(n.kids)]
    return main_blocks(page, own) if landmark and known and not out else out


def _extract(batches):
    """Joined rows (row with html, nodes, many) to (row, main text)."""
    for batch in batches:
        rows = batch.column("row")
        pages, nodes, many = rows.field("html").to_pylist(), batch.column("nodes").to_pylist(), batch.column("many").to_pylist()
        texts = ["\n".join(main_blocks(page or "", dict(own or ()), often or ())) for page, own, often in zip(pages, nodes, many, strict=True)]
        yield pa.record_batch([rows, pa.array(texts, pa.string())], names=["row", "text"])


def main_texts(pages: DataFrame, map_nodes: int = MAP_NODES) -> DataFrame:
    """The pages (page_id, url, html and whatever else, of any name) with text; a column of this name is replaced.
    map_nodes changes how importances come to the pages, not the texts."""
    host, _ = host_and_path(F.col("url"))
    names = [f"`{c}`" for c in pages.columns if c != "text"]
    rows = pages.select(F.struct(*names).alias("row"), host.alias("host"))  # so that no name can clash
    # written first: a small table is then broadcast by its true size, and with a large one both sides of the join are
    # shuffled for it, so that Spark can split a host with very many pages
    known = stored(node_importances(rows.select("host", "row.html")), "importances")
    large = stored(known.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > map_nodes).select("host"), "large")
    trees = stored(_gathered(known.join(large, "host", "left_anti"), "host"), "trees")
    if large.isEmpty():
        joined = rows.join(trees, "host", "left").select("row", "nodes", "many")
    else:
        joined = rows.join(large, "host", "left_anti").join(trees, "host", "left").select("row", "nodes", "many")
        rest = rows.join(large, "host", "left_semi").withColumn("page", F.xxhash64(F.coalesce("row.html", F.lit(""))))
        held = _feature_rows(rest.select("host", "row.html")).filter("kind = 'p'").select("host", "page", "node").distinct()
        own = _gathered(held.join(known, ["host", "node"]), "host", "page")
        joined = joined.union(rest.join(own, ["host", "page"], "left").select("row", "nodes", "many"))
    out = joined.mapInArrow(_extract, StructType([joined.schema["row"], StructField("text", StringType())]))
    return out.select(*(F.col(f"row.{c}") for c in names), "text")


def page_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return main_texts(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
