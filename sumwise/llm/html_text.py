"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of containers.  A node is a path of tags, classes
and ids (digits made equal).  Over the pages that have a node, two entropies say how far it
varies: of its presentation (the row of its children) and of its content (its text), each
divided by the logarithm of the number of pages.  A branch matters if either varies:

    importance = prior * (1 - (1 - presentation) * (1 - content))

The prior is what tags, classes, ids and roles say themselves.  Tags of menus, headers, footers,
sidebars and forms, and names that are as a whole one of OWN (adverts, readers' comments), have
one so low that no entropy lifts them over the threshold: their text varies like that of an
article.  An `article` or `main` is never removed, and what stands beside it is.  A name that
holds a word of NOISE_NAMES or HEADERS only lowers the prior, and the tree decides:

- inside an `article` such a container stays unless the host repeats it; a `section`, whose id
  is its heading, is not lowered at all, unless it holds articles of its own (comments);
- elsewhere it stays if the host shows that it varies, and goes where the tree cannot tell;
- the container with more than half of the page's text (a wrapper, also a `form`) is not lowered
  on a page without `article` and `main`.

Everything else depends on the tree.  A node on fewer than FEW_PAGES pages counts as varying.
Paragraphs, headings and other leaves are never removed by themselves, so passages that many
pages share stay.

The text of a page are its remaining blocks in order, character references decoded, white
space made one space, joined by two line feeds.

Counts are combined before each shuffle; a hot host gives one row per distinct page and node,
dealt by page.  The
branches to remove are broadcast up to BROADCAST_BYTES, and joined by host beyond.

Pages of a host whose blocks and places are all equal (mirrors, repeated rows, pages that differ
in scripts only) count once in the entropies, so copies never make a branch look constant.

Edge cases: a null or empty page has an empty text.  Pages cut off anywhere are read to their
end; an unfinished tag ends the page.  A null URL, or one without `://`, has no host: such pages
are no site, and no tree is made of them.  An empty table gives an empty result, further
columns are ignored.  Pages are read whole.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import stored
from sumwise.llm.common import slices
from sumwise.llm.url_filter import host_and_path

THRESHOLD = 0.3
FEW_PAGES = 5
NOISE, BESIDE, NAMED, MARKED, PLAIN, INSIDE, CONTENT = 0.2, 0.25, 0.4, 0.5, 0.6, 0.9, 1.0
#: What the tree decides about; a node's place in the lists of a host is its path with these bits.
CODES = {NAMED: 1, MARKED: 2, PLAIN: 4, INSIDE: 8}
BROADCAST_BYTES = 4 << 20

#: A quote counts only right after the sign of its attribute; elsewhere it is a letter like others.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Their content is never text of the page.
RAW = frozenset("script style noscript template textarea iframe object svg math select title".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture
    q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption pre blockquote figcaption summary".split())
#: What a start tag ends if it is still open.
ENDS = {t: frozenset({t}) for t in ("li", "tr", "option")} | {t: frozenset({"dt", "dd"}) for t in ("dt", "dd")}
ENDS |= {t: frozenset({"td", "th"}) for t in ("td", "th")}
NOISE_TAGS = frozenset("nav footer aside form button menu dialog head input fieldset".split())
NOISE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo
    cookie cookies discussion disclaimer footer gdpr login menu modal nav navbar navigation newsletter notice notices
    popup promo related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe
    toolbar widget widgets complementary""".split()
)
#: Noise as a whole class, id or role, whatever varies.
OWN = frozenset("ad ads advert adverts advertisement advertising comments sponsored".split())
HEADERS = frozenset("header masthead topbar".split())
MAIN = frozenset(("article", "main"))


def hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


class Node:
    __slots__ = ("tag", "names", "tokens", "path", "prior", "parent", "children", "content", "size")

    def __init__(self, tag: str, names: set[str], tokens: set[str], shown: str, parent: Node | None):
        self.tag, self.names, self.tokens, self.parent = tag, names, tokens, parent
        self.path = hash64(f"{parent.path}/{shown}" if parent else shown)
        self.children: list[Node] = []
        self.prior = PLAIN
        self.content = False  # is or holds the page's own article
        self.size = 0  # characters in it and below, without noise by tag
        if parent:
            parent.children.append(self)


def tree(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The containers of a page and its blocks of text, each with the container it stands in."""
    root = Node("html", set(), set(), "html", None)
    open_nodes, leaf_tags = [root], [[]]
    blocks: list[tuple[Node, str]] = []
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append((open_nodes[-1], text))

    while True:
        found = TAG.search(page, at)
        # A character reference does not reach over a tag.
        parts.append(html_module.unescape(page[at : found.start()] if found else page[at:]))
        if not found:
            break
        at = found.end()
        closing, tag, rest = found[1], found[2], found[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE or tag in VOID and tag != "hr":
            if tag == "br":
                parts.append(" ")
            continue
        # A slash at the end of a start tag closes foreign elements only.
        if tag in ("svg", "math") and rest.endswith("/"):
            continue
        flush()
        if closing:
            if tag in leaf_tags[-1]:
                del leaf_tags[-1][len(leaf_tags[-1]) - 1 - leaf_tags[-1][::-1].index(tag) :]
            elif tag not in LEAVES:
                for k in range(len(open_nodes) - 1, 0, -1):
                    if open_nodes[k].tag == tag:
                        del open_nodes[k:], leaf_tags[k:]
                        break
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag in VOID or tag in ("html", "body"):
            continue
        if tag in LEAVES:
            ends = ENDS.get(tag, ())
            leaves = leaf_tags[-1]
            while leaves and (leaves[-1] == "p" or leaves[-1] in ends):
                leaves.pop()
            leaves.append(tag)
            continue
        said = [m.strip("\"'").lower() for m in NAMES.findall(rest)]
        names = {n for s in said for n in re.split(r"[^a-z0-9]+", s)}
        shown = re.sub(r"\d+", "0", ".".join([tag, *said]))
        node = Node(tag, names, {n for s in said for n in s.split()}, shown, open_nodes[-1])
        open_nodes.append(node)
        leaf_tags.append([])
    flush()
    for node, text in blocks:
        node.size += len(text)
    weigh(root)
    return root, blocks


def below(root: Node) -> list[Node]:
    """The nodes of a tree, parents first."""
    nodes = [root]
    for node in nodes:
        nodes += node.children
    return nodes


def weigh(root: Node) -> None:
    """Sets the priors: what holds an article is no noise by name; what stands beside one is."""
    nodes = below(root)
    for node in reversed(nodes):
        if node.parent and (node.tag == "form" or node.tag not in NOISE_TAGS):
            node.parent.size += node.size
    open_nodes = [root]
    while open_nodes:
        node = open_nodes.pop()
        if node.tag in MAIN:
            while node and not node.content:
                node.content, node = True, node.parent
        elif node.tag == "form" or node.tag not in NOISE_TAGS:
            open_nodes += node.children
    nested = set()  # holds an article
    for node in reversed(nodes):
        if node.parent and (node.tag == "article" or node in nested):
            nested.add(node.parent)
    articles = set()  # is or stands in an article
    for parent in nodes:
        if parent.tag == "article" or parent.parent in articles:
            articles.add(parent)
        inside = parent.prior in (CONTENT, INSIDE, MARKED)
        beside = not inside and (parent.content or parent.prior == BESIDE)
        for node in parent.children:
            wrapper = 2 * node.size > root.size and not root.content
            named = bool(node.names & NOISE_NAMES)
            if node.content:
                node.prior = CONTENT if node.tag in MAIN else PLAIN
            elif parent.prior == NOISE or node.tag in NOISE_TAGS and not (node.tag == "form" and wrapper):
                node.prior = NOISE
            elif parent in articles:
                section = node.tag == "section" or "section" in node.tokens
                if named and node in nested or node.tokens & OWN and not section:
                    node.prior = NOISE
                else:
                    node.prior = MARKED if named and not section else INSIDE
            elif wrapper:
                node.prior = PLAIN
            elif beside:
                node.prior = NOISE if named else BESIDE
            elif node.tokens & OWN:
                node.prior = NOISE
            elif named or not inside and node.names & HEADERS:
                node.prior = NAMED
            elif inside:
                node.prior = INSIDE
            elif node.tag in HEADERS:
                node.prior = NOISE


def style_rows(page: str) -> list[tuple[int, int, float, int, int]]:
    """(page, path, prior, presentation, content) of the containers for which the tree decides."""
    root, blocks = tree(page)
    whole = hash64("\n".join(f"{node.path} {text}" for node, text in blocks))
    texts: dict[Node, list[str]] = {}
    for node, text in blocks:
        while node:
            texts.setdefault(node, []).append(text)
            node = node.parent
    shapes: dict[tuple[int, float], list[str]] = {}
    contents: dict[tuple[int, float], list[str]] = {}
    open_nodes = [root]
    while open_nodes:
        node = open_nodes.pop()
        open_nodes += node.children
        if node.parent and THRESHOLD <= node.prior < CONTENT and node in texts:
            key = (node.path, node.prior)
            shapes.setdefault(key, []).append(f"{len(texts[node])}:{','.join(str(c.path) for c in node.children)}")
            contents.setdefault(key, []).extend(texts[node])
    return [(whole, *k, hash64(";".join(v)), hash64("\n".join(contents[k]))) for k, v in shapes.items()]


def stays(node: Node, low: frozenset[int]) -> bool:
    if node.prior < THRESHOLD or node.prior == CONTENT:
        return node.prior == CONTENT
    return (node.path ^ CODES[node.prior] in low) == (node.prior == NAMED)


def main_text(page: str | None, low: frozenset[int]) -> str:
    """The blocks that stand in no noise; `low` are the nodes of the host that the tree finds to be
    other than their prior says: repeated, or varying where it is NAMED."""
    _, blocks = tree(page or "")
    kept = []
    for node, text in blocks:
        if node.content and node.prior < CONTENT:
            continue  # beside the article
        above = node
        while above and stays(above, low):
            above = above.parent
        if above is None:
            kept.append(text)
    return "\n\n".join(kept)


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, low): the nodes whose importance stays below the threshold or, where NAMED, is known
    to reach it; for hosts that have some."""

    def styled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            hosts, found = [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                rows = style_rows(page or "")
                hosts += [host] * len(rows)
                found += rows
            columns = list(zip(*found)) or [[], [], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["host", "page", "path", "prior", "shape", "content"],
            )

    sites = pages.where(F.col("host") != "")
    rows = sites.mapInArrow(styled, "host string, page long, path long, prior double, shape long, content long").distinct()
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(("shape", "content"))])
    values = rows.select("host", "path", "prior", F.inline(both))
    n = F.col("n")
    code = F.coalesce(*[F.when(F.col("prior") == p, F.lit(k)) for p, k in CODES.items()])
    nodes = (
        values.groupBy("host", "path", "kind", "value")
        .agg(F.count("*").alias("n"), F.bit_or(code).alias("codes"))
        .groupBy("host", "path", "kind")
        .agg(F.sum("n").alias("m"), F.sum(n * F.ln(n)).alias("s"), F.bit_or("codes").alias("codes"))
        .withColumn("varies", F.when(F.col("m") < FEW_PAGES, 1.0).otherwise(1 - F.col("s") / F.col("m") / F.ln("m")))
    )
    branch = nodes.groupBy("host", "path").agg(
        F.min(F.when(F.col("kind") == 0, F.col("varies"))).alias("shape"), F.min(F.when(F.col("kind") == 1, F.col("varies"))).alias("content"),
        F.max("m").alias("m"), F.bit_or("codes").alias("codes"),
    )
    either = 1 - (1 - F.col("shape")) * (1 - F.col("content"))

    def told(prior: float, code: int) -> Column:
        tells = (F.col("m") >= FEW_PAGES) & (prior * either >= THRESHOLD) if prior == NAMED else prior * either < THRESHOLD
        return F.when((F.col("codes").bitwiseAND(code) != 0) & tells, F.col("path").bitwiseXOR(F.lit(code).cast("long")))

    low = branch.select("host", F.explode(F.array(*[told(p, k) for p, k in CODES.items()])).alias("path")).where("path IS NOT NULL")
    return low.groupBy("host").agg(F.collect_set("path").alias("low"))


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`id`, `url`, text and n_chars (code points) of every page."""
    kind = pages.schema[id].dataType.simpleString()
    host, _ = host_and_path(F.col(url).cast("string"))
    rows = pages.select(
        F.col(id).alias("id"), F.col(url).cast("string").alias("url"), host.alias("host"), F.col(html).cast("string").alias("html")
    )
    low = stored(low_branches(rows.select("host", "html")))
    size = low.agg(F.sum(8 * F.size("low") + F.length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        low = F.broadcast(low)
    joined = rows.join(low, "host", "left").select("id", "url", "html", "low")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            texts = [
                main_text(page, frozenset(paths or ())) for page, paths in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    found = joined.mapInArrow(extracted, f"id {kind}, url string, text string, n_chars long")
    return found.select(F.col("id").alias(id), F.col("url").alias(url), "text", "n_chars")
