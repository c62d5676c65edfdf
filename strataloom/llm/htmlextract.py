"""Main text of web pages by wrapper induction.

Pages of a host are parsed; each belongs to two groups, that of its layout and that of its kind of slot (articles,
main part or body). A group's reference pages are the REFERENCES first ones by hash. Every page's slot is aligned
with those of its references by simple tree matching (see treematch), and the reference's text nodes are counted
over all distinct pages of the group: those that nearly all pages have alike, there, are constant and become the
template; what varies is content. A page's text is its slot without what the alignment pairs with a constant node,
and without the parts that are never content (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments). Pages in groups with too few pages have these rules alone.

Inside an article or main part a name is weaker evidence, since texts name their parts too (share-price, menu-review,
ad-hoc). There a part goes by its tag, by a name that is firm, or by another of these names if most of its text is in
links; without, its text stays but for what the wrapper finds to be template.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keyed import split_join
from .shared import bounded_batches, stored
from .treematch import Match, Tree
from .urlfilter import url_host

#: Distinct pages that a template needs, and the share of them that has each of its nodes.
LEAST_PAGES, CONSTANT_SHARE = 3, 0.9
#: Pages of a group that its other pages are aligned with. Counts rest on all pages; a constant node is missed only
#: if none of these has it.
REFERENCES = 2
#: Templates are dropped where they hold at most this share of the pages' text: in articles and main parts, and in bodies.
TEMPLATE_SHARE, BODY_SHARE = 0.3, 0.5
#: Bytes of all references or templates up to which they are broadcast; beyond, pages meet them in a split join.
BROADCAST_BYTES = 32_000_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES = {  # a start tag ends these open elements
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
NEVER = frozenset("head nav footer aside form script style noscript iframe template button select textarea input svg canvas object embed audio video menu dialog title".split())
#: Words of class, id and role that mark parts which are not content, as a whole name or as its first or last part.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent notice notices popup modal promo promotion sponsor sponsored social share sharing related comment comments respond "
    "disqus newsletter subscribe signup login pagination pager widget toolbar complementary contentinfo".split()
)
#: Of these, words that may just as well be a text's subject: a name with them is never firm.
SUBJECTS = frozenset("menu nav navigation share sharing social related".split())
#: A name is firm if it ends with one of the other words, or begins with one and goes on with these (or numbers) only.
STRUCTURE = frozenset("area author bar block body box container content form group header inner item items link links list meta message panel replies reply section slot text thread title unit wrap wrapper".split())
#: Share of a part's text that is in links from which on a name that is not firm counts.
LINK_SHARE = 0.5
#: Names with one of these parts tell what a part has or is in (has-sidebar, comments-open), not what it is.
STATES = frozenset("has have no with without is are not open closed enabled disabled on off in".split())
#: Of paragraphs and headings only these names count: others are used for the text's own style.
OWN_WORDS = frozenset("ad ads advert adverts advertisement advertising cookie cookies consent comment comments sponsored breadcrumb breadcrumbs pagination".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong code figure figcaption".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|"
    # a quoted value ends where a quote stands before white space or the tag's end; other quotes are plain characters
    r"<([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"(?=[\s/>]|$)|'[^']*'(?=[\s/>]|$)|[\"'])*)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[-_]+")
_NUMBER = re.compile(r"\d+")
#: Tags whose kinds tell one layout from another.
FRAME = frozenset("article aside body center div footer header main nav section table tbody tr td".split())
ARTICLE, MAIN, BODY = 0, 1, 2


class Node:
    __slots__ = ("tag", "mark", "children", "kind", "holds")

    def __init__(self, tag: str, mark: str = "") -> None:
        self.tag, self.mark, self.children = tag, mark, []
        self.kind = f"{tag}.{_NUMBER.sub('0', mark)}" if mark else tag  # ids often hold a page's number
        self.holds = False  # an article or main part is somewhere below


class _Open:
    """The open elements, with what is needed to find one without looking through all of them."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.count, self.blocks = [root], Counter(), []

    def push(self, node: Node) -> None:
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.count[node.tag] += 1

    def cut(self, k: int) -> None:
        """Close the k-th element and all within it."""
        for node in self.nodes[k:]:
            self.count[node.tag] -= 1
        del self.nodes[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def last(self, tags: frozenset[str] | set[str], stop: set[str] = frozenset()) -> int | None:
        """The innermost open element of one of the tags, inside the innermost one of `stop`."""
        if any(self.count[t] for t in tags):
            for k in range(len(self.nodes) - 1, 0, -1):
                if self.nodes[k].tag in tags:
                    return k
                if self.nodes[k].tag in stop:
                    return None
        return None


def parse(html: str) -> Node:
    """A forgiving tree: unclosed elements end with their parents, stray end tags are skipped."""
    root = Node("#root")
    opened, at, n = _Open(root), 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            opened.nodes[-1].children.append(html[at:])
            break
        if m.start() > at:
            opened.nodes[-1].children.append(html[at : m.start()])
        at = m.end()
        if m[1]:
            k = opened.last({m[1].lower()})
            if k is not None:
                opened.cut(k)
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCK and opened.blocks and opened.nodes[opened.blocks[-1]].tag == "p":
            opened.cut(opened.blocks[-1])  # a block ends an open paragraph
        if tag in CLOSES:
            while (k := opened.last(CLOSES[tag], SCOPES[tag])) is not None:
                opened.cut(k)
        rest = m[3]
        mark = " ".join(a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(rest)).lower() if "=" in rest else ""
        node = Node(tag, mark)
        opened.nodes[-1].children.append(node)
        if tag in ("article", "main") or "main" in mark.split():
            for up in reversed(opened.nodes):
                if up.holds:
                    break
                up.holds = True
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|$)[^>]*>?", re.I).search(html, at)
            node.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not rest.rstrip().endswith("/"):
            opened.push(node)
    return root


def marked(node: Node) -> bool:
    """Whether a class, id or role names the node a part that is not content."""
    words = OWN_WORDS if node.tag in PARAGRAPHS else MARKS
    for name in node.mark.split():
        parts = [x for x in _PART.split(name) if x]
        if parts and (parts[0] in words or parts[-1] in words) and STATES.isdisjoint(parts):
            return True
    return False


def firm(node: Node) -> bool:
    """Whether one of the node's names can hardly be that of a part of a text."""
    words = (OWN_WORDS if node.tag in PARAGRAPHS else MARKS) - SUBJECTS
    for name in node.mark.split():
        parts = [x for x in _PART.split(name) if x]
        if parts and STATES.isdisjoint(parts):
            if parts[-1] in words or (parts[0] in words and all(x in words or x in STRUCTURE or x[0].isdigit() for x in parts[1:])):
                return True
    return False


class LinkShares:
    """Characters of parts, and those in links; every node of a page is measured once."""

    def __init__(self) -> None:
        self.known: dict[int, tuple[int, int]] = {}

    def mostly_links(self, node: Node) -> bool:
        if id(node) not in self.known:
            self._measure(node)
        chars, linked = self.known[id(node)]
        return linked >= LINK_SHARE * chars

    def _measure(self, top: Node) -> None:
        order = [top]
        for n in order:  # parents before children
            order += [c for c in n.children if isinstance(c, Node) and c.tag not in NEVER]
        for n in reversed(order):
            chars = sum(len(_clean(c)) for c in n.children if isinstance(c, str))
            below = [self.known[id(c)] for c in n.children if isinstance(c, Node) and c.tag not in NEVER]
            chars += sum(x for x, _ in below)
            self.known[id(n)] = (chars, chars if n.tag == "a" else sum(x for _, x in below))


def never_content(node: Node, inside: bool = False, lenient: bool = False) -> bool:
    """Whether a part is no content; a header is the page's unless it is inside an article or main part.

    Names of html, body, article and main do not count; in lenient reading neither do those of parts that hold an
    article or main part.
    """
    if node.tag in NEVER or (node.tag == "header" and not inside):
        return True
    return bool(node.mark) and node.tag not in ("html", "body", "article", "main") and not (lenient and node.holds) and marked(node)


def _clean(text: str) -> str:
    return " ".join(unescape(text).split())


def _key(*parts: str | int) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _slots(root: Node) -> tuple[int, list[Node], str]:
    """The rank, the outermost articles, else main parts, else the body, else all; and the layout.

    A main part that holds several articles, all that there are, is the slot as a whole: what stands between them belongs to them.
    """
    for lenient in (False, True):
        found: list[list[tuple[Node, tuple]]] = [[], [], []]
        stack: list[tuple[Node, tuple, frozenset[int]]] = [(root, (), frozenset())]  # with the line of nodes above, and their ranks
        while stack:
            n, line, within = stack.pop()
            rank = ARTICLE if n.tag == "article" else MAIN if n.tag == "main" or "main" in n.mark.split() else BODY if n.tag == "body" else None
            if rank is not None and rank not in within:
                found[rank].append((n, line))
                within |= {rank}
            stack += [(c, (line, n), within) for c in reversed(n.children) if isinstance(c, Node) and not never_content(c, lenient=lenient)]
        if found[ARTICLE] or found[MAIN] or not root.holds:
            break
    rank = next((r for r in (ARTICLE, MAIN) if found[r]), BODY)
    if rank == ARTICLE and len(found[ARTICLE]) > 1 and len(found[MAIN]) == 1:
        inside = 0
        for _, line in found[ARTICLE]:
            while line and line[1] is not found[MAIN][0][0]:
                line = line[0]
            inside += bool(line)
        if inside == len(found[ARTICLE]):
            rank = MAIN
    slots = found[rank] if rank < BODY else found[BODY][:1] or [(root, ())]
    first, line = slots[0]
    frame = [first]
    while line:
        line, up = line
        frame.append(up)
    layout = "\x01".join(f"{n.kind}:{','.join(sorted({c.kind for c in n.children if isinstance(c, Node) and c.tag in FRAME}))}" for n in frame)
    return rank, [n for n, _ in slots], layout


class Page:
    """A page's slot: rank, layout, text pieces in page order (None where a block begins or ends), and its pruned tree.

    pieces has (raw text, number of its text node or 0).
    """

    def __init__(self, html: str) -> None:
        self.rank, slots, self.layout = _slots(parse(html))
        self.pieces: list[tuple[str | None, int]] = []
        links = LinkShares()
        labels, parents, texts = ["#slots"], [-1], [0]
        for slot in slots:
            labels.append(slot.tag)
            parents.append(0)
            texts.append(0)
            stack = [(iter(slot.children), len(labels) - 1, True, slot.tag in ("article", "main"))]
            while stack:
                children, number, block, inside = stack[-1]
                for c in children:
                    if isinstance(c, str):
                        if c.strip():
                            labels.append("#")
                            parents.append(number)
                            texts.append(_key(_clean(c)) or 1)
                            self.pieces.append((c, len(labels) - 1))
                        else:
                            self.pieces.append((c, 0))
                    elif c.tag == "br":
                        self.pieces.append((" ", 0))
                    elif not never_content(c, inside) or (inside and c.tag not in NEVER and not firm(c) and not links.mostly_links(c)):
                        labels.append(c.tag)
                        parents.append(number)
                        texts.append(0)
                        if c.tag in BLOCK:
                            self.pieces.append((None, 0))
                        stack.append((iter(c.children), len(labels) - 1, c.tag in BLOCK, inside or c.tag in ("article", "main")))
                        break
                else:
                    stack.pop()
                    if block:
                        self.pieces.append((None, 0))
        self.nodes = (labels, parents, texts)

    def scopes(self, host: str) -> tuple[int, int]:
        """The groups that it belongs to: pages of its layout, and pages with its rank."""
        return _key("layout", host, self.rank, self.layout), _key("rank", host, self.rank)

    def keyed(self, references: dict[int, list[Tree]]) -> list[tuple[str | None, list[tuple[int, int, int]]]]:
        """The pieces, each with (scope, reference, key) of the reference's equal text nodes that the alignment pairs with it."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        tree = Tree(*self.nodes) if any(references.values()) else None
        for scope, trees in references.items():
            for k, other in enumerate(trees):
                for i, j in Match(tree, other).equal_texts():
                    found.setdefault(i, []).append((scope, k, _key(scope, k, j)))
        return [(text, found.get(i, [])) for text, i in self.pieces]

    def chars(self) -> int:
        return sum(len(_clean(text)) for text, i in self.pieces if i)


def joined(pieces: Iterable[tuple[str | None, Iterable[int]]], template: frozenset[int]) -> str:
    """The blocks without template pieces, one per line."""
    out: list[str] = []
    run: list[str] = []
    for text, keys in pieces:
        if text is None:
            whole = _clean("".join(run))
            run.clear()
            if whole:
                out.append(whole)
        elif not template or template.isdisjoint(keys):
            run.append(text)
    whole = _clean("".join(run))
    return "\n".join([*out, whole] if whole else out)


def content_key(html: str) -> bytes:
    return blake2b(html.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def induce(pages: list[str]) -> dict:
    """The wrapper of same-host pages: {references: {scope: trees}, template: keys}; the same as extract_pages does."""
    different = {content_key(p): Page(p) for p in pages}
    groups: dict[int, list[tuple[bytes, Page]]] = {}
    for same, page in sorted(different.items(), key=lambda x: x[0]):
        for scope in page.scopes(""):
            groups.setdefault(scope, []).append((same, page))
    groups = {scope: g for scope, g in groups.items() if len(g) >= LEAST_PAGES}
    references = {scope: [Tree(*p.nodes) for _, p in g[:REFERENCES]] for scope, g in groups.items()}
    counts, sizes, total = Counter(), {}, Counter()
    for page in different.values():
        own = {scope: references[scope] for scope in page.scopes("") if scope in groups}
        total.update(dict.fromkeys(own, page.chars()))
        for text, keys in page.keyed(own):
            counts.update(keys)
            sizes.update(dict.fromkeys(keys, len(_clean(text or ""))))
    template: list[int] = []
    for scope, g in groups.items():
        limit = (TEMPLATE_SHARE if g[0][1].rank < BODY else BODY_SHARE) * total[scope]
        for k in range(len(references[scope])):
            mine = [x for x in counts if x[:2] == (scope, k)]
            for share in (CONSTANT_SHARE, 1.0):  # near copies of one page hold much in common, which is no template
                chosen = [x for x in mine if counts[x] >= max(LEAST_PAGES, share * len(g))]
                if sum(sizes[x] * counts[x] for x in chosen) <= limit:
                    template += [key for _, _, key in chosen]
                    break
    return {"references": references, "template": sorted(template)}


def extract(html: str | None, wrapper: dict | None = None) -> str:
    """The main text of a page; empty for null, empty and contentless pages."""
    if not html:
        return ""
    page, known = Page(html), wrapper["references"] if wrapper else {}
    own = {scope: known[scope] for scope in page.scopes("") if scope in known}
    return joined(((text, [key for _, _, key in keys]) for text, keys in page.keyed(own)), frozenset(wrapper["template"]) if wrapper else frozenset())


class _Opened(dict):
    """Unpickled values by their bytes; what a worker keeps of them is bounded."""

    def __init__(self, make, most: int = 300) -> None:
        self.make, self.most = make, most

    def __missing__(self, content: bytes):
        if len(self) >= self.most:
            self.clear()
        self[content] = value = self.make(content)
        return value


def _trees(content: bytes | None) -> list[Tree]:
    return [Tree(*nodes) for nodes in pickle.loads(content)] if content else []


def _keys(content: bytes | None) -> frozenset[int]:
    return frozenset(pickle.loads(content)) if content else frozenset()


def _with_scopes(rows: DataFrame, values: DataFrame, name: str, total: int) -> DataFrame:
    """rows with name1 and name2: the values (scope, times, name) of their scopes s1 and s2, or null."""
    size = values.agg(F.sum(F.length(name) + 16)).first()[0] or 0
    for k in ("1", "2"):
        own = values.select(F.col("scope").alias(f"s{k}"), F.col(name).alias(f"{name}{k}"), "times")
        if size <= BROADCAST_BYTES:
            rows = rows.join(F.broadcast(own.drop("times")), f"s{k}", "left")
        else:
            rows = split_join(rows, own, f"s{k}", "times", total, "left", ("rid",))
    return rows


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id_col, url_col, text, n_chars.

    Null or empty html gives an empty text; pages whose url has no host (or is null) share no wrapper; repeated
    rows are pages of their own, though equal html counts once for a host's template; very long pages are read
    whole, and deep or wide ones take no recursion (aligning two lists of k and m unlike elements takes k * m steps);
    an empty table gives no rows; other columns are not read.
    """
    bounded_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", url_host(F.col("url")))

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if html and host:
                    page = Page(html)
                    rows.append((page.rank, *page.scopes(host), content_key(html)))
                else:
                    rows.append((None,) * 4)
            columns = zip(*rows, strict=True) if rows else [()] * 4
            made = [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "rank", "s1", "s2", "same"])

    looked = chosen.mapInArrow(look, f"id {kind}, url string, html string, host string, rank int, s1 long, s2 long, same binary")
    seen = stored(looked.withColumn("rid", F.monotonically_increasing_id()), "pages")
    total = seen.count()
    # one row of each distinct page of a host
    distinct = seen.where("same is not null").groupBy("host", "same").agg(F.min(F.struct("rid", "s1", "s2")).alias("x")).select("same", "x.*")
    distinct = stored(distinct, "distinct-pages")
    scoped = distinct.select("rid", "same", F.explode(F.array("s1", "s2")).alias("scope"))
    groups = scoped.groupBy("scope").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    times = seen.where("same is not null").select(F.explode(F.array("s1", "s2")).alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("times"))
    first = scoped.withColumn("k", F.row_number().over(Window.partitionBy("scope").orderBy("same"))).where(F.col("k") <= REFERENCES).select("scope", "k", "rid")
    first = stored(first.join(groups.select("scope"), "scope", "left_semi"), "references")

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pickle.dumps(Page(html).nodes) for html in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["rid", "nodes"])

    trees = seen.join(first.select("rid").distinct(), "rid", "left_semi").select("rid", "html").mapInArrow(prune, "rid long, nodes binary")
    sides = first.join(trees, "rid").groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("k", "nodes"))).alias("n"))

    def bundle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pickle.dumps([pickle.loads(x) for x in some]) for some in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["scope", "trees"])

    bundled = sides.select("scope", F.col("n.nodes").alias("n")).mapInArrow(bundle, "scope long, trees binary")
    references = stored(bundled.join(times, "scope"), "reference-trees")

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Opened(_trees)
        piece = pa.struct([("t", pa.string()), ("size", pa.int64()), ("keys", pa.list_(pa.struct([("scope", pa.int64()), ("k", pa.int64()), ("key", pa.int64())])))])
        for batch in batches:
            rows, chars = [], []
            for html, s1, s2, t1, t2 in zip(*(batch.column(c).to_pylist() for c in ("html", "s1", "s2", "trees1", "trees2")), strict=True):
                page = Page(html or "")
                found = page.keyed({s: opened[t] for s, t in ((s1, t1), (s2, t2)) if t})
                rows.append([{"t": text, "size": len(_clean(text)) if keys else 0, "keys": [{"scope": s, "k": k, "key": x} for s, k, x in keys]} for text, keys in found])
                chars.append(page.chars())
            kept = [batch.column(c) for c in ("id", "url", "rid", "rank", "s1", "s2")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(chars, pa.int64()), pa.array(rows, pa.list_(piece))], names=["id", "url", "rid", "rank", "s1", "s2", "chars", "pieces"])

    aligned = _with_scopes(seen.drop("host", "same"), references, "trees", total).mapInArrow(
        match, f"id {kind}, url string, rid long, rank int, s1 long, s2 long, chars long, pieces array<struct<t:string,size:long,keys:array<struct<scope:long,k:long,key:long>>>>"
    )
    aligned = stored(aligned, "aligned-pages")

    # nodes that nearly all distinct pages of a group have alike
    own = aligned.join(distinct.select("rid"), "rid", "left_semi").where("rank is not null")
    totals = own.select("rank", "chars", F.explode(F.array("s1", "s2")).alias("scope")).groupBy("scope").agg(F.sum("chars").alias("total"), F.max("rank").alias("rank"))
    texts = own.select(F.explode(F.filter("pieces", lambda p: F.size(p["keys"]) > 0)).alias("p")).select("p.size", F.explode("p.keys").alias("x"))
    nodes = texts.groupBy("x.scope", "x.k", "x.key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    held = nodes.join(groups, "scope").join(totals, "scope").where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= CONSTANT_SHARE * F.col("pages")))
    most = F.when(F.col("rank") < BODY, TEMPLATE_SHARE).otherwise(BODY_SHARE) * F.col("total")
    whole = Window.partitionBy("scope", "k")
    held = held.withColumns({"wide": F.sum("size").over(whole), "strict": F.sum(F.when(F.col("n") == F.col("pages"), F.col("size"))).over(whole)})
    # near copies of one page hold much in common, which is no template
    template = held.where((F.col("wide") <= most) | ((F.col("n") == F.col("pages")) & (F.col("strict") <= most)))
    lists = template.groupBy("scope").agg(F.sort_array(F.collect_list("key")).alias("keys"))

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pickle.dumps(keys) for keys in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["scope", "wrapper"])

    wrappers = stored(lists.mapInArrow(listed, "scope long, wrapper binary").join(times, "scope"), "wrappers")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Opened(_keys)
        for batch in batches:
            texts = []
            for pieces, *own in zip(*(batch.column(c).to_pylist() for c in ("pieces", "wrapper1", "wrapper2")), strict=True):
                template = frozenset().union(*(opened[w] for w in own if w))
                texts.append(joined(((p["t"], [x["key"] for x in p["keys"]]) for p in pieces), template))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    found = _with_scopes(aligned.drop("rank"), wrappers, "wrapper", total)
    out = found.select("id", "url", "pieces", "wrapper1", "wrapper2").mapInArrow(read, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
