"""Main text of web pages by wrapper induction.

Pages of one host are aligned with a reference page of it by simple tree matching: the largest order-preserving mapping between two
trees in which mapped nodes have the same label (tag, class, id) and mapped parents.  Over all contents of the host, a node of the
reference whose own text is the same on nearly all that align is template; a node whose text varies is a slot.  Pages with the same
content have one vote together, and those with the reference's content have none, as copies of an article don't make it template.
Pages are then read by that wrapper: nodes with the template's text go, and so do the parts that say by themselves that they aren't the article (menus,
headers, footers, sidebars, notices, adverts, forms, comments), in a marked article by whole class names alone.  Where a page marks its article (article, main, or their roles)
the article's slots are its content.  Elsewhere the slots under the host's content node are: the deepest reference node that
holds most of the varying text.

Text is put together block by block: character references decoded, white space in a block one space, blocks joined by one line
break in page order; a line break element counts as white space.

Defined cases: a null or empty html has empty text; markup that ends early or never closes is read as far as it goes, however deep or wide, and text without
any markup is one block; a null or hostless url is a host of its own; a host with a single content has no template; rows that repeat a
page have its text, and no further vote; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import OrderedDict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.scratch import Scratch

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Fixed values of HTML: raw text, void and block elements, and which open elements a start tag ends.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
#: Their ends, in letters of either case; letters beyond ASCII are never one of theirs.
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption select button".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
CLOSES_P = BLOCK - {"html", "head", "body", "option", "button", "select", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
FENCE = {"table", "td", "th", "ul", "ol", "dl", "div", "article", "section", "body", "html", "main", "aside", "nav", "footer", "header"}
#: What is never article text: by element, and by words in class, id or role.
OUT_TAGS = {"head", "nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "svg", "object", "video", "audio", "canvas"} | RAW
OUT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?|banner|side-?bar|menu|nav(?:bar|igation)?|footer|header|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|disqus|replies|respond|share|sharing|social|related|recommend(?:ed|ations)?|subscribe|newsletter|signup|login|breadcrumbs?|widget|toolbar|pagination|complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
#: In a marked article only whole tokens of class or role count, and an article has headers of its own.
HEADER_WORDS = {"header", "masthead"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Pairs of children that one table of the tree matching holds at most, and hosts whose trees a task keeps.
CELLS, TREES = 250_000, 64
ARTICLE_ROLE = re.compile(r"(?:^|\s)(?:main|article|articleBody)(?:$|\s)")


class Node:
    __slots__ = ("tag", "label", "kids", "parent", "out", "article", "texts", "number", "end", "shape")

    def __init__(self, tag: str, label: str, parent: Node | None):
        self.tag, self.label, self.parent = tag, label, parent
        self.kids: list[Node] = []
        self.texts: list[tuple[int, str]] = []
        self.out = self.article = False
        self.number = self.end = self.shape = 0  # place in page order, that after the last node below, hash of labels from here down


def _cut_inside(tag: str, attrs: str) -> bool:
    """Whether a block in a marked article says that it isn't part of it: by a whole class or role, never by an id or on a heading."""
    if tag in HEADINGS:
        return False
    tokens = [t for k, a, b, c in ATTR.findall(attrs) if k.lower() in ("class", "role") for t in (a or b or c).split()]
    return any(t.lower() not in HEADER_WORDS and (m := OUT_WORDS.match(t)) is not None and m.end() == len(t) for t in tokens)


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and its blocks of text in page order with the node that each belongs to."""
    root = Node("", "", None)
    here, stack = root, []  # stack: open elements, inline ones too, as (tag, node to return to)
    blocks: list[tuple[Node, str]] = []
    run: list[str] = []
    at = 0

    def flush() -> None:
        text = "".join(run)
        run.clear()
        if "&" in text:
            text = _html.unescape(text)
        text = " ".join(text.split())
        if text:
            blocks.append((here, text))

    def close(k: int) -> None:
        nonlocal here
        inner = stack[k:]
        del stack[k:]
        for tag, node in reversed(inner):
            if node is not None:
                flush()
                here = node

    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["cdata"]:
                run.append(_html.escape(m["cdata"]))
            continue
        tag = tag.lower()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k][1] is not None:
                    break  # an inline end tag doesn't end a block
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            stop = page.find(">", end.start()) if end else -1
            at = stop + 1 if stop >= 0 else len(page)
            continue
        if tag not in BLOCK and tag not in OUT_TAGS:
            stack.append((tag, None))
            continue
        ends = ENDS.get(tag)
        if tag in CLOSES_P or ends:
            for k in range(len(stack) - 1, -1, -1):
                if (ends and stack[k][0] in ends) or (tag in CLOSES_P and stack[k][0] == "p"):
                    close(k)
                    if not ends:
                        break
                elif stack[k][0] in FENCE:
                    break
        flush()
        names = " ".join(a or b or c for _, a, b, c in ATTR.findall(m["attrs"])) if "=" in m["attrs"] else ""
        node = Node(tag, f"{tag} {names}" if names else tag, here)
        node.article = here.article or tag in ("article", "main") or bool(names and ARTICLE_ROLE.search(names))
        node.out = here.out or tag in OUT_TAGS or (tag == "header" and not here.article) or bool(names and (_cut_inside(tag, m["attrs"]) if here.article else tag not in ("html", "body") and not node.article and OUT_WORDS.search(names)))
        here.kids.append(node)
        if m["attrs"].endswith("/") and tag not in BLOCK:
            continue
        stack.append((tag, here))
        here = node
    run.append(page[at:])
    flush()
    nodes = _flat(root)
    for number, node in enumerate(nodes):
        node.number, node.end = number, number + 1
    for node in reversed(nodes):
        node.shape = hash((node.label, *[x.shape for x in node.kids]))
        if node.kids:
            node.end = node.kids[-1].end
    for node, text in blocks:
        node.texts.append((len(node.texts), text))
    return root, blocks


def _map_all(a: Node, b: Node, out: dict[int, Node]) -> int:
    """Two trees of one shape, node by node; the number of nodes."""
    for x, y in zip(_flat(a), _flat(b), strict=True):
        out[y.number] = x
    return a.end - a.number


def _match(a: Node, b: Node, out: dict[int, Node]):
    """One step of `align`: yields the pairs of nodes below that it needs the mapping of, and is sent their sizes."""
    if a.shape == b.shape:
        return _map_all(a, b, out)
    out[b.number] = a
    size, xs, ys = 1, a.kids, b.kids
    # children of one shape at both ends: no mapping has more than they have
    lo, hi, most = 0, 0, min(len(xs), len(ys))
    while lo < most and xs[lo].shape == ys[lo].shape:
        size += _map_all(xs[lo], ys[lo], out)
        lo += 1
    while hi < most - lo and xs[-1 - hi].shape == ys[-1 - hi].shape:
        size += _map_all(xs[-1 - hi], ys[-1 - hi], out)
        hi += 1
    xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
    n, m = len(xs), len(ys)
    if n * m > CELLS:
        waiting: dict[str, list[int]] = {}
        for i, x in enumerate(xs):
            waiting.setdefault(x.label, []).append(i)
        at = 0
        for y in ys:
            places = waiting.get(y.label, ())
            k = bisect_left(places, at)
            if k < len(places):
                size += yield xs[places[k]], y, out
                at = places[k] + 1
        return size
    table = [[0] * (m + 1) for _ in range(n + 1)]
    inner: dict[tuple[int, int], dict[int, Node]] = {}
    for i in range(1, n + 1):
        x, row, above = xs[i - 1], table[i], table[i - 1]
        label = x.label
        for j in range(1, m + 1):
            best = above[j] if above[j] > row[j - 1] else row[j - 1]
            y = ys[j - 1]
            if y.label == label:
                if not x.kids or not y.kids:
                    w = 1
                elif x.shape == y.shape:
                    w = x.end - x.number
                else:
                    inner[i, j] = {}
                    w = yield x, y, inner[i, j]
                if above[j - 1] + w > best:
                    best = above[j - 1] + w
            row[j] = best
    size += table[n][m]
    i, j = n, m
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            if (i + 1, j + 1) in inner:
                out.update(inner[i + 1, j + 1])
            elif xs[i].shape == ys[j].shape:
                _map_all(xs[i], ys[j], out)
            else:
                out[ys[j].number] = xs[i]
    return size


def align(a: Node, b: Node, out: dict[int, Node]) -> int:
    """Simple tree matching of two nodes with equal labels: the size of the mapping; out: node of a by number of b's node.

    Children of two nodes that make more than CELLS pairs, without those of one shape at both ends, are mapped in order, each to the next
    of its label.  However deep a page is, the steps stand in a list and not on the call stack.
    """
    steps, size = [_match(a, b, out)], None
    while steps:
        try:
            steps.append(_match(*steps[-1].send(size)))
            size = None
        except StopIteration as end:
            steps.pop()
            size = end.value
    return size


def _recent(kept: OrderedDict, key, make):
    """kept[key], made if it isn't there; the TREES entries used last stay."""
    if key in kept:
        kept.move_to_end(key)
    else:
        kept[key] = make()
        if len(kept) > TREES:
            kept.popitem(last=False)
    return kept[key]


def _own(node: Node) -> str:
    return "\n".join(t for _, t in node.texts)


def extract(page: str, reference: Node | None, template: dict[int, str], content: int) -> str:
    """The main text of a page, given its host's reference tree, number and text of its template nodes, and its content node's number."""
    root, blocks = parse(page)
    constant: set[int] = set()
    under = None
    if reference is not None:
        mapped: dict[int, Node] = {}
        align(root, reference, mapped)
        constant = {id(mapped[k]) for k, text in template.items() if k in mapped and _own(mapped[k]) == text}
        under = mapped.get(content)
    good = [(n, t) for n, t in blocks if not n.out and id(n) not in constant]
    marked = [(n, t) for n, t in good if n.article]
    if not marked and under is not None:
        inside = [(n, t) for n, t in good if under.number <= n.number < under.end]
        good = inside or good
    return "\n".join(t for _, t in (marked or good))


def host_of(url: Column) -> Column:
    """The host of a url in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def _flat(tree: Node) -> list[Node]:
    """The nodes of a tree, by number."""
    nodes, todo = [], [tree]
    while todo:
        x = todo.pop()
        nodes.append(x)
        todo.extend(reversed(x.kids))
    return nodes


def _content(blocks: list[tuple[Node, str]], same: set[int]) -> int | None:
    """A number for a page's content, given the nodes (by id) whose own text is the reference's; None for the reference's content.

    A page whose text (the marked article's, where there is one) is to four fifths the reference's at the same places has the
    reference's content.  Others go by their longest block that differs, so that copies with another advert or footer are one.
    """
    good = [(n, t) for n, t in blocks if not n.out]
    good = [(n, t) for n, t in good if n.article] or good
    other = [t for n, t in good if id(n) not in same]
    total = sum(len(t) for _, t in good)
    if total and 5 * sum(map(len, other)) <= total:
        return None
    longest = max(other, key=lambda t: (len(t), t), default="")
    return int.from_bytes(blake2b(longest.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _votes(batches):
    """For each host and content in a batch: the reference's nodes that align, whether the own text is the same, length of one that differs."""
    trees: OrderedDict[str, list[Node]] = OrderedDict()
    for b in batches:
        out: dict[tuple[str, int], list[tuple[int, bool, int]]] = {}
        for host, page, ref in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if page == ref:
                continue
            nodes = _recent(trees, host, lambda ref=ref: _flat(parse(ref)[0]))
            mapped: dict[int, Node] = {}
            root, blocks = parse(page)
            align(root, nodes[0], mapped)
            same = {k for k, node in mapped.items() if _own(node) == _own(nodes[k])}
            content = _content(blocks, {id(mapped[k]) for k in same})
            if content is None:
                continue
            vote = [(k, k in same, 0 if k in same or node.out else sum(len(t) for _, t in node.texts)) for k, node in sorted(mapped.items())]
            if (host, content) not in out or vote < out[host, content]:
                out[host, content] = vote
        flat_votes = [v for vote in out.values() for v in vote]
        ends = np.cumsum([0, *map(len, out.values())])
        fields = [pa.array([v[i] for v in flat_votes], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.int64()))]
        votes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["node", "same", "varied"]))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int64()), votes], ["host", "content", "votes"])


def content_node(tree: Node, varied: dict[int, int], share: float = 0.8) -> int:
    """The deepest node of the reference that holds at least share of the varying text."""
    total = sum(varied.values())
    sums: dict[int, int] = {}
    for n in reversed(_flat(tree)):
        sums[n.number] = varied.get(n.number, 0) + sum(sums[k.number] for k in n.kids)
    here = tree
    while total:
        down = [k for k in here.kids if sums[k.number] >= share * total]
        if not down or down[0].tag in ("p", "h1", "h2", "h3", "li"):
            break
        here = down[0]
    return here.number


def _wrapper(ref: str | None, votes: list | None, few: int, same: float) -> tuple[Node | None, dict[int, str], int]:
    """A host's reference tree, number and text of its template nodes, and its content node's number."""
    if not ref or not votes:
        return None, {}, 0
    tree = parse(ref)[0]
    nodes = _flat(tree)
    template = {v["node"]: _own(nodes[v["node"]]) for v in votes if v["aligned"] >= few and v["same"] >= same * v["aligned"]}
    return tree, template, content_node(tree, {v["node"]: v["varied"] for v in votes})


def _read(batches, few: int, same: float):
    known: OrderedDict[str, tuple] = OrderedDict()
    for b in batches:
        ids, urls, hosts, pages, refs, nodes = (b.column(i).to_pylist() for i in range(6))
        out = []
        for host, page, ref, votes in zip(hosts, pages, refs, nodes, strict=True):
            wrapper = _recent(known, host, lambda ref=ref, votes=votes: _wrapper(ref, votes, few, same))
            out.append(extract(page or "", *wrapper))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", few: int = 1, same: float = 0.8, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) for each page.

    A reference node is template if at least ``few`` contents besides its own align with it and on ``same`` of them its own text is the
    same; one is enough, as its other text differs.  References and
    wrappers (one page a host) are measured and sent to all executors up to broadcast_bytes; beyond it they meet the pages in a
    shuffle by host, which AQE splits for large hosts.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    full = rows.where(F.length("html") > 0)
    refs = full.groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("page_id"), "page_id", "html")).alias("ref"))
    scratch = Scratch(pages.sparkSession, "wrapper")
    refs = scratch.save(refs, "references")
    size = refs.agg(F.sum(F.octet_length("ref"))).first()[0] or 0
    side = F.broadcast if size <= broadcast_bytes else (lambda x: x)
    votes = full.join(side(refs), "host").select("host", "html", "ref").mapInArrow(_votes, "host string, content long, votes array<struct<node:int,same:boolean,varied:long>>")
    votes = votes.groupBy("host", "content").agg(F.min("votes").alias("votes")).select("host", F.inline("votes"))  # one vote a content
    votes = votes.groupBy("host", "node").agg(F.count("*").alias("aligned"), F.sum(F.col("same").cast("long")).alias("same"), F.sum("varied").alias("varied"))
    votes = votes.groupBy("host").agg(F.collect_list(F.struct("node", "aligned", "same", "varied")).alias("votes"))  # one page's nodes
    wrappers = scratch.save(refs.join(votes, "host", "left"), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("ref") + 32 * F.greatest(F.size("votes"), F.lit(0)))).first()[0] or 0
    side = F.broadcast if size <= broadcast_bytes else (lambda x: x)
    read = rows.join(side(wrappers), "host", "left").select("page_id", "url", "host", "html", "ref", "votes")
    return read.mapInArrow(lambda b: _read(b, few, same), "page_id long, url string, text string, n_chars long")
