"""HTML to a relational tree: a page is one row that holds its elements in pre-order and its JSON-LD scripts.

The tree follows the forgiving reading of the stdlib parser: void elements close at once, an end tag closes back
to the nearest open element of its name and is ignored without one, nothing else is closed implicitly. Work is
linear in the page: per-parent counters give ordinals, and texts are cut from one list of text pieces.

A page's elements stay in one array, so that what a rule asks about a page (what lies below what, the nearest
card, the next sibling) is a higher-order function over that array, with neither a join nor a shuffle. Texts are
kept for the tags and lengths that rules read, not for every element again in all that are around it.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from factloom.functions import jsonld
from factloom.functions.scalars import CODES
from factloom.functions.urls import host_of, path_of, quiet

#: Elements without content, elements whose text is not shown, blocks, and the longest texts compared.
VOID = {"area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr"}
UNSHOWN = {"script", "style", "noscript", "template", "svg", "head"}
BLOCK_TAGS = ("p", "li", "h1", "h2", "h3", "tr", "dt", "dd")
LONGEST_BLOCK, LONGEST_LABELLED, LONGEST_SCOPE = 400, 180, 5000
LONGEST = LONGEST_SCOPE + 1
LONGEST_SOURCE = 4_000
#: Tags whose shown text is read whatever its length up to LONGEST_SCOPE; of others, up to LONGEST_LABELLED.
TEXT_TAGS = {"h1", "h2", "h3", "h4", "p", "li", "dt", "dd", "td", "th"}
_HIDING = re.compile(r"(?:^|;)(?:display:none|visibility:hidden|opacity:0(?:\.0+)?)(?:!important)?(?:;|$)")
_SPACE = re.compile(r"\s+")
#: The first digit of an amount: no word runs into it but a currency's code that stands alone.
_AMOUNT = re.compile(rf"(?<!\w)(?:{'|'.join(CODES)})?\d", re.IGNORECASE)


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_TEXT, _INT, _MAP = T.StringType(), T.IntegerType(), T.MapType(T.StringType(), T.StringType())
ELEMENT = T.StructType([
    T.StructField("node_id", T.IntegerType()),  # pre-order, from 1
    T.StructField("last_id", T.IntegerType()),  # the last descendant's; the node's own without any
    T.StructField("parent_id", T.IntegerType()),  # 0 at the top
    T.StructField("depth", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("step", T.StringType()),  # its own part of the path from the top; node_path joins them
    T.StructField("hidden", T.BooleanType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("block_text", T.StringType()),  # shown strings and comments, stripped, joined by a space
    T.StructField("shown_text", T.StringType()),  # shown strings, white space collapsed
    T.StructField("plain_text", T.StringType()),  # every string, stripped, joined by a space
    T.StructField("only_string", T.StringType()),  # the text of an element with one string and nothing else
    T.StructField("fold", T.StringType()),  # shown text of text tags, plain text of titles, content of metas: case folded
    T.StructField("size", T.IntegerType()),  # length of the shown text, LONGEST at most
    T.StructField("amount", T.BooleanType()),  # whether the shown text, if not too long for a scope, holds an amount
])
OFFER = _struct(idx=_INT, name=_TEXT, price=_TEXT, currency=_TEXT)
ENTITY = _struct(root_idx=_INT, child_idx=_INT, types=T.ArrayType(_TEXT), url=_TEXT, host=_TEXT, own_path=_TEXT, anchor=_TEXT, facts=_MAP, offers=T.ArrayType(OFFER))
ITEM = _struct(item_idx=_INT, key=_TEXT, raw_value=_TEXT)
SCRIPT = _struct(node_id=_INT, path=_TEXT, script=_TEXT, items=T.ArrayType(ITEM), entities=T.ArrayType(ENTITY))
PAGE = _struct(page_key=_TEXT, url=_TEXT, page_host=_TEXT, page_path=_TEXT, nodes=T.ArrayType(ELEMENT), scripts=T.ArrayType(SCRIPT))
_ELEMENT_ARROW, _SCRIPT_ARROW = to_arrow_type(ELEMENT), to_arrow_type(SCRIPT)
#: Elements after which a batch of pages goes out, so that memory follows a page and not the batch.
BATCH_NODES = 20_000


class _Node:
    __slots__ = ("attrs", "children", "counts", "depth", "first_piece", "hidden", "last_id", "last_piece", "node_id", "parent", "step", "tag", "unshown")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None, node_id: int, at: int):
        self.tag, self.attrs, self.parent, self.node_id, self.last_id = tag, attrs, parent, node_id, node_id
        self.counts: dict[str, int] = {}
        self.children: list[str | tuple[str, str] | _Node] = []  # strings, (kind, text) of comments and the like, elements
        self.first_piece = self.last_piece = at
        if parent is None:
            self.depth, self.hidden, self.unshown, self.step = 0, False, -1, ""
            return
        self.depth = parent.depth + 1
        parent.counts[tag] = parent.counts.get(tag, 0) + 1
        self.step = f"{tag}:nth-of-type({parent.counts[tag]})"
        self.hidden = parent.hidden or hides(attrs)
        self.unshown = self.depth if tag in UNSHOWN else parent.unshown


def _path(node: _Node) -> str:
    """Steps from the top down to a node. Nodes keep their own step alone, so a page takes as much room as its html."""
    steps = []
    while node.parent is not None:
        steps.append(node.step)
        node = node.parent
    return " > ".join(reversed(steps))


def hides(attrs: dict[str, str]) -> bool:
    """Whether an element's own attributes hide it."""
    if not attrs:
        return False
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(_HIDING.search(_SPACE.sub("", attrs.get("style", "").lower())))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[_Node] = []
        #: (stripped text, is a comment, depth of the nearest unshown element around it, hidden)
        self.pieces: list[tuple[str, bool, int, bool]] = []
        self.stack = [_Node("", {}, None, 0, 0)]
        self.open: dict[str, int] = {}
        self.data: list[str] = []

    def _string(self, text: str, kind: str) -> None:
        top = self.stack[-1]
        top.children.append(text if kind == "text" else (kind, text))
        if kind in ("text", "comment") and text.strip():
            self.pieces.append((text.strip(), kind == "comment", top.unshown, top.hidden))

    def _flush(self) -> None:
        if self.data:
            text = "".join(self.data)
            self.data.clear()
            self._string(text, "text")

    def handle_data(self, data: str) -> None:
        self.data.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()
        self._string(data, "comment")

    def handle_decl(self, decl: str) -> None:
        self._flush()
        self._string(decl, "other")

    handle_pi = unknown_decl = handle_decl

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        parent = self.stack[-1]
        kept: dict[str, str] = {}
        for name, value in attrs:
            kept[name] = value if value is not None else ""
        node = _Node(tag, kept, parent, len(self.nodes) + 1, len(self.pieces))
        self.nodes.append(node)
        parent.children.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def _close(self) -> None:
        node = self.stack.pop()
        node.last_id, node.last_piece = len(self.nodes), len(self.pieces)
        self.open[node.tag] -= 1

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if self.open.get(tag):
            while self.stack[-1].tag != tag:
                self._close()
            self._close()

    def finish(self) -> None:
        self.close()
        self._flush()
        while len(self.stack) > 1:
            self._close()


def _text(pieces: list[tuple[str, bool, int, bool]], node: _Node, comments: bool, everything: bool = False) -> str:
    out: list[str] = []
    size = 0
    for text, comment, unshown, hidden in pieces[node.first_piece : node.last_piece]:
        if comment and not comments or not everything and (hidden or unshown >= node.depth):
            continue
        out.append(text)
        size += len(text) + 1
        if size > LONGEST:
            break
    return " ".join(out)


def _written(node: _Node) -> Iterator[str]:
    """The element as HTML: attributes quoted, &, < and > escaped but in scripts and styles, void elements closed."""
    todo: list[str | _Node] = [node]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            yield at
            continue
        attrs = "".join(f" {k}='{_escape(v)}'" if '"' in v and "'" not in v else f' {k}="{_escape(v).replace(chr(34), "&quot;")}"' for k, v in at.attrs.items())
        if at.tag in VOID:
            yield f"<{at.tag}{attrs}/>"
            continue
        yield f"<{at.tag}{attrs}>"
        todo.append(f"</{at.tag}>")
        for child in reversed(at.children):
            if isinstance(child, str):
                todo.append(child if at.tag in ("script", "style") else _escape(child))
            elif isinstance(child, tuple):
                todo.append(f"<!--{child[1]}-->" if child[0] == "comment" else f"<!{child[1]}>")
            else:
                todo.append(child)


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def located(tree: _Tree, locators: Iterable[str | None]) -> list[_Node | None]:
    """The node that each locator names (what follows "::" is ignored), null without one. All locators of a page are one
    trie of steps, which one walk over its nodes follows."""
    trie: dict = {}
    asked = [tuple((locator or "").split("::", 1)[0].split(" > ")) for locator in locators]
    for steps in asked:
        at = trie
        for step in steps:
            at = at.setdefault(step, {})
    reached: dict[int, dict] = {0: trie}  # by node, the part of the trie that goes on below it
    found: dict[int, _Node] = {}
    for node in tree.nodes:
        below = reached.get(node.parent.node_id, {}).get(node.step)
        if below is not None:
            reached[node.node_id] = below
            found[id(below)] = node
    out: list[_Node | None] = []
    for steps in asked:
        at = trie
        for step in steps:
            at = at[step]
        out.append(found.get(id(at)))
    return out


def source_of(html: str | None, locator: str | None, longest: int = LONGEST_SOURCE) -> str | None:
    """The HTML of the node that a locator names, cut at `longest` characters."""
    return sources_of(html, [locator], longest)[0]


def sources_of(html: str | None, locators: Iterable[str | None], longest: int = LONGEST_SOURCE) -> list[str | None]:
    """The HTML of the nodes that locators name, from one parse, each cut at `longest` characters; null without a node."""
    return [node and _source(node, longest) for node in located(_tree(html), locators)]


def _source(node: _Node, longest: int) -> str:
    out, size = [], 0
    for part in _written(node):
        out.append(part)
        size += len(part)
        if size >= longest:
            break
    return "".join(out)[:longest]


@F.pandas_udf(T.StringType())
def source_node(html: pd.Series, locator: pd.Series) -> pd.Series:
    return pd.Series([source_of(h, loc) for h, loc in zip(html, locator, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def source_nodes(html: pd.Series, locators: pd.Series) -> pd.Series:
    """The sources of all locators of a page, in their order, from one parse."""
    return pd.Series([sources_of(h, () if loc is None else loc) for h, loc in zip(html, locators, strict=True)], dtype=object)


HEADINGS, CELLS = ("h1", "h2", "h3", "h4", "h5", "h6"), ("td", "th")
CITED = _struct(node_id=_INT, last_id=_INT, tag=_TEXT, shown=T.BooleanType(), text=_TEXT, headings=_INT, cell_id=_INT, cell=_INT)


def _rendered(node: _Node) -> str:
    """The text that a reader sees of a node: all strings but comments and those in hidden elements, scripts, styles and
    templates, white space collapsed."""
    parts: list[str] = []
    at: _Node | None = node
    while at is not None:
        if at.tag in ("script", "style", "template"):
            return ""
        at = at.parent
    todo: list = [node]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            parts.append(at)
        elif not isinstance(at, tuple) and not at.hidden and at.tag not in ("script", "style", "template"):
            todo += reversed(at.children)
    return " ".join(" ".join(parts).split())


def _place_in_table(node: _Node) -> tuple[_Node | None, int | None]:
    """The nearest cell around a node, and its index in its row; no index where a cell of the row spans."""
    cell: _Node | None = node
    while cell is not None and cell.tag not in CELLS:
        cell = cell.parent
    row = cell
    while row is not None and row.tag != "tr":
        row = row.parent
    cells = [c for c in row.children if isinstance(c, _Node) and c.tag in CELLS] if row is not None else []
    if cell not in cells or any("colspan" in c.attrs or "rowspan" in c.attrs for c in cells):
        return cell, None
    return cell, cells.index(cell)


def _cited(tree: _Tree, locators: Iterable[str | None]) -> list[dict]:
    heads = [n.node_id for n in tree.nodes if n.tag in HEADINGS]
    out = []
    for node in located(tree, locators):
        if node is None:
            out.append(dict.fromkeys(CITED.fieldNames()))
            continue
        cell, index = _place_in_table(node)
        inner = bisect.bisect_right(heads, node.last_id) - bisect.bisect_right(heads, node.node_id)
        out.append({"node_id": node.node_id, "last_id": node.last_id, "tag": node.tag, "shown": not node.hidden, "text": _rendered(node), "headings": inner, "cell_id": cell and cell.node_id, "cell": index})
    return out


@F.pandas_udf(T.ArrayType(CITED))
def cited_nodes(html: pd.Series, locators: pd.Series) -> pd.Series:
    """What each locator names, in order: its interval, tag, whether it is shown, the text that a reader sees, the headings
    below it, and its cell; nulls where it names nothing. Rows of one page that follow each other share a parse."""
    last, tree, out = None, _tree(None), []
    for page, asked in zip(html, locators, strict=True):
        if page != last:
            last, tree = page, _tree(page)
        out.append(_cited(tree, asked))
    return pd.Series(out, dtype=object)


def _tree(html: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(html or "")
    tree.finish()
    return tree


def _only(n: _Node) -> str | None:
    return n.children[0] if len(n.children) == 1 and isinstance(n.children[0], str) else None


def parse(page_key: str | None, html: str | None) -> list[tuple]:
    """(page_key, the first twelve parts of ELEMENT with all texts) for each element of one page; a page that is
    null or has no element has none."""
    tree = _tree(html)
    return [
        (page_key, n.node_id, n.last_id, n.parent.node_id, n.depth, n.tag, _path(n), n.hidden, list(n.attrs.items()), _text(tree.pieces, n, True)[:LONGEST], _shown(tree.pieces, n)[:LONGEST],
         _text(tree.pieces, n, False, True)[:LONGEST], _only(n))
        for n in tree.nodes
    ]


def _shown(pieces: list[tuple[str, bool, int, bool]], n: _Node) -> str:
    return " ".join(_text(pieces, n, False).split())


def _kept(pieces: list[tuple[str, bool, int, bool]], n: _Node) -> tuple:
    """The parts of ELEMENT of one element: texts only where a rule reads them."""
    shown = _shown(pieces, n)[:LONGEST]
    plain = _SPACE.sub(" ", _text(pieces, n, False, True)).strip() if n.tag == "title" else None
    block = _text(pieces, n, True) if n.tag in BLOCK_TAGS else None
    text = shown if len(shown) <= (LONGEST_SCOPE if n.tag in TEXT_TAGS else LONGEST_LABELLED) else None
    fold = n.attrs.get("content") if n.tag == "meta" else plain if n.tag == "title" else text if n.tag in TEXT_TAGS and len(shown) <= LONGEST_BLOCK else None
    only = _only(n) if n.tag == "script" and n.attrs.get("type") == jsonld.SCRIPT_TYPE else None
    return (
        n.node_id, n.last_id, n.parent.node_id, n.depth, n.tag, n.step, n.hidden, list(n.attrs.items()), block if block and len(block) <= LONGEST_BLOCK else None, text, plain,
        only if only and len(only) <= jsonld.LONGEST_GRAPH_SCRIPT else None, None if fold is None else fold.casefold(), len(shown), 0 < len(shown) <= LONGEST_SCOPE and bool(_AMOUNT.search(shown)),
    )


def _scripts(tree: _Tree, rows: list[tuple]) -> list[dict]:
    """Shown JSON-LD scripts of a page's kept elements."""
    out = []
    for node, r in zip(tree.nodes, rows, strict=True):
        script = r[11]
        if script and not r[6]:
            roots = jsonld.roots(script)
            out.append({"node_id": r[0], "path": _path(node), "script": script, "items": jsonld.items(roots) if len(script) <= jsonld.LONGEST_ITEM_SCRIPT else [], "entities": jsonld.entities(roots)})
    return out


def _batch(keys: list, urls: list, rows: list[tuple], ends: list[int], scripts: list[list[dict]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_ELEMENT_ARROW)
    elements = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ELEMENT_ARROW, strict=True)], fields=list(_ELEMENT_ARROW))
    offsets = pa.array([0, *ends], pa.int32())
    arrays = [pa.array(keys, pa.string()), pa.array(urls, pa.string()), pa.array([quiet(host_of, u) for u in urls], pa.string()), pa.array([path_of(u) for u in urls], pa.string())]
    return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(offsets, elements), pa.array(scripts, pa.list_(_SCRIPT_ARROW))], PAGE.fieldNames())


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, urls, rows, ends, scripts = [], [], [], [], []
        done = 0

        def pages(upto: int) -> pa.RecordBatch:
            found, more = _batch(keys, urls, rows, ends, scripts), batch.slice(done, upto - done)
            return pa.RecordBatch.from_arrays([*found.columns, *more.columns[3:]], [*found.schema.names, *more.schema.names[3:]])

        for at, (key, url, html) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True), 1):
            tree = _tree(html.as_py())
            own = [_kept(tree.pieces, n) for n in tree.nodes]
            keys.append(key)
            urls.append(url)
            rows += own
            ends.append(len(rows))
            scripts.append(_scripts(tree, own))
            if len(rows) >= BATCH_NODES:
                yield pages(at)
                keys, urls, rows, ends, scripts, done = [], [], [], [], [], at
        if keys:
            yield pages(batch.num_rows)


def nodes(captures: DataFrame, key: str = "page_key", html: str = "html", also: Sequence[str] = ()) -> DataFrame:
    """One row for each capture (PAGE), with its elements and scripts; the only place where a page is parsed. A null
    page has no elements; further columns of captures are left behind, but for the url, if there is one, and `also`."""
    url = F.col("url") if "url" in captures.columns else F.lit(None)
    rows = captures.select(F.col(key).cast("string"), url.cast("string"), F.col(html), *also)
    return rows.mapInArrow(_parse_batches, T.StructType([*PAGE.fields, *(rows.schema[c] for c in also)]))


def node_path(nodes: Column, node_id: Column) -> Column:
    """The path of an element among all nodes of its page, joined from the steps on the way up; only what a rule gives out
    has one, so that a deeply nested page takes no more room than its html."""

    def up(at: Column, _: Column) -> Column:
        return let(F.get(nodes, at["id"] - 1), lambda n: F.struct(n["parent_id"].alias("id"), F.concat(F.array(n["step"]), at["steps"]).alias("steps")))

    start = F.struct(node_id.cast("int").alias("id"), F.array().cast("array<string>").alias("steps"))
    return F.aggregate(F.sequence(F.lit(1), F.get(nodes, node_id - 1)["depth"]), start, up, lambda at: F.array_join(at["steps"], " > "))


def elements(pages: DataFrame, tags: Iterable[str]) -> DataFrame:
    """One row for each element with one of the tags: page_key, url, path and the parts of ELEMENT."""
    nodes = F.col("nodes")
    kept = F.transform(tagged(nodes, tags), lambda n: F.struct(node_path(nodes, n["node_id"]).alias("path"), *[n[f.name].alias(f.name) for f in ELEMENT.fields]))
    return pages.select("page_key", "url", F.inline(kept))


def below(a: Column, b: Column, itself: bool = False) -> Column:
    """Whether element b lies below element a of the same page, or is a itself if that counts."""
    return ((b["node_id"] >= a["node_id"]) if itself else (b["node_id"] > a["node_id"])) & (b["node_id"] <= a["last_id"])


def tagged(array: Column, tags: Iterable[str], also: Callable[[Column], Column] | None = None) -> Column:
    """The elements of an array with one of the tags, and with what else is asked."""
    return F.filter(array, lambda n: n["tag"].isin(*tags) & also(n) if also else n["tag"].isin(*tags))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used, also inside the functions of arrays."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def flat_map(array: Column, each: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(array, each))


@F.pandas_udf(T.StringType())
def shown_text_of(html: pd.Series, locator: pd.Series) -> pd.Series:
    """The whole shown text of the shown element that a locator names; null without one."""

    def one(page: str | None, path: str | None) -> str | None:
        tree = _tree(page)
        node = located(tree, [path])[0] if path else None
        return None if node is None or node.hidden else " ".join(t for t, comment, unshown, hidden in tree.pieces[node.first_piece : node.last_piece] if not (comment or hidden or unshown >= node.depth))

    return pd.Series([one(h, loc) for h, loc in zip(html, locator, strict=True)], dtype=object).map(lambda t: t and " ".join(t.split()))
