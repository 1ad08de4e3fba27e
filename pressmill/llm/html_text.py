"""HTML main-text extraction with wrappers induced from the pages of a host.

The pages of a host are grouped on three levels: all of them, those with one outline (how containers follow each other)
and those with one layout (how all block tags do). Each group has a reference tree, merged from up to REFERENCE_PAGES of
its pages by aligning them. Every page is aligned with the references of its groups by simple tree matching, and votes:

- a slot of the reference whose text stays the same over nearly all different pages of the group is template;
- the others vary. Going down from the top of the reference while one node holds most of the varying text, but not below
  the headings beside it, the node that is reached is the group's content slot.

Extraction takes what a page has in the content slot of its narrowest group, leaves out what its tag, role or class marks
as surroundings and what fills a template slot of any level, and joins the blocks left. Names of tags and classes choose
nothing there: they only leave out what an article isn't, and an article that a page names refines a slot around it. They
choose alone where a group has less than CONTENT_PAGES different pages, so that nothing can be induced, and where the
article that a page names lies outside the slot.

Bounds: references are made of pages of at most REFERENCE_CHARS where a group has such. They are broadcast only if all of
them together are measured to be at most BROADCAST_CHARS, and else travel with the pages of their group by a join on the
group, which Spark can split where a host is hot. Reading a page takes time in proportion to its length; rows of
children that would take more than ALIGN_CELLS steps are matched greedily, and a matching looks ALIGN_DEPTH levels ahead.
Elements may be nested to any depth.

Where a page names several articles, the smallest node that holds all of them is read, so headings between them are too.

Defined results: null and empty pages give an empty text; pages with a null url share one empty host; broken markup is
read leniently, and a tag that never ends is text, with all after it; repeated rows give repeated results and count once
in the induction; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Steps, few_tasks, map_arrow, stored, table

REFERENCE_CHARS = 4096
REFERENCE_PAGES = 3
BROADCAST_CHARS = 16 << 20
ALIGN_DEPTH = 120
#: A slot is template if its text is that of the reference on this share of the group's different pages that have it, and on so many.
TEMPLATE_SHARE = 0.9
TEMPLATE_PAGES = 6
#: A node holds most of the varying text if it has this share of it; different pages that it takes to say so.
CONTENT_SHARE = 0.6
CONTENT_PAGES = 3
ALIGN_CELLS = 1 << 18

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>=]")
QUOTE = re.compile(r"""\s*+(["'])""")
ATTRIBUTE = re.compile(r"""(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
NOT_BLOCKS = INLINE | VOID
CLOSES_ITSELF = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
HEADINGS = frozenset("h1 h2 h3".split())
HOLDERS = frozenset("ul ol dl table article section div body main aside nav header footer form blockquote".split())
SURROUNDINGS = frozenset(
    "head nav header footer aside form script style noscript template iframe button select textarea input dialog menu title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that mark surroundings.
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget ad ads advert adverts "
    "advertisement advertising adbox banner promo promoted promotion sponsor sponsored cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist disqus replies reply respond pagination pager toolbar disclaimer".split()
)

OF_ARTICLE = frozenset("article entry post story content".split())


class Node:
    __slots__ = ("attrs", "children", "parts", "slot", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.parts, self.children, self.slot = tag, attrs, [], [], None

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(self.attrs)} if self.attrs else {}

    def surrounds(self) -> bool:
        """Whether its tag, role, class or id says that it isn't part of an article."""
        if self.tag in SURROUNDINGS:
            return True
        if not self.attrs:
            return False
        a = self.attributes()
        if a.get("role", "").lower() in ROLES:
            return True
        return any(self._marked(name) for name in (*a.get("class", "").split(), a.get("id", "")))

    @staticmethod
    def _marked(name: str) -> bool:
        words = {w.lower() for w in WORDS.findall(name)}
        # An article's own header holds its title.
        return not words.isdisjoint(MARKS) and not ("header" in words and not words.isdisjoint(OF_ARTICLE))

    def is_article(self) -> bool:
        return self.tag == "article" or (bool(self.attrs) and self.attributes().get("itemprop", "").lower() == "articlebody")

    def is_main(self) -> bool:
        return self.tag == "main" or (bool(self.attrs) and self.attributes().get("role", "").lower() == "main")


def next_tag(source: str, at: int, unpaired: set[str]) -> tuple[int, int, str, bool, str] | None:
    """Start, end, name (of comments and the like: empty), whether it ends an element, and attributes of the next tag.

    None if what is left is text. unpaired: quotes found to have no partner any more, so that none is looked for twice.
    """
    while (start := source.find("<", at)) >= 0:
        if source.startswith(("<!", "<?"), start):
            comment = source.startswith("<!--", start)
            end = source.find("-->" if comment else ">", start + (4 if comment else 2))
            if end < 0:
                return (start, len(source), "", False, "") if comment else None
            return start, end + (3 if comment else 1), "", False, ""
        name = NAME.match(source, start + 1)
        if name is None:
            at = start + 1
            continue
        at = name.end()
        while (stop := STOP.search(source, at)) and stop[0] == "=":
            at = stop.end()
            if (quote := QUOTE.match(source, at)) and quote[1] not in unpaired:
                close = source.find(quote[1], quote.end())
                at = close + 1 if close >= 0 else quote.end()
                if close < 0:
                    unpaired.add(quote[1])
        return (start, stop.end(), name[2].lower(), bool(name[1]), source[name.end() : stop.start()]) if stop else None
    return None


def raw_end(source: str, tag: str, at: int) -> tuple[int, int]:
    """Where the text of a raw element ends, and its end tag."""
    end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(source, at)
    return end.span() if end else (len(source), len(source))


def parse(source: str, names: list[str] | None = None) -> Node:
    """The tree of a page. Parts of a node are strings (text, references kept) and nodes, in order. names: gets the block
    tags as they come, ends with a slash."""
    root = Node("#page")
    stack = [root]
    # Where elements of each tag, and elements that hold others, stand on the stack: none is looked for one by one.
    open_at: dict[str, list[int]] = {}
    holders: list[int] = []

    def close(i: int) -> None:
        while len(stack) > i:
            tag = stack.pop().tag
            open_at[tag].pop()
            if tag in HOLDERS:
                holders.pop()

    def close_last(tags: Iterable[str]) -> None:
        """Close the innermost open element of these, with what is open inside it, unless an element that holds others is
        further in."""
        last = max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)
        if last > (holders[-1] if holders else 0):
            close(last)

    at, n = 0, len(source)
    unpaired: set[str] = set()
    while at < n:
        found = next_tag(source, at, unpaired)
        if found is None:
            stack[-1].parts.append(source[at:])
            break
        start, end, tag, closes, attrs = found
        if start > at:
            stack[-1].parts.append(source[at:start])
        at = end
        if not tag:
            continue
        if names is not None and tag not in NOT_BLOCKS and (closes or tag not in RAW):
            names.append(f"/{tag}" if closes else tag)
        if closes:
            if places := open_at.get(tag):
                close(places[-1])
            continue
        if tag not in INLINE:
            # A new block ends an open paragraph, with what is open inside it.
            paragraphs = open_at.get("p")
            if paragraphs and paragraphs[-1] > (holders[-1] if holders else 0):
                close(paragraphs[-1])
        if tag in CLOSES_ITSELF:
            close_last(CLOSES_ITSELF[tag])
        node = Node(tag, attrs)
        stack[-1].parts.append(node)
        if tag in RAW:
            stop, end = raw_end(source, tag, at)
            node.parts.append(source[at:stop])
            at = end
        elif tag not in VOID and not attrs.endswith("/"):
            if tag in open_at:
                open_at[tag].append(len(stack))
            else:
                open_at[tag] = [len(stack)]
            if tag in HOLDERS:
                holders.append(len(stack))
            stack.append(node)
    return root


def blocks(node: Node, leave_out) -> list[tuple[Node, str]]:
    """The blocks of text below a node: the block element that holds each, and its text."""
    out: list[tuple[Node, str]] = []
    run: list[str] = []

    def flush(holder: Node) -> None:
        if run:
            text = "".join(run)
            run.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((holder, text))

    # The parts that are left of each open node, and the block element that holds its text.
    todo = [(iter(node.parts), node)]
    while todo:
        parts, holder = todo[-1]
        for part in parts:
            if isinstance(part, str):
                run.append(part)
            elif part.tag == "br":
                run.append(" ")
            elif leave_out(part):
                if part.tag not in INLINE:
                    flush(holder)
            else:
                if part.tag not in INLINE:
                    flush(holder)
                todo.append((iter(part.parts), holder if part.tag in INLINE else part))
                break
        else:
            todo.pop()
            if not todo or todo[-1][1] is not holder:
                flush(holder)
    return out


def _elements(node: Node) -> list[Node]:
    """Block elements below, inline ones looked through."""
    out, todo = [], [iter(node.parts)]
    while todo:
        for part in todo[-1]:
            if isinstance(part, str):
                continue
            if part.tag in INLINE:
                todo.append(iter(part.parts))
                break
            if part.tag not in RAW:
                out.append(part)
        else:
            todo.pop()
    return out


def _tree(root: Node) -> list[Node]:
    """Fill children, and number the nodes from the top."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        x.slot = len(order)
        order.append(x)
        x.children = _elements(x)
        todo += reversed(x.children)
    return order


def _weight(a: Node, b: Node, known: dict, depth: int) -> int:
    """Size of the largest simple matching of two trees; below ALIGN_DEPTH children count as matched."""
    if a.tag != b.tag:
        return 0
    if not a.children or not b.children:
        return 1
    key = (a.slot, b.slot)
    if key not in known:
        small = len(a.children) * len(b.children) <= ALIGN_CELLS and depth < ALIGN_DEPTH
        known[key] = 1 + (_rows(a.children, b.children, known, depth + 1)[-1][-1] if small else min(len(a.children), len(b.children)))
    return known[key]


def _rows(left: list[Node], right: list[Node], known: dict, depth: int = 0) -> list[list[int]]:
    above = [0] * (len(right) + 1)
    rows = [above]
    for x in left:
        row, best = [0], 0
        for j, y in enumerate(right):
            w = _weight(x, y, known, depth)
            best = max(best, above[j + 1], above[j] + w) if w else max(best, above[j + 1])
            row.append(best)
        rows.append(row)
        above = row
    return rows


def align(page: Node, reference: Node) -> dict[int, int]:
    """Slots of the page's nodes to those of the reference's, by simple tree matching."""
    known: dict = {}
    out, todo = {}, [(page, reference)]
    while todo:
        a, b = todo.pop()
        out[a.slot] = b.slot
        if [x.tag for x in a.children] == [x.tag for x in b.children]:
            todo += zip(a.children, b.children, strict=True)
            continue
        if len(a.children) * len(b.children) > ALIGN_CELLS:
            rest = iter(b.children)
            todo += [(x, y) for x in a.children if (y := next((y for y in rest if y.tag == x.tag), None))]
            continue
        rows = _rows(a.children, b.children, known)
        i, j = len(a.children), len(b.children)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((a.children[i], b.children[j]))
    return out


def _has_text(node: Node) -> bool:
    return any(isinstance(p, str) and p.strip() for x in _iter(node) if x.tag not in RAW for p in x.parts)


def article_of(root: Node) -> tuple[Node, bool]:
    """The node that holds the main text, and whether the page names it as such. Of several the smallest node around all."""
    # By rank, articles before main elements: the first with text, the least height of the stack since, the node there.
    first: dict[int, Node] = {}
    low: dict[int, int] = {}
    around: dict[int, Node] = {}
    empty: dict[int, Node] = {}
    # The parts that are left of each open node, and whether it lies in a main element.
    todo = [(root, iter(root.parts), False)]
    while todo:
        x, parts, in_main = todo[-1]
        for part in parts:
            if isinstance(part, str) or part.tag in RAW:
                continue
            article = part.is_article() and not part.surrounds()
            main = not article and part.is_main()
            if article or main and not in_main:
                rank = 2 if article else 1
                if not _has_text(part):
                    empty.setdefault(rank, part)
                elif rank not in first:
                    first[rank], low[rank] = part, len(todo)
                else:
                    around[rank] = todo[low[rank] - 1][0]
            if article or not main and part.tag in ("nav", "aside", "footer", "head"):
                continue
            todo.append((part, iter(part.parts), in_main or main))
            break
        else:
            todo.pop()
            for rank in low:
                low[rank] = min(low[rank], len(todo))
    for rank in (2, 1):
        if rank in first or rank in empty:
            return around.get(rank) or first.get(rank) or empty[rank], True
    return next((x for x in _iter(root) if x.tag == "body"), root), False


def _iter(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        todo += [p for p in reversed(x.parts) if not isinstance(p, str)]


def _masses(root: Node) -> tuple[dict[int, int], dict[int, int]]:
    """The characters of text below each node, by id, and those of them that are in links."""
    chars: dict[int, int] = {}
    whole: dict[int, int] = {}
    linked: dict[int, int] = {}
    for x in reversed(list(_iter(root))):  # parts come before what holds them
        texts = [p for p in x.parts if isinstance(p, str)]
        nodes = [id(p) for p in x.parts if not isinstance(p, str)]
        whole[id(x)] = sum(map(len, texts)) + sum(map(whole.__getitem__, nodes))
        chars[id(x)] = (0 if x.tag in RAW else sum(len(p.strip()) for p in texts)) + sum(map(chars.__getitem__, nodes))
        linked[id(x)] = whole[id(x)] if x.tag == "a" else sum(map(linked.__getitem__, nodes))
    return chars, linked


def _hash(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()


def _texts(root: Node) -> dict[int, tuple[bytes, int]]:
    """A hash and the length of the text that each numbered node holds itself."""
    found: dict[int, list[str]] = {}
    for holder, text in blocks(root, lambda x: x.tag in RAW):
        if holder.slot is not None:
            found.setdefault(holder.slot, []).append(text)
    return {k: (_hash("\n".join(v)), sum(map(len, v))) for k, v in found.items()}


def merged(sources: list[str]) -> str:
    """One page that has the elements of all: those that one lacks are put in beside what they stand beside."""
    first = parse(sources[0])
    for source in sources[1:]:
        if source == sources[0]:
            continue
        other = parse(source)
        mine, theirs = _tree(first), _tree(other)
        pairs = {b: a for a, b in align(first, other).items()}
        for y in theirs:
            x, at = mine[pairs[y.slot]] if y.slot in pairs else None, 0
            if x is None:
                continue
            for part in y.children:
                if part.slot in pairs:
                    known = mine[pairs[part.slot]]
                    at = x.parts.index(known) + 1 if known in x.parts else at
                else:
                    x.parts.insert(at, part)
                    at += 1
    out: list[str] = []

    # Parts yet to be written, the next one last; end tags are among them.
    todo: list[Node | str] = list(reversed(first.parts))
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            out.append(f"<{part.tag}{part.attrs}>")
            if part.tag not in VOID:
                todo.append(f"</{part.tag}>")
            todo += reversed(part.parts)
    return "".join(out)


@dataclass(frozen=True)
class Wrapper:
    """A group's reference: its tree, the texts of template slots, and the content slot, without and with names' help."""

    root: Node
    template: dict[int, bytes]
    content: tuple[int | None, int | None]


#: References that a process keeps ready.
CACHED = 512


@lru_cache(maxsize=CACHED)
def _reference(source: str) -> tuple[Node, dict[int, tuple[bytes, int]]]:
    root = parse(source)
    _tree(root)
    return root, _texts(root)


def _content_slot(root: Node, varying: dict[int, int], named: bool) -> int | None:
    """The slot that holds the varying text (characters by slot); named: whether roles, classes and article tags help."""
    mass: dict[int, int] = {}
    for x in reversed(_tree(root)):
        if not (x.surrounds() if named else x.tag in SURROUNDINGS):
            mass[x.slot] = varying.get(x.slot, 0) + sum(mass.get(c.slot, 0) for c in x.children)
    node = root
    while True:
        if named and (node.is_article() or node.is_main()):
            break
        if named and sum(c.is_article() and mass.get(c.slot, 0) > 0 for c in node.children) > 1:
            break
        best = max(node.children, key=lambda c: mass.get(c.slot, 0), default=None)
        if best is None or not best.children or mass.get(best.slot, 0) < CONTENT_SHARE * mass.get(node.slot, 0):
            break
        if any(c.tag in HEADINGS and mass.get(c.slot, 0) for c in node.children):
            break
        node = best
    return node.slot if mass.get(node.slot) and node is not root else None


def rules(reference: str, slots: list[tuple[int, bool, int]]) -> str:
    """What a wrapper knows of its reference, as text: the content slots without and with names, and the template slots.

    slots: number, whether it is template, and the characters of varying text seen there.
    """
    root, texts = _reference(reference)
    varying = {k: chars for k, same, chars in slots if not same}
    content = [_content_slot(root, varying, named) for named in (False, True)]
    return ";".join(("" if c is None else str(c)) for c in content) + ";" + ",".join(str(k) for k, same, _ in slots if same and k in texts)


@lru_cache(maxsize=CACHED)
def wrapper(reference: str, said: str) -> Wrapper:
    root, texts = _reference(reference)
    *content, template = said.split(";")
    first, second = (int(c) if c else None for c in content)
    return Wrapper(root, {k: texts[k][0] for k in map(int, filter(None, template.split(",")))}, (first, second))


def main_text(source: str | None, *wrappers: Wrapper, named: bool = True) -> str:
    """The main text of a page; wrappers: those of its groups, the narrowest last. Without named, no role, class, article
    or main element has a say."""
    return extracted(source, *wrappers, named=named)[0]


def extracted(source: str | None, *wrappers: Wrapper, named: bool = True) -> tuple[str, bool]:
    """The main text of a page, and whether a wrapper chose where it is."""
    return _extracted(parse(source or ""), wrappers, named)


def _extracted(root: Node, wrappers: Sequence[Wrapper], named: bool) -> tuple[str, bool]:
    same: set[int] = set()
    content = None
    if wrappers:
        nodes = _tree(root)
        own = _texts(root) if any(x.template for x in wrappers) else {}
        for x in wrappers:
            pairs = align(root, x.root)
            if x.template:
                same |= {a for a, b in pairs.items() if b in x.template and a in own and own[a][0] == x.template[b]}
            slot = x.content[named]
            content = next((nodes[a] for a, b in pairs.items() if b == slot), content) if slot is not None else content
    return _main_text(root, same, content, named), content is not None


def _main_text(root: Node, same: set[int], content: Node | None, named: bool) -> str:
    """The main text of a parsed page without the slots that are template."""
    holder, told = article_of(root) if named else (root, False)
    if content is not None:
        inside = told and (content is holder or any(x is holder for x in _iter(content)))
        if not told or not inside and any(x is content for x in _iter(holder)):
            holder = content
        told = True
    # Needed only where no article is named.
    chars, links = ({}, {}) if told else _masses(holder)
    whole = chars.get(id(holder), 0)

    def leave_out(x: Node) -> bool:
        # Without a named article, what holds most of a page isn't its surroundings, whatever its class says.
        return x.tag in SURROUNDINGS or named and x.surrounds() and (told or 2 * chars[id(x)] <= whole)

    found = [(x, t) for x, t in blocks(holder, leave_out) if x.slot not in same or x.slot is None]
    if not told:
        found = [(x, t) for x, t in found if x is holder or x.tag == "p" or 2 * links[id(x)] <= len(t)]
    return "\n".join(t for _, t in found)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


CONTAINERS = frozenset("html body div section article main nav header footer aside form table center".split())
LEVELS = ("host", "outline", "layout")


def _shape(source: str) -> tuple[str, str]:
    """What follows what in a page: its containers, and all its block tags. A pair counts once, however often blocks repeat."""
    names, at, unpaired = [], 0, set()
    while found := next_tag(source, at, unpaired):
        _, at, tag, closes, _ = found
        if tag in RAW and not closes:
            at = raw_end(source, tag, at)[1]
        elif tag and tag not in NOT_BLOCKS:
            names.append(f"/{tag}" if closes else tag)
    return _shape_of(names)


def _shape_of(names: list[str]) -> tuple[str, str]:
    """The shape of a page whose block tags these are."""
    containers = [x for x in names if x.lstrip("/") in CONTAINERS]
    return tuple(_hash(" ".join(sorted({f"{a}>{b}" for a, b in pairwise(x)}))).hex() for x in (containers, names))


def _groups(host: str, shape: tuple[str, str]) -> tuple[str, str, str]:
    """The names of a page's groups, by level."""
    return host, f"{host}/{shape[0]}", f"{host}/{shape[0]}/{shape[1]}"


def grouped(pages: DataFrame) -> DataFrame:
    """pages with the groups of each page, a column for each level."""
    pages = pages.withColumn("host", host(F.col("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for source, name in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True):
                _, *below = _groups(name, _shape(source or ""))
                for column, x in zip(out, below, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in out)], names=[*batch.schema.names, *LEVELS[1:]])

    fields = [T.StructField(f.name, f.dataType) for f in pages.schema] + [T.StructField(x, T.StringType()) for x in LEVELS[1:]]
    return map_arrow(pages, run, T.StructType(fields))


def references(pages: DataFrame, steps: Steps) -> DataFrame:
    """level, name and reference of each group; of outlines and layouts those that divide a group and can show a template."""
    source = F.coalesce("html", F.lit(""))
    # Different pages by chance, short ones first.
    chance = lambda i: F.struct(F.length(source) > REFERENCE_CHARS, F.xxhash64(source, F.lit(i)))
    parts = range(REFERENCE_PAGES)
    rows = grouped(pages.select("url", "html"))
    rows, _ = steps.store(rows.groupBy(*LEVELS).agg(F.count("*").alias("rows"), *(F.min(chance(i)).alias(f"place_{i}") for i in parts), *(F.min_by(source, chance(i)).alias(f"page_{i}") for i in parts)), few_tasks(pages.sparkSession))
    found, above = None, None
    for i, level in enumerate(LEVELS):
        part = rows.groupBy(*LEVELS[max(0, i - 1) : i + 1]).agg(F.sum("rows").alias("rows"), F.array_distinct(F.array(*(F.min_by(f"page_{k}", f"place_{k}") for k in parts))).alias("found"))
        if i:
            part = part.join(above, LEVELS[i - 1]).where((F.col("rows") >= TEMPLATE_PAGES) & (F.col("rows") < F.col("rows_above")))
        part = part.where(F.col("rows") >= CONTENT_PAGES).select(F.lit(i).alias("level"), F.col(level).alias("name"), "found")
        found = part if found is None else found.unionByName(part)
        above = rows.groupBy(level).agg(F.sum("rows").alias("rows_above"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("level"), batch.column("name"), pa.array([merged(x) for x in batch.column("found").to_pylist()], pa.string())], names=["level", "name", "reference"])

    return map_arrow(found, run, "level int, name string, reference string")


def over_groups(pages: DataFrame, of_groups: DataFrame, values: tuple[str, ...], carried: tuple[str, ...], use, schema: pa.Schema, ddl: str) -> DataFrame:
    """The rows that use(carried values, root, groups, found) gives for each page: its parsed tree, the names of its groups,
    and for each level the values that of_groups (a stored table of level, name and values) has for that group, or None."""
    size = of_groups.agg(F.coalesce(F.sum(F.length("reference") + 64), F.lit(0))).first()[0]
    shared = None
    if size <= BROADCAST_CHARS:
        shared = pages.sparkSession.sparkContext.broadcast({(r["level"], r["name"]): tuple(r[v] for v in values) for r in of_groups.collect()})
        pages = pages.withColumn("host", host(F.col("url"))).select("host", "html", *(F.col(c).alias(f"_{c}") for c in carried))
    else:
        pages = grouped(pages.select("url", "html", *(F.col(c).alias(f"_{c}") for c in carried)))
        for i, level in enumerate(LEVELS):
            part = of_groups.where(F.col("level") == i).select(F.col("name").alias(level), F.struct(*values).alias(f"found_{i}"))
            pages = pages.join(part, level, "left")
    joined = [f"found_{i}" for i in range(len(LEVELS))] if shared is None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            columns = [batch.column(c).to_pylist() for c in ("html", "host", *(f"_{c}" for c in carried), *joined)]
            for source, name, *rest in zip(*columns, strict=True):
                names: list[str] = []
                root = parse(source or "", names)
                groups = _groups(name, _shape_of(names))
                if shared is None:
                    found = [None if x is None else tuple(x[v] for v in values) for x in rest[len(carried) :]]
                else:
                    found = [shared.value.get((i, group)) for i, group in enumerate(groups)]
                for row in use(rest[: len(carried)], root, groups, found):
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return map_arrow(pages, run, ddl)


def _votes(root: Node, nodes: list[Node], own: dict[int, tuple[bytes, int]], reference: str) -> dict[int, tuple[bool | None, int]]:
    """Of each slot of the reference whether the page has the same text there (None: one of them has none), and how many
    characters the page has there, or below it in nodes of its own."""
    other, texts = _reference(reference)
    pairs = align(root, other)
    out: dict[int, tuple[bool | None, int]] = {}
    at: dict[int, int] = {}
    for x in nodes:
        slot = at[x.slot] = pairs.get(x.slot, at.get(x.slot, 0))
        for child in x.children:
            at[child.slot] = slot
        if x.slot in own or x.slot in pairs and slot in texts:
            digest, chars = own.get(x.slot, (None, 0))
            same, before = out.get(slot, (None, 0))
            if x.slot in pairs and slot in texts:
                same = digest == texts[slot][0]
            out[slot] = same, before + chars
    return out


def wrappers(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """level, name, reference and rules of the groups that have enough different pages."""

    def votes(_, root: Node, groups: tuple, found: list) -> Iterator[tuple]:
        nodes = _tree(root)
        own = _texts(root)
        page = int.from_bytes(_hash("".join(f"{k}{v[0].hex()}" for k, v in own.items())), "little", signed=True)
        known: dict[str, dict] = {}
        for i, (name, ref) in enumerate(zip(groups, found, strict=True)):
            if ref is None:
                continue
            if ref[0] not in known:
                known[ref[0]] = _votes(root, nodes, own, ref[0])
            for slot, (same, chars) in known[ref[0]].items():
                yield i, name, slot, page, None if same is None else int(same), chars

    schema = pa.schema([("level", pa.int32()), ("name", pa.string()), ("slot", pa.int32()), ("page", pa.int64()), ("same", pa.int32()), ("chars", pa.int64())])
    found = over_groups(pages, refs, ("reference",), (), votes, schema, "level int, name string, slot int, page long, same int, chars long")
    # Pages with the same text count once; groups are spread by page before they are counted.
    counts = found.groupBy("level", "name", "slot", "page").agg(F.max("same").alias("same"), F.max("chars").alias("chars"))
    counts = counts.groupBy("level", "name", "slot").agg(F.count("*").alias("pages"), F.count("same").alias("voting"), F.sum("same").alias("same"), F.sum("chars").alias("chars"))
    template = F.coalesce((F.col("same") >= TEMPLATE_PAGES) & (F.col("same") >= TEMPLATE_SHARE * F.col("voting")), F.lit(False))
    slots = counts.groupBy("level", "name").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(F.struct("slot", template.alias("template"), "chars"))).alias("slots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [rules(ref, [(x["slot"], x["template"], x["chars"]) for x in slots]) for ref, slots in zip(batch.column("reference").to_pylist(), batch.column("slots").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("level", "name", "reference")), pa.array(said, pa.string())], names=["level", "name", "reference", "rules"])

    joined = refs.join(slots.where(F.col("pages") >= CONTENT_PAGES).drop("pages"), ["level", "name"])
    return map_arrow(joined.select("level", "name", "reference", "slots"), run, "level int, name string, reference string, rules string")


def extract(pages: DataFrame, named: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, and by_wrapper (whether a wrapper chose where the text is) of every row."""
    steps = Steps(pages.sparkSession)
    refs, _ = steps.store(references(pages, steps), few_tasks(pages.sparkSession))
    found = stored(wrappers(pages, refs), few_tasks(pages.sparkSession))
    steps.clear()

    def main(carried: list, root: Node, _, found: list) -> Iterator[tuple]:
        text, chosen = _extracted(root, [wrapper(*x) for x in found if x is not None], named)
        yield *carried, text, len(text), chosen

    id_type = pages.schema["page_id"].dataType
    schema = pa.schema([("page_id", to_arrow_type(id_type)), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("by_wrapper", pa.bool_())])
    ddl = f"page_id {id_type.simpleString()}, url string, text string, n_chars long, by_wrapper boolean"
    return over_groups(pages, found, ("reference", "rules"), ("page_id", "url"), main, schema, ddl)


def op3_wrapper_induction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
