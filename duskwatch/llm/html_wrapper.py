"""Main text of web pages by wrapper induction.

The DOM trees of the pages of a host are aligned by simple tree matching into one
wrapper tree. A node of the wrapper knows how many pages have it and a few of the texts
seen in it: a text that never changes is template, slots that vary are content. Each
page is then aligned with its host's wrapper and loses the template; what is a menu,
header, footer, advert and so on by its element, role or class goes as well, for such
parts often vary from page to page. What is only thought so (a form, a word of the class)
stays if it holds an article of more than half the page's words or if the wrapper shows long varying text in it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import INLINE, Element, blocks, of_readers, parse, unlinked_words
from .tables import by_batch, stored
from .url_filter import url_host

# A text is template if so many different pages and such a share of the host's pages have
# it and all say the same, and content somewhere on them has at least as many different texts.
LEAST_PAGES = 5
LEAST_SHARE = 0.01
# Words outside links that a form or an element with a telling word has on a page, on
# average, if it is main text all the same.
LONG_WORDS = 50
# Wrappers of a host are merged in so many parts first, then the parts.
PARTS = 32
# Inner elements that are too fine for a wrapper.
_DEPTH = 40


class Node:
    """A wrapper node: ``texts`` holds up to LEAST_PAGES different digests of its own text.

    ``heads`` holds as many of what names the different pages that have it. The texts of a ``soft`` node are of all text in it, and ``words`` counts its words outside links.
    """

    __slots__ = ("key", "pages", "many", "texts", "children", "words", "soft", "heads")

    def __init__(
        self, key: str, pages: int, many: bool, texts: list[int], children: list[Node], words: int = 0, soft: bool = False,
        heads: list[int] = (),
    ):
        self.key, self.pages, self.many, self.texts, self.children = key, pages, many, texts, children
        self.words, self.soft, self.heads = words, soft, heads

    def pack(self) -> list:
        return [self.key, self.pages, int(self.many), self.texts, [c.pack() for c in self.children], self.words, int(self.soft), list(self.heads)]

    @classmethod
    def unpack(cls, data: list) -> Node:
        return cls(data[0], data[1], bool(data[2]), data[3], [cls.unpack(c) for c in data[4]], data[5], bool(data[6]), data[7])


def _digest(said: str) -> int:
    return xxhash.xxh3_64_intdigest(said.encode("utf-8", "surrogatepass")) >> 1


def page_head(root: Element) -> int:
    """What names a page: its title, else the text; near copies have one title."""
    said = [root.title] if root.title else blocks(root)
    if not said:
        soft, todo = set(), [root]
        while todo:
            e = todo.pop()
            if e.soft:
                soft.add(id(e))
            todo.extend(c for c in e.children if not isinstance(c, str))
        said = blocks(root, keep=soft)
    return _digest("\n".join(said))


def wrapper_of(element: Element, depth: int = 0) -> tuple[Node, dict[int, Element]]:
    """The wrapper of one page, and the element each node stands for (by ``id`` of the node)."""
    owner: dict[int, Element] = {}
    head = page_head(element)

    def build(e: Element, depth: int) -> Node:
        text: list[str] = []
        children: list[Node] = []
        for c in e.children:
            if isinstance(c, str):
                text.append(c)
            elif c.dropped:
                if c.soft and c.tag not in INLINE and depth < _DEPTH:
                    children.append(build(c, depth + 1))
            elif c.tag in INLINE or depth >= _DEPTH:
                text += blocks(c)
            else:
                children.append(build(c, depth + 1))
        if e.soft:
            text = blocks(e, keep={id(e)})
        said = " ".join(" ".join(text).split())
        node = Node(
            e.key, 1, False, [_digest(said)] if said else [], children, unlinked_words(e) if e.soft else 0, e.soft, [head]
        )
        owner[id(node)] = e
        return node

    return build(element, depth), owner


def _folded(children: list[Node]) -> list[Node]:
    """Runs of siblings of the same key as one repeated node."""
    out: list[Node] = []
    for c in children:
        if out and out[-1].key == c.key:
            last = out[-1]
            out[-1] = merge(last, c, same_page=True)
        else:
            out.append(c)
    return out


def fold(node: Node) -> Node:
    return Node(node.key, node.pages, node.many, node.texts, _folded([fold(c) for c in node.children]), node.words, node.soft, node.heads)


def _score(a: Node, b: Node) -> int:
    """Simple tree matching: nodes in the largest order-keeping match of two trees of one key."""
    if a.key != b.key:
        return 0
    return 1 + (_align(a.children, b.children)[0] if a.children and b.children else 0)


def _align(xs: list[Node], ys: list[Node]) -> tuple[int, list[tuple[int, int]]]:
    """(matched nodes, matched places) of two lists of siblings."""
    if [x.key for x in xs] == [y.key for y in ys]:
        # the usual case: every sibling has its partner
        return len(xs), [(i, i) for i in range(len(xs))]
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    score = [[_score(x, y) for y in ys] for x in xs]
    for i in range(len(xs) - 1, -1, -1):
        for j in range(len(ys) - 1, -1, -1):
            best = max(table[i + 1][j], table[i][j + 1])
            if score[i][j]:
                best = max(best, table[i + 1][j + 1] + score[i][j])
            table[i][j] = best
    pairs, i, j = [], 0, 0
    while i < len(xs) and j < len(ys):
        if score[i][j] and table[i][j] == table[i + 1][j + 1] + score[i][j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif table[i][j] == table[i + 1][j]:
            i += 1
        else:
            j += 1
    return table[0][0], pairs


def merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """One wrapper of two of the same key; nodes without a partner are kept in order."""
    pairs = _align(a.children, b.children)[1]
    children, i, j = [], 0, 0
    for x, y in [*pairs, (len(a.children), len(b.children))]:
        children += a.children[i:x] + b.children[j:y]
        if x < len(a.children) and y < len(b.children):
            children.append(merge(a.children[x], b.children[y], same_page))
        i, j = x + 1, y + 1
    texts = list(dict.fromkeys([*a.texts, *b.texts]))
    pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    # the smallest digests are kept, so the order of merging does not matter
    heads = sorted({*a.heads, *b.heads})[:LEAST_PAGES]
    return Node(
        a.key, pages, a.many or b.many or same_page, sorted(texts)[:LEAST_PAGES], children, a.words + b.words, a.soft, heads
    )


def merge_all(wrappers: Iterable[Node]) -> Node:
    done: Node | None = None
    for w in wrappers:
        done = w if done is None else merge(done, w)
    return done


def _dropped(node: Node) -> bool:
    """Soft, and not shown to be main text."""
    return node.soft and (
        node.many or len(node.texts) < LEAST_PAGES or node.words < LONG_WORDS * node.pages
        or of_readers(node.key)
    )


def _varies(node: Node) -> bool:
    return not _dropped(node) and (len(node.texts) >= LEAST_PAGES or any(_varies(c) for c in node.children))


def _is_template(node: Node, least: float) -> bool:
    """Do ``least`` pages have it, LEAST_PAGES different ones, and all say the same? An article never is."""
    return (
        node.pages >= least and len(node.heads) >= LEAST_PAGES and not node.many and len(node.texts) <= 1
        and node.key.split(" ")[0] != "article"
        and all(_dropped(c) or _is_template(c, least) for c in node.children)
    )


def _says_something(node: Node) -> bool:
    return not _dropped(node) and (bool(node.texts) or any(_says_something(c) for c in node.children))


def _judged_elements(page: Node, owner: dict[int, Element], wrapper: Node) -> tuple[set[int], set[int]]:
    """``id()`` of the page's elements that are template by the wrapper, and of soft ones that are not."""
    out: set[int] = set()
    keep: set[int] = set()
    if not _varies(wrapper):
        return out, keep

    def walk(p: Node, w: Node, inside: bool) -> None:
        if _dropped(w):
            return
        inside |= owner[id(p)].tag == "article"
        if w.soft:
            keep.add(id(owner[id(p)]))
        elif not inside and _is_template(w, LEAST_SHARE * wrapper.pages) and _says_something(w):
            out.add(id(owner[id(p)]))
            return
        # repeated nodes of the wrapper stand for a run of the page's
        heads = [i for i, c in enumerate(p.children) if not i or p.children[i - 1].key != c.key]
        for i, j in _align([p.children[i] for i in heads], w.children)[1]:
            if not w.children[j].many:
                walk(p.children[heads[i]], w.children[j], inside)

    walk(page, wrapper, False)
    return out, keep


def _main_parts(root: Element, keep: set[int]) -> list[Element]:
    """Outermost article elements, else main elements, else the whole page."""
    for wanted in (lambda e: e.tag == "article", lambda e: e.tag == "main" or "role=main" in e.key.split(" ")):
        found, todo = [], [root]
        while todo:
            e = todo.pop()
            if isinstance(e, str) or e.dropped and id(e) not in keep:
                continue
            if wanted(e):
                found.append(e)
            else:
                todo.extend(reversed(e.children))
        if found:
            return found
    return [root]


def extract(page: str | None, wrapper: Node | None) -> str:
    """The main text of a page: its blocks joined by newlines; empty if there is none."""
    root = parse(page)
    skip, keep = set(), set()
    if wrapper is not None:
        own, owner = wrapper_of(root)
        skip, keep = _judged_elements(own, owner, wrapper)
    return "\n".join(b for part in _main_parts(root, keep) for b in blocks(part, skip, keep))


def induce_wrappers(pages: DataFrame, host_column: str, html_column: str) -> DataFrame:
    """(host, wrapper): one wrapper per host, as JSON, aligned from all its pages.

    Pages are merged by host inside every batch first; the wrappers of one host are then
    merged in up to ``PARTS`` parts and these at last. A wrapper has a node for every
    place met, however many pages there are, so that no task holds the pages of a host.
    """

    def induce(batch: pa.RecordBatch) -> pa.RecordBatch:
        done: dict[str, Node] = {}
        for host, page in zip(batch.column("h").to_pylist(), batch.column("p")):
            own = fold(wrapper_of(parse(page.as_py()))[0])
            done[host] = merge(done[host], own) if host in done else own
        packed = [json.dumps(w.pack()) for w in done.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(done)), pa.array(packed)], ["host", "wrapper"])

    def join_parts(group: pd.DataFrame) -> pd.DataFrame:
        whole = merge_all(Node.unpack(json.loads(w)) for w in sorted(group["wrapper"]))
        return pd.DataFrame({"host": group["host"].iloc[:1].to_numpy(), "wrapper": [json.dumps(whole.pack())]})

    rows = pages.select(pages[host_column].alias("h"), pages[html_column].alias("p"))
    first = by_batch(rows, induce, "host string, wrapper string")
    schema = "host string, wrapper string"
    parts = first.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS))).groupBy("host", "part")
    return parts.applyInPandas(join_parts, schema).groupBy("host").applyInPandas(join_parts, schema)


def extract_main_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars), one row per row of ``pages``.

    A null html is an empty page and gives an empty text; a null or odd url is of the
    host "". Repeated rows stay, rows with the same id are pages of their own, other
    columns are ignored, an empty table gives an empty table. Hosts with fewer than
    ``LEAST_PAGES`` pages have no template but what elements and classes tell.
    """
    hosted = pages.select(
        pages[id_column].alias("i"), pages[url_column].alias("u"), pages[html_column].alias("p"),
        url_host(pages[url_column]).alias("host"),
    )
    wrappers = stored(induce_wrappers(hosted, "host", "p"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for batch in batches:
            texts = []
            for host, packed, page in zip(*(batch.column(c) for c in ("host", "wrapper", "p"))):
                name = host.as_py()
                if name not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[name] = Node.unpack(json.loads(packed.as_py())) if packed.is_valid else None
                texts.append(extract(page.as_py(), known[name]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), batch.column("u"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_column, url_column, "text", "n_chars"],
            )

    kinds = [hosted.schema[c].dataType.simpleString() for c in ("i", "u")]
    schema = f"`{id_column}` {kinds[0]}, `{url_column}` {kinds[1]}, text string, n_chars bigint"
    return hosted.join(wrappers, "host", "left").select("i", "u", "p", "host", "wrapper").mapInArrow(read, schema)
