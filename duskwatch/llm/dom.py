"""A small DOM for main-text extraction: a tolerant parser and the roles of elements."""

from __future__ import annotations

import html
import re

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s"
    " samp small span strike strong sub sup time tt u var wbr br".split()
)
# Of the dropped ones, those that do not break the line they stand in.
_INSIDE_LINES = RAW | frozenset("button select input svg canvas object audio video".split())
# An open element of the key is closed by the start of one of its values.
_BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY = {
    "p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
    "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]), "head": frozenset(["body"]),
}
# Elements within which an implied end is not looked for further out.
_SCOPES = {
    "p": frozenset("td th table button caption".split()), "li": frozenset(["ul", "ol", "menu"]),
    "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]),
    "th": frozenset(["table"]), "thead": frozenset(["table"]), "tbody": frozenset(["table"]),
    "option": frozenset(["select", "datalist"]), "head": frozenset(),
}
# What is never main text: by element, by ARIA role, by a word of class or id.
BOILERPLATE = RAW | frozenset(
    "head nav header footer aside form button select input menu dialog svg canvas object audio video".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar menu nav"
    " navbar navigation breadcrumb breadcrumbs header masthead footer notice notices cookie cookies consent gdpr"
    " popup modal newsletter subscribe signup comment comments commentlist disqus respond replies reply discussion"
    " share sharing social related widget login".split()
)
# Of these, those for what readers write: it may be long and varies too, but is never main text.
READERS = frozenset("comment comments commentlist disqus respond replies".split())
_NEVER_BY_WORD = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")


class Element:
    """``key`` names the element for alignment: tag, id and class.

    ``dropped`` elements are no main text; ``soft`` ones are only thought so, since they
    are a form or carry a word. The root knows the page's ``title``.
    """

    __slots__ = ("tag", "key", "dropped", "soft", "children", "title")

    def __init__(self, tag: str, attributes: str = "", in_article: bool = False):
        self.tag, self.key, self.children, self.title = tag, tag, [], ""
        # the header of an article is its title and lead, not the page's
        self.dropped, self.soft = tag in BOILERPLATE and not (in_article and tag == "header"), tag == "form"
        if attributes and "=" in attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            if found:
                self.key = " ".join([tag, *(f"{k}={v}" for k, v in sorted(found.items()))])
                if tag not in _NEVER_BY_WORD:
                    # camelCase names are words too
                    said = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}")
                    role = found.get("role", "").lower()
                    own = {"header"} if in_article else set()
                    word = not WORDS.isdisjoint({w.lower() for w in _WORD.findall(said)} - own)
                    sure = self.dropped and not self.soft or role in ROLES and role != "form"
                    self.dropped |= role in ROLES or word
                    self.soft = self.dropped and not sure

    @property
    def main(self) -> bool:
        return self.tag in ("article", "main") or "role=main" in self.key.split(" ")


def parse(page: str | None) -> Element:
    """The tree under a root element; texts are decoded strings among the children.

    Soft elements around an article or main element are not dropped if they hold more than
    half of the page's words, so that the article is the page's and not a teaser.
    """
    root = Element("#root")
    # the soft elements around each article or main element that no other dropped one holds
    around: list[list[Element]] = []
    stack = [root]
    at = 0
    page = page or ""
    while at < len(page):
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        if found[2] is None:
            if found[0].startswith("<![CDATA["):
                stack[-1].children.append(found[0][9:].removesuffix("]]>"))
            continue
        tag = found[2].lower()
        if found[1]:
            _close(stack, tag)
            continue
        _imply_ends(stack, tag)
        element = Element(tag, found[3], any(e.tag == "article" for e in stack))
        if element.main and all(e.soft or not e.dropped for e in [*stack, element]):
            around.append([e for e in [*stack, element] if e.soft])
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if tag == "title" and not root.title:
                root.title = " ".join(page[at : end.start() if end else len(page)].split())
            at = end.end() if end else len(page)
        elif tag not in VOID and not found[3].rstrip().endswith("/") or tag in CLOSED_BY:
            stack.append(element)
    if any(around):
        whole = unlinked_words(root)
        for softs in around:
            if softs and not any(map(of_readers, (e.key for e in softs))) and 2 * unlinked_words(softs[0]) > whole:
                for e in softs:
                    e.dropped = e.soft = False
    return root


def of_readers(key: str) -> bool:
    """Is this an element for what readers write?"""
    return any(w.lower() in READERS for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", key)))


def unlinked_words(element: Element) -> int:
    """Words outside links, those of soft elements as well."""
    n, todo = 0, [*element.children]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            n += len(e.split())
        elif e.tag != "a" and (e.soft or not e.dropped):
            todo.extend(e.children)
    return n


def _close(stack: list[Element], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        # an inline end tag does not close blocks around it
        if tag in INLINE and stack[i].tag not in INLINE:
            return


def _imply_ends(stack: list[Element], tag: str) -> None:
    for open_tag, closers in CLOSED_BY.items():
        if tag in closers:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == open_tag:
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPES[open_tag] or (open_tag == "p" and stack[i].tag in _BLOCKS):
                    break


def blocks(element: Element, skip: set[int] = frozenset(), keep: set[int] = frozenset()) -> list[str]:
    """Texts of the blocks in page order: white space is one space, nothing empty.

    Dropped elements whose ``id()`` is not in ``keep`` and those in ``skip`` are left out.
    """
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    # an explicit stack: pages may be nested deeper than Python calls
    todo: list = [element]
    while todo:
        node = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            line.append(node)
        elif node.dropped and id(node) not in keep or id(node) in skip:
            if node.tag not in INLINE and node.tag not in _INSIDE_LINES:
                flush()
        elif node.tag in INLINE:
            if node.tag == "br":
                line.append(" ")
            todo.extend(reversed(node.children))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(node.children))
    flush()
    return out
