"""HTML to a tree of blocks and texts.

The parser keeps what text extraction needs of the HTML rules: void elements, raw text, implied end
tags, scopes of table cells, end tags without a start, and tags that never end. It reads every page
once from left to right and takes time in proportion to its length, however deep or broken it is.

Nodes are block elements, inline elements with a telling name, and texts. Scripts, styles, comments
and whatever else is never shown have no nodes.
"""

from __future__ import annotations

import re
from html import unescape

# What a node is. The named kinds come first; the name or tag that gives them is in the lists below.
KINDS = (
    "article", "main", "menu", "header", "footer", "side", "notice", "advert", "form", "comment",
    "root", "heading", "paragraph", "list", "item", "table", "quote", "figure", "other", "text",
)
KIND = {name: i for i, name in enumerate(KINDS)}
NAMED = KIND["comment"] + 1
OTHER, TEXT, ROOT = KIND["other"], KIND["text"], KIND["root"]
ARTICLE, MAIN = KIND["article"], KIND["main"]

# Names in class, id and role, and the kind they stand for.
NAMES = {
    "main": "article content main post entry story",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead topbar banner",
    "footer": "footer copyright colophon contentinfo",
    "side": "sidebar aside complementary related recommended widget rail share social",
    "notice": "notice cookie cookies consent gdpr popup modal overlay dialog alert alertdialog "
    "newsletter subscribe paywall hidden",
    "advert": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion",
    "form": "form search searchbox login signup",
    "comment": "comment comments respond replies disqus",
}
# Tags and the kind they stand for.
TAGS = {
    "article": "article",
    "main": "main",
    "menu": "nav menu",
    "header": "header",
    "footer": "footer",
    "side": "aside",
    "notice": "dialog",
    "form": "form fieldset button select datalist option optgroup label legend output",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "paragraph": "p",
    "list": "ul ol dl dir",
    "item": "li dt dd",
    "table": "table caption thead tbody tfoot tr td th",
    "quote": "blockquote pre",
    "figure": "figure figcaption picture",
}
# The HTML standard's element classes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var nobr img wbr input".split()
)
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dt dd main menu nav ol p pre search section "
    "summary table ul".split()
)
SCOPE = set("html body table td th caption button object marquee applet".split())
# A start tag on the left ends the open elements on the right, up to one of the last group.
_IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
    "tr": ("tr", "table thead tbody tfoot"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "thead": ("thead tbody tfoot", "table"),
    "tbody": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody tfoot", "table"),
    "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"),
}
IMPLIED = {k: (set(a.split()), set(b.split())) for k, (a, b) in _IMPLIED.items()}
_CELLS, _TABLE = {"td", "th", "caption"}, set("table thead tbody tfoot tr td th caption".split())

_NAME_KIND = {w: KIND[kind] for kind, listed in NAMES.items() for w in listed.split()}
_TAG_KIND = {w: KIND[kind] for kind, listed in TAGS.items() for w in listed.split()}
# Words before a name that turn its sense: "no-sidebar", "has-ads"; and after one: "comments-open".
_TURNED = {"no", "without", "has", "with"}
_STATES = {"open", "closed", "off", "count"}

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_MARKED = re.compile(
    r"""(?:^|[\s"'/])(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""",
    re.I,
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def name_kind(tag: str, attributes: str) -> int | None:
    """The kind that tag and attributes name, None where they name none."""
    own = _TAG_KIND.get(tag)
    if not attributes or tag in ("html", "body"):
        return own
    found = set()
    for match in _MARKED.finditer(attributes):
        key, value = match[1].lower(), (match[2] or "").strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            found.add(KIND["notice"])
        elif key == "style":
            if "display:none" in value.replace(" ", "").lower():
                found.add(KIND["notice"])
        elif key != "aria-hidden":
            for name in value.split():
                parts = [p.lower() for p in _PARTS.findall(name)]
                for i, part in enumerate(parts):
                    if part not in _NAME_KIND or (i and parts[i - 1] in _TURNED):
                        continue
                    if i + 1 < len(parts) and parts[i + 1] in _STATES:
                        continue
                    found.add(_NAME_KIND[part])
    if own == ARTICLE:
        # an article among others may be a reader's comment; its other names are states of the site
        return KIND["comment"] if KIND["comment"] in found else own
    if own is not None and own < NAMED and own != MAIN:
        return own
    drops = found - {MAIN}
    return min(drops) if drops else MAIN if found and tag not in INLINE else own


class Forest:
    """The trees of many pages in flat lists; every page begins with a root node."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.level: list[int] = []
        self.kind: list[int] = []
        self.roots: list[int] = []
        # of texts: the node, the decoded text, if a block begins before it, and if it is a link
        self.text_node: list[int] = []
        self.text: list[str] = []
        self.begins: list[bool] = []
        self.linked: list[bool] = []

    def node(self, kind: int, parent: int) -> int:
        self.parent.append(parent)
        self.level.append(self.level[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        return len(self.kind) - 1

    def add(self, html: str | None) -> None:
        root = self.node(ROOT, -1)
        self.roots.append(root)
        if html:
            _Page(self, root).read(html)


class _Page:
    def __init__(self, forest: Forest, root: int):
        self.forest = forest
        # open elements: (tag, node); inline ones without a name share the node around them
        self.open: list[tuple[str, int]] = [("", root)]
        self.count: dict[str, int] = {}
        self.link: int | None = None
        self.begins = True

    def read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                lt = end
            if lt > at:
                self.put(html[at:lt])
            if lt == end:
                break
            at = self.markup(html, lt)

    def markup(self, html: str, lt: int) -> int:
        """Take what begins with the ``<`` at ``lt``; returns where the text goes on."""
        after = html[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if html.startswith("<!--", lt):
                if html.startswith(("<!-->", "<!--->"), lt):
                    return html.index(">", lt) + 1
                close = html.find("-->", lt + 4)
                return len(html) if close < 0 else close + 3
            close = html.find(">", lt)
            return len(html) if close < 0 else close + 1
        if not after.isascii() or not (after.isalpha() or after == "/"):
            self.put("<")
            return lt + 1
        tag = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if tag is None:
            if after == "/" and not html[lt + 2 : lt + 3].isalpha():
                close = html.find(">", lt)  # an end tag without a name is a comment
                return len(html) if close < 0 else close + 1
            return len(html)  # a tag that never ends
        name = tag[2].lower()
        if tag[1]:
            self.end(name)
            return tag.end()
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(html, tag.end())
            if name not in ("script", "style", "template"):
                self.begins = True
            return len(html) if close is None else close.end()
        self.start(name, tag[3])
        return tag.end()

    def put(self, raw: str) -> None:
        forest = self.forest
        text = unescape(raw) if "&" in raw else raw
        node, linked = self.open[-1][1], self.link is not None
        if (
            not self.begins
            and forest.text_node
            and forest.linked[-1] == linked
            and forest.parent[forest.text_node[-1]] == node
        ):
            forest.text[-1] += text
            return
        if not self.begins or not text.isspace():
            forest.text_node.append(forest.node(TEXT, node))
            forest.text.append(text)
            forest.begins.append(self.begins)
            forest.linked.append(linked)
            self.begins = False

    def push(self, tag: str, node: int) -> None:
        self.open.append((tag, node))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop_to(self, place: int) -> None:
        """Close the open elements from ``place`` on."""
        while len(self.open) > place:
            tag, _ = self.open.pop()
            self.count[tag] -= 1
            if tag not in INLINE:
                self.begins = True
        if self.link is not None and self.link >= len(self.open):
            self.link = None

    def close(self, tags: set[str], until: set[str]) -> None:
        """End the innermost open element of ``tags`` that lies inside the nearest ``until``."""
        if any(self.count.get(tag) for tag in tags):
            for place in range(len(self.open) - 1, 0, -1):
                if self.open[place][0] in tags:
                    self.pop_to(place)
                    return
                if self.open[place][0] in until:
                    return

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.begins = True
            return
        if tag in ENDS_P:
            self.close({"p"}, SCOPE)
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        inline = tag in INLINE
        if not inline:
            self.begins = True
        if tag in VOID:
            return
        kind = name_kind(tag, attributes)
        node = self.open[-1][1]
        if tag in ("html", "head", "body"):
            return
        if not inline or kind is not None:
            node = self.forest.node(OTHER if kind is None else kind, node)
        if tag == "a":
            if self.count.get("a"):
                self.end("a")
            self.link = len(self.open)
        self.push(tag, node)

    def end(self, tag: str) -> None:
        inline = tag in INLINE
        if not inline:
            self.begins = True
        if not self.count.get(tag):
            return
        for place in range(len(self.open) - 1, 0, -1):
            if self.open[place][0] == tag:
                self.pop_to(place)
                return
            if inline and self.open[place][0] not in INLINE:
                return  # an inline element ends inside its block at the latest
            if self.open[place][0] in _CELLS and tag not in _TABLE:
                return


def page_text(pieces: list[tuple[bool, str]]) -> str:
    """Texts in page order, blanks as one space; (a block begins, text)."""
    return " ".join("".join((" " if begins else "") + text for begins, text in pieces).split())
