"""Pages as trees of blocks: tokens, implied end tags, and what an element is by its name, role and class."""

from __future__ import annotations

import html
import re

#: Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp template textarea title svg object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body head html caption dd dt legend li summary tbody td tfoot th thead tr".split()) | {"hr"}
#: What an open tag closes first, and where that search ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
} | {h: ({"h1", "h2", "h3", "h4", "h5", "h6"}, {"div", "section", "article"}) for h in ("h1", "h2", "h3", "h4", "h5", "h6")}

#: What is no part of an article: element names, roles, and words in class or id.
DROPPED = frozenset("nav footer aside form search dialog menu button select datalist head".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv nav aside side rail notice notices alert alerts form login signup search share sharing social related recommended recommendations reply replies respond discussion skip copyright modal header masthead".split()
)
_STEMS = re.compile(r"sidebar|navbar|navigation|menu|breadcrumb|footer|advert|sponsor|cookie|consent|gdpr|newsletter|subscri|comment(?!ar|at)|disqus|popup|banner|promo|widget|toolbar|pagination|pager")
_COMMENTS = re.compile(r"comment(?!ar|at)|disqus|\brepl(?:y|ies)\b")
#: Says something about the page around it, not about the element.
_ABOUT = re.compile(r"\b(?:has|with|without|no)[-_ ][a-z]+")
_PART = re.compile(r"[a-z]+")

#: Open blocks that are told apart; deeper ones add their text to the last of these. Open tags in all that are remembered.
DEPTH, OPEN = 60, 500

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    """A block: children are elements and texts, a text being [pieces, characters inside links]."""

    __slots__ = ("tag", "mark", "kind", "children")

    def __init__(self, tag: str, mark: str = "", kind: str = ""):
        self.tag, self.mark, self.kind, self.children = tag, mark, kind, []

    def say(self, text: str, linked: bool) -> None:
        if not self.children or isinstance(self.children[-1], Element):
            self.children.append([[], 0])
        last = self.children[-1]
        last[0].append(text)
        if linked:
            last[1] += len(text.strip())


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def kind_of(tag: str, given: dict[str, str], inside: bool) -> str:
    """``drop``, ``frame`` (dropped, unless it turns out to hold the article), ``article``, ``main`` or nothing. A header inside an article belongs to it."""
    named = f"{given.get('class', '')} {given.get('id', '')}"
    words = _ABOUT.sub(" ", _CAMEL.sub("-", named).lower()) if named != " " else ""
    if tag in ("article", "main"):
        return "drop" if tag == "article" and _COMMENTS.search(words) else tag
    if tag in ("body", "html"):
        return ""
    role = given.get("role", "").lower()
    if tag in DROPPED or role in DROPPED_ROLES or (tag == "header" and not inside) or _COMMENTS.search(words):
        return "drop"
    if _STEMS.search(words) or any(w in _WORDS and not (inside and w in ("header", "masthead")) for w in _PART.findall(words)):
        return "frame"
    if given.get("itemprop", "").lower() == "articlebody" or role == "article":
        return "article"
    return "main" if role == "main" else ""


def mark_of(given: dict[str, str]) -> str:
    """The class, or else the id, without what counts or numbers."""
    return re.sub(r"\d+", "0", " ".join(sorted((given.get("class") or given.get("id") or "").lower().split())))[:60]


class _Builder:
    """The open tags, from the page down, and where their text goes."""

    def __init__(self):
        self.root = Element("html")
        #: (tag, element that text goes to, whether the tag began it, links around)
        self.stack: list[tuple[str, Element, bool, int]] = [("html", self.root, True, 0)]
        self.blocks, self.articles, self.dropped = 1, 0, 0

    def text(self, text: str) -> None:
        self.stack[-1][1].say(html.unescape(text), self.stack[-1][3] > 0)

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            _, element, own, _ = self.stack.pop()
            if own:
                self.blocks -= 1
                self.articles -= element.kind in ("article", "main")
                self.dropped -= element.kind == "drop"

    def close(self, tags, until=frozenset()) -> None:
        """Close the innermost open one of some tags, and all that is open inside it."""
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] in tags:
                return self.pop_to(depth)
            if self.stack[depth][0] in until:
                return None

    def begin(self, tag: str, rest: str) -> None:
        if tag in ENDS_P:
            self.close({"p"}, BLOCK - {"p"})
        if tag in CLOSES:
            these, until = CLOSES[tag]
            before = 0
            while before != len(self.stack):  # a row may end a cell and a row
                before = len(self.stack)
                self.close(these, until)
        given = attributes(rest) if "=" in rest else {}
        kind = kind_of(tag, given, self.articles > 0)
        here, links = self.stack[-1][1], self.stack[-1][3] + (tag == "a")
        if tag in BLOCK:
            here.say(" ", False)
        if (tag in BLOCK or kind) and not self.dropped and (self.blocks < DEPTH or kind in ("drop", "frame")):
            element = Element(tag, mark_of(given), "drop" if self.blocks >= DEPTH else kind)
            here.children.append(element)
            self.blocks += 1
            self.articles += element.kind in ("article", "main")
            self.dropped += element.kind == "drop"
            self.stack.append((tag, element, True, links))
        elif len(self.stack) < OPEN:
            self.stack.append((tag, here, False, links))


def parse(page: str) -> Element:
    """The tree of a page: all its text but that of raw elements, comments and markup, each piece in the innermost block told apart."""
    build, at = _Builder(), 0
    while found := _TOKEN.search(page, at):
        if found.start() > at:
            build.text(page[at : found.start()])
        at = found.end()
        closing, tag, rest = found.groups()
        tag = (tag or "").lower()
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag in VOID:
            if tag in ("br", "hr"):
                build.text(" ")
        elif closing:
            build.close({tag})
            if tag in BLOCK:
                build.text(" ")
        elif tag and tag != "html":
            build.begin(tag, rest)
    build.text(page[at:])
    _settle(build.root)
    return build.root


def _holds_article(element: Element, frames: bool) -> bool:
    """An article in what isn't dropped, looking into frames or not."""
    return any(
        c.kind in ("article", "main") or (c.kind != "drop" and (frames or c.kind != "frame") and _holds_article(c, frames)) for c in element.children if isinstance(c, Element)
    )


def _settle(root: Element) -> None:
    """Frames are dropped, unless the only articles of the page stand in them."""
    outside = _holds_article(root, False)

    def walk(element: Element) -> None:
        for c in element.children:
            if isinstance(c, Element) and c.kind != "drop":
                if c.kind == "frame":
                    c.kind = "" if not outside and _holds_article(c, True) else "drop"
                walk(c)

    walk(root)
