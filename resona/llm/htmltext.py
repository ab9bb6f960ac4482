"""Blocks of text of an HTML page, each with the containers around it.

Containers are a tree: each has a number, its parent's number, and the number of its path, which is interned as
(path of the parent, step). So the work grows with the page, however deeply it is nested.
"""

import html
import re
from collections import Counter
from dataclasses import dataclass
from urllib.parse import urlsplit

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Elements whose content is text of its own kind, up to the end tag of the same name.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details",
    "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADING = {"h1", "h2", "h3"}
CONTAINER = {"article", "body", "center", "div", "main", "section", "table", "tbody", "td", "tr"}
# Start tags that end an open element, up to the nearest of the elements named last.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}

# Parts of a page that are never article text.
NEVER = {
    "aside", "button", "dialog", "fieldset", "footer", "form", "head", "menu", "nav", "optgroup", "option",
    "search", "select", "svg", "math", "canvas", "object", "audio", "video",
} | RAW
# Words in class, id or role that name such a part.
BOILERPLATE = {
    "ad", "adbox", "adblock", "ads", "adsense", "advert", "adverts", "advertisement", "advertisements",
    "advertising", "alert", "banner", "banners", "breadcrumb", "breadcrumbs", "byline", "comment",
    "commentlist", "comments", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog",
    "disqus", "footer", "footnav", "form", "gdpr", "header", "hidden", "infobar", "legal", "login", "masthead",
    "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "notification", "overlay", "pager", "pagination", "paywall", "popup", "privacy", "promo", "promos",
    "promoted", "promotion", "recommendations", "recommended", "related", "replies", "reply", "respond",
    "search", "share", "sharing", "sidebar", "sidenav", "signup", "skip", "social", "sponsor",
    "sponsored", "sponsors", "subnav", "subscribe", "subscription", "tagcloud", "teaser", "toolbar",
    "topbar", "widget", "widgets",
}
# Those that name texts of others, however long they are.
OTHERS = {
    "comment", "commentlist", "comments", "disqus", "recommendations", "recommended", "related", "replies",
    "reply", "respond", "teaser", "promo", "promos", "promoted",
}
# Those that name notes of the site, which may be longer than a short article.
NOTES = {
    "ad", "adbox", "adblock", "ads", "adsense", "advert", "adverts", "advertisement", "advertisements",
    "advertising", "consent", "cookie", "cookies", "gdpr", "sponsor", "sponsored", "sponsors",
}
# Inside an article, these name parts of it.
OF_ARTICLE = {"header", "legal", "form"}
# First and last words of names that tell how a page is laid out around such a part.
LAYOUT_FIRST, LAYOUT_LAST = {"with", "without", "no", "has"}, {"open", "opened", "closed"}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """Text between block boundaries in the container numbered `node`, 0 for none. `linked` counts the characters inside
    links, `heading` tells whether it is one."""

    text: str
    node: int
    linked: int
    heading: bool = False


class Page(list):
    """The blocks of a page in order, and its containers: parents come before their children, so `parents[n] < n`.
    Number 0 stands for the page itself."""

    def __init__(self):
        super().__init__()
        self.parents, self.steps, self.paths = [0], [""], [0]
        self.numbers: dict[tuple[int, str], int] = {}  # of paths

    def container(self, parent: int, name: str) -> int:
        key = (self.paths[parent], name)
        self.parents.append(parent)
        self.steps.append(name)
        self.paths.append(self.numbers.setdefault(key, len(self.numbers) + 1))
        return len(self.parents) - 1

    def tag(self, node: int) -> str:
        return self.steps[node].split(".")[0]

    def path(self, node: int) -> tuple[str, ...]:
        """Steps from the outermost container to this one."""
        found = []
        while node:
            found.append(self.steps[node])
            node = self.parents[node]
        return tuple(reversed(found))

    def number(self, path: str) -> int | None:
        """Of a path of steps with spaces between, None if no container has it."""
        at: int | None = 0
        for name in path.split(" "):
            at = self.numbers.get((at, name))
            if at is None:
                return None
        return at

    def up(self, values: list[float], share: float = 1.0) -> list[float]:
        """For each container its value and `share` of what its children have."""
        found = list(values)
        for node in range(len(found) - 1, 0, -1):
            found[self.parents[node]] += share * found[node]
        return found

    def below(self, marked) -> list[bool]:
        """For each container whether `marked(number)` holds for it or one around it."""
        found = [False] * len(self.parents)
        for node in range(1, len(found)):
            found[node] = found[self.parents[node]] or marked(node)
        return found

    def spans(self) -> list[tuple[int, int]]:
        """For each container the first block in it and the one behind the last; they follow each other."""
        first, last = [len(self)] * len(self.parents), [0] * len(self.parents)
        for i, block in enumerate(self):
            first[block.node], last[block.node] = min(first[block.node], i), max(last[block.node], i + 1)
        for node in range(len(first) - 1, 0, -1):
            parent = self.parents[node]
            first[parent], last[parent] = min(first[parent], first[node]), max(last[parent], last[node])
        return list(zip(first, last))


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def step(tag: str, given: dict[str, str]) -> str:
    """Tag and classes of an element, generalised: numbers become #, classes are sorted."""
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in given.get("class", "").split()})
    return ".".join([tag, *classes])


def is_boilerplate(tag: str, given: dict[str, str], inside_article: bool) -> bool:
    """Whether an element is no article text by its tag or because it is not shown."""
    if tag in NEVER or "hidden" in given or given.get("aria-hidden", "").lower() == "true":
        return True
    if tag == "header":
        return not inside_article
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I))


def boilerplate_words(tag: str, given: dict[str, str], inside_article: bool) -> set[str]:
    """Words in the names of an element that speak against it."""
    if tag in ("html", "body", "main", "article"):
        return _named(given) & {"comment"} if tag == "article" else set()
    if tag == "header":
        return set()
    found = _named(given) & BOILERPLATE
    if inside_article and tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "b", "i", "em", "strong", "span", "a"):
        return found - OF_ARTICLE - {"banner", "search"}
    return found - OF_ARTICLE if inside_article else found


def _named(given: dict[str, str]) -> set[str]:
    found: set[str] = set()
    for name in " ".join(given[key] for key in ("class", "id", "role") if key in given).split():
        words = [w.lower() for w in WORDS.findall(name)]
        if len(words) < 2 or words[0] not in LAYOUT_FIRST and words[-1] not in LAYOUT_LAST:
            found.update(words)
    return found


class _Named:
    """Elements whose names speak against them, as a tree of their own; 0 stands for none."""

    def __init__(self):
        self.parents, self.words, self.holding = [0], [set()], [set()]

    def add(self, parent: int, words: set[str]) -> int:
        self.parents.append(parent)
        self.words.append(words)
        self.holding.append(set())
        return len(self.parents) - 1

    def dropped(self, pieces: list[tuple[str, int, bool]], framed: bool) -> list[bool]:
        """For each of them whether it, or one around it, is dropped: not those that hold a main element, and, if they
        don't name texts of others, not those that hold an article. Where no article or main element has text outside
        them (`framed`), those that hold more than half of the text outside links stay too, unless they name notes.
        `pieces` are (text, innermost such element around it, linked)."""
        count = len(self.parents)
        others, sizes, whole = [False] * count, [0] * count, 0
        for n in range(1, count):
            others[n] = others[self.parents[n]] or bool(self.words[n] & OTHERS)
        for text, around, linked in pieces:
            if not linked and not others[around]:
                sizes[around] += len(text.strip())
                whole += len(text.strip())
        for n in range(count - 1, 0, -1):
            sizes[self.parents[n]] += sizes[n]
            self.holding[self.parents[n]] |= self.holding[n]
        gone = [False] * count
        for n in range(1, count):
            words, holding = self.words[n], self.holding[n]
            alone = "main" not in holding and bool(
                words & OTHERS or not ("article" in holding or not framed and not words & NOTES and 2 * sizes[n] > whole))
            gone[n] = gone[self.parents[n]] or alone
        return gone


def blocks(source: str | None) -> Page:
    """Blocks of a page in order, without the parts that `is_boilerplate` and `_Named.dropped` name; those of the
    latter stay where nothing else is left. Null has none."""
    source, at = source or "", 0
    open_tags: list[tuple[str, bool, bool]] = []  # tag, boilerplate (also above), inside an article
    opened: Counter = Counter()  # how many of each tag are open
    page, node = Page(), 0
    holders: list[int] = []  # depth in open_tags of each open container
    dropping = links = headings = 0
    text: list[tuple[str, int, bool]] = []  # piece, innermost named element around it, inside a link
    pieces: list[tuple[list, int, bool]] = []
    named, around = _Named(), 0
    depths: list[int] = []  # in open_tags, of the named elements

    def flush() -> None:
        if any(t.strip() for t, _, _ in text):
            pieces.append((text.copy(), node, bool(headings)))
        text.clear()

    def add(piece: str) -> None:
        if piece and not dropping:
            text.append((html.unescape(piece), around, links > 0))

    def close(depth: int) -> None:
        nonlocal dropping, links, headings, around, node
        while len(open_tags) > depth:
            tag, drops, _ = open_tags.pop()
            opened[tag] -= 1
            if tag in BLOCK:
                flush()
            dropping -= drops
            if depths and depths[-1] >= len(open_tags):
                depths.pop()
                around = named.parents[around]
            links -= tag == "a"
            headings -= tag in HEADING
            while holders and holders[-1] >= len(open_tags):
                holders.pop()
                node = page.parents[node]

    size = len(source)
    while at < size:
        m = TAG.search(source, at)
        if not m:
            add(source[at:])
            break
        add(source[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(open_tags) - 1, -1, -1) if opened[tag] else ():
                if open_tags[depth][0] == tag:
                    close(depth)
                    break
                if tag not in BLOCK and open_tags[depth][0] in BLOCK - {"p"}:
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            for depth in range(len(open_tags) - 1, -1, -1) if opened["p"] else ():
                if open_tags[depth][0] == "p":
                    close(depth)
                    break
                if open_tags[depth][0] in BLOCK:
                    break
        if tag in ENDS:
            ended, until = ENDS[tag]
            for depth in range(len(open_tags) - 1, -1, -1) if any(opened[t] for t in ended) else ():
                if open_tags[depth][0] in until:
                    break
                if open_tags[depth][0] in ended:
                    close(depth)
                    if tag not in ("tr", "tbody", "thead", "tfoot"):
                        break
        given = attributes(m[3]) if m[3].strip() else {}
        inside = any(t[2] for t in open_tags[-1:])
        drops = is_boilerplate(tag, given, inside)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>?", re.I).search(source, at)
            at = source.find(">", end.start()) + 1 or size if end else size
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        words = set() if drops else boilerplate_words(tag, given, inside)
        if tag in ("article", "main") and not dropping and not words:
            named.holding[around].add(tag)
        if words:
            around = named.add(around, words)
            depths.append(len(open_tags))
        open_tags.append((tag, drops, inside or tag in ("article", "main")))
        opened[tag] += 1
        dropping += drops
        links += tag == "a"
        headings += tag in HEADING
        if tag in CONTAINER:
            node = page.container(node, step(tag, given))
            holders.append(len(open_tags) - 1)
    close(0)
    flush()

    def build(without: list[bool]) -> None:
        for own, place, heading in pieces:
            left = [p for p in own if not without[p[1]]]
            whole = " ".join("".join(p[0] for p in left).split())
            if whole:
                page.append(Block(whole, place, sum(len(p[0].strip()) for p in left if p[2]), heading))

    in_main = page.below(lambda n: page.tag(n) in ("article", "main"))
    framed = any(in_main[place] for own, place, _ in pieces if not all(p[1] for p in own))
    build(named.dropped([p for own, *_ in pieces for p in own], framed))
    if not page:
        build([False] * len(named.parents))
    return page


def host(url: str | None) -> str:
    """Host of a URL in lower case; empty if there is none."""
    try:
        return (urlsplit(url or "").hostname or "") if url else ""
    except ValueError:
        return ""
