"""Pages as streams of structural tags and text.

Tags inside a line of text are dropped, the others form a tree whatever is missing: an element ends
with its end tag, with that of an element around it, or where its kind cannot go on (a paragraph at
the next block, a list item at the next). Comments, declarations and the contents of scripts, styles
and the like are no text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

# Names of the markup language and words that sites use in classes and ids.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
NOISE_TAGS = frozenset(
    "nav footer aside form head script style textarea title iframe noembed noframes noscript template button select "
    "option fieldset dialog menu svg math object applet canvas audio video map datalist".split()
)
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split()
)
NOISE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising adbox banner sponsor sponsors sponsored promo "
    "promos promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "subscription sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager share "
    "sharing social related recommended recommendations comment comments commentlist respond reply replies disqus footer "
    "masthead topbar toolbar copyright legal disclaimer widget widgets login signin signup register search searchbox skip "
    "skiplink".split()
)
BODY_WORDS = frozenset("article content entry main post story text body page".split())
HEADER_WORDS = frozenset("header head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENT_WORDS = frozenset("comment comments respond reply replies".split())
NOT_MEANT = frozenset("has no with without".split())  # "has-sidebar" is no sidebar
ENDS = {  # a start tag of the first ends an open one of the second, without passing one of the third
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
SCOPES = frozenset("table td th article section main aside nav footer header form".split())

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|-?>|.*\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPLIT_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
DEEPEST = 100  # elements nested deeper count as at this depth

Kind = tuple[str, str, bool]  # tag, label with its class and id words, whether it is no part of an article


def kind(name: str, rest: str) -> Kind:
    """What a start tag is, by its name, classes, id and role."""
    words: list[str] = []
    said: set[str] = set()
    role = ""
    if "=" in rest:
        for attribute, *values in _ATTRIBUTE.findall(rest):
            value = "".join(values)
            if attribute.lower() == "role":
                role = value.strip().lower()
                continue
            for token in value.split():
                parts = _WORD.findall(_SPLIT_CASE.sub(" ", token).lower())
                words += [x for x in parts if len(x) > 1 or x == token.lower()]
                if parts and parts[0] not in NOT_MEANT and parts[-1] != "free":
                    said.update(parts)
    noise = name in NOISE_TAGS or role in NOISE_ROLES or bool(said & NOISE_WORDS)
    if said & HEADER_WORDS and not said & BODY_WORDS and name not in HEADINGS:
        noise = True
    if name in ("article", "main") and not said & COMMENT_WORDS:
        noise = False
    if role == "main":
        name = "main"
    return name, ".".join([name, *dict.fromkeys(words)]), noise


class Tags:
    """``kind`` with a bounded cache over whole tags."""

    def __init__(self):
        self.known: dict[tuple[str, str], Kind] = {}

    def __call__(self, name: str, rest: str) -> Kind:
        found = self.known.get((name, rest))
        if found is None:
            if len(self.known) > 5000:
                self.known.clear()
            found = self.known[name, rest] = kind(name, rest)
        return found


def events(page: str, tags: Tags) -> Iterator[tuple[str, object]]:
    """("open", kind), ("close", None), ("text", str), ("link", +1 or -1) and ("space", None), well nested.

    Text is decoded; an inline tag of noise is an element too.
    """
    at, size = 0, len(page)
    open_: list[str] = []
    count: Counter[str] = Counter()
    links = 0

    def close() -> tuple[str, None]:
        count[open_.pop()] -= 1
        return "close", None

    while at < size:
        token = _TOKEN.search(page, at)
        start = token.start() if token else size
        if start > at:
            yield "text", html.unescape(page[at:start])
        if token is None:
            return
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["end"]:
            if name == "a" and links:
                links -= 1
                yield "link", -1
            if name == "br":
                yield "space", None
            if not count[name]:
                continue
            if name in ("p", "li", "dt", "dd") or name in INLINE:  # these end only within their part of the page
                reach = len(open_) - 1
                while reach >= 0 and open_[reach] != name and open_[reach] not in SCOPES:
                    reach -= 1
                if reach < 0 or open_[reach] != name:
                    continue
            while open_[-1] != name:
                yield close()
            yield close()
            continue
        if name in VOID:
            yield "space", None
            continue
        if name in RAW:
            done = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = done.start() if done else size
            yield "space", None
            continue
        if name in ("html", "body"):  # may be missing, so no element of their own
            continue
        if open_ and open_[-1] == "head":
            yield close()
        what = tags(name, token["rest"])
        if name in INLINE:
            if name == "a":
                if links:  # links do not nest
                    yield "link", -1
                links = 1
                yield "link", 1
            if not what[2]:
                continue
        else:
            while open_ and (open_[-1] == "p" or open_[-1] in INLINE):
                yield close()
            ended, limit = ENDS.get(name, ((), ()))
            while any(count[x] for x in ended):
                reach = len(open_) - 1
                while reach >= 0 and open_[reach] not in ended and open_[reach] not in limit and open_[reach] not in SCOPES - {"td", "th"}:
                    reach -= 1
                if reach < 0 or open_[reach] not in ended:
                    break
                while len(open_) > reach:
                    yield close()
        open_.append(name)
        count[name] += 1
        yield "open", what
