"""Web pages as lines of text, each with the zone that the markup puts it in."""

from __future__ import annotations

import html
import re
from collections import Counter

PLAIN, MAIN, ARTICLE, OUTSIDE = range(4)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^>"']|"[^"<]*"|'[^'<]*')*+)|(?P<broken>[^>]*))(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
_OUTSIDE = frozenset("head nav footer aside form menu dialog noscript template svg math canvas object audio video button select datalist search".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are not judged by words in their class and id.
_UNNAMED = _HEADINGS | {"article", "main", "header"}
#: What an opening tag ends, and how far up that is looked for.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ROLES_OUTSIDE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class and id that name what is no part of an article.
_NAMES_OUTSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promoted promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "pagination pager header masthead footer sidebar aside related recommended recommendations cookie cookies consent gdpr notice notices alert newsletter subscribe signup popup modal "
    "overlay comment comments disqus respond replies share sharing social widget widgets copyright form login search".split()
)
_NAMES_ARTICLE = frozenset("article articlebody articlecontent articletext postcontent postbody entrycontent entrybody storybody storycontent maincontent".split())


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c, alone in _ATTR.findall(text):
        found.setdefault((name or alone).lower(), html.unescape(a or b or c))
    return found


def _zone(name: str, text: str, inside: int) -> int:
    """The zone of an element's content, from its name, its attributes and the zone around it."""
    if inside == OUTSIDE or name in _OUTSIDE:
        return OUTSIDE
    if name == "header" and inside != ARTICLE:
        return OUTSIDE
    if name == "article" and inside == ARTICLE:  # an article in an article is a reader's comment
        return OUTSIDE
    zone = ARTICLE if name == "article" else max(inside, MAIN) if name == "main" else inside
    if not text.strip(" \t\r\n/") or name in ("html", "body"):
        return zone
    given = _attributes(text)
    role = given.get("role", "").lower()
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
    if hidden or role in _ROLES_OUTSIDE:
        return OUTSIDE
    named = f"{given.get('class', '')} {given.get('id', '')}"
    if named != " " and name not in _UNNAMED:
        for part in map(str.lower, _PARTS.findall(named)):
            if part in _NAMES_OUTSIDE and not (part == "header" and inside == ARTICLE):
                return OUTSIDE
    elif name == "article" and re.search(r"\bcomment", named, re.I):
        return OUTSIDE
    whole = {re.sub(r"[^a-z]", "", x.lower()) for x in named.split()}
    if role == "article" or given.get("itemprop", "").lower() == "articlebody" or whole & _NAMES_ARTICLE:
        return ARTICLE
    return max(zone, MAIN) if role == "main" else zone


def lines(page: str) -> list[tuple[str, int]]:
    """(text, zone) of the blocks of a page in order; what is not shown (scripts, styles, comments) is no text.

    End tags that were forgotten are supplied where the next block, or the end of an outer
    element, asks for them; an unfinished tag at the end is no text.
    """
    out: list[tuple[str, int]] = []
    open_: list[tuple[str, int]] = []  # elements, each with the zone of its content
    number: Counter[str] = Counter()  # of open elements by name, so that the list is searched only for what is in it
    zone, held, at = PLAIN, {}, 0

    def flush() -> None:
        for z, parts in held.items():
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, z))
        held.clear()

    def say(text: str) -> None:
        z = zone
        if z == ARTICLE and number["header"] and not any(number[x] for x in _HEADINGS):
            z = OUTSIDE  # of an article's own header only the headings are text
        held.setdefault(z, []).append(html.unescape(text) if "&" in text else text)

    def pop(k: int) -> None:
        nonlocal zone
        gone = [x for x, _ in open_[k:]]
        if not _BLOCK.isdisjoint(gone):
            flush()
        number.subtract(gone)
        del open_[k:]
        zone = open_[-1][1] if open_ else PLAIN

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if not m["name"] or not m[0].endswith(">"):
            continue
        name, text = m["name"].lower(), m["attrs"] or m["broken"] or ""
        if m["close"]:
            if number[name] > 0:
                pop(next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name))
            elif name in _BLOCK:
                flush()
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            say(" ")
            continue
        if name in _BLOCK:
            flush()
            for k in range(len(open_) - 1, -1, -1) if number["p"] > 0 else ():
                if open_[k][0] == "p":
                    pop(k)
                if k >= len(open_) or open_[k][0] in _BLOCK:
                    break
            ended, limits = _ENDS.get(name, ((), ()))
            for k in range(len(open_) - 1, -1, -1) if any(number[x] > 0 for x in ended) else ():
                if open_[k][0] in ended:
                    pop(k)
                    break
                if open_[k][0] in limits:
                    break
        if name in _VOID:
            continue
        zone = _zone(name, text, zone)
        open_.append((name, zone))
        number[name] += 1
    flush()
    return out
