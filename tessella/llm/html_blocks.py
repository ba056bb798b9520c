"""HTML to blocks of text, each with what its place in the page says of it."""

from __future__ import annotations

import re
from html.parser import HTMLParser

MAIN, LIKELY, OPEN, CHROME = "main", "likely", "open", "chrome"

#: Elements without content, without visible text, and those that stand in a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head svg math iframe object canvas audio video select option datalist textarea button form dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav header footer aside menu".split())
ARTICLE = frozenset(["article", "main"])
#: Words of class names, ids and roles that mark what isn't the article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations trending pagination pager comment comments reply replies disqus discussion toolbar copyright legal disclaimer skip search".split()
)
MAIN_WORDS = frozenset("article content main post entry story".split())
ROLES = {"navigation": CHROME, "banner": CHROME, "contentinfo": CHROME, "complementary": CHROME, "search": CHROME, "dialog": CHROME, "form": CHROME, "main": MAIN, "article": MAIN}
SPACE = re.compile(r"\s+")


def _words(value: str | None) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value or "").lower()))


class Blocks(HTMLParser):
    """blocks: (text, place) in page order; hidden and empty ones are left out. MAIN is an article by its element or role, LIKELY one by names only."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.stack: list[tuple[str, str, bool]] = []  # tag, place, hidden
        self.parts: list[str] = []

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            self.blocks.append((text, self.stack[-1][1] if self.stack else OPEN))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self._flush()
            return
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        if tag == "p":  # an open paragraph ends here
            self._leave("p", {"div", "article", "section", "main", "body", "td", "th", "li", "blockquote", *FURNITURE})
        elif tag == "li":
            self._leave("li", {"ul", "ol", "menu"})
        place, hidden = self.stack[-1][1:] if self.stack else (OPEN, False)
        given = dict(attrs)
        names = _words(given.get("class")) | _words(given.get("id"))
        role = ROLES.get((given.get("role") or "").lower())
        inside = place in (MAIN, LIKELY)
        if tag in FURNITURE and not (tag == "header" and inside) or role == CHROME or names & CHROME_WORDS and tag not in ("html", "body") and tag not in ARTICLE:
            place = CHROME
        elif place != CHROME and (tag in ARTICLE or role == MAIN):
            place = MAIN
        elif place == OPEN and tag in ("div", "section") and names & MAIN_WORDS:
            place = LIKELY
        hidden = hidden or tag in HIDDEN or "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or "display:none" in (given.get("style") or "").replace(" ", "").lower()
        self.stack.append((tag, place, hidden))

    def _leave(self, tag: str, stop: set[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if self.stack[k][0] in stop:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._flush()
            return
        if tag not in INLINE:
            self._flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][2]):
            self.parts.append(data)

    def close(self) -> None:
        super().close()
        self._flush()


def blocks(html: str | None) -> list[tuple[str, str]]:
    if not html:
        return []
    parser = Blocks()
    parser.feed(html)
    parser.close()
    return parser.blocks
