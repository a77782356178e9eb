"""Leaf blocks of a page, and generated training pages with known labels.

A block is the text between two block-level boundaries, with the path of open
block-level elements above it; all other elements, known or not, stand inside their block.  Scripts, styles, comments and the like never become
text; elements are known by their whole names, and one that is closed at once hides nothing.  A path is a node with its parent, and what is
known of it is added to what is known of the parent, so that a page takes time in proportion to its length however deep it is.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from html import unescape
from typing import NamedTuple
from zlib import crc32

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!.*?(?:>|\Z)|<\?.*?(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S,
)
#: Elements whose content is not markup: without an end tag they reach to the end of the page (fixed values).
RAW = frozenset("script style textarea title iframe".split())
#: Elements whose content is no text of the page, up to their end tag if there is one (fixed values).
HIDDEN = RAW | frozenset("template noscript svg select object canvas audio video annotation annotation-xml".split())
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in HIDDEN}
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PART = re.compile(r"[a-z]+")
#: Elements that end a block (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li listing main menu nav noframes ol p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Elements without content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that part words though they end no block (fixed values).
SPACED = frozenset("br option optgroup".split())
#: Starting one of these ends an open element of its list (fixed values).
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: Block-level starts that end an open paragraph (fixed values).
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
SCOPES = frozenset("table ul ol dl div section article aside main nav body".split())


#: Cells of the hashed tokens of a path.
PATH_CELLS = 512


class Node:
    """An open element below its parent: ``cells``, a bit a cell, holds the tokens of the whole path, ``leaf`` those of a block that lies right in it."""

    __slots__ = ("name", "cells", "leaf", "depth")

    def __init__(self, step: str, above: Node | None = None):
        self.name, _, named = step.partition(" ")
        self.depth = above.depth + 1 if above else 1
        self.cells = (above.cells if above else 0) | cells_of(self.name, *("." + w for w in PART.findall(named)))
        parent = f"{above.name}>" if above else ""
        self.leaf = self.cells | cells_of(f"depth{min(self.depth, 12)}", "leaf:" + self.name, f"leaf:{parent}{self.name}")


def cells_of(*tokens: str) -> int:
    out = 0
    for t in tokens:
        out |= 1 << crc32(t.encode()) % PATH_CELLS
    return out


#: What is known of a block that no element holds.
BARE = cells_of("depth0")


class Block(NamedTuple):
    text: str
    at: Node | None
    linked: float

    @property
    def cells(self) -> int:
        return self.at.leaf if self.at else BARE


def node_of(path: list[str], known: dict[tuple[str, ...], Node] | None = None) -> Node | None:
    """The node of a path given in full."""
    node = None
    for i, step in enumerate(path):
        key = tuple(path[: i + 1])
        node = known.setdefault(key, Node(step, node)) if known is not None else Node(step, node)
    return node


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in page order; white space inside is one space."""
    out: list[Block] = []
    stack: list[Node] = []
    names: Counter[str] = Counter()  # of the open elements
    text: list[str] = []
    in_link, linked, at = False, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, stack[-1] if stack else None, min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def close(wanted: frozenset[str] | set[str], stop: frozenset[str] = frozenset()) -> None:
        if not any(names[w] for w in wanted):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in wanted:
                names.subtract(n.name for n in stack[i:])
                del stack[i:]
                return
            if stack[i].name in stop:
                return

    endless: set[str] = set()  # hidden elements that no end tag follows any more
    while m := TOKEN.search(html, at):
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        if m[2] is None:  # a comment and the like
            continue
        name = m[2].lower()
        if name in HIDDEN and not m[1]:
            if not m[3].endswith("/"):
                end = None if name in endless else ENDS[name].search(html, at)
                if end:
                    at = end.end()
                else:
                    endless.add(name)
                    at = len(html) if name in RAW else at
            continue
        if name not in BLOCKS:
            if name == "a":
                in_link = not m[1]
            elif name in SPACED:
                text.append(" ")
            continue
        flush()
        in_link = False
        if m[1]:
            close({name})
            continue
        if name == "head":  # what a head holds is void or hidden; text after an open head belongs to the page
            continue
        if name in ENDS_P:
            close({"p"}, SCOPES)
        if name in CLOSES:
            close(set(CLOSES[name].split()), SCOPES - {"div"})
        if name in VOID or m[3].endswith("/"):
            continue
        named = " ".join(x for g in NAMES.findall(m[3]) for x in g if x) if m[3] else ""
        stack.append(Node(f"{name} {named.lower()}" if named else name, stack[-1] if stack else None))
        names[name] += 1
    if at < len(html):
        text.append(html[at:])
    flush()
    return out


#: Names under which pages mark their parts; a generated page draws from them.
ROLES = {
    "menu": "menu nav navbar navigation topnav mainmenu breadcrumb breadcrumbs pagination tabs toolbar links skip toc sitemap pager dropdown",
    "header": "header masthead banner topbar branding logo sitename tagline site hero brand",
    "footer": "footer colophon copyright bottom legal imprint foot credits contact disclaimer",
    "side": "sidebar side aside widget related recommended popular trending more tags archive rail promo author share social sharing latest teaser",
    "notice": "cookie consent notice alert gdpr popup modal overlay message warning privacy banner paywall subscribe",
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted adsense adbox commercial banner",
    "form": "form search login signup newsletter subscribe contact register poll feedback",
    "comments": "comments comment commentlist discussion replies reply responses respond disqus feedback thread reader",
    "body": "content article post entry story main text body page articlebody postcontent entrycontent prose news blog",
}
SYLLABLES = "an er th in on re st nd ed le de la que ion ou ai en sch ung ich der ci que os ra mo ta pre vor ka lu zi".split()
PHRASES = {
    "menu": "Home|About us|News|Contact|Next|Previous|Sports|Menu|Archive|Login",
    "header": "Daily News|The Morning Herald|Welcome|Your local paper|Sign in|Search",
    "footer": "© 2024 All rights reserved|Privacy policy|Terms of use|Imprint|Powered by",
    "side": "Related articles|Related|You may also like|More stories|Most read|Popular posts|Tags|Follow us|Share this|Read more",
    "notice": "We use cookies to improve your visit.|Accept all|This site uses cookies|Please enable scripts",
    "advert": "Advertisement|Buy now|Sponsored|Limited offer|Anzeige|Publicité",
    "form": "Your email|Subscribe to our newsletter|Search|Send|Name|Password",
    "comments": "3 Comments|Reply|says:|Leave a comment|Great article!|Posted by",
}


def training_page(rng: random.Random) -> list[tuple[Block, int]]:
    """A generated page: blocks with label 1 for the article and 0 for all else."""

    def prose(lo: int, hi: int) -> str:
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
        return " ".join(words).capitalize() + rng.choice([".", "", "!", "..."])

    out: list[tuple[Block, int]] = []
    known: dict[tuple[str, ...], Node] = {}
    shell = ["html", "body"] + ["div" + rng.choice(["", "", " wrapper", " container", " page", " site"]) for _ in range(rng.choice([0, 0, 0, 1, 2]))]
    nameless = rng.random() < 0.3  # a page without telling names

    def put(path: list[str], text: str, label: int, linked: float = 0.0) -> None:
        out.append((Block(text, node_of(path, known), linked), label))

    def named(tag: str, role: str, always: bool = False) -> str:
        names = ROLES[role].split()
        if nameless or not always and rng.random() < 0.5:
            return tag
        return f"{tag} " + rng.choice(["", "site-", "main-", "block-", "c-", "js-"]) + rng.choice(names) + rng.choice(["", "-list", "-box", "-1", " clearfix", "-wrap"])

    def junk(role: str, inside: list[str]) -> None:
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(role)
        bare = not (tag and rng.random() < (0.5 if nameless else 0.7))
        box = named(rng.choice(["div", "section", "div"]), role, True) if bare else named(tag, role)
        path = [*inside, box]
        if rng.random() < 0.3:
            path.append(rng.choice(["div", "div inner", "div content", "section", "div row"]))
        kind = rng.random()
        telling = bare and nameless  # then only links and stock phrases tell
        if rng.random() < 0.4:
            put([*path, rng.choice(["h2", "h3", "h3", "h4", "p"])], rng.choice(PHRASES[role].split("|")) if rng.random() < 0.7 else prose(1, 3).rstrip(".!?"), 0)
        for _ in range(rng.randint(1, 6)):
            stock = telling and rng.random() < 0.4
            said = rng.choice(PHRASES[role].split("|")) if stock or rng.random() < 0.4 else prose(1, 6 if kind < 0.5 or telling else 40).rstrip(".!?" if telling else "")
            linked = lambda: (0.0 if stock else 1.0) if telling else rng.choice([1.0, 0.0, 0.0])
            if kind < 0.4:
                put([*path, "ul", "li"], said, 0, 1.0 if telling and not stock else rng.choice([1.0, 1.0, 0.0]))
            elif kind < 0.75:
                put([*path, rng.choice(["p", "p", "h3", "h2", "h4", "div"])], said, 0, linked())
            else:
                put(path, said, 0, linked())

    for role in rng.sample(["header", "menu", "notice", "advert", "form", "menu"], rng.randint(0, 4)):
        junk(role, shell)
    body = list(shell)
    if rng.random() < 0.3:
        body.append(rng.choice(["main", "main content", "div row", "section", "table"]))
    if body[-1] == "table":
        body += ["tr", "td"]
    kind = rng.random()
    if kind < 0.45:
        body.append(named("article", "body"))
    elif kind < 0.6 and "main" not in body[-1]:
        body.append(named("main", "body"))
    elif kind < 0.75:
        body.append(named("div", "body", True))
    elif kind < 0.85:
        body.append("div " + rng.choice(["main", "content", "text", "page-content", "article", "story", "post"]))
    elif kind < 0.93:
        body.append(rng.choice(["div", "section"]))
    if rng.random() < 0.25:
        body.append(rng.choice([named("div", "body", True), "div", "section"]))
    if rng.random() < 0.8:
        put([*body, *(["header"] if rng.random() < 0.2 else []), rng.choice(["h1", "h1", "h1", "h2"])], prose(2, 14), 1)
    top, parts = list(body), rng.random() < 0.35
    for n in range(rng.choice([1, 2, 2, 3]) if rng.random() < 0.25 else rng.randint(1, 14)):
        if parts and (n == 0 or rng.random() < 0.3):
            body = [*top, rng.choice(["section", "section", "div", "section section", "section chapter", "div section", "section part"])]
            if rng.random() < 0.7:
                put([*body, rng.choice(["h2", "h2", "h3"])], prose(1, 8), 1)
        what = rng.random()
        if what < 0.72:
            put([*body, "p"], prose(1, 120), 1, rng.choice([0.0, 0.0, 0.0, 0.1, 0.3]))
        elif what < 0.78:
            put([*body, rng.choice(["h2", "h3"])], prose(1, 8), 1)
        elif what < 0.84:
            for _ in range(rng.randint(1, 4)):
                put([*body, rng.choice(["ul", "ol"]), "li"], prose(1, 25), 1, rng.choice([0.0, 0.0, 0.5]))
        elif what < 0.87:
            put([*body, "blockquote", *(["p"] if rng.random() < 0.6 else [])], prose(4, 50), 1)
        elif what < 0.89:
            put([*body, "pre"], prose(4, 50), 1)
        elif what < 0.91:
            put([*body, "figure", "figcaption"], prose(3, 20), 1)
        elif what < 0.93:
            for _ in range(rng.randint(2, 6)):
                put([*body, "table", "tr", rng.choice(["td", "th"])], prose(1, 6), 1)
        elif what < 0.95:
            for _ in range(rng.randint(1, 3)):
                put([*body, "dl", rng.choice(["dt", "dd"])], prose(1, 20), 1)
        elif what < 0.98:
            put([*body, *rng.choice([[], [], ["div"]])], prose(8, 60), 1)
        else:
            junk(rng.choice(["advert", "side", "form"]), body)
    for role in rng.sample(["comments", "comments", "side", "side", "advert", "form", "menu", "notice"], rng.randint(0, 3)):
        junk(role, top if role in ("comments", "side", "form") and rng.random() < 0.4 else shell)
    if rng.random() < 0.8:
        junk("footer", shell)
    return out
