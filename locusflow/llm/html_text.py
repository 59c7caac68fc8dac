"""Main text of web pages by composite text density.

Every block element of a page gets its characters per tag, adjusted for the share of link
text. The densities of an element's children are summed; the element with the largest sum
is the article's body. The least density on the path from it up to the page body is the
threshold: other parts that are as dense belong to the article too. An ``article`` or
``main`` element around the best element is taken whole. Menus, headers, footers, asides,
forms, scripts, adverts, notices and reader comments are left out by element, role and class: by whole names, and where a name also fits
article text, by the share of links. Reading a page takes time in proportion to its length, however deep its elements nest.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_TOKEN = re.compile(r"[a-z0-9]+")

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: it ends at their own end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
LEFT_OUT = frozenset(
    "head nav footer aside form button select template svg canvas video audio object dialog menu datalist math".split()
) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names of reader comments, also run together ("commentlist", "usercomments"). They count for ids too.
COMMENTS = frozenset(
    [f"{who}{what}" for who in ("", "user", "reader") for what in ("comment", "comments")]
    + [f"comment{s}{part}" for s in ("", "s") for part in ("area", "body", "box", "form", "list", "section", "thread", "wrapper")]
    + ["disqus", "respond"]
)
WORDS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal newsletter subscribe share "
    "sharing social related recommended reply replies footer login signup widget pagination toolbar".split()
)
#: Words of WORDS that articles also have subjects and boxes of: these alone do not show that an element is no text.
LOOSE = frozenset("social share sharing notice notices menu widget".split())
#: What else a class name or id may be made of. One with any other word, as "market-share", is no known name.
SHAPES = frozenset(
    "area article author bar block blog body bottom box btn button buttons container content entries facebook fb footer form "
    "global google gpt group header icons inner item items js left link links list message meta outer page post posts primary "
    "reader readers recent right row secondary section site slot text thread title top unit user users wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An element that only a LOOSE word or an id speaks against goes if this share of its characters is links.
MOSTLY_LINKS = 0.5
#: An open element that the start of another ends: element -> (ended by, search stops at).
_LISTS = frozenset(("ul", "ol", "menu", "dir"))
ENDED = {
    "li": (frozenset(("li",)), _LISTS), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))), "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
}


class _Node:
    __slots__ = ("name", "parent", "block", "out", "doubt", "chars", "link_chars", "tags", "link_tags", "density", "total", "best")

    def __init__(self, name: str, parent: _Node | None, block: bool, out: bool):
        self.name, self.parent, self.block, self.out = name, parent, block, out
        self.doubt: tuple[int, int, int] | None = None  # place, characters and link characters before it
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.best = self


def _known(tokens: list[str]) -> set[str]:
    """The words that tell what a class name or id means, if it is made of known words only."""
    words = WORDS.intersection(tokens)
    return words if all(t in words or t in SHAPES or t[0].isdigit() for t in tokens) else set()


def _is_left_out(name: str, attributes: str, inside: bool) -> bool | None:
    """None: only if it is mostly links. ``inside``: whether an article or main element is open, whose own header belongs to it.

    Ids of headings, and of sections in an article, are made from titles and say nothing, unless they name comments.
    """
    if name in LEFT_OUT:
        return True
    if name in ("html", "body", "article", "main"):
        return False
    if name == "header" and not inside:
        return True
    if not attributes:
        return False
    doubt = False
    for key, *values in _NAMED.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "role":
            if ROLES.intersection(_TOKEN.findall(value)):
                return True
            continue
        if key == "itemprop":
            if COMMENTS.intersection(value.split()):
                return True
            continue
        if key == "id" and name in HEADINGS:
            continue
        for part in value.split():
            tokens = _TOKEN.findall(part)
            words = _known(tokens)
            if words & COMMENTS:
                return True
            if not words or key == "id" and inside and name == "section":
                continue
            titled = key == "id" and (inside or name == "section")
            loose = words <= LOOSE and (len(tokens) == 1 or not words <= {"notice", "notices"})
            if not titled and not (inside and loose):
                return True
            doubt = True
    return bool(_HIDDEN.search(attributes)) or (None if doubt else False)


def _parse(page: str, gone: set[int] = frozenset()) -> tuple[list[_Node], list[tuple[_Node, str]], set[int]]:
    """Block nodes, parents first, the text blocks in page order with the node each stands in, and doubtful elements.

    The last are the places of those that turned out to be mostly links; ``gone`` are
    places whose elements are left out.
    """
    root = _Node("#page", None, True, False)
    nodes, stack, blocks = [root], [root], []
    owners = [root]  # the open block elements
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
    held: list[str] = []
    links = linked = seen = seen_linked = 0
    mostly_links: set[int] = set()
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                owner = owners[-1]
                blocks.append((owner, text))
                owner.chars += len(text)
                owner.link_chars += min(linked, len(text))
        linked = 0

    def close(to: int) -> None:
        nonlocal links
        if any(n.block for n in stack[to:]):
            flush()
        links -= sum(n.name == "a" for n in stack[to:])
        for n in reversed(stack[to:]):
            places[n.name].pop()
            if n.block:
                owners.pop()
            if n.doubt and seen > n.doubt[1] and seen_linked - n.doubt[2] >= MOSTLY_LINKS * (seen - n.doubt[1]):
                mostly_links.add(n.doubt[0])
        del stack[to:]

    def last(names: frozenset[str] | set[str]) -> int:
        return max((places[name][-1] for name in names if places.get(name)), default=0)

    def find(names: frozenset[str] | set[str], stop: frozenset[str] | set[str] = frozenset()) -> int:
        i = last(names)
        return i if i > last(stop) else 0

    while at < end:
        m = _TAG.search(page, at)
        upto = m.start() if m else end
        if upto > at and not stack[-1].out:
            piece = html.unescape(page[at:upto])
            held.append(piece)
            size = len(piece.strip())
            seen += size
            if links:
                linked += size
                seen_linked += size
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            i = find({name})
            if i:
                close(i)
            continue
        if name in BLOCKS:
            i = find({"p"}, {"table", "button", "td", "th"})
            if i:
                close(i)
            if name in ENDED:
                i = find(*ENDED[name])
                if i:
                    close(i)
            if not stack[-1].out:
                flush()
        if name in VOID:
            if not stack[-1].out:
                held.append(" " if name != "wbr" else "")
            continue
        parent = stack[-1]
        inside = bool(places.get("article") or places.get("main"))
        left_out = _is_left_out(name, m[3] or m[6] or "", inside)
        out = parent.out or left_out is True or m.start() in gone
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(page, at)
            at = stop.start() if stop else end
        block = name in BLOCKS and not out
        node = _Node(name, parent, block, out)
        if left_out is None and not out:
            node.doubt = m.start(), seen, seen_linked
        places.setdefault(name, []).append(len(stack))
        stack.append(node)
        if name == "a":
            links += 1
            if not out:
                owners[-1].link_tags += 1
        if block:
            node.parent = owners[-1]
            owners.append(node)
            nodes.append(node)
    close(1)
    flush()
    return nodes, blocks, mostly_links


def _measure(nodes: list[_Node]) -> None:
    """Composite densities and their sums over children, bottom up."""
    for n in reversed(nodes[1:]):
        p = n.parent
        p.chars += n.chars
        p.link_chars += n.link_chars
        p.tags += n.tags + 1
        p.link_tags += n.link_tags
    page = nodes[0]
    link_share = page.link_chars / max(page.chars, 1)
    for n in nodes:
        if n.chars:
            tags, links = max(n.tags, 1), max(n.link_chars, 1)
            base = math.log(n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + link_share * n.chars + math.e)
            ratio = max(n.chars / links * tags / max(n.link_tags, 1), 1.0)
            n.density = n.chars / tags * math.log(ratio + 1) / math.log(base + 1)
    for n in reversed(nodes[1:]):
        n.parent.total += n.density
    for n in reversed(nodes):
        if n.parent is not None and n.best.total >= n.parent.best.total and n.best.total > n.parent.total:
            n.parent.best = n.best


def main_text(page: str | None) -> str:
    """The article's blocks joined by line feeds; empty for an empty page or one without such text."""
    nodes, blocks, gone = _parse(page or "")
    if gone:
        nodes, blocks, _ = _parse(page or "", gone)
    if not blocks:
        return ""
    _measure(nodes)
    best = nodes[0].best
    path, around = [best], None
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    on_path = {id(n) for n in path}
    for n in path:
        if n.name in ("article", "main"):
            around = n
    if around is not None:
        chosen = {id(around)}
    else:
        threshold = min(n.density for n in path)
        chosen = {id(best)}
        for n in nodes[1:]:
            if n.density >= threshold and id(n) not in on_path:
                chosen.add(id(n.best))
    taken: dict[int, bool] = {}
    for n in nodes:
        taken[id(n)] = id(n) in chosen or (n.parent is not None and taken[id(n.parent)])
    return "\n".join(text for n, text in blocks if taken[id(n)])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty page, and one without text, gives an empty text. Every row stands for
    itself, so repeated ids stay repeated; other columns are ignored.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["page_id", "url"]].copy()
            out["text"] = [main_text(h) for h in batch["html"]]
            yield out

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    found = rows.mapInPandas(extract, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
