"""Main text of HTML pages by wrappers inferred per host.

A page is read as a stream of text tokens, each with the path of block elements that hold it; inline
markup belongs to the text. A wrapper is a union-free regular expression over such streams: a
sequence of tokens, some optional, some repeated, whose texts are constant or slots. It is inferred
by aligning the streams of the same host: tokens that are equal in path and text, and occur once on either side, are
anchors; between them, differing texts of one path become a slot, tokens that one side lacks become
optional (found by looking ahead on both sides), and tokens of one path that follow each other become
a repeated group. Wrappers align with wrappers in the same way: pages are ordered by a hash of
their streams and merged in rounds, by ever shorter prefixes of the hash, so that each task folds a
few wrappers of a host and the result does not depend on how pages are partitioned. A wrapper keeps
all its tokens: one that only one page had so far may still meet its like on a page that comes later.

A wrapper tells which texts are the same on the host's pages, which are no part of an article, and which
element holds the text that varies. A page's own marks come first: ``article`` and ``main``
elements name the article; menus, headers, footers, sidebars, notices, adverts, forms and
comments, by element or role, are no part of it, nor are elements of which a whole class name says
so and that hold no marked article. Inside a marked article, texts that nearly all pages of the host share are left out as well,
unless they are a large part of it. Without marks the host's
wrapper, and failing that the page's own densest element, tells where the article is.

Defined cases: a null or empty page has an empty text, and so has a page without text
outside the parts named above. Unclosed and misnested elements are closed as browsers do
for paragraphs, list items and cells. Pages without a host share one wrapper. Pages with equal
streams count once for the wrapper. Repeated rows get equal texts.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookloom.llm.common import broadcast_if_small, whole_text
from hookloom.llm.urls import url_host
from hookloom.session import stage_table

# A quoted value may hold >, but an unclosed quote must not swallow the page.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[^>\"']++|\"[^\"]{0,4096}+\"|'[^']{0,4096}+')*+>|[^>]*+>)",
    re.DOTALL,
)
UNCLOSED = re.compile(r"<(?:!--.*|[a-zA-Z/!?][^<]*)\Z", re.DOTALL)
# Elements nested deeper belong to the element at this depth.
MAX_DEPTH = 150
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Elements by their part in a page.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary nav header footer aside form fieldset center hgroup "
    "dialog menu search noscript template svg iframe button select textarea head title object video audio canvas".split()
)
RAW = frozenset("script style textarea title noscript iframe template".split())
DROPPED = frozenset(
    "nav aside footer form head dialog menu search svg button select object video audio canvas fieldset".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_PARAGRAPH = BLOCKS - frozenset("button select object video audio canvas svg".split())
SAME_LEVEL = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["td", "th", "tr"]),
}
SCOPES = frozenset("ul ol dl table".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CHROME = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar header footer sidebar aside widget widgets "
    "related recommended recommendations share sharing social ad ads advert adverts advertisement advertisements adsense "
    "banner promo promotion promotions sponsor sponsored sponsors cookie cookies consent gdpr notice notices popup modal "
    "overlay newsletter subscribe subscription signup login search comment comments commentlist disqus reply replies "
    "respond pagination pager copyright disclaimer teaser teasers toolbar skip".split()
)
ARTICLE_CHROME = frozenset("comment comments reply ad ads advert advertisement sponsored promo related teaser teasers".split())
# Words that class names of the above hold besides; and those of an article, whose own header holds its title.
NEUTRAL = frozenset(
    "site global top main primary secondary left right bottom upper lower box bar list wrap wrapper container inner outer area "
    "section block slot unit group item items links link buttons button icons posts post title form text thread content body "
    "article entry story page module panel region holder row col column mobile desktop sticky fixed js id".split()
)
ARTICLE_WORDS = frozenset("article entry story post page content main".split())


class Element:
    __slots__ = ("tag", "label", "path", "dropped", "weak", "soft", "inside", "main", "chars", "links", "parent", "depth")

    def __init__(self, tag: str, label: str, parent: Element | None):
        self.tag, self.label, self.parent = tag, label, parent
        self.depth = parent.depth + 1 if parent is not None else 0
        self.path = _path_key(parent.path, label) if parent is not None else 0
        self.dropped = self.weak = self.soft = self.inside = self.main = False
        self.chars, self.links = 0, 0


def _path_key(parent: int, label: str) -> int:
    """A path of labels as a whole number of 56 bits."""
    return int.from_bytes(blake2b(f"{parent} {label}".encode("utf-8", "replace"), digest_size=7).digest())


def _names_chrome(names: list[list[str]], chrome: frozenset[str] = CHROME) -> bool:
    """Whether a whole class name or id says that the element is no part of an article.

    All its words must be such words or neutral ones: a search result, social science or a
    layout with a sidebar are none of them.
    """
    return any(not chrome.isdisjoint(parts) and all(part in CHROME or part in NEUTRAL for part in parts) for parts in names)


def _attributes(source: str) -> tuple[list[list[str]], str, bool]:
    """Words of each class and of the id, the role, and whether the element is hidden."""
    names, role, hidden = [], "", False
    for name, *values in ATTRIBUTE.findall(source):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            names += [[part.lower() for part in NAME_PARTS.findall(one)] for one in value.split()]
        elif name == "role":
            role = value.lower()
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        else:
            hidden |= name == "hidden" or value.lower() == "true"
    return names, role, hidden


def read_page(page: str) -> list[tuple[Element, str, int]]:
    """The text blocks in page order: element, text and how many of its characters are links."""
    root = top = Element("", "", None)
    blocks: list[tuple[Element, str, int]] = []
    pieces: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                blocks.append((top, text, min(linked, len(text))))
                top.chars += len(text)
                top.links += min(linked, len(text))
        linked = 0

    at, size = 0, page.rfind(">") + 1
    tail = UNCLOSED.sub("", page[size:])
    lowered = None
    unopened: dict[str, int] = {}
    while at < size:
        match = MARKUP.search(page, at, size)
        if not match:
            pieces.append(page[at:size])
            break
        if match.start() > at:
            pieces.append(page[at:match.start()])
            if links:
                linked += match.start() - at
        at = match.end()
        tag = match.group(2)
        if not tag:
            continue
        tag, closing = tag.lower(), match.group(1)
        if not closing and (tag in RAW or tag == "script"):
            lowered = page.lower() if lowered is None else lowered
            end = lowered.find(f"</{tag}", at) if len(lowered) == len(page) else page.find(f"</{tag}", at)
            end = page.find(">", end) if end >= 0 else -1
            at, tail = (size, "") if end < 0 else (end + 1, tail)
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            pieces.append("\n")
            continue
        if tag == "hr":
            flush()
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            if unopened.get(tag):
                unopened[tag] -= 1
                continue
            holder = top
            while holder is not root and holder.tag != tag:
                holder = holder.parent
            if holder is not root:
                top = holder.parent
            continue
        if top.tag == "p" and tag in CLOSES_PARAGRAPH:
            top = top.parent
        if level := SAME_LEVEL.get(tag):
            holder = top
            while holder is not root and holder.tag not in SCOPES and holder.tag not in level:
                holder = holder.parent
            while holder is not root and holder.tag in level:
                top, holder = holder.parent, holder.parent
        if top.depth >= MAX_DEPTH:
            unopened[tag] = unopened.get(tag, 0) + 1
            continue
        names, role, hidden = _attributes(match.group(3)) if len(match.group(3)) > 2 else ([], "", False)
        child = Element(tag, " ".join([tag, *(part for parts in names for part in parts)]), top)
        child.main = tag in ("article", "main") or role == "main"
        child.inside = top.inside or child.main
        child.soft = top.soft
        if child.main:
            # A mark weighs more than class names around it.
            child.dropped = top.dropped or hidden
            child.weak = _names_chrome(names, ARTICLE_CHROME)
        elif tag in ("html", "body"):
            child.dropped, child.weak = top.dropped, top.weak
        else:
            strong, weak = False, _names_chrome(names)
            if top.inside and tag in ("header", "hgroup"):
                child.soft, weak = True, False  # an article's own header may hold its title
            elif tag == "header":
                strong = True
            elif weak and any("header" in parts and not ARTICLE_WORDS.isdisjoint(parts) for parts in names):
                child.soft, weak = True, False
            child.dropped = top.dropped or hidden or strong or tag in DROPPED or role in ROLES
            child.weak = top.weak or weak
        top = child
        if match.group(3).endswith("/>") and tag in ("object", "svg", "canvas"):
            top = child.parent
    if tail:
        pieces.append(tail)
    flush()
    return blocks


# A wrapper token: path, text (a checksum, -1 for a slot), pages, optional, repeated, chars, link chars, dropped, path
# of its holder.
PATH, TEXT, PAGES, OPTIONAL, REPEATED, CHARS, LINKS, GONE, HOLDER = range(9)
SLOT = -1


def _holder(element: Element) -> Element:
    """The element that holds a paragraph and its like, else the element itself."""
    held = element.tag in ("p", "li", "pre", "blockquote", *HEADINGS) and element.parent is not None
    return element.parent if held else element


def page_tokens(page: str) -> list[list]:
    """The token stream of a page; equal tokens that follow each other are one, repeated."""
    tokens: list[list] = []
    for element, text, links in read_page(page):
        checksum = zlib.crc32(text.encode("utf-8", "replace"))
        if tokens and tokens[-1][PATH] == element.path and tokens[-1][TEXT] == checksum:
            tokens[-1][REPEATED] = 1
            continue
        holder = _holder(element)
        tokens.append([element.path, checksum, 1, 0, 0, len(text), links, int(element.dropped or element.weak), holder.path])
    return tokens


def _merged(a: list, b: list) -> list:
    """One token for two of the same path: constant if their texts are equal, else a slot."""
    return [
        a[PATH], a[TEXT] if a[TEXT] == b[TEXT] else SLOT, a[PAGES] + b[PAGES], a[OPTIONAL] | b[OPTIONAL],
        a[REPEATED] | b[REPEATED], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], a[GONE] & b[GONE], a[HOLDER],
    ]


def _add_optional(out: list[list], token: list) -> None:
    """Append a token that one side lacks, or let it repeat the one before it."""
    last = out[-1] if out else None
    # Constant texts of several pages stay what they are.
    loose = last is not None and last[PATH] == token[PATH] and (token[TEXT] == SLOT or token[PAGES] < 3) and (
        last[TEXT] == SLOT or (last[OPTIONAL] and last[PAGES] < 2)
    )
    if loose or (last is not None and last[PATH] == token[PATH] and last[TEXT] == token[TEXT]):
        joined = _merged(last, token)
        joined[PAGES], joined[OPTIONAL], joined[REPEATED] = max(last[PAGES], token[PAGES]), last[OPTIONAL], 1
        out[-1] = joined
    else:
        out.append([*token[:OPTIONAL], 1, *token[OPTIONAL + 1:]])


def _resolve(a: list[list], b: list[list], out: list[list]) -> None:
    """Align stretches without anchors: slots where paths agree, else the nearer way to an agreement."""
    places: list[dict[int, list[int]]] = [{}, {}]
    for side, tokens in enumerate((a, b)):
        for at, token in enumerate(tokens):
            places[side].setdefault(token[PATH], []).append(at)

    def ahead(side: int, path: int, start: int) -> int | None:
        found = places[side].get(path, ())
        at = bisect_left(found, start)
        return found[at] if at < len(found) else None

    i = j = 0
    while i < len(a) and j < len(b):
        if a[i][PATH] == b[j][PATH]:
            out.append(_merged(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        in_b, in_a = ahead(1, a[i][PATH], j), ahead(0, b[j][PATH], i)
        if in_b is not None and (in_a is None or in_b - j <= in_a - i):
            for token in b[j:in_b]:
                _add_optional(out, token)
            j = in_b
        elif in_a is not None:
            for token in a[i:in_a]:
                _add_optional(out, token)
            i = in_a
        elif out and out[-1][PATH] == b[j][PATH]:
            _add_optional(out, b[j])  # more of what repeats
            j += 1
        else:
            _add_optional(out, a[i])
            i += 1
    for token in a[i:] + b[j:]:
        _add_optional(out, token)


def _anchors(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Places of the longest common run, in order, of tokens that occur once on either side."""
    keys: list[dict[tuple, int]] = []
    for tokens in (a, b):
        seen: dict[tuple, int] = {}
        for at, token in enumerate(tokens):
            key = (token[PATH], token[TEXT])
            seen[key] = -1 if key in seen else at
        keys.append(seen)
    pairs = [(at, keys[1].get(key, -1)) for key, at in keys[0].items() if at >= 0]
    pairs = sorted(pair for pair in pairs if pair[1] >= 0)
    # Longest increasing run by patience sorting.
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for at, (_, place) in enumerate(pairs):
        pile = bisect_left(tops, place)
        before[at] = piles[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(place)
            piles.append(at)
        else:
            tops[pile], piles[pile] = place, at
    run = []
    at = piles[-1] if piles else -1
    while at >= 0:
        run.append(pairs[at])
        at = before[at]
    return run[::-1]


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of two wrappers or streams."""
    out: list[list] = []
    i = j = 0
    for x, y in [*_anchors(a, b), (len(a), len(b))]:
        _resolve(a[i:x], b[j:y], out)
        if x < len(a):
            out.append(_merged(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def wrapper_plan(tokens: list[list], pages: int) -> dict:
    """What a host's wrapper says: the element of the varying text, and the constant texts by path."""
    mass: dict[int, int] = {}
    for token in tokens:
        if token[TEXT] == SLOT and not token[GONE]:
            mass[token[HOLDER]] = mass.get(token[HOLDER], 0) + token[CHARS] - token[LINKS]
    best = max(mass.items(), key=lambda pair: (pair[1], -pair[0]), default=(0, 0))
    found = best[1] > 0
    fixed = [[t[PATH], t[TEXT], t[PAGES]] for t in tokens if t[TEXT] != SLOT and t[PAGES] >= max(3, pages / 2)]
    return {"main": best[0] if found and pages > 1 else 0, "fixed": fixed if found else [], "pages": pages}


def _within(element: Element, holder: Element) -> bool:
    step: Element | None = element
    while step is not None:
        if step is holder:
            return True
        step = step.parent
    return False


def main_text(page: str, plan: dict | None = None) -> str:
    """The article of a page, its blocks joined by empty lines."""
    plan = plan or {"main": 0, "fixed": [], "pages": 0}
    kept = [
        (element, text) for element, text, _ in read_page(page)
        if not element.dropped and not element.weak and (not element.soft or element.tag in HEADINGS)
    ]
    mass: dict[int, int] = {}
    named: dict[int, Element] = {}
    for element, text in kept:
        step: Element | None = element
        while step is not None:
            if step.main:
                mass[id(step)] = mass.get(id(step), 0) + len(text)
                named[id(step)] = step
            step = step.parent
    if named:
        articles = [key for key in named if named[key].tag == "article"]
        largest = max(mass.values())
        pool = [key for key in articles if mass[key] * 4 >= largest] or list(named)
        chosen = named[max(pool, key=mass.get)]
        while (outer := next((e for e in _ancestors(chosen) if e.tag == "article"), None)) is not None:
            chosen = outer
        inside = [(element, text) for element, text in kept if _within(element, chosen)]
        # What nearly all pages of a host of several share is no article's own, unless it is much of it.
        shared = {(path, text) for path, text, pages in plan["fixed"] if pages >= max(4, 0.9 * plan["pages"])}
        own = _without(inside, shared)
        if 5 * sum(len(text) for _, text in own) >= 4 * sum(len(text) for _, text in inside):
            inside = own
        return "\n\n".join(text for _, text in inside)

    kept = _without(kept, {(path, text) for path, text, _ in plan["fixed"]}) or kept
    chosen = _planned(kept, plan["main"]) or _densest(kept)
    if chosen is None:
        return ""
    return "\n\n".join(text for element, text in kept if _within(element, chosen))


def _without(blocks: list[tuple[Element, str]], fixed: set[tuple[int, int]]) -> list[tuple[Element, str]]:
    if not fixed:
        return blocks
    paths = {path for path, _ in fixed}
    return [
        (element, text) for element, text in blocks
        if element.path not in paths or (element.path, zlib.crc32(text.encode("utf-8", "replace"))) not in fixed
    ]


def _ancestors(element: Element) -> Iterator[Element]:
    step = element.parent
    while step is not None:
        yield step
        step = step.parent


def _planned(kept: list[tuple[Element, str]], path: int) -> Element | None:
    """The element on the wrapper's path to the article that holds most text."""
    mass: dict[int, int] = {}
    found: dict[int, Element] = {}
    for element, text in kept if path else ():
        for step in (element, *_ancestors(element)):
            if step.path == path:
                mass[id(step)] = mass.get(id(step), 0) + len(text)
                found[id(step)] = step
    return found[max(mass, key=mass.get)] if mass else None


def _densest(kept: list[tuple[Element, str]]) -> Element | None:
    """The element whose own blocks hold most text that is no link."""
    score: dict[int, int] = {}
    holders: dict[int, Element] = {}
    for element, text in kept:
        holder = _holder(element)
        holders[id(holder)] = holder
        score[id(holder)] = score.get(id(holder), 0) + max(len(text) - element.links, 0)
    return holders[max(score, key=score.get)] if score else None


# A round shortens prefixes by so many bits: sixteen wrappers become one, on average.
_BITS = 4


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host`` and ``plan`` (JSON) of hosts with several pages, from ``host`` and ``html``."""
    @F.pandas_udf("struct<mark: long, tokens: string>")
    def streams(contents: pd.Series) -> pd.DataFrame:
        tokens = [json.dumps(page_tokens(content), separators=(",", ":")) for content in contents]
        marks = [int.from_bytes(blake2b(one.encode(), digest_size=8).digest(), signed=True) for one in tokens]
        return pd.DataFrame({"mark": pd.Series(marks, dtype="int64"), "tokens": pd.Series(tokens, dtype=object)})

    read = pages.select("host", streams("html").alias("s")).select("host", "s.mark", "s.tokens")
    # Equal streams count once; a host with one stream has nothing to align.
    distinct = stage_table(read.groupBy("host", "mark").agg(F.first("tokens").alias("tokens")), "html-streams")
    sizes = stage_table(distinct.groupBy("host").agg(F.count("*").alias("pages")).filter("pages > 1"), "html-hosts")
    # A host of n streams takes the least rounds whose fan-in reaches n.
    rounds = F.ceil(F.log2(F.col("pages")) / _BITS).cast("int")
    hosts = stage_table(sizes.select("host", F.greatest(rounds, F.lit(1)).alias("rounds")), "html-rounds")
    parts = distinct.join(broadcast_if_small(hosts), "host").withColumn("pages", F.lit(1).cast("long"))
    most = hosts.agg(F.max("rounds")).first()[0] or 0

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Fold rows of one host and prefix, which come sorted by their marks; one wrapper in memory."""
        group: tuple | None = None
        whole: list[list] = []
        mark = pages = 0
        for frame in frames:
            done = []
            for host, prefix, own, tokens, count, left in zip(*(frame[name] for name in frame.columns)):
                if (host, prefix, left) != group:
                    if group is not None:
                        done.append((group[0], mark, json.dumps(whole, separators=(",", ":")), pages, group[2]))
                    group, whole, mark, pages = (host, prefix, left), json.loads(tokens), own, count
                else:
                    whole = align(whole, json.loads(tokens))
                    pages += count
            yield pd.DataFrame(done, columns=["host", "mark", "tokens", "pages", "rounds"])
        if group is not None:
            last = (group[0], mark, json.dumps(whole, separators=(",", ":")), pages, group[2])
            yield pd.DataFrame([last], columns=["host", "mark", "tokens", "pages", "rounds"])

    columns = ["host", "mark", "tokens", "pages", "rounds"]
    for step in range(most, 0, -1):
        # Groups share the first bits of their marks, fewer in each round; smaller hosts come in later.
        shift = 64 - _BITS * (step - 1)
        prefix = F.shiftrightunsigned("mark", shift) if shift < 64 else F.lit(0).cast("long")
        now = parts.filter(F.col("rounds") >= step).withColumn("prefix", prefix)
        merged = now.repartition("host", "prefix").sortWithinPartitions("host", "prefix", "mark").select(
            "host", "prefix", "mark", "tokens", "pages", "rounds"
        ).mapInPandas(merge, "host string, mark long, tokens string, pages long, rounds int")
        later = parts.filter(F.col("rounds") < step).select(*columns)
        parts = stage_table(merged.union(later), "html-wrappers")

    @F.pandas_udf("string")
    def plans(tokens: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(wrapper_plan(json.loads(t), int(n))) for t, n in zip(tokens, pages)], dtype=object)

    return stage_table(parts.select("host", plans("tokens", "pages").alias("plan")), "html-plans")


def extract_main_text(
    pages: DataFrame, carry: list[str], url: str = "url", page: str = "html",
) -> DataFrame:
    """One row per page: ``row`` (the carried columns) and ``text``."""
    source = pages.select(
        F.struct(*(F.col(f"`{name}`") for name in carry)).alias("row"),
        url_host(F.col(f"`{url}`")).alias("host"), whole_text(F.col(f"`{page}`")).alias("html"),
    )
    plans = infer_wrappers(source.select("host", "html"))

    @F.pandas_udf("string")
    def extract(contents: pd.Series, plan_texts: pd.Series) -> pd.Series:
        known: dict[str, dict] = {}
        texts = []
        for content, plan_text in zip(contents, plan_texts):
            plan = known.get(plan_text)
            if plan is None and plan_text:
                if len(known) > 1000:
                    known.clear()
                plan = known[plan_text] = json.loads(plan_text)
            texts.append(main_text(content, plan))
        return pd.Series(texts, dtype=object)

    found = source.join(broadcast_if_small(plans), "host", "left")
    return found.select("row", extract("html", "plan").alias("text"))


def html_report(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    found = extract_main_text(pages, ["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
