"""Main text of web pages by inferred wrappers.

Pages of one host are mostly made from one template, a union-free regular
expression over tokens that is inferred from all of them: it starts as one page
and is aligned with the others; where they do not match, text becomes a slot, a
stretch that only one side has becomes optional, and a stretch that repeats what
stands before it becomes a repeated group. Over a table, every page is aligned
with the host's first one where it lies, and what the alignments agree on is
counted, so the pages of a host needn't meet in one place.

What the wrapper holds for every page is the template's, each text in its place.
What stands in its slots, optional and repeated groups differs by page; the
region of the article is the innermost element, told by its place, that holds
most of that text over all pages. A page's main text is what stands there.
Element names are a check: the region grows to the article or main element
around it. Regions that are never main text (menus, notices, forms, comments and
the like) are told by their elements and class names.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import cut, slices

#: Characters of first pages, and digests of pages already read, that a task remembers at most.
REMEMBERED, DIGESTS = 4 << 20, 100_000
#: Tags that a task remembers at most, and the characters of one.
TAGS, SHORT_TAG = 1 << 14, 256
#: Share of the text that differs by page which the region of the article holds.
MOST = 0.6
#: Words of a block that counts for it: lists of short texts say nothing of where the article is.
PROSE = 10

# Element names of the markup language.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset(
    "script style noscript template iframe head title nav footer aside form menu button select option textarea "
    "input dialog svg math canvas object embed audio video map datalist".split())
SECTIONS = frozenset("p li dt dd tr td th option".split())  # closed by the next of their kind
#: Words in class, id or role that mark what is not main text, in names made of them and of PLAIN words only.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside toc pager pagination footer header "
    "masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter "
    "subscribe subscription signup login comment comments commentlist disqus reply replies respond discussion "
    "share sharing social related recommended widget widgets contentinfo complementary search skip".split())
PLAIN = frozenset(
    "area bar block body bottom box button buttons container content form global group id inner item items left link "
    "links list main outer page panel post posts primary right secondary section site text top wrap wrapper".split())
CONTAINERS = frozenset("html body main article section div center table tbody tr td".split())
#: Words in class, id or role that mark readers' comments, whatever else the name says.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
MAIN = frozenset("article main".split())
MAIN_MARKS = frozenset("article content maincontent articlebody".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
WORDS = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Token:
    """A tag (``name``, with ``</`` if it closes) or a text (``name`` empty)."""

    name: str
    text: str = ""
    marks: tuple[str, ...] = ()
    marked: bool = False  # as what is not main text
    comments: bool = False  # as readers' comments
    #: What must agree for two tokens to match, apart from text; the marks of html and body vary by page.
    key: str = field(init=False, default="")

    def __post_init__(self):
        if self.name:
            self.key = self.name + "." + ("" if self.name in ("html", "body") else ".".join(self.marks))


def _tag(tag: str) -> Token:
    name = re.match(r"</?([a-zA-Z][^\s/>]*)", tag)[1].lower()
    if tag[1] == "/":
        return Token("</" + name)
    marks, marked, comments = [], False, False
    for m in ATTRIBUTE.finditer(tag):
        for label in (m[2] or m[3] or m[4] or "").lower().split():
            words = WORDS.findall(label)
            marks += words
            comments = comments or not COMMENTS.isdisjoint(words)
            marked = marked or comments or not MARKS.isdisjoint(words) and all(x in MARKS or x in PLAIN for x in words)
    return Token(name, marks=tuple(marks), marked=marked, comments=comments)


def tokens(page: str, tags: dict[str, Token] | None = None) -> list[Token]:
    """The tags and texts of a page; comments, declarations and raw elements' contents are left out.

    ``tags`` remembers short tags for the next page, most of which pages of a host share.
    """
    tags = {} if tags is None else tags
    out: list[Token] = []
    at = 0
    while at < len(page):
        found = TOKEN.search(page, at)
        text = page[at:found.start()] if found else page[at:]
        if text and not text.isspace():
            out.append(Token("", text))
        elif text:
            out.append(Token("", " "))
        if not found:
            break
        at, tag = found.end(), found[0]
        if tag[1] in "!?":
            continue
        token = tags.get(tag)
        if token is None:
            token = _tag(tag)
            if len(tag) <= SHORT_TAG:
                if len(tags) >= TAGS:
                    tags.clear()
                tags[tag] = token
        out.append(token)
        if token.name in RAW and not tag.endswith("/>"):
            end = re.compile(rf"</{token.name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            out.append(Token("</" + token.name))
    return out


# A wrapper is a list of parts: ("tag", key, place), ("text", constant, place),
# ("slot", place), ("some", parts) for an optional stretch and ("more", parts)
# for a repeated one. A place tells the elements that a part stands in.


def _words(text: str) -> str:
    """A text as blocks show it: references decoded, single spaces."""
    return " ".join(entities.unescape(text).split())


def _parts(page: list[Token], place: list[int] | None = None) -> list[tuple]:
    parts = (("tag", t.key, at) if t.name else ("text", _words(t.text), at)
             for t, at in zip(page, place or _layout(page)[0], strict=True) if t.name or t.text != " ")
    once: dict[tuple, tuple] = {}
    return [once.setdefault(p, p) for p in parts]


def _same(a: tuple, b: tuple) -> bool:
    if a[0] in ("text", "slot") and b[0] in ("text", "slot"):
        return a[-1] == b[-1]
    return a == b


def _meet(a: tuple, b: tuple) -> tuple:
    return a if a == b else ("slot", a[-1])


def generalise(wrapper: list[tuple], page: list[tuple]) -> list[tuple]:
    """The wrapper after an alignment with one more page."""
    out: list[tuple] = []
    tags: dict[tuple, list[int]] = {}
    for k, part in enumerate(page):
        if part[0] == "tag":
            tags.setdefault(part, []).append(k)
    i = j = 0
    while i < len(wrapper) or j < len(page):
        if i < len(wrapper) and wrapper[i][0] in ("some", "more"):
            body = wrapper[i][1]
            end, used = _repeat(body, page, j, wrapper[i][0] == "more")
            out.append((wrapper[i][0], tuple(used)))
            i, j = i + 1, end
        elif i < len(wrapper) and j < len(page) and _same(wrapper[i], page[j]):
            out.append(_meet(wrapper[i], page[j]))
            i, j = i + 1, j + 1
        else:
            skip_w, skip_p = _next_match(wrapper, i, tags, j, len(page))
            for stretch in (wrapper[i:i + skip_w], page[j:j + skip_p]):
                if stretch:
                    _add_stretch(out, stretch)
            i, j = i + skip_w, j + skip_p
    return out


def _next_match(a: list[tuple], i: int, tags: dict[tuple, list[int]], j: int, end: int) -> tuple[int, int]:
    """How many parts to pass over on either side to the nearest pair of equal
    tags, by the places of each tag on the page. What it looks at is passed over."""
    best = (len(a) - i, end - j)
    for x in range(len(a) - i):
        if x >= sum(best):
            break
        at = tags.get(a[i + x], ())
        k = bisect_left(at, j)
        if k < len(at) and x + at[k] - j < sum(best):
            best = (x, at[k] - j)
    return best


def _add_stretch(out: list[tuple], stretch: list[tuple]) -> None:
    """Append a stretch that only one side has: as a repeated group if it says
    again what stands just before it, else as optional."""
    n = len(stretch)
    for width in range(1, n + 1):
        if n % width:
            continue
        unit = stretch[:width]
        if any(p[0] in ("some", "more") for p in unit):
            break
        if not all(_same(unit[k % width], p) for k, p in enumerate(stretch)):
            continue
        before = out[-width:]
        if len(before) == width and all(_same(x, y) for x, y in zip(before, unit, strict=True)):
            del out[-width:]
            body = list(before)
            for k in range(0, n, width):
                body = [_meet(x, y) for x, y in zip(body, stretch[k:k + width], strict=True)]
            while len(out) >= width and all(_same(x, y) for x, y in zip(out[-width:], body, strict=True)):
                body = [_meet(x, y) for x, y in zip(body, out[-width:], strict=True)]
                del out[-width:]
            out.append(("more", tuple(body)))
            return
        if out and out[-1][0] == "more" and len(out[-1][1]) == width and all(
                _same(x, y) for x, y in zip(out[-1][1], unit, strict=True)):
            out[-1] = ("more", tuple(_meet(x, y) for x, y in zip(out[-1][1], unit, strict=True)))
            return
    out.append(("some", tuple(stretch)))


def _repeat(body, page: list[tuple], j: int, many: bool):
    """Read ``body`` from the page as often as it stands there; the place after it and the body met with it."""
    while True:
        at, met = j, []
        for part in body:
            if part[0] in ("some", "more"):
                at, inner = _repeat(part[1], page, at, part[0] == "more")
                met.append((part[0], tuple(inner)))
            elif at < len(page) and _same(part, page[at]):
                met.append(_meet(part, page[at]))
                at += 1
            else:
                return j, body
        if at == j:
            return j, body
        j, body = at, met
        if not many:
            return j, body


def infer(pages: list[str]) -> list[tuple]:
    """The wrapper of some pages of one host."""
    wrapper: list[tuple] | None = None
    for page in pages:
        parts = _parts(tokens(page))
        wrapper = parts if wrapper is None else generalise(wrapper, parts)
    return wrapper or []


def fixed(wrapper: list[tuple], sampled: int) -> list[tuple[int, str]]:
    """(place, text) of the texts that the wrapper holds for every page; none if it comes from one page."""
    if sampled < 2:
        return []
    found: dict[tuple[int, str], None] = {}

    def walk(parts):
        for part in parts:
            if part[0] == "text":
                found[part[2], part[1]] = None
            elif part[0] == "more":
                walk(part[1])

    walk(wrapper)
    return list(found)


def constants(wrapper: list[tuple], sampled: int) -> list[str]:
    """The texts of ``fixed``."""
    return list(dict.fromkeys(text for _, text in fixed(wrapper, sampled)))


def _layout(page: list[Token]) -> tuple[list[int], list[int]]:
    """Of each token, a checksum of the open elements it stands in, its own included, and where it ends if it opens one."""
    place, end = [0] * len(page), [0] * len(page)
    open_: list[tuple[str, int]] = []  # name, token

    def leave(n: int, at: int):
        while len(open_) > n:
            end[open_.pop()[1]] = at

    for k, t in enumerate(page):
        name = t.name
        if name.startswith("</"):
            name = name[2:]
            depth = next((d for d in range(len(open_) - 1, -1, -1) if open_[d][0] == name), None)
            if depth is not None and (name not in INLINE or all(x[0] in INLINE for x in open_[depth:])):
                place[k] = place[open_[depth][1]]
                leave(depth, k)
                continue
        elif name and name not in VOID and name not in INLINE:
            while open_ and open_[-1][0] in INLINE:
                leave(len(open_) - 1, k)
            if open_ and (open_[-1][0] == "p" or open_[-1][0] == name and name in SECTIONS):
                leave(len(open_) - 1, k)
        place[k] = place[open_[-1][1]] if open_ else 0
        if t.name and not t.name.startswith("</"):
            place[k] = zlib.crc32(t.key.encode("utf-8", "surrogatepass"), place[k])
            if name not in VOID:
                open_.append((name, k))
    leave(0, len(page))
    return place, end


def _spared(page: list[Token]) -> set[int]:
    """The marked elements that are no reason to drop anything: they hold most
    of the text of the page's article and main elements, or of the whole page
    if it has none. Comments may be longer than what they are about, so an element
    marked as theirs is spared if it holds an article, main or h1 element."""
    if not any(t.marked for t in page):
        return set()
    _, end = _layout(page)
    every, inside = [0], [0]  # characters before each token
    never = main = 0  # where the regions end
    for k, t in enumerate(page):
        if end[k] > never and t.name in NEVER:
            never = end[k]
        if end[k] > main and t.name in MAIN and k >= never:
            main = end[k]
        size = 0 if t.name or k < never else len(t.text.strip())
        every.append(every[-1] + size)
        inside.append(inside[-1] + (size if k < main else 0))
    of = inside if inside[-1] else every
    titles = [k for k, t in enumerate(page) if t.name == "h1" or t.name in MAIN]

    def holds(k: int) -> bool:
        if page[k].comments:
            return bisect_left(titles, k) < bisect_left(titles, end[k])
        return 2 * (of[end[k]] - of[k]) > of[-1]

    return {k for k, t in enumerate(page) if t.marked and holds(k)}


@dataclass(slots=True)
class Block:
    words: str
    linked: int  # characters in links
    main: int  # 2 in an article or main element, 1 in an element marked as one, else 0
    texts: list[int]  # its tokens
    home: int = -1  # the outermost article it stands in, or main element if in no article
    title: bool = False  # in an h1 element


def _blocks(page: list[Token]) -> list[Block]:
    """The texts between block borders outside of regions that are never main text."""
    open_: list[tuple[str, bool, int, int]] = []  # name, never main text, main region, token
    out: list[Block] = []
    text: list[str] = []
    of: list[int] = []
    linked = never = 0
    main = [0, 0, 0]  # open regions by kind

    def flush():
        nonlocal linked
        words = " ".join(entities.unescape("".join(text)).split())
        if words:
            around = {x[0]: x[3] for x in reversed(open_) if x[0] in MAIN or x[0] == "h1"}
            out.append(Block(words, linked, 2 if main[2] else 1 if main[1] else 0, of.copy(),
                             around.get("article", around.get("main", -1)), "h1" in around))
        text.clear()
        of.clear()
        linked = 0

    def leave(n: int):
        nonlocal never
        while len(open_) > n:
            _, bad, kind, _ = open_.pop()
            never -= bad
            main[kind] -= 1

    links = 0
    spared = _spared(page)
    for k, t in enumerate(page):
        if not t.name:
            if not never:
                text.append(t.text)
                if t.text != " ":
                    of.append(k)
                linked += len(t.text.strip()) if links else 0
            continue
        name = t.name
        if name.startswith("</"):
            name = name[2:]
            if name not in INLINE:
                flush()
            if name == "a":
                links = 0
            depth = next((d for d in range(len(open_) - 1, -1, -1) if open_[d][0] == name), None)
            if depth is not None and (name not in INLINE or all(x[0] in INLINE for x in open_[depth:])):
                leave(depth)
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if name in SECTIONS or name not in INLINE:
            # An open inline element does not outlive its block; p, li and the like end the last of their kind.
            while open_ and open_[-1][0] in INLINE:
                leave(len(open_) - 1)
                links = 0
            if open_ and (open_[-1][0] == "p" or open_[-1][0] == name and name in SECTIONS):
                leave(len(open_) - 1)
        if name == "a":
            links = 1
        bad = name in NEVER or (name not in ("html", "body", *MAIN) and t.marked and k not in spared) or (
            name == "header" and not main[1] + main[2])
        marked = not MAIN_MARKS.isdisjoint(t.marks) and name not in ("html", "body")
        kind = 0 if bad else 2 if name in MAIN else 1 if marked else 0
        open_.append((name, bad, kind, k))
        never += bad
        main[kind] += 1
    flush()
    return out


@dataclass(slots=True)
class Share:
    """What a page says of where the article is, in characters: those of texts that are not
    of the template, and those of texts (their numbers) that may be."""

    places: dict[int, tuple[int, int]]  # by container's place: characters in it, how deep it stands
    total: int
    open_: dict[int, int]  # by text


def _share(page: list[Token], layout: tuple[list[int], list[int]], numbers: dict[tuple[int, str], int]) -> Share:
    """The share of one page; ``numbers`` has the (place, text) that may be the template's.

    Blocks of few words, and those of regions that are never main text or mostly links, don't count.
    """
    place, end = layout
    size = [0] * (len(page) + 1)
    out = Share({}, 0, {})
    for block in _blocks(page):
        if 2 * block.linked < len(block.words) and block.words.count(" ") + 1 >= PROSE:
            for k in block.texts:
                words = _words(page[k].text)
                number = numbers.get((place[k], words))
                if number is None:
                    size[k + 1] = len(words)
                else:
                    out.open_[number] = out.open_.get(number, 0) + len(words)
    for k in range(len(page)):
        size[k + 1] += size[k]
    out.total = size[-1]
    ends: list[int] = []
    for k, t in enumerate(page):
        while ends and ends[-1] <= k:
            ends.pop()
        if end[k] and t.name in CONTAINERS:
            ends.append(end[k])
            held, depth = out.places.get(place[k], (0, 0))
            out.places[place[k]] = held + size[end[k]] - size[k], max(depth, len(ends))
    return out


def region(pages: list[str], known: frozenset) -> int | None:
    """The place of the innermost container that holds most of the text that differs by page; None if there is none.

    Texts of the template, blocks of few words, and those of regions that are
    never main text or mostly links, don't count.
    """
    found: dict[int, tuple[int, int]] = {}
    total = 0
    for page in map(tokens, pages):
        share = _share(page, _layout(page), dict.fromkeys(known, 0))
        total += share.total
        for at, (n, deep) in share.places.items():
            held, depth = found.get(at, (0, 0))
            found[at] = held + n, max(depth, deep)
    most = [p for p, (n, _) in found.items() if total and n >= MOST * total]
    return max(most, key=lambda p: (found[p][1], found[p][0], p), default=None)


class First:
    """The first page of a host, that the others are aligned with: its parts, and the (place, text) of its texts
    by number with the places of the containers around each."""

    def __init__(self, html: str):
        page = tokens(html)
        place, end = _layout(page)
        self.parts = _parts(page, place)
        self.numbers = {text: n for n, text in enumerate(fixed(self.parts, 2))}
        self.around: dict[int, list[int]] = {}
        open_: list[tuple[int, int]] = []  # end, place
        for k, t in enumerate(page):
            while open_ and open_[-1][0] <= k:
                open_.pop()
            if end[k] and t.name in CONTAINERS:
                open_.append((end[k], place[k]))
            elif not t.name and t.text != " ":
                self.around[self.numbers[place[k], _words(t.text)]] = [at for _, at in open_]

    def held(self, parts: list[tuple]) -> list[int]:
        """The numbers of the texts that are constant in the alignment with a page."""
        return sorted(n for text in fixed(generalise(self.parts, parts), 2) if (n := self.numbers.get(text)) is not None)


def main_text(page: str, known: frozenset, where: int | None = None, tags: dict[str, Token] | None = None) -> str:
    """The blocks of the main text, joined by line breaks.

    ``where`` is the place of the host's region, ``known`` has the template's
    texts, or (place, text) of those that are the template's in one place only.
    If the page has article or main elements, the text is that of one, the
    outermost article if they are nested: the one that the region stands in or
    holds the most text of. A page without such a region takes the one with the
    most text. Without article and main elements it is the text of elements that
    are marked as such; else the region's blocks and the title (h1); else all
    blocks. Then blocks of template texts and of mostly links are left out.
    """
    read = tokens(page, tags)
    blocks = _blocks(read)
    kind = max((b.main for b in blocks), default=0)
    place, end = _layout(read) if known or where is not None else ([], [])
    ranges = [(k, end[k]) for k, at in enumerate(place) if at == where and end[k] and read[k].name]

    def inside(b: Block) -> bool:
        return any(x < k < y for k in b.texts for x, y in ranges)

    if kind == 2:
        homes: dict[int, tuple[int, int]] = {}
        for b in blocks:
            if b.main == 2:
                own, every = homes.get(b.home, (0, 0))
                homes[b.home] = own + len(b.words) * inside(b), every + len(b.words)
        best = max(homes, key=lambda h: (homes[h], -h))
        return "\n".join(b.words for b in blocks if b.main == 2 and b.home == best)
    if kind:
        return "\n".join(b.words for b in blocks if b.main == kind)

    def is_known(k: int) -> bool:
        words = _words(read[k].text)
        return not words or words in known or (place[k], words) in known

    chosen = [b for b in blocks if inside(b)]
    if chosen:
        chosen = [b for b in blocks if b.title or inside(b)]
    return "\n".join(b.words for b in chosen or blocks if 2 * b.linked < len(b.words) and not (
        known and all(is_known(k) for k in b.texts)))


#: Kinds of facts of a page and their fields.
PAGE, HOLDS, OPEN, TOTAL, INSIDE = range(5)
FACT = ("what", "number", "place", "size", "depth")


def host(url: Column) -> Column:
    """The host of a url in lower case, empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _aligned(batches):
    """(host, digest, facts) of every page: that it is one, the texts of the first page it holds, its ``_share``.

    A fact is (what, number, place, size, depth). Copies that a task sees again are left out.
    """
    first: dict[str, First] = {}
    seen: set[tuple[str, str]] = set()
    room, tags = REMEMBERED, {}
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in FACT]))
    for batch in slices(batches, "html"):
        out: list[tuple[str, str, list]] = []
        for host_, digest, html, start in zip(*(batch.column(c).to_pylist() for c in ("host", "digest", "html", "first")), strict=True):
            if (host_, digest) in seen:
                continue
            if len(seen) >= DIGESTS:
                seen.clear()
            seen.add((host_, digest))
            if host_ not in first:
                if room < len(start):
                    first.clear()
                    room = REMEMBERED
                room -= len(start)
                first[host_] = First(start)
            page = tokens(html, tags)
            layout = _layout(page)
            share = _share(page, layout, first[host_].numbers)
            out.append((host_, digest, [
                (PAGE, -1, -1, 1, 0), (TOTAL, -1, -1, share.total, 0),
                *((HOLDS, n, -1, 1, 0) for n in first[host_].held(_parts(page, layout[0]))),
                *((OPEN, n, -1, size, 0) for n, size in share.open_.items()),
                *((INSIDE, -1, at, size, depth) for at, (size, depth) in share.places.items())]))
        yield pa.record_batch(
            [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()),
             pa.array([[dict(zip(FACT, f, strict=True)) for f in x[2]] for x in out], kind)], names=["host", "digest", "facts"])


def _texts(batches):
    """(host, number, place, text, around) of the texts of every first page."""
    around = pa.list_(pa.int64())
    for batch in slices(batches, "first"):
        for host_, html in zip(*(batch.column(c).to_pylist() for c in ("host", "first")), strict=True):
            page = First(html)
            keys = list(page.numbers)
            yield pa.record_batch(
                [pa.array([host_] * len(keys), pa.string()), pa.array(range(len(keys)), pa.int64()),
                 pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array([page.around[n] for n in range(len(keys))], around)],
                names=["host", "number", "place", "text", "around"])


def wrappers(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(host, known, region): of every host with several different pages, the texts its wrapper
    holds for all of them, with their places, and the place that holds most of what differs.

    All pages that are not blank count; copies count once. The wrapper starts as the page with the
    smallest digest. Every page is aligned with it in the task that reads it, and what goes on is
    which of its texts the page holds and how much other text its containers hold, once for each
    digest. So no page is moved beside the first ones, and a host with most of the pages is
    dealt over all tasks.
    """
    rows = pages.filter(F.col(html).isNotNull()).select(
        host(F.col(url)).alias("host"), F.col(html).alias("html"), F.md5(F.col(html).cast("binary")).alias("digest"),
        F.col(html).rlike(r"\S").alias("read"))
    read = F.when(F.col("read"), F.col("digest"))
    several = rows.groupBy("host").agg(F.min("digest").alias("least"), F.max("digest").alias("last"), F.min(read).alias("digest"))
    rows = rows.filter("read").drop("read")
    starts = cut(several.filter((F.col("least") < F.col("last")) & F.col("digest").isNotNull()).select("host", "digest"))
    first = cut(rows.join(starts, ["host", "digest"]).groupBy("host").agg(F.first("html").alias("first")))
    aligned = rows.join(first, "host").mapInArrow(
        _aligned, f"host string, digest string, facts array<struct<{', '.join(f'{n}: bigint' for n in FACT)}>>")
    once = aligned.groupBy("host", "digest").agg(F.first("facts").alias("facts"))
    facts = cut(once.select("host", F.explode("facts").alias("f")).select("host", "f.*").groupBy(
        "host", "what", "number", "place").agg(F.sum("size").alias("size"), F.max("depth").alias("depth")))
    texts = cut(first.mapInArrow(_texts, "host string, number bigint, place bigint, text string, around array<bigint>"))

    def of(what: int) -> DataFrame:
        return facts.filter(F.col("what") == what)

    counted = of(PAGE).select("host", F.col("size").alias("pages"))
    held = of(HOLDS).join(counted, "host").filter((F.col("size") == F.col("pages")) & (F.col("pages") > 1)).select("host", "number")
    known = texts.join(held, ["host", "number"]).groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("number", "place", "text"))).alias("known"))
    # Texts of the first page that some page doesn't hold differ by page like all others.
    other = of(OPEN).join(held, ["host", "number"], "left_anti").join(texts.select("host", "number", "around"), ["host", "number"])
    inside = of(INSIDE).select("host", "place", "size", "depth").unionByName(other.select(
        "host", F.explode("around").alias("place"), "size", F.lit(0).cast("bigint").alias("depth")))
    total = of(TOTAL).select("host", "size").unionByName(other.select("host", "size")).groupBy("host").agg(
        F.sum("size").alias("total")).filter("total > 0")
    places = inside.groupBy("host", "place").agg(F.sum("size").alias("size"), F.max("depth").alias("depth"))
    most = places.join(total, "host").filter(F.col("size") >= F.lit(MOST) * F.col("total"))
    where = most.groupBy("host").agg(F.max_by("place", F.struct("depth", "size", "place")).alias("region"))
    return counted.select("host").join(known, "host", "left").join(where, "host", "left").select(
        "host", F.transform("known", lambda x: F.struct(x["place"], x["text"])).alias("known"), "region")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars): the main text of every row of ``pages``.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined in page order by a line break; nothing else is
    dropped or cut. ``n_chars`` counts code points. A null or empty page, and
    one without main text, gives an empty text. Pages without a host share one
    wrapper; repeated rows give repeated rows; an empty table gives no rows.
    Broken markup is read as far as it goes: what is not closed ends with the
    page.
    """
    of = cut(wrappers(pages, key, url, html))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"),
                        host(F.col(url)).alias("host"))

    def run(batches):
        tags: dict[str, Token] = {}
        for batch in slices(batches, "html"):
            texts = [
                main_text(page or "", frozenset((x["place"], x["text"]) for x in known or ()), where, tags)
                for page, known, where in zip(*(batch.column(c).to_pylist() for c in ("html", "known", "region")), strict=True)
            ]
            yield pa.record_batch(
                [batch.column("key"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.join(of, "host", "left").select("key", "url", "html", "known", "region")
    return found.mapInArrow(run, f"key {kind}, url string, text string, n_chars bigint").withColumnsRenamed(
        {"key": key, "url": url})
