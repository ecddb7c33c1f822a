"""Main text of web pages by a host's suffix array.

A page is read into blocks of text. The token streams of a host's pages, all blocks of them, are concatenated, their suffixes
sorted by prefix doubling, and token runs that repeat across distinct pages are marked. Blocks that such runs cover go, whatever
element they stand in, and their unique runs stay. Markup is a prior: blocks in boilerplate elements go, and where a main
container has most of a page's text, so does what is outside it. A page most of whose text repeats is a copy, not boilerplate, and keeps its text.

A host's pages are dealt to groups of bounded size, so a hot host is many groups; repetition is judged over the whole host by one rule,
however many there are. The suffixes of a group are named by prefix doubling, with hashes for names, so that all groups of a host name
alike, and sorted by name: a section of the host's suffix array. Sections are merged by ranges of names: first by the
leading bits alone, which tells most suffixes that too few pages share, then those left by whole names. Each group
gets the names that enough pages of its host share.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import bound_batches, durable


@dataclass(frozen=True)
class PagePlan:
    """run: tokens of a repeated run at least, and of a unique run that stays in a covered block; pages: distinct pages that repeat it; cover: share of a block that must be repeated for it to go; copy: share of a page beyond which it is a copy; group: pages of a host in one section of its suffix array, about; broadcast_rows: large hosts whose sizes are broadcast at most."""

    run: int = 8
    pages: int = 3
    cover: float = 0.7
    copy: float = 0.8
    group: int = 128
    broadcast_rows: int = 500_000


# a tag without < or > in its values; what it can't read is left to the careful way
TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^'"<>=]*+(?:=\s*+(?:"[^"<>]*+"|'[^'<>]*+')?+[^'"<>=]*+)*+)>""")
ELEMENT = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
PLAIN = re.compile(r"""[^'">]*""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Element names and attribute words of HTML pages.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video", "textarea", "title", "select"}
TO_THE_END = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "label"}
MAIN = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
# whole words of a class or id that say what a block is, in an article too
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "overlay", "pager", "pagination", "popup", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar",
}
# of these, the words that count on a paragraph of an article and in compounds as reader-comments
PLAIN_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "sponsored"}
# words that in compounds, as share-buttons, name no part of an article either, but for its paragraphs
COMPOUND_WORDS = PLAIN_WORDS | {"breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "disqus", "gdpr", "navbar", "newsletter", "pagination", "replies", "share", "sharing", "sidebar", "signup", "sponsor", "subscribe", "subscription"}
# elements that hold an article's own text
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "figcaption", "summary"} | INLINE
# words that may as well name a part of an article; they count outside a main container
DOUBTFUL = {"banner", "disclaimer", "notice", "promo", "promoted", "promotion", "recommended", "related", "reply", "teaser", "widget", "widgets"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}


def _marked(name: str, attributes: str, in_main: bool, in_article: bool = False) -> bool:
    """Whether an element is marked as boilerplate.

    An article within another is a comment or a card; else it goes only if its own words say so. Words of a class or id count for all elements but those of a page's frame,
    in compounds, as site-footer, outside a main container. Inside one, a paragraph goes only for words that can't be an article's
    own, and compounds only by words that name no part of an article.
    """
    if name in BOILERPLATE and not (name == "header" and in_main) or name == "article" and in_article:
        return True
    for m in ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
        value = next((g for g in m.groups()[1:] if g is not None), "").lower()
        if m[1].lower() == "role" and value in ROLES:
            return True
        if m[1].lower() in ("class", "id") and name not in ("body", "html", "main"):
            words = value.split()
            parts = [x for w in words for x in re.split("[-_]+", w)]
            if in_main or name == "article":
                known, inside = (PLAIN_WORDS, {"comment"}) if name == "article" else (PLAIN_WORDS, PLAIN_WORDS) if name in TEXTUAL else (WORDS, COMPOUND_WORDS)
                if not (known.isdisjoint(words) and inside.isdisjoint(parts)):
                    return True
            elif not (WORDS.isdisjoint(words) and DOUBTFUL.isdisjoint(words) and WORDS.isdisjoint(parts)):
                return True
    return False


def markup(page: str) -> Iterator[tuple[str, str, bool, str, int]]:
    """(text before, element, whether it ends there, attributes, place behind) of each tag in order, in time linear in the page; the element is
    empty for comments and at the end. What is sent back is where to go on instead.

    A > in a quoted value doesn't end a tag, unless the quote or the tag has no other end; from such a page on, it does.
    """
    begin = at = 0
    end, last, quotes = len(page), page.rfind(">"), True
    while 0 <= (at := page.find("<", at)):
        m = TAG.match(page, at)
        if m is not None:
            go_on = yield page[begin:at], m[2].lower(), m[1] == "/", m[3], m.end()
            begin = at = m.end()
            if go_on is not None:
                begin = at = go_on
                yield "", "", False, "", at
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            stop = end if stop < 0 else stop + 3
            yield page[begin:at], "", False, "", stop
            begin = at = stop
            continue
        if at > last:
            break
        closing = page.startswith("/", at + 1)
        m = ELEMENT.match(page, at + 1 + closing)
        if m is None:
            if not page.startswith(("!", "?"), at + 1):
                at += 1
                continue
            stop = page.find(">", at) + 1
            yield page[begin:at], "", False, "", stop
            begin = at = stop
            continue
        stop = m.end()
        first = page.find(">", stop)
        while quotes:
            stop = PLAIN.match(page, stop).end()
            if stop < end and page[stop] == ">":
                break
            if stop < end and not page[max(at, stop - 16) : stop].rstrip().endswith("="):
                stop += 1
                continue
            stop = page.find(page[stop], stop + 1) + 1 if stop < end else 0
            quotes = stop > 0
        if not quotes:
            stop = first
        go_on = yield page[begin:at], m[0].lower(), closing, page[m.end() : stop], stop + 1
        begin = at = stop + 1
        if go_on is not None:
            begin = at = go_on
            yield "", "", False, "", at
    yield page[begin:], "", False, "", end


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) in page order; zone 2: main container, 1: elsewhere, 0: marked as boilerplate. White space is one space, references decoded."""
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, int]] = []  # (element, main containers and boilerplate elements entered with it)
    opened: Counter = Counter()  # elements of the stack
    endless: set[str] = set()  # raw elements that have no end tag any more
    text: list[str] = []
    main = aside = 0
    zone = 1

    def flush() -> None:
        if text:
            if words := " ".join(entities.unescape("".join(text)).split()):
                out.append((zone, words))
            text.clear()

    def leave(k: int) -> None:
        nonlocal main, aside
        for name, was_main, was_aside in stack[k:]:
            main -= was_main
            aside -= was_aside
            opened[name] -= 1
        del stack[k:]

    tags = markup(page)
    for before, name, closing, attributes, at in tags:
        text.append(before)
        if not name:
            continue
        if closing:
            if name in INLINE and not (stack and stack[-1][0] == name):
                continue
            if name not in INLINE:
                flush()
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                leave(k)
        elif name in RAW:
            flush()
            close = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if close is None:
                endless.add(name)
            if close is not None or name in TO_THE_END:
                tags.send(close.end() if close is not None else len(page))
        elif name in VOID:
            if name == "br":
                text.append(" ")
            elif name not in INLINE:
                flush()
        else:
            if name not in INLINE:
                flush()
                if name in CLOSES_P:  # an open paragraph ends, with what is open in it
                    k = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 8), -1) if stack[i][0] == "p"), None)
                    if k is not None and all(s[0] in INLINE for s in stack[k + 1 :]):
                        leave(k)
            if not attributes.rstrip().endswith("/"):
                is_aside = _marked(name, attributes, main > 0, opened["article"] > 0)
                is_main = not is_aside and (name in MAIN or 'role="main"' in attributes)
                stack.append((name, int(is_main), int(is_aside)))
                opened[name] += 1
                main += is_main
                aside += is_aside
        zone = 0 if aside else 2 if main else 1
    flush()
    return out


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the tokens, ordered by their first `depth` tokens, then place, and the suffixes' ranks there. Tokens lie close together."""
    rank = tokens - tokens.min()
    have = 1
    while have < depth:
        step = min(have, depth - have)  # the windows of the last step overlap
        after = np.full(len(rank), -1, np.int64)
        after[: max(0, len(rank) - step)] = rank[step:]
        rank = np.unique(rank * (int(rank.max()) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    return np.argsort(rank, kind="stable"), rank


def repeated(streams: list[np.ndarray], plan: PagePlan, weight: list[int] | None = None) -> list[np.ndarray]:
    """Per page stream of token numbers: which tokens lie in runs of plan.run tokens or more that plan.pages distinct pages share. weight: how many equal pages each stands for."""
    size = np.array([len(s) for s in streams], np.int64)
    if not size.sum():
        return [np.zeros(0, bool) for _ in streams]
    ends = np.cumsum(size + 1)
    joined = np.full(int(ends[-1]), -1, np.int64)
    owner = np.repeat(np.arange(len(streams)), size + 1)
    for k, (s, e) in enumerate(zip(streams, ends, strict=True)):
        joined[e - 1 - len(s) : e - 1] = s
        joined[e - 1] = -1 - k  # a mark of its own: no run crosses pages
    order, rank = suffix_order(joined, plan.run)
    groups = rank[order]
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    pages = owner[order]  # ascending in each group
    fresh = np.concatenate([[True], (groups[1:] != groups[:-1]) | (pages[1:] != pages[:-1])])
    distinct = np.add.reduceat(fresh * np.array(weight or [1] * len(streams), np.int64)[pages], starts)
    spread = np.repeat(distinct, np.diff(np.append(starts, len(order))))
    inside = ends[owner] - 1 - np.arange(len(joined)) >= plan.run
    covered = _covered(order[(spread >= plan.pages) & inside[order]], len(joined), plan.run)
    return [covered[e - 1 - n : e - 1] for e, n in zip(ends, size, strict=True)]


def _covered(starts: np.ndarray, size: int, run: int) -> np.ndarray:
    """Which of `size` places lie in the windows of `run` places that begin at starts, distinct ones."""
    hit = np.zeros(size + run + 1, np.int64)
    hit[starts] += 1
    hit[starts + run] -= 1
    return np.cumsum(hit)[:size] > 0


def _sliding(of, x: np.ndarray, width: int) -> np.ndarray:
    """`of`, a minimum or maximum, over every `width` values that follow each other."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = of(x[:-step], x[step:])
        have += step
    return x


def anchors(hashes: np.ndarray, winnow: int) -> np.ndarray:
    """Places of the windows that are the smallest of some `winnow` that follow each other; of fewer windows, the smallest."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = _sliding(np.minimum, hashes, min(winnow, len(hashes)))
    edge = np.full(min(winnow, len(hashes)) - 1, np.iinfo(np.int64).min)
    return np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, low, edge]), len(edge) + 1) == hashes)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class Words:
    """Hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 200_000) -> None:
        self.known = _Hashes()
        self.most = most

    def hashes(self, page: list[tuple[int, str]]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        words = [w for _, text in page for w in text.split(" ")]
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def _kept(page: list[tuple[int, str]], marks: np.ndarray, plan: PagePlan) -> str:
    sizes = [t.count(" ") + 1 for _, t in page]
    ends = np.cumsum(sizes).tolist()
    before = np.concatenate([[0], np.cumsum(marks)]).tolist()
    told = [before[e] - before[e - n] for e, n in zip(ends, sizes, strict=True)]
    inside = sum(n for n, (z, _) in zip(sizes, page, strict=True) if z == 2)
    # what is outside goes only if the container has most of the text that is neither marked nor repeated: else it is a card in a text
    outside = sum(n - m for n, m, (z, _) in zip(sizes, told, page, strict=True) if z == 1)
    has_main = inside > outside
    own = [(m, n) for m, n, (z, _) in zip(told, sizes, page, strict=True) if z]
    is_copy = bool(own) and sum(m for m, _ in own) / sum(n for _, n in own) > plan.copy
    out = []
    for (zone, text), n, m, end in zip(page, sizes, told, ends, strict=True):
        if not zone or zone == 1 and has_main:
            continue
        if is_copy or m / n < plan.cover:
            out.append(text)
        elif m < n:
            edges = np.flatnonzero(np.diff(np.concatenate([[True], marks[end - n : end], [True]]).astype(np.int8)))
            words = text.split(" ")
            out += [" ".join(words[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= plan.run]
    return " ".join(out)


def main_texts(pages: list[str | None], plan: PagePlan) -> list[tuple[str, int]]:
    """(main text, tokens found repeated) of pages of one host, by one suffix array in memory."""
    words = Words()
    parsed = [blocks(p) for p in pages]
    streams = [words.hashes(page) for page in parsed]
    cuts = np.cumsum([len(s) for s in streams])
    numbers = np.unique(np.concatenate(streams), return_inverse=True)[1] if streams else np.zeros(0, np.int64)
    found = repeated(np.split(numbers, cuts[:-1]) if streams else [], plan)
    return [(_kept(page, marks, plan), int(marks.sum())) for page, marks in zip(parsed, found, strict=True)]


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def pack(page: list[tuple[int, str]]) -> bytes:
    """Blocks as bytes: a line of zones, then a line each; texts have no line breaks."""
    return zlib.compress("\n".join(["".join(str(z) for z, _ in page), *(t for _, t in page)]).encode("utf-8", "surrogatepass"), 1)


def unpack(packed: bytes) -> tuple[bytes, bytes]:
    """The zones and the lines of texts."""
    zones, _, texts = zlib.decompress(packed).partition(b"\n")
    return zones, texts


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column, html, becomes packed blocks."""
    for b in batches:
        packed = pa.array([pack(blocks(page)) for page in map(pa.StringScalar.as_py, b.columns[-1])], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], names=["host", "salt", "groups", "page_id", "url", "packed"])


# random numbers, the same everywhere, for each byte and for each of its places in a word
BYTES = np.array([xxhash.xxh64_intdigest(f"byte {k}") for k in range(256)], np.uint64)
BYTES[10] = BYTES[32]  # what ends a word is no part of it
PLACES = np.array([xxhash.xxh64_intdigest(f"place {k}") | 1 for k in range(256)], np.uint64)


def word_hashes(texts: list[bytes], most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of texts, which a space or a line break parts, and how many words each text has; `most` are hashed at a time."""
    data = np.frombuffer(b"".join(t + b"\n" for t in texts if t), np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(0, len(ends), most):
        first, last = starts[k : k + most], ends[k : k + most]
        part = data[first[0] : last[-1] + 1]
        place = np.arange(len(part)) - np.repeat(first - first[0], last - first + 1)
        out[k : k + most] = np.add.reduceat(BYTES[part] * PLACES[place % len(PLACES)], first - first[0])
    for k in np.flatnonzero(ends - starts >= len(PLACES)):
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes())
    stops = np.cumsum([len(t) + 1 if t else 0 for t in texts])
    return out, np.diff(np.searchsorted(ends, stops), prepend=0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def names(hashes: np.ndarray, host: int, run: int) -> np.ndarray:
    """Names of the suffixes by their first `run` words, of all that have as many, by prefix doubling: a name of twice the length comes of two."""
    h, have = _mixed(hashes + np.uint64(host)), 1
    while have < run:
        step = min(have, run - have)  # the windows of the last step overlap
        h = _mixed(h[:-step] * np.uint64(0xC2B2AE3D27D4EB4F) + h[step:]) if len(h) > step else h[:0]
        have += step
    return h


@dataclass
class Section:
    """Of some pages of a host: the suffixes with `run` words of their page, sorted by name, their ranks, and each rank's name and count of distinct pages."""

    size: np.ndarray
    order: np.ndarray
    rank: np.ndarray
    name: np.ndarray
    pages: np.ndarray

    def marks(self, told: np.ndarray, run: int) -> list[np.ndarray]:
        """Per page, which words lie in suffixes whose rank is told."""
        covered = _covered(self.order[told[self.rank]], int(self.size.sum()), run)
        return np.split(covered, np.cumsum(self.size)[:-1])


def section(texts: list[bytes], host: int, plan: PagePlan) -> Section:
    hashes, size = word_hashes(texts)
    owner = np.repeat(np.arange(len(size)), size)
    places = np.flatnonzero(np.repeat(np.cumsum(size), size) - np.arange(len(owner)) >= plan.run)
    found = names(hashes, host, plan.run)[places] if len(places) else np.zeros(0, np.uint64)
    by_name = np.argsort(found, kind="stable")  # equal ones stay in page order
    order, found = places[by_name], found[by_name]
    new = _fresh(found)
    starts = np.flatnonzero(new)
    distinct = np.add.reduceat((new | _fresh(owner[order])).astype(np.int64), starts) if len(starts) else starts
    return Section(size, order, np.cumsum(new) - 1, found[starts], distinct)


def _fresh(x: np.ndarray) -> np.ndarray:
    """Which values differ from the one before."""
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)


def code(values: np.ndarray, pages: np.ndarray, raw: int) -> bytes:
    """Ascending numbers and their counts as bytes: differences, the lowest `raw` bytes of which are as good as random."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 15, 9, zlib.Z_RLE)
    rest = squeeze.compress(steps[raw:].tobytes() + pages.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) + squeeze.flush()
    return steps[:raw].tobytes() + rest if raw else rest


def decode(coded: bytes, n: int, raw: int) -> tuple[np.ndarray, np.ndarray]:
    """The n numbers and counts of code()."""
    rest = np.frombuffer(zlib.decompress(coded[n * raw :]), np.uint8).reshape(-1, n)
    low = np.frombuffer(coded, np.uint8, n * raw).reshape(raw, n)
    steps = np.ascontiguousarray(np.concatenate([low, rest[: 8 - raw]]).T).view("<u8")[:, 0]
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(rest[8 - raw :].T).view("<u4")[:, 0]


def _leading(groups: int) -> int:
    """Leading bits of a name to tell those that may repeat on a host of so many groups: some 8 numbers for each of its suffixes, at 512 a page."""
    return min(63, 19 + (groups - 1).bit_length())


def _ranges(groups: int) -> int:
    """Ranges of names that the sections of so many groups are merged in: parts of 32 groups' size, or up to 16 for fewer."""
    return max(min(groups, 16), -(-groups // 32))


MESSAGE = pa.schema([("host", pa.int64()), ("range", pa.int32()), ("salt", pa.int32()), ("n", pa.int32()), ("coded", pa.binary())])
REPLY = pa.schema([("host", pa.int64()), ("salt", pa.int32()), ("range", pa.int32()), ("n", pa.int32()), ("told", pa.binary())])
TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_repeated", pa.int64())])


def _messages(values: np.ndarray, bits: int, pages: np.ndarray, raw: int, pages_table: pa.Table) -> pa.Table:
    """The ascending numbers of so many bits, a row for each range of them that has any."""
    host, salt, groups = (pages_table[c][0].as_py() for c in ("host", "salt", "groups"))
    top = values >> np.uint64(bits - 32) if bits > 32 else values
    ranges = (top * np.uint64(_ranges(groups))) >> np.uint64(min(bits, 32))
    cuts = [*np.flatnonzero(_fresh(ranges)).tolist(), len(values)]
    rows = [{"host": host, "range": int(ranges[a]), "salt": salt, "n": b - a, "coded": code(values[a:b], pages[a:b], raw)} for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.Table.from_pylist(rows, MESSAGE)


def _section_of(pages: pa.Table, plan: PagePlan) -> Section:
    return section([unpack(x)[1] for x in pages["packed"].to_pylist()], pages["host"][0].as_py() % 2**64, plan)


def _leading_names(found: Section, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Names cut to their leading bits, and which of the distinct ones begin there."""
    cut = found.name >> np.uint64(64 - _leading(groups))
    return cut, _fresh(cut)


def _first(plan: PagePlan):
    """A group's names by their leading bits, with counts of pages; none for the only group of a host."""

    def run(pages: pa.Table) -> pa.Table:
        groups = pages["groups"][0].as_py()
        if groups == 1:
            return MESSAGE.empty_table()
        found = _section_of(pages, plan)
        cut, new = _leading_names(found, groups)
        starts = np.flatnonzero(new)
        count = np.minimum(np.add.reduceat(found.pages, starts), plan.pages) if len(starts) else starts
        return _messages(cut[starts], _leading(groups), count, 1, pages)

    return run


def _second(plan: PagePlan):
    """A group's names, with counts of pages, whose leading bits enough pages of the host have."""

    def run(pages: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows:
            return MESSAGE.empty_table()
        found = _section_of(pages, plan)
        _, new = _leading_names(found, pages["groups"][0].as_py())
        rows = sorted(told.to_pylist(), key=lambda r: r["range"])
        many = np.concatenate([np.unpackbits(np.frombuffer(r["told"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
        if len(many) != new.sum():
            raise RuntimeError("the pages of a group changed between two readings")
        left = many[np.cumsum(new) - 1]
        return _messages(found.name[left], 64, np.minimum(found.pages[left], plan.pages), 6, pages)

    return run


def _merged(plan: PagePlan, raw: int, names_back: bool):
    """To each group of a host: which of the numbers it sent of a range enough pages have over all groups, as bits or as the numbers themselves."""

    def run(messages: pa.Table) -> pa.Table:
        rows = messages.to_pylist()
        sent = [decode(r["coded"], r["n"], raw) for r in rows]
        values, pages = (np.concatenate(x) for x in zip(*sent, strict=True))
        order = np.argsort(values, kind="stable")
        starts = np.flatnonzero(_fresh(values[order]))
        enough = np.zeros(len(values), bool)
        enough[order] = np.repeat(np.add.reduceat(pages[order].astype(np.int64), starts) >= plan.pages, np.diff(np.append(starts, len(values))))
        out = []
        for r, (v, _), told in zip(rows, sent, np.split(enough, np.cumsum([r["n"] for r in rows])[:-1]), strict=True):
            if not names_back:
                out.append((r["n"], np.packbits(told).tobytes()))
            else:
                out.append((int(told.sum()), v[told].tobytes()))
        back = [{"host": r["host"], "salt": r["salt"], "range": r["range"], "n": n, "told": x} for r, (n, x) in zip(rows, out, strict=True) if n]
        return pa.Table.from_pylist(back, REPLY)

    return run


def _extract(plan: PagePlan):
    """The texts of a group's pages; told: names that enough pages of the host have. The only group of a host tells by its own counts."""

    def run(pages: pa.Table, told: pa.Table) -> pa.Table:
        packed = pages["packed"].to_pylist()
        if not packed:
            return TEXT.empty_table()
        found = _section_of(pages, plan)
        if pages["groups"][0].as_py() == 1:
            enough = found.pages >= plan.pages
        else:
            known = np.sort(np.frombuffer(b"".join(told["told"].to_pylist()), np.uint64))
            enough = _among(found.name, known) if len(known) else np.zeros(len(found.name), bool)
        texts, n_repeated = [], []
        for x, marks in zip(packed, found.marks(enough, plan.run), strict=True):
            zones, body = unpack(x)
            page = list(zip((z - 48 for z in zones), body.decode("utf-8", "surrogatepass").split("\n"), strict=True)) if zones else []
            texts.append(_kept(page, marks, plan))
            n_repeated.append(int(marks.sum()))
        return pa.Table.from_arrays([pages["page_id"], pages["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(n_repeated, pa.int64())], schema=TEXT)

    return run


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are known ones; known is sorted and not empty."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _common(plan: PagePlan):
    """(part, hash) of the rows (part, hash, n), sorted by hash, whose hash comes to plan.pages pages. Of a hash that doesn't yet, fewer rows than that are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            part, hashes, n = (np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(held, b.columns, strict=True))
            if not len(hashes):
                continue
            starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            total = np.add.reduceat(n, starts)
            total[0] += before if hashes[0] == last else 0
            spread = np.repeat(total >= plan.pages, np.diff(np.append(starts, len(hashes))))
            # the last hash goes on in the next batch: its rows wait, or its pages are enough already
            tail = hashes == hashes[-1]
            enough = bool(total[-1] >= plan.pages)
            last, before = hashes[-1], int(total[-1]) if enough else 0
            held = [np.zeros(0, np.int64)] * 3 if enough else [x[tail] for x in (part, hashes, n)]
            out = spread if enough else spread & ~tail
            yield pa.RecordBatch.from_arrays([pa.array(part[out]), pa.array(hashes[out])], names=["part", "hash"])

    return run


def main_text(pages: DataFrame, plan: PagePlan = PagePlan()) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated), one row for each row of pages; n_repeated counts tokens that repeat on the host.

    Null or empty html gives an empty text. All urls without host are of one host. Repeated rows and rows sharing a page_id
    are pages of their own. A page of any length is read whole, in linear time. An empty table gives an empty result, and
    columns beside page_id, url and html are not looked at.
    """
    bound_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(pages["url"], HOST, 1), F.lit("")))
    d = pages.select(F.xxhash64(host).alias("host"), F.xxhash64(F.monotonically_increasing_id()).alias("dealt"), pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    sizes = d.groupBy("host").count().select("host", F.round(F.col("count") / plan.group).cast("int").alias("groups")).where("groups > 1")
    sizes = durable(sizes)  # the hosts that need more than one group
    n_large = sizes.count()
    sizes = F.broadcast(sizes) if n_large <= plan.broadcast_rows else sizes
    groups = F.coalesce("groups", F.lit(1))
    dealt = d.join(sizes, "host", "left").select("host", F.pmod("dealt", groups).cast("int").alias("salt"), groups.alias("groups"), "page_id", "url", "html")
    # read three times, shuffled once
    rows = dealt.mapInArrow(_read, "host long, salt int, groups int, page_id long, url string, packed binary").repartition("host", "salt")
    message, reply = "host long, range int, salt int, n int, coded binary", "host long, salt int, range int, n int, told binary"
    grouped = rows.groupBy("host", "salt")
    may = grouped.applyInArrow(_first(plan), message).groupBy("host", "range").applyInArrow(_merged(plan, 1, False), reply)
    do = grouped.cogroup(may.groupBy("host", "salt")).applyInArrow(_second(plan), message).groupBy("host", "range").applyInArrow(_merged(plan, 6, True), reply)
    return grouped.cogroup(do.groupBy("host", "salt")).applyInArrow(_extract(plan), "page_id long, url string, text string, n_chars long, n_repeated long")


def pages_query(pages: DataFrame, plan: PagePlan = PagePlan()) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_repeated."""
    return main_text(pages, plan)
