"""What one text holds: the finders behind the detectors, over plain strings.

Measured against built-in column functions on 26 MB of documents and 8 cores,
Python's regex over Arrow batches took a small part of the time (see README):
finds are few, and an array built up by a fold is copied for each of them.
Offsets are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from prosegauge.functions.phrases import EDGE, JAVA_BLANK, phrase, with_blanks
from prosegauge.operators.catalog import ALL, CHAIN_HEADS, CHAIN_PARTS, Detector

#: Openers that no run of alike sentences is counted for, and what a full stop after is no sentence's end.
COMMON_OPENERS = frozenset("i it the a an this that we you they he she there but and so in as if my his her their its these those for at on of to is was".split())
ABBREVIATIONS = frozenset("dr mr mrs ms prof sr jr st inc ltd co corp vs etc approx est fig vol".split())
_INK = re.compile(f"[^{JAVA_BLANK[1:-1]}]+")
_HEAD, _LETTER, _GRAM = re.compile("[A-Za-z'’-]+"), re.compile("[A-Za-z]"), re.compile("[a-z0-9'’-]+")
_RUN = re.compile(f"{JAVA_BLANK}+")
_LONG_RUN = re.compile(f"{JAVA_BLANK}{{11,}}")
_BLANKS = "".join(c for c in map(chr, range(0x10000)) if re.fullmatch(JAVA_BLANK, c))
#: Bytes of a-z, 0-9, apostrophes (a curly one as 1) and hyphens; stops; blanks for all others.
_WORDS_STOPS = bytes(c if c in b"abcdefghijklmnopqrstuvwxyz0123456789'-\x01" else 46 if c in b".!?\n" else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Find(NamedTuple):
    start: int
    end: int
    item_count: int | None
    ordinal: int


def python_regex(java: str) -> re.Pattern:
    """The Java form for Python: ASCII classes, and its name for the very end."""
    return re.compile(java.replace(r"\z", r"\Z"), re.ASCII)


def _trimmed(text: str, start: int, end: int, left: bool = True) -> tuple[int, int]:
    own = text[start:end]
    return (start + len(own) - len(own.lstrip(_BLANKS)) if left else start), end - len(own) + len(own.rstrip(_BLANKS))


class Sentence(NamedTuple):
    start: int
    end: int
    sign: object  # what is compared with the next one


def _runs(items: Iterable[Sentence], linked: Callable[[Sentence, Sentence], bool], least: int) -> Iterator[tuple[Sentence, Sentence, int]]:
    """(first, last, how many) of the longest runs of at least `least` in which each is linked to the next."""
    run: list[Sentence] = []
    for item in chain(items, [None]):
        if run and (item is None or not linked(run[-1], item)):
            if len(run) >= least:
                yield run[0], run[-1], len(run)
            run = []
        run.append(item)


@lru_cache(maxsize=4096)
def _regex(d: Detector, specs: tuple[str, ...]) -> re.Pattern:
    return python_regex(phrase(*specs, fold=d.fold).java)


@lru_cache(maxsize=8)
def _fixed(regex: str) -> re.Pattern:
    return re.compile(regex)


def _phrases(d: Detector, specs: tuple[str, ...], text: str) -> Iterator[tuple]:
    for m in _regex(d, specs).finditer(text):
        yield *m.span(), None


class _Ahead:
    """The first match from a place on, for places that never go back: each part of the text is searched once."""

    def __init__(self, regex: re.Pattern, text: str):
        self.regex, self.text, self.last, self.more = regex, text, None, True

    def at(self, pos: int) -> re.Match | None:
        if self.more and (self.last is None or self.last.start() < pos):
            self.last = self.regex.search(self.text, pos)
            self.more = self.last is not None
        return self.last


_GAP = re.compile(r"\[\^((?:\\.|[^\]])+)\]\*\?")


@lru_cache(maxsize=512)
def _far_parts(d: Detector, specs: tuple[str, ...]) -> tuple[list[tuple[re.Pattern, re.Pattern, re.Pattern]], re.Pattern | None]:
    """(head, tail, what may not lie between) of each phrase with an unbounded gap, and a regex of the others."""
    parts, near = [], []
    for spec in specs:
        gap = _GAP.search(spec)
        if gap:
            ends = f"{spec[: gap.start()]}>", f"<{spec[gap.end() :]}"
            parts.append((*(python_regex(phrase(x, fold=d.fold).java) for x in ends), re.compile(f"[{gap[1]}]")))
        else:
            near.append(spec)
    return parts, python_regex(phrase(*near, fold=d.fold).java) if near else None


def _far(d: Detector, specs: tuple[str, ...], text: str) -> Iterator[tuple]:
    """What the phrases' regex finds, in linear time: a sentence's end and the next tail are looked up once, not for each head."""
    parts, near = _far_parts(d, specs)

    def gapped(head: re.Pattern, tail: re.Pattern, stop: re.Pattern) -> Callable[[int], tuple[int, int] | None]:
        heads, tails, stops = (_Ahead(r, text) for r in (head, tail, stop))

        def search(pos: int) -> tuple[int, int] | None:
            while (h := heads.at(pos)) and (t := tails.at(h.end())):
                if not (s := stops.at(h.end())) or t.start() <= s.start():
                    return h.start(), t.end()
                pos = h.start() + 1
            return None

        return search

    searches = [gapped(*p) for p in parts]
    if near:
        searches.append(lambda pos: m.span() if (m := near.search(text, pos)) else None)
    pos, found = 0, [(-1, -1)] * len(searches)
    while True:
        found = [search(pos) if own and own[0] < pos else own for search, own in zip(searches, found, strict=True)]
        first = min((x for x in found if x), key=lambda x: x[0], default=None)
        if not first:
            return
        yield *first, None
        pos = first[1]


@lru_cache(maxsize=1)
def _again_parts(d: Detector) -> tuple[list[re.Pattern], list[re.Pattern], re.Pattern]:
    """Heads and tails, with and without an adverb, that capture the verb; what may not lie between."""
    gap = _GAP.search(d.specs[0])
    head, tail = f"{d.specs[0][: gap.start()]}>", f"<{d.specs[0][gap.end() :]}".replace(r"<\1>", r"<(\w+)>")
    adverb = re.compile(r"\[((?:\w+ \|)+\w+) \]")
    both = [[python_regex(phrase(adverb.sub(x, part), fold=d.fold).java) for x in (lambda m: f"({m[1].replace(' ', '')}) ", "")] for part in (head, tail)]
    return *both, re.compile(f"[{gap[1]}]")


def _again(d: Detector, _: tuple[str, ...], text: str) -> Iterator[tuple]:
    """What the phrase's regex finds, in linear time: the verb's next place after a stop is looked up, not searched for each head."""
    heads, tails, stop = _again_parts(d)
    first = sorted(((m.start(), i, m.end(), m[1].lower()) for i, r in enumerate(heads) for m in r.finditer(text)))
    if not first:
        return
    places: dict[str, list[tuple[int, int]]] = {}
    for m in sorted((m for r in tails for m in r.finditer(text)), key=lambda m: m.start()):
        places.setdefault(m[1].lower(), []).append(m.span())
    stops, pos = _Ahead(stop, text), 0
    for start, _, end, verb in first:
        own = places.get(verb, [])
        i = bisect_left(own, (end,))
        s = stops.at(end)
        if start >= pos and i < len(own) and (not s or own[i][0] <= s.start()):
            pos = own[i][1]
            yield start, pos, None


@lru_cache(maxsize=2)
def _chain_parts(d: Detector) -> tuple[re.Pattern, ...]:
    """An item's head at a word's edge; what joins items and the next head, without the blanks before it; a separator; a head."""
    head = CHAIN_HEADS[d.pattern_id]
    joint = f"(?=((?P<sign>[,;&–—])\\s*(?:(?:and|or)\\s+)?{head}|(?<=\\s)(?:and|or|--?)\\s+{head}))"
    return tuple(re.compile(with_blanks(r), re.IGNORECASE | re.ASCII) for r in (EDGE + head, joint, CHAIN_PARTS, head))


class _Joint(NamedTuple):
    first: int  # where the blanks before it begin
    last: int  # the last place where the item before it may end
    end: int


def _chain(d: Detector, _: tuple[str, ...], text: str) -> Iterator[tuple]:
    """What the phrase's regex finds, in linear time: joints are looked up, so that an item's body is never tried end by end.

    An item's body takes as much as it can, up to 400 characters or a stop: the first joint is the last within reach, later ones begin where a body ends.
    """
    heads, joint, parts, head = _chain_parts(d)
    joints = []
    for m in joint.finditer(text):
        at = m.start()
        while at and text[at - 1] in _BLANKS and (not joints or at > joints[-1].last):
            at -= 1
        joints.append(_Joint(at, m.start() if m["sign"] else m.start() - 1, m.end(1)))
    if not joints:
        return
    stops, lasts, pos = _Places(_fixed("[,.;:!?\n–—…]"), text), [j.last for j in joints], 0

    def reach(body: int) -> int:
        return min(body + 400, len(text), stops.at(body))

    for h in heads.finditer(text):
        if h.start() < pos:
            continue
        end, items = h.end(), 1
        while True:
            most = reach(end)
            i = bisect_left(lasts, most)  # the joint whose blanks the body may end in
            if not (i < len(joints) and joints[i].first <= most):
                i -= 1
                # Only the first item gives way for a joint that its body could run over.
                if items > 1 or i < 0 or lasts[i] < end:
                    break
            end, items = joints[i].end, items + 1
        if items > 1:
            pos = reach(end)
            own = _RUN.sub(" ", text[h.start() : pos])
            yield *_trimmed(text, h.start(), pos, left=False), sum(bool(head.match(x.strip(_BLANKS))) for x in parts.split(own))


class _Places:
    """The first place of a sign from a position on."""

    def __init__(self, regex: re.Pattern, text: str):
        self.all, self.end = [m.start() for m in regex.finditer(text)], len(text)

    def at(self, pos: int) -> int:
        i = bisect_left(self.all, pos)
        return self.all[i] if i < len(self.all) else self.end


def _questions(d: Detector, specs: tuple[str, ...], text: str) -> Iterator[tuple]:
    for m in _regex(d, specs).finditer(text):
        start, _ = _trimmed(text, *m.span())
        yield start, m.end(), m[0].count("?")


def _alike(low: str) -> list[int]:
    """Numbers of sentences that seem to share four words in a row with one beside it: sums of hashes do. A sentence's number is how many stops stand before it."""
    own = low.replace("\x01", " ").replace("’", "\x01").encode(errors="surrogatepass").translate(_WORDS_STOPS)
    words = own.replace(b".", b" . ").split()
    if len(words) < 8:
        return []
    h = np.fromiter(map(hash, words), np.int64, len(words))
    stops = h == hash(b".")
    at = np.cumsum(stops)
    # Another sentence of four words parts its neighbours by more than the gap, so only these are counted.
    number = np.cumsum(np.bincount(at, ~stops, at[-1] + 1) >= 4)
    free = np.flatnonzero(at[3:] == at[:-3])
    free = free[~stops[free]]
    u = h.view(np.uint64)
    sums = ((u[free] * _ODD + u[free + 1]) * _ODD + u[free + 2]) * _ODD + u[free + 3]
    order = np.argsort(sums, kind="stable")
    sums, at = sums[order], at[free][order]
    pairs = np.flatnonzero((sums[1:] == sums[:-1]) & (number[at[1:]] - number[at[:-1]] == 1))
    return np.unique(np.r_[at[pairs], at[pairs + 1]]).tolist()


def _echo(_: Detector, __: tuple[str, ...], text: str) -> Iterator[tuple]:
    """Two or more neighbouring sentences, each sharing four words in a row with the next."""
    low = text.lower()
    numbers = _alike(low)
    if not numbers:
        return
    ends = [-1, *(m.start() for m in _fixed(r"[.!?\n]").finditer(text)), len(text)]

    def sentences() -> Iterator[Sentence]:
        for i in numbers:
            start, end = ends[i] + 1, ends[i + 1]
            end += text[end : end + 1] in (".", "!", "?")
            words = _GRAM.findall(text[start:end].lower())
            if len(_INK.findall(text[start:end])) >= 4:
                yield Sentence(start, end, set(zip(words, words[1:], words[2:], words[3:], strict=False)))

    for a, b, n in _runs(sentences(), lambda a, b: b.start - a.end <= 3 and not a.sign.isdisjoint(b.sign), 2):
        yield *_trimmed(text, a.start, b.end, left=False), n


def _closed(text: str, ends: str, most: int) -> Iterator[tuple[int, int]]:
    """Spans of 1 to `most` characters other than . ! ? and newlines before a match of `ends`: the nearest ones, where there are more."""
    last = 0
    for m in _fixed(ends).finditer(text):
        stop, end = m.span()
        start = max(last, stop - most)
        if (line := text.rfind("\n", start, stop)) >= 0:
            start = line + 1
        if start < stop:
            yield start, end
        last = end


def _begin_alike(text: str) -> bool:
    """Whether three sentences in a row, however far apart, begin with the same uncommon word."""
    bodies = _fixed("[.!?]").split(text)[:-1]
    found = [_HEAD.search(b, max(b.rfind("\n", -400) + 1, len(b) - 400)) for b in bodies]
    heads = [m[0].lower() for m in found if m]
    return any(a == b == c and a not in COMMON_OPENERS for a, b, c in zip(heads, heads[1:], heads[2:], strict=False))


def _anaphora(_: Detector, __: tuple[str, ...], text: str) -> Iterator[tuple]:
    """Three or more sentences in a row that begin with the same uncommon word."""
    if not _begin_alike(text):
        return

    def sentences() -> Iterator[Sentence]:
        for start, end in _closed(text, "[.!?]", 400):
            if head := _HEAD.search(text, start, end):
                yield Sentence(head.start(), end, head[0].lower())

    for a, b, n in _runs(sentences(), lambda a, b: a.sign == b.sign and b.start - a.end < 4, 3):
        if a.sign not in COMMON_OPENERS:
            yield a.start, b.end, n


def _fragment(token: str) -> bool:
    """One or two words with a letter, and no abbreviation or single letter before a final full stop."""
    if token.count(" ") > 2 and "  " not in token and token[0] != " ":  # most tokens are ruled out by their plain blanks
        return False
    words = _INK.findall(token)
    if not 0 < len(words) <= 2 or not _LETTER.search(token):
        return False
    last = words[-1][:-1].lower()
    return not (words[-1][-1] == "." and (last in ABBREVIATIONS or len(last) == 1 and _LETTER.match(last)))


def _staccato(_: Detector, __: tuple[str, ...], text: str) -> Iterator[tuple]:
    """Three or more sentences in a row of one or two words; abbreviations and signs without letters break a run."""
    own = (Sentence(a, b, _fragment(text[a:b])) for a, b in _closed(text, "[.!?]+", 40))
    for a, b, n in _runs(own, lambda a, b: a.sign and b.sign and b.start - a.end <= 3, 3):
        yield *_trimmed(text, a.start, b.end), n


def _function(d: Detector, _: tuple[str, ...], text: str) -> Iterator[tuple]:
    yield from d.function(text)


_KINDS = {"phrase": _phrases, "far": _far, "again": _again, "chain": _chain, "questions": _questions, "echo": _echo, "anaphora": _anaphora, "staccato": _staccato, "function": _function}


@lru_cache(maxsize=256)
def _needs(d: Detector) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Each phrase of a detector and the lower-case texts of which its finds hold one; () if none is known."""
    return tuple((spec, phrase(spec, fold=d.fold).anchors) for spec in d.specs)


#: Kinds that search a text whose blank runs are cut.
_BY_REGEX = frozenset(["phrase", "far", "again", "questions"])
_BOUND = re.compile(r"\{\d*,?(\d+)\}")
_BOUNDS = re.compile(r"\{\d*,?\d*\}")


@lru_cache(maxsize=4096)
def _told_apart(d: Detector, specs: tuple[str, ...]) -> int:
    """How many blanks in a row, from either side, these phrases can tell from more."""
    return max([4, *(int(n) + 1 for n in _BOUND.findall(_regex(d, specs).pattern))])


class _Shortened:
    """A text whose long blank runs keep `each` blanks at either end, and their first and last line break between.

    No phrase that counts up to `each` characters can tell it from the text. Places are carried back by the sorted table of what is kept.
    """

    def __init__(self, text: str, runs: list[tuple[int, int]], each: int):
        kept, at = [], 0
        for start, end in runs:
            if end - start > 2 * each + 2:
                a, b = start + each, end - each
                lines = sorted({text.find("\n", a, b), text.rfind("\n", a, b)} - {-1})
                for x, y in [*((i, i + 1) for i in lines), (b, b)]:
                    kept.append((at, a))
                    at, a = x, y
                at = b
        kept.append((at, len(text)))
        self.text = text if len(kept) == 1 else "".join(text[a:b] for a, b in kept)
        self.froms, self.tos, n = [], [], 0
        for a, b in kept:
            if b > a:
                self.froms.append(n)
                self.tos.append(a)
                n += b - a

    def back(self, at: int) -> int:
        i = bisect_right(self.froms, at) - 1
        return self.tos[i] + at - self.froms[i] if i >= 0 else at


_LOOK = re.compile(r"\(\?<?[=!]")
_SHORT = r"(?:\s|\v|[^\x00-\x7F])*[^\s.!?]+(?:(?:\s|\v|[^\x00-\x7F])+[^\s.!?]+)?(?:\s|\v|[^\x00-\x7F])*[.!?]+"


@lru_cache(maxsize=4096)
def _loose(d: Detector, specs: tuple[str, ...]) -> str | None:
    """A regex for RE2 that matches each text in which these phrases find something, and some others: without look-around, counts and back-references. None if there is none."""
    if d.kind == "staccato":  # three times one or two words and stops
        return rf"{_SHORT}(?s:.{{0,3}}){_SHORT}(?s:.{{0,3}}){_SHORT}"
    if not specs or d.kind not in _BY_REGEX | {"chain"}:
        return None
    regex, out, i = phrase(*specs, fold=d.fold).java, [], 0
    while i < len(regex):
        if (m := _LOOK.match(regex, i)) or (m := _BOUNDS.match(regex, i)):
            if m.re is _BOUNDS:
                out.append("*")
                i = m.end()
            else:
                i = _group_end(regex, i)
                out.append("(?:)")
        elif regex[i] == "\\":
            own = regex[i : i + 6] if regex[i + 1] == "u" else regex[i : i + 2]
            out.append(f"\\x{{{own[2:]}}}" if own[1] == "u" else r"\w+" if own[1].isdigit() else own)
            i += len(own)
        elif regex[i] in "*+?" and out and out[-1] == "*":
            i += 1  # lazy or possessive: the same texts match
        else:
            out.append(regex[i])
            i += 1
    loose = "".join(out)
    try:
        pc.match_substring_regex(pa.array([""]), loose)
    except pa.ArrowInvalid:
        return None
    return loose


def _group_end(regex: str, i: int) -> int:
    """The place behind the group that begins at i."""
    depth, inside = 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        else:
            depth += (c == "(") - (c == ")")
            if depth == 0 and c == ")":
                return i + 1
        i += 1
    raise ValueError(f"a group without an end: {regex}")


def find_all(texts: Iterable[str | None], chosen: Iterable[tuple[int, Detector]]) -> list[list[Find]]:
    """All that these (ordinal, detector) find in each text, in their order, overlaps included.

    A text is searched by a detector only where Arrow's regex (RE2), over all
    these texts at once, says that its phrases may match, and only for those
    phrases of which an anchor occurs in it.
    """
    texts = [t or "" for t in texts]
    column, out = pa.array(texts, pa.large_string()), [[] for _ in texts]
    own: dict[int, _Searched] = {}
    for ordinal, d in chosen:
        loose = _loose(d, d.specs)
        may = np.flatnonzero(pc.match_substring_regex(column, loose).to_numpy(zero_copy_only=False)).tolist() if loose else range(len(texts))
        for i in may:
            if texts[i]:
                if i not in own:
                    own[i] = _Searched(texts[i])
                out[i] += own[i].find(ordinal, d)
    return out


class _Searched:
    """A text in which several detectors search: its lower-case form, its blank runs and its cut forms are worked out once."""

    def __init__(self, text: str):
        self.text, self.seen, self.views = text, {}, {}

    @cached_property
    def low(self) -> str:
        return self.text.lower()

    @cached_property
    def runs(self) -> list[tuple[int, int]]:
        return [m.span() for m in _LONG_RUN.finditer(self.text)]

    def there(self, anchors: Iterable[str]) -> bool:
        for a in anchors:
            found = self.seen.get(a)
            if found is None:
                found = self.seen[a] = a in self.low
            if found:
                return True
        return False

    def find(self, ordinal: int, d: Detector) -> list[Find]:
        if d.must_hold and not self.there(d.must_hold) or d.and_one_of and not self.there(d.and_one_of):
            return []
        specs = tuple([spec for spec, anchors in _needs(d) if not anchors or self.there(anchors)])
        if not specs and d.specs:
            return []
        if self.runs and d.kind in _BY_REGEX:
            each = _told_apart(d, specs)
            view = self.views[each] = self.views.get(each) or _Shortened(self.text, self.runs, each)
            return [Find(view.back(s), view.back(e), n, ordinal) for s, e, n in _KINDS[d.kind](d, specs, view.text)]
        return [Find(*found, ordinal) for found in _KINDS[d.kind](d, specs, self.text)]


def find(text: str | None, chosen: Iterable[tuple[int, Detector]]) -> list[Find]:
    """find_all() of one text."""
    return find_all([text], chosen)[0]


def find_by_id(text: str | None, pattern_ids: Iterable[str]) -> list[Find]:
    """find() of built-in detectors."""
    return find(text, ALL.chosen(pattern_ids))


def resolve(found: list[Find]) -> list[Find]:
    """In order of start, then the longest, then the detectors' order; each is kept that begins no earlier than the last kept ended."""
    kept: list[Find] = []
    for f in sorted(found, key=lambda f: (f.start, -f.end, f.ordinal)):
        if not kept or f.start >= kept[-1].end:
            kept.append(f)
    return kept


# Contexts ------------------------------------------------------------------------------------------------------------
_STOPS, _CLOSERS = "\n.!?…", "\"'”’)]"
_AFTER = re.compile(rf"[^{_STOPS}]*(?:[.!?…][{re.escape(_CLOSERS)}]*)?")


def _stops(text: str) -> list[int]:
    return [m.start() for m in _fixed(f"[{_STOPS}]").finditer(text)]


def sentence_bounds(text: str, start: int, end: int, stops: list[int] | None = None) -> tuple[int, int]:
    """The sentence around a match: from after the stop before it, blanks skipped, through the first stop from its end on. `stops`: their places, if known."""
    stops = _stops(text) if stops is None else stops
    at = bisect_left(stops, start)
    left = stops[at - 1] + 1 if at else 0
    while left < start and text[left] in _BLANKS:
        left += 1
    at = bisect_left(stops, end)
    return left, _AFTER.match(text, stops[at] if at < len(stops) else len(text)).end()


def merged(spans: Iterable[tuple[int, int]], joined: Callable[[int, int], bool]) -> list[tuple[int, int, int]]:
    """(start, end, how many) of spans in order, a span joining the last one where joined(its start, the last end)."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and joined(s, out[-1][1]):
            out[-1][1], out[-1][2] = max(out[-1][1], e), out[-1][2] + 1
        else:
            out.append([s, e, 1])
    return [tuple(x) for x in out]


def regions(text: str, matches: Iterable[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Sentences around matches in order, those that touch or overlap as one: (start, end, matches)."""
    stops = _stops(text)
    return merged((sentence_bounds(text, s, e, stops) for s, e in matches), lambda s, last: s <= last)


def windows(text: str, regions_: Iterable[tuple[int, int, int]], words: int = 12) -> list[tuple[int, int, int]]:
    """Regions with so many words to either side, those that meet or have no word between them as one: (start, end, regions)."""
    ink = [m.span() for m in _INK.finditer(text)]
    starts, ends = [s for s, _ in ink], [e for _, e in ink]

    def wide(s: int, e: int) -> tuple[int, int]:
        before, after = bisect_left(starts, s), bisect_right(ends, e)
        if before and ends[before - 1] > s:  # a region that begins inside a word
            before -= 1
        first, last = max(0, before - words), min(len(ink), after + words)
        return (min(s, starts[first]) if before else s), (max(e, ends[last - 1]) if last > after else e)

    return merged((wide(s, e) for s, e, _ in regions_), lambda s, last: s <= last or not _INK.search(text, last, s))
