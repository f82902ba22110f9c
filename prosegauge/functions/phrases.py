"""Phrase notation: word lists compiled to the regex dialects of Spark (Java) and of the SQL check (RE2).

    a b      words parted by blanks         (a|b)   one of
    '        either apostrophe              [a|b]   one of, or nothing
    _        one word                       <...>   regex as it is
    {is was} 's, or a blank and is or was   {a-b}   a to b characters of the sentence, as few as do

A phrase's edge that is a word character must not touch another one (ASCII).
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: What counts as a blank, as in JavaScript's \\s.
JAVA_BLANK = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_TOKEN = re.compile(r"<(?P<raw>(?:\\.|[^>\\])*)>|\{(?P<low>\d+)-(?P<high>\d*)\}|\{(?P<be>[a-z ]+)\}|(?P<mark>[()\[\]|])|(?P<blank> +)|(?P<word>_)|(?P<quote>')|(?P<text>[\w\-]+)|(?P<other>.)")


class Phrase(NamedTuple):
    java: str
    re2: str
    anchors: tuple[str, ...]  # lower-case texts of which one must be there; () if none is known


#: An ASCII word edge where look-around must say it: Java's own takes letters beyond ASCII for word characters.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def with_blanks(raw: str) -> str:
    """\\s widened to all blanks, inside character classes too."""
    out, inside, i = [], False, 0
    while i < len(raw):
        step = raw[i : i + 2] if raw[i] == "\\" else raw[i]
        inside = step == "[" or inside and step != "]"
        out.append((JAVA_BLANK[1:-1] if inside else JAVA_BLANK) if step == r"\s" else step)
        i += len(step)
    return "".join(out)


BLANK, BLANKS, NO_BLANKS = r"\s", r"\s+", r"\s*"
WORD_END, WORD_START = "(?![A-Za-z0-9_])", "(?<![A-Za-z0-9_])"
#: A word's sign, a word that may hold hyphens and apostrophes, an apostrophe.
WORD_SIGN, COMPOUND, QUOTE = r"\w", r"[\w'’-]+", "['’]"


# Combinators for what the notation's words can't say. Each gives a raw part.
def run(low: int, high: int, stops: str, lazy: bool = False) -> str:
    """low to high characters other than these."""
    inner = "".join(r"\n" if c == "\n" else re.escape(c) if c in "]\\^-" else c for c in stops)
    return f"[^{inner}]{{{low},{high}}}{'?' if lazy else ''}"


def gap(stops: str, lazy: bool = True) -> str:
    """Any number of characters other than these."""
    return run(0, 0, stops).split("{")[0] + ("*?" if lazy else "*")


def made_of(signs: str, low: int, high: int) -> str:
    """low to high of these signs."""
    return f"[{signs}]{{{low},{high}}}"


def several(item: str, low: int, high: int) -> str:
    """low to high items parted by blanks, as few as do."""
    return f"{item}(?:{BLANKS}{item}){{{low - 1},{high - 1}}}?"


def led_by(most: int) -> str:
    """Up to so many words before what follows, as few as do."""
    return f"(?:{WORD_SIGN}+{BLANKS}){{0,{most}}}?"


def one_of(*parts: str) -> str:
    return f"(?:{'|'.join(parts)})"


def maybe(*parts: str) -> str:
    return f"(?:{''.join(parts)})?"


def items(item: str, separator: str, least: int) -> str:
    """least or more items, a separator before each but the first."""
    return f"{item}(?:{separator}{item}){f'{{{least - 1},}}' if least > 2 else '+'}"


def ahead(*parts: str, but: bool = False) -> str:
    """What must (or, with but, must not) follow, and isn't part of the span."""
    return f"(?{'!' if but else '='}{''.join(parts)})"


def _dialects(raw: str) -> tuple[str, str]:
    """A raw part for Java and Python, and for RE2 with its own word edge."""
    re2 = raw
    for edge in (EDGE, "(?![A-Za-z0-9_])", "(?<![A-Za-z0-9_])"):
        re2 = re2.replace(edge, r"\b")
    return with_blanks(raw), re2


class _Part(NamedTuple):
    java: str
    re2: str
    anchors: frozenset[str] | None


def _choice(parts: list[_Part]) -> frozenset[str] | None:
    if any(p.anchors is None for p in parts):
        return None
    return frozenset().union(*(p.anchors for p in parts))


def _best(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets one of whose texts must occur, the one that says more: longer at its shortest."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _parse(spec: str) -> _Part:
    stack: list[list] = [["", [], _Part("", "", None)]]

    def add(java: str, re2: str, anchors: frozenset[str] | None = None) -> None:
        top = stack[-1]
        top[2] = _Part(top[2].java + java, top[2].re2 + re2, _best(top[2].anchors, anchors))

    for m in _TOKEN.finditer(spec):
        kind = m.lastgroup
        if kind == "raw":
            add(*_dialects(m["raw"]))
        elif kind in ("low", "high"):
            add(*[rf"[^.!?\n]{{{m['low']},{m['high']}}}?"] * 2)
        elif kind == "be":
            words = m["be"].replace(" ", "|")
            add(rf"(?:['’]s|{JAVA_BLANK}+(?:{words}))", rf"(?:['’]s|\s+(?:{words}))")
        elif kind == "blank":
            add(JAVA_BLANK + "+", r"\s+")
        elif kind == "word":
            add(r"\w+", r"\w+")
        elif kind == "quote":
            add("['’]", "['’]")
        elif kind in ("text", "other"):
            add(re.escape(m[0]), re.escape(m[0]), frozenset([m[0].lower()]) if len(m[0]) > 1 else None)
        elif m[0] in "([":
            stack.append([m[0], [], _Part("", "", None)])
        elif m[0] == "|":
            stack[-1][1].append(stack[-1][2])
            stack[-1][2] = _Part("", "", None)
        else:
            opened, parts, last = stack.pop()
            parts = [*parts, last]
            tail = "?" if opened == "[" else ""
            add(f"(?:{'|'.join(p.java for p in parts)}){tail}", f"(?:{'|'.join(p.re2 for p in parts)}){tail}", None if tail else _choice(parts))
    return stack[0][2]


def _edges(spec: str) -> tuple[bool, bool]:
    """Whether the phrase begins, and ends, with a word character. All alternatives of its first part must agree."""
    plain = re.sub(r"[\[(|)\]]", "", spec)
    left = bool(re.match(r"[A-Za-z0-9_]", plain))
    if spec[:1] == "(":
        depth, starts, raw = 0, [], False
        for before, c in zip(spec, spec[1:]):
            raw = c != ">" and (raw or c == "<")
            depth += (c in "([") - (c in ")]") if not raw else 0
            if depth < 0:
                break
            if depth == 0 and before in "(|" and c not in "([":
                starts.append(bool(re.match(r"[A-Za-z0-9_]", c)))
        if len(set(starts)) > 1:
            raise ValueError(f"some alternatives begin with a word character and some don't; write them as phrases of their own: {spec}")
    return left, bool(re.search(r"[A-Za-z0-9_]\Z", plain))


def phrase(*specs: str, fold: bool = True) -> Phrase:
    """One regex for all specs, in order; fold: upper and lower case are alike."""
    java, re2, anchors = [], [], []
    for spec in specs:
        p = _parse(spec)
        left, right = _edges(spec)
        java.append(("(?<![A-Za-z0-9_])" if left else "") + p.java + ("(?![A-Za-z0-9_])" if right else ""))
        re2.append((r"\b" if left else "") + p.re2 + (r"\b" if right else ""))
        anchors.append(p)
    flags = "(?i)" if fold else ""
    return Phrase(flags + "|".join(java), flags + "|".join(re2), tuple(sorted(_choice(anchors) or ())))
