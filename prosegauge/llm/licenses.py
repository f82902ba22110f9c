"""License scans by template-markup matching.

A template is wording with markup: <<opt>>...<</opt>> may be left out, and
<<var:n>> stands for any run of up to n words. A template is compiled into an
automaton over words; a text is accepted where every mandatory word stands
exactly, in order. Beside the templates, fixed phrases are counted wherever
their words stand consecutively.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import WORD, fold
from .license_texts import TEMPLATES

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_MARK = re.compile(r"<<(/?opt|var:\d+)>>|([^<\s]+)")


class Automaton(NamedTuple):
    """States 0 to n - 1; steps[s] maps a word to next states, wild[s] are states that any word leads to, free[s] those that none is needed for."""

    steps: list[dict[str, tuple[int, ...]]]
    wild: list[tuple[int, ...]]
    free: list[tuple[int, ...]]
    accept: int
    mandatory: int


def compile_template(markup: str) -> Automaton:
    """One template as an automaton. a|b are alternatives for one word; a word that folds to several is a row of them."""
    steps: list[dict[str, list[int]]] = [{}]
    wild: list[list[int]] = [[]]
    free: list[list[int]] = [[]]
    opened: list[int] = []
    mandatory = 0

    def state() -> int:
        steps.append({})
        wild.append([])
        free.append([])
        return len(steps) - 1

    at = 0
    for m in _MARK.finditer(markup):
        if m[1] == "opt":
            opened.append(at)
        elif m[1] == "/opt":
            free[opened.pop()].append(at)
        elif m[1]:
            start = at
            for _ in range(int(m[1][4:])):
                new = state()
                wild[at].append(new)
                at = new
            end = state()
            for s in range(start, at + 1):
                free[s].append(end)
            at = end
        else:
            rows = [WORD.findall(fold(x)) for x in m[2].split("|")]
            end = state()
            for words in rows:
                here = at
                for i, w in enumerate(words):
                    to = end if i + 1 == len(words) else state()
                    steps[here].setdefault(w, []).append(to)
                    here = to
            mandatory += 0 if opened else len(rows[0])
            at = end
    if opened:
        raise ValueError(f"not closed: {markup}")
    return Automaton([{w: tuple(x) for w, x in s.items()} for s in steps], [tuple(x) for x in wild], [tuple(x) for x in free], at, mandatory)


def _closed(states: set[int], a: Automaton) -> set[int]:
    todo = list(states)
    while todo:
        for x in a.free[todo.pop()]:
            if x not in states:
                states.add(x)
                todo.append(x)
    return states


def accepts(a: Automaton, words: list[str], start: int) -> int | None:
    """The end (exclusive) of the longest match of a from start, or None."""
    states, end = _closed({0}, a), None
    for i in range(start, len(words) + 1):
        if a.accept in states:
            end = i
        if i == len(words):
            break
        states = _closed({x for s in states for x in (*a.steps[s].get(words[i], ()), *a.wild[s])}, a)
        if not states:
            break
    return end


def regex(markup: str) -> tuple[str, int]:
    """(RE2 regex over words set between single blanks, mandatory words) of a template: what its automaton accepts, for the SQL check."""
    out, depth, mandatory = "", 0, 0
    for m in _MARK.finditer(markup):
        if m[1] == "opt":
            out, depth = out + "(?:", depth + 1
        elif m[1] == "/opt":
            out, depth = out + ")?", depth - 1
        elif m[1]:
            out += f"(?:[^ ]+ ){{0,{m[1][4:]}}}"
        else:
            rows = [WORD.findall(fold(x)) for x in m[2].split("|")]
            out += "(?:" + "|".join(" ".join(words) + " " for words in rows) + ")"
            mandatory += 0 if depth else len(rows[0])
    return f" {out}", mandatory


class Scanner:
    """All templates and phrases over a document. A template is tried wherever a word stands that it can begin with."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.autos = [(label, compile_template(t)) for label, ts in sorted(templates.items()) for t in ts]
        self.firsts: dict[str, list[int]] = {}
        for k, (_, a) in enumerate(self.autos):
            starts = _closed({0}, a)
            if any(a.wild[s] for s in starts):
                raise ValueError("a template can't begin with a replaceable region")
            for w in {w for s in starts for w in a.steps[s]}:
                self.firsts.setdefault(w, []).append(k)
        self.phrases = [(p.split(" "), label) for p, label in phrases.items()]
        self.needed = {p[0] for p, _ in self.phrases} | set(self.firsts)

    def scan(self, text: str | None) -> tuple:
        words = WORD.findall(fold(text)) if text else []
        n = len(words)
        if not self.needed & set(words):
            return n, 0, None, None, [], [], 0.0, []
        where: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.needed:
                where.setdefault(w, []).append(i)
        starts, base = [], set()
        for phrase, label in self.phrases:
            own = [i for i in where.get(phrase[0], ()) if words[i : i + len(phrase)] == phrase]
            starts += own
            if own:
                base.add(label)
        found, best = [], 0
        for w, ks in self.firsts.items():
            for i in where.get(w, ()):
                for k in ks:
                    label, a = self.autos[k]
                    end = accepts(a, words, i)
                    if end is not None:
                        found.append((label, i, end))
                        best = max(best, a.mandatory)
        labels = sorted(base | {x for x, _, _ in found})
        score = 1 - 1 / (1 + best) if best else 0.5 if base else 0.0
        return n, len(starts), min(starts, default=None), max(starts, default=None), sorted(base), labels, score, found


_FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, matches array<struct<label:string,first:int,end:int>>"
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]


@lru_cache(maxsize=4)
def _scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner({k: list(v) for k, v in templates}, dict(phrases))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """docs with a struct column `license`: words, places of base phrases, labels, matched templates, score.

    score is 0 without any find, 1/2 for base phrases alone, and 1 - 1/(1 + m)
    where the fullest template matched has m mandatory words. Null and empty
    texts have no words and no finds. Overlapping places of a phrase all count.
    Rows that repeat stay; extra columns stay, one named license is replaced.
    """
    t = tuple((k, tuple(v)) for k, v in (TEMPLATES if templates is None else templates).items())
    p = tuple((PHRASES if phrases is None else phrases).items())

    @F.pandas_udf(_FOUND)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(t, p)
        for s in batches:
            out = pd.DataFrame([scanner.scan(x) for x in s], columns=_NAMES)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn("license", of("text"))
