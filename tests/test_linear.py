"""Hostile texts of 200,000 characters, and what shortened blank runs find against plain regexes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from prosegauge.functions import finders
from prosegauge.operators import catalog, grade
from prosegauge.sources.seeds import SENTENCES

N = 200_000
HEAD = "No no certainly, did not x. In conclusion, is real do not do it. turns out? model whether you are perhaps less dead maybe not just forget :"
RNG = random.Random(2)
HOSTILE = {
    "blanks": HEAD + " " * N, "line breaks": HEAD + "\n" * N, "quotes": HEAD + '"' * N, "apostrophes": HEAD + "’'" * (N // 2), "mixed": HEAD + "".join(RNG.choice(' \n\t"') for _ in range(N)),
    "blank lines": HEAD + " \n" * (N // 2), "hyphens": HEAD + "a-" * (N // 2), "many runs": (HEAD + " " * 1000) * (N // 1100), "quoted lines": HEAD + '\n"' * (N // 2), "chains": ("no x" + " " * 90 + "\n") * 2000, "stops": HEAD + ". " * (N // 2),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_all_detectors_are_linear(name):
    began = time.time()
    finders.find(HOSTILE[name], catalog.ALL.chosen(catalog.ALL.ids))
    assert time.time() - began < 3


def test_shortened_runs_find_what_plain_regexes_find():
    rng = random.Random(9)
    gaps = [" ", "\n", " \n", "\n\n", " " * 5, " " * 30, "\n" * 40, " \n" * 30, " " * 25 + "\n" + " " * 25, "\t" * 200, " " * 90 + "\n" + " " * 90 + "\n" + " " * 90]
    regexes = {d.pattern_id: finders.python_regex(catalog.compiled(d.pattern_id).java) for d in catalog.DETECTORS if d.kind in ("phrase", "far", "again", "questions")}
    seen = set()
    for _ in range(1500):
        text = rng.choice(gaps).join(rng.choice(SENTENCES).replace(" ", rng.choice(gaps), rng.randrange(3)) for _ in range(rng.randrange(1, 4))) + rng.choice(["", *gaps])
        for pattern_id, regex in regexes.items():
            spans = [m.span() for m in regex.finditer(text)]
            if pattern_id == "stacked-questions":
                spans = [(finders._trimmed(text, *s)[0], s[1]) for s in spans]
            assert [f[:2] for f in finders.find_by_id(text, [pattern_id])] == spans, (pattern_id, text)
            seen |= {pattern_id} if spans else set()
    assert len(seen) > 50


def test_shortened_text_carries_places_back():
    text = "a" + " " * 50 + "\n" + " " * 50 + "\n" + " " * 50 + "b" + " " * 9 + "c"
    short = finders._Shortened(text, [(1, 153)], 4)
    assert short.text == "a" + " " * 4 + "\n\n" + " " * 4 + "b" + " " * 9 + "c"
    assert [short.back(short.text.index(x)) for x in "a\nbc"] == [text.index(x) for x in "a\nbc"] and short.back(len(short.text)) == len(text)


@pytest.mark.parametrize("name", ["blanks", "line breaks", "hyphens", "apostrophes", "quotes", "contrasts", "triads", "blank lines"])
def test_the_grade_is_linear(spark, name):
    sentence = "The quick one went home. " * 200
    long = {"contrasts": ", not a" * (N // 7), "triads": "a, b, and c " * (N // 12)} | HOSTILE
    run = lambda text: grade.grade(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n_words", "n_sentences", F.to_json("signals")).first()
    run(sentence)  # compiled and warm
    began = time.time()
    got = run(sentence + "word " + long[name] + " word." + sentence)
    assert time.time() - began < 3 + 4 and got.n_words > 2000  # the plan itself takes up to four seconds on two cores
