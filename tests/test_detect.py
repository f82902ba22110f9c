"""Detectors, overlaps, contexts: our own sentences and what is found in them."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from prosegauge.functions import finders
from prosegauge.functions.phrases import phrase
from prosegauge.jobs import corpus
from prosegauge.operators import catalog, detect
from prosegauge.operators.grade import grade
from prosegauge.operators.page_scan import node_rows, scan_pages
from prosegauge.sources.seeds import SENTENCES

# (detector, sentence, finds, items of each counted find)
CASES = [
    ("no-chain", "There was no rush, no noise and no hurry at all.", 1, [3]),
    ("no-chain", "There was no rush.", 0, []),
    ("no-chain", "It is a no-code, no-config tool.", 1, [2]),
    ("whole", "That’s the whole idea.", 1, None),
    ("whole", "We read the whole book.", 0, None),
    ("did-not-chain", "She did not wait, did not ask, didn't stop.", 1, [3]),
    ("dont-verb-it", "Don't think about it. Read about it.", 0, None),
    ("dont-verb-it", "Do not say it; say it.", 1, None),
    ("sit-with", "Try sitting with the discomfort for a minute.", 1, None),
    ("already-know", "You already know.", 1, None),
    ("already-know", "You already know Paris.", 0, None),
    ("is-the-entire", "It's the entire plan.", 1, None),
    ("the-entire-is", "The entire plan of ours is new.", 1, None),
    ("is-real", "The cost is real and it hurts.", 1, None),
    ("is-real", "This is a real estate and it sells.", 0, None),
    ("punchline", "The punchline: nobody came.", 1, None),
    ("worth-naming", "That feels worth naming.", 1, None),
    ("worth-naming", "It is worth naming names.", 0, None),
    ("not-nothing", "That is not nothing.", 1, None),
    ("is-the-whole", "Here's the whole list.", 1, None),
    ("echo-triad", "He went to the old mill. She went to the old barn.", 1, [2]),
    ("echo-triad", "He went to the mill. Birds sing in early spring.", 0, []),
    ("performative-honesty", "It failed. Honestly, we knew.", 1, None),
    ("performative-honesty", "They spoke honestly, we knew.", 0, None),
    ("thats-the-part", "This is the part of it.", 1, None),
    ("the-only-i-trust", "It is the only tool I trust.", 1, None),
    ("take-my-word", "You don't have to take my word for it.", 1, None),
    ("turns-out", "Turns out he left.", 1, None),
    ("turns-out", "He turns out lights.", 0, None),
    ("fits-in-your-head", "It fits in your head.", 1, None),
    ("stacked-questions", "Why us? Why now? Fine.", 1, [2]),
    ("stacked-questions", "Why us?", 0, []),
    ("sentence-anaphora", "Perhaps so. Perhaps not. Perhaps later on.", 1, [3]),
    ("sentence-anaphora", "The cat. The dog. The bird.", 0, []),
    ("colon-triple", "We need three: red paint, blue paint, and time.", 1, None),
    ("heres-the-twist", "Here's the twist: it worked.", 1, None),
    ("x-is-dead", "Printed paper is dead.", 1, None),
    ("thats-why-mattered", "That is why the vote mattered.", 1, None),
    ("stranded-auxiliary", "Some left; the others never did.", 1, None),
    ("chat-boilerplate", "Certainly! Here it is.", 1, None),
    ("scene-setting", "In a world where time stops, we wait.", 1, None),
    ("journey-metaphor", "They embarked on a journey.", 1, None),
    ("dive-in", "Let's dive in.", 1, None),
    ("hype-buzzwords", "A game-changing, cutting edge idea.", 2, None),
    ("conclusion-wrapper", "It ended. In summary, it was good.", 1, None),
    ("cataphoric-teaser", "Here's what most people get wrong.", 1, None),
    ("hook-opener", "It is the worst mistake you make.", 1, None),
    ("false-authority", "Studies show it.", 1, None),
    ("corporate-buzzwords", "A holistic approach.", 1, None),
    ("fiction-slop", "Her breath hitched.", 1, None),
    ("something-for-everyone", "There is something for everyone.", 1, None),
    ("verb-inflation", "In order to utilise or utilize it.", 2, None),
    ("hedge-stack", "Generally speaking, it may potentially rain.", 2, None),
    ("pseudo-wisdom", "Timing is everything.", 1, None),
    ("ai-vocab", "They foster care; she fosters hope and delves deep.", 2, None),
    ("ai-vocab", "A non-pivotal vote.", 0, None),
    ("not-just", "It isn't a tool, it's a habit.", 1, None),
    ("not-just", "He is a clerk, not a judge.", 1, None),
    ("note-that", "It’s worth noting that it rained.", 1, None),
    ("testament", "It stands as a lasting testament.", 1, None),
    ("crucial-role", "It played a truly vital role.", 1, None),
    ("landscape", "The political landscape.", 1, None),
    ("vague-experts", "Many experts believe it.", 1, None),
    ("despite-challenges", "Despite these many challenges, we go.", 1, None),
    ("participle-tail", "It fell, highlighting the need for care.", 1, None),
    ("promo", "Nestled in a valley, a hidden gem.", 2, None),
    ("ai-leftovers", "Dear [insert name], see **this note** now.", 2, None),
    ("ai-leftovers", "[insert name]", 0, None),
    ("copulative-avoidance", "It serves as a base.", 1, None),
    ("vague-association", "In connection with that.", 1, None),
    ("canned-notability", "It gained significant media coverage.", 1, None),
    ("topic-announcement", "The real story here is trust.", 1, None),
    ("ineffability", "A thing that no tool can measure.", 1, None),
    ("transition-openers", "Yes. Moreover, it rained.", 1, None),
    ("shapes-discussions", "It sparked a debate about rain.", 1, None),
    ("primary-source", "The official website lists it.", 1, None),
    ("literary-slop", "The constellation of lights.", 1, None),
    ("staccato-fragments", "Bold. Clear. Ready now.", 1, [3]),
    ("staccato-fragments", "See Dr. Then St. Now vol.", 0, []),
    ("no-chain", "éno rush, éno noise", 0, []),
    ("no-chain", "There is no a, no ", 1, [1]),
    ("not-just", "It's a lamp, not a mirror.", 1, None),
    ("not-just", "The dog's a friend, not the owner", 1, None),
    ("not-just", "’s a lamp, not a mirror.", 0, None),
    ("did-not-chain", "She did not wait; she left.", 0, []),
    ("whole", "That was a whole day.", 0, None),
    ("dont-verb-it", "Don't fear it. We fear nothing.", 0, None),
    ("sit-with", "They sit with friends.", 0, None),
    ("is-the-entire", "She read the entire book.", 0, None),
    ("the-entire-is", "The entire plan of ours for the next two years is new.", 0, None),
    ("punchline", "A punchline came.", 0, None),
    ("not-nothing", "There is nothing.", 0, None),
    ("is-the-whole", "Here lies the whole list.", 0, None),
    ("thats-the-part", "The part fits.", 0, None),
    ("the-only-i-trust", "The only tool is here.", 0, None),
    ("take-my-word", "They take my word.", 0, None),
    ("fits-in-your-head", "The hat fits your head.", 0, None),
    ("colon-triple", "We need two: red paint and blue paint.", 0, None),
    ("heres-the-twist", "Here's the twisted road.", 0, None),
    ("x-is-dead", "The old deadline is near.", 0, None),
    ("thats-why-mattered", "That is why they left. It mattered.", 0, None),
    ("stranded-auxiliary", "Some left; the others never did it.", 0, None),
    ("chat-boilerplate", "He certainly came.", 0, None),
    ("scene-setting", "In the world of birds, we wait.", 0, None),
    ("journey-metaphor", "They went on a journey.", 0, None),
    ("dive-in", "A deep lake.", 0, None),
    ("hype-buzzwords", "The game changed.", 0, None),
    ("conclusion-wrapper", "The book in summary, was good.", 0, None),
    ("cataphoric-teaser", "Here is what they sell: bread.", 1, None),
    ("hook-opener", "It is the worst weather of all.", 0, None),
    ("false-authority", "The study shows it.", 0, None),
    ("corporate-buzzwords", "A framework of steel.", 0, None),
    ("fiction-slop", "He spoke in a whisper.", 0, None),
    ("something-for-everyone", "There is something for you.", 0, None),
    ("verb-inflation", "An initiative began.", 0, None),
    ("hedge-stack", "It may rain.", 0, None),
    ("pseudo-wisdom", "Everything takes time.", 0, None),
    ("note-that", "It is a note that fell.", 0, None),
    ("testament", "The old testament.", 0, None),
    ("crucial-role", "A role was played.", 0, None),
    ("landscape", "A green landscape.", 0, None),
    ("vague-experts", "The experts met.", 0, None),
    ("despite-challenges", "Despite the rain, we go.", 0, None),
    ("participle-tail", "It fell, highlighting nothing.", 0, None),
    ("promo", "The bird nestled.", 0, None),
    ("copulative-avoidance", "She serves tea.", 0, None),
    ("vague-association", "The association met.", 0, None),
    ("canned-notability", "It gained weight.", 0, None),
    ("topic-announcement", "The topic changed.", 0, None),
    ("ineffability", "A thing that no bird eats.", 0, None),
    ("transition-openers", "It was, moreover, wet.", 0, None),
    ("shapes-discussions", "It started a fire.", 0, None),
    ("primary-source", "The official opened it.", 0, None),
    ("literary-slop", "A star of lights.", 0, None),
    ("performative-honesty", "To be sure, it rained.", 0, None),
    ("staccato-fragments", "Bold. Clear.", 0, []),
]


@pytest.mark.parametrize(("pattern_id", "text", "n", "items"), CASES)
def test_cases(pattern_id, text, n, items):
    found = finders.find_by_id(text, [pattern_id])
    assert len(found) == n
    if items is not None:
        assert [f.item_count for f in found] == items


def test_every_detector_has_a_case_and_a_row(spark):
    assert {c[0] for c in CASES if c[2]} == {d.pattern_id for d in catalog.DETECTORS}
    rows = catalog.catalog(spark).orderBy("ordinal").collect()
    assert len(rows) == 63 and sum(r.is_wiki for r in rows) == 16 and [r.pattern_id for r in rows if not r.default_enabled] == ["colon-triple"]
    off = spark.createDataFrame([("whole",), ("unknown",), (None,)], "pattern_id string")
    assert len(detect.ids_of(catalog.enabled(spark, off))) == 62


def test_blanks_edges_and_prefix():
    assert [(f.start, f.end) for f in finders.find_by_id("in\u00a0order\u2003to go", ["verb-inflation"])] == [(0, 11)]
    assert finders.find_by_id("Right. Moreover, so.", ["transition-openers"])[0][:2] == (5, 16)
    assert finders.find_by_id("Done.\nTurns out", ["turns-out"])[0][:2] == (4, 15)


def test_resolve_keeps_the_earliest_then_the_longest():
    f = finders.Find
    found = [f(5, 9, None, 1), f(0, 4, None, 3), f(0, 6, None, 2), f(6, 8, None, 0), f(6, 8, None, 4)]
    assert finders.resolve(found) == [f(0, 6, None, 2), f(6, 8, None, 0)]


def test_kept_spans_never_overlap_and_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        found = [finders.Find(s := rng.randrange(40), s + rng.randrange(1, 9), None, rng.randrange(63)) for _ in range(rng.randrange(12))]
        kept, reach = [], -1
        for x in sorted(found, key=lambda x: (x.start, -x.end, x.ordinal)):
            if x.start >= reach:
                kept.append(x)
                reach = x.end
        assert finders.resolve(found) == kept


def test_scan_rows_contexts(spark):
    text = " ".join(f"w{i}" for i in range(30)) + ". It just works. " + " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 9), (2, None, 9), (3, "", 9), (1, text, 9)], "doc_id long, text string, found int")
    scanned = detect.scan(docs)
    assert sorted(r.n_matches for r in scanned.collect()) == [0, 0, 1, 1]
    m = detect.match_rows(scanned, ["doc_id"]).first()
    assert (m.pattern_id, m.snippet, m.match_id) == ("fits-in-your-head", "It just works", 0)
    c = detect.contexts(docs, ["doc_id"]).first()
    assert c.context.split()[0] == "w18" and c.context.split()[-1] == "v11" and c.n_matches == 1
    counts = detect.per_pattern(scanned, ["doc_id"]).first().per_pattern
    assert len(counts) == 63 and sum(counts.values()) == 1
    assert detect.scan(docs, []).agg({"n_matches": "sum"}).first()[0] == 0
    at = detect.matches_at(spark.createDataFrame([(1, m.start), (1, m.end), (7, 0)], "doc_id long, pos int"), detect.match_rows(scanned, ["doc_id"]).distinct())
    assert sorted((r.pos, r.pattern_id) for r in at.collect() if r.doc_id == 1) == [(m.start, "fits-in-your-head"), (m.end, None)]


def test_cap(spark):
    docs = spark.createDataFrame([(1, "x" * 100 + " it just works")], "doc_id long, text string")
    r = detect.scan(docs, cap=100).first()
    assert r.truncated and r.n_matches == 0


def test_whole_texts_are_scanned(spark):
    text = "word " * 120_000 + "It just works."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    scanned = detect.scan(docs)
    m = detect.match_rows(scanned, ["doc_id"]).collect()
    assert [(r.pattern_id, r.start) for r in m] == [("fits-in-your-head", 600_000)] and not scanned.first().truncated
    assert detect.contexts(docs, ["doc_id"]).first()["end"] == len(text)


@pytest.mark.parametrize("pattern_id", ["is-real", "dont-verb-it", "not-just"])
def test_far_finders_find_what_the_regex_finds(pattern_id):
    words = ["is", "real", "the", "a", "and", "not", "it", "estate", "don't", "do not", "do", "just", "of", "but", "also", "only", ",", ".", "\n", "Verb", "is real", "and it", "don't do it", ", do it", ". just do it", "not just"]
    rng, n, whole = random.Random(7), 0, finders.python_regex(catalog.compiled(pattern_id).java)
    for _ in range(4000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randint(4, 40)))
        spans = [m.span() for m in whole.finditer(text)]
        assert [f[:2] for f in finders.find_by_id(text, [pattern_id])] == spans
        n += len(spans)
    assert n > 20


@pytest.mark.parametrize(("unit", "pattern_id"), [("is real ", "is-real"), ("don't do it ", "dont-verb-it"), ("not only ", "not-just")])
def test_sentences_without_end_are_searched_once(unit, pattern_id):
    text, began = "But and. " + unit * 100_000, time.time()  # the anchors are there, the ends are not
    finders.find_by_id(text, [pattern_id])
    assert time.time() - began < 10


@pytest.mark.parametrize("unit", ["a ", "no ", "no a, ", "word, ", "it is a real ", "perhaps x ", "Don't do it ", "did not ", "in a ", "x.", "? "])
def test_hostile_texts_end(unit):
    """All default detectors together, within what each of them may take."""
    text, began = (unit * (200_000 // len(unit))), time.time()
    finders.find_by_id(text, detect.default_ids())
    assert time.time() - began < 3


def test_contradictory_edges_are_refused():
    with pytest.raises(ValueError, match="phrases of their own"):
        phrase("(is|<['’]s>) the")


def test_each_seed_holds_its_detector():
    for pattern_id, text in zip(catalog.ALL.ids, SENTENCES, strict=True):
        assert pattern_id in {catalog.ALL.ids[f.ordinal] for f in finders.find("Some words.\n" + text, catalog.ALL.chosen(catalog.ALL.ids))}


def test_chains_and_runs_against_plain_regexes():
    """Linear searches against what the definitions' regexes find."""
    rng = random.Random(3)
    words = ["no ", "no-", "did not ", "didn't ", "rush", ", ", "; ", "and ", "or ", "x", "a. ", "Yes. ", "Maybe ", "? ", "\n", " - ", "  ", "Bold. ", "...", "— "]
    for _ in range(3000):
        text = "".join(rng.choice(words) for _ in range(rng.randrange(3, 30)))
        for pattern_id in ("no-chain", "did-not-chain"):
            spans = [finders._trimmed(text, *m.span(), left=False) for m in finders.python_regex(catalog.compiled(pattern_id).java).finditer(text)]
            assert [f[:2] for f in finders.find_by_id(text, [pattern_id])] == spans
        assert [*finders._closed(text, "[.!?]+", 4)] == [m.span() for m in re.finditer(r"[^.!?\n]{1,4}[.!?]+", text)]


def test_one_python_evaluation_a_plan(spark):
    docs = spark.createDataFrame([(1, "It just works.")], "doc_id long, text string")
    web = spark.createDataFrame([(1, "http://a.org", "<p>It just works.</p>")], "page_id long, url string, html string")
    own = {
        "matches": corpus.match_table(docs), "contexts": detect.contexts(docs, ["doc_id"]), "densest": corpus.densest(detect.scan(docs)), "counts": corpus.counts(docs, ["doc_id"]),
        "match_at": detect.matches_at(docs.select("doc_id", F.lit(3).alias("pos")), detect.match_rows(detect.scan(docs), ["doc_id"])), "nodes": node_rows(scan_pages(web), ["page_id"]),
    }
    for name, frame in own.items():
        plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert len(re.findall(r"ArrowEvalPython|MapInPandas", plan)) == 1, name
        assert frame.count() >= 1


def test_a_users_detectors(spark):
    own = catalog.ALL.added(catalog.Detector("boats", "own", "boats", specs=("(boat|ship)[s]",)), catalog.Detector("digits", "own", "digits", "function", function=lambda t: [(i, i + 1, None) for i, c in enumerate(t) if c.isdigit()]))
    docs = spark.createDataFrame([(1, "Two ships, 1 boat, it just works."), (2, None)], "doc_id long, text string")
    counted = {r.pattern_id: r.hits for r in corpus.counts(docs, [], own.ids, own).collect() if r.hits}
    assert counted == {"boats": 2, "digits": 1, "fits-in-your-head": 1}
    assert {(r["group"], r.pattern_id): (r.hits, r.docs) for r in corpus.rollup(detect.scan(docs, own.ids, among=own), own).collect()}["own", None] == (3, 1)
    with pytest.raises(ValueError, match="same pattern_id"):
        own.added(catalog.Detector("whole", "own", ""))


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "en", "It just works in connection with it."), (2, None, "x")], "doc_id long, lang string, text string")
    corpus.write_matches(corpus.match_table(docs), str(tmp_path / "m"))
    assert {(r["group"], r.lang) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {("tic", "en"), ("wiki", "en")}
    corpus.write_grades(grade(docs), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).where("tier = 'low'").count() == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert detect.match_rows(detect.scan(docs), ["doc_id"]).count() == 0


def test_a_phrase_as_columns_finds_the_same(spark):
    from prosegauge.functions.spans import phrase_spans

    own = catalog.compiled("verb-inflation")
    texts = ["In order to utilize it, prior to that.", "none", "", None, "a number of é things in order  to"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in docs.select("text", phrase_spans(docs.text, own).alias("s")).collect():
        assert [(x.start, x.end) for x in r.s or []] == [f[:2] for f in finders.find_by_id(r.text, ["verb-inflation"])]
