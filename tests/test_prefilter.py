"""Texts are searched by Python only where Arrow's regex says that a detector may find something."""

import pyarrow as pa
import pyarrow.compute as pc

from prosegauge.functions import finders
from prosegauge.operators.catalog import ALL
from prosegauge.sources.seeds import SENTENCES

_BY_PHRASE = [(o, d) for o, d in ALL.chosen(ALL.ids) if d.kind not in ("echo", "anaphora")]


def test_loose_regex_keeps_every_text_with_a_find():
    texts = [*SENTENCES, *[" 　".join(SENTENCES[i : i + 3]) for i in range(60)], "Yes.\x1cNo.\x85 Go﻿on!", "\n\nGo. " + " " * 40 + "Stay put. Run."]
    for o, d in _BY_PHRASE:
        may = pc.match_substring_regex(pa.array(texts), finders._loose(d, d.specs)).to_pylist()
        for text, m in zip(texts, may, strict=True):
            assert m or not finders._Searched(text).find(o, d), (d.pattern_id, text)


def test_texts_without_phrases_are_not_searched(monkeypatch):
    searched = []
    monkeypatch.setattr(finders._Searched, "find", lambda self, o, d: searched.append(d.pattern_id) or [])
    finders.find_all(["the of and not is it for a real way"] * 5, _BY_PHRASE)  # anchors of many phrases, no find
    assert not searched


def test_batches_give_what_single_texts_give():
    texts = [None, "", *SENTENCES, "It is it. It is it. A b c d e. A b c d f. ? A b c d."]
    chosen = ALL.chosen(ALL.ids)
    assert finders.find_all(texts, chosen) == [finders.find(t, chosen) for t in texts]
