"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force where SQL can't say."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from prosegauge.llm import ann, bpe, decontaminate, huffman, langid, licenses, line_dedup, simhash, token_counts, toxicity
from prosegauge.llm.components import components

DOCS = "doc_id long, text string"
LONG = "a very long line of words that goes on and on " * 3000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "shared line here\nown line of one"), (2, "Shared line here \nshort\n\n"), (3, None), (4, ""), (5, LONG), (2, "Shared line here \nshort\n\n"), (None, "shared line here")]
    return spark.createDataFrame([(*r, 0, "x", 7, *"abcdef") for r in rows], DOCS + ", n_dropped int, hits string, score int, drops string, kept string, KEY string, parts string, found string, n string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS + ", lang string")


def test_line_dedup(spark, docs, none):
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in line_dedup.dedup(docs).collect()}
    assert got[1, "shared line here\nown line of one"] == (2, 0) and got[2, "short\n\n"] == (4, 1)
    assert got[3, None] == (1, 0) and got[4, ""] == (1, 0) and got[None, "shared line here"] == (1, 0)
    assert line_dedup.dedup(docs).columns == [*docs.columns[:2], "n_dropped", *docs.columns[3:], "n_lines"]
    assert line_dedup.dedup(docs).count() == 7 and line_dedup.dedup(none).count() == 0


def test_line_dedup_is_reversible(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "\n".join(f"line number {rng.randrange(30)}" for _ in range(6))) for i in range(40)]
    one, two = (spark.createDataFrame(r, DOCS) for r in (rows[:25], rows[20:]))
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)  # many shards, and more of them on the way
    index = line_dedup.insert(line_dedup.insert(line_dedup.empty(spark), one), two)
    assert index.n_shards > 4
    gone = spark.createDataFrame([(i,) for i in range(0, 40, 3)] + [(99,)], "doc_id long")
    index = line_dedup.delete(index, gone)
    rest = [r for r in rows if r[0] % 3]
    want = line_dedup.insert(line_dedup.empty(spark), spark.createDataFrame(rest, DOCS))
    table = lambda i: sorted(map(tuple, i.counts.select("key", "n_docs", "owner").collect()))
    assert table(index) == table(want)
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeats(index, spark.createDataFrame(rest, DOCS)).collect()}
    owner: dict[str, int] = {}
    for i, text in rest:
        for line in text.split("\n"):
            owner.setdefault(line, i)
    shared = {x for x in owner if sum(x in t.split("\n") for _, t in rest) > 1}
    assert kept == {i: "\n".join(x for x in t.split("\n") if x not in shared or owner[x] == i) for i, t in rest}


    lines = line_dedup._postings(spark.createDataFrame(rest, DOCS), 10)
    both = [sorted(map(tuple, line_dedup.maybe_shared(index, lines, most).select("key", "doc_id").collect())) for most in (1 << 20, 0)]
    assert both[0] == both[1]
    held = {r.key for r in index.counts.where("n_docs > 1").select("key").collect()}
    assert {k for k, _ in both[0]} >= held and len(both[0]) < lines.count()


def test_cuckoo_filter():
    h = np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64)
    f = line_dedup.CuckooFilter.sized(5000)
    assert f.insert(h) and f.contains(h).all()
    f.delete(h[:2500])
    assert f.contains(h[2500:]).all() and f.contains(h[:2500]).mean() < 0.01


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs, none):
    rng, base = random.Random(2), [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w if rng.random() > 0.003 * (i % 7) else "zz" for w in base[: 400 - i % 3])) for i in range(60)]
    rows += [(100 + i, " ".join(f"q{rng.randrange(9999)}" for _ in range(30))) for i in range(40)] + [(200, None), (201, " \n"), (202, "a b")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).withColumn("fingerprint", simhash.hex16(simhash.F.col("fp"))).collect()}
    fp = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in fp}
    assert simhash.near_duplicates(docs).count() == 7 and simhash.near_duplicates(none).count() == 0


def test_simhash_hot_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 4000)
    rng = random.Random(3)
    centre = rng.getrandbits(63)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(4))) for _ in range(150)} | {rng.getrandbits(63) for _ in range(100)}
    fps = sorted(fps)
    links = simhash.ball_links(spark.createDataFrame(list(enumerate(fps)), "id long, fp long"))
    got = {r.node: r.root for r in components(links).collect()}
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i + 1, len(fps)):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert [got.get(i, i) for i in range(len(fps))] == root


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, "One two, three four five six seven eight nine ten ELEVEN"), (2, "Short item"), (3, None), (4, "...")], "item_id long, text string")
    rows = [(1, "x ONE two three four five six seven eight nine ten. y short-item"), (2, "one two three"), (3, None), (4, "")]
    texts = spark.createDataFrame([(*r, "old") for r in rows], DOCS + ", hits string")
    for limit in (1 << 20, 20):
        got = {r.doc_id: r.hits for r in decontaminate.overlaps(texts, items, block_chars=limit).collect()}
        assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1]["items"]) == (14, 12, 2, ["1", "2"])
        assert [rows[0][1][s.start : s.end] for s in got[1].spans] == ["ONE two three four five six seven eight nine ten", "short-item"]
        assert got[2].n_hit == 0 and got[3].n_words == 0 and got[4].n_items == 0
    assert decontaminate.overlaps(docs, items.where("false")).where("hits.n_hit > 0").count() == 0
    assert decontaminate.overlaps(none, items).count() == 0


def test_ann_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vecs = [rng.standard_normal(16) for _ in range(300)]
    rows = [(i, (vecs[i % 250] if i > 270 else vecs[i]).tolist()) for i in range(300)] + [(400, [0.0] * 16), (450, None), (500, [float("nan")] * 16), (550, [1.0])]
    rows += [rows[7]]
    usable = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got: dict[int, list] = {}
    for r in ann.search(ann.build(usable, block=100), usable.where("vec_id % 10 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    real = {i: np.array(v) for i, v in rows if i < 300}
    hit = 0
    for q, found in got.items():
        cos = sorted((-(real[q] @ v) / np.sqrt((real[q] @ real[q]) * (v @ v)), i) for i, v in real.items() if i != q)
        hit += len({i for _, i in cos[:5]} & {i for _, i, _ in found})
        for _, i, s in found:
            assert abs(s - (real[q] @ real[i]) / np.sqrt((real[q] @ real[q]) * (real[i] @ real[i]))) < 1e-12
    assert len(got) == 30 and hit >= 0.9 * 150


def test_ann_extreme_and_repeated_vectors(spark):
    """Components whose squares overflow or vanish score like the same vectors scaled; a repeated vec_id counts with its smallest vector; other lengths don't meet."""
    rng = np.random.default_rng(12)
    vecs = [rng.standard_normal(8) for _ in range(40)]
    size = [1e200, 1e-200, 1.0, 1e300, 1e-300]
    schema = "vec_id long, embedding array<double>"
    rows = [(i, (v * size[i % 5]).tolist()) for i, v in enumerate(vecs)]
    usable = ann.usable(spark.createDataFrame([*rows, (50, [1.0, 2.0]), (60, [2.0, 1.0]), (50, [3.0, 0.0])], schema))
    got: dict[int, list] = {}
    for r in ann.search(ann.build(usable), usable.where("vec_id % 10 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 10, 20, 30):
        cos = sorted((-(vecs[q] @ v) / np.sqrt((vecs[q] @ vecs[q]) * (v @ v)), i) for i, v in enumerate(vecs) if i != q)
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in cos[:5]]
        assert np.allclose([s for _, _, s in sorted(got[q])], [-c for c, _ in cos[:5]], atol=1e-12)
    assert got[50] == [(1, 60, pytest.approx(0.8))] and got[60] == [(1, 50, pytest.approx(0.8))]


def test_ann_empty(spark):
    usable = ann.usable(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert ann.search(ann.build(usable.where("false")), usable.where("false")).count() == 0


def test_bpe_round_trip(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, rng = Tokenizer.from_file(path), random.Random(6)
    signs = [chr(c) for c in [*range(0x250), 0x300, 0x3A3, 0x4E2D, 0x1F600]]
    rows = [(i, "".join(rng.choice(signs) for _ in range(40))) for i in range(50)] + [(90, "It's <|endoftext|> <|ENDOFTEXT|>"), (91, None), (92, ""), (92, ""), (None, LONG)]
    table = spark.createDataFrame(rows, DOCS)
    for head in (1 << 20, 300, 0):
        got = bpe.encode(table, path, head_bytes=head, pieces=bpe.vocabulary(spark, path)).collect()
        want = []
        for i, t in rows:
            ids = tok.encode(t or "", add_special_tokens=False).ids
            want.append((str(i), ids, tok.decode(ids, skip_special_tokens=False)))
        assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == sorted(want)
    apart = bpe.decode(bpe.encode(table, path), bpe.vocabulary(spark, path)).collect()
    assert sorted(r.decoded for r in apart) == sorted(w[2] for w in want)
    assert bpe.encode(none, path).count() == 0 and bpe.encode(docs, path).count() == 7


def test_huffman_files(spark, docs, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    for name, table, n in (("a", docs, 7), ("b", none, 0)):
        huffman.write(huffman.token_ids(table, path, end=2), str(tmp_path / name))
        got = huffman.read(spark, str(tmp_path / name)).orderBy("start").collect()
        assert len(got) == n
        at = 0
        for r in got:
            assert r.start == at and r.ids[-1] == 2
            at += len(r.ids)
    tok = Tokenizer.from_file(path)
    want = sorted(zlib.crc32(np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in docs.collect())
    assert sorted(zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in huffman.read(spark, str(tmp_path / "a")).collect()) == want


def test_huffman_long_documents_and_large_ids(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.choice([3, 5, 9, 2**30], n).tolist()) for i, n in ((3, huffman.MOST * 2 + 5), (1, 10), (2, 0), (4, 40_000))]
    huffman.write(huffman.packed(spark.createDataFrame(rows, "doc_id long, ids array<int>")), str(tmp_path / "x"))
    got = {r.doc_id: (r.start, list(r.ids)) for r in huffman.read(spark, str(tmp_path / "x")).collect()}
    at = 0
    for i, ids in sorted(rows):
        assert got[i] == (at, ids)
        at += len(ids)


def test_code_lengths_are_limited_and_whole():
    counts = (1.6 ** np.arange(40)).astype(np.int64)
    lengths = huffman.code_lengths(counts, 12)
    assert lengths.max() == 12 and sum(2.0**-lengths) == 1
    with pytest.raises(ValueError, match="fit"):
        huffman.code_lengths(np.ones(9, np.int64), 3)


def test_token_counts(spark, docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [LONG[:9000], "ab" * 2000, "é中😀 " * 300, " " * 3000, "▁a " * 500, None, "", "x"]
    rows = list(enumerate([*texts, texts[0]]))
    for chunk, overlap in ((512, 64), (100, 40)):
        got = {r.doc_id: (r.n_tokens, r.n_bytes) for r in token_counts.count_tokens(spark.createDataFrame(rows, DOCS), path, chunk, overlap).collect()}
        assert got == {i: (len(sp.encode(t or "")), len((t or "").encode())) for i, t in rows}
    assert token_counts.count_tokens(docs, path).count() == 7 and token_counts.count_tokens(none, path).count() == 0


def test_langid(spark, docs, none):
    rng = random.Random(8)
    words = {"en": "the of and to in that is was for with".split(), "fr": "le de et la les des en un est pour".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i in range(200) for lang in [("en", "fr")[i % 2]]] + [(900, None, "en"), (901, "1 2 3", "fr"), (902, "the and", None), (None, "the of", "en")]
    got = langid.learn_and_predict(spark.createDataFrame(rows, DOCS + ", lang string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].lang_pred == lang for i, _, lang in rows[:200]) and all(0 <= r.score <= 1 for r in got)
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[900].score == 0 and by[902].lang_pred == "en" and by[None].held_out
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))
    assert langid.learn_and_predict(none).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    rng = random.Random(9)
    plain = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "re") for b in ("ta", "no", "sa") for c in ("n", "l", "r")]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        text = " ".join(rng.choices(plain, k=25))
        rows.append((i, f"{text} {rng.choice(['idiot', '1d10t', 'i d i o t', 'idiiiot', 'moron', 'm0r0n'])} {rng.choice(plain)}" if toxic else text))
        labels.append((i, int(toxic)))
    table, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (1, None), (7777, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, marks)
    out = [(r.doc_id % 3 == 0, r.score) for r in toxicity.score(table, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((s >= 0.5) == y for y, s in out) >= 0.95 * len(out)
    scores = [r.score for r in toxicity.score(docs, model).collect()]
    assert len(scores) == 7 and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(none, toxicity.fit(none, marks.where("false"))).count() == 0


@pytest.mark.parametrize("disguise", [
    "you are a i d i o t", "y o u i d i o t", "! d ! o t", "id.iot", "mo-ron", "i/d/i/o/t", "i  d  i  o  t", "i\nd\ni\no\nt", "i. d- i  o\tt", "iddiot", "i*d*i*o*t", "1 d 1 0 t", "i d i o t !", "m o r 0 n",
])
def test_toxicity_restores(disguise):
    text = "you are a kind person and that is a good word to say to the others in town, you idiot, you moron " * 40
    x = np.array([0, 0, *(toxicity._code(c) if c.isalpha() else 0 for c in text), 0])
    counts = np.zeros(28**3, np.int64)
    for a, b, c in zip(x, x[1:], x[2:], strict=False):
        counts[((a if b else 0) * 28 + b) * 28 + c] += 1
    scorer = toxicity.Scorer(toxicity.Model(counts, {"idiot": 3.0, "moron": 3.0}, np.zeros(4)))
    found = list(scorer.hits([f"that is {disguise} to say", None, "that is a good word to say, a b c and/or 1 2 3"]))
    assert found[0] and not found[1] and not found[2]


def test_toxicity_rules_out_only_words_without_weight():
    """What the first letters of all tokens at once rule out has no weight one by one."""
    scorer = toxicity.Scorer(toxicity.Model(np.ones(28**3, np.int64), {"idiot": 3.0, "abcdefghijk": 1.0, "moro~": 2.0, "stup~": 1.0, "été": 1.0}, np.zeros(4)))
    rng = random.Random(11)
    tokens = ["idiot", "iddiiot,", "(idiots)", "moron", "mooron.", "moro", "abcdefghijk", "abcdefghzzz", "stuppid", "été", "id1ot", "a", "!", "idiot!"]
    tokens += ["".join(rng.choice("abidiomrstup.,!1é") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    worth = scorer._worth(toxicity.pa.array(tokens))
    assert worth[:2].all() and not worth[11]
    assert not any(scorer._of(toxicity.token_words(t, scorer.lm)) for t, w in zip(tokens, worth, strict=True) if not w)


def test_licenses(spark, docs, none):
    rows = [(1, "This small thing is licensed under the Apache License, Version 2.0."), (2, "Under the MIT License. MIT license"), (3, "Licensed under CC BY-NC 4.0."), (4, None), (5, "licensed under the apache style license")]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].labels) == (1, 7, ["apache", "apache-2.0"])
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 2, 4, ["mit"])
    assert got[3].labels == ["cc-by", "cc-by-nc-4.0"] and got[4].first_word is None and got[5].labels == [] and got[5].score == 0
    assert licenses.scan(docs).count() == 7 and licenses.scan(none).count() == 0


def test_license_template_markup():
    a = licenses.compile_template("use <<opt>>and copy<</opt>> by <<var:2>> is|are granted")
    words = lambda t: t.split()
    for text, ok in (("use by is granted", 1), ("use and copy by any one are granted", 1), ("use and by is granted", 0), ("use by a b c is granted", 0), ("use by x is", 0)):
        assert (licenses.accepts(a, words(text), 0) is not None) == bool(ok)


def test_pipeline_near_duplicates_reach_0_8(spark):
    import corpus_pipeline
    from prosegauge.llm.near_copies import shingles, similarity

    rng = np.random.default_rng(5)
    rows, close = [], 0
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        other = list(words)
        for at in rng.choice(290, 4 if i % 2 else 14, replace=False):
            other[at] = "edited"
        a, b = " ".join(words), " ".join(other)
        rows += [(2 * i, a), (2 * i + 1, b)]
        close += similarity(shingles(a), shingles(b)) >= 0.8
    assert 20 <= close <= 40
    docs = spark.createDataFrame([*rows, (500, rows[0][1]), (501, ""), (502, None), (503, "two words")], "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    for (x, a), (y, b) in zip(rows[::2], rows[1::2], strict=True):
        assert x in left and (y in left) == (similarity(shingles(a), shingles(b)) < 0.8)
    assert 500 not in left and {501, 503} <= left and 502 not in left


def plain_text(markup, keep, rng):
    """A text that a template stands for: with or without its optional parts, some words for its replaceable ones."""
    out, depth, skip = [], 0, 0
    for m in licenses._MARK.finditer(markup):
        if m[1] == "opt":
            depth += 1
            skip = skip or (0 if keep else depth)
        elif m[1] == "/opt":
            skip = 0 if skip == depth else skip
            depth -= 1
        elif not skip:
            out.append(" ".join(["holder"] * rng.randrange(1, int(m[1][4:]) + 1)) if m[1] else rng.choice(m[2].split("|")).title())
    return rng.choice([" ", "\n", ", "]).join(out)


def test_licenses_against_regexes_and_whole_texts(spark):
    rng, texts = random.Random(13), []
    for label, templates in licenses.TEMPLATES.items():
        for t in templates:
            for keep in (True, False):
                own = f"Copyright 2020 A. Holder. {plain_text(t, keep, rng)} end"
                words = own.split()
                at = words[rng.randrange(5, len(words) - 1)]
                texts += [(label, own), (None, own.replace(at, "altered", 1))]
    rows = [(i, x) for i, (_, x) in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "cc by cc by. CC-BY"), (9003, "The MIT License the mit license")]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    for i, (label, _) in enumerate(texts):
        assert label is None or label in got[i].labels
    compiled = [(label, *licenses.regex(t)) for label, ts in licenses.TEMPLATES.items() for t in ts]
    for i, x in rows:
        words = decontaminate.WORD.findall(decontaminate.fold(x or ""))
        joined = f" {' '.join(words)} "
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        hits = [(label, n) for label, rx, n in compiled if re.search(rx, joined)]
        best = max((n for _, n in hits), default=0)
        want = (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, sorted({x for _, x in places}), sorted({x for _, x in places} | {x for x, _ in hits}))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, list(r.base_labels), list(r.labels)) == want
        assert r.score == (1 - 1 / (1 + best) if best else 0.5 if places else 0.0)
