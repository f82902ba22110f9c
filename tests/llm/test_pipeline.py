"""The pipeline's stages on small tables: nulls, empty texts, repeated rows, clashing columns, empty tables."""

import numpy as np
import pytest

import corpus_pipeline

#: Names that the operators use themselves.
CLASHING = ["score", "lang_pred", "held_out", "n_lines", "n_dropped", "drops", "kept", "hits", "ids", "decoded", "component_id", "fp", "key", "shard", "node", "band", "found"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
WORDS = {"en": "the of and to in that is was for with", "fr": "le de et la les des en un est pour"}


def text_of(i: int, lang: str) -> str:
    own = WORDS[lang].split()
    return " ".join(f"{own[k % 10]} {own[(k * i) % 10]} {lang}{'abcdefghij'[k % 10]}{'klmnopqrst'[i % 10]}{'uvwxyzabcd'[i // 10]}" for k in range(30))


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    items = [(1, "a test question of just ten words that nobody else asks"), (2, None), (None, "x")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def rows():
    out = [(i, text_of(i, lang), lang) for i in range(80) for lang in [("en", "fr")[i % 2]]]
    out += [(100, None, "en"), (101, "", "fr"), (102, "1 2 3", None), (103, out[4][1], "en"), (103, out[4][1], "en"), (None, out[6][1] + " the end of it", "en"), (104, out[8][1] + " A test question of just ten words that nobody else asks!", None)]
    out += [(105, f"a line that is shared by two of them\n{text_of(71, 'en')} of 105", "en"), (106, f"A line that is shared by two of them \n{text_of(77, 'fr')} de 106", "fr"), (107, "the of and to in that", "en"), (107, "the of and to is for", "en")]
    return [(*r, "web", len(r[1] or ""), *CLASHING) for r in out]


def test_stages_one_after_the_other(spark, place, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, place))
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")], name
        assert all(tuple(r[c] for c in CLASHING) == tuple(CLASHING) and r.source == "web" and r.n_chars == len(r.text) for r in docs.collect())
        seen[name] = sorted((r.doc_id for r in docs.collect()), key=str)
    after = list(seen.values())
    assert not {100, 101, 102} & set(after[0]) and len(after[0]) == len(rows) - 3
    assert after[1] == after[0]
    assert after[1].count(103) == 2 and after[2].count(103) == 1  # line dedup left it no word, and no other text is without
    assert after[2].count(107) == 1 and None in after[2] and not {*range(80), 104, 105} - set(after[2]) and 106 not in after[2]  # 106 is 77 and two words
    assert set(after[2]) - set(after[3]) == {104}
    last = corpus_pipeline.tokens(spark, docs, place)
    assert last.columns == ["doc_id", "ids", "decoded"] and last.count() == len(after[3])


def test_lines_drop_from_the_later_document(spark, place, rows):
    got = {r.doc_id: r for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows, SCHEMA), place).collect()}
    assert "shared" in got[105].text and "shared" not in got[106].text and got[106].n_chars == len(got[106].text) and got[100].text is None


def test_every_stage_takes_an_empty_table(spark, place):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, place).count() == 0, name


def test_run_on_the_smallest_tables(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0.8 * n <= len(got) <= n and len({r.doc_id for r in got}) == len(got)


def near_copy_components(texts, least=0.8):
    """Brute force: every two texts' five-word shingles."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    ids: dict[tuple, int] = {}
    flat = [[ids.setdefault(g, len(ids)) for g in s] for s in sets]
    m = np.zeros((len(texts), len(ids)), np.float32)
    for i, f in enumerate(flat):
        m[i, f] = 1
    both, n = m @ m.T, m.sum(1)
    near = both >= least * (n[:, None] + n[None, :] - both) - 1e-3
    root = np.arange(len(texts))
    while True:
        new = np.where(near, root[None, :], len(texts)).min(1)
        if (new == root).all():
            return root.tolist()
        root = new


@pytest.mark.parametrize("size", [150, 1500])
def test_near_copies_of_one_text_lose_no_link(spark, size, monkeypatch):
    from prosegauge.llm import near_copies

    monkeypatch.setattr(near_copies, "APART", 16)  # several blocks
    monkeypatch.setattr(near_copies, "ALL", 64)
    rng = np.random.default_rng(size)
    base, texts = [f"w{x}" for x in rng.integers(0, 5000, 300)], []
    for i in range(size):
        words = list(base)
        for at in rng.choice(300, 4, replace=False):
            words[at] = f"e{i}x{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(map(tuple, near_copies.near_copies(docs).collect()))
    want = near_copy_components(texts)
    assert [got[i] for i in range(size)] == want and len(set(want)) < size / 3


def test_a_group_that_hardly_links_is_held_in_full(spark, monkeypatch):
    from prosegauge.llm import near_copies

    monkeypatch.setattr(near_copies, "APART", 8)
    monkeypatch.setattr(near_copies, "ALL", 16)
    rng = np.random.default_rng(8)
    base, texts = [f"w{x}" for x in rng.integers(0, 5000, 200)], []
    for i in range(90):
        words = list(base)
        for at in rng.choice(40, 8, replace=False) * 5:  # mostly just below the similarity
            words[at] = f"e{i % 30}x{at}"
        texts.append(" ".join(words))
    got = dict(map(tuple, near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    assert [got[i] for i in range(90)] == near_copy_components(texts)
