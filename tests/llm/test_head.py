"""The driver puts the sent part of the word table in order by parts, so that it holds the places of few ids at once."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from xxhash import xxh64_intdigest

from prosegauge.llm import bpe


def test_head_is_ordered_by_parts(spark, monkeypatch):
    rows = [(f"w{i}", i % 7 + 1, np.arange(i % 5, dtype="<u2") + i) for i in range(1000)]
    table = spark.createDataFrame([(w, n, bytearray(ids.astype("<u2").tobytes())) for w, n, ids in rows], "word string, n long, ids binary")
    asked, spread = [], bpe.spread
    monkeypatch.setattr(bpe, "ORDERED", 64, raising=False)
    monkeypatch.setattr(bpe, "spread", lambda starts, flat, at: asked.append(len(at)) or spread(starts, flat, at))
    head = bpe._head(table, "<u2", 1 << 20)
    assert max(asked) <= 64 and head.whole
    of = {r.h: r.word for r in table.select("word", F.xxhash64("word").alias("h")).collect()}
    ids = {w: x.astype("<u2").tolist() for w, _, x in rows}
    assert head.hashes.tolist() == sorted(of)
    assert [head.ids[a:b].tolist() for a, b in zip(head.starts, head.starts[1:])] == [ids[of[h]] for h in head.hashes.tolist()]
    assert len(bpe._head(table, "<u2", 0).hashes) == 0


def test_a_worker_encodes_few_stretches_at_once(monkeypatch):
    """Memory beside the head follows the stretches that are put in order at once; the ids don't depend on them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, rng = bpe.word_tokenizer(path), random.Random(5)
    words = sorted({"".join(rng.choices("abcdeou", k=rng.randint(2, 9))) for _ in range(2000)}, key=lambda w: np.uint64(xxh64_intdigest(w, 42)).astype(np.int64))
    starts, ids = tok.encode_words(pa.array(words))
    head = bpe.Head(np.array([xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64), starts, ids.astype("<u2"), True)
    texts = [" ".join(rng.choices(words, k=4000)) for _ in range(150)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})

    def run() -> tuple[int, dict]:
        tracemalloc.start()
        out = {}
        for doc_ids, own, k in bpe._encoded(path, head, iter([batch])):
            out |= {d: hash(x.tobytes()) for d, x in zip(doc_ids.to_pylist(), np.split(own, np.cumsum(k)[:-1]))}
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak, out

    few, found = run()
    monkeypatch.setattr(bpe, "STRETCHES", 1_500_000)
    monkeypatch.setattr(bpe, "AT_ONCE", 500_000)
    many, same = run()
    assert found == same and len(found) == len(texts)
    assert 2 * few < many
    assert np.array_equal(next(bpe._encoded(path, head, iter([batch])))[1][:50], tok.tok.encode(texts[0], add_special_tokens=False).ids[:50])
