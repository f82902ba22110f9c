"""Centroids, the trie of conversations and the language model against brute force; nulls, ties, repeats, empty tables, clashing columns, hot keys."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from prosegauge.llm import clustering, interpolation, prefix_trie


def lloyd(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        cs = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(cs)]
    return sorted((-1 if i is None else i, near(v)[1], near(v)[0]) for i, v in kept), cs


@pytest.mark.parametrize("big", [1.0, 300.0, 40000.0])
def test_clusters(spark, big):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 0, 1]) * big * rng.random() for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [0.25 * big] * 4) for i in range(90)]  # copies
    rows += [(7, [0.5] * 4), (7, [0.5] * 4), (None, [0.1] * 4), (300, None), (301, []), (302, [1.0] * 5), (303, [1.0, None, 1.0, 1.0]), (304, [1.0, float("nan"), 1.0, 1.0]), (305, [float("inf")] * 4)]
    df = spark.createDataFrame([(*r, "x", 5, 6) for r in rows], "vec_id long, embedding array<double>, v string, cluster int, n int")
    found = clustering.cluster(df, k=9, rounds=3, dims=4, scale=256)
    want, cs = lloyd(rows, 9, 3, 4, 256)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in found.rows.collect()) == want
    assert [list(c) for c in found.centroids] == cs and sum(found.inertia) == sum(w[2] for w in want)
    got = clustering.digest(found).where("vec_id = 100").first()
    assert got.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[got.cluster])).encode()).hexdigest() and got.inertia == sum(found.inertia) and got.cluster_inertia == found.inertia[got.cluster]


def test_clusters_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    none = clustering.digest(clustering.cluster(spark.createDataFrame([], schema), dims=2))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = clustering.cluster(spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, -1.0])], schema), dims=2)
    assert len(few.centroids) == 2 and few.inertia == [0, 0]
    huge = clustering.cluster(spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0])], schema), dims=2)
    assert sorted(map(tuple, huge.centroids)) == [(0, 0), (clustering.LIMIT, -clustering.LIMIT)]


def test_weighted_sums_are_exact():
    x, n = np.array([[1 << 27, -5], [3, 4]]), np.array([1 << 40, 7])
    assert clustering.weighted_sums(x, n, np.array([1, 1]), 2).tolist() == [[0, 0, 0], [(1 << 67) + 21, -5 * (1 << 40) + 28, (1 << 40) + 7]]


def brute_trie(paths):
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k)
        leaves = sum(all(len(m) <= len(k) for m in below if m[: len(k)] == k) for k in below)
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(key))
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), sum(len(k) == len(key) + 1 for k in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    turns = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + t[h:]
    return out


def test_trie(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice("ua"), rng.choice(["hello", "b", "", "long text " * 40])) for c in range(95, 430) if c % 7 for t in range(rng.randrange(1, 8))]
    rows += [(101, None, None, None), (101, None, "u", "tie"), (101, 3, "u", "é" * 9), (101, 3, "u", "é" * 9), (None, 1, "u", "lost"), (10**12, 1, "u", "hello")]
    rows += [(c, 0, "u", "same first turn") for c in range(500, 560)] + [(c, 0, "u", "without a base") for c in range(601, 640)]
    df = spark.createDataFrame([(*r, "x", 1, "k", 2) for r in rows], "conv_id long, turn long, role string, text string, part string, pos int, node string, depth int")
    turns, convs = prefix_trie.borrowed(prefix_trie.ordered(df))
    paths = rebuilt(rows)
    assert any(not p for p in paths.values())
    got = prefix_trie.trie(turns, convs)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(paths)


def test_trie_of_one_very_long_conversation_and_of_none(spark):
    rows = [(1, t, "u", f"turn {t % 5}") for t in range(3000)] + [(2, t, "u", f"turn {t % 5}") for t in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # else so few rows are one task's
    turns = prefix_trie.ordered(df)
    spark.conf.unset(key)
    assert turns.where("conv_id = 1").select("part").distinct().count() > 1  # a stretch a task
    got = {(r.conv_id, r.depth): (r.n_convs, r.saved_tokens, r.n_leaves) for r in prefix_trie.trie(turns, turns.select("conv_id").distinct()).collect()}
    assert len(got) == 3001 and got[1, 0] == (2, 2000 * 6, 1) and got[1, 1999] == (2, 12, 1) and got[1, 3000] == (1, 0, 1)
    assert prefix_trie.trie(*prefix_trie.borrowed(prefix_trie.ordered(df.limit(0)))).count() == 0


def brute_model(rows, order, folds):
    fold = {i: 1 if d is None else zlib.crc32(str(d).encode()) % folds for i, (d, _) in enumerate(rows)}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*(t or "").translate(lower).encode().split(), None] for i, (_, t) in enumerate(rows)}

    def table(own):
        grams = Counter()
        for i in own:
            w = ["<s>"] * (order - 1) + tokens[i]
            for at in range(order - 1, len(w)):
                for k in range(1, order + 1):
                    grams[tuple(w[at - k + 1 : at + 1])] += 1
        context = Counter()
        for g, n in grams.items():
            context[g[:-1]] += n
        return grams, context, sum(len(tokens[i]) for i in own), len({g for g in grams if len(g) == 1})

    def levels(i, model):
        grams, context, _, _ = model
        w = ["<s>"] * (order - 1) + tokens[i]
        for at in range(order - 1, len(w)):
            yield [(grams[tuple(w[at - k + 1 : at + 1])], context[tuple(w[at - k + 1 : at])]) for k in range(1, order + 1)]

    def mix(event, weights, v):
        p, ws = [1 / (v + 1)], []
        for k, (c, x) in enumerate(event):
            w = weights[k, x.bit_length()] if x else 0.0
            p.append((w * c / x if x else 0.0) + (1 - w) * p[-1])
            ws.append(w)
        return p, ws

    every, counted = table([i for i in fold if fold[i]]), table([i for i in fold if fold[i] not in (0, folds - 1)])
    weights, last = defaultdict(lambda: 0.5), -math.inf
    deleted = [e for i in fold if fold[i] == folds - 1 for e in levels(i, counted)]
    for _ in range(interpolation.ROUNDS):
        made, reached, total = Counter(), Counter(), 0.0
        for e in deleted:
            p, ws = mix(e, weights, counted[3])
            total, reach = total + math.log10(p[-1]), 1.0
            for k in range(order - 1, -1, -1):
                below = (1 - ws[k]) * p[k] / p[k + 1]
                if e[k][1]:
                    made[k, e[k][1].bit_length()] += reach * (1 - below)
                    reached[k, e[k][1].bit_length()] += reach
                reach *= below
        weights.update({b: made[b] / reached[b] for b in reached})
        if total / len(deleted) - last < interpolation.GAIN:
            break
        last = total / len(deleted)
    out = []
    for i, (d, _) in enumerate(rows):
        grams, _, n, v = every
        c = [grams[(w,)] for w in tokens[i]]
        out.append((d, fold[i] == 0, len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c), sum(math.log10(mix(e, weights, v)[0][-1]) for e in levels(i, every))))
    return out


def _close(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 5))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


TEXT = "the cat sat on the mat the dog sat on the log a cat and a dog ran to the mat".split()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_interpolation(spark, monkeypatch, order):
    for name, value in (("LOT", 64), ("SHARD", 100), ("SEGMENT", 40)):  # many lots and shards, and texts in pieces
        monkeypatch.setattr(interpolation, name, value)
    rng = random.Random(6)
    rows = [(i, " ".join(TEXT[(j := rng.randrange(20)) : j + rng.randrange(1, 9)] * rng.randrange(1, 9)) + rng.choice(["", " \t", "\nThe ÉTÉ", "\x0bx" + "y" * 99])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "a null id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(*r, 1, "x", 3) for r in rows], "doc_id long, text string, part int, lot string, n_tokens int")
    _close(interpolation.score(df, order, 10).collect(), brute_model(rows, order, 10))


def test_interpolation_of_little_and_none(spark):
    schema = "doc_id long, text string"
    assert interpolation.score(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = interpolation.score(spark.createDataFrame([(held, "a b"), (held, "a b")], schema)).collect()
    assert [tuple(r) for r in only] == [(held, True, 3, 0, 0, 0.0, 0.0)] * 2
    one = interpolation.score(spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 4), "a a")], schema)).first()
    assert one.n_known == one.train_tokens == 3 and one.score > one.base_score


def test_long_texts_are_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(interpolation, "SEGMENT", 7)
    text = "aa bb " * 5 + "c" * 40 + " dd"
    got = list(interpolation.pieces(text, 3))
    assert [w for lead, words, _ in got for w in words[lead:]] == text.encode().split() and [x[2] for x in got] == [False] * (len(got) - 1) + [True]
    assert all(words[:lead] == before[-lead:] for (_, before, _), (lead, words, _) in zip(got, got[1:]) if lead)
