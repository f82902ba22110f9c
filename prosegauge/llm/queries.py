"""The registered queries of this subpackage, and the SQL that states them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, clustering, decontaminate, huffman, interpolation, langid, licenses, line_dedup, prefix_trie, simhash, token_counts, toxicity
from .common import fresh_path, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that an earlier one holds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup(docs, least=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL["op1_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(s.owner <> k.doc_id, false) AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op2_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, distance=4)
    return found.select("doc_id", simhash.hex16(found.fp).alias("fingerprint"), "component_id")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled ones that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license templates in every document."""
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined).drop("matches")


def _licenses_sql() -> str:
    """Words joined by single blanks; phrases by the places of their words, templates as regexes over the joined words."""
    phrases = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"('{label}', '{rx}', {n})" for label, ts in licenses.TEMPLATES.items() for rx, n in map(licenses.regex, ts))
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j FROM d),
phrases(phrase, n, label) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, phrase, n, label, unnest(range(1, len(w) + 1)) AS i FROM t, phrases WHERE contains(j, phrase))
  WHERE array_to_string(w[i : i + n - 1], ' ') = phrase),
templates(label, rx, n) AS (VALUES {templates}),
matched AS (SELECT doc_id, label, n FROM t, templates WHERE regexp_matches(j, rx)),
every AS (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM matched)
SELECT d.doc_id, len(w) AS n_words, coalesce(p.n_base, 0) AS n_base, p.first_word, p.last_word, coalesce(p.base_labels, '') AS base_labels, coalesce(b.labels, '') AS labels,
  CASE WHEN m.most IS NOT NULL THEN 1 - 1 / (1 + m.most) WHEN p.n_base > 0 THEN 0.5 ELSE 0.0 END AS score
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id) p USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id) b USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(max(n) AS DOUBLE) AS most FROM matched GROUP BY doc_id) m USING (doc_id)
"""


ORACLE_SQL["op4_licenses"] = _licenses_sql()


@query
def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    rows = ann.usable(read(spark, sf_dir, "embeddings"))
    return ann.search(ann.build(rows), rows.where("vec_id % 50 = 0"), k=5)


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie inside windows of benchmark items."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.overlaps(docs, read(spark, sf_dir, "benchmark"), width=10)
    items = F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "hits.n_words", "hits.n_hit", "hits.n_items", items, (F.col("hits.n_hit") > 0).alias("contaminated"))


ORACLE_SQL["op6_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
starts AS (
  SELECT p.doc_id, p.i, s.n, array_to_string(p.w[p.i : p.i + s.n - 1], ' ') AS win
  FROM spots p, (SELECT DISTINCT n FROM wins) s WHERE p.i + s.n - 1 <= len(p.w)),
found AS (SELECT s.doc_id, s.i, s.n, w.item FROM starts s JOIN wins w ON s.win = w.win AND s.n = w.n),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    back = bpe.encode(read(spark, sf_dir, "documents"), path, pieces=bpe.vocabulary(spark, path))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, size and checksum of every document's ids, from the files written."""
    place = fresh_path(spark, "huffman")
    tokens = huffman.token_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    huffman.write(tokens, place)

    back = huffman.read(spark, place, packed_ids=True)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.learn_and_predict(docs).select("doc_id", "held_out", "lang_pred", "score")


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five rounds from forty starting vectors."""
    return clustering.digest(clustering.cluster(read(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, salt="2"))


def _centroids_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The rounds one after the other, over distinct vectors: assigned by the smallest (distance, number), means floored exactly."""
    far = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"m{r} AS MATERIALIZED (SELECT v.q, v.n, min(struct_pack(d := CAST({far} AS BIGINT), c := c.c)) AS best FROM v, c{r} c GROUP BY v.q, v.n)")
        if r < rounds:
            mean = "CAST((s - ((s % w) + w) % w) // w AS BIGINT)"
            sums = f"SELECT best.c AS c, i, sum(q[i] * n) AS s, sum(n) AS w FROM m{r}, (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY ALL"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(z.q, o.q) AS q FROM c{r} o LEFT JOIN (SELECT c, list({mean} ORDER BY i) AS q FROM ({sums}) GROUP BY c) z ON z.c = o.c)")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
v AS MATERIALIZED (SELECT q, count(*) AS n FROM kept GROUP BY q),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM kept ORDER BY h LIMIT {k})),
{", ".join(steps)},
own AS (SELECT best.c AS c, CAST(sum(best.d * n) AS BIGINT) AS cluster_inertia FROM m{rounds} GROUP BY ALL)
SELECT kept.vec_id, m.best.c AS cluster, m.best.d AS distance, own.cluster_inertia, (SELECT CAST(sum(best.d * n) AS BIGINT) FROM m{rounds}) AS inertia,
  sha256(array_to_string(list_transform(c.q, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM kept JOIN m{rounds} m USING (q) JOIN own ON own.c = m.best.c JOIN c{rounds} c ON c.c = m.best.c
"""


ORACLE_SQL["op11_centroids"] = _centroids_sql()


@query
def op12_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a bigram model of those that are not held out."""
    return interpolation.score(read(spark, sf_dir, "documents"), order=2, folds=10)


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations, each of which opens like the first of its hundred."""
    turns, convs = prefix_trie.borrowed(prefix_trie.ordered(read(spark, sf_dir, "conversations")))
    return prefix_trie.trie(turns, convs)


#: The polynomial's division, bit by bit, over the digits of a number.
_CRC32 = "xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295)"
#: Paths as texts; a subtree is what members pass through from a node on.
ORACLE_SQL["op13_prefix_trie"] = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
    length(coalesce(role, '')) || ':' || coalesce(role, '') || length(coalesce(text, '')) || ':' || coalesce(text, '') AS said, length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, %s %% 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, t.pos, said, n FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id %% 100 AND t.pos < c.h
  UNION ALL SELECT c.conv_id, t.pos, said, n FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
path AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(said, '') OVER w AS key, n FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
last AS (SELECT conv_id, max(depth) AS len FROM path GROUP BY conv_id),
node AS MATERIALIZED (
  SELECT depth, key, min(conv_id) AS conv_id, any_value(n) AS n, count(*) AS n_convs, string_agg(CASE WHEN len = depth THEN conv_id END, ',' ORDER BY conv_id) AS ends, max(len) AS deepest
  FROM path JOIN last USING (conv_id) GROUP BY depth, key),
parts AS (SELECT DISTINCT a.depth, a.key, b.key AS up FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.depth = a.depth - 1),
below AS (SELECT DISTINCT a.depth, a.key, b.depth AS d2, b.key AS k2 FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT b.depth, b.key, CAST(count(*) FILTER (WHERE d2 = b.depth + 1) AS BIGINT) AS n_children, CAST(count(*) FILTER (WHERE x.deepest = x.depth) AS BIGINT) AS n_leaves, CAST(sum((x.n_convs - 1) * x.n) AS BIGINT) AS saved_tokens
  FROM below b JOIN node x ON x.depth = b.d2 AND x.key = b.k2 GROUP BY b.depth, b.key)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, node.n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN sums USING (depth, key) LEFT JOIN parts USING (depth, key) LEFT JOIN node u ON u.depth = node.depth - 1 AND u.key = parts.up
""" % _CRC32
