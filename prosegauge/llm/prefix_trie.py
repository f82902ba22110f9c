"""The trie of conversations that share their first turns, by smallest-member ownership.

A node is a distinct sequence of first turns; its smallest member owns it.
Whoever owns a node owns what it passes through below, so a conversation owns a
suffix of its path, and what a subtree's nodes sum up to can be summed over
members: the tokens that members pass through, minus those of the nodes they own.
So one group-by over prefixes gives each node's sums, and no subtree is walked.

A prefix's key is the exclusive or of a hash of each turn and its place, so keys
and sums along a path are running totals. They are taken in stretches: rows are
dealt by ranges of (conversation, turn), each task runs over its own stretch of
a conversation, and what lies before it is added, so that one very long
conversation is many tasks'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup, settle, union_all

#: Consecutive conv_ids (2 to this power) whose ends are joined in one row.
LOT_BITS = 13
_NOTHING = hashlib.sha256(b"").hexdigest()


def _before(rows: DataFrame, by: str, **totals: Column) -> DataFrame:
    """(conv_id, part) with what the totals come to in the earlier parts of a conversation, and (all_*) in the whole of it."""
    per = rows.groupBy("conv_id", "part").agg(*[x.alias(n) for n, x in totals.items()])
    w = Window.partitionBy("conv_id").orderBy("part")
    fold = {n: F.bit_xor if by == "xor" and n.startswith("k") else F.sum for n in totals}
    own = [F.coalesce(fold[n](n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias(f"past_{n}") for n in totals]
    return per.select("conv_id", "part", *own, *[fold[n](n).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"all_{n}") for n in totals])


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, pos, content, n_chars) of conversations(conv_id, turn, role, text), pos from 0 in the order of turn, null first.

    Turns with the same number are ordered by content, the SHA-256 of role and
    text. Null roles and texts are empty ones; rows with a null conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", content.alias("content"), F.char_length(text).cast("long").alias("n_chars"))
    rows = settle(rows.repartitionByRange("conv_id", "turn", "content").withColumn("part", F.spark_partition_id()), "turns")
    local = rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "content")) - 1)
    past = _before(rows, "sum", n=F.count("*"))
    return local.join(past, ["conv_id", "part"]).select("conv_id", "part", (F.col("pos") + F.col("past_n")).alias("pos"), "content", "n_chars")


def borrowed(turns: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that open like an earlier one: (turns, conversations) anew.

    Conversation c gets the first h turns of conversation c - c % every, where it
    is there, in place of its own first h; h is crc32 of c in decimals, modulo most + 1.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % (most + 1)).alias("h")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", h, (c - c % every).alias("base"))
    firsts = turns.where(F.col("pos") < most).select(c.alias("base"), "pos", "content", "n_chars")
    heads = settle(convs.join(firsts, "base").where("pos < h").select("conv_id", F.lit(-1).alias("part"), "pos", "content", "n_chars"), "heads")
    sizes = convs.join(heads.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "left").select("conv_id", "h", F.coalesce("n", F.lit(0)).alias("n"))
    own = lookup(turns, "conv_id", sizes, "inner", by=["pos"]).where("pos >= h").select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "content", "n_chars")
    return heads.unionByName(own), convs.select("conv_id")


def _occurrences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a conversation and node on its path, root included: node, parent, conv_id, length, past (characters before the last turn) and total."""
    place = F.col("pos").cast("long")
    rows = turns.withColumns({"k1": F.xxhash64(place, "content"), "k2": F.xxhash64("content", F.lit("second"), place)})
    w = Window.partitionBy("conv_id", "part").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = {"u1": F.bit_xor("k1").over(upto), "u2": F.bit_xor("k2").over(upto), "chars": F.sum("n_chars").over(upto)}
    past = settle(_before(rows, "xor", k1=F.bit_xor("k1"), k2=F.bit_xor("k2"), chars=F.sum("n_chars"), n=F.count("*")), "stretches")
    both = rows.withColumns(run).join(past, ["conv_id", "part"])
    key = [F.col(f"u{i}").bitwiseXOR(F.col(f"past_k{i}")) for i in (1, 2)]
    depth = place + 1
    node = F.struct(depth.alias("depth"), key[0].alias("k1"), key[1].alias("k2"))
    parent = F.struct(place.alias("depth"), key[0].bitwiseXOR(F.col("k1")).alias("k1"), key[1].bitwiseXOR(F.col("k2")).alias("k2"))
    below = both.select(node.alias("node"), parent.alias("parent"), "conv_id", F.col("all_n").alias("length"), (F.col("past_chars") + F.col("chars") - F.col("n_chars")).alias("past"), F.col("all_chars").alias("total"))
    zero = F.lit(0).cast("long")
    whole = past.select("conv_id", "all_n", "all_chars").distinct()
    root = convs.distinct().join(whole, "conv_id", "left").select(
        F.struct(zero.alias("depth"), zero.alias("k1"), zero.alias("k2")).alias("node"), F.lit(None).cast("struct<depth:long,k1:long,k2:long>").alias("parent"),
        "conv_id", F.coalesce("all_n", zero).alias("length"), zero.alias("past"), F.coalesce("all_chars", zero).alias("total"),
    )
    return union_all([below, root])


def _ends(occurrences: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end.

    Ids are joined in lots of consecutive ones first; a node's lots then run
    through one digest in order, a batch of them in memory at a time.
    """
    lots = occurrences.where("node.depth = length").groupBy("node", F.expr(f"shiftright(conv_id, {LOT_BITS})").alias("lot"))
    ids = lots.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    schema = "depth long, k1 long, k2 long, ends_sha256 string"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for b in batches:
            done = []
            keys, texts = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True), b.column(3).to_pylist()
            for key, text in zip(keys, texts, strict=True):
                if key != last:
                    if last is not None:
                        done.append((*last, sha.hexdigest()))
                    last, sha = key, hashlib.sha256(text.encode())
                else:
                    sha.update(f",{text}".encode())
            yield _rows(done)
        yield _rows([(*last, sha.hexdigest())] if last is not None else [])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], ["depth", "k1", "k2", "ends_sha256"])

    flat = ids.select("node.*", "lot", "ids").repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "lot")
    return flat.select("depth", "k1", "k2", "ids").mapInArrow(of, schema).select(F.struct("depth", "k1", "k2").alias("node"), "ends_sha256")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node of turns(conv_id, part, pos, content, n_chars), pos dense from 0, and convs(conv_id), those without turns included.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, each node's members but one times
    the characters of its last turn) and ends_sha256. No conversations give no nodes.
    """
    seen = settle(_occurrences(turns, convs), "occurrences")
    owners = seen.groupBy("node").agg(F.min("conv_id").alias("owner"), F.max("length").alias("longest"), F.min("past").alias("past"))
    # What a conversation owns begins at its first owned node; a node that no member goes beyond is its owner's last.
    owned = owners.groupBy(F.col("owner").alias("conv_id")).agg(F.min("node.depth").alias("first"), F.min_by("past", "node.depth").alias("shared"), F.max(F.col("longest") == F.col("node.depth")).cast("int").alias("leaf"))
    rows = lookup(seen, "conv_id", owned, by=["node"])
    depth = F.col("node.depth")
    child = (depth + 1).between(F.col("first"), F.col("length"))
    not_owned = F.greatest(F.coalesce("shared", "total") - F.col("past"), F.lit(0).cast("long"))
    nodes = rows.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.min_by("first", "conv_id").alias("first"), F.count("*").alias("n_convs"),
        F.sum(F.coalesce(child, F.lit(False)).cast("long")).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"), F.sum(not_owned).alias("saved_tokens"),
    )
    nodes = settle(nodes.join(_ends(seen), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING))), "nodes")
    # A parent is owned by the same conversation, but where that one's own part begins.
    top = nodes.where("node.depth = first AND node.depth > 0")
    above = lookup(top.select("node", "parent"), "parent", nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "inner", by=["node"])
    out = nodes.join(above.select("node", "parent_conv_id"), "node", "left")
    parent = F.when(F.col("node.depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent_conv_id"))
    return out.select("conv_id", F.col("node.depth").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
