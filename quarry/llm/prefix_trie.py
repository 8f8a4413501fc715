"""Conversations as a trie of shared prefixes, rolled up by depth bands.

Each conversation is rebuilt: the first turns of its family's first conversation (FAMILY ids form a
family), then its own turns after as many. A node is a distinct sequence of rebuilt turns from the
start. It is named by two hashes of 64 bits, each the exclusive or over its turns of a hash of the
turn's place and content, so that a node's parent is its own name without its last turn, and names
along a conversation are a running sum.

Turns are dealt by ranges of (conversation, turn), so that a conversation of any length is spread
over many tasks; places and names run within a range, and start from what the ranges before it add
up to, a row per range and conversation. Nodes are counted before they are shuffled.

Sums over subtrees go up by bands of BAND depths: each node adds its own values to its ancestors
within its band, which are found by joins that double their reach; the tops of the bands form a trie
of a BAND-th of the height, whose sums are found the same way; and each top's whole sum is then added
to its ancestors in the band above. So rounds grow as the logarithm of the height, and a node is never
exploded to more than BAND rows. A parent of many children is joined by broadcast (see join_unique).

Null roles and texts are empty. Rows without a conversation id are left out. Turns of equal number
come in the order of md5(md5(role) || md5(text)); repeated rows are turns of their own. Conversations
that rebuild to no turn belong to the root. An empty table has no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import releasing, stash
from .passages import HOT_SHARE

FAMILY = 20
HEADS = 4
BAND = 8
#: Ids of a node's ends travel in pieces of about so many characters.
PIECE_CHARS = 1 << 16
VALUES = ("n_leaves", "saved_tokens")


def _words(text: Column) -> Column:
    """How many runs of characters that are no spaces."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))).cast("long")


def _names(place: Column, content: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), place.cast("long"), content) for seed in (1, 2)]


def join_unique(rows: DataFrame, key: str, other: DataFrame, how: str = "inner") -> DataFrame:
    """rows.join(other, key) of two stashed tables, where a key of other is one row and in rows may be hot.

    Hot keys are 1 / HOT_SHARE at most; their rows of other go to all tasks, so none gets a hot key's rows.
    """
    n = rows.count()
    hot = stash(rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(1000, HOT_SHARE * n)).select(key))
    if hot.isEmpty():
        return rows.join(other, key, how)
    few = stash(other.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(F.broadcast(hot), key, "left_anti").join(other, key, how).unionByName(rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how))


def rebuilt(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """(nodes' rows, ends): rows (conv, depth, a, b, pa, pb, words) for each rebuilt turn; ends (conv, a, b) for each conversation."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    content = F.unhex(F.md5(F.concat(F.md5(of(role).cast("binary")), F.md5(of(text).cast("binary"))).cast("binary")))
    turns = conversations.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), content.alias("content"), _words(of(text)).alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("content")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(turns.repartitionByRange(parts, F.col("conv"), *order).withColumn("part", F.spark_partition_id()))  # ranges are drawn anew each time they are run, so once

    local = dealt.withColumn("place", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)).cast("long"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stash(dealt.groupBy("conv", "part").agg(F.count("*").alias("n")))
    before = counts.select("conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = stash(local.join(before, ["conv", "part"]).select("conv", "part", (F.col("place") + F.col("before")).alias("place"), "content", "words"), done_with=(dealt,))

    first = placed.filter(F.col("place") < HEADS).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "content", "words"))).alias("head"))  # fewer than HEADS rows each
    convs = counts.groupBy("conv").agg(F.sum("n").alias("n"))
    own = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    convs = convs.select("conv", own.cast("int").alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    convs = convs.join(first, "base", "left").select("conv", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<place:bigint,content:binary,words:bigint>>")).alias("head"))
    named = F.transform("head", lambda x: F.struct(x["words"].alias("words"), *(v.alias(f"v{k}") for k, v in enumerate(_names(x["place"], x["content"])))))
    run = lambda k: F.aggregate("head", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x[f"v{k}"]))
    convs = stash(convs.select("conv", "h", named.alias("head")).select("*", F.size("head").cast("long").alias("k"), run(0).alias("ha"), run(1).alias("hb")))

    after = placed.join(convs.select("conv", "h", "k"), "conv").filter(F.col("place") > F.col("h")).select("conv", "part", (F.col("place") - F.col("h") + F.col("k")).alias("depth"), "content", "words")
    after = after.select("conv", "part", "depth", "words", *(v.alias(n) for n, v in zip("vw", _names(F.col("depth"), F.col("content")), strict=True)))
    sums = stash(after.groupBy("conv", "part").agg(F.bit_xor("v").alias("v"), F.bit_xor("w").alias("w")))
    none = F.lit(0).cast("long")
    start = sums.join(convs.select("conv", "ha", "hb"), "conv").select("conv", "part", *(F.col(h).bitwiseXOR(F.coalesce(F.bit_xor(v).over(earlier), none)).alias(s) for h, v, s in (("ha", "v", "sa"), ("hb", "w", "sb"))))
    along = Window.partitionBy("conv", "part").orderBy("depth")
    reached = after.join(start, ["conv", "part"]).select("conv", "depth", "words", "v", "w", *(F.col(s).bitwiseXOR(F.bit_xor(v).over(along)).alias(n) for s, v, n in (("sa", "v", "a"), ("sb", "w", "b"))))
    rows = reached.select("conv", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("v")).alias("pa"), F.col("b").bitwiseXOR(F.col("w")).alias("pb"), "words")

    upto = lambda n, k: F.aggregate(F.slice("head", F.lit(1), n), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x[f"v{k}"]))
    heads = convs.filter("k > 0").select("conv", "head", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("d"))
    heads = heads.select("conv", F.col("d").cast("long").alias("depth"), upto(F.col("d"), 0).alias("a"), upto(F.col("d"), 1).alias("b"), upto(F.col("d") - 1, 0).alias("pa"), upto(F.col("d") - 1, 1).alias("pb"), F.get("head", F.col("d") - 1)["words"].alias("words"))
    root = convs.select("conv", none.alias("depth"), none.alias("a"), none.alias("b"), none.alias("pa"), none.alias("pb"), none.alias("words"))

    total = sums.groupBy("conv").agg(F.bit_xor("v").alias("v"), F.bit_xor("w").alias("w"))
    ends = convs.join(total, "conv", "left").select("conv", F.col("ha").bitwiseXOR(F.coalesce("v", none)).alias("a"), F.col("hb").bitwiseXOR(F.coalesce("w", none)).alias("b"))
    return rows.unionByName(heads).unionByName(root), ends


def _pieces(batches):
    """Rows (a, b, first, ids) of sorted rows (a, b, conv): runs of ids of one node, joined by commas."""
    node, first, ids, size = None, 0, [], 0

    def piece():
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["a", "b", "first", "ids"])

    for batch in batches:
        for a, b, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if node != (a, b) or size > PIECE_CHARS:
                if ids:
                    yield piece()
                node, first, ids, size = (a, b), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield piece()


def _digests(batches):
    """Rows (a, b, ends_sha256) of sorted pieces; a node's pieces are hashed as they come."""
    node, digest, out = None, None, []

    def done(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])

    for batch in batches:
        for a, b, _, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if node == (a, b):
                digest.update(b",")
            else:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (a, b), hashlib.sha256()
            digest.update(ids.encode())
            if len(out) >= 4096:
                yield done(out)
                out = []
    if node:
        out.append((*node, digest.hexdigest()))
    if out:
        yield done(out)


def ends_digests(ends: DataFrame) -> DataFrame:
    """Rows (a, b, ends_sha256) from (conv, a, b): SHA-256 of the ids in ascending order, joined by commas.

    Ids are sorted over all tasks, so a node's may lie in many, and become pieces of bounded size; the
    digest of a node reads its pieces in turn, as SHA-256 has to, and holds one.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["a", "b", "conv"]
    pieces = ends.select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(releasing(_pieces), "a long, b long, first long, ids string")
    return pieces.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(releasing(_digests), "a long, b long, ends_sha256 string")


def _chains(nodes: DataFrame, band: int) -> DataFrame:
    """nodes (id, parent, depth, ...) with up, their ancestors from the parent to the top of their band; for a top, to the top of the band above."""
    level = F.col("depth") % band
    chains = stash(nodes.withColumn("up", F.when(level > 0, F.array("parent")).otherwise(F.array().cast(f"array<{nodes.schema['parent'].dataType.simpleString()}>"))))
    reach = 1
    while reach < band - 1:  # those whose chain is full and goes on take the chain of its last
        more = level > reach
        going = stash(chains.filter(more).withColumn("last", F.element_at("up", -1)))
        grown = join_unique(going, "last", chains.select(F.col("id").alias("last"), F.col("up").alias("beyond")))
        longer = grown.withColumn("up", F.concat("up", "beyond")).select(*chains.columns)
        chains = stash(chains.filter(~more).unionByName(longer), done_with=(chains, going))
        reach *= 2
    top = (level == 0) & (F.col("depth") > 0)
    going = stash(chains.filter(top).withColumn("last", F.col("parent")))
    grown = join_unique(going, "last", chains.select(F.col("id").alias("last"), F.col("up").alias("beyond")))
    tops = grown.withColumn("up", F.concat(F.array("parent"), "beyond")).select(*chains.columns)
    return stash(chains.filter(~top).unionByName(tops), done_with=(chains, going))


def rollup(nodes: DataFrame, values: tuple[str, ...], band: int = BAND) -> DataFrame:
    """Rows (id, *values): sums over the subtrees of nodes (id, parent, depth, *values); a root has depth 0."""
    total = [F.sum(v).alias(v) for v in values]
    chains = _chains(nodes.select("id", "parent", "depth", *values), band)
    inner = F.when(F.col("depth") % band == 0, F.array("id")).otherwise(F.concat(F.array("id"), "up"))
    local = chains.select(F.explode(inner).alias("id"), *values).groupBy("id").agg(*total)
    tops = chains.filter((F.col("depth") % band == 0) & (F.col("depth") > 0))
    if tops.isEmpty():
        return stash(local)
    local = stash(local)
    bands = chains.filter(F.col("depth") % band == 0).select("id", F.when(F.col("depth") > 0, F.element_at("up", -1)).alias("parent"), F.floor(F.col("depth") / band).alias("depth"))
    whole = rollup(stash(bands.join(local, "id")), values, band)
    above = tops.select("id", "up").join(whole, "id").select(F.explode("up").alias("id"), *values)
    return stash(local.unionByName(above).groupBy("id").agg(*total))


def prefix_trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", band: int = BAND, family: int = FAMILY) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, ends = rebuilt(conversations, key, turn, role, text, family)
    found = rows.groupBy("a", "b").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *(F.max(c).alias(c) for c in ("depth", "pa", "pb", "words")))
    parent = F.when(F.col("depth") > 0, F.struct(F.col("pa").alias("a"), F.col("pb").alias("b")))
    nodes = stash(found.select(F.struct("a", "b").alias("id"), parent.alias("parent"), "depth", "conv_id", "n_convs", "words"))
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = stash(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    saved = (F.col("n_convs") - 1) * F.col("words")
    sums = rollup(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": saved}), VALUES, band)
    digests = ends_digests(ends).select(F.struct("a", "b").alias("id"), "ends_sha256")
    upper = join_unique(nodes, "parent", nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "left")
    out = upper.join(sums, "id").join(digests, "id", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
