"""Prefix trie of conversations by smallest-member ownership.

A node is a sequence of first turns that some conversation starts with. It is keyed by
its depth and by the running XOR of 128 bits of hashed (place, turn), so a node needs no
text and its parent's key is its own XOR its last turn's. Each node belongs to the
smallest conversation that starts with it; what a conversation owns is then a suffix of
its path. That makes every sum over a subtree a sum over the members of its top: the
tokens of all occurrences below less those of the nodes owned below, and one flag for
each conversation that owns a leaf. One aggregation by node gives all of them at once.

Neither a conversation nor a node is ever gathered in one task, whatever share of the
rows it has: places and running sums are windows over blocks of ``BLOCK`` turns, started
from the totals of the blocks before, the owner of a node is an aggregate with map-side
combining, and marks come by joins that adaptive execution may split. Only the digest
of the conversations that end at a node is sequential by definition: it reads their ids,
8 bytes each, in order and holds none of them.

Defined cases: a null role or text is empty; turns are ordered with null first, ties by
a hash of role and text; repeated rows are turns of their own; rows without a
conversation are left out; a conversation without turns is a member of the root alone; an
empty table has no nodes; other columns are not read. Rows of one conversation whose
``turn`` is the same lie in one block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Turns of a conversation that one window group holds.
BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
#: What the mixing rule of :func:`rebuilt` takes its numbers from.
FAMILY, MOST_SHARED = 5, 9

KEY = ["depth", "x1", "x2"]


def numbered_turns(convs: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes) of every turn: its place from 1, 128 bits of (role, text), UTF-8 bytes of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    t = convs.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    t = t.withColumn("block", F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-(1 << 62))))
    before = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = before.select("conv_id", "block", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "digest"))
    t = t.withColumn("rn", inside).join(before, ["conv_id", "block"])
    return t.select("conv_id", (F.col("before") + F.col("rn")).alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: (conv_id, depth, digest, bytes) of their turns, and (conv_id, len) of all.

    Conversation c takes the first crc32(c) % 9 turns of c - c % 5, then its own after so many.
    """
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = sizes.select(c.alias("base"), F.col("n").alias("n_base"))
    sizes = sizes.withColumn("base", c - c % FAMILY).withColumn("shared", F.crc32(c.cast("string")) % MOST_SHARED)
    sizes = sizes.join(heads, "base", "left").withColumn("taken", F.least("shared", F.coalesce("n_base", F.lit(0).cast("long"))))
    own = turns.join(sizes.select("conv_id", "shared", "taken"), "conv_id").where("pos > shared")
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("shared")).alias("depth"), "digest", "bytes")
    first = turns.where(F.col("pos") < MOST_SHARED).withColumnRenamed("conv_id", "base")
    lent = first.join(sizes.select("conv_id", "base", "taken"), "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "digest", "bytes")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0).cast("long"))
    return own.unionByName(lent), sizes.select("conv_id", length.alias("len"))


def occurrences(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, p1, p2, bytes, before, len): the node and the parent of every turn, the bytes of the turns before."""
    t = turns.select("conv_id", "depth", F.shiftright(F.col("depth") - 1, BLOCK_BITS).alias("block"), F.xxhash64("depth", "digest").alias("h1"), F.xxhash64("digest", "depth").alias("h2"), "bytes")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = t.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.sum("bytes").alias("bb"))
    zero = F.lit(0).cast("long")
    totals = totals.select("conv_id", "block", *[F.coalesce(f(c).over(earlier), zero).alias(c) for c, f in (("b1", F.bit_xor), ("b2", F.bit_xor), ("bb", F.sum))])
    t = t.select("*", F.bit_xor("h1").over(inside).alias("r1"), F.bit_xor("h2").over(inside).alias("r2"), F.sum("bytes").over(inside).alias("rb")).join(totals, ["conv_id", "block"])
    x1, x2 = F.col("b1").bitwiseXOR(F.col("r1")), F.col("b2").bitwiseXOR(F.col("r2"))
    t = t.select("conv_id", "depth", x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("h1")).alias("p1"), x2.bitwiseXOR(F.col("h2")).alias("p2"), "bytes", (F.col("bb") + F.col("rb") - F.col("bytes")).alias("before"))
    return t.join(lengths, "conv_id")


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0).cast("long")


def ends_digest(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256): SHA-256 of the ascending, comma-joined conv_ids of each key, read as a sorted stream."""

    def run(batches):
        now, h = None, None
        for b in batches:
            out = []
            ids = b.column(len(keys)).to_pylist()
            for k, c in zip(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True), ids, strict=True):
                if k != now:
                    if h is not None:
                        out.append((*now, h.hexdigest()))
                    now, h = k, hashlib.sha256(str(c).encode())
                else:
                    h.update(b",%d" % c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], names)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, h.hexdigest())], names)

    names = [*keys, "ends_sha256"]
    d = ends.select(*[F.col(k).cast("long").alias(k) for k in keys], "conv_id")
    return d.repartition(*keys).sortWithinPartitions(*keys, "conv_id").mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` (conv_id, depth, digest, bytes) numbers the turns of a conversation from 1 without
    gaps; ``lengths`` (conv_id, len) has every conversation, those without turns too.
    """
    lengths = scratch.keep(lengths, "lengths")
    occ = scratch.keep(occurrences(turns, lengths), "occurrences")
    owners = occ.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.max("len").alias("longest"))
    last = F.col("depth") == F.col("len")
    marked = scratch.keep(occ.join(owners, KEY).select(*occ.columns, (F.col("conv_id") == F.col("owner")).alias("owned"), (last & (F.col("longest") == F.col("depth"))).alias("leaf")), "marked")

    # Owned turns are the last ones of a path: what is not owned lies before them.
    path = marked.groupBy("conv_id").agg(F.sum(F.when(~F.col("owned"), F.col("bytes")).otherwise(0)).alias("foreign"), F.count(F.when(~F.col("owned"), 1)).alias("n_foreign"), F.max(_flag(F.col("owned") & F.col("leaf"))).alias("owns_leaf"))
    path = scratch.keep(path, "paths")
    d = marked.join(path, "conv_id")
    nodes = d.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.first("p1").alias("p1"),
        F.first("p2").alias("p2"),
        F.count("*").alias("n_convs"),
        F.sum(_flag((F.col("depth") >= F.col("n_foreign")) & (F.col("depth") < F.col("len")))).alias("n_children"),
        F.sum("owns_leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("foreign") - F.col("before"), F.lit(0).cast("long"))).alias("saved_tokens"),
    )
    nodes = scratch.keep(nodes, "nodes")
    top = lengths.join(path, "conv_id", "left").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count(F.when((F.col("len") > 0) & (F.col("n_foreign") == 0), 1)).alias("n_children"), F.coalesce(F.sum("owns_leaf"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("foreign"), F.lit(0)).alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    root = top.where("n_convs > 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(above, ["depth", "p1", "p2"]).select(*root.columns)
    first = nodes.where("depth = 1").join(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id")))).select(*root.columns)  # one row
    ends = occ.where(last).select(*KEY, "conv_id").unionByName(lengths.where("len = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id"))
    out = deep.unionByName(first).unionByName(root).join(ends_digest(ends, KEY), KEY, "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def trie_digest(convs: DataFrame, scratch: Scratch) -> DataFrame:
    """The trie of the conversations as :func:`rebuilt` mixes them."""
    turns = scratch.keep(numbered_turns(convs), "turns")
    return prefix_trie(*rebuilt(turns), scratch)
