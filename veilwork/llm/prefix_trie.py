"""Operator 13, the prefix trie of conversations: blocks of turns named by doubling, prefixes named by binary decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.core import with_position
from veilwork.llm.common import crc32_text, written

#: Ids of a chunk of the text that is hashed.
CHUNK = 4096


def turn_keys(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, p, key, bytes)``: each turn's place from 0, a strong digest of role and text, and the text's UTF-8 bytes.

    Turns are ordered by turn, null first; turns of one number by their digests. Null role or text is empty; rows
    without a conv_id belong to no conversation; repeated rows are turns of their own. Places come from a global order
    and each conversation's first place, so one of a third of all rows is spread. Texts don't move: digests do.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("bigint").alias("bytes"))
    placed = written(with_position(written(rows, "turns"), [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("key")], "at").drop("turn"), "placed")
    first = written(placed.groupBy("conv").agg(F.min("at").alias("first")), "first")
    return placed.join(first, "conv").select("conv", (F.col("at") - F.col("first")).alias("p"), "key", "bytes")


def with_shared_openings(turns: DataFrame, group: int = 5, kinds: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the opening of their group's first: ``(turns, sizes(conv, n))``.

    Conversation c takes the first h turns of conversation ``c - c % group`` (as many as there are, none if it is
    absent) and then its own after its first h; h is the CRC-32 of its decimal id modulo ``kinds``.
    """
    turns = written(turns, "turns")
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumn("h", crc32_text(F.col("conv")) % kinds)
    sizes = written(sizes.withColumn("base", F.col("conv") - F.col("conv") % group), "sizes")
    bases = sizes.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    shape = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    shape = written(shape.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "shape")
    own = turns.join(shape.select("conv", "h", "taken"), "conv").filter("p >= h").select("conv", (F.col("p") - F.col("h") + F.col("taken")).alias("p"), "key", "bytes")
    opening = turns.filter(F.col("p") < kinds - 1).withColumnRenamed("conv", "base")
    opening = opening.join(shape.select("base", "conv", "h"), "base").filter("p < h").select("conv", "p", "key", "bytes")
    return own.unionByName(opening), shape.select("conv", "n")


# --- names ------------------------------------------------------------------------------------------------------------


def dense_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct ``keys`` and ``name``: numbers from 0 without gaps. Each part of the table says how many it has, one row each."""
    laid = written(rows.select(*keys).distinct().withColumn("_slot", F.monotonically_increasing_id()), "names")
    part = F.shiftright("_slot", 33)
    counts, starts, total = sorted(map(tuple, laid.groupBy(part.alias("p")).count().collect())), [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _from long"))  # a row per part
    return laid.join(offsets, part == F.col("_part")).select(*keys, (F.col("_from") + F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))).alias("name"))


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the ``name`` of their keys in place of them. Both sides of the join are tables, so a key of very many rows can be split."""
    names = written(dense_names(rows, keys), "named")
    return rows.join(names, keys).drop(*[k for k in keys if k != "depth"])


def prefix_names(turns: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """``(conv, depth, name)`` of every prefix, equal names at one depth for equal prefixes; and ``(conv, p, bytes)``.

    Blocks of 2^j turns at multiples of 2^j are named by the pair of names of their halves, j = 0, 1, .. A prefix of d
    turns is made of one block for each bit of d, so in the k-th round those with k bits are named by the pair of the
    prefix without the lowest bit and that bit's block. Rounds grow with the logarithm of the longest conversation, and
    every prefix is named once.
    """
    base = written(named(written(turns, "turns"), ["key"]), "blocks")
    blocks = [base.select("conv", "p", "name")]
    while 1 << len(blocks) <= longest:
        half, j = 1 << (len(blocks) - 1), len(blocks)
        right = F.col("p").bitwiseAND(F.lit(half)) != 0
        pairs = blocks[-1].groupBy("conv", F.shiftright("p", j).alias("i")).agg(F.max(F.when(~right, F.col("name"))).alias("l"), F.max(F.when(right, F.col("name"))).alias("r"))
        pairs = written(pairs.filter("l is not null and r is not null").select("conv", F.shiftleft("i", j).alias("p"), "l", "r"), "pairs")
        blocks.append(written(named(pairs, ["l", "r"]), "blocks"))
    heads, rest = [], []
    for j, b in enumerate(blocks):
        size = 1 << j
        heads.append(b.filter("p = 0").select("conv", F.lit(size).cast("bigint").alias("depth"), "name"))
        # the block of the lowest bit of p + size, where p has higher bits only
        rest.append(b.filter((F.col("p") > 0) & (F.col("p").bitwiseAND(F.lit(2 * size - 1)) == 0)).select("conv", F.col("p").alias("from"), (F.col("p") + size).alias("depth"), F.col("name").alias("r")))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    tails = written(union(rest), "tails")
    made = [written(union(heads), "prefixes")]
    for bits in range(1, longest.bit_length()):
        left = made[-1].select("conv", F.col("depth").alias("from"), F.col("name").alias("l"))
        pairs = left.join(tails.filter(F.bit_count("from") == bits), ["conv", "from"]).select("conv", "depth", "l", "r")
        made.append(written(named(written(pairs, "pairs"), ["depth", "l", "r"]), "prefixes"))
    return union(made), base.select("conv", "p", "bytes")


# --- nodes ------------------------------------------------------------------------------------------------------------


def _subtrees(tree: DataFrame, sums: dict[str, Column], deepest: int) -> DataFrame:
    """``(node, sums)`` over each node's subtree, in rounds that double the reach: a node adds what those 2^k below it have."""
    state = written(tree.select("node", F.col("parent").alias("jump"), *[c.alias(n) for n, c in sums.items()]), "sums")
    for _ in range(deepest.bit_length()):
        add = state.filter("jump is not null").groupBy(F.col("jump").alias("node")).agg(*[F.sum(n).alias(f"_{n}") for n in sums])
        far = state.filter("jump is not null").select("node", F.col("jump").alias("next"))
        far = far.join(state.select(F.col("node").alias("next"), F.col("jump").alias("to")).filter("to is not null"), "next").select("node", "to")
        grown = state.drop("jump").join(add, "node", "left").join(far, "node", "left")
        state = written(grown.select("node", F.col("to").alias("jump"), *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in sums]), "sums")
    return state.drop("jump")


def joined_digests(ends: DataFrame) -> DataFrame:
    """``(node, digest)``: SHA-256 of each node's decimal ids, ascending, comma-joined.

    Ids are laid in order over all tasks and joined to chunks of text there; a digest can't be computed in parts, so a
    node's chunks then stream through one task, in order, which holds one batch of them.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["node", "first", "text"])

        done = []
        for b in batches:
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (n != node or len(ids) == CHUNK):
                    done.append(out())
                    ids = []
                node = n
                ids.append(c)
            yield from done
            done = []
        if ids:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            nodes, sums = [], []
            for n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n == node:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    nodes.append(node)
                    sums.append(state.hexdigest())
                node, state = n, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sums, pa.string())], ["node", "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], ["node", "digest"])

    laid = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").select("node", "conv")
    made = laid.mapInArrow(chunks, "node bigint, first bigint, text string")
    return made.repartition("node").sortWithinPartitions("node", "first").select("node", "text").mapInArrow(digests, "node bigint, digest string")


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The trie of ``turns(conv, p, key, bytes)``, conversations and their lengths being ``sizes(conv, n)``.

    A node per distinct sequence of first turns, the root without any included: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over its subtree, each node's members but one times the
    bytes of its last text) and ends_sha256 (of the members that end there). Turns are compared by strong digests of role
    and text. A hot turn or a large group of copies is a node of many members: they are counted with partial sums.
    Conversations without turns are members of the root; without conversations there are no nodes.
    """
    sizes = written(sizes, "sizes")
    longest = sizes.agg(F.max("n")).first()[0] or 0
    prefixes, texts = prefix_names(turns, longest)
    every = prefixes.groupBy("depth", "name").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    root = sizes.groupBy().agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("name"), "conv_id", "n_convs")
    nodes = written(every.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "nodes")
    # a node's last text and its parent are those of its smallest member
    above = prefixes.select("conv", F.col("depth").alias("p"), F.col("name").alias("above"))
    facts = texts.join(above, ["conv", "p"], "left").select(F.col("conv").alias("conv_id"), (F.col("p") + 1).alias("depth"), "bytes", F.coalesce("above", F.lit(0)).alias("above"))
    below = written(nodes.join(facts, ["conv_id", "depth"], "left"), "below")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("above"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tree = written(below.join(parents, ["depth", "above"], "left"), "tree")
    children = written(tree.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    tree = written(tree.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")
    saved = F.coalesce((F.col("n_convs") - 1) * F.col("bytes"), F.lit(0))
    sums = _subtrees(tree, {"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": saved}, longest)
    last = prefixes.join(sizes.select("conv", F.col("n").alias("depth")), ["conv", "depth"])
    none = sizes.filter("n = 0").select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("name"))
    ends = written(last.select("conv", "depth", "name").unionByName(none), "ends").join(nodes.select("depth", "name", "node"), ["depth", "name"])
    digests = joined_digests(written(ends.select("node", "conv"), "ends"))
    out = tree.join(sums, "node").join(digests, "node", "left")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in names], F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, group: int = 5, kinds: int = 9) -> DataFrame:
    """The trie of ``conversations`` rebuilt on shared openings; see ``turn_keys`` for odd rows."""
    turns, sizes = with_shared_openings(turn_keys(conversations), group, kinds)
    return prefix_trie(turns, sizes)
