"""Prefix tries of conversations: burst by turn ids, swept in sorted containers.

A turn is named by 128 bits of its SHA-256, a path of turns by a chain of them.
Conversations of one sequence are one class from the start, with their number
and smallest id, so that a large group of copies is one row. Classes begin as
suffixes in containers under the trie's root, one a first turn. A container
with more than ``LIMIT`` turns bursts: it becomes a trie node, and its suffixes
go on to one container a next turn, until none is oversized. What is left is
dealt to shards by a hash of the container, sorted there and swept into nodes:
neighbours in order share a path, and a stack closes what the next one has
left. Totals of nodes that burst are then summed from below, a round a level of
bursts.

Very long conversations are cut into segments of ``STRIDE`` turns. Segments of
one depth are tries of their own under the paths that lead to them, worked from
the deepest up, and what hangs below a segment's end is handed to its class.
So no task holds more than a segment of a conversation or a container, nor more
digests of segments than one conversation has.

A list of members may hold a third of all ids, and its SHA-256 can only be
worked out in order: ids are joined in blocks of 4096 first, and the blocks of
a class pass one digest in order, in constant memory.

Defined cases: rows without conv_id belong to no conversation; null role or
text is empty; turns of equal number are ordered by their digest, null numbers
first; repeated rows are turns of their own; a conversation without turns ends
at the root; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.shared import materialize, numbered

#: Turns of a container beyond which it bursts, and least shards swept.
LIMIT, LEAST_SHARDS = 1 << 16, 16
#: Turns of a segment, and bytes of a turn's name.
STRIDE, NAME = 1024, 16
#: Conversations that share a head, and most turns of one, less one.
FAMILY, HEADS = 20, 4
#: Binary digits of the ids that are joined in one block.
BLOCK_BITS = 12
EMPTY = hashlib.sha256(b"").hexdigest()


def _named(data: Column) -> Column:
    return F.unhex(F.substring(F.sha2(data, 256), 1, 2 * NAME))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, turn_id, words) of all turns, in their conversations' order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.hex(_named(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn_id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    rows, _ = materialize(said, "turns")
    placed = numbered(rows, [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("turn_id")], "place")
    firsts = placed.groupBy("conv").agg(F.min("place").alias("first"))
    return placed.join(firsts, "conv").select("conv", (F.col("place") - F.col("first")).alias("pos"), "turn_id", "words")


def with_shared_heads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that go on from their family's first ones, and
    the ids of all conversations, those without turns too.

    The first ``crc32(id) % 4`` turns of a conversation are those of the one at
    its family's start, as many as that has.
    """
    lengths = rows.groupBy("conv").agg(F.count("*").alias("n"))
    convs = lengths.select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("family"), (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h"))
    starts = lengths.select(F.col("conv").alias("family"), F.col("n").alias("there"))
    convs, _ = materialize(convs.join(starts, "family", "left").withColumn("lead", F.least("h", F.coalesce("there", F.lit(0)))), "convs")
    own = rows.join(convs, "conv").where("pos >= h").select("conv", F.expr("pos - h + lead").alias("pos"), "turn_id", "words")
    heads = rows.where((F.col("pos") < HEADS - 1) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "family")
    led = heads.join(convs, "family").where("pos < lead").select("conv", "pos", "turn_id", "words")
    return own.unionByName(led), convs.select("conv")


def _segments(rows: DataFrame) -> DataFrame:
    """Segments (conv, seg, ids, words, head, next): the paths before and after."""

    @F.pandas_udf("array<binary>")
    def chained(digests: pd.Series) -> pd.Series:
        def chain(names: list[bytes]) -> list[bytes]:
            path = [b""]
            for d in names:
                path.append(hashlib.sha256(path[-1] + d).digest()[:NAME])
            return path

        return digests.map(chain)

    seg = F.floor(F.col("pos") / STRIDE).cast("int").alias("seg")
    held = F.array_sort(F.collect_list(F.struct("pos", "turn_id", "words")))
    cut = rows.groupBy("conv", seg).agg(held.alias("l")).select("conv", "seg", F.unhex(F.array_join("l.turn_id", "")).alias("ids"), F.col("l.words").alias("words"))
    cut, _ = materialize(cut.withColumn("digest", _named(F.col("ids"))), "segments")
    paths = cut.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seg", "digest"))).alias("l")).select("conv", chained(F.col("l.digest")).alias("path"))
    each = paths.select("conv", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("head"), F.slice("path", 2, F.size("path") - 1).alias("next"))).alias("seg", "p"), (F.size("path") - 2).alias("last"))
    return cut.drop("digest").join(each.select("conv", "seg", "p.*", (F.col("seg") == F.col("last")).alias("last")), ["conv", "seg"])


def member_digests(ends: DataFrame) -> DataFrame:
    """``seq`` and the SHA-256 of its conversations' ids (``conv``), ascending
    and joined by commas."""

    def streamed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for part in parts:
            found = []
            for seq, ids in zip(part["seq"], part["ids"], strict=True):
                if seq == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        found.append((now, digest.hexdigest()))
                    now, digest = seq, hashlib.sha256()
                digest.update(ids.encode())
            yield pd.DataFrame(found, columns=["seq", "sha"])
        if now is not None:
            yield pd.DataFrame([(now, digest.hexdigest())], columns=["seq", "sha"])

    block = F.shiftright("conv", BLOCK_BITS).alias("block")
    joined = ends.groupBy("seq", block).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    parts = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return joined.repartition(parts, "seq").sortWithinPartitions("seq", "block").mapInPandas(streamed, "seq binary, sha string")


_NODE = "up binary, at int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, sha string"


def swept(part: pd.DataFrame) -> pd.DataFrame:
    """All nodes of a shard's containers, from one sweep over sorted suffixes.

    A row is a class: the path ``ids`` with its turns' ``words``, of which the
    first ``at`` led to the container ``key`` under the node ``up``; its members
    ``m`` and their ``least``; what hangs below its end (``kids``, ``leaves``,
    ``saved``) and the digest ``sha`` of members that end there. A container's
    top has ``up``, all other nodes null.
    """
    keys, ids, words, ats = (part[c].tolist() for c in ("key", "ids", "words", "at"))
    fixed = [part[c].tolist() for c in ("m", "least", "kids", "leaves", "saved", "sha", "up", "parent_least")]
    paths = [np.frombuffer(x, np.uint64).reshape(-1, NAME // 8) for x in ids]
    depth, parent, least, members, kids, leaves, saved, weight, sha, up, above = ([] for _ in range(11))

    def close(k: int) -> None:
        saved[k] += (members[k] - 1) * weight[k]
        if not kids[k]:
            leaves[k] = 1
        p = parent[k]
        if p >= 0:
            kids[p] += 1
            for total in (members, leaves, saved):
                total[p] += total[k]
            least[p] = min(least[p], least[k])

    stack, before = [], None
    for i in sorted(range(len(keys)), key=lambda i: (keys[i], ids[i])):
        m, first, more, under, below, digest, top, led = (f[i] for f in fixed)
        fork = ats[i] - 1
        if before is not None and keys[before] == keys[i]:
            n = min(len(paths[before]), len(paths[i]))
            parted = (paths[before][:n] != paths[i][:n]).any(axis=1)
            fork = int(parted.argmax()) if parted.any() else n
        while stack and (depth[stack[-1]] > fork or fork < ats[i]):
            close(stack.pop())
        for d in range(fork, len(paths[i])):
            parent.append(stack[-1] if stack else -1)
            up.append(None if stack else top)
            above.append(led)
            depth.append(d + 1)
            weight.append(int(words[i][d]))
            for column, start in ((least, first), (members, 0), (kids, 0), (leaves, 0), (saved, 0), (sha, None)):
                column.append(start)
            stack.append(len(depth) - 1)
        end, before = stack[-1], i
        members[end] += m
        least[end] = min(least[end], first)
        kids[end] += more
        leaves[end] += under
        saved[end] += below
        sha[end] = digest
    while stack:
        close(stack.pop())
    led = [least[p] if p >= 0 else a for p, a in zip(parent, above, strict=True)]
    return pd.DataFrame({"up": pd.Series(up, dtype=object), "at": depth, "conv_id": least, "parent_conv_id": led, "n_convs": members, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved, "sha": pd.Series(sha, dtype=object)})


def _burst(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Containers within ``LIMIT`` turns, and a round after another of the nodes
    that burst (key, up, at, words, least, m, sha, parent_least)."""
    step = lambda key, at: _named(F.concat(key, F.expr(f"substring(ids, {at} * {NAME} + 1, {NAME})")))
    size = F.size("words")
    rows, _ = materialize(rows.withColumn("up", F.col("head")).withColumn("at", F.lit(1)).withColumn("key", step(F.col("head"), "0")).drop("head"), "suffixes")
    small, bursts = [], []
    while True:
        sizes = rows.groupBy("key").agg(F.sum(size - F.col("at") + 1).alias("turns"), F.count("*").alias("n"), F.min("least").alias("least_here"), F.sum("m").alias("m_here"))
        big, _ = materialize(sizes.where((F.col("turns") > LIMIT) & (F.col("n") > 1)).drop("turns", "n"), "bursts")
        if not big.limit(1).count():
            return reduce(DataFrame.unionByName, [*small, rows]), bursts
        small.append(rows.join(big, "key", "left_anti"))
        hot = rows.join(big, "key")
        one = hot.groupBy("key", "up", "at").agg(*[F.first(c).alias(c) for c in ("parent_least", "least_here", "m_here")], F.first(F.expr("words[at - 1]")).alias("word"), F.max(F.when(size == F.col("at"), F.col("sha"))).alias("sha"))
        bursts.append(materialize(one, "burst-nodes")[0])
        on = hot.where(size > F.col("at")).withColumn("parent_least", F.col("least_here")).withColumn("up", F.col("key")).withColumn("key", step(F.col("key"), "at")).withColumn("at", F.col("at") + 1)
        rows, _ = materialize(on.drop("least_here", "m_here"), "suffixes")


def _level(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one depth of segments, ``at`` their depth in it, and the totals
    of what hangs under each head."""
    containers, bursts = _burst(rows)
    total = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("key"), F.lit(max(LEAST_SHARDS, -(-2 * total // LIMIT)))).alias("shard")
    nodes, _ = materialize(containers.groupBy(shard).applyInPandas(swept, _NODE), "nodes")
    tops = nodes.where("up is not null").select("up", "n_leaves", "saved_tokens")
    summed = lambda df: df.groupBy("up").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    found = [nodes]
    for burst in reversed(bursts):
        below = summed(tops).withColumnRenamed("up", "key")
        full = burst.join(below, "key").select("up", "at", F.col("least_here").alias("conv_id"), F.col("parent_least").alias("parent_conv_id"), F.col("m_here").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("m_here") - 1) * F.col("word")).alias("saved_tokens"), "sha")
        full, _ = materialize(full, "nodes")
        found.append(full)
        tops = tops.unionByName(full.select("up", "n_leaves", "saved_tokens"))
    return reduce(DataFrame.unionByName, found).drop("up"), summed(tops).withColumnRenamed("up", "head")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie over turns ``rows`` of the conversations ``convs``.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256 a node, the root included.
    """
    cut, _ = materialize(_segments(rows), "segments")
    turnless = convs.join(cut.where("seg = 0").select("conv"), "conv", "left_anti").select("conv", F.lit(b"").alias("seq"))
    shas, _ = materialize(member_digests(cut.where("last").select("conv", F.col("next").alias("seq")).unionByName(turnless)), "members")
    grouped = cut.groupBy("seg", "head", "next").agg(F.first("ids").alias("ids"), F.first("words").alias("words"), F.count("*").alias("m"), F.min("conv").alias("least"))
    classes, _ = materialize(grouped.join(shas.withColumnRenamed("seq", "next"), "next", "left"), "classes")
    all_convs, smallest = convs.agg(F.count("*"), F.min("conv")).first()
    deepest = classes.agg(F.max("seg")).first()[0]
    found, below = [], None
    for seg in range(-1 if deepest is None else deepest, -1, -1):
        here = classes.where(F.col("seg") == seg).drop("seg")
        here = here.withColumn("parent_least", F.lit(smallest).cast("long")) if not seg else here.join(classes.where(F.col("seg") == seg - 1).groupBy(F.col("next").alias("head")).agg(F.min("least").alias("parent_least")), "head")
        if below is None:
            here = here.withColumns({c: F.lit(0).cast("long") for c in ("kids", "leaves", "saved")})
        else:
            here = here.join(below.withColumnRenamed("head", "next"), "next", "left").fillna(0, ["kids", "leaves", "saved"])
        nodes, heads = _level(here.drop("next"))
        below, _ = materialize(heads, "heads")
        found.append(nodes.withColumn("depth", F.lit(seg * STRIDE).cast("long") + F.col("at")).drop("at"))
    if not all_convs:
        return convs.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    at_root = shas.where(F.col("seq") == F.lit(b"")).select("sha")
    root = convs.sparkSession.range(1).select(F.lit(smallest).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(all_convs).cast("long").alias("n_convs"))
    totals = below.where(F.col("head") == F.lit(b"")) if below is not None else None
    sha = at_root.first()
    kids = totals.first() if totals is not None else None
    root = root.withColumns({"n_children": F.lit(kids.kids if kids else 0).cast("long"), "n_leaves": F.lit(kids.leaves if kids else 1).cast("long"), "saved_tokens": F.lit(kids.saved if kids else 0).cast("long"), "sha": F.lit(sha.sha if sha else None).cast("string")})
    every = reduce(DataFrame.unionByName, [*found, root])
    return every.withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: :func:`with_shared_heads`."""
    placed, _ = materialize(turns(conversations), "placed")
    return trie(*with_shared_heads(placed))
