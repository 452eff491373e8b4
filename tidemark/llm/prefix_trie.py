"""Tries of conversation prefixes, built by cutting sequences at half their depth."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

ROOT = bytes(16)
# Turns whose names one task makes at once, as a power of two; deeper cuts are made by joins.
BLOCK_BITS = 8
# Conversation ids in one chunk of a node's list, as a power of two.
CHUNK_BITS = 12


def _named(text: Column) -> Column:
    """The first 16 bytes of a sha256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _name(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(left + right).digest()[:16]


def numbered_turns(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, pos, item, words`` of all turns: place in the conversation from 0, name of role and text, words of text.

    Turns stand in order of ``turn`` (null first), then role, then name. The sort goes over ranges of all turns, so a
    conversation of any length may spread over tasks; its parts are numbered on their own and moved up by the sizes of
    the earlier ones, of which there are no more than tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("conv"),
        F.col(turn).alias("turn"),
        role.alias("role"),
        _named(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("item"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    order = ["conv", "turn", "role", "item"]
    rows = settle(rows, "turns").repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "item", "words")

    def run(batches):
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for conv in batch.column("conv").to_pylist():
                at = at + 1 if conv == last else 0
                last = conv
                places.append(at)
            parts = pa.array([part] * len(places), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(places, pa.int64())], [*batch.schema.names, "part", "at"])

    placed = settle(rows.mapInArrow(run, "conv bigint, item binary, words bigint, part bigint, at bigint"), "placed-turns")
    sizes = placed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    # Only a task's first conversation can have begun earlier: one row per task at most.
    first = placed.groupBy("part").agg(F.min("conv").alias("conv")).select("conv").distinct()
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.join(F.broadcast(first), "conv", "left_semi").select("conv", "part", F.sum("n").over(before).alias("shift")).where("shift > 0")
    moved = placed.join(F.broadcast(earlier), ["conv", "part"], "left")
    return moved.select("conv", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("pos"), "item", "words")


def shared_openings(numbered: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``conv, size, pos, item, words`` of the rebuilt conversations; one row with null ``pos`` for each without turns.

    Conversation c takes the first h = crc32(c) % ``most`` turns of conversation c - c % ``every`` (all if it has
    fewer, none if there is none) in place of its own first h.
    """
    numbered = settle(numbered, "numbered-turns")
    sizes = numbered.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = settle(sizes.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base")), "conversations")
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))
    convs = settle(convs, "rebuilt")
    own = numbered.join(convs, "conv").where("pos >= h").select("conv", "size", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "item", "words")
    openings = numbered.where(F.col("pos") < most).withColumnRenamed("conv", "base")
    openings = convs.where("taken > 0").join(openings, "base").where("pos < taken").select("conv", "size", "pos", "item", "words")
    empty = convs.where("size = 0").select("conv", "size", *(F.lit(None).cast(t).alias(c) for c, t in (("pos", "bigint"), ("item", "binary"), ("words", "bigint"))))
    return own.unionByName(openings).unionByName(empty)


def block_names(start: bytes, items: list[bytes]) -> list[bytes]:
    """Names of the prefixes that end after 0, 1, 2, ... of the items, where ``start`` names what comes before them.

    The items are cut at half depth: the first half's content names the cut, and both halves are named by themselves,
    the second one from the cut on. So the prefix of length d is named by its cut at d less its lowest bit and by the
    content of the rest, which is a full half of its level.
    """
    levels = [items]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([_name(low[i], low[i + 1]) for i in range(0, len(low) - 1, 2)])
    names = [start]
    for d in range(1, len(items) + 1):
        bit = (d & -d).bit_length() - 1
        names.append(_name(names[d - (1 << bit)], levels[bit][(d >> bit) - 1]))
    return names


def _cut_names(blocks: DataFrame, last: int) -> DataFrame:
    """``conv, block, start, chain`` for the end of every full block: its name as the ``start`` of the next block, with
    that block's number, and those of the cuts above, highest first. ``last`` is the largest block number.

    Upwards, full halves of each level are named from those below; downwards, each cut from the one before its half.
    """

    def content(batches):
        for batch in batches:
            found = []
            for items in batch.column("items").to_pylist():
                while len(items) > 1:
                    items = [_name(items[i], items[i + 1]) for i in range(0, len(items), 2)]
                found.append(items[0])
            yield pa.RecordBatch.from_arrays([*batch.select(["conv", "block"]).columns, pa.array(found, pa.binary())], ["conv", "block", "content"])

    full = blocks.where(F.size("items") == 1 << BLOCK_BITS).select("conv", "block", "items")
    halves = [settle(full.mapInArrow(content, "conv bigint, block bigint, content binary"), "halves")]
    while last + 1 >> len(halves):
        pair = F.sort_array(F.collect_list(F.struct("block", "content")))
        above = halves[-1].groupBy("conv", F.shiftright("block", 1).alias("above")).agg(pair.alias("p")).where(F.size("p") == 2)
        content_of_both = _named(F.concat(F.get("p", F.lit(0))["content"], F.get("p", F.lit(1))["content"]))
        halves.append(settle(above.select("conv", F.col("above").alias("block"), content_of_both.alias("content")), "halves"))
    none = F.array().cast("array<binary>")
    names = blocks.select("conv").distinct().select("conv", F.lit(0).cast("bigint").alias("block"), F.lit(ROOT).alias("start"), none.alias("chain"))
    for k in range(len(halves) - 1, -1, -1):
        half = halves[k].withColumn("block", F.shiftleft("block", k))
        start = _named(F.concat("start", "content"))
        after = names.join(half, ["conv", "block"]).select("conv", (F.col("block") + (1 << k)).alias("block"), start.alias("start"), "chain")
        names = settle(names.unionByName(after.withColumn("chain", F.concat("chain", F.array("start")))), "cuts")
    return names.where("block > 0")


def trie_rows(turns: DataFrame) -> tuple[DataFrame, int]:
    """``name, parent, depth, words, cuts, conv, ends`` for every prefix of every conversation, and the largest depth.

    ``cuts`` are the names of the cuts above a node, highest first: one for each set bit of its depth less one.
    """
    entry = F.sort_array(F.collect_list(F.struct("pos", "item", "words")))
    held = turns.where("pos is not null").groupBy("conv", "size", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(entry.alias("e"))
    blocks = settle(held.select("conv", "size", "block", F.col("e.item").alias("items"), F.col("e.words").alias("words")), "blocks")
    deepest, last = blocks.agg(F.max("size"), F.max("block")).first()
    if last:
        cuts = _cut_names(blocks, last)
        stops = cuts.select("conv", (F.col("block") - 1).alias("block"), F.col("start").alias("stop"))
        blocks = blocks.join(cuts, ["conv", "block"], "left").join(stops, ["conv", "block"], "left")
    else:
        none = F.lit(None).cast("binary")
        blocks = blocks.select("*", none.alias("start"), F.lit(None).cast("array<binary>").alias("chain"), none.alias("stop"))

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                out = {c: [] for c in ("name", "parent", "depth", "words", "cuts", "conv", "ends")}
                for row in batch.slice(low, 512).to_pylist():
                    first, chain = row["block"] << BLOCK_BITS, row["chain"] or []
                    names = block_names(row["start"] or ROOT, row["items"])
                    # A full block's end may be a cut of a higher level, which names it.
                    names[-1] = row["stop"] or names[-1]
                    for r, words in enumerate(row["words"]):
                        bits = [k for k in range(BLOCK_BITS - 1, -1, -1) if r >> k & 1]
                        out["name"].append(names[r + 1])
                        out["parent"].append(names[r])
                        out["depth"].append(first + r + 1)
                        out["words"].append(words)
                        out["cuts"].append(chain + [names[r >> k << k] for k in bits])
                        out["conv"].append(row["conv"])
                        out["ends"].append(first + r + 1 == row["size"])
                types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    schema = "name binary, parent binary, depth bigint, words bigint, cuts array<binary>, conv bigint, ends boolean"
    rows = blocks.mapInArrow(run, schema)
    top = turns.groupBy("conv", "size").agg(F.lit(0).alias("z")).select(
        F.lit(ROOT).alias("name"),
        F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(0).cast("bigint").alias("words"),
        F.array().cast("array<binary>").alias("cuts"),
        "conv",
        (F.col("size") == 0).alias("ends"),
    )
    return rows.unionByName(top), deepest or 0


def grafted(nodes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """``name`` and the sums of ``values`` over each node's subtree, of ``nodes`` with ``name, depth, cuts``.

    From the highest cut down: all nodes of a lower tree add their sums to the node their tree hangs on, the last of
    the upper tree, which hands them on in its turn within that. Each level is one sum by name, added up map-side.
    """

    def level(df: DataFrame, sends: Column, to: Column, rest: Column) -> DataFrame:
        own = F.struct("name", "depth", F.when(sends, rest).otherwise(F.col("cuts")).alias("cuts"), *values)
        sent = F.struct(to.alias("name"), F.lit(None).cast("bigint").alias("depth"), F.lit(None).cast("array<binary>").alias("cuts"), *values)
        both = df.select(F.explode(F.when(sends, F.array(own, sent)).otherwise(F.array(own))).alias("x")).select("x.*")
        return both.groupBy("name").agg(F.max("depth").alias("depth"), F.max("cuts").alias("cuts"), *(F.sum(v).alias(v) for v in values))

    df = nodes.select("name", "depth", "cuts", *values)
    for k in range(max(deepest - 1, 0).bit_length() - 1, -1, -1):
        sends = (F.col("depth") > 0) & (F.shiftright(F.col("depth") - 1, k).bitwiseAND(1) == 1)
        df = level(df, sends, F.get("cuts", F.lit(0)), F.slice("cuts", 2, 64))
    return level(df, F.col("depth") == 1, F.lit(ROOT), F.col("cuts")).select("name", *values)


def end_digests(ends: DataFrame) -> DataFrame:
    """``name, ends_sha256`` of ``name, conv``: ids in numerical order, comma-joined. A node's ids travel in chunks of
    2 ** CHUNK_BITS numbers, one chunk a row, and are digested one chunk after the other."""
    chunk = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy("name", F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(chunk.alias("ids"))
    chunks = chunks.repartition("name").sortWithinPartitions("name", "chunk")

    def run(batches):
        last, digest = None, None
        for batch in batches:
            names, found = [], []
            for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name == last:
                    digest.update(b",")
                else:
                    if digest:
                        names.append(last)
                        found.append(digest.hexdigest())
                    last, digest = name, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.string())], ["name", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], ["name", "ends_sha256"])

    return chunks.mapInArrow(run, "name binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (``conv, size, pos, item, words``, as of ``shared_openings``).

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree, words of a node's last text times its members less one) and ``ends_sha256``.
    Conversations without turns are members of the root; no conversations give no rows. Nodes are named by 128 bits
    of sha256, cut by cut; members, children and sums are counted map-side, so neither a first turn that a third of
    all conversations share nor a conversation of any length meets in one task.
    """
    turns = settle(turns, "sequences")
    rows, deepest = trie_rows(turns)
    rows = settle(rows, "trie-rows")
    nodes = rows.groupBy("name", "parent", "depth", "words", "cuts").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = settle(nodes, "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = settle(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")), "trie-nodes")
    own = nodes.select(
        "name",
        "depth",
        "cuts",
        (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    sums = grafted(own, ["n_leaves", "saved_tokens"], deepest)
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("cuts").join(sums, "name").join(end_digests(rows.where("ends").select("name", "conv")), "name", "left").join(above, "parent", "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, key: str, turn: str, role: str, text: str, every: int = 20, most: int = 4) -> DataFrame:
    """``prefix_trie`` of the conversations in ``turns`` after ``shared_openings``.

    Null roles and texts count as empty, rows with a null ``key`` are left out, repeated rows are turns of their own,
    turns of equal number are ordered by role and then by the name of role and text. Other columns are ignored; empty
    tables give no rows.
    """
    return prefix_trie(shared_openings(numbered_turns(turns, key, turn, role, text), every, most))
