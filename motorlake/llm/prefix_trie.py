"""The trie of conversation prefixes, as owned chains.

A node is a distinct sequence of first turns; its owner is the smallest conversation that
starts with it. What a conversation owns are its deepest prefixes, from its first owned
depth on: they form a chain that hangs on a node of another conversation. So that depth is
found by binary search, all conversations at once, in joins with the smallest conversation
of each prefix digest. Sums over subtrees then need chains only: each chain's total goes
up to the chain that it hangs on, over twice as many chains in each round, and sums from
the end of a chain give those of its nodes.

Digests of prefixes are exclusive ors of 128-bit hashes of (position, role, text), so that
they, like all sums along a conversation, are running totals over rows dealt out by range:
a conversation of any length is split over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlake.llm.common import stored

#: Turns that another conversation may lend at most, and the number of ids in a part of an id list.
LENT = 8
PART_IDS = 1 << 16
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, order: list[Column], totals: dict[str, str], name: str) -> DataFrame:
    """``df`` with running totals over the rows of each ``conv``, in the given order, of the columns of ``totals`` ("sum" or "xor"; all bigint), in place of these.

    Rows are dealt out by range and totalled in their tasks; what a conversation has
    in earlier tasks is added afterwards, from two rows for each task.
    """
    columns = [c for c in df.columns if c not in totals]
    ufuncs = {c: np.add if kind == "sum" else np.bitwise_xor for c, kind in totals.items()}
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join([f"{c} {fields[c]}" for c in columns] + [f"{c} bigint" for c in totals] + ["part int", "seq bigint", "carried boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first, last, held = TaskContext.get().partitionId(), 0, None, None, dict.fromkeys(totals, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            sizes = np.diff(np.append(starts, len(conv)))
            first = conv[0] if first is None else first
            goes_on = last is not None and conv[0] == last
            out = [batch.column(c) for c in columns]
            for c, add in ufuncs.items():
                all_ = add.accumulate(batch.column(c).to_numpy())
                before = np.concatenate([[0], all_[starts[1:] - 1]])
                own = all_ - np.repeat(before, sizes) if add is np.add else all_ ^ np.repeat(before, sizes)
                if goes_on:
                    own[: sizes[0]] = add(own[: sizes[0]], held[c])
                held[c] = own[-1]
                out.append(pa.array(own))
            last = conv[-1]
            place = [pa.array(np.full(len(conv), part, np.int32)), pa.array(np.arange(seq, seq + len(conv))), pa.array(conv == first)]
            seq += len(conv)
            yield pa.RecordBatch.from_arrays([*out, *place], [*columns, *totals, "part", "seq", "carried"])

    rows = stored(df.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order).mapInArrow(run, ddl), name)
    # the last row of each task holds what it has of its last conversation
    ends = rows.groupBy("part").agg(F.min("conv").alias("first"), F.max_by(F.struct("conv", *totals), "seq").alias("last"))
    asks = ends.select(F.col("first").alias("conv"), "part", F.lit(0).alias("kind"), *(F.lit(None).cast("bigint").alias(c) for c in totals))
    gives = ends.select("last.conv", "part", F.lit(1).alias("kind"), *(F.col(f"last.{c}").alias(c) for c in totals))
    earlier = Window.partitionBy("conv").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.sum(c) if totals[c] == "sum" else F.bit_xor(c)
    carry = asks.unionByName(gives).select("part", "kind", *(F.coalesce(total(c).over(earlier), F.lit(0)).alias(f"carry_{c}") for c in totals)).where("kind = 0").drop("kind")
    joined = rows.join(F.broadcast(carry), "part")  # a row for each task of the sort
    both = lambda c: F.col(c) + F.col(f"carry_{c}") if totals[c] == "sum" else F.col(c).bitwiseXOR(F.col(f"carry_{c}"))
    return joined.select(*columns, *(F.when(F.col("carried"), both(c)).otherwise(F.col(c)).alias(c) for c in totals))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, place, h1, h2, n_bytes): the turns of each conversation in order, as hashes."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes = [F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(7), text, role).alias("h2")]
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), "turn", *hashes, F.octet_length(text).cast("bigint").alias("n_bytes"), F.monotonically_increasing_id().alias("n"), F.lit(1).cast("bigint").alias("place"))
    order = [F.col("turn").asc_nulls_first(), F.col("h1").asc(), F.col("h2").asc(), F.col("n").asc()]
    return running(stored(rows, "trie-turns"), order, {"place": "sum"}, "trie-places").select("conv", (F.col("place") - 1).alias("place"), "h1", "h2", "n_bytes")


def lent(conv: Column) -> Column:
    """How many first turns a conversation takes from the first one of its five."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, place, h1, h2, n_bytes) and lengths (conv, length) after each conversation has taken its lent turns."""
    lengths = rows.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", lent(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % 5).alias("lender"))
    lenders = lengths.where("conv = lender").select(F.col("conv").alias("lender"), F.col("n").alias("lender_n"))
    taken = F.least("h", F.coalesce("lender_n", F.lit(0))).cast("bigint")
    plan = stored(lengths.join(lenders, "lender", "left").select("conv", "lender", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-plan")
    heads = rows.where(f"conv % 5 = 0 and place < {LENT}").withColumnRenamed("conv", "lender")
    borrowed = plan.where("taken > 0").select("conv", "lender", "taken").join(heads, "lender").where("place < taken")
    moved = plan.where("taken <> h").select("conv", (F.col("taken") - F.col("h")).alias("shift"))
    own = rows.where(F.col("place") >= lent(F.col("conv"))).join(moved, "conv", "left").withColumn("place", F.col("place") + F.coalesce("shift", F.lit(0)))
    same = ["conv", "place", "h1", "h2", "n_bytes"]
    return borrowed.select(*same).unionByName(own.select(*same)), plan.select("conv", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, n_bytes): the digest of each prefix, and the bytes of its last text."""
    digests = rows.select("conv", (F.col("place") + 1).alias("depth"), "n_bytes", F.xxhash64("place", "h1", "h2").alias("k1"), F.xxhash64("h2", "place", "h1").alias("k2"))
    return running(stored(digests, "trie-digests"), [F.col("depth").asc()], {"k1": "xor", "k2": "xor"}, "trie-prefixes")


def first_owned(lengths: DataFrame, paths: DataFrame, minima: DataFrame, root: int, longest: int) -> DataFrame:
    """(conv, length, first, above): the first depth that a conversation owns, by binary search, and the owner of the depth above.

    A conversation that owns nothing has length + 1. Depth ``low`` is never owned, ``high`` always, or is beyond the end.
    """
    state = lengths.select("conv", "length", F.lit(0).cast("bigint").alias("low"), (F.col("length") + 1).alias("high"), F.lit(root).cast("bigint").alias("above")).where(F.col("conv") != root)
    for _ in range(ceil(log2(longest + 1))):
        probes = state.where("high - low > 1").withColumn("depth", F.expr("(low + high) div 2"))
        met = probes.join(paths.select("conv", "depth", "k1", "k2"), ["conv", "depth"]).join(minima.select("depth", "k1", "k2", "owner"), ["depth", "k1", "k2"])
        owned = F.col("owner") == F.col("conv")
        moved = met.select("conv", "length", F.when(owned, F.col("low")).otherwise(F.col("depth")).alias("low"), F.when(owned, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(owned, F.col("above")).otherwise(F.col("owner")).alias("above"))
        state = stored(state.where("high - low <= 1").unionByName(moved), "trie-search")
    return state.select("conv", "length", F.col("high").alias("first"), "above")


def subtree_totals(chains: DataFrame, root: int) -> DataFrame:
    """``chains`` (conv, above, leaves, saved) with sums over each chain and all that hang on it, directly or not.

    After a round a chain has the sums of those less than 2, 4, 8 ... steps below it, and
    ``above`` is the chain as many steps up; at most log2 of the longest way to the root.
    """
    now = stored(chains, "trie-chains")
    while not now.where("above is not null").isEmpty():
        below = now.where("above is not null").groupBy("above").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnRenamed("above", "conv")
        steps = now.where(F.col("conv") != root).select(F.col("conv").alias("above"), F.col("above").alias("next"))
        higher = now.where(F.col("above") != root).select("conv", "above").join(steps, "above").select("conv", "next")
        joined = now.select("conv", "leaves", "saved").join(below, "conv", "left").join(higher, "conv", "left")
        add = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        now = stored(joined.select("conv", F.col("next").alias("above"), add("leaves"), add("saved")), "trie-chains")
    return now.select("conv", "leaves", "saved")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, depth, member) rows to runs of comma-joined ids."""
    key, held = None, []
    names = ["conv", "depth", "member", "ids"]
    run = lambda: (*key, held[0], ",".join(map(str, held)))
    for batch in batches:
        done = []
        for conv, depth, member in zip(*(batch.column(c).to_pylist() for c in names[:3]), strict=True):
            if held and (key != (conv, depth) or len(held) >= PART_IDS):
                done.append(run())
                held = []
            key = (conv, depth)
            held.append(member)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in run()], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts of id lists to one SHA-256 for each node; a part at a time is held."""
    names = ["conv", "depth", "ends_sha256"]
    key, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "ids")), strict=True):
            if key != (conv, depth):
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (conv, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names)


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of ``ends`` (conv, depth, member): a node's many members are dealt out by range, and meet as lists of ids."""
    keys = ["conv", "depth", "member"]
    parts = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_parts, "conv bigint, depth bigint, member bigint, ids string")
    return parts.repartition("conv", "depth").sortWithinPartitions(*keys).mapInArrow(_digests, "conv bigint, depth bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are ordered by turn, null first, rows of equal turn by a hash of role and
    text; repeated rows are turns of their own. A null role or text is empty, and rows
    without conv_id take no part. Only conv_id, turn, role and text are read, so other
    columns can't clash. Texts count as a whole, however long, and a conversation may have
    any number of turns. A conversation without turns after the rebuild is a member of the
    root. An empty table gives no rows.
    """
    rows = turns(conversations)
    pieces, lengths = rebuilt(rows)
    paths = prefixes(pieces)
    minima = stored(paths.groupBy("depth", "k1", "k2").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes")), "trie-minima")
    root, longest, total = lengths.agg(F.min("conv"), F.max("length"), F.count("*")).first()
    root = 0 if root is None else root
    found = first_owned(lengths, paths, minima, root, longest or 0)
    own_root = lengths.where(F.col("conv") == root).select("conv", "length", F.lit(0).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("above"))
    chains = stored(found.unionByName(own_root), "trie-owned")

    full = chains.where("first <= length")
    hung = full.where("above is not null").select(F.col("above").alias("conv"), (F.col("first") - 1).alias("depth"), F.col("conv").alias("child"))
    tips = full.select("conv", F.col("length").alias("depth")).join(hung.select("conv", "depth").distinct(), ["conv", "depth"], "left_anti")
    saved = minima.groupBy(F.col("owner").alias("conv")).agg(F.sum((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    values = full.join(saved, "conv", "left").join(tips.select("conv", F.lit(1).cast("bigint").alias("leaf")), "conv", "left")
    totals = subtree_totals(values.select("conv", "above", F.coalesce("leaf", zero).alias("leaves"), F.coalesce("saved", zero).alias("saved")), root)

    # all that is known of a node, gathered by its owner and depth
    def facts(df: DataFrame, **known: Column) -> DataFrame:
        return df.select("conv", "depth", *(known.get(c, none if c == "parent" else zero).alias(c) for c in ("n_convs", "hung", "leaves", "saved", "parent")))

    one = F.lit(1).cast("bigint")
    gathered = facts(minima.withColumnRenamed("owner", "conv"), n_convs=F.col("n_convs"), saved=(F.col("n_convs") - 1) * F.col("n_bytes"))
    gathered = gathered.unionByName(facts(own_root.select("conv", F.col("first").alias("depth")), n_convs=F.lit(total).cast("bigint")))
    gathered = gathered.unionByName(facts(full.select("conv", F.col("first").alias("depth"), "above"), parent=F.col("above")))
    gathered = gathered.unionByName(facts(tips, leaves=one))
    gathered = gathered.unionByName(facts(hung.join(totals.withColumnRenamed("conv", "child"), "child"), hung=one, leaves=F.col("leaves"), saved=F.col("saved")))
    nodes = gathered.groupBy("conv", "depth").agg(*(F.sum(c).alias(c) for c in ("n_convs", "hung", "leaves", "saved")), F.max("parent").alias("parent"), F.lit(1).cast("bigint").alias("place"))
    summed = running(stored(nodes, "trie-nodes"), [F.col("depth").desc()], {"leaves": "sum", "saved": "sum", "place": "sum"}, "trie-sums")

    owns = F.col("first") <= F.col("length")
    ends = chains.select(F.when(owns, F.col("conv")).otherwise(F.col("above")).alias("conv"), F.col("length").alias("depth"), F.col("conv").alias("member"))
    is_root = (F.col("conv") == root) & (F.col("depth") == 0)
    return summed.join(end_digests(ends), ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(is_root, none).otherwise(F.coalesce("parent", "conv")).alias("parent_conv_id"),
        "n_convs",
        (F.col("hung") + (F.col("place") > 1).cast("bigint")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
