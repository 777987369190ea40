"""SimHash near-dedup: fingerprints linked within a Hamming distance through vantage-point trees.

Equal fingerprints are one node. A tree deals all nodes out to shards: a node of the tree
holds a vantage fingerprint and a radius, and sends what lies within the radius to one
side, the rest to the other. By the triangle inequality two fingerprints that link differ
by no more than the threshold in their distance to the vantage, so a fingerprint from
beyond the radius visits the inner side only if it lies within the radius plus the
threshold. A tree is drawn from a bounded sample; shards that come out too large for a
task are dealt out again by trees drawn from them, until all fit, so the depth follows
the number of fingerprints at every size. Each shard then links the fingerprints at home
there with all of its own and its visitors, exactly, through a tree of its own.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlake.llm.arrow import mapper, text_bytes
from motorlake.llm.common import stored
from motorlake.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: A tree is drawn from so many fingerprints at most, and has a leaf for SAMPLE_LEAF of them at least.
SAMPLE = 1 << 16
SAMPLE_LEAF = 16
#: Fingerprints that should be at home in a shard, and rows, visitors included, that a task takes.
SHARD = 8192
SHARD_ROWS = 1 << 20
#: Fingerprints that should be at home in a leaf of a shard's own tree.
LEAF = 256
#: Vantage fingerprints tried at each node of a tree, on so many fingerprints of it.
TRIED = 12
TRIED_ON = 512
#: A node isn't split if a larger share than this would visit the other side.
MAX_VISITS = 0.6
#: Trees that go to all tasks at once when shards are dealt out again, and fingerprints that each is drawn from.
TREES = 256
RESAMPLE = 1 << 13
#: Rows walked through a tree at once, and rows in a part of a shard that no tree divides.
DEALT = 1 << 15
CELL = 1 << 15


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """Of UTF-8 text: the bits set in over half of the XXH64 values of its word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at : at + (1 << 16)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(shingles), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed bigint; null text counts as empty. ``also`` names bigint columns to carry."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in text_bytes(batch)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in also), pa.array(fps.view(np.int64))], ["doc_id", *also, "fp"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), *also, "text").mapInArrow(mapper(step), ", ".join(f"{c} bigint" for c in ("doc_id", *also, "fp")))


@dataclass(frozen=True)
class Node:
    """A leaf has no vantage."""

    leaf: int
    vantage: int = 0
    radius: int = 0
    inner: Node | None = None
    outer: Node | None = None


def build_tree(sample: np.ndarray, total: int, max_bits: int = MAX_BITS, leaf: int = LEAF, least: int = SAMPLE_LEAF) -> Node:
    """A vantage-point tree over sample fingerprints (uint64) that stand for ``total`` ones: ``leaf`` of them in a leaf, ``least`` of the sample."""
    chance = np.random.default_rng(7)
    leaves = iter(range(1 << 30))
    weight = total / max(1, len(sample))

    def split(own: np.ndarray) -> Node:
        if len(own) < 2 * least or len(own) * weight <= leaf:
            return Node(next(leaves))
        some = own if len(own) <= TRIED_ON else chance.choice(own, TRIED_ON, replace=False)
        best = None
        for vantage in chance.choice(own, min(TRIED, len(own)), replace=False):
            far = np.bitwise_count(some ^ vantage)
            for radius in np.unique(np.quantile(far, (0.35, 0.5, 0.65)).astype(int)):
                inside = (far <= radius).mean()
                visits = ((far > radius) & (far <= radius + max_bits)).mean()
                if 0.1 <= inside <= 0.9 and visits <= MAX_VISITS:
                    cost = visits + abs(inside - 0.5) / 2
                    if best is None or cost < best[0]:
                        best = (cost, int(vantage), int(radius))
        if best is None:
            return Node(next(leaves))
        _, vantage, radius = best
        inside = np.bitwise_count(own ^ np.uint64(vantage)) <= radius
        if inside.all() or not inside.any():
            return Node(next(leaves))
        return Node(-1, vantage, radius, split(own[inside]), split(own[~inside]))

    return split(np.unique(sample))


def places(tree: Node, fps: np.ndarray, home: np.ndarray | None = None, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) of each leaf that a fingerprint lives in or visits; those not at home only visit."""
    out = []
    todo = [(tree, np.arange(len(fps)), np.ones(len(fps), bool) if home is None else home)]
    while todo:
        node, rows, home = todo.pop()
        if not len(rows):
            continue
        if node.inner is None:
            out.append((rows, np.full(len(rows), node.leaf), home))
            continue
        far = np.bitwise_count(fps[rows] ^ np.uint64(node.vantage)).astype(np.int64)
        inside = far <= node.radius
        inner = far <= node.radius + max_bits
        outer = ~inside & home | ~home & (far > node.radius - max_bits)
        todo.append((node.inner, rows[inner], home[inner] & inside[inner]))
        todo.append((node.outer, rows[outer], home[outer]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def _link(label: np.ndarray, fps: np.ndarray, own: np.ndarray, all_: np.ndarray, max_bits: int) -> None:
    """Lower the labels of linked fingerprints to the smaller one, comparing each of rows ``own`` with each of rows ``all_``."""
    step = max(1, (1 << 20) // max(1, len(all_)))
    others = fps[all_]
    for at in range(0, len(own), step):
        part = own[at : at + step]
        i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ others[None, :]) <= max_bits)
        i, j = part[i], all_[j]
        other = i != j
        i, j = i[other], j[other]
        while len(i):
            for rows in (i, j):  # each row's label becomes its root
                root = label[rows]
                while (label[root] != root).any():
                    root = label[root]
                label[rows] = root
            a, b = label[i], label[j]
            apart = a != b
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def linked(fps: np.ndarray, home: np.ndarray, max_bits: int = MAX_BITS, leaf: int = LEAF) -> np.ndarray:
    """For each fingerprint of a shard the first one that it is linked with, through others or not; links need one end at home."""
    label = np.arange(len(fps))
    tree = build_tree(fps[home], int(home.sum()), max_bits, leaf)
    rows, leaves, at_home = places(tree, fps, home, max_bits)
    order = np.argsort(leaves, kind="stable")
    rows, leaves, at_home = rows[order], leaves[order], at_home[order]
    bounds = np.flatnonzero(np.diff(leaves, prepend=-1, append=-1))
    for a, b in zip(bounds, bounds[1:], strict=False):
        _link(label, fps, rows[a:b][at_home[a:b]], rows[a:b], max_bits)
    while (label[label] != label).any():
        label = label[label]
    return label


def _shard_links(max_bits: int, leaf: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["node", "home"], kind="stable").drop_duplicates("node", keep="last")
        label = linked(shard["fp"].to_numpy().view(np.uint64), shard["home"].to_numpy(), max_bits, leaf)
        nodes = shard["node"].to_numpy()
        found = nodes[label] != nodes
        return pd.DataFrame({"u": nodes[found], "v": nodes[label][found]})

    return run


def together(batches):
    """Batches of DEALT rows or more, so that walking through a tree pays."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, (None,)):
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(b.num_rows for b in held) >= DEALT):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []


ROWS = "shard bigint, node bigint, fp bigint, home boolean"


def deal(rows: DataFrame, trees: dict[int, Node], first: int, max_bits: int) -> DataFrame:
    """Deal the rows of some shards out to the leaves of a tree for each; leaves are numbered from ``first`` on, ``1 << 20`` numbers for a tree."""
    base = {shard: first + (n << 20) for n, shard in enumerate(sorted(trees))}
    sent = rows.sparkSession.sparkContext.broadcast((trees, base))

    def run(batches):
        known, start = sent.value
        for batch in together(batches):
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            for shard in np.unique(shards).tolist():
                part = batch.filter(pa.array(shards == shard))
                fps = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                at, leaves, home = places(known[shard], fps, part.column("home").to_numpy(zero_copy_only=False), max_bits)
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(start[shard] + leaves), taken.column("node"), taken.column("fp"), pa.array(home)], ["shard", "node", "fp", "home"])

    return rows.mapInArrow(run, ROWS)


def _drawn(rows: DataFrame, homes: dict[int, int], size: int, leaf: int, max_bits: int) -> dict[int, Node]:
    """A tree for each shard of ``homes`` (shard to fingerprints at home), drawn in the tasks from a hash sample of about ``size`` of each."""
    share = rows.sparkSession.createDataFrame([(s, min(1.0, size / n), n) for s, n in homes.items()], "shard bigint, share double, total bigint")
    some = rows.where("home").join(F.broadcast(share), "shard").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(np.sort(group["fp"].to_numpy().view(np.uint64)), int(group["total"].iloc[0]), max_bits, leaf)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})

    found = some.select("shard", "fp", "total").groupBy("shard").applyInPandas(draw, "shard bigint, tree binary").collect()
    return {r["shard"]: pickle.loads(bytes(r["tree"])) for r in found}


def dealt(nodes: DataFrame, max_bits: int = MAX_BITS, sample: int = SAMPLE, shard: int = SHARD, shard_rows: int = SHARD_ROWS) -> tuple[list[DataFrame], list[tuple[DataFrame, dict]]]:
    """Tables of (shard, node, fp, home): of shards that a task takes, and of larger ones that no tree divides, with their rows and homes.

    A round writes what it dealt out to the shared folder; shards of more than
    ``shard_rows`` rows are dealt out again in the next one, each by a tree drawn from it,
    TREES of them at once.
    """
    turn = nodes.select(F.lit(0).cast("bigint").alias("shard"), "node", "fp", F.lit(True).alias("home"))
    total = nodes.count()
    full, size, first = {0: (total, total)} if total else {}, sample, 1
    fit, dense = [], []
    while full:
        parts = []
        for at in range(0, len(full), TREES):
            some = {s: full[s] for s in sorted(full)[at : at + TREES]}
            own = turn.where(F.col("shard").isin([*some]))
            trees = _drawn(own, {s: homes for s, (_, homes) in some.items()}, size, shard, max_bits)
            divided = {s: tree for s, tree in trees.items() if tree.inner is not None}
            for place, whole in ((fit, {s: n for s, n in some.items() if s not in divided and n[0] <= shard_rows}), (dense, {s: n for s, n in some.items() if s not in divided and n[0] > shard_rows})):
                if whole:
                    left = own.where(F.col("shard").isin([*whole]))
                    place.append(left if place is fit else (left, whole))
            if divided:
                parts.append(stored(deal(own.where(F.col("shard").isin([*divided])), divided, first, max_bits), "vantage-shards"))
                first += len(divided) << 20
        if not parts:
            break
        turn = reduce(DataFrame.unionByName, parts)
        sizes = turn.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("home").alias("own")).where((F.col("n") > shard_rows) & (F.col("own") > 0))
        full, size = {r["shard"]: (r["n"], r["own"]) for r in sizes.collect()}, min(sample, RESAMPLE)  # shards, not fingerprints
        fit.append(turn.where(~F.col("shard").isin([*full])) if full else turn)
    return fit, dense


def grid(rows: DataFrame, sizes: dict[int, tuple[int, int]], cell: int) -> DataFrame:
    """(shard, i, j, node, fp, home): each shard's homes in parts i and rows in parts j of about ``cell`` rows, every two parts together."""
    ways = rows.sparkSession.createDataFrame([(s, -(-own // cell), -(-n // cell)) for s, (n, own) in sizes.items()], "shard bigint, homes int, alls int")
    known = rows.join(F.broadcast(ways), "shard")
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = known.where("home").select("shard", part("homes").alias("i"), every("alls").alias("j"), "node", "fp", "home")
    right = known.select("shard", every("homes").alias("i"), part("alls").alias("j"), "node", "fp", F.lit(False).alias("home"))
    return left.unionByName(right)


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS, sample: int = SAMPLE, shard: int = SHARD, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """(u, v) links between nodes (node, fp; distinct fp) that join exactly what lies within ``max_bits``; a spanning forest of each shard, not all pairs.

    Shards that no tree divides, all their fingerprints being about equally far from each
    other, are compared part by part.
    """
    fit, dense = dealt(nodes, max_bits, sample, shard, shard_rows)
    links = [rows.groupBy("shard").applyInPandas(_shard_links(max_bits, leaf), "u bigint, v bigint") for rows in fit]
    links += [grid(rows, sizes, max(1, min(CELL, shard_rows))).groupBy("shard", "i", "j").applyInPandas(_shard_links(max_bits, leaf), "u bigint, v bigint") for rows, sizes in dense]
    return reduce(DataFrame.unionByName, links) if links else nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).where("u <> v")


def simhash_groups(docs: DataFrame, max_bits: int = MAX_BITS, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (bigint), fingerprint (16 hex digits), component_id for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links, the document included. Null
    and empty texts, and texts without words, have fingerprint zero and link like any
    other. Rows of one doc_id with different texts belong to a component each. Null doc_ids
    are members, but never give a component its id; a component of such rows only has
    a null id. Other columns aren't read; an empty table gives none. With ``also``, names of
    bigint columns of ``docs``, rows have these too, and the component itself.
    """
    own = stored(fingerprints(docs, also), "fingerprints")
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "fingerprint-nodes")
    links = near_links(nodes.select(F.col("fp").alias("node"), "fp"), max_bits)
    groups = components(links).select(F.col("node").alias("fp"), "component")
    placed = nodes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = stored(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")  # a table of its own, so that a large component's rows are split over tasks
    named = placed.select("fp", "component").join(ids, "component").select("fp", "component_id", "component")
    return own.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *also, *(["component"] if also else []))
