"""Merkle manifest of a dataset as a tree of SHA-256 midstates.

A leaf is the digest of a row's fields. Leaves of a group (a language) ascend by id; a
parent is the digest of the hexadecimal digests of ``fanout`` consecutive nodes, the last
run fewer. A hexadecimal digest is one whole block of SHA-256, so the state of the hash
before each child slot is eight words and nothing else. A parent retains a copy of all
these states. To fold a changed leaf, the state of its slot is resumed with the replacement
and the siblings to the right only; what stands left of the slot is never hashed again.

The tree is stored as subtrees of at most ``BLOCK`` nodes in a row, one row each (digests
and retained states of all its levels), built by tasks that hold one subtree at a time;
the roots of the subtrees are the leaves of the next round. Leaves get their places by a
range sort and a prefix sum over the sorted partitions, so a group of any size is spread
over all tasks. Digests and states are computed with numpy, a whole level at a time.

Defined cases: null fields count as ``-``; a null group is a group of its own, the first;
null ids come first in their group, and rows that share an id follow each other by leaf
digest; equal rows are equal leaves, each with its own proof; an empty text is a field of
length zero and a text of any length is hashed whole; an empty table has no root and gives
no rows; only the columns named are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckflow.session import materialize, materialize_measured

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a subtree's lowest level, rounded down to a power of the fan-out.
BLOCK = 1024

LEAVES = "grp string, pos long, total long, digest binary"
SUBTREE = "grp string, block long, total long, root binary, sizes array<int>, digests binary, states binary"
STEP = "struct<state:binary,left:binary,right:binary>"


# --- SHA-256 over columns of words ---------------------------------------------


def _fractions(root: int, count: int) -> np.ndarray:
    """The first 32 bits behind the point of the square or cube roots of the first primes."""
    primes, n = [], 2
    while len(primes) < count:
        if all(n % p for p in primes):
            primes.append(n)
        n += 1
    out = []
    for p in primes:
        scaled = p << (32 * root)
        x = int(round(scaled ** (1 / root)))
        while x**root > scaled:
            x -= 1
        while (x + 1) ** root <= scaled:
            x += 1
        out.append(x & 0xFFFFFFFF)
    return np.array(out, np.uint32)


START, ROUND = _fractions(2, 8), _fractions(3, 64)
_HEX = np.array([int.from_bytes(f"{b:02x}".encode(), "big") for b in range(256)], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one block each, (16, n) words; either may have one column for all."""
    w = list(block)
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        near = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
        far = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
        w.append(w[i - 16] + near + w[i - 7] + far)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[i] + ROUND[i : i + 1])
        s = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (c & (a ^ b)))
        a, b, c, d, e, f, g, h = t + s, a, b, c, d + t, e, f, g
    return state + np.stack(np.broadcast_arrays(a, b, c, d, e, f, g, h))


def as_block(digests: np.ndarray) -> np.ndarray:
    """The hexadecimal text of digests (8, n) as blocks (16, n)."""
    b = [(digests >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)]
    halves = [(_HEX[b[k]] << np.uint32(16)) | _HEX[b[k + 1]] for k in (0, 2)]
    return np.stack(halves, axis=1).reshape(16, -1)


def finish(state: np.ndarray, children: int) -> np.ndarray:
    """Digests of states that took so many children: the closing block holds the length only."""
    block = np.zeros((16, 1), np.uint32)
    block[0], block[15] = 0x80000000, children * 512
    return absorb(state, block)


def words(digests: list[bytes] | bytes) -> np.ndarray:
    """Digests or states of 32 bytes as (8, n) words."""
    data = digests if isinstance(digests, bytes) else b"".join(digests)
    return np.frombuffer(data, ">u4").astype(np.uint32).reshape(-1, 8).T


def as_bytes(of: np.ndarray) -> bytes:
    return of.T.astype(">u4").tobytes()


# --- subtrees ------------------------------------------------------------------


def levels_of(total: int, fanout: int) -> int:
    """Levels above ``total`` leaves."""
    n = 0
    while total > 1:
        total, n = -(-total // fanout), n + 1
    return n


def _grow(nodes: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Parents of a level, and the state before each slot of each: (fanout, 8, parents)."""
    n = nodes.shape[1]
    parents = -(-n // fanout)
    blocks = as_block(nodes)
    state = np.repeat(START[:, None], parents, axis=1)
    states = np.empty((fanout, 8, parents), np.uint32)
    out = np.empty((8, parents), np.uint32)
    for slot in range(fanout):
        states[slot] = state
        there = -(-(n - slot) // fanout) if n > slot else 0  # parents with a child in this slot
        if there:
            state = np.concatenate(
                [absorb(state[:, :there], blocks[:, slot::fanout]), state[:, there:]], axis=1
            )
    full = n // fanout
    if full:
        out[:, :full] = finish(state[:, :full], fanout)
    if full < parents:
        out[:, full:] = finish(state[:, full:], n - full * fanout)
    return out, states


def subtree(leaves: np.ndarray, levels: int, fanout: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """All levels of digests from the leaves up, and the retained states of each level of parents."""
    digests, states = [leaves], []
    for _ in range(levels):
        up, kept = _grow(digests[-1], fanout)
        digests.append(up)
        states.append(kept)
    return digests, states


@dataclass
class Subtree:
    """A stored subtree, read back."""

    digests: list[np.ndarray]
    states: list[np.ndarray]
    fanout: int

    @classmethod
    def read(cls, sizes: list[int], digests: bytes, states: bytes, fanout: int) -> Subtree:
        nodes, kept = words(digests), words(states)
        d, s, at, below = [], [], 0, 0
        for k, n in enumerate(sizes):
            d.append(nodes[:, at : at + n])
            at += n
            if k:
                s.append(kept[:, below : below + fanout * n].reshape(8, fanout, n).transpose(1, 0, 2))
                below += fanout * n
        return cls(d, s, fanout)

    def step(self, level: int, node: int) -> dict:
        """What a fold needs to go from a node of a level to its parent."""
        first, slot = node - node % self.fanout, node % self.fanout
        run = self.digests[level][:, first : first + self.fanout]
        state = self.states[level][slot][:, node // self.fanout]
        return {
            "state": as_bytes(state[:, None]),
            "left": as_bytes(run[:, :slot]),
            "right": as_bytes(run[:, slot + 1 :]),
        }

    def fold(self, nodes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Roots of the subtree if the leaf at each place of ``at`` alone were the given one."""
        k = self.fanout
        for level, kept in enumerate(self.states):
            row = self.digests[level]
            n, parent, slot = row.shape[1], at // k, at % k
            children = np.minimum(n - parent * k, k)
            state = absorb(kept[slot, :, parent].T, as_block(nodes))
            for right in range(1, k):
                more = slot + right < children
                if more.any():
                    state[:, more] = absorb(state[:, more], as_block(row[:, at[more] + right]))
            nodes = np.empty_like(nodes)
            for c in np.unique(children):
                nodes[:, children == c] = finish(state[:, children == c], int(c))
            at = parent
        return nodes

    def siblings(self, at: np.ndarray) -> list[bytes]:
        """The hexadecimal siblings of each leaf's way to the root, level by level, left to right."""
        k, parts = self.fanout, [[] for _ in at]
        for level in range(len(self.states)):
            row = self.digests[level]
            text = as_bytes(row).hex().encode()
            for one, node in zip(parts, (at // k**level).tolist()):
                first = node - node % k
                one.append(text[64 * first : 64 * node] + text[64 * (node + 1) : 64 * (first + k)])
        return [b"".join(p) for p in parts]


def climb(nodes: np.ndarray, path: list[dict]) -> np.ndarray:
    """Fold further along a path: each step's state, the replacement, the siblings to the right."""
    for step in path:
        state = absorb(words(step["state"]), as_block(nodes))
        right = words(step["right"])
        for k in range(right.shape[1]):
            state = absorb(state, as_block(right[:, k : k + 1]))
        nodes = finish(state, 1 + (len(step["left"]) + len(step["right"])) // 32)
    return nodes


def proof_text(path: list[dict]) -> bytes:
    return b"".join((step["left"] + step["right"]).hex().encode() for step in path)


# --- Spark ---------------------------------------------------------------------


def field(col: str | Column) -> Column:
    """A field of a leaf: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[str | Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(f) for f in fields]), 256))


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos`` in their ``grp`` by ``order`` and the ``total`` of the group, stored.

    A range sort spreads a group of any size; the places of a partition start at the count
    of the group in those before, of which there is one row per partition and group.
    """
    spread = nodes.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    keys = ["grp", *order, "salt"]
    placed = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    placed = materialize(placed.withColumn("row", F.monotonically_increasing_id()), "sorted_nodes")
    placed = placed.withColumn("part", F.shiftright("row", 33))
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    groups = Window.partitionBy("grp")
    before = groups.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "grp",
        "part",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(groups).alias("total"),
    )
    return placed.join(starts, ["grp", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def _subtrees(nodes: DataFrame, fanout: int, height: int, below: int) -> DataFrame:
    """One round: a stored row per run of nodes, with as many levels as its group still has."""
    span = fanout**height

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        total = group.column("total")[0].as_py()
        levels = min(height, levels_of(total, fanout) - below)
        digests, states = subtree(words(group.column("digest").to_pylist()), levels, fanout)
        return pa.table(
            {
                "grp": group.column("grp").slice(0, 1),
                "block": group.column("block").slice(0, 1),
                "total": group.column("total").slice(0, 1),
                "root": pa.array([as_bytes(digests[-1])], pa.binary()),
                "sizes": pa.array([[d.shape[1] for d in digests]], pa.list_(pa.int32())),
                "digests": pa.array([b"".join(map(as_bytes, digests))], pa.binary()),
                "states": pa.array(
                    [b"".join(as_bytes(s.transpose(1, 0, 2).reshape(8, -1)) for s in states)], pa.binary()
                ),
            }
        )

    keyed = nodes.select("grp", F.expr(f"pos div {span}").alias("block"), "pos", "total", "digest")
    return materialize(keyed.groupBy("grp", "block").applyInArrow(build, SUBTREE), "subtrees")


def height_of(fanout: int, block: int) -> int:
    """Levels of a subtree of at most ``block`` nodes."""
    n = 1
    while fanout ** (n + 1) <= block:
        n += 1
    return n


def _forest(nodes: DataFrame, largest: int, fanout: int, height: int) -> list[DataFrame]:
    """Rounds of subtrees until every group, the largest of so many nodes, has one root."""
    rounds, below = [], 0
    while True:
        rounds.append(_subtrees(nodes, fanout, height, below))
        below += height
        if below >= levels_of(largest, fanout):
            return rounds
        done = fanout**below  # groups of so many nodes have their root
        nodes = rounds[-1].filter(F.col("total") > done).select(
            "grp", F.col("block").alias("pos"), "total", F.col("root").alias("digest")
        )


def _roots(rounds: list[DataFrame], span: int) -> DataFrame:
    """``grp, digest, round``: the root of each group, from the round that reached it."""
    out = None
    for k, trees in enumerate(rounds):
        below, reach = span**k, span ** (k + 1)
        reached = F.col("total") <= reach
        if k:
            reached &= F.col("total") > below
        some = trees.filter(reached).select("grp", F.col("root").alias("digest"), F.lit(k).alias("round"))
        out = some if out is None else out.unionByName(some)
    return out


def _paths(trees: DataFrame, above: DataFrame, fanout: int, height: int) -> DataFrame:
    """``grp, block, path, subroot, top`` of every lowest node of a round, whose own path is ``above``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = Subtree.read(row["sizes"], row["digests"], row["states"], fanout)
                n = row["sizes"][0]
                paths = [
                    [tree.step(level, node // fanout**level) for level in range(len(tree.states))] + row["path"]
                    for node in range(n)
                ]
                first = row["block"] * fanout**height
                yield pa.RecordBatch.from_pydict(
                    {
                        "grp": pa.array([row["grp"]] * n, pa.string()),
                        "block": pa.array(range(first, first + n), pa.int64()),
                        "path": pa.array(paths, _STEPS),
                        "subroot": pa.array([row["subroot"]] * n, pa.binary()),
                        "top": pa.array([row["top"]] * n, pa.binary()),
                    }
                )

    joined = trees.select("grp", "block", "sizes", "digests", "states").join(above, ["grp", "block"])
    return joined.mapInArrow(rows, f"grp string, block long, path array<{STEP}>, subroot binary, top binary")


_STEPS = pa.list_(pa.struct([(name, pa.binary()) for name in ("state", "left", "right")]))


@dataclass
class Manifest:
    """``leaves`` with their places, ``trees`` round by round, and for every lowest subtree
    the path from its root up, its group's root and the dataset's root."""

    leaves: DataFrame
    trees: list[DataFrame]
    paths: DataFrame | None
    fanout: int
    height: int


def build(leaves: DataFrame, fanout: int = 2, block: int = BLOCK) -> Manifest:
    """The manifest of ``grp, doc_id, digest, …`` (a stored table); groups ascend by ``grp``.

    ``leaves`` may carry further columns, such as a replacement of the digest. The driver
    sees the size of the largest group and the number of groups.
    """
    height = height_of(fanout, block)
    placed, seen = materialize_measured(_numbered(leaves, ["doc_id", "digest"]), "leaves", largest=F.max("total"))
    if not seen["largest"]:
        return Manifest(placed, [], None, fanout, height)
    trees = _forest(placed, seen["largest"], fanout, height)
    roots = _roots(trees, fanout**height).select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest", "round")
    tops, count = materialize_measured(
        _numbered(materialize(roots, "roots"), ["of"]), "group_roots", largest=F.max("total")
    )
    over = _forest(tops, count["largest"], fanout, height)
    no_step, root = F.array().cast(f"array<{STEP}>"), F.col("root")
    paths = over[-1].select("grp", "block", no_step.alias("path"), root.alias("subroot"), root.alias("top"))
    for one in reversed(over):
        paths = _paths(one, paths, fanout, height)
    # A place among the groups' roots becomes the group, with its root at the end of a path.
    above = tops.join(paths.select(F.col("block").alias("pos"), "path", "top"), "pos").select(
        F.col("of").alias("grp"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "top", "round"
    )
    above = materialize(above, "group_paths")
    paths = None
    for k in range(len(trees) - 1, -1, -1):
        ended = above.filter(F.col("round") == k).drop("round")
        paths = ended if paths is None else _paths(trees[k + 1], paths, fanout, height).unionByName(ended)
    return Manifest(placed, trees, materialize(paths, "paths"), fanout, height)


PROOFS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def verify(manifest: Manifest, replaced: str = "replaced") -> DataFrame:
    """Fold the column ``replaced`` (a digest) of every leaf into the root, by retained states.

    Returns the untampered leaf, roots and proof of each row, the folded root, and whether
    it is the root.
    """
    spark, fanout = manifest.leaves.sparkSession, manifest.fanout
    if manifest.paths is None:
        return spark.createDataFrame([], PROOFS)
    span = fanout**manifest.height

    def fold(rows: pa.Table, trees: pa.Table) -> pa.Table:
        (tree,) = trees.to_pylist()
        held = Subtree.read(tree["sizes"], tree["digests"], tree["states"], fanout)
        at = rows.column("pos").to_numpy() % span
        folded = climb(held.fold(words(rows.column("replaced").to_pylist()), at), tree["path"])
        above, top = proof_text(tree["path"]), tree["top"].hex()
        proofs = [hashlib.sha256(p + above).hexdigest() for p in held.siblings(at)]
        data, n = as_bytes(folded).hex(), len(at)
        roots = [data[i : i + 64] for i in range(0, 64 * n, 64)]
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "leaf": pa.array([d.hex() for d in rows.column("digest").to_pylist()], pa.string()),
                "subroot": pa.array([tree["subroot"].hex()] * n, pa.string()),
                "root": pa.array([top] * n, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(roots, pa.string()),
                "verified": pa.array([r == top for r in roots], pa.bool_()),
            }
        )

    block = F.expr(f"pos div {span}").alias("block")
    rows = manifest.leaves.select("grp", block, "doc_id", "pos", "digest", F.col(replaced).alias("replaced"))
    trees = manifest.trees[0].select("grp", "block", "sizes", "digests", "states").join(manifest.paths, ["grp", "block"])
    keys = ["grp", "block"]
    return rows.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(fold, PROOFS)


def group_key(col: str) -> Column:
    """Orders groups by UTF-8 bytes, the null group first."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def leaves(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, group: str = "lang", changed: str = "n_chars") -> DataFrame:
    """Leaves of ``docs``, stored; rows where ``tampered`` holds are replaced by one with ``changed`` plus one."""
    other = [F.col(f) + 1 if f == changed else F.col(f) for f in fields]
    digest = leaf(list(fields))
    rows = docs.select(
        group_key(group).alias("grp"),
        F.col(fields[0]).cast("long").alias("doc_id"),
        digest.alias("digest"),
        F.when(F.coalesce(tampered, F.lit(False)), leaf(other)).alias("replaced"),
    )
    return materialize(rows, "leaf_digests").withColumn("replaced", F.coalesce("replaced", "digest"))
