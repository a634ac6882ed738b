"""Operator 11 - the prefix trie of conversations, from sorted LCPs.

A conversation is the sequence of its turns' keys (16 bytes each).  All
sequences are sorted over range partitions; equal ones go by conv_id, so that
a group of copies with a third of all rows spans as many partitions as it needs.
In a partition, neighbours' common prefix lengths (LCPs) get a sparse table of
range minima, and each candidate prefix (a row and a depth) finds the extents of
its members by two binary searches, to the left and to the right, independent of
each other and of all other candidates.  A candidate whose left extent is its
own row names the node.

All sums over subtrees are differences of prefix sums over the sorted rows, as
a node's subtree is what its interval holds from its depth on.

A node whose members lie in several partitions has one piece in each.  Pieces
are added up by the node's key (a chained hash of its path).  What neighbouring
partitions count twice is the path that the last sequence of one shares with
the first of the next; its length comes from one row for each partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

KEY = 16                       # bytes of a turn's key and of a node's key
ROOT = b"\0" * KEY
END_IDS = 4096                 # ids in one piece of a node's list of ended conversations
TURNS_PER_SHARD = 200_000      # aimed at; a shard's keys and tables stay in one worker's memory

PIECE = ("shard int, node binary, parent binary, depth long, n_convs long, least long, tokens long, "
         "once long, leaves long, before long, at_left boolean, at_right boolean, first_seq array<binary>, "
         "first_bytes array<long>, last_seq array<binary>, ends array<struct<first:long,ids:string>>")


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that stand for (role, text)."""
    head = F.concat(F.octet_length(role).cast("string"), F.lit(":"))
    return F.unhex(F.md5(F.concat(head, role, text).cast("binary")))


def sequences(conversations: DataFrame, weight: Column | None = None) -> DataFrame:
    """(conv_id, seq, weights): each conversation's turn keys and turn weights (by
    default the UTF-8 bytes of the text) in order of turn.

    Texts are replaced by keys before the shuffle.  Rows go by turn, null first,
    rows of one turn by key.  Rows without a conv_id belong to no conversation and
    are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("has"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), turn_key(role, text).alias("key"),
        (F.octet_length(text) if weight is None else weight).cast("long").alias("weight"))
    turns = F.sort_array(F.collect_list(F.struct("has", "turn", "key", "weight")))
    return rows.groupBy("conv_id").agg(turns.alias("turns")) \
        .select("conv_id", F.col("turns.key").alias("seq"), F.col("turns.weight").alias("weights"))


def lcps(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """LCP of each sequence with the one in front of it (0 for the first)."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    at = np.arange(len(flat)) - starts[row]
    there = np.zeros(len(flat), bool)
    inside = (row > 0) & (at < sizes[row - 1])
    there[inside] = flat[np.flatnonzero(inside)] == flat[starts[row[inside] - 1] + at[inside]]
    out = np.minimum(sizes, np.concatenate([[0], sizes[:-1]]))    # if nothing differs
    off = np.flatnonzero(~there)
    if len(off):
        first_row, first = np.unique(row[off], return_index=True)
        out[first_row] = np.minimum(out[first_row], at[off[first]])
    out[:1] = 0
    return out


class SparseTable:
    """Range minima: level k holds the minima of all windows of 2^k values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (width := 1 << (len(self.levels) - 1)) <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-width], low[width:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values[lo..hi], both included, for lo <= hi."""
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            t = self.levels[level]
            out[at] = np.minimum(t[lo[at]], t[hi[at] + 1 - (1 << level)])
        return out


def extents(table: SparseTable, rows: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share each candidate's prefix of ``depths`` turns:
    binary searches for the outermost rows up to which the least LCP reaches it."""
    n = len(table.levels[0])
    left, right = rows.copy(), rows.copy()
    for k in range(len(table.levels) - 1, -1, -1):
        t, width = table.levels[k], 1 << k
        # rows left-width+1 .. left join row left-width to row left
        can = left - width >= 0
        can[can] = t[left[can] - width + 1] >= depths[can]
        left[can] -= width
        can = right + width < n
        can[can] = t[right[can] + 1] >= depths[can]
        right[can] += width
    return left, right


def _before(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def shard_pieces(ids: np.ndarray, flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> dict[str, list]:
    """Pieces of all nodes of one shard; rows are sorted by (sequence, id)."""
    n = len(ids)
    starts = _before(sizes)[:-1]
    lcp = lcps(flat, starts, sizes)
    table, by_id = SparseTable(lcp), SparseTable(ids)
    row = np.repeat(np.arange(n), sizes)
    depth = np.arange(len(flat)) - starts[row] + 1
    # candidates: each row at each depth, and the root at row 0
    c_row, c_depth = np.concatenate([[0], row]), np.concatenate([[0], depth])
    left, right = extents(table, c_row, c_depth)
    own = np.flatnonzero(left == c_row)
    c_row, c_depth, right = c_row[own], c_depth[own], right[own]

    # a row's new nodes are its depths behind its LCP; equal rows end a run
    fresh = depth > lcp[row]
    run_start = np.concatenate([[True], (lcp[1:] != sizes[1:]) | (sizes[1:] != sizes[:-1])])
    run_end = np.concatenate([np.flatnonzero(run_start)[1:], [n]])[np.cumsum(run_start) - 1]    # of each row's run
    deeper = np.concatenate([lcp[1:], [-1]])
    leaf = run_start & (deeper[run_end - 1] < sizes)  # nothing extends the run's sequence
    # a subtree: the node's own row from its depth on, then the rows behind up to the right extent
    sums = _before(weights)
    once = _before(np.where(fresh, weights, 0))
    row_once = once[starts + sizes] - once[starts]
    all_once, all_leaf = _before(row_once), _before(leaf)
    row_tail = sums[starts[c_row] + sizes[c_row]] - sums[starts[c_row] + np.maximum(c_depth - 1, 0)]
    piece_once = row_tail + all_once[right + 1] - all_once[c_row + 1]
    leaves = all_leaf[right + 1] - all_leaf[c_row]
    # every member's weights from the node's depth on: all of them less the shared path in front
    row_all = _before(sums[starts + sizes] - sums[starts])
    path = sums[starts[c_row] + np.maximum(c_depth - 1, 0)] - sums[starts[c_row]]
    members = right - c_row + 1
    tokens = row_all[right + 1] - row_all[c_row] - members * path

    chain, nodes, parents, ends = [ROOT], [], [], []
    keys = flat.tolist()
    for r, d in zip(c_row.tolist(), c_depth.tolist()):
        if d:
            del chain[d:]
            # numpy drops trailing zero bytes of a key
            chain.append(hashlib.md5(chain[-1] + keys[starts[r] + d - 1].ljust(KEY, b"\0")).digest())
        nodes.append(chain[d])
        parents.append(chain[d - 1] if d else None)
        ends.append([{"first": int(ids[i]), "ids": ",".join(map(str, ids[i:min(i + END_IDS, run_end[r])].tolist()))}
                     for i in range(r, run_end[r], END_IDS)] if d == sizes[r] and run_start[r] else [])
    return {"node": nodes, "parent": parents, "depth": c_depth.tolist(), "n_convs": members.tolist(),
            "least": by_id.least(c_row, right).tolist(), "tokens": tokens.tolist(),
            "once": piece_once.tolist(), "leaves": leaves.tolist(), "before": path.tolist(),
            "at_left": (c_row == 0).tolist(), "at_right": (right == n - 1).tolist(), "ends": ends}


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()

    ids, seqs = rows.column("conv_id").to_numpy(), rows.column("seq").chunk(0)
    sizes = pc.list_value_length(seqs).to_numpy().astype(np.int64)
    flat = np.array(seqs.flatten().to_pylist(), f"S{KEY}")
    weights = rows.column("weights").chunk(0).flatten().to_numpy().astype(np.int64)
    cols = shard_pieces(ids, flat, sizes, weights)
    n = len(cols["node"])
    shard = TaskContext.get().partitionId()
    ends_at = _before(sizes)

    def path(r):
        return [k.ljust(KEY, b"\0") for k in flat[ends_at[r]:ends_at[r + 1]].tolist()]
    edge = {"first_seq": path(0), "first_bytes": weights[:sizes[0]].tolist(), "last_seq": path(len(ids) - 1)}
    types = {"shard": pa.int32(), "node": pa.binary(), "parent": pa.binary(), "at_left": pa.bool_(), "at_right": pa.bool_(),
             "first_seq": pa.list_(pa.binary()), "first_bytes": pa.list_(pa.int64()), "last_seq": pa.list_(pa.binary()),
             "ends": pa.list_(pa.struct([("first", pa.int64()), ("ids", pa.string())]))}
    names = [f.split()[0] for f in PIECE.split(", ")]
    for lo in range(0, n, 10_000):
        hi = min(n, lo + 10_000)
        arrays = []
        for name in names:
            if name == "shard":
                v = [shard] * (hi - lo)
            elif name in edge:      # on the root's piece, the first of the shard
                v = [edge[name] if i == 0 else None for i in range(lo, hi)]
            else:
                v = cols[name][lo:hi]
            arrays.append(pa.array(v, types.get(name, pa.int64())))
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of id lists in order of (node, first id) -> a digest for each node."""
    now, sha = None, None
    for b in batches:
        nodes, out = [], []
        for node, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if node != now:
                if now is not None:
                    nodes.append(now)
                    out.append(sha.hexdigest())
                now, sha = node, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out)], names=["node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])],
                                         names=["node", "ends_sha256"])


def _shards(seqs: DataFrame) -> int:
    spark = seqs.sparkSession
    turns = seqs.agg(F.coalesce(F.sum(F.size("seq")), F.lit(0))).first()[0]
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-turns // TURNS_PER_SHARD))


def _edges(pieces: DataFrame) -> DataFrame:
    """(shard, shared, shared_before, twice): what a shard's first sequence shares with the
    last one in front (turns, and their weights), and whether the next shard goes on
    with this one's last sequence.  One row for each shard."""
    first = pieces.where(F.col("first_seq").isNotNull()).select("shard", "first_seq", "first_bytes", "last_seq")
    w = Window.orderBy("shard")
    same = F.zip_with(F.col("first_seq"), F.col("in_front"), lambda a, b: F.coalesce(a == b, F.lit(False)))
    differ = F.array_position(same, False)
    shared = F.when(F.col("in_front").isNull(), 0) \
        .when(differ > 0, differ - 1).otherwise(F.size("first_seq")).cast("int")
    return first.withColumn("in_front", F.lag("last_seq").over(w)).withColumn("shared", shared) \
        .withColumn("twice", F.coalesce((F.lead("shared").over(w) == F.size("last_seq"))
                                        & F.lead("shard").over(w).isNotNull(), F.lit(False))) \
        .select("shard", F.col("shared").cast("long").alias("shared"),
                F.aggregate(F.slice("first_bytes", F.lit(1), F.col("shared")), F.lit(0).cast("long"),
                            lambda a, x: a + x).alias("shared_weight"), "twice")


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) for every node of the trie over ``seqs(conv_id, seq, weights)``.

    A node is a distinct sequence of the first ``depth`` turns, its members all
    conversations that start with it; conv_id is the smallest member.
    saved_tokens sums (n_convs - 1) times the last turn's weight over the
    subtree.  ends_sha256 digests the ids of the members that end at the node.

    Defined cases: an empty table has no nodes; a conversation without turns is a
    member of the root; equal sequences are members of the same nodes;
    conv_ids should be distinct, and a repeated one counts as often as it stands
    there.  A conversation's keys, never its texts, are one record.
    """
    spark = seqs.sparkSession
    small_batches(spark)
    seqs = written(seqs)
    sorted_ = seqs.repartitionByRange(_shards(seqs), "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    pieces = written(sorted_.mapInArrow(_shard, PIECE))
    edges = F.broadcast(written(_edges(pieces)))       # one row for each shard
    twice_path = F.col("at_left") & (F.col("depth") <= F.col("shared"))
    own = pieces.drop("first_seq", "first_bytes", "last_seq", "ends").join(edges, "shard") \
        .withColumn("once", F.col("once") - F.when(twice_path, F.col("shared_weight") - F.col("before")).otherwise(0)) \
        .withColumn("leaves", F.col("leaves") - F.when(F.col("at_right") & F.col("twice"), 1).otherwise(0))
    nodes = written(own.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.min("least").alias("conv_id"), (F.sum("tokens") - F.sum("once")).alias("saved_tokens"),
        F.sum("leaves").alias("n_leaves")))
    ends = pieces.select("node", F.explode("ends").alias("e")).select("node", "e.first", "e.ids") \
        .repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    digests = ends.mapInArrow(_digest, "node binary, ends_sha256 string")
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, "parent", "left").join(kids, "node", "left").join(digests, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rebuilt(seqs: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations that share openings: the first h turns of conversation
    c - c % family (none if absent), then c's own turns after its first h, where
    h = crc32(c as text) % most."""
    seqs = written(seqs)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = seqs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, most - 1).alias("b_seq"),
                        F.slice("weights", 1, most - 1).alias("b_weights"))
    both = seqs.withColumn("h", h.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % family) \
        .join(heads, "base", "left")

    def glued(own: str, head: str) -> Column:
        front = F.when(F.col(head).isNull(), F.slice(F.col(own), 1, 0)).otherwise(F.slice(F.col(head), F.lit(1), F.col("h")))
        rest = F.when(F.size(own) > F.col("h"), F.slice(F.col(own), F.col("h") + 1, F.size(own))) \
            .otherwise(F.slice(F.col(own), 1, 0))
        return F.concat(front, rest)
    return both.select("conv_id", glued("seq", "b_seq").alias("seq"), glued("weights", "b_weights").alias("weights"))
