"""Tries of conversation prefixes: double arrays per shard, shared upper nodes merged over all shards.

1. A turn is known by the first 16 bytes of the SHA-256 of its role and text; a conversation by the string of its turns,
   its path. Equal paths become one row with their number, smallest id and the digest of their ids, so that copies
   cost one path.
2. Paths are dealt by range and sorted. A shard is a run of them with a bounded number of turns; as a prefix's paths stand
   together, a prefix that all conversations share is split over shards like any other.
3. A shard numbers its turns densely, packs BASE and CHECK arrays, walks its paths through them for the nodes' members, and
   sums subtrees from the deepest level up. Only nodes on its first and last path can reach into other shards:
   their children there are summed up but themselves they are put out as shared; all other nodes are whole.
4. Shared nodes' members and whole children are added up over the shards. Subtree sums above them are sums along
   paths: each shared node counts on one of the paths that hold it, each path is summed from its end, and the
   sums of all paths through a node are its own. Shared nodes are twice a path per shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keyed import split_join
from .shared import bounded_batches, stored

#: Bytes of a turn in a path.
WIDTH = 16
#: Turns in a shard (some 300 bytes each while it is made); a longer path is a shard of its own.
SHARD_TURNS = 50_000
#: Turns that a task's paths hold.
TASK_TURNS = 1_000_000
#: Ids of a chunk of a node's ends: chunks are sorted lists, digests run over chunks in order.
CHUNK_IDS = 4_096
#: Free slots that are tried for a node's children before they go to the arrays' end.
TRIES = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """BASE and CHECK over paths of dense turn ids; node s's child by turn c is slot base[s] + c if check[it] = s.

    Paths are distinct and sorted. levels: per depth, the paths that reach it and their slots there.
    """

    def __init__(self, paths: list[np.ndarray]) -> None:
        self.base, self.check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
        self.check[0] = 0  # the root is its own parent
        self._free, self._end = 1, 1  # no slot below is free; none from here on is taken
        lengths = np.array([len(p) for p in paths], np.int64)
        starts = np.r_[0, np.cumsum(lengths)[:-1]] if len(paths) else np.zeros(0, np.int64)
        flat = np.concatenate(paths) if len(paths) else np.zeros(0, np.int64)
        here, slot = np.arange(len(paths)), np.zeros(len(paths), np.int64)
        self.levels = [(here, slot)]
        depth = 0
        while len(here := here[keep := lengths[here] > depth]):
            slot = slot[keep]
            turn = flat[starts[here] + depth]
            new = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (turn[1:] != turn[:-1])])  # first path of each child
            for own in np.split(new, np.flatnonzero(np.diff(slot[new])) + 1):
                self._place(int(slot[own[0]]), np.sort(turn[own]))
            slot = self.child(slot, turn)
            self.levels.append((here, slot))
            depth += 1

    def child(self, node: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Slots of the nodes' children by the turns; -1 where there is none."""
        to = self.base[node] + turn
        there = (to >= 0) & (to < len(self.check))
        found = np.where(there, to, 0)
        return np.where(there & (self.check[found] == node) & (found > 0), found, -1)

    def _place(self, node: int, turns: np.ndarray) -> None:
        """A base at which all of the node's turns meet free slots."""
        low = int(turns[0])
        while self._free < self._end and self.check[self._free] >= 0:
            self._free += 1
        window = self.check[self._free : min(self._end, self._free + 64 * TRIES)]
        for f in (np.flatnonzero(window < 0)[:TRIES] + self._free).tolist():
            slots = f - low + turns
            if (self.check[slots[: np.searchsorted(slots, self._end)]] < 0).all():
                break
        else:  # behind all that is taken
            slots = self._end - low + turns
        last = int(slots[-1]) + 1
        if last > len(self.check):
            size = max(last, 2 * self._end)
            self.base = np.r_[self.base, np.zeros(size - len(self.base), np.int64)]
            self.check = np.r_[self.check, np.full(size - len(self.check), -1, np.int64)]
        self._end = max(self._end, last)
        self.base[node] = int(slots[0]) - low
        self.check[slots] = node


def rebuilt(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 100, most: int = 5) -> DataFrame:
    """conv_id (long), path (binary), lens (code points of each turn's text) of each rebuilt conversation.

    Conversation c is the first h turns of conversation c - c % block, then its own from the h-th on; h is the crc32 of its
    decimal id modulo most + 1. Turns go by turn_col (nulls first), then role and text; null roles and texts are empty;
    rows without an id belong to no conversation.
    """
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    name = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    each = rows.withColumn("r", place).select("c", "r", F.substring(F.sha2(name.cast("binary"), 256), 1, 2 * WIDTH).alias("h"), F.length("text").alias("n"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("r", "h", "n"))), lambda t: F.struct(t["h"].alias("h"), t["n"].alias("n")))
    own = stored(each.groupBy("c").agg(turns.alias("turns")), "conversations")
    first = own.where(F.col("c") % block == 0).select(F.col("c").alias("b"), F.slice("turns", 1, most).alias("head"))
    heads = F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1)
    both = own.withColumns({"h": heads.cast("int"), "b_own": F.col("c") - F.col("c") % block}).join(first, F.col("b_own") == F.col("b"), "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    whole = both.select("c", F.concat(head, tail).alias("t"))
    path = F.unhex(F.array_join(F.transform("t", lambda t: t["h"]), ""))
    return whole.select(F.col("c").alias("conv_id"), path.alias("path"), F.transform("t", lambda t: t["n"].cast("long")).alias("lens"))


def _ends(conversations: DataFrame) -> DataFrame:
    """key, times, least, ends of each distinct path: its number of ids, the smallest, and the digest of all in order.

    Ids are first gathered in chunks of bounded size; a path's chunks then run through one digest in order, so a task holds
    a chunk and a digest's state, however many conversations are equal.
    """
    chunk = F.floor(F.col("conv_id") / CHUNK_IDS).cast("long")
    ids = F.array_sort(F.collect_list("conv_id"))
    listed = F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
    chunks = conversations.groupBy("key", chunk.alias("chunk")).agg(listed.alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    dealt = chunks.repartition("key").sortWithinPartitions("key", "chunk")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, times, least = None, hashlib.sha256(), 0, 0

        def row(rows: list) -> None:
            rows.append((key, times, least, state.hexdigest()))

        def out(rows: list) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "times", "least", "ends"])

        for batch in batches:
            rows: list[tuple] = []
            for k, _, ids, n, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        row(rows)
                    key, state, times, least = k, hashlib.sha256(), 0, low
                else:
                    state.update(b",")
                state.update(ids.encode())
                times += n
            yield out(rows)
        rows = []
        if key is not None:
            row(rows)
        yield out(rows)

    return dealt.mapInArrow(digest, "key string, times long, least long, ends string")


#: A node as its shard knows it. own, up: keys of it and its parent, of shared nodes and their whole children; path, depth:
#: where a shared node stands (twice, if it is on both of the shard's paths: then part 1 has no numbers).
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, shared boolean, own binary, up binary, path string, part int, last_len long"


def _chain(path: bytes, depth: int) -> list[bytes]:
    """Keys of a path's prefixes up to depth."""
    keys = [hashlib.sha256(b"root").digest()[:WIDTH]]
    for d in range(depth):
        keys.append(hashlib.sha256(keys[-1] + path[d * WIDTH : (d + 1) * WIDTH]).digest()[:WIDTH])
    return keys


def shard_nodes(name: str, paths: list[bytes], lens: list[np.ndarray], times: np.ndarray, least: np.ndarray, ends: list[str]) -> pa.RecordBatch:
    """Nodes (NODE) of a shard of distinct sorted paths."""
    turns = np.frombuffer(b"".join(paths), f"V{WIDTH}") if any(paths) else np.zeros(0, f"V{WIDTH}")
    sizes = np.array([len(p) // WIDTH for p in paths], np.int64)
    _, dense = np.unique(turns.view("u8").reshape(-1, WIDTH // 8), axis=0, return_inverse=True)
    dense = dense.reshape(-1)
    # numbers by depth and place of first use, so that siblings are numbered side by side
    depths = np.arange(len(turns)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64), sizes)
    by_depth = np.argsort(depths, kind="stable")
    seen, first = np.unique(dense[by_depth], return_index=True)
    ids = np.empty(len(seen), np.int64)
    ids[np.argsort(first, kind="stable")] = np.arange(len(seen))
    trie = DoubleArray(np.split(ids[dense], np.cumsum(sizes)[:-1]))
    slots = len(trie.check)
    n_convs, n_children, n_leaves, saved = (np.zeros(slots, np.int64) for _ in range(4))
    conv, depth, last_len, at_end = np.full(slots, np.iinfo(np.int64).max), np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.full(slots, -1, np.int64)
    for d, (here, slot) in enumerate(trie.levels):
        np.add.at(n_convs, slot, times[here])
        np.minimum.at(conv, slot, least[here])
        depth[slot] = d
        done = sizes[here] == d
        at_end[slot[done]] = here[done]
        if d:
            last_len[slot] = [lens[i][d - 1] for i in here.tolist()]
    nodes = np.flatnonzero(trie.check >= 0)
    nodes = nodes[np.argsort(depth[nodes], kind="stable")]
    shared = np.zeros(slots, bool)
    edges = {i: [slot[np.searchsorted(here, i)] for here, slot in trie.levels[: sizes[i] + 1]] for i in {0, len(paths) - 1}}
    for own in edges.values():
        shared[own] = True
    inner = nodes[nodes > 0]
    np.add.at(n_children, trie.check[inner], ~shared[inner])
    for d in range(len(trie.levels) - 1, -1, -1):  # whole nodes from the deepest level up; shared ones keep their whole children's sums
        level = np.unique(trie.levels[d][1])
        whole = level[~shared[level]]
        n_leaves[whole] += n_children[whole] == 0
        saved[whole] += (n_convs[whole] - 1) * last_len[whole]
        np.add.at(n_leaves, trie.check[whole], n_leaves[whole])
        np.add.at(saved, trie.check[whole], saved[whole])
    key: dict[int, bytes] = {}
    rows, extra = nodes, []
    where: dict[int, tuple[str, int]] = {}
    for i, own in edges.items():
        for s, k in zip(own, _chain(paths[i], int(sizes[i])), strict=True):
            key[int(s)] = k
            if int(s) in where:
                extra.append((int(s), f"{name}-{i}"))
            else:
                where[int(s)] = (f"{name}-{i}", 0)
    parents = trie.check[rows]
    up = [key.get(p) if s else None for s, p in zip(rows.tolist(), parents.tolist(), strict=True)]
    of_shared = shared[parents]
    columns = [
        pa.array(conv[rows]), pa.array(depth[rows]), pa.array(conv[parents], mask=of_shared), pa.array(n_convs[rows]), pa.array(n_children[rows]), pa.array(n_leaves[rows]), pa.array(saved[rows]),
        pa.array([ends[i] if (i := int(e)) >= 0 else NO_ENDS for e in at_end[rows]], pa.string()), pa.array(shared[rows]), pa.array([key.get(s) for s in rows.tolist()], pa.binary()), pa.array(up, pa.binary()),
        pa.array([where[s][0] if s in where else None for s in rows.tolist()], pa.string()), pa.array(np.zeros(len(rows), np.int32)), pa.array(last_len[rows]),
    ]
    names = [f.split()[0] for f in NODE.split(", ")]
    made = pa.RecordBatch.from_arrays(columns, names=names)
    if not extra:
        return made
    none = {"conv_id": [int(conv[s]) for s, _ in extra], "depth": [int(depth[s]) for s, _ in extra], "own": [key[s] for s, _ in extra], "up": [key.get(int(trie.check[s])) if s else None for s, _ in extra], "path": [p for _, p in extra], "last_len": [int(last_len[s]) for s, _ in extra]}
    more = [pa.array(none[n], made.schema.field(n).type) if n in none else pa.array([{"shared": True, "part": 1, "ends": NO_ENDS, "parent_conv_id": None}.get(n, 0)] * len(extra), made.schema.field(n).type) for n in names]
    return pa.Table.from_batches([made, pa.RecordBatch.from_arrays(more, names=names)]).combine_chunks().to_batches()[0]


def prefix_nodes(paths: DataFrame, n_turns: int, shard_turns: int = SHARD_TURNS, task_turns: int = TASK_TURNS) -> DataFrame:
    """The nodes of all shards (NODE); paths has path, lens, times, least, ends of distinct paths with n_turns turns."""
    parts = max(1, -(-n_turns // task_turns))
    spark = paths.sparkSession
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n_turns > shard_turns else 1
    dealt = paths.select("path", "lens", "times", "least", "ends").repartitionByRange(parts, "path").sortWithinPartitions("path")
    dealt = dealt.withColumn("task", F.spark_partition_id())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turns, shard = 0, 0

        def made() -> pa.RecordBatch:
            own, lens, times, least, ends, task = zip(*held, strict=True)
            return shard_nodes(f"{task[0]}-{shard}", list(own), list(lens), np.array(times, np.int64), np.array(least, np.int64), list(ends))

        for batch in batches:
            lens = batch.column(1)
            flat, cuts = lens.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(lens).to_numpy(zero_copy_only=False))
            for path, own, *rest in zip(batch.column(0).to_pylist(), np.split(flat, cuts[:-1]), *(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                if held and turns + len(own) > shard_turns:
                    yield made()
                    held, turns, shard = [], 0, shard + 1
                held.append((path, own, *rest))
                turns += len(own)
        if held:
            yield made()

    return dealt.mapInArrow(work, NODE)


def merge_nodes(found: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends of all nodes; found is stored."""
    shared = found.where("shared")
    one = shared.groupBy("own").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("up").alias("up"), F.first("last_len").alias("last_len"), F.min("path").alias("owner"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max(F.when(F.col("ends") != NO_ENDS, F.col("ends"))).alias("ends"), F.count(F.lit(1)).alias("times"),
    )
    one = stored(one, "shared-nodes")  # one row per shared node; a path that holds it, the first, counts it
    below = one.where("up is not null").groupBy(F.col("up").alias("u")).agg(F.count(F.lit(1)).alias("n_shared"))
    full = one.join(below, F.col("own") == F.col("u"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("n_shared", F.lit(0)))
    full = full.withColumns({"leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("last_len")})
    full = stored(full.select("own", "up", "owner", "conv_id", "depth", "n_convs", "n_children", "leaves", "saved", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends"), "times"), "shared-nodes")
    places = shared.select("own", "path", F.col("depth").alias("d"))
    total = places.count()
    # a node of many shards (the root is one of all) is split by path; each path is then summed from its end
    valued = split_join(places, full.select("own", "owner", "leaves", "saved", "times"), "own", "times", total)
    mine = F.col("path") == F.col("owner")
    ends_first = Window.partitionBy("path").orderBy(F.desc("d"))
    sums = {c: F.sum(F.when(mine, F.col(c)).otherwise(0)).over(ends_first) for c in ("leaves", "saved")}
    added = valued.select("own", *[s.alias(c) for c, s in sums.items()]).groupBy("own").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    upper = full.drop("leaves", "saved", "owner", "times").join(added.withColumnRenamed("own", "o"), F.col("own") == F.col("o")).drop("o")
    columns = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    whole = found.where("not shared")
    inside = whole.where("up is null").select(*columns, "parent_conv_id")
    asking = whole.where("up is not null").select(*columns, "up").unionByName(upper.select(*columns, "up"))
    times = asking.groupBy("up").agg(F.count(F.lit(1)).alias("times"))
    parents = times.join(full.select(F.col("own").alias("k"), F.col("conv_id").alias("parent_conv_id")), F.col("up") == F.col("k")).drop("k")
    asked = split_join(asking, parents, "up", "times", asking.count(), "left")
    return inside.unionByName(asked.select(*columns, "parent_conv_id"))


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see rebuilt); the root has depth 0.

    conv_id (smallest member), depth, parent_conv_id (of the parent; null for the root), n_convs (members), n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, (members - 1) times code points of the last
    text), ends_sha256 (of the ids of the conversations that end here, in order, comma-joined).

    Null turns stand first; null roles and texts are empty ones; equal turn numbers go by role and text, and repeated
    rows are turns each; rows without a conversation id belong to none; a conversation may end up without turns and
    is then a member of the root only. An empty table has no root and gives no rows. Other columns are not read. A
    conversation is one row (24 bytes a turn), as a document's text is.
    """
    bounded_batches(conversations.sparkSession)
    each = stored(rebuilt(conversations, id_col, turn_col, role_col, text_col).withColumn("key", F.sha2("path", 256)), "rebuilt")
    digests = _ends(each.select("key", "conv_id"))
    # the smallest id's row brings the path: equal paths meet nowhere
    paths = digests.join(each.select(F.col("conv_id").alias("c"), "path", "lens"), F.col("least") == F.col("c")).drop("c", "key")
    paths = stored(paths, "paths")
    n_turns = paths.agg(F.sum(F.size("lens"))).first()[0] or 0
    found = stored(prefix_nodes(paths, n_turns, shard_turns), "trie-nodes")
    return merge_nodes(found).withColumnRenamed("ends", "ends_sha256").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
