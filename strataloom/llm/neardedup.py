"""Near-duplicate documents by banded SetSketch registers, likelihood estimates and exact verification.

1. Each text's shingle set is sketched; texts with equal word sequences are one class, so copies cost one sketch.
2. Band values deal classes into buckets. Each class is paired with the smallest class that it shares a bucket
   with; these stars, estimated by likelihood and verified on full shingle sets, join most of a group with as
   many pairs as it has members.
3. Where a bucket still holds several components, its members outside the star's component are compared, in
   blocks of bounded size, with the registers of all its other members; each pair is met in its first common
   band only. Members with a likely partner bring their texts to the block, which verifies its likely pairs on
   full shingle sets and puts out a spanning forest of its links: at most one row per member, never pairs.
4. Components of the links by alternating stars.

No link between classes is lost but by the bands' chance (7e-11 at the threshold). Pairs within a component
that earlier links have joined are never verified. Rows grow with members everywhere; what grows with the square
of a bucket's unjoined members is the comparison of registers, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.keyed import split_join
from .setsketch import FINE, M, ROWS, band_keys, estimate, fine_registers, registers, shingle_hashes, words_of
from .shared import alone, bounded_batches, stored

PERCENT = 85
#: How far below the threshold an estimate may lie and still be verified (some seven standard deviations).
MARGIN = 0.19
#: The same for the share of equal fine registers.
FINE_MARGIN = 0.11
#: Members outside the star's component that are compared with a bucket's members at once, and their bytes.
BLOCK, BLOCK_BYTES = 1_000, 8_000_000
#: Members of a bucket that a block meets in one task.
MEET = 50_000
#: Class rows (24 bytes) up to which they are broadcast to fetch texts; beyond, that join shuffles.
BROADCAST_CLASSES = 1_000_000


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), key (of the word sequence; null without words), n, bands, regs of each row."""
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("words")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, sizes, bands, regs = [], [], [], []
                for text in part.column(2).to_pylist():
                    words = words_of(text)
                    hashes = shingle_hashes(words)
                    r = registers(hashes)
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                    sizes.append(len(hashes))
                    bands.append(band_keys(r) if words else None)
                    regs.append(r.tobytes() if words else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(regs, pa.binary())],
                    names=["id", "th", "key", "n", "bands", "regs"],
                )

    return chosen.mapInArrow(sketch, "id long, th long, key binary, n long, bands array<long>, regs binary")


def _fine(texts: DataFrame) -> DataFrame:
    """cid, fine: further registers of candidates, from their texts (cid, t)."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("words")
        for batch in batches:
            made = [fine_registers(shingle_hashes(words_of(t))).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["cid", "fine"])

    return texts.select("cid", "t").mapInArrow(sketch, "cid long, fine binary")


def _with_ends(pairs: DataFrame, values: DataFrame, total: int) -> DataFrame:
    """Pairs x, y with the columns of both ends' values (by cid), named with x and y behind; an x may have many pairs."""
    names = [c for c in values.columns if c != "cid"]
    times = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("times"))
    own = values.join(times, F.col("cid") == F.col("x")).select("x", "times", *[F.col(c).alias(f"{c}x") for c in names])
    met = pairs.join(values.select(F.col("cid").alias("y"), *[F.col(c).alias(f"{c}y") for c in names]), "y")
    return split_join(met, own, "x", "times", total)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int, total: int) -> DataFrame:
    """The pairs x, y whose estimates lie within the margins of the threshold; classes has cid, n, regs, fine."""
    rows = _with_ends(pairs, classes.select("cid", "n", "regs", "fine"), total).select("x", "y", "nx", "ny", "regsx", "regsy", "finex", "finey")

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, nx, ny, rx, ry, fx, fy = (c.to_pylist() for c in batch.columns)
            kept = [
                i
                for i in range(len(x))
                if min(nx[i], ny[i]) * 100 >= percent * max(nx[i], ny[i])
                and (np.frombuffer(fx[i], np.uint8) == np.frombuffer(fy[i], np.uint8)).mean() >= percent / 100 - FINE_MARGIN
                and estimate(np.frombuffer(rx[i], np.uint16), np.frombuffer(ry[i], np.uint16), nx[i], ny[i])[0] >= percent / 100 - MARGIN
            ]
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(judge, "x long, y long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, total: int) -> DataFrame:
    """The pairs x, y whose shingle sets are similar enough."""
    rows = _with_ends(pairs, texts.select("cid", "t"), total).sortWithinPartitions("x")

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            kept = []
            for i, (x, tx, ty) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                if x != last:
                    last, held = x, shingle_hashes(words_of(tx))
                other = shingle_hashes(words_of(ty))
                common = len(np.intersect1d(held, other, assume_unique=True))
                if 100 * common >= percent * (len(held) + len(other) - common):
                    kept.append(i)
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    return rows.select("x", "y", "tx", "ty").mapInArrow(judge, "x long, y long")


@dataclass
class _Rows:
    """Columns of some rows of one bucket and block, with their registers."""

    cid: np.ndarray
    comp: np.ndarray
    stray: np.ndarray
    pos: np.ndarray
    n: np.ndarray
    regs: np.ndarray
    fine: np.ndarray

    def __len__(self) -> int:
        return len(self.cid)

    def part(self, which: slice | np.ndarray) -> _Rows:
        return _Rows(*(getattr(self, f.name)[which] for f in fields(self)))

    def with_more(self, other: _Rows) -> _Rows:
        return _Rows(*(np.concatenate((getattr(self, f.name), getattr(other, f.name))) for f in fields(self)))

    def partners(self, i: int, held: _Rows, percent: int) -> np.ndarray:
        """Places of the rows that stray i of `held` meets here first and may be linked with."""
        new = self.comp != held.comp[i]
        new &= ~self.stray | (self.cid > held.cid[i])
        new &= np.minimum(self.n, held.n[i]) * 100 >= percent * np.maximum(self.n, held.n[i])
        near = np.flatnonzero(new)
        near = near[(self.fine[near] == held.fine[i]).mean(axis=1) >= percent / 100 - FINE_MARGIN] if len(near) else near
        if len(near):
            first = (self.regs[near] == held.regs[i]).reshape(len(near), -1, ROWS).all(axis=2).argmax(axis=1)
            near = near[first == held.pos[i]]
        if len(near):
            near = near[estimate(held.regs[i], self.regs[near], held.n[i], self.n[near]) >= percent / 100 - MARGIN]
        return near


ROW = "b long, block long, role int, pos int, cid long, comp long, stray boolean"


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, _Rows, slice]]:
    """(bucket, block), role and rows of each run of a batch that is sorted by them."""
    names = ("b", "block", "role", "pos", "cid", "comp", "stray", "n")
    b, block, role, pos, cid, comp, stray, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
    regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, M)
    fine = np.frombuffer(b"".join(batch.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
    rows = _Rows(cid, comp, stray.astype(bool), pos, n, regs, fine)
    change = np.flatnonzero((np.diff(b) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
    for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(rows)], strict=True):
        if lo < hi:
            yield (int(b[lo]), int(block[lo])), int(role[lo]), rows.part(slice(lo, hi)), slice(lo, hi)


def _strays(members: DataFrame, n_members: int, labels: DataFrame, classes: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """Rows (ROW) of buckets and blocks that have a likely partner of another component there.

    members has b, pos, pivot, cid; labels has node, component. Each bucket's strays (outside its pivot's
    component) are dealt into blocks (role 0), and each block meets the bucket's members (role 1), in parts of MEET, as
    they stream by.
    """
    known = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    buckets = (
        known.groupBy("b")
        .agg(F.max(F.when(F.col("cid") == F.col("pivot"), F.col("comp"))).alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"))
        .where("lo <> hi")
        .select("b", "main", "size")
    )
    # a bucket may hold much of all rows: both joins by bucket are split
    met = split_join(known.drop("component"), stored(buckets, "buckets"), "b", "size", n_members, spread=("cid",))
    active = stored(met.withColumn("stray", F.col("comp") != F.col("main")).join(classes.select("cid", "n"), "cid").select("b", "pos", "cid", "comp", "stray", "n"), "active")
    own = F.col("stray").cast("long")
    size = F.ceil(F.greatest(F.sum(own) / block_rows, F.sum(own * (F.col("n") * 8 + 1000)) / BLOCK_BYTES))
    counts = active.groupBy("b").agg(size.cast("long").alias("blocks"), F.ceil(F.count(F.lit(1)) / MEET).alias("parts"), F.count(F.lit(1)).alias("size"))
    rows = split_join(active, stored(counts, "buckets"), "b", "size", n_members, spread=("cid",)).join(classes.select("cid", "regs", "fine"), "cid")
    cols = ("pos", "cid", "comp", "stray", "n", "regs", "fine")
    # a grid of blocks of strays and parts of the members; one number stands for both
    own, part = F.pmod(F.xxhash64("cid"), F.col("blocks")), F.pmod(F.xxhash64("cid", F.lit(1)), F.col("parts"))
    asked = rows.where("stray").withColumn("at", F.explode(F.expr("sequence(0L, parts - 1)"))).select("b", (own * F.col("parts") + F.col("at")).alias("block"), F.lit(0).alias("role"), *cols)
    met = rows.withColumn("at", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("b", (F.col("at") * F.col("parts") + part).alias("block"), F.lit(1).alias("role"), *cols)
    dealt = asked.union(met).repartition("b", "block").sortWithinPartitions("b", "block", "role", "cid")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("words")
        group, held, likely = None, None, np.zeros(0, bool)
        parts: list[tuple[tuple[int, int], int, _Rows]] = []

        def found() -> pa.RecordBatch:
            flat = [(np.full(len(r), g[0]), np.full(len(r), g[1]), np.full(len(r), role), r.pos, r.cid, r.comp, r.stray) for g, role, r in parts]
            parts.clear()
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            columns = [np.concatenate(c) for c in zip(*flat, strict=True)] if flat else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])

        for batch in batches:
            for this, role, rows, _ in _groups(batch):
                if this != group:
                    if group is not None and likely.any():
                        parts.append((group, 0, held.part(likely)))
                    group, held, likely = this, rows.part(slice(0, 0)), np.zeros(0, bool)
                if role == 0:
                    held = held.with_more(rows)
                    likely = np.zeros(len(held), bool)
                    continue
                met = np.zeros(len(rows), bool)
                for i in range(len(held)):
                    near = rows.partners(i, held, percent)
                    if len(near):
                        likely[i] = met[near] = True
                if met.any():
                    parts.append((this, 1, rows.part(met)))
            yield found()
        if group is not None and likely.any():
            parts.append((group, 0, held.part(likely)))
        yield found()

    return dealt.mapInArrow(compare, ROW)


def _forests(flagged: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Verified links x, y between components, a spanning forest of each bucket's block.

    Each likely pair of a block is verified on its full shingle sets, unless verified links of the block have joined
    its ends already.
    """
    rows = flagged.join(classes.select("cid", "n", "regs", "fine"), "cid").join(texts.select("cid", "t"), "cid")
    dealt = rows.select("b", "block", "role", "pos", "cid", "comp", "stray", "n", "regs", "fine", "t")
    dealt = dealt.repartition("b", "block").sortWithinPartitions("b", "block", "role", "cid")

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("words")
        group, held, sets = None, None, []
        above: dict[int, int] = {}  # a union-find over the block's components
        codes, known, marks = [], np.zeros(0, np.uint64), np.zeros(0, bool)

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        for batch in batches:
            xs, ys = [], []
            for this, role, rows, place in _groups(batch):
                own = [shingle_hashes(words_of(t)) for t in batch.column("t").slice(place.start, place.stop - place.start).to_pylist()]
                if this != group:
                    group, held, sets, above, codes = this, rows.part(slice(0, 0)), [], {}, []
                if role == 0:
                    held, codes = held.with_more(rows), []
                    sets += own
                    continue
                if not sets:
                    continue
                if not codes:
                    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
                    codes = np.split(flat, np.cumsum([len(s) for s in sets])[:-1])
                    marks = np.zeros(len(known) + 1, bool)
                likely: dict[int, list[int]] = {}
                for i in range(len(held)):
                    for k in rows.partners(i, held, percent).tolist():
                        likely.setdefault(k, []).append(i)
                for k, some in likely.items():
                    here = np.searchsorted(known, own[k])
                    here = here[known[np.minimum(here, len(known) - 1)] == own[k]]
                    marks[here] = True
                    for i in some:
                        a, b = root(int(held.comp[i])), root(int(rows.comp[k]))
                        if a == b:
                            continue
                        common = int(np.count_nonzero(marks[codes[i]]))
                        if 100 * common >= percent * (len(own[k]) + len(sets[i]) - common):
                            above[max(a, b)] = min(a, b)
                            xs.append(int(held.cid[i]))
                            ys.append(int(rows.cid[k]))
                    marks[here] = False
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return dealt.mapInArrow(link, "x long, y long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block_rows: int = BLOCK) -> DataFrame:
    """One row per row of docs: id_col (as long), n_shingles, component_id, kept, text_hash.

    Two texts are linked where 100 * |common shingles| >= percent * |all shingles|; component_id is the
    smallest id reachable. Texts without words (or null) are linked with nothing, not even each other.
    Repeated rows are copies of each other; kept is true for all rows that carry their component's id, and
    for rows without an id where the whole component has none. Empty tables give no rows; other columns are
    not read.
    """
    bounded_batches(docs.sparkSession)
    sk = stored(sketches(docs, id_col, text_col), "sketches")
    reps = stored(sk.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times")), "copies")
    total = reps.agg(F.sum("times")).first()[0] or 0
    # a group of copies may hold much of all rows: its key is met by broadcast
    chosen = split_join(sk, reps, "key", "times", total).where(F.col("id").eqNullSafe(F.col("rep"))).dropDuplicates(["key"])
    classes = stored(chosen.select(F.monotonically_increasing_id().alias("cid"), "key", "rep", "th", "n", "bands", "regs"), "classes")
    n_classes = classes.count()

    banded = classes.select("cid", "rep", F.posexplode("bands").alias("pos", "b"))
    # the smallest id of a group is its likeliest original, to which most of its members are linked
    buckets = banded.groupBy("b").agg(F.min(F.struct("rep", "cid")).alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    pivots = buckets.select("b", F.col("least.cid").alias("pivot"), F.col("least.rep").alias("pivot_rep"), "size")
    members = stored(split_join(banded.drop("rep"), pivots, "b", "size", n_classes * (M // ROWS)), "members")

    met = members.select("cid").distinct().join(classes.select("cid", "rep", F.col("th").alias("h")), "cid")
    met = stored(met, "candidates")
    few = met.count() <= BROADCAST_CLASSES
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    found = source.join(F.broadcast(met) if few else met, F.col("id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("h")))
    texts = stored(found.select("cid", "t").dropDuplicates(["cid"]), "texts")

    fine = stored(_fine(texts), "fine").withColumnRenamed("cid", "f_cid")
    known = classes.select("cid", "n", "regs").join(fine, F.col("cid") == F.col("f_cid")).drop("f_cid")

    # each class meets one pivot only, that with the smallest id; what other pivots could link is left to the strays
    first = members.where("cid <> pivot").groupBy("cid").agg(F.min(F.struct("pivot_rep", "pivot")).alias("p"))
    star = first.select(F.col("p.pivot").alias("x"), F.col("cid").alias("y"))
    star = stored(star, "stars")
    n_stars = star.count()
    links = stored(_verified(_likely(star, known, percent, n_stars), texts, percent, n_stars), "links")
    labels = connected_components(links, "x", "y")
    flagged = stored(_strays(members, members.count(), labels, known, percent, block_rows), "strays")
    more = stored(_forests(flagged, known, texts, percent).distinct(), "links")
    if more.isEmpty():
        final = labels
    else:
        final = connected_components(links.union(more), "x", "y")
    grouped = classes.select("cid", "key", "rep").join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("c", F.coalesce("component", "cid"))
    least = grouped.groupBy("c").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("size"))
    owner = split_join(grouped.select("key", "c"), least, "c", "size", n_classes).select("key", F.col("least").alias("component"))
    owner = stored(owner.join(reps.select(F.col("key").alias("k"), "times"), F.col("key") == F.col("k")).drop("k"), "owners")
    out = split_join(sk.select("id", "key", "n", "th"), owner, "key", "times", total, "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"),
        F.col("th").alias("text_hash"),
    ).select(id_col, "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col(id_col)).alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with its smallest id.

    Rows are dropped by an anti join with the ids and text hashes of the others, which is broadcast where it is
    small, so the kept texts are not shuffled. Equal rows of one id are reduced to one apart from the rest.
    """
    judged = stored(near_duplicates(docs, id_col, text_col, percent), "near-duplicates").withColumnRenamed(id_col, "j_id")
    gone = judged.where("not kept").select("j_id", "text_hash").distinct()
    again = judged.where("kept").groupBy("j_id", "text_hash").count().where("count > 1").select("j_id", "text_hash")

    whole = docs.select(F.struct("*").alias("row"))  # so that no column of docs clashes with those that it is met with

    def at(other: DataFrame, how: str) -> DataFrame:
        other = F.broadcast(other) if other.count() <= BROADCAST_CLASSES else other
        own, text = F.col(f"row.`{id_col}`").cast("long"), F.xxhash64(F.col(f"row.`{text_col}`"))
        return whole.join(other, own.eqNullSafe(F.col("j_id")) & text.eqNullSafe(F.col("text_hash")), how).select("row.*")

    if again.isEmpty():
        return at(gone, "left_anti")
    single = at(again, "left_semi").dropDuplicates([id_col, text_col])
    return at(gone.union(again), "left_anti").unionByName(single)
