"""From band collisions to connected components, without emitting a group's pairs.

Rows of equal key share a bucket. Tasks send their (key, id, signature) rows packed, one row a slot of keys;
a bucket that is crowded within one task leaves it as a star around its least id, and only that id goes on.
Where a slot's rows meet, every member of a bucket is compared with the bucket's least id by signatures; a
member unlike it stays only if it is like another one. Stars are then tested exactly, so no more pairs are
tested than there are rows. Only a bucket that holds a failed pair, or an unlike member, may hide a link
between members of different components: those outside the bucket's largest component are compared with all
of it in cells of a bounded size, first by signatures alone, then exactly for the ids that have a likely
partner. Every pair of a bucket is either known to be connected or has been compared: the star loses no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.llm.components import connected_components
from orebed.storage import forget, materialize

#: Members on either side of a cell of the second round; a task holds one cell at a time.
BLOCK = 512

#: Rows that a task packs and sends together; slots of keys a partition; members from which a bucket within one task is sent as a star; buckets up to which unlike members are compared at once.
HELD, SLOTS, CROWDED, SMALL = 1 << 19, 4, 32, 4096

LOW_BITS = np.uint64(0x5555555555555555)

#: Kinds of packed rows: (key, id, signature), keys of crowded buckets, and (key, head, id, signature).
MEMBERS, CROWDS, STAR = range(3)

DEALT = "slot int, part int, kind int, rows binary"
STARS = "key long, head long, id long, far boolean, sig binary"


def pack(minima: np.ndarray) -> np.ndarray:
    """The two low bits of each minimum, 32 of them to a word: (..., 32 w) to (..., w)."""
    two = (minima & 3).astype(np.uint64).reshape(*minima.shape[:-1], -1, 32)
    return np.bitwise_or.reduce(two << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=-1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from packed signatures, corrected for the quarter of unequal minima that agree by chance."""
    x = a ^ b
    n = 32 * x.shape[-1]
    equal = n - np.bitwise_count((x | (x >> np.uint64(1))) & LOW_BITS).sum(axis=-1, dtype=np.int64)
    return (equal / n - 0.25) / 0.75


def signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A binary column of equally long rows as a matrix of uint64."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1) if rows else np.empty((0, 1), np.uint64)


class Dealer:
    """Packs a task's rows (key, id, signature) by slot of keys, as DEALT batches."""

    def __init__(self, partitions: int, words: int, least: float, likely: Callable) -> None:
        self.partitions, self.words, self.least, self.likely = partitions, words, least, likely
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        """keys: (rows, bands) uint64; ids: (rows,) int64; sig: (rows, words) uint64."""
        bands = keys.shape[1]
        rows = np.empty((keys.size, 2 + self.words), np.uint64)
        rows[:, 0] = keys.ravel()
        rows[:, 1] = np.repeat(ids.astype(np.int64).view(np.uint64), bands)
        rows[:, 2:] = np.repeat(sig, bands, axis=0)
        self.held.append(rows)
        self.n += len(rows)
        if self.n >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        rows = np.concatenate(self.held)
        self.held, self.n = [], 0
        rows, stars, crowded = self._thin(rows[np.argsort(rows[:, 0])])
        slots = self.partitions * SLOTS
        slot_of = lambda key: (key >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)
        yield from self._packed(MEMBERS, rows, slot_of(rows[:, 0]))
        yield from self._packed(CROWDS, crowded, slot_of(crowded))
        even = np.arange(len(stars), dtype=np.uint64) * np.uint64(self.partitions) // np.uint64(max(1, len(stars)))
        yield from self._packed(STAR, stars, even * np.uint64(SLOTS))  # these need not meet again

    def _packed(self, kind: int, rows: np.ndarray, slot: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        cuts = np.concatenate(([0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(slot)])).tolist()
        at = slot[cuts[:-1]].astype(np.int64)
        blobs = [rows[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int32()), "part": pa.array(at // SLOTS, pa.int32()), "kind": pa.array([kind] * len(at), pa.int32()), "rows": pa.array(blobs, pa.binary())})

    def _thin(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows sorted by key: those that go on, the stars (key, head, id, signature) of crowded buckets, and their keys."""
        cut = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0], [True])))
        keep, stars, crowded = np.ones(len(rows), bool), [], []
        for g in np.flatnonzero(np.diff(cut) >= CROWDED).tolist():
            lo, hi = cut[g], cut[g + 1]
            _, first = np.unique(rows[lo:hi, 1].view(np.int64), return_index=True)
            keep[lo:hi] = False
            keep[lo + first] = True
            if len(first) < CROWDED:
                continue
            one = rows[lo + first]  # by id: the first is the head
            near = self.likely(one[:, 2:], one[0, 2:]) >= self.least
            near[0] = True
            keep[lo + first[near][1:]] = False
            found = one[near]
            stars.append(np.column_stack((found[:, 0], np.full(len(found), one[0, 1]), found[:, 1:])))
            crowded.append(rows[lo, 0])
        return rows[keep], np.concatenate(stars) if stars else np.empty((0, 3 + self.words), np.uint64), np.array(crowded, np.uint64)


def _meet(rows: np.ndarray, crowds: np.ndarray, least: float, likely: Callable) -> tuple[np.ndarray, ...]:
    """Of one slot's rows: key, has_key, head, id, far, signature of the members of buckets that hold likely pairs.

    A bucket of two is a pair alone, without a key, since nothing else is in it. A bucket among `crowds` has
    other members, in stars: of such a one all members stay.
    """
    order = np.argsort(rows[:, 0])
    k = rows[order, 0]
    same = k[1:] == k[:-1]
    rows = rows[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
    rows = rows[np.lexsort((rows[:, 1].view(np.int64), rows[:, 0]))]
    rows = rows[np.concatenate((np.ones(min(1, len(rows)), bool), (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))]
    if not len(rows):
        none = np.empty(0, np.int64)
        return none, none.astype(bool), none, none, none.astype(bool), rows[:, 2:]
    cut = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0], [True])))
    size = np.diff(cut)
    more = (size > 2) | (size > 1) & np.isin(rows[cut[:-1], 0], crowds)
    has_key, head, size_of = np.repeat(more, size), np.repeat(cut[:-1], size), np.repeat(size, size)
    is_head = head == np.arange(len(rows))
    near = is_head | (likely(rows[:, 2:], rows[head, 2:]) >= least)
    keep = near & (size_of > 1) & (has_key | ~is_head)
    far = np.zeros(len(rows), bool)
    for h in np.unique(head[~near & has_key]).tolist():
        hi = h + int(size_of[h])
        out = np.flatnonzero(~near[h:hi]) + h
        if hi - h <= SMALL and rows[h, 0] not in crowds:
            out = np.array([i for i in out.tolist() if np.count_nonzero(likely(rows[h:hi, 2:], rows[i, 2:]) >= least) > 1], np.int64)
        keep[out] = far[out] = True
    left = np.add.reduceat(keep.astype(np.int64), cut[:-1])
    keep &= ~(is_head & np.repeat(left == 1, size) & has_key)  # a head that nothing is left around
    r = rows[keep]
    return r[:, 0].view(np.int64), has_key[keep], rows[head[keep], 1].view(np.int64), r[:, 1].view(np.int64), far[keep], r[:, 2:]


def _stars(least: float, likely: Callable, words: int) -> Callable:
    """STARS of DEALT rows sorted by slot."""

    def batch(key, has_key, head, ids, far, sig) -> pa.RecordBatch:
        flat = np.ascontiguousarray(sig).tobytes()
        width = 8 * words
        blobs = [flat[i : i + width] if h else None for i, h in zip(range(0, len(flat), width), has_key.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(key, mask=~has_key), pa.array(head), pa.array(ids), pa.array(far), pa.array(blobs, pa.binary())], ["key", "head", "id", "far", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowds, last = [], [], None

        def met() -> Iterator[pa.RecordBatch]:
            if held:
                yield batch(*_meet(np.concatenate(held), np.concatenate([*crowds, np.empty(0, np.uint64)]), least, likely))
            held.clear()
            crowds.clear()

        for b in batches:
            for slot, kind, blob in zip(b.column("slot").to_pylist(), b.column("kind").to_pylist(), b.column("rows"), strict=True):
                rows = np.frombuffer(blob.as_buffer(), np.uint64)
                if kind == STAR:
                    r = rows.reshape(-1, 3 + words)
                    yield batch(r[:, 0].view(np.int64), np.ones(len(r), bool), r[:, 1].view(np.int64), r[:, 2].view(np.int64), np.zeros(len(r), bool), r[:, 3:])
                    continue
                if slot != last:
                    yield from met()
                last = slot
                if kind == CROWDS:
                    crowds.append(rows.copy())
                else:
                    held.append(rows.reshape(-1, 2 + words).copy())
        yield from met()

    return run


class _Prepared(dict):
    """Texts made ready for the exact test, by id; forgotten all at once when there are many."""

    def __init__(self, prepare: Callable, most: int = 4 * BLOCK, size: int = 1 << 22) -> None:
        self.prepare, self.most, self.size, self.held = prepare, most, size, 0

    def of(self, i: int, text: Callable[[], str]) -> np.ndarray:
        if i not in self:
            if len(self) > self.most or self.held > self.size:
                self.clear()
                self.held = 0
            self[i] = self.prepare(text())
            self.held += len(self[i])
        return self[i]


def _tested(pairs: DataFrame, texts: DataFrame, prepare: Callable, similar: Callable) -> DataFrame:
    """(a, b, ok) of the pairs: whether their texts are similar by the exact test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _Prepared(prepare)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("ta"), batch.column("tb")
            ok = [similar(ready.of(a[i], lambda i=i: ta[i].as_py()), ready.of(b[i], lambda i=i: tb[i].as_py())) for i in range(len(a))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    one, two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, ok boolean")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table | None, list[tuple[int, int]]]]:
    """Tables of rows sorted by (key, x, y), and the (start, end) of the whole cells in each."""
    kept: pa.Table | None = None  # the cell that the next batch may go on with
    for b in _and_end(batches):
        t = kept if b is None else pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
        if t is None or not t.num_rows:
            continue
        key, x, y = (t.column(k).to_numpy() for k in ("key", "x", "y"))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        edges = [0, *cuts.tolist(), *([len(key)] if b is None else [])]
        yield t, list(zip(edges, edges[1:], strict=False))
        kept = t.slice(edges[-1]) if b is not None else None


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches with rows, then None."""
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def _likely_pairs(ids: np.ndarray, comp: np.ndarray, outside: np.ndarray, left: np.ndarray, sig: np.ndarray, least: float, likely: Callable) -> tuple[np.ndarray, ...]:
    """(likeness, i, j) of a cell's left rows with its right ones, of different components; two outsiders once."""
    rows, right = np.flatnonzero(left), np.flatnonzero(~left)
    near, one, two = [], [], []
    step = max(1, (1 << 16) // max(1, len(right)))
    for lo in range(0, len(rows), step):
        i = rows[lo : lo + step]
        apart = (comp[i][:, None] != comp[right]) & (~outside[right] | (ids[right] > ids[i][:, None]))
        p, q = np.nonzero(apart)
        if len(p):
            e = likely(sig[right[q]], sig[i[p]])
            hit = e >= least
            near.append(e[hit])
            one.append(i[p[hit]])
            two.append(right[q[hit]])
    if not near:
        return np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(near), np.concatenate(one), np.concatenate(two)


def _needed(least: float, likely: Callable) -> Callable:
    """Of cells' rows (key, x, y, id, component, outside, left, sig), those with a likely partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, spans in _cells(batches):
            ids, comp, outside, left = (t.column(k).to_numpy() for k in ("id", "component", "outside", "left"))
            sig, take = signatures(t.column("sig")), []
            for lo, hi in spans:
                _, i, j = _likely_pairs(ids[lo:hi], comp[lo:hi], outside[lo:hi], left[lo:hi], sig[lo:hi], least, likely)
                take.append(np.unique(np.concatenate((i, j))) + lo)
            at = np.concatenate(take) if take else np.empty(0, np.int64)
            if len(at):
                yield from t.take(pa.array(at)).to_batches()

    return run


def _exact(prepare: Callable, similar: Callable, least: float, likely: Callable) -> Callable:
    """Links of cells whose rows hold `text` as well: a forest over the components that each meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _Prepared(prepare)
        for t, spans in _cells(batches):
            ids, comp, outside, left = (t.column(k).to_numpy() for k in ("id", "component", "outside", "left"))
            sig, text, pairs = signatures(t.column("sig")), t.column("text"), []
            for lo, hi in spans:
                near, one, two = _likely_pairs(ids[lo:hi], comp[lo:hi], outside[lo:hi], left[lo:hi], sig[lo:hi], least, likely)
                head: dict[int, int] = {}

                def find(c: int, head: dict[int, int] = head) -> int:
                    while (up := head.get(c, c)) != c:
                        head[c] = head.get(up, up)
                        c = up
                    return c

                for k in np.argsort(-near, kind="stable").tolist():  # the likeliest first, so that few tests fail
                    i, j = int(one[k]) + lo, int(two[k]) + lo
                    p, q = find(int(comp[i])), find(int(comp[j]))
                    if p != q and similar(ready.of(int(ids[i]), lambda i=i, text=text: text[i].as_py()), ready.of(int(ids[j]), lambda j=j, text=text: text[j].as_py())):
                        head[max(p, q)] = min(p, q)
                        pairs.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    return run


def _placed(stars: DataFrame, bad: DataFrame, first: DataFrame) -> DataFrame:
    """(key, id, sig, component) of the members of `bad` buckets."""
    m = stars.where("key IS NOT NULL").join(bad, "key", "left_semi")
    m = m.repartition("key", "id").groupBy("key", "id").agg(F.min("sig").alias("sig"))  # a hot key's join can be split, and its rows part here
    return m.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _second_round(m: DataFrame) -> DataFrame:
    """Rows (key, x, y, id, component, outside, left, sig) of the cells in which buckets of several components are compared."""
    sizes = m.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).where("n > most.n")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select("key", F.col("most.component").alias("home"), blocks(F.col("n") - F.col("most.n")).alias("xs"), blocks(F.col("n")).alias("ys"))
    sizes = materialize(sizes, "sizes")  # else the join would share the aggregate's shuffle, and a hot key could not be split
    m = m.join(sizes, "key").withColumn("outside", F.col("component") != F.col("home"))
    dealt = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ("id", "component", "outside", "left", "sig")
    right = m.withColumn("left", F.lit(False)).select("key", every("xs").alias("x"), dealt("y", "ys").alias("y"), *columns)
    left = m.where("outside").withColumn("left", F.lit(True)).select("key", dealt("x", "xs").alias("x"), every("ys").alias("y"), *columns)
    return left.unionByName(right)


def link(dealt: DataFrame, texts: Callable[[DataFrame], DataFrame], prepare: Callable, similar: Callable, least: float, words: int, likely: Callable = estimate) -> DataFrame:
    """(id, component) of all ids that are linked with another; the rest are components of their own.

    dealt: DEALT rows that a Dealer made for as many partitions as `partitions` gives. texts: takes (id), returns
    (id, text) of those. prepare, similar: the exact test on two texts. likely: likeness of signatures of `words`
    64-bit words, by default the b-bit estimate of those that `pack` made. least: the likeness below which a pair
    is no candidate; set it far enough under the threshold. Nothing of a null id may be dealt; no rows give none.
    """
    spark = dealt.sparkSession
    met = dealt.repartitionById(partitions(dealt), F.col("part")).sortWithinPartitions("slot")
    stars = materialize(met.mapInArrow(_stars(least, likely, words), STARS), "stars")
    described = materialize(texts(stars.select("id").unionByName(stars.where("key IS NULL").select(F.col("head").alias("id"))).distinct()), "described")
    pairs = stars.where("NOT far AND head <> id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    tested = materialize(_tested(pairs, described, prepare, similar), "tested")
    first = connected_components(tested.where("ok").select("a", "b"))
    failed = tested.where("NOT ok").select(F.col("a").alias("head"), F.col("b").alias("id"))
    bad = stars.where("key IS NOT NULL").join(failed, ["head", "id"], "left_semi").select("key").unionByName(stars.where("far").select("key"))
    bad = materialize(bad.distinct(), "bad")
    if bad.isEmpty():
        forget(spark, stars, described, tested, bad)
        return first
    placed = materialize(_placed(stars, bad, first), "placed")
    cells = _second_round(placed)
    together = lambda df: df.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "left", "id")
    needed = materialize(together(cells).mapInArrow(_needed(least, likely), cells.schema), "needed")
    if needed.isEmpty():
        forget(spark, stars, described, tested, bad, placed, needed)
        return first
    more = together(needed.join(described, "id").select(*cells.columns, "text"))
    more = materialize(more.mapInArrow(_exact(prepare, similar, least, likely), "a long, b long").distinct(), "links")
    forget(spark, stars, described, tested, bad, placed, needed)
    stays = first.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return connected_components(stays.unionByName(more))


def partitions(df: DataFrame) -> int:
    """Partitions among which slots are dealt: those of the session's shuffles."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
