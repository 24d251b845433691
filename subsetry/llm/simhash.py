"""SimHash fingerprints and near duplicates by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once.
_AT_ONCE = 100_000
#: Distinct fingerprints under one key of the first level beyond which the key is extended.
HOT = 200_000
#: Node pairs that are taken a level further at once, and leaf pairs compared at once.
_PAIRS = 200_000
#: A node of at most so many fingerprints is a leaf.
_LEAF = 8


def _view(hashes: np.ndarray, view: int) -> np.ndarray:
    """Hashes for another fingerprint of the same shingles; view 0 is the hash itself."""
    if view == 0:
        return hashes
    with np.errstate(over="ignore"):
        h = hashes + np.uint64(0x9E3779B97F4A7C15 * view % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def fingerprint_views(text: str, words: int = 3, views: int = 1) -> list[int]:
    """The text's 64-bit fingerprints, unsigned, each from other bits of the shingles' hashes.

    A-Z are lower-cased; words end at ASCII white space. A bit is 1 if it is set in over half
    the XXH64 hashes (seed 42; view 0) of the shingles, repeats included. A text of fewer
    words has one shingle, all its words; a text of none has fingerprint 0.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return [0] * views
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    last = min(words, len(found))
    hashes, ones = xxhash.xxh64_intdigest, np.zeros((views, BITS), np.int64)
    for a in range(0, n, _AT_ONCE):
        b = min(n, a + _AT_ONCE)
        pieces = [joined[x:y] for x, y in zip(starts[a:b].tolist(), (starts[a + last : b + last] - 1).tolist())]
        h = np.fromiter(map(hashes, pieces, repeat(SEED)), np.uint64, b - a)
        for v in range(views):
            ones[v] += np.unpackbits(_view(h, v).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return [int.from_bytes(np.packbits(o * 2 > n).tobytes(), "big") for o in ones]


def fingerprint(text: str, words: int = 3) -> int:
    return fingerprint_views(text, words)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, views: int = 1) -> DataFrame:
    """id and fps (the fingerprints as signed longs) of each row; null texts count as empty."""
    common.tune(docs.sparkSession)

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            fps = np.array([fingerprint_views(t, words, views) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * views, pa.int32()), pa.array(fps.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "fps"])

    own = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(common.lean(run), f"id {kind}, fps array<long>")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class TrieJoin:
    """Links among sorted distinct fingerprints, group by group: a forest of the components.

    Each group's fingerprints are the leaves of a binary trie, whose nodes are ranges of the
    sorted array. Node pairs go down together: a pair adds one to its differing bits where
    its nodes take different branches, and is dropped beyond the budget. Small nodes are
    compared directly. Pairs go down depth first in blocks, so that memory is bounded; a pair
    whose fingerprints all are in one component already is dropped, which keeps the work on a
    dense cloud of fingerprints far below the number of its pairs.
    """

    def __init__(self, fp: np.ndarray, starts: np.ndarray, budget: int):
        self.fp, self.budget, n = fp, budget, len(fp)
        self.label = np.arange(n)
        self.ones: dict[int, np.ndarray] = {}
        ends = np.append(starts[1:], n)
        big = ends - starts > 1
        lo, hi = starts[big], ends[big]
        self.stack = [(0, np.stack([lo, hi, lo, hi, np.zeros(len(lo), np.int64)]))] if len(lo) else []
        self.changes = np.arange(n)

    def _middle(self, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if depth not in self.ones:
            bit = (self.fp >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
        c = self.ones[depth]
        return hi - (c[hi] - c[lo])

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        label, changed = self.label, False
        while True:
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            a, b, la, lb, changed = a[differ], b[differ], la[differ], lb[differ], True
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                further = label[label]
                if np.array_equal(further, label):
                    break
                label = further
        self.label = label
        if changed:
            self.changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])

    def _compare(self, p: np.ndarray) -> None:
        """Directly: every pair across the two nodes of each pair of p."""
        lo1, hi1, lo2, hi2, _ = p
        n2 = hi2 - lo2
        n = (hi1 - lo1) * n2
        for a in range(0, len(n), max(1, _PAIRS // (_LEAF * _LEAF))):
            cut = slice(a, a + max(1, _PAIRS // (_LEAF * _LEAF)))
            m = n[cut]
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            own2 = np.repeat(n2[cut], m)
            i, j = np.repeat(lo1[cut], m) + at // own2, np.repeat(lo2[cut], m) + at % own2
            ok = (i < j) & (self.label[i] != self.label[j])
            i, j = i[ok], j[ok]
            ok = _popcount(self.fp[i] ^ self.fp[j]) <= self.budget
            self._union(i[ok], j[ok])

    def _down(self, depth: int, p: np.ndarray) -> None:
        one = (self.changes[p[1] - 1] == self.changes[p[0]]) & (self.changes[p[3] - 1] == self.changes[p[2]])
        p = p[:, ~(one & (self.label[p[0]] == self.label[p[2]]))]
        leaf = (p[1] - p[0] <= _LEAF) & (p[3] - p[2] <= _LEAF)
        self._compare(p[:, leaf])
        p = p[:, ~leaf]
        if not p.shape[1] or depth == BITS:
            return
        lo1, hi1, lo2, hi2, diff = p
        m1, m2 = self._middle(depth, lo1, hi1), self._middle(depth, lo2, hi2)
        cross = lo1 != lo2
        new = [
            np.stack([lo1, m1, lo2, m2, diff]), np.stack([m1, hi1, m2, hi2, diff]),
            np.stack([lo1, m1, m2, hi2, diff + 1]), np.stack([m1, hi1, lo2, m2, diff + 1])[:, cross],
        ]
        q = np.concatenate(new, axis=1)
        q = q[:, (q[1] > q[0]) & (q[3] > q[2]) & (q[4] <= self.budget)]
        q = q[:, ~((q[0] == q[2]) & (q[1] - q[0] == 1))]
        for a in range(0, q.shape[1], _PAIRS):
            self.stack.append((depth + 1, q[:, a : a + _PAIRS]))

    def run(self) -> np.ndarray:
        """Of each fingerprint, the index of its component's first member within its group."""
        while self.stack:
            self._down(*self.stack.pop())
        return self.label


def _block(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _joined(keyed: DataFrame, budget: int, parts: int) -> DataFrame:
    """Edges (u, v) of a forest for each key of (key, fp)."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in stream]
        if not got:
            return
        key, fp = (np.concatenate(x) for x in zip(*got))
        got.clear()
        fp = fp.astype(np.int64).view(np.uint64)
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        label = TrieJoin(fp, starts, budget).run()
        linked = np.flatnonzero(label != np.arange(len(fp)))
        for a in range(0, len(linked), 50_000):
            x = linked[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)), pa.array(fp[label[x]].view(np.int64))], names=["u", "v"])

    return keyed.repartition(parts, "key").mapInArrow(common.lean(run), "u long, v long")


def links(distinct: DataFrame, budget: int = 3, hot: int = HOT) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of fp within budget bits.

    With budget + 1 blocks of bits, a pair within budget has a block without a differing bit:
    the tries are joined below each value of each block, as keys of a shuffle. A key of more
    than hot fingerprints is extended by the blocks of its remaining bits in the same way, so
    a dense region spreads over many tasks and no pair is lost.
    """
    blocks = budget + 1
    width = BITS // blocks
    rows = distinct.count()
    parts = max(common.tasks_for(distinct.sparkSession), blocks * rows // 500_000 + 1)
    # a key holds its block's number above the block's value
    first = [F.lit(b << 32).bitwiseOR(_block(F.col("fp"), b * width, width)) for b in range(blocks)]
    keyed = distinct.select("fp", F.explode(F.array(*first)).alias("key"))
    if rows <= hot:
        return _joined(keyed.select("key", "fp"), budget, parts)
    large = common.staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"), "hot")
    cold = keyed.join(large, "key", "left_anti").select("key", "fp")
    # turned so that the block is on top, the other bits are the low ones
    sub, top = (BITS - width) // blocks, f"cast(shiftright(key, 32) as int) * {width} + {width}"
    turned = F.expr(f"shiftrightunsigned(fp, {top}) | shiftleft(fp, {BITS} - ({top}))")
    deeper = [F.xxhash64("key", F.lit(j), _block(F.col("turned"), j * sub, sub)) for j in range(blocks)]
    more = keyed.join(large, "key", "left_semi").withColumn("turned", turned).select("fp", F.explode(F.array(*deeper)).alias("key"))
    return _joined(cold, budget, parts).unionByName(_joined(more.select("key", "fp"), budget, parts))


#: Copies of each row on the small side of a join whose keys may be very uneven.
SALTS = 8


def _spread(many: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """many joined with one, which has a row for each key; the rows of a frequent key go to several tasks."""
    salted = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for each node of edges (u, v).

    Large and small stars in turn until nothing changes; each round is written to the shared
    folder, so lineage stays short. The driver sees a count and a checksum only.
    """
    known = common.staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        sign = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == before:
            return known.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                known.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = sign
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _spread(both, least, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        known = common.staged(
            _spread(large, small, "u", "v").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct(), "edges",
        )


def _edges(distinct: DataFrame, views: int, budget: int) -> DataFrame:
    """Edges (u, v) between nodes whose fingerprints link in any view, less those that follow."""
    if views == 1:
        return links(distinct.select("fp"), budget)
    out = None
    for v in range(views):
        own = distinct.select("fp", F.col("fps")[v].alias("view"))
        found = common.staged(components(links(own.select(F.col("view").alias("fp")).distinct(), budget)), "view")
        label = own.join(found, F.col("view") == F.col("node"), "left").select("fp", F.coalesce("component", "view").alias("label"))
        hubs = label.groupBy("label").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
        part = _spread(label, hubs, "label", "fp").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v"))
        out = part if out is None else out.unionByName(part)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3, views: int = 1) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of each row of docs.

    Two rows link if their fingerprints differ in at most budget bits; component_id is the
    smallest id that links lead to, the row's own included. With more views than one, rows
    link where those of any view do; the fingerprint is the first view's. Equal fingerprints
    are one node, so copies cost one row each. Null and empty texts have fingerprint 0 and
    link as others; of texts of any length all shingles count, so many at a time. A null id gets its
    component's smallest id, null where no member has one. Repeated rows stay. An empty table gives
    no rows; other columns are ignored.
    """
    node = F.col("fps")[0] if views == 1 else F.xxhash64("fps")
    rows = common.staged(fingerprints(docs, id_col, text_col, words, views).withColumn("fp", node), "fp")
    distinct = common.staged(rows.groupBy("fp").agg(F.min("id").alias("least"), F.first("fps").alias("fps")), "distinct")
    found = common.staged(components(_edges(distinct, views, budget)), "components")
    of = (
        found.join(distinct, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("least").alias("cid"))
    )
    linked = _spread(found, of, "component", "node").select(F.col("node").alias("fp"), "cid")
    every = distinct.join(linked, "fp", "left").select("fp", F.coalesce("cid", "least").alias("cid"))
    return _spread(rows, every, "fp", "id").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), F.col("cid").alias("component_id")
    )


#: Dropped ids, so many at most, that are broadcast (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3, views: int = 1) -> DataFrame:
    """The rows of docs that stay: of each group of near_duplicates, those with the smallest id.

    Rows with a null id stay. Rows that share an id count as one document and stay or go together.
    """
    found = near_duplicates(docs, id_col, text_col, words, budget, views)
    out = common.staged(found.groupBy(id_col).agg(F.max(F.col("component_id") == F.col(id_col)).alias("kept")).where("not kept").select(id_col), "dropped")
    small = out.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(out) if small else out, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
