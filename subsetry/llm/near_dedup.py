"""Near copies by the similarity of their shingles: SimHash classes and MinHash bands find pairs, exact sets verify them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import BROADCAST_IDS, SEED, _spread, near_duplicates

WORDS = 5
SIMILARITY = 0.8
#: Permutations, bands and permutations of each band, which bands share. A pair of similarity 0.8
#: has no band in common with probability 5e-5; one of 0.5 has with 0.2.
HASHES, BANDS, ROWS = 256, 64, 8
_RNG = np.random.default_rng(SEED)
_MULTIPLY = _RNG.integers(0, 2**31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _RNG.integers(0, 2**32, (HASHES, 1), dtype=np.uint32)
_BANDS = np.array([_RNG.choice(HASHES, ROWS, replace=False) for _ in range(BANDS)])
#: Shingles that are permuted at once.
_AT_ONCE = 4096
#: Pairs for each row of a key up to which all are compared at once.
PAIRS = 1


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the text's shingles, as signed longs.

    A-Z are lower-cased; words end at ASCII white space. A text of fewer words has one shingle,
    all its words.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    joined, n, last = b" ".join(found), max(1, len(found) - words + 1), min(words, len(found))
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)])
    ends = starts[last : last + n] - 1 if found else [0]
    pieces = [joined[a:b] for a, b in zip(starts[:n].tolist(), np.asarray(ends).tolist())]
    return common.distinct(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n).view(np.int64))


def bands(found: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles; equal sets have equal keys."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    high = (found.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(found), _AT_ONCE):
        h = (high[a : a + _AT_ONCE] ^ _XOR) * _MULTIPLY
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        least = np.minimum(least, h.min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least[_BANDS])]
    return np.array(keys, np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _lists(of: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(of)))


def _arrays(rows: DataFrame, keys: bool) -> DataFrame:
    """node and the text's bands (keys) or shingles of rows (node, text)."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                of = map(shingles, batch.column(1).to_pylist())
                found = [bands(s) for s in of] if keys else list(of)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found)], names=["node", "found"])

    return rows.mapInArrow(common.lean(run), "node long, found array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of pairs (node, top) whose similarity is at least least."""
    own = pairs.join(sets.withColumnRenamed("found", "a"), "node")
    tops = pairs.select("top").distinct().join(sets.select(F.col("node").alias("top"), F.col("found").alias("b")), "top")

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            a, b = batch.column(2), batch.column(3)
            ok = [similarity(a[i].values.to_numpy(), b[i].values.to_numpy()) >= least for i in range(batch.num_rows)]
            yield batch.select(["node", "top"]).filter(pa.array(ok, pa.bool_()))

    return common.staged(_spread(own, tops, "top", "node").select("node", "top", "a", "b").mapInArrow(common.lean(run), "node long, top long"), "similar")


def _covered(edges: DataFrame) -> DataFrame:
    """node of each of edges (node, top) that goes: one with an edge to a top that stays."""
    out = edges.select("node").limit(0)
    while edges.count():
        later = edges.select(F.col("node").alias("top")).distinct()
        gone = common.staged(edges.join(later, "top", "left_anti").select("node").distinct(), "gone")
        out = out.unionByName(gone)
        edges = common.staged(edges.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "top"), "top", "left_anti").select("node", "top"), "edges")
    return out


def _chosen(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of rows whose node is in nodes; their texts shuffle only if nodes are many."""
    nodes = nodes.select("node").distinct()
    return rows.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes, "node", "left_semi")


def _keyed(rows: DataFrame) -> DataFrame:
    """node and key, once each, of rows (node, text): the text's bands and its SimHash class."""
    bands_of = common.staged(_arrays(rows, True), "bands").select("node", F.explode("found").alias("key"))
    classes = common.staged(near_duplicates(rows, "node", "text", WORDS).select("node", F.xxhash64(F.lit("class"), "component_id").alias("key")), "classes")
    return bands_of.unionByName(classes)


def dropped(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """node of each of rows (node, id, text) that goes; a node is a document.

    Documents that share a key are compared: a band, or the class of the SimHash operator over the
    same shingles. Their order is by the sizes of their keys' groups, largest sum first, then by id
    (null first) and node; so the text that others were made from comes before its copies. In this
    order a document goes if it has the similarity least or more to one that stays.

    While keys have more than PAIRS pairs a row, a document that is the first of all its keys stays,
    those that share a key with it are compared with it, and the others wait; so a group of n
    copies costs n comparisons. What is left is compared pair by pair. That limit doubles each
    round, as a crowd of unlike documents in one band has no shorter way. Each round is
    written to the shared folder; the driver sees counts only.
    """
    keyed = _keyed(rows.select("node", "text"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = _spread(keyed, shared, "key", "node").groupBy("node").agg(F.sum("n").alias("mates"), F.collect_set("key").alias("keys"))
    ids = rows.groupBy("node").agg(F.first("id").alias("id"))
    live = common.staged(own.join(ids, "node").select("node", F.struct((-F.col("mates")).alias("mates"), "id", "node").alias("place"), "keys"), "live")
    sets = common.staged(_arrays(_chosen(rows.select("node", "text"), live).dropDuplicates(["node"]), False), "shingles")
    live = live.select("node", "place", F.explode("keys").alias("key"))
    out, limit = sets.select("node").limit(0), PAIRS * live.count()
    while True:
        sizes = live.groupBy("key").agg(F.min("place").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
        if (sizes.agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0) <= limit:
            break
        limit *= 2
        with_top = common.staged(_spread(live, sizes.select("key", F.col("top.node").alias("top")), "key", "node"), "tops")
        first = common.staged(with_top.groupBy("node").agg(F.min(F.col("node") == F.col("top")).alias("first")).where("first").select("node"), "first")
        pairs = with_top.where("node <> top").select("node", "top").distinct().join(first.select(F.col("node").alias("top")), "top", "left_semi")
        gone = _similar(common.staged(pairs.select("node", "top"), "pairs"), sets, least).select("node").distinct()
        out = out.unionByName(gone)
        live = common.staged(with_top.join(first.unionByName(gone), "node", "left_anti").select("node", "place", "key"), "live")
    other = live.select("key", F.col("place").alias("top_place"), F.col("node").alias("top"))
    pairs = _spread(live, other, "key", "node").where(F.col("top_place") < F.col("place"))
    edges = _similar(common.staged(pairs.select("node", "top").distinct(), "pairs"), sets, least)
    return out.unionByName(_covered(edges))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay: no two of them have the similarity least, and each that goes has it to one that stays.

    Null and empty texts are alike. Rows with equal id and text stay or go together. An empty
    table gives no rows.
    """
    common.tune(docs.sparkSession)
    (name,) = common.unused(docs, "node")
    text = common.text_of(docs, text_col)
    node = F.xxhash64(docs[id_col], text)
    out = common.staged(dropped(docs.select(node.alias("node"), docs[id_col].alias("id"), text.alias("text")), least).withColumnRenamed("node", name), "dropped")
    small = out.count() <= BROADCAST_IDS
    return docs.withColumn(name, node).join(F.broadcast(out) if small else out, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
