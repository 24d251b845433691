import hashlib
import random
import string

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from subsetry.llm import exact_dedup, lz_fingerprint, simhash
from subsetry.llm.queries import ORACLES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def groups(ids, linked):
    """Smallest index of each component."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(ids))]


def near(fps, budget):
    return [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= budget) if j > i]


def plain_fingerprint(text, words=3):
    """The definition, word by word and bit by bit."""
    found = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text.translate(LOWER)) if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(monkeypatch):
    monkeypatch.setattr(simhash, "_AT_ONCE", 7)
    rng = random.Random(1)
    for _ in range(150):
        t = "".join(rng.choices(["a", "B", "É", " ", "\n", "\x0b", " ", "word", "\x1c", "ß"], k=rng.randint(0, 60)))
        assert simhash.fingerprint(t) == plain_fingerprint(t), repr(t)


def test_near_duplicates(spark, docs, local, odd):
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = np.array([simhash.fingerprint(t) for _, t in local], np.uint64)
    ids = [i for i, _ in local]
    found = groups(ids, near(fps, 3))
    for k, i in enumerate(ids):
        assert rows[i].fingerprint == f"{int(fps[k]):016x}" and rows[i].component_id == ids[found[k]]
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {r.fingerprint for r in rows if r.doc_id in (3, 4)} == {"0" * 16}
    assert {r.component_id for r in rows if r.doc_id in (3, 4)} == {3} and [r.component_id for r in rows if r.fingerprint == "0" * 16 and r.doc_id is None] == [3]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 3, 5, 7, 9}


def test_views(spark, docs, local):
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, budget=5, views=3).collect()}
    fps = np.array([simhash.fingerprint_views(t, views=3) for _, t in local], np.uint64)
    assert [int(x) for x in fps[:, 0]] == [simhash.fingerprint(t) for _, t in local]
    ids = [i for i, _ in local]
    found = groups(ids, [p for v in range(3) for p in near(fps[:, v], 5)])
    assert [rows[i] for i in ids] == [ids[k] for k in found]


@pytest.mark.parametrize(("budget", "hot"), [(3, 10**9), (3, 20), (5, 10**9), (5, 20)])
def test_trie_join_equals_brute_force(spark, budget, hot):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    rows = [base, np.array([0, 2**64 - 1], np.uint64)]
    for flips in range(1, 5):
        x = base[rng.integers(0, 8, 250)]
        for _ in range(flips):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64))
        rows.append(x)
    fps = np.unique(np.concatenate(rows))
    df = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    label = {r.node: r.component for r in simhash.components(simhash.links(df, budget, hot)).collect()}
    own = [label.get(int(x), int(x)) for x in fps.view(np.int64)]
    expected = groups(fps, near(fps, budget))
    pairs = set(zip(own, expected))
    assert len(pairs) == len(set(own)) == len(set(expected))


def test_dense_cloud_is_cheap():
    """A ball of fingerprints: fewer comparisons than pairs, one component."""
    rng = np.random.default_rng(0)
    x = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 20_000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20_000).astype(np.uint64)))
    assert set(simhash.TrieJoin(x, np.array([0]), 3).run()) == {0}


def test_exact(spark, docs, odd):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    expected = sorted(con.sql(ORACLES["op9_exact_dedup"]).fetchall())
    assert sorted(map(tuple, exact_dedup.duplicate_groups(docs).collect())) == expected
    rows = exact_dedup.duplicate_groups(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r.text_sha256, []).append(r)
    for i, t in [(1, "same text here"), (5, "É same"), (6, "é same"), (3, "")]:
        own = by[hashlib.sha256(t.encode()).hexdigest()]
        assert sum(r.kept for r in own) == 1 and {r.group_size for r in own} == {len(own)} and i in {r.doc_id for r in own}
    same = by[hashlib.sha256(b"same text here").hexdigest()]
    assert len(same) == 4 and {r.keep_id for r in same} == {2}
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(by)
    assert sorted(kept.where("lower(text) = 'same text here'").toPandas().doc_id) == [2]
    assert exact_dedup.duplicate_groups(odd.limit(0)).count() == exact_dedup.keep_one(odd.limit(0)).count() == 0


def test_filter_marks_every_repeat(spark):
    rng = random.Random(4)
    rows = [(i, f"t{rng.randint(0, 3000)}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (16, 0.01):  # the second: a filter that is far too small stays right
        marked = {r.doc_id for r in exact_dedup.marked(df, "text", "m", bits).where("m").collect()}
        count = pd.Series([t for _, t in rows]).value_counts()
        assert {i for i, t in rows if count[t] > 1} <= marked
        if bits == 16:
            assert len(marked) < sum(count[t] > 1 for _, t in rows) + 300


def test_exact_is_native(docs):
    for df in (exact_dedup.duplicate_groups(docs), exact_dedup.keep_one(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def plain_phrases(text):
    seen, a, out = set(), 0, set()
    for b in range(1, len(text) + 1):
        if text[a:b] not in seen:
            seen.add(text[a:b])
            out.add(text[a:b])
            a = b
    return out


def test_phrases_and_likeness():
    rng = random.Random(6)
    for _ in range(100):
        a = "".join(rng.choices("abé ", k=rng.randint(0, 300)))
        tail = "".join(rng.choices("xyz", k=len(a) // 4))
        bins, edited, other = lz_fingerprint.with_edited(a, tail)
        assert edited == a[: len(a) - len(a) // 4] + tail
        assert (bins == lz_fingerprint.fingerprint(a)).all() and (other == lz_fingerprint.fingerprint(edited)).all()
        seen: set = set()
        lz_fingerprint.phrases(a, seen)
        assert seen == plain_phrases(a)
    x, y = ("".join(rng.choices("abcdefgh ", k=20_000)) for _ in range(2))
    both = x[:15_000] + y[:5_000]
    p, q = plain_phrases(x), plain_phrases(both)
    assert abs(lz_fingerprint.likeness(lz_fingerprint.fingerprint(x), lz_fingerprint.fingerprint(both)) - len(p & q) / len(p | q)) < 0.2


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_compare(spark, docs, local, odd, parts):
    rows = {r.doc_id: r for r in lz_fingerprint.compare(docs, parts=parts).collect()}
    assert len(rows) == len(local)
    for k, (i, t) in enumerate(local):
        after = local[(k + 1) % len(local)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b, c = map(lz_fingerprint.fingerprint, (t, edited, after))
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].fingerprint == lz_fingerprint.as_text(a) and rows[i].edited_fingerprint == lz_fingerprint.as_text(b)
        assert rows[i].near_edited == pytest.approx(lz_fingerprint.likeness(a, b)) and rows[i].near_next == pytest.approx(lz_fingerprint.likeness(a, c))
    assert lz_fingerprint.compare(odd, parts=parts).count() == odd.count()
    assert lz_fingerprint.compare(odd.limit(0), parts=parts).count() == 0
    (one,) = lz_fingerprint.compare(odd.where("doc_id = 1"), parts=parts).collect()
    assert one.near_next == 1.0
