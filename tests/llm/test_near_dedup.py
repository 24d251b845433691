import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from subsetry.llm import near_dedup, simhash


def plain_shingles(text):
    found = text.lower().split()
    return {" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def alike(a, b):
    return len(a & b) / len(a | b) >= 0.8


def plain_kept(rows, classes):
    """Of (id, text), in the order of their mates, those that are less than 0.8 alike to all that are kept before."""
    keys = {i: {*near_dedup.bands(near_dedup.shingles(t)).tolist(), ("class", classes[i])} for i, t in rows}
    size = Counter(k for own in keys.values() for k in own)
    kept = []
    for i, t in sorted(rows, key=lambda r: (-sum(size[k] for k in keys[r[0]] if size[k] > 1), r[0])):
        own = plain_shingles(t)
        if not any(alike(own, other) for _, other in kept):
            kept.append((i, own))
    return {i for i, _ in kept}


def copies(n, words, seed):
    """Texts of a few originals, each with up to words of its words replaced."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(8)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, words)):
            t[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize("pairs", [16, 0])
def test_near_stage_is_by_shingle_similarity(spark, monkeypatch, pairs):
    monkeypatch.setattr(near_dedup, "PAIRS", pairs)
    rows = [*copies(120, 5, 1), (200, "one two"), (201, "ONE  two"), (202, ""), (203, " ")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, words=5).collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert 8 < len(kept) < 120 and kept == plain_kept(rows, classes)
    sets = {i: plain_shingles(t) for i, t in rows}
    assert not any(alike(sets[i], sets[j]) for i in kept for j in kept if i < j)
    assert all(any(alike(sets[i], sets[j]) for j in kept) for i in sets.keys() - kept)


def test_an_original_takes_its_copies_away(spark):
    # copies of 1 to 3 edits are alike to the original, but seldom to one another
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(77, " ".join(base))]
    for i in range(60):
        t = list(base)
        for at in rng.sample(range(5, 145), 1 + i % 3):
            t[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in near_dedup.keep_one(df).collect()] == [77]


def test_odd_rows(spark, odd):
    out = near_dedup.keep_one(odd)
    assert out.columns == odd.columns and near_dedup.keep_one(odd.limit(0)).count() == 0
    assert near_dedup.similarity(np.array([1, 2, 3]), np.array([2, 3, 4])) == 0.5
