"""The Kneser-Ney models against a plain version of their formulas with exact counts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsetry.llm import toxicity

from .test_scans import corpus


def words_of(text):
    """Between blanks, in lower case, without the punctuation at either end."""
    return [w for w in (x.strip(toxicity._EDGE) for x in text.lower().split()) if w]


class Plain:
    """Dictionaries of sets of contexts, one class at a time."""

    def __init__(self, texts_of, every, d, d2):
        before = defaultdict(set)
        for t in every:
            words = words_of(t)
            for u, w in zip(["", *words], words):
                before[w].add(u)
        self.shared = {w: len(s) for w, s in before.items()}
        self.shared_of = Counter()
        for w, n in self.shared.items():
            self.shared_of[w[: toxicity.PREFIX]] += n
        self.total, self.d, self.d2 = sum(self.shared.values()), d, d2
        self.classes = []
        for texts in texts_of:
            pair = defaultdict(set)
            for t in texts:
                words = ["", "", *words_of(t)]
                for v, u, w in zip(words, words[1:], words[2:]):
                    pair[u, w].add(v)
            pair = {k: len(v) for k, v in pair.items()}
            word, prefix, first = Counter(w for _, w in pair), Counter(), defaultdict(list)
            for w, n in word.items():
                prefix[w[: toxicity.PREFIX]] += n
            for (u, _), n in pair.items():
                first[u].append(n)
            self.classes.append((pair, word, prefix, first))

    def probability(self, which, u, w, known):
        pair, word, prefix, first = self.classes[which]
        d, p, total = self.d, w[: toxicity.PREFIX], sum(word.values())
        share = self.shared[w] / self.shared_of[p] if w in known else 1.0
        share_p = self.shared_of[p] / self.total if p in {k[: toxicity.PREFIX] for k in known} else 1.0
        free = sum(min(n, d) for n in prefix.values()) + toxicity.STRENGTH * total
        q = (max(prefix[p] - d, 0) + free * share_p) / (total * (1 + toxicity.STRENGTH))
        kinds = sum(min(n, d) for x, n in word.items() if x[: toxicity.PREFIX] == p)
        inner = (max(word[w] - d, 0) + kinds * share) / prefix[p] if prefix[p] else share
        if u not in first:
            return q * inner
        return (max(pair.get((u, w), 0) - self.d2, 0) + sum(min(n, self.d2) for n in first[u]) * q * inner) / sum(first[u])

    def ratios(self, text, known):
        words = words_of(text)
        return [math.log(self.probability(0, u, w, known)) - math.log(self.probability(1, u, w, known)) for u, w in zip(["", *words], words)]


def test_ratios_equal_a_plain_version(spark):
    docs, labels, _ = corpus(spark, 300)
    texts = {r.doc_id: r.text for r in docs.collect()}
    # an expression of ordinary words that only toxic documents have, in changing contexts
    texts = {i: f"{t} ba ne {t[:5]} la zorbi ba ne to" if i % 6 == 0 else t for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sample = toxicity._sample(labels, "doc_id", "toxic").withColumn("counts", F.col("place") % toxicity.EVERY != 0)
    counted = [[texts[r.doc_id] for r in sample.where("counts").withColumnRenamed("id", "doc_id").collect() if r.toxic == c] for c in (1, 0)]
    own = docs.select(F.col("doc_id").alias("id"), "text")
    words, pairs = toxicity._counts(own, sample)
    known = {w for side in counted for t in side for w in words_of(t)}
    exact = Plain(counted, texts.values(), 1, 1)
    names = {toxicity.key_of(w): w for w in known}
    every = [names.get(int(k), "") for k in words["key"]]
    for name, n in (("contexts", [exact.shared.get(w, 0) for w in every]), ("of_prefix", [exact.shared_of[w[: toxicity.PREFIX]] for w in every]), ("of_all", exact.total)):
        assert np.allclose(words[name], n, rtol=0.6, atol=2) and np.mean(np.abs(words[name] - n) / np.maximum(n, 1)) < 0.15
        words[name] = np.array(n, float)  # what follows is exact, but for these estimates
    for d, d2 in toxicity.GRID:
        model, plain = toxicity.Model(words, pairs, (d, d2)), Plain(counted, texts.values(), d, d2)
        some = [*list(texts.values())[:40], "unheardof word ba ne", "zorguxyz", "ba"]
        starts, x = model._ratios(some)
        got = [part[1:] for part in np.split(x, starts[1:])]
        wanted = [plain.ratios(t, known) for t in some]
        assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(got, wanted))
        features = model.features(some)
        for (whole, best), r in zip(features, wanted):
            passages = [np.mean(r[i : i + toxicity.PASSAGE]) for i in range(max(1, len(r) - toxicity.PASSAGE + 1))]
            assert whole == pytest.approx(np.mean(r), abs=1e-6) and best == pytest.approx(max(passages), abs=1e-6)
        assert model.features(["", "  .,"]).tolist() == [[0, 0], [0, 0]]


def test_an_expression_of_ordinary_words_tells(spark):
    docs, labels, toxic = corpus(spark, 600)
    # both words are frequent everywhere, their sequence is not
    texts = {r.doc_id: r.text.replace("zorgu", "") for r in docs.collect()}
    texts = {i: " ".join(f"{w} dola mari" if toxic >= {i} and n % 12 == 5 else f"{w} dola" if n % 12 == 5 else f"mari {w}" if n % 12 == 9 else w for n, w in enumerate(t.split())) for i, t in texts.items()}
    rows = toxicity.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), labels, keep=["doc_id"]).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted for r in held if r.doc_id in toxic) >= 0.8 * sum(r.doc_id in toxic for r in held)
    assert sum(r.predicted for r in held if r.doc_id not in toxic) <= 0.03 * len(held)


def test_distinct_contexts_are_counted(spark):
    rng = np.random.default_rng(5)
    sizes = {1: 1, 2: 9, 3: 100, 4: 3000, 5: 200_000}
    parts = []
    for owner, n in sizes.items():
        some = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for half in (some[: n * 2 // 3], some[n // 3 :]):  # two tasks that share contexts
            k, slot, mask = toxicity._masks(np.full(len(half), owner), half)
            parts += [(0, int(a), int(b), int(c)) for a, b, c in zip(k, slot, mask.view(np.int64))]
    found = toxicity._distinct_contexts(spark.createDataFrame(parts, "kind byte, key long, slot short, mask long"))
    got = {r.key: r.n for r in found.collect()}
    assert got[1] == pytest.approx(1, abs=0.01) and got[2] == pytest.approx(9, abs=0.6)
    assert all(abs(got[k] / n - 1) < 0.25 for k, n in sizes.items())


def test_results_do_not_depend_on_partitions(spark):
    docs, labels, _ = corpus(spark, 240)
    one = {r.doc_id: r.score for r in toxicity.score(docs.coalesce(1), labels, keep=["doc_id"]).collect()}
    many = {r.doc_id: r.score for r in toxicity.score(docs.repartition(7), labels.repartition(3), keep=["doc_id"]).collect()}
    assert one == pytest.approx(many, abs=1e-9)


def test_without_both_classes_all_documents_stay(spark):
    docs, labels, toxic = corpus(spark, 60)
    for one in (0, 1):
        assert toxicity.keep_ordinary(docs, labels.where(f"toxic = {one}")).count() == 60
    assert toxicity.score(docs, labels.where("toxic = 1")).where("predicted = 1").count() == 60
