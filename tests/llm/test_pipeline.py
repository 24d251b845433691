import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from subsetry.llm import bpe, common, secret_scan, simhash, toxicity
from subsetry.llm.packing import Limits

from .test_duplicates import LOWER
from .test_near_dedup import plain_kept
from .test_tokens import held, ids_of

DIR = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark, docs, tokenizer):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "toxic")
    bad = {r.doc_id for r in toxicity.score(docs, labels, keep=["doc_id"]).where("predicted = 1").collect()}
    left = {i: r for i, r in rows.items() if i not in bad}
    best = {}
    for i, r in left.items():
        key = r.text.translate(LOWER)
        best[key] = max(best.get(key, i), i)
    ids = sorted(best.values())
    left = docs.where(docs.doc_id.isin(ids))
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(left, words=5).collect()}
    ids = sorted(plain_kept([(i, rows[i].text) for i in ids], classes))
    words = secret_scan.dictionary_of(docs.where(docs.doc_id.isin(ids)))
    texts = {i: secret_scan.redact(rows[i].text, words=words) for i in ids}
    tokens = {i: [*x, 0] for i, x in zip(texts, ids_of(tokenizer, list(texts.values())))}
    pieces = corpus_pipeline.run(spark, DIR).collect()
    held([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in pieces], Limits())
    got: dict = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == got.get(r.doc_id, 0)
        assert r.ids_crc32 == zlib.crc32(np.asarray(tokens[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        got[r.doc_id] = r.start + r.length
    assert got == {i: len(x) for i, x in tokens.items()}


@pytest.mark.parametrize("which", range(4))
def test_stages_keep_the_columns(spark, which):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "a b c", None, "s", 5), (3, "a b c", None, "s", 5), (4, "very long text " * 9000, "en", "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(*r, "x", "y", 7, True, None) for r in rows], schema + ", node string, score string, key long, maybe boolean, predicted int")
    name, stage = corpus_pipeline.STAGES[which]
    for given in (df, df.limit(0)):
        out = stage(spark, given, DIR)
        assert out.columns == df.columns and out.count() <= given.count()
    plain = spark.createDataFrame(rows, schema)
    assert stage(spark, plain.limit(0), DIR).columns == plain.columns


def test_pack_stage_takes_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "a b", "z"), (2, "a b", "z")], "doc_id long, text string, start string")
    out = corpus_pipeline.pack(spark, df, DIR).collect()
    assert sorted((r.doc_id or 0, r.length) for r in out)[:2] == [(0, 1), (1, 1)] and len(out) == 4
    assert corpus_pipeline.pack(spark, df.limit(0), DIR).count() == 0


def test_a_settled_stage_leaves_its_result_only(spark):
    inner = []

    def make():
        inner.append(common.staged(spark.range(5), "inner"))
        return inner[0].where("id > 1")

    out = common.settled(spark, make, "outer")
    assert out.count() == 3
    with pytest.raises(Exception, match="(?i)file|path"):
        inner[0].count()


def test_the_entry_works_without_this_subpackage(monkeypatch):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and "op9_exact_dedup" in __spark_entry__.oracle_sql()
    for name in ("subsetry.llm", "subsetry.llm.queries"):
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.delattr(sys.modules["subsetry"], "llm", raising=False)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("subsetry.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    assert "table_counts" in __spark_entry__.queries() and not any(n.startswith("op") for n in __spark_entry__.queries())


def test_a_worker_gives_up_what_earlier_stages_cached(spark):
    """Without packing between them, stages do not carry the encoder of an earlier one along."""
    def cached(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.encoder.cache_info().currsize] * batch.num_rows, pa.int64())], names=["n"])

    bpe.encoder(bpe.public_path("byte_bpe_50k.json"))
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert [b.column(0).to_pylist() for b in common.lean(cached, encoders=True)(iter([batch]))] == [[1, 1]]
    assert [b.column(0).to_pylist() for b in common.lean(cached)(iter([batch]))] == [[0, 0]]
    assert spark.range(3, numPartitions=1).mapInArrow(common.lean(cached), "n long").collect() == [(0,)] * 3
