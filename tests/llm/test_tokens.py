import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from subsetry.llm import chunk_bpe, common, tokenfiles
from subsetry.llm.bpe import UnitEncoder, public_path
from subsetry.llm.packing import Limits, Packer, pack

PIECES = [
    "a", "b", " ", " ", "\n", "'", "s", "re", "'re", "  ", "é", "ß", "1", "22", "!", "\t", "<|endoftext|>", "日本", "\x1c", "<|", " the", " word", " longer", "x y z ", "᠎", "​",
]


def texts(n, size, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, size))) for _ in range(n)]


def ids_of(tokenizer, found):
    return [e.ids for e in tokenizer.encode_batch(found, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_units_equal_the_library(tokenizer):
    enc = UnitEncoder(public_path("byte_bpe_50k.json"), cache_units=50)
    found = texts(3000, 30)
    for a in range(0, len(found), 100):
        assert [x.tolist() for x in enc.encode(found[a : a + 100])] == ids_of(tokenizer, found[a : a + 100])


def test_chunks_equal_the_library(tokenizer, monkeypatch, local):
    enc = chunk_bpe.ChunkEncoder(UnitEncoder(public_path("byte_bpe_50k.json")))
    whole = [t for _, t in local[:60]]
    assert [x.tolist() for x in enc.encode(whole)] == ids_of(tokenizer, whole)
    assert enc.repairs > 0
    monkeypatch.setattr(chunk_bpe, "MEAN", 5)
    monkeypatch.setattr(chunk_bpe, "WINDOW", 3)
    monkeypatch.setattr(chunk_bpe, "CACHED_CHARS", 500)
    found = texts(3000, 60, 2)
    for a in range(0, len(found), 200):
        assert [x.tolist() for x in enc.encode(found[a : a + 200])] == ids_of(tokenizer, found[a : a + 200])


def test_shared_passages_share_chunks():
    rng = random.Random(3)
    passage = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(3000))
    a, b = "start one " + passage, "another, longer start " + passage
    pieces = [{t[x:y] for x, y in zip([0, *chunk_bpe.cuts(t)], chunk_bpe.cuts(t))} for t in (a, b)]
    assert len(pieces[0] & pieces[1]) >= len(pieces[0]) - 2


def test_encode_decode(spark, docs, local, tokenizer, odd):
    got = {r.doc_id: r for r in chunk_bpe.encode_decode(docs).collect()}
    for (i, t), ids in zip(local, ids_of(tokenizer, [t for _, t in local])):
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = chunk_bpe.encode_decode(odd, with_ids=True).collect()
    assert len(rows) == odd.count() and {len(r.ids) for r in rows if r.doc_id in (3, 4)} == {0}
    assert [r.decoded for r in rows if r.doc_id == 11] == ["<|endoftext|> inside"]
    assert chunk_bpe.encode_decode(odd.limit(0)).count() == 0


def held(pieces, limits):
    by = defaultdict(list)
    for key, start, n, seq, offset in pieces:
        by[seq].append((offset, key, start, n))
    for parts in by.values():
        at = 0
        for offset, _, _, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= limits.tokens and len(parts) <= limits.segments
    return by


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 4, 40), Limits(100, 1, 100), Limits(50, 8, 10)])
def test_packer_keeps_limits(limits):
    rng, pieces = random.Random(5), []
    packer = Packer(limits, lambda *p: pieces.append(p), pool=32)
    given = [(i, rng.choice([1, 2, 5, 30, 60, 200, 1500]), rng.choice([0, 0, 3, 20])) for i in range(800)]
    for i, n, prompt in given:
        packer.add((i, prompt), n, min(prompt, n))
    packer.close()
    by = held(pieces, limits)
    for parts in by.values():
        assert sum(Packer._loss(start, n, key[1]) for _, key, start, n in parts) <= limits.loss_tokens
    cover = defaultdict(list)
    for key, start, n, _, _ in pieces:
        cover[key[0]].append((start, n))
    for i, n, _ in given:
        at = 0
        for start, size in sorted(cover[i]):
            assert start == at
            at += size
        assert at == n


def test_pack(spark, docs, local, tokenizer, odd):
    rows = pack(docs, with_ids=True).collect()
    ids = {i: [*x, 0] for (i, _), x in zip(local, ids_of(tokenizer, [t for _, t in local]))}
    held([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows], Limits())
    done = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == done[r.doc_id] and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.ids == ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id])
        done[r.doc_id] += r.length
    assert done == {i: len(x) for i, x in ids.items()}
    sequences = len({r.sequence_id for r in rows})
    assert sum(map(len, ids.values())) / (1024 * sequences) > 0.98
    rows = pack(odd).collect()
    assert sum(r.length for r in rows if r.start == 0 and r.doc_id in (3, 4)) == 2 and sum(r.doc_id is None for r in rows) >= 2
    assert pack(odd.limit(0)).count() == 0


def test_token_files(spark, docs, local, tokenizer, odd):
    rows = sorted(tokenfiles.round_trip(docs).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, (i, _), ids in zip(rows, local, ids_of(tokenizer, [t for _, t in local])):
        assert tuple(r) == (i, at, len(ids) + 1, crc([*ids, 0]))
        at += len(ids) + 1
    rows = sorted(tokenfiles.round_trip(odd).collect(), key=lambda r: r.start)
    assert len(rows) == odd.count() and [r.doc_id for r in rows[:2]] == [None, None]
    assert [r.doc_id for r in rows[2:]] == sorted(r.doc_id for r in rows[2:])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert tokenfiles.round_trip(odd.limit(0)).count() == 0


def test_shards_are_read_by_ranges(spark, docs, monkeypatch):
    from pyarrow import fs

    folder = common.shared_dir(spark, "tokens")
    shards = [r.asDict() for r in tokenfiles.write(docs, folder, parts=3).collect()]
    wanted = [(i, a, x.tolist()) for s in shards for i, a, x in tokenfiles.documents(folder, s)]
    far = fs.SubTreeFileSystem("/", fs.LocalFileSystem())
    root = common.filesystem(folder)[1]
    monkeypatch.setattr(common, "filesystem", lambda uri: (far, root))
    monkeypatch.setattr(tokenfiles._Ranged.__init__, "__defaults__", (4096,))
    assert [(i, a, x.tolist()) for s in shards for i, a, x in tokenfiles.documents(folder, s)] == wanted and len(wanted) == docs.count()
    assert common.tasks_for(spark, docs) == common.tasks_for(spark) == 4
