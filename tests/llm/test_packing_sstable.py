import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import packing, sstable
from tallyforge.llm.tokens import ChunkEncoder

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ENCODERS = {p: ChunkEncoder(p) for p in (BYTE, WORD)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, queue string, ids string"
ROWS = [
    (5, "the same text, twice", "en", "a", 1, 7, "x", "y"),
    (5, "the same text, twice", "en", "a", 1, 7, "x", "y"),
    (-3, None, None, None, None, None, None, None),
    (None, "no identifier", "en", "", 1, 7, "x", "y"),
    (9, "", "en", "a", 1, 7, "x", "y"),
    (2, "word " * 9000, "en", "b", 1, 7, "x", "y"),
    (3, "é İ ΣΑΣ 日本語  x́ \t\n two  spaces ", "fr", "c", 1, 7, "x", "y"),
]


@lru_cache
def library(path):
    return Tokenizer.from_file(path)  # as it is


def ids_of(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \t\n\r'stremldv.,!09aAéÉñªµ²½ſİΣσ́ ​ \x1c日")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_chunks_give_the_ids_of_the_whole_text(text):
    for enc in ENCODERS.values():
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_names_of_special_tokens_and_full_tables(path):
    small = ChunkEncoder(path, limit=20, longest=6)
    names = [t.content for t in library(path).get_added_tokens_decoder().values()]
    assert names
    for name in names:
        for text in (name, f"hello {name} world", f"a{name.upper()}b", f"{name}{name}", f"日本 {name} é", name[:-1], "x" * 200 + " y" * 2000, " ".join(f"w{i}é" for i in range(3000))):
            for enc in (small, ENCODERS[path]):
                assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == ids_of(path, text), text


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_pieces(pieces, rows, window=2048):
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(ids_of(BYTE, r[1]) + [1])
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == want.keys()
    for d, ps in by_doc.items():
        if len(want[d]) == 1:
            ids, at = want[d][0], 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert zlib.crc32(p.ids) == crc(ids[at : at + p.length])
                at += p.length
            assert at == len(ids)
    assert sum(p.length for p in pieces) == sum(len(x) for v in want.values() for x in v)
    last = max(by_seq, default=-1)
    assert sorted(by_seq) == list(range(last + 1))
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and (s == last or at == window)
        assert {p.padded_length for p in ps} == {packing.padded(at, window)}


@pytest.mark.parametrize("targets", [None, {"a": 0.5, None: 0.5}])
def test_pack(spark, targets):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    pieces = packing.pack(docs, BYTE, 1, targets=targets)
    check_pieces(pieces.collect(), ROWS)
    seqs = packing.windows(pieces).collect()
    assert all(len(r.ids) == 4 * packing.padded(len(r.ids) // 4) for r in seqs)


def test_targets_hold_with_many_sources(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 4)
    sources = ["a"] * 300 + ["b"] * 150 + [None] * 150 + [str(i % 9) for i in range(360)]
    docs = spark.createDataFrame([(i, "x" * 2040, x) for i, x in enumerate(sources)], "doc_id long, text string, source string")
    pieces = packing.pack(docs, BYTE, 1, targets={"a": 2.0, "b": 1.0, None: 1.0}).toPandas()
    first = pieces[pieces.sequence_id < 64].groupby("queue").length.sum().to_dict()
    assert first == {"=a": 256 * 256, "=b": 128 * 256, "-": 128 * 256}
    assert sorted(set(pieces.doc_id)) == list(range(960))


def test_pack_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pack(docs, BYTE, 1).count() == 0
    assert sstable.read_shards(sstable.write_shards(docs, WORD, 2)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40_000), min_size=1, max_size=7), st.integers(1, 5), st.randoms())
def test_schedule_is_a_permutation_and_fair(tokens, most_runs, rnd):
    plan = packing.Schedule.plan(np.array(tokens), 2048, 256, most_runs=most_runs)
    full = plan.full
    q = np.repeat(np.arange(len(full)), full)
    i = np.concatenate([np.arange(n) for n in full]) if full.sum() else np.zeros(0, int)
    place = plan.places(q, i)
    assert sorted(place) == list(range(int(full.sum())))
    for r in range(len(full)):  # ascending in each queue, and at most some slots off its share at any time
        own = np.sort(place[q == r])
        assert (own == place[q == r]).all()
        if len(own):
            assert np.abs(own * full[r] / full.sum() - np.arange(len(own))).max() <= len(full) + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=6), st.integers(1, 40))
def test_deficits_are_carried_from_window_to_window(slots, room):
    slots = np.array(slots)
    total = int(slots.sum())
    rooms = [min(room, total - at) for at in range(0, total, room)]
    rows = packing.deal(slots, rooms)
    assert (rows[-1] == (slots if total else 0)).all() and (np.diff(rows, axis=0) >= 0).all()
    assert (rows.sum(1) == np.cumsum([0, *rooms])).all()
    if total:
        assert np.abs(rows - np.outer(rows.sum(1), slots / total)).max() < len(slots)


def test_windows_hold_their_shares_in_deep_runs(monkeypatch):
    monkeypatch.setattr(packing, "FAN", 4)
    plan = packing.Schedule.plan(np.array([256 * 7000, 256 * 2000, 256 * 1000]), 2048, 256, most_runs=1)
    place = [plan.places(np.full(n, q), np.arange(n)) for q, n in enumerate((7000, 2000, 1000))]
    assert sorted(np.concatenate(place)) == list(range(10000))
    for own, share in zip(place, (0.7, 0.2, 0.1), strict=True):
        served = np.searchsorted(np.sort(own), np.arange(8, 10001, 8))
        assert np.abs(served - share * np.arange(8, 10001, 8)).max() < 3


def test_targets_hold_until_a_queue_runs_dry():
    plan = packing.Schedule.plan(np.array([256 * 4000, 256 * 1000]), 2048, 256, np.array([0.5, 0.5]))
    order = np.argsort(np.concatenate([plan.places(np.full(4000, 0), np.arange(4000)), plan.places(np.full(1000, 1), np.arange(1000))]))
    early = (order[:1984] >= 4000).reshape(-1, 8).sum(1)
    assert set(early) <= {3, 4, 5}


def test_shards(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    manifest = sstable.write_shards(docs, WORD, 2, block_bytes=64)
    got = sorted(((r.id is not None, r.id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in sstable.read_shards(manifest).collect()), key=lambda r: r[2])
    want = sorted(((r[0] is not None, r[0], ids_of(WORD, r[1]) + [2]) for r in ROWS), key=lambda r: (r[0], r[1] or 0))
    assert [(g[1], g[3]) for g in got] == [(w[1], w[2]) for w in want]
    at = 0
    for g in got:
        assert g[2] == at
        at += len(g[3])


def test_lookup(tmp_path):
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(-(1 << 40), 1 << 40, 3000))
    keys[100:103] = keys[100]
    path = tmp_path / "one.sst"
    with path.open("wb") as f:
        w = sstable.Writer(f, 2, block_bytes=512)
        for i, k in enumerate(keys):
            w.add(sstable.key_of(int(k)), b"v%d" % i)
        w.close()
    r = sstable.open_shard(str(path))
    assert [sstable.identifier_of(k) for k, _ in r.items()] == keys.tolist()
    assert r.get(sstable.key_of(int(keys[100]))) == [b"v100", b"v101", b"v102"]
    for i in range(0, 3000, 37):
        assert b"v%d" % i in r.get(sstable.key_of(int(keys[i])))
    missing = [k for k in rng.integers(-(1 << 40), 1 << 40, 500).tolist() if k not in set(keys.tolist())]
    assert not any(r.get(sstable.key_of(k)) for k in missing)
    assert sum(r.may_hold(sstable.key_of(k)) for k in missing) < 25
    data = bytearray(path.read_bytes())
    data[10] ^= 1
    path.write_bytes(data)
    with pytest.raises(ValueError):
        list(sstable.open_shard(str(path)).items())


def test_queries_against_the_library(spark):
    from tallyforge.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start = 0
    for r, d in zip(queries.op2_sstable(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect(), docs, strict=True):
        ids = ids_of(WORD, d.text) + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), crc(ids))
        start += len(ids)
    packed = packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), BYTE, 1)
    check_pieces(packed.collect(), [(d.doc_id, d.text) for d in docs])
