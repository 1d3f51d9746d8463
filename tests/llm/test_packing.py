import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from framewright.llm import packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts():
    rng = random.Random(2)
    marks = ["a", "Word", "don't", " ", "  ", "\n", "\n\n", "\t", "é", "x́", "123", "!!", "<|endoftext|>", "　", "\xa0", "\x1c", "\x85", "日本", "\U0001f600", "foo.\nbar"]
    return ["", None, " ", "a  b", "a \nb", " lead", "trail ", *("".join(rng.choices(marks, k=rng.randint(1, 25))) for _ in range(1500)), *(" ".join(rng.choices(marks, k=12)) for _ in range(500))]


def test_ids_are_the_tokenizers():
    own, theirs = packing.encoder(JSON, RANKS), Tokenizer.from_file(JSON)
    for t in texts():
        assert np.frombuffer(own.encode(t), "<u4").tolist() == (theirs.encode(t, add_special_tokens=False).ids if t else []), repr(t)


def naive(lengths, capacity):
    rooms, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[i])
        else:
            rooms.append(capacity - lengths[i])
        out[i] = 1
    return len(rooms)


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(4)
    for n in (0, 1, 5, 200):
        lengths = np.array([rng.randint(1, 100) for _ in range(n)], np.int64)
        bins, offset = packing.best_fit(lengths, 100)
        assert len(set(bins.tolist())) == naive(lengths.tolist(), 100)
        for b in set(bins.tolist()):
            at = 0
            for i in sorted(np.flatnonzero(bins == b), key=lambda i: offset[i]):
                assert offset[i] == at
                at += lengths[i]
            assert at <= 100


def check(docs, capacity=2048):
    rows = packing.pack(packing.pieces(docs, JSON, RANKS, capacity, with_ids=True), capacity).collect()
    t = Tokenizer.from_file(JSON)
    want = sorted(([*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.select("text").collect()), key=str)
    per, places = {}, {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * capacity
        per.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= capacity
    return rows, per, places, want


def test_pieces_join_to_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, per, places, want = check(docs)
    got = []
    for pieces in per.values():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces[:-1])]))
        assert len(pieces) == 1 or all(r.length == 2048 for r in pieces[1:])
        got.append(np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist())
    assert sorted(got, key=str) == want
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 2048) * 1.05 + 1


def test_odd_rows(odd, none):
    rows, per, _, want = check(odd)
    assert sum(r.length for r in rows) == sum(map(len, want))
    assert len(per[6]) == 2 and len(per[4]) == 1 and per[4][0].length == 1
    assert packing.pack(packing.pieces(none, JSON, RANKS)).count() == 0
