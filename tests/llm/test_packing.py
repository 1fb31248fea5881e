import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tamarack.llm import packing
from tamarack.llm.queries import op10_packing, tokenizer_file

from .helpers import documents, rows, table

PATH = tokenizer_file("word_bpe_49k.json")


def places(got, capacity):
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= capacity
        assert (3 * g.length > capacity).sum() <= 2


def direct(texts):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def check(got, ids, capacity=packing.CAPACITY):
    want = {}
    for d, own in ids:
        for i in range(0, len(own), capacity):
            p = own[i : i + capacity]
            want[d, i // capacity] = (i, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    places(got, capacity)


def test_whole_table(spark, sf_dir):
    d = documents(sf_dir)
    got = rows(op10_packing(spark, sf_dir))
    check(got, list(zip(d.doc_id, direct(d.text))))
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / packing.CAPACITY + 1


def test_edges(spark):
    texts = [None, "", "don't STOP, café 123  x y z", "same", "same", "café\n\ttab", "word " * 20_000, "x" * 9000, "<|endoftext|> a"]
    got = rows(packing.pack(table(spark, texts), PATH))
    check(got, list(enumerate(direct(texts))))
    assert packing.pack(table(spark, texts).where("doc_id < 0"), PATH).count() == 0


PIECES = [*"abzAZ09 \t\n.,;:!?'%$-_|<>/@İıßéÉµªºΣσς²½\u00ad\u00a0\u0085\u0300\u0301\u200b", "'s", "'LL", "  ", "don't", "İ?", "Ǆ", "日本", "😀", "한", "Å", "ﬁ", "\u1100\u1161", "\x1c", "\r\n", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "the", "x" * 70]


def test_ids_of_random_texts():
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    encoder = packing.WordEncoder(PATH)
    assert encoder.merges
    for at in range(0, len(texts), 5000):  # later chunks meet remembered parts
        own = texts[at : at + 5000]
        flat, bounds = encoder.encode(pa.array(own))
        assert [[*flat[a:b].tolist(), 1] for a, b in zip(bounds, bounds[1:])] == direct(own)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 20)
    encoder = packing.WordEncoder(PATH)
    for i in range(30):
        own = [f"word{j} anew{i % 7} same" for j in range(i, i + 15)]
        flat, bounds = encoder.encode(pa.array(own))
        assert [[*flat[a:b].tolist(), 1] for a, b in zip(bounds, bounds[1:])] == direct(own)
        assert len(encoder.young) <= 10 + 50


def test_other_tokenizer():
    path = tokenizer_file("byte_bpe_50k.json")
    assert packing.merge_ranks(path) is None
    texts = ["Two  blanks kept", "", None, "end\n"]
    flat, bounds = packing.WordEncoder(path).encode(pa.array(texts))
    t = Tokenizer.from_file(path)
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def bins_of(counts, capacity):
    fill = {}
    for n, _, many, first, each, offset in packing.plan(counts, capacity):
        for i in range(many):
            b = first + i // each
            at = offset + i % each * n
            fill.setdefault(b, []).append((at, n))
    for items in fill.values():
        items.sort()
        end = 0
        for at, n in items:
            assert at == end
            end += n
        assert end <= capacity
    return fill


@pytest.mark.parametrize("seed", range(20))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(10, 120))
    items = rng.integers(1, capacity + 1, int(rng.integers(1, 400)))
    if seed % 2:
        items = np.maximum(1, items // 3)
    counts = dict(zip(*(x.tolist() for x in np.unique(items, return_counts=True))))
    fill = bins_of(counts, capacity)
    assert sorted(n for b in fill.values() for _, n in b) == sorted(items)
    # first-fit decreasing as a yardstick
    gaps = []
    for n in sorted(items.tolist(), reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= n), None)
        if at is None:
            gaps.append(capacity - n)
        else:
            gaps[at] -= n
    assert len(fill) <= len(gaps) + 1 and sorted(fill) == list(range(len(fill)))
