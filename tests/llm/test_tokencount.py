import math
import random

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer, models

from tamarack.llm import tokencount
from tamarack.llm.queries import op5_token_counts, tokenizer_file

from .helpers import documents, rows, table

PATH = tokenizer_file("piece_bpe_32k.model")


def reference(pieces):
    """The library's own unigram model over the same pieces and scores."""
    bytes_ = [(f"<0x{b:02X}>", -1e6) for b in range(256)]
    return Tokenizer(models.Unigram([("<unk>", min((s for _, s in pieces), default=0.0)), *pieces, *bytes_], unk_id=0, byte_fallback=True))


@pytest.fixture(scope="module")
def both():
    pieces = tokencount.load_pieces(PATH)
    return tokencount.ViterbiCounter(pieces), pieces


def library_counts(pieces, texts):
    lib = reference(pieces)
    return [len(lib.encode(tokencount.MARK + t.replace(" ", tokencount.MARK)).ids) if t else 0 for t in texts]


def test_against_library(both, sf_dir):
    counter, pieces = both
    rng = random.Random(3)
    known = sorted({c for p, _ in pieces if len(p) == 1 for c in p})
    texts = ["".join(rng.choice(known + [" ", " ", "😀", "𐍈", "\n"]) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    assert [counter.count(t) for t in texts] == library_counts(pieces, texts)


def test_whole_table(spark, both, sf_dir):
    d = documents(sf_dir)
    got = rows(op5_token_counts(spark, sf_dir))
    assert dict(zip(got.doc_id, got.n_tokens)) == dict(zip(d.doc_id, library_counts(both[1], d.text)))


def test_ranks_become_log_frequencies(both):
    pieces = dict(both[1])
    assert len(pieces) > 30_000 and max(pieces.values()) == -round(1000 * math.log(100))
    counter, texts = both[0], ["The cat sat on the mat and looked at the old house by the river."] * 3
    own = SentencePieceProcessor(model_file=PATH).encode(texts, num_threads=1)
    assert [counter.count(t) for t in texts] == [len(x) for x in own]


def path_count(pieces, text):
    """Plain Viterbi over the whole text: strictly better scores only, earliest beginning first."""
    score = dict(pieces)
    unknown = min(score.values(), default=0.0) - 10
    text = tokencount.MARK + text.replace(" ", tokencount.MARK)
    best = [(0.0, 0)] + [(float("-inf"), 0)] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 50), e):
            p = text[s:e]
            if p in score and best[s][0] + score[p] > best[e][0]:
                best[e] = (best[s][0] + score[p], best[s][1] + 1)
        c = text[e - 1]
        if c not in score and best[e - 1][0] + unknown > best[e][0]:
            best[e] = (best[e - 1][0] + unknown, best[e - 1][1] + len(c.encode()))
    return best[-1][1]


def test_whole_text_viterbi(both):
    counter, pieces = both
    rng = random.Random(4)
    for t in ["a", " ", "  two  blanks ", "new\nline\t tab", "😀 é ẞ 日本語", "the theory of thin things", *("".join(rng.choice("abcdeé \n😀") for _ in range(60)) for _ in range(60))]:
        assert counter.count(t) == path_count(pieces, t)


def test_ties_and_fractions():
    pieces = [("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("b", -1.5), ("ab", -2.5), (tokencount.MARK, -1.0)]
    counter = tokencount.ViterbiCounter(pieces)
    for t in ("aaaa", "aab", "abab b", "x", "aax", "baab"):
        assert counter.count(t) == path_count(pieces, t)


def test_edges(spark):
    texts = [None, "", "same text", "same text", "word " * 50_000]
    got = rows(tokencount.token_counts(table(spark, texts), PATH))
    assert got.n_tokens[0] == got.n_tokens[1] == 0 and got.n_tokens[2] == got.n_tokens[3] > 0 and got.n_tokens[4] >= 50_000
    assert tokencount.token_counts(table(spark, texts).where("doc_id < 0"), PATH).count() == 0
