"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only the number of pieces of each length (at most ``capacity`` counts) comes to the
driver. The plan is made on these counts: pieces over a third of the capacity are matched
greedily, largest first with the largest partner that fits, so at most two share a
sequence (for such pieces this uses the fewest sequences possible); smaller pieces then
go, largest first, each into the smallest gap that holds it. Pieces of a length are
ranked without gathering a length in one task, and a piece finds its place by its rank.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked

CAPACITY = 4096
END = 1
CACHE = 500_000
CHUNK = 8_000_000

# What the tokenizer file must say for ``WordEncoder`` to take its own way.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_WORD_END = "</w>"

# Within these characters (no blanks, no combining marks) NFC changes nothing, lower case goes
# by single characters and the classes L and N are the two below.
_SIMPLE = re.compile("[!-~\u00a1-\u012f]{1,64}")
_L, _N = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\n{_L}{_N}]+")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Ids by bytes, a word's end written as a blank; None if the file is not of the known form.

    The form: the normaliser and splitter above, byte-level BPE, ids in the order of merges,
    no two tokens alike, and every token comes out of its own characters whole. Then joining
    the pair whose bytes have the least id is the same as applying the merges in order: two
    tokens that stand where a token could be are the last step of that token's own way.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    plain = ("dropout", "unk_token", "continuing_subword_prefix")
    if spec.get("normalizer") != _NORMALIZER or spec.get("pre_tokenizer") != _PRE_TOKENIZER or spec.get("truncation") or spec.get("padding"):
        return None
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != _WORD_END or any(model.get(k) for k in plain) or model.get("byte_fallback") or model.get("ignore_merges"):
        return None
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") for t in spec["added_tokens"]):
        return None
    added = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    byte_of = byte_alphabet()
    ranks: dict[bytes, int] = {}
    for token, i in vocab.items():
        body = token.removesuffix(_WORD_END)
        if not all(c in byte_of for c in body):
            return None
        ranks[bytes(map(byte_of.__getitem__, body)) + b" " * (body != token)] = i
    first = 2 * len(byte_of)
    alone = all(ranks.get(bytes([b]), first) < first and ranks.get(bytes([b, 32]), first) < first for b in byte_of.values())
    if not alone or len(ranks) != len(vocab) or [vocab.get(a + b) for a, b in merges] != list(range(first, first + len(merges))):
        return None
    from tokenizers import models

    ended, bare = (models.BPE(vocab=vocab, merges=merges, **end) for end in ({"end_of_word_suffix": _WORD_END}, {}))
    for token, i in vocab.items():
        body = token.removesuffix(_WORD_END)
        if [t.id for t in (bare if body == token else ended).tokenize(body)] != [i]:
            return None
    return ranks


class WordEncoder:
    """Token ids of whole texts by a tokenizer, each distinct blank-separated part once.

    A tokenizer of the form that ``merge_ranks`` knows drops white space and treats what
    stands between blanks on its own, so a text's ids are the joined ids of its parts. A
    chunk of texts is split and its distinct parts are numbered by Arrow; parts not met
    lately are encoded many at a time, simple ones by the same merges over bytes, others
    (other alphabets, very long ones, those with a special token's ``<|``) by the tokenizer
    itself. Parts are remembered in two generations of ``CACHE / 2``; one that is in use
    moves to the younger. With any other tokenizer file, whole texts go to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        ranks = merge_ranks(path)
        self.merges = ranks and tiktoken.Encoding("words", pat_str=r"[^ \n]+ |\n", mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n"] if ranks else -1
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plainly(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _simple(self, parts: list[str]) -> list[bytes]:
        text = _PRE_TOKEN.sub(r"\g<0> ", "\n".join(parts).lower()) + "\n"
        ids = np.asarray(self.merges.encode_to_numpy(text, disallowed_special=()), "<u4")
        cuts = np.flatnonzero(ids == self.line).tolist()
        raw = ids.tobytes()
        return [raw[4 * s : 4 * e] for s, e in zip([0, *(c + 1 for c in cuts)], cuts, strict=False)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts."""
        get, old = self.young.get, self.old
        out = [get(p) for p in parts]
        simple, other = [], []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            p = parts[i]
            if (ids := old.get(p)) is not None:
                out[i] = self.young[p] = ids
            elif _SIMPLE.fullmatch(p) and "<|" not in p:
                simple.append(i)
            else:
                other.append(i)
        for which, encode in ((simple, self._simple), (other, self._plainly)):
            words = [parts[i] for i in which]
            for i, p, ids in zip(which, words, encode(words) if words else (), strict=True):
                out[i] = ids
                if len(p) <= 64:
                    self.young[p] = ids
        if len(self.young) > CACHE // 2:
            self.old, self.young = self.young, {}
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (null: none), and where each text begins, with the end as last."""
        if not self.merges:
            each = self._plainly(texts.fill_null("").to_pylist())
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([0, *(len(x) // 4 for x in each)])
        split = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        ids = self._parts(words.dictionary.to_pylist())
        size = np.array([len(x) // 4 for x in ids], np.int64)
        first = np.cumsum(size) - size
        word = words.indices.to_numpy()
        many = size[word]
        ends = np.cumsum(many)
        pool = np.frombuffer(b"".join(ids), "<u4")
        flat = pool[np.repeat(first[word] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = split.offsets.to_numpy()
        return flat, np.concatenate([[0], ends])[bounds - bounds[0]]


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder per worker, kept between tasks."""
    return WordEncoder(path)


def chunks(batch: pa.RecordBatch, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's tokens and end mark."""
    mark = END.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            for part in chunks(batch):
                flat, bounds = encode(part["text"])
                raw, tokens = memoryview(flat.astype("<u4", copy=False)).cast("B"), np.diff(bounds) + 1
                many = -(-tokens // capacity)
                doc = np.repeat(np.arange(len(tokens)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, tokens[doc] - start)
                begin = bounds[doc] + start
                stop = np.minimum(begin + length, bounds[doc + 1])  # the last piece holds the end mark, too
                crcs = [crc32(raw[4 * b : 4 * e]) for b, e in zip(begin.tolist(), stop.tolist(), strict=True)]
                for i in np.flatnonzero(stop - begin < length).tolist():
                    crcs[i] = crc32(mark, crcs[i])
                cols = [part["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def token_lengths(docs: DataFrame, tokenizer_path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the string columns ``carry`` and ``n_tokens``, the tokens of each whole text without an end mark.

    Null and empty texts have none; other columns are ignored; an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            for part in chunks(batch):
                bounds = encode(part["text"])[1]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(part[c] for c in carry), pa.array(np.diff(bounds), pa.int64())], ["doc_id", *carry, "n_tokens"])

    return docs.select("doc_id", "text", *carry).mapInArrow(count, ", ".join(["doc_id long", *(f"{c} string" for c in carry), "n_tokens long"]))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces: ``(length, first rank, pieces, first sequence, pieces a sequence, offset)``."""
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    bins = 0

    def put(n: int, many: int, first: int, each: int, offset: int) -> None:
        out.append((n, rank[n], many, first, each, offset))
        rank[n] += many
        left[n] -= many

    def open_gap(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            at = bisect_left(large, capacity - n + 1)
            mate = next((m for m in reversed(large[:at]) if left[m] - (m == n) > 0), 0)
            many = left[n] // 2 if mate == n else min(left[n], left[mate]) if mate else left[n]
            if mate == n:
                put(n, 2 * many, bins, 2, 0)
            else:
                put(n, many, bins, 1, 0)
                if mate:
                    put(mate, many, bins, 1, n)
            open_gap(capacity - n - mate, bins, many)
            bins += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                first, many, gap = bins, -(-left[n] // (capacity // n)), capacity
                bins += many
            else:
                gap = order[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            each = gap // n
            full = min(many, left[n] // each)
            rest = 0
            if full:
                put(n, full * each, first, each, capacity - gap)
                open_gap(gap - each * n, first, full)
            if full < many and left[n]:
                rest = left[n]
                put(n, rest, first + full, rest, capacity - gap)
                open_gap(gap - rest * n, first + full, 1)
            open_gap(gap, first + full + (rest > 0), many - full - (rest > 0))
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents: one row per piece with its ``sequence_id`` and ``offset``.

    A document's ids end with id 1; only longer ones are cut, into pieces of ``capacity``
    ids. Null and empty texts hold the end mark alone. Extra columns are ignored whatever
    their names; an empty table gives an empty result. Equal texts are packed each for
    itself; ``doc_id`` must be unique. Sequences are numbered from 0 and have no gaps.
    """
    cut = materialize(pieces(docs, tokenizer_path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = np.array(plan(counts, capacity) or [(0, 0, 1, 0, 1, 0)], np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    keys = (table[:, 0] << 48) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = (b[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (n << 48) + r, "right") - 1]
            inside = r - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 3] + inside // row[:, 4]), pa.array(row[:, 5] + inside % row[:, 4] * n)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(cut, ["length"], ["doc_id", "piece"]).mapInArrow(place, schema)
