"""Token counts of a unigram tokenizer, without token ids.

An Aho-Corasick automaton over the vocabulary lists all pieces that end at each
character; dynamic programming carries the best score and the number of pieces up to
there. Ties are the tokenizer's: among equal scores the piece that begins first wins. A
character that no piece covers scores ten under the worst piece and counts as one token
per UTF-8 byte (byte fallback).

A unigram file's own scores are taken. A BPE file has merge ranks instead, which are no log
probabilities; they are read as ranks of frequency, and Zipf and Mandelbrot's law gives the
scores, ``-ln(rank + 100)`` in thousandths. These are whole numbers, so sums are exact in any
order, and a text may be cut wherever no piece reaches across: before a word mark that
follows another character, and around characters that are in no longer piece. Counts of the
parts are looked up once known.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 400_000


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    plain = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    pieces = [(sp.id_to_piece(i), float(sp.get_score(i))) for i in plain]
    return zipf(pieces) if all(s.is_integer() for _, s in pieces) else pieces  # only ranks are whole numbers


def zipf(pieces: list[tuple[str, float]], shift: int = 100) -> list[tuple[str, float]]:
    """Pieces, from the highest score down, with the log frequency that their place stands for, in whole thousandths."""
    order = sorted(pieces, key=lambda p: (-p[1], p[0]))
    return [(piece, -float(round(1000 * math.log(rank + shift)))) for rank, (piece, _) in enumerate(order)]


class ViterbiCounter:
    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        whole = all(float(s).is_integer() for _, s in pieces)
        marks = all(MARK not in p.lstrip(MARK) for p, _ in pieces)
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.units = re.compile("(?s).+")
        if whole and marks:
            joint = {c for p, _ in pieces if len(p) > 1 for c in p}
            alone = "".join(re.escape(c) for c in "\n\r\t\x0b\x0c| " if c not in joint)
            self.units = re.compile(f"(?s)[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"(?s){MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, int] = {}

    def unit(self, text: str) -> int:
        """Pieces on the best path through one unit."""
        n = len(text)
        if self.singles.issuperset(text):  # some piece ends at every character
            top, pieces = [0.0] + [float("-inf")] * n, [0] * (n + 1)
            for end, (size, score) in self.automaton.iter(text):  # by end, the earliest beginning first
                begin = end + 1 - size
                total = top[begin] + score
                if total > top[end + 1]:
                    top[end + 1], pieces[end + 1] = total, pieces[begin] + 1
            return pieces[n]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(n):
            top, many, single = float("-inf"), 0, False
            for size, score in sorted(ends[e], reverse=True):  # the earliest beginning first
                total = best[e + 1 - size] + score
                if total > top:
                    top, many = total, count[e + 1 - size] + 1
                single |= size == 1
            if not single and (total := best[e] + self.unknown) > top:
                top, many = total, count[e] + len(text[e].encode("utf-8", "surrogatepass"))
            best[e + 1], count[e + 1] = top, many
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a text: blanks become word marks, and one is put in front."""
        if not text:
            return 0
        known, total = self.known, 0
        for part in self.units.findall(MARK + text.replace(" ", MARK)):
            n = known.get(part)
            if n is None:
                n = self.unit(part)
                if len(part) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[part] = n
            total += n
        return total


@cache
def counter_of(vocabulary: str) -> ViterbiCounter:
    """One counter per worker, kept between tasks."""
    return ViterbiCounter(load_pieces(vocabulary))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens`` of every whole text under the vocabulary file at ``vocabulary``.

    Null and empty texts have no tokens; a text of any length is counted whole, in time
    proportional to it; equal texts have equal counts, each row its own. Extra columns are
    ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([counter.count(t.as_py()) for t in b["text"]], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
