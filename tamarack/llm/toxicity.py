"""Toxicity by a weighted grammar of composed finite-state transducers.

A lexicon, a trie over letters, gives each word a class and, to insults, a strength. Five
machines read the classes of a clause and are composed into one: the insult machine marks
insults, the threat machine tells threats from announced ones ("will ... kill"), the
negation machine negates what stands in the scope of a negating word, the machine of
reported speech marks what is quoted or in a clause with a word of saying, and the target
machine marks what is aimed at somebody. Arcs that write a hit carry the weight of its
kind. A text's score is a logistic function of its matched clauses: each clause counts once
per kind, with the strength of its strongest hit, and counts grow by their logarithm. So an
isolated word counts only as the clause that it makes.

Insult stems, their strengths and the weights are learned from labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .transducer import Transducer, compose

MAX_LABELLED = 3000  # rows of each label that are read to fit, at most
STEM_CHARS = range(3, 11)
CLEAN_COST = 10.0  # toxic rows that a stem must bring for each clean one, both as rates
LEAST_GAIN = 0.01  # share of the toxic rows with any stem that one more must cover anew; chosen by ``cross_validated``
LEAST_RATIO = 20.0  # how much oftener than clean rows toxic ones must have a stem

WORDS = {
    "target": "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes ti tus they them he she him",
    "negation": "not no never neither nor nobody none nothing isn't aren't wasn't weren't don't doesn't didn't without nicht kein keine keiner niemand nie pas jamais personne rien ni nunca nadie ninguno nada jamás tampoco sin sans ohne",
    "contrast": "but sondern aber mais sino pero",
    "report": "said says called calls quoted quote wrote claimed reported allegedly sagte sagt schrieb zitiert dit disait écrit selon dijo dice escribió según",
    "threat": "kill hurt destroy punch stab shoot strangle beat töten umbringen schlagen verletzen tuer frapper blesser matar golpear herir",
    "future": "will gonna shall going should werde wirst soll vais va devrait voy vas debería",
}
CLASSES = ("other", "insult", "quote", *WORDS)
NEGATION_REACH = 3

HITS = ("insult", "threat", "intent")
KINDS = tuple(f"{hit}{scope}{aim}" for hit in HITS for scope in ("", "_negated", "_reported") for aim in ("", "_aimed"))
#: Weights before any label is seen: bias, then those kinds that say more than nothing.
PRIOR_OF = {"insult": 3.5, "insult_aimed": 5.0, "insult_negated": 1.0, "insult_negated_aimed": 2.0, "insult_reported": 1.0, "insult_reported_aimed": 2.5, "threat_aimed": 1.5, "intent": 1.0, "intent_aimed": 4.0, "intent_reported_aimed": 1.0}
PRIOR = np.array([-3.0, *(PRIOR_OF.get(k, 0.0) for k in KINDS)])

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_TOKEN = re.compile(_WORD.pattern + '|["«»„“”]')
_APOSTROPHE = re.compile(r"(?<=[^\W_])[’ʼ‘](?=[^\W_])")
_END = re.compile(r"[.!?;\n|]")


def insult_machine() -> Transducer:
    """Passes insults as hits; every other class stays as it is."""
    return Transducer.of("", lambda s: True, CLASSES, lambda s, x: [(s, x)])


def threat_machine() -> Transducer:
    """A threat word after a future word of its clause is an intent."""

    def step(state: str, x: str) -> list[tuple[str, str]]:
        if x == "future":
            return [("announced", "other")]
        return [(state, "intent" if x == "threat" and state else x)]

    return Transducer.of("", lambda s: True, insult_machine().outputs(), step)


def negation_machine(reach: int = NEGATION_REACH) -> Transducer:
    """Hits among the ``reach`` words after a negation are negated; a contrasting word ends its scope."""

    def step(left: int, x: str) -> list[tuple[int, str]]:
        if x == "negation":
            return [(reach, "other")]
        if x == "contrast":
            return [(0, "other")]
        if x == "quote":
            return [(left, x)]
        return [(max(0, left - 1), f"{x}_negated" if x in HITS and left else x)]

    return Transducer.of(0, lambda s: True, threat_machine().outputs(), step)


def report_machine() -> Transducer:
    """Hits between quotes, or in a clause with a word of saying, are reported.

    States: whether quotes are open, and whether a word of saying has come (``said``), is
    guessed to come (``will``) or guessed to stay away (``wont``); before the first hit
    nothing is guessed. A wrong guess has no path to the end.
    """

    def step(state: tuple[bool, str], x: str) -> list[tuple[tuple[bool, str], str]]:
        quoted, word = state
        if x == "quote":
            return [((not quoted, word), "other")]
        if x == "report":
            return [] if word == "wont" else [((quoted, "said"), "other")]
        if x.split("_")[0] not in HITS:
            return [(state, x)]
        reported = x.split("_")[0] + "_reported"
        if quoted or word in ("said", "will"):
            return [(state, reported)]
        if word == "wont":
            return [(state, x)]
        return [((quoted, "will"), reported), ((quoted, "wont"), x)]

    return Transducer.of((False, ""), lambda s: s[1] != "will", negation_machine().outputs(), step)


def target_machine() -> Transducer:
    """Hits in a clause with a target are aimed; a target that is still to come is guessed."""

    def step(state: str, x: str) -> list[tuple[str, str]]:
        if x == "target":
            return [] if state == "none" else [("seen", "other")]
        if x.split("_")[0] not in HITS:
            return [(state, "other")]
        if state in ("seen", "later"):
            return [(state, f"{x}_aimed")]
        return [("none", x)] if state else [("later", f"{x}_aimed"), ("none", x)]

    return Transducer.of("", lambda s: s != "later", report_machine().outputs(), step)


@cache
def clause_machine() -> Transducer:
    return compose(insult_machine(), threat_machine(), negation_machine(), report_machine(), target_machine())


@lru_cache(20_000)
def _known(classes: tuple[str, ...]) -> list[str]:
    return clause_machine().run(classes)


def clause_kinds(classes: tuple[str, ...]) -> list[str]:
    """For each word of a clause its kind of hit, or ``other``."""
    return _known(classes) if len(classes) <= 60 else clause_machine().run(classes)


class Lexicon:
    """A trie over letters: listed words whole, stems with any ending."""

    def __init__(self, stems: dict[str, float]) -> None:
        self.arcs: dict[tuple[int, str], int] = {}
        self.word: dict[int, str] = {}
        self.stem: dict[int, float] = {}
        for kind, listed in WORDS.items():
            for w in listed.split():
                self.word[self._add(w)] = kind
        for s, strength in stems.items():
            self.stem[self._add(s)] = strength

    def _add(self, letters: str) -> int:
        state = 0
        for c in letters:
            state = self.arcs.setdefault((state, c), len(self.arcs) + 1)
        return state

    def read(self, word: str) -> tuple[str, float]:
        """Class and strength; the longest stem wins, and a stem wins over a listed word."""
        state, strength = 0, 0.0
        for c in word:
            state = self.arcs.get((state, c), -1)
            if state < 0:
                break
            strength = self.stem.get(state, strength)
        if strength:
            return "insult", strength
        return self.word.get(state, "other"), 1.0


def lowered(text: str) -> str:
    """Lower case, with typographic apostrophes inside words as plain ones."""
    low = text.lower()
    return _APOSTROPHE.sub("'", low) if "’" in low or "ʼ" in low or "‘" in low else low


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(lowered(text))) if text else set()


@dataclass
class Grammar:
    """Learned stems with strengths from 0 to 1, and weights; ``score`` is a function of the text alone."""

    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def __post_init__(self) -> None:
        heads = [*(re.escape(s) + r"[^\W_]*" for s in sorted(self.stems, key=lambda s: (-len(s), s))), *(re.escape(w) + r"(?![^\W_])" for w in WORDS["threat"].split())]
        self._hit = re.compile(r"(?<![^\W_])(?:" + "|".join(heads) + ")")
        self._lexicon = Lexicon(self.stems)

    def __getstate__(self) -> dict:
        return {"stems": self.stems, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def clause(self, clause: str) -> dict[str, float]:
        """The kinds of hit in a clause, each with the strength of its strongest hit."""
        read = [("quote", 1.0) if t in '"«»„“”' else self._lexicon.read(t) for t in _TOKEN.findall(clause)]
        best: dict[str, float] = {}
        for kind, (_, strength) in zip(clause_kinds(tuple(c for c, _ in read)), read, strict=True):
            if kind != "other":
                best[kind] = max(best.get(kind, 0.0), strength)
        return best

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses that hold a hit, lower-cased."""
        low = lowered(text)
        done = -1
        for hit in self._hit.finditer(low):
            if hit.start() >= done:
                begin = max((low.rfind(c, max(0, done), hit.start()) for c in ".!?;\n|"), default=-1)
                begin = max(begin + 1, done, 0)
                end = _END.search(low, hit.end())
                done = end.start() if end else len(low)
                yield low[begin:done]

    def features(self, text: str | None) -> np.ndarray:
        """1, and for each kind the logarithm of 1 plus its clauses' strengths."""
        out = np.zeros(len(KINDS) + 1)
        for clause in self.clauses(text) if text else ():
            for kind, strength in self.clause(clause).items():
                out[1 + KINDS.index(kind)] += strength
        out = np.log1p(out) / np.log(2)
        out[0] = 1
        return out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -700, 700))))


def asserted(text: str | None) -> str:
    """A text without the clauses that hold a negation, a word of saying or quotes."""
    listed = {*WORDS["negation"].split(), *WORDS["report"].split(), *'"«»„“”'}
    return "\n".join(c for c in _END.split(lowered(text or "")) if listed.isdisjoint(_TOKEN.findall(c)))


def stems_of(text: str | None) -> set[str]:
    return {w[:k] for w in words(text) for k in STEM_CHARS if len(w) >= k}


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each label that have a stem in an asserted clause, so that a quoted or negated insult speaks for neither."""
    for b in batches:
        counts = Counter(), Counter()
        for text, toxic in zip(b["text"], b["toxic"].to_pylist(), strict=True):
            counts[toxic].update(stems_of(asserted(text.as_py())))
        names = sorted({*counts[0], *counts[1]})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[y][s] for s in names], pa.int64()) for y in (1, 0))], ["stem", "in_toxic", "in_clean"])


def log_ratio(t: F.Column, c: F.Column, n_t: int, n_c: int) -> F.Column:
    """Log likelihood ratio of separate rates for both labels over a common one."""
    part = lambda k, n: F.when(k == 0, 0.0).otherwise(k * F.log(k / n / ((t + c) / (n_t + n_c)))) + F.when(k == n, 0.0).otherwise((n - k) * F.log((1 - k / n) / (1 - (t + c) / (n_t + n_c))))
    return part(t, F.lit(n_t)) + part(c, F.lit(n_c))


def cover(rows: list[set[str]], worth: dict[str, float], least_gain: float = LEAST_GAIN) -> list[str]:
    """Stems that cover the toxic rows twice, greedily by new rows times ``worth``.

    Of stems in the same rows the longest counts; beginnings and longer forms of a chosen
    stem are no longer looked at.
    """
    inside = {s: np.zeros(len(rows), bool) for s in worth}
    for i, own in enumerate(rows):
        for s in own:
            inside[s][i] = True
    best: dict[bytes, str] = {}
    for s, has in inside.items():
        if (len(s), s) > (len(best.get(has.tobytes(), "")), best.get(has.tobytes(), "")):
            best[has.tobytes()] = s
    names = sorted(best.values())
    table = np.array([inside[s] for s in names]).reshape(len(names), len(rows))
    weight, size = np.array([worth[s] for s in names]), table.sum(1)
    count = np.zeros(len(rows), int)
    out: list[str] = []
    while len(names):
        gain = (table & (count < 2)).sum(1)
        gain = np.where(gain >= np.maximum(max(2, least_gain * len(rows)), 0.02 * size), gain * weight, 0)
        top = int(gain.argmax())
        if not gain[top]:
            break
        out.append(names[top])
        count += table[top]
        table[[s.startswith(names[top]) or names[top].startswith(s) for s in names]] = False
    return sorted(out)


def fit_weights(x: np.ndarray, y: np.ndarray, spread: float = 2.0, steps: int = 30) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to the prior with standard deviation ``spread``."""
    w = PRIOR.copy()
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + (w - PRIOR) / spread**2
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread**2
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return w


def in_fold(doc_id: str = "doc_id") -> F.Column:
    """True for rows kept from training: crc32 of the id's text is a multiple of five."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``text, toxic`` of at most ``most`` rows of each label outside the held-out fold; equal texts count once."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    halves = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    chosen = F.broadcast(halves[0].unionByName(halves[1]))  # at most 2 * most rows of two numbers
    return docs.select("doc_id", "text").join(chosen, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic").distinct()


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, least_gain: float = LEAST_GAIN) -> Grammar:
    """Learn a grammar from labelled rows outside the held-out fold.

    At most ``most`` rows of each label, the smallest by a hash of the id, are read. A word
    beginning becomes a stem if its rows of both labels differ more than chance would let
    any of all beginnings differ, and toxic rows have it ``LEAST_RATIO`` times as often;
    then the toxic rows are covered greedily. Counting is done where the texts are: only
    beginnings that pass, their rows and the rows' features come to the driver. Rows with a
    null label are ignored; null and empty texts have no stem. Without toxic rows the
    grammar has the prior weights and its threat words only.
    """
    rows = materialize(labelled(docs, labels, most), "labelled")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_t, n_c = sizes.get(1, 0), sizes.get(0, 0)
    if not n_t or not n_c:
        return Grammar()
    counts = rows.mapInArrow(_stem_counts, "stem string, in_toxic long, in_clean long").groupBy("stem").agg(F.sum("in_toxic").alias("t"), F.sum("in_clean").alias("c"))
    counts = materialize(counts, "stems")
    t, c = F.col("t"), F.col("c")
    rate_t, rate_c = t / n_t, (c + F.lit(0.3)) / (n_c + 1)
    passed = counts.where((rate_t >= LEAST_RATIO * rate_c) & (log_ratio(t, c, n_t, n_c) >= float(np.log(max(2, counts.count())))))
    found = passed.select("stem", ((rate_t - rate_c) / (rate_t + rate_c)).alias("strength"), (1 - CLEAN_COST * rate_c / rate_t).alias("worth")).collect()
    strength, worth = ({r["stem"]: r[c] for r in found} for c in ("strength", "worth"))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(stems_of(text.as_py()).intersection(strength)) for text in b["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["stems"])

    hits = rows.where("toxic = 1").select("text").mapInArrow(present, "stems array<string>").where("size(stems) > 0")
    grammar = Grammar({s: strength[s] for s in cover([set(r["stems"]) for r in hits.collect()], worth, least_gain)})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [grammar.features(text.as_py()).tolist() for text in b["text"]]
            yield pa.RecordBatch.from_arrays([b["toxic"], pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

    measured = rows.mapInArrow(measure, "toxic int, x array<double>").collect()
    pairs = sorted((r["x"], r["toxic"]) for r in measured)  # a fixed order of sums
    grammar.weights = fit_weights(np.array([x for x, _ in pairs]), np.array([y for _, y in pairs], float))
    return grammar


def cross_validated(docs: DataFrame, labels: DataFrame, least_gains: tuple[float, ...], folds: int = 4, most: int = MAX_LABELLED) -> dict[float, float]:
    """Accuracy by values of ``least_gain``, each from models that have not seen the rows they judge.

    Only rows outside the held-out fold are read, whatever the value: they are dealt to
    ``folds`` parts by the CRC-32 of their ids, one part judged by a grammar of the others.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold())
    part = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5) % folds
    out = {}
    for gain in least_gains:
        right = []
        for k in range(folds):
            judged = own.where(part == k).select("doc_id", "toxic")
            scored = score(docs.join(judged, "doc_id", "left_semi"), fit(docs, own.where(part != k), most, gain)).join(judged, "doc_id")
            right.append(scored.agg(F.sum(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int")), F.count(F.lit(1))).first())
        out[gain] = sum(r[0] or 0 for r in right) / max(1, sum(r[1] for r in right))
    return out


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id, score`` of every whole text; null and empty texts get the score of no clause.

    Extra columns are ignored whatever their names; an empty table gives an empty result;
    equal texts get equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                scores = [grammar.score(t.as_py()) for t in part["text"]]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text scores under ``threshold``.

    Whole texts are scored, however long; null and empty ones have the score of no clause
    and stay. Equal texts share their fate; a score of exactly ``threshold`` is rejected.
    Extra columns pass through, whatever their names; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [grammar.score(t.as_py()) < threshold for t in b["text"]]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
