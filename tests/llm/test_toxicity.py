import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tamarack.llm import toxicity
from tamarack.llm.queries import op2_toxicity
from tamarack.llm.transducer import compose

from .helpers import rows, table


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    p = y.sum()
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = rows(op2_toxicity(spark, sf))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    y, s = held.toxic.to_numpy(), held.score.to_numpy()
    assert auc(y, s) > 0.94  # about one label in a hundred is drawn at random here
    assert ((s >= 0.5) == y).mean() > 0.975
    assert (held.predicted == (held.score >= 0.5)).all()


def recognise(classes):
    """The kinds of a clause's hits from their definitions, looking at the whole clause at once."""
    out = []
    for i, x in enumerate(classes):
        if x not in ("insult", "threat"):
            out.append("other")
            continue
        kind = "intent" if x == "threat" and "future" in classes[:i] else x
        reach, near = toxicity.NEGATION_REACH, False
        for y in reversed(classes[:i]):
            if y == "contrast" or not reach:
                break
            if y == "negation":
                near = True
                break
            reach -= y != "quote"
        if "report" in classes or classes[:i].count("quote") % 2:
            kind += "_reported"
        elif near:
            kind += "_negated"
        out.append(kind + "_aimed" * ("target" in classes))
    return out


def test_machine_against_definitions():
    rng = random.Random(8)
    for _ in range(20_000):
        classes = tuple(rng.choice(toxicity.CLASSES) for _ in range(rng.randrange(10)))
        assert toxicity.clause_kinds(classes) == recognise(classes), classes
    for x in toxicity.CLASSES:
        for y in toxicity.CLASSES:
            for z in toxicity.CLASSES:
                assert toxicity.clause_machine().run((x, y, z)) == recognise((x, y, z))
    long = tuple(rng.choice(toxicity.CLASSES) for _ in range(3000))
    assert toxicity.clause_kinds(long) == recognise(long)


def test_composition_is_one_after_the_other():
    machines = [toxicity.insult_machine(), toxicity.threat_machine(), toxicity.negation_machine()]  # these never guess
    whole, rng = compose(*machines), random.Random(2)
    for _ in range(2000):
        symbols = [rng.choice(toxicity.CLASSES) for _ in range(rng.randrange(12))]
        want = symbols
        for m in machines:
            want = m.run(want)
        assert whole.run(symbols) == want


def slow_score(grammar, text):
    """The score from the definitions: split, classify word by word, recognise, add up."""
    x = dict.fromkeys(toxicity.KINDS, 0.0)
    for clause in re.split(r"[.!?;\n|]", (text or "").lower()):
        tokens = re.findall(r"[^\W_]+(?:'[^\W_]+)?|[\"«»„“”]", clause)
        read = []
        for t in tokens:
            stems = [s for s in grammar.stems if t.startswith(s)]
            listed = [k for k, ws in toxicity.WORDS.items() if t in ws.split()]
            read.append(("insult", grammar.stems[max(stems, key=len)]) if stems else ("quote", 1) if t in '"«»„“”' else (listed[0] if listed else "other", 1))
        best = {}
        for kind, (_, strength) in zip(recognise([c for c, _ in read]), read):
            best[kind] = max(best.get(kind, 0), strength)
        for kind in set(best) - {"other"}:
            x[kind] += best[kind]
    z = grammar.weights[0] + sum(w * math.log2(1 + x[k]) for k, w in zip(toxicity.KINDS, grammar.weights[1:]))
    return 1 / (1 + math.exp(-z))


def test_query_against_slow_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grammar = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert grammar.stems
    got = rows(op2_toxicity(spark, sf))
    texts = dict(docs.select("doc_id", "text").collect())
    assert len(got) == len(texts)
    for r in got.itertuples():
        assert abs(r.score - slow_score(grammar, texts[r.doc_id])) < 1e-12 and r.predicted == (r.score >= 0.5)


def test_clauses_not_words():
    g = toxicity.Grammar({"idiot": 1.0, "scum": 1.0})
    score = g.score
    assert score("You are an idiot.") > score("An idiot.") > score("He is not an idiot")
    assert score("not an idiot") < 0.5 < score("you idiot")
    assert score("someone said idiot once") < 0.5
    assert score('"idiot", he wrote') < score("idiot")  # a word of saying may follow
    assert score("not nice but an idiot") == score("an idiot")
    assert score("I will kill you") > 0.5 > score("the pills kill germs")
    assert score("kill you") > score("never kill you") == score("calm")
    assert score("") == score(None) == score("a calm text")
    assert score("idiotproof scum") == score("IDIOTPROOF SCUM")


def test_a_quoted_insult_does_not_hide_the_stem(spark):
    texts = [f"you wobbler number{i}" for i in range(60)] + [f"he said wobbler, case{i}" for i in range(20)] + [f"calm words {i} and more" for i in range(200)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 0, int(i < 60)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    g = toxicity.fit(docs, labels)
    assert any("wobbler".startswith(s) or s.startswith("wobbler") for s in g.stems)
    assert g.score("you wobbler") > 0.5 > g.score("she said wobbler")


def test_edges(spark):
    g = toxicity.Grammar({"idiot": 1.0})
    texts = [None, "", "you idiot", "you idiot", "word " * 200_000 + "you idiot"]
    got = rows(toxicity.score(table(spark, texts), g))
    assert got.score[0] == got.score[1] < 0.5 < got.score[2] == got.score[3] == got.score[4]
    assert toxicity.score(table(spark, texts).where("doc_id < 0"), g).count() == 0
    kept = rows(toxicity.reject(table(spark, texts), g))
    assert list(kept.doc_id) == [0, 1] and "rep" in kept.columns


def test_no_labels(spark):
    docs = table(spark, ["calm", "words"])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    g = toxicity.fit(docs, labels)
    assert g.stems == {} and g.score("calm") < 0.5


def test_apostrophes_and_negative_pronouns():
    grammar = toxicity.Grammar({"idiot": 1.0})
    for said in ("you aren’t an idiot", "you aren't an idiot", "nobody is an idiot", "niemand ist ein idiot", "nadie es idiota"):
        assert set(grammar.clause(next(grammar.clauses(said)))) <= {"insult_negated", "insult_negated_aimed"}, said
    assert set(grammar.clause(next(grammar.clauses("you are an idiot")))) == {"insult_aimed"}
    assert toxicity.words("Aren’t ’quoted’") == {"aren't", "quoted"}


def test_cross_validation_sees_training_rows_only(spark):
    """Labels of the held-out fold may say anything."""
    texts = [f"word{i % 7} and so on. " + ("you idiot" if i % 2 else "fine day") for i in range(120)]
    docs = table(spark, texts)
    right = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    wrong = right.withColumn("toxic", F.when(toxicity.in_fold(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.cross_validated(docs, labels, (0.01,), folds=2) for labels in (right, wrong))
    assert a == b == {0.01: 1.0}
