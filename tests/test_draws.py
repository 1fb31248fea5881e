"""Random changes of characters: the same draws as a Spark expression for each character, without one."""

import numpy as np
from pyspark.sql import functions as F

from tamarack.functions import draws, fixed, perturb
from tamarack.plans.registry import QUERIES

CASES = "ßŉΐﬃᾧİıΣσςǅǆÀéЖжԱև𐐀𐐨ⅷⓐẞ日本🙂é\t\n\u0000\x7f\U0010fffd"
TEXTS = ["plain words only", None, "a", " ", CASES, CASES * 40, "Straße für Straße, " * 5000, "x", "𐐀" * 40000, "Zoë " * 3] * 12 + ["peace " * 30000] + ["".join(chr(c) for c in range(1, 1 << 17) if not 0xD800 <= c < 0xE000)] * 6


def _draw(i, seed):
    return F.pmod(F.xxhash64("key", i, F.lit(seed)), F.lit(100))


def _each(change):
    return F.array_join(F.transform(F.split("text", ""), change), "")


def plain():
    """What each change means, character by character."""
    return {
        "homoglyph": _each(lambda c, i: F.when(_draw(i, 1) < 60, F.translate(c, *fixed.HOMOGLYPH_NINE)).otherwise(c)),
        "casing": _each(lambda c, i: F.when(_draw(i, 2) < 50, F.upper(c)).otherwise(F.lower(c))),
        "zero_width": _each(lambda c, i: F.when(_draw(i, 3) < 30, F.concat(c, F.substring(F.lit(fixed.ZERO_WIDTH), F.pmod(_draw(i, 4), F.lit(4)).cast("int") + 1, F.lit(1)))).otherwise(c)),
    }


def test_draws_are_those_of_spark(spark):
    rows = spark.createDataFrame([(i * 7919 - 900_000, t) for i, t in enumerate(TEXTS)], "key long, text string").repartition(3)
    t, k = F.col("text"), F.col("key")
    made = {"homoglyph": perturb.random_homoglyph(t, k, 60), "casing": perturb.random_casing(t, k), "zero_width": perturb.zero_width_insertion(t, k)}
    want = plain()
    both = rows.select("key", "text", *(F.struct(want[n].alias("want"), c.alias("got")).alias(n) for n, c in made.items()))
    wrong = both.select(*(F.count_if(~F.col(f"{n}.want").eqNullSafe(F.col(f"{n}.got"))).alias(n) for n in made), F.count(F.lit(1)).alias("n"))
    assert wrong.first().asDict() == {"homoglyph": 0, "casing": 0, "zero_width": 0, "n": len(TEXTS)}


def test_no_step_for_each_character(spark, sf_dir):
    """The query and the transforms of the report go through Python once, with nothing made of single characters before."""
    key, rows = F.col("id"), spark.range(3).withColumn("text", F.lit("some text"))
    report = perturb.fan_out(rows, perturb.script_transforms(key))
    for df in (QUERIES["perturb_random"](spark, sf_dir), report):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and plan.count("ArrowEvalPython ") == plan.count("run(") == 1, plan


def test_empty_stays_empty(spark):
    rows = spark.range(200).withColumn("text", F.lit(""))
    made = perturb.zero_width_insertion(F.col("text"), F.col("id"))
    assert rows.where(made != "").count() == 0


def test_other_bytes_stay(spark):
    """Bytes that are no UTF-8 are neither an error nor changed."""
    rows = spark.range(50).withColumn("text", F.concat(F.lit("ab "), F.unhex(F.lit("FFC3E28228")).cast("string"), F.lit(" é")))
    got = rows.select(F.hex(perturb.random_casing(F.col("text"), F.col("id")).cast("binary")).alias("h")).collect()
    assert {r.h[6:-4] for r in got} == {"FFC3E2822820C3"[:10] + "20"} and len({r.h for r in got}) > 2


def test_pieces_have_bounded_bytes():
    sizes = np.array([5, 0, 5, 30, 1, 1, 1, 1, 9, 2])
    got = [(c.start, c.stop) for c in draws.cuts(sizes, 3, 10)]
    assert got == [(0, 3), (3, 4), (4, 7), (7, 9), (9, 10)]
    assert list(draws.cuts(sizes[:0])) == []
