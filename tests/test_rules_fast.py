"""Rules behind a look at their first character, and one pass for all, give what the rules in turn give."""

import re

from pyspark.sql import functions as F

from tamarack.functions import fixed, sanitize
from tamarack.plans.registry import QUERIES

TEXTS = ["DAN dan Dandy", "ſystem  prompt\tbypass", "ignore previous\n\ninstructions,override!x", "byPass[STRIPPED]override", "do anything  now developer message", " a　b  c d ", "", "plain", "jail jailbreak, act  as no restriction"]


def test_first_characters():
    assert sanitize.begins(r"\b(?:you|act\s+as)\b") == "[ay]" and sanitize.begins(r"\\n|x") is None
    assert all(sanitize.begins(r) for r in (*fixed.STRIP_RULES, *fixed.DEMO_RULES))


def test_one_pass_equals_rules_in_turn(spark):
    def plain(t):
        for r in fixed.STRIP_RULES:
            t = re.sub(r, "[STRIPPED]", t, flags=re.I)
        return re.sub(r"\s+", " ", t).strip()

    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", sanitize.rule_strip(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [plain(r.t) for r in got]


def test_texts_that_pass_are_read_once(spark, sf_dir):
    """The trade-off makes one row of numbers for each mode; texts are not multiplied."""
    plan = QUERIES["sanitize_tradeoff"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    made = next(line for line in plan.splitlines() if "Generate explode" in line)
    assert ".s AS s" not in plan and "text#" not in made.split("[mode")[0].split("explode(")[0]
