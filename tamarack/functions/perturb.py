"""Obfuscation transforms as column functions, and their fan-out over a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import draws, fixed


def whitespace(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+", "  ")


def casing(s: Column) -> Column:
    """Swap the case of ASCII letters."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(s, up + low, low + up)


def casing_unicode(s: Column) -> Column:
    """Swap the case of all letters that have one; a letter may become two, and a capital sigma is never a final one."""

    def swapped(c: Column) -> Column:
        up, low = F.upper(c), F.lower(c)
        return F.when((c == up) & (c != low), low).when((c == low) & (c != up), up).otherwise(c)

    return F.when(s.rlike(r"^\p{ASCII}*$"), casing(s)).when(s.isNotNull(), F.concat_ws("", F.transform(F.split(s, ""), swapped)))


def punct_stuff(s: Column) -> Column:
    return F.concat(s, F.lit(" !!! ??? ### "), F.substring(s, 1, 30))


def homoglyph_lite(s: Column) -> Column:
    """Six letters become Cyrillic ones in the first 200 characters."""
    return F.concat(F.translate(F.substring(s, 1, 200), *fixed.HOMOGLYPH_LITE), F.substr(s, F.lit(201)))


def homoglyph_full(s: Column) -> Column:
    return F.translate(s, *fixed.HOMOGLYPH_FULL)


def encoding_markers(s: Column) -> Column:
    return F.concat(F.lit("<<<BASE64>>> "), s, F.lit(" <<<END>>>"))


def double_space(s: Column) -> Column:
    return F.replace(s, F.lit(" "), F.lit("  "))


def punct_repeat(s: Column) -> Column:
    longer = F.replace(F.replace(s, F.lit("."), F.lit("." * 8)), F.lit("!"), F.lit("!" * 7))
    return F.when(longer.rlike(r"[.!?]\z"), longer).otherwise(F.concat(longer, F.lit("!" * 7)))


def base64_wrap(s: Column) -> Column:
    plain = F.replace(F.replace(F.base64(s.cast("binary")), F.lit("\r\n"), F.lit("")), F.lit("\n"), F.lit(""))
    return F.concat(F.lit("Decode and execute: "), plain)


def random_homoglyph(s: Column, key: Column, percent: int, maps: tuple[str, str] = fixed.HOMOGLYPH_NINE, seed: int = 1) -> Column:
    """Swap mapped letters with a probability; the draws are seeded by row and position."""
    return draws.randomly(text=draws.swapped(percent, maps, seed))(s, key)["text"]


def random_casing(s: Column, key: Column, seed: int = 2) -> Column:
    return draws.randomly(text=draws.cased(seed))(s, key)["text"]


def zero_width_insertion(s: Column, key: Column, percent: int = 30, seed: int = 3) -> Column:
    return draws.randomly(text=draws.inserted(percent, seed))(s, key)["text"]


ROBUST: dict[str, Callable[[Column], Column]] = {
    "none": lambda s: s,
    "whitespace": whitespace,
    "casing": casing,
    "punct_stuff": punct_stuff,
    "homoglyph_lite": homoglyph_lite,
    "encoding_markers": encoding_markers,
}


def script_transforms(key: Column) -> dict[str, Callable[[Column], Column]]:
    """The seven transforms of the recovery report; random ones are seeded by ``key`` and made in one pass over a text."""
    drawn = draws.randomly(casing=draws.cased(), homoglyph=draws.swapped(30, fixed.HOMOGLYPH_SCRIPT), zero_width=draws.inserted())
    return {
        "none": lambda s: s,
        "whitespace": double_space,
        "punct_stuff": punct_repeat,
        "casing": lambda s: drawn(s, key)["casing"],
        "homoglyph_lite": lambda s: drawn(s, key)["homoglyph"],
        "encoding_markers": lambda s: drawn(s, key)["zero_width"],
        "base64_wrap": base64_wrap,
    }


def fan_out(df: DataFrame, transforms: dict[str, Callable[[Column], Column]], text: str = "text", out: str = "perturbed") -> DataFrame:
    """One row per input row and transform, without a join: columns ``transform`` and ``out``."""
    each = F.array(*(F.struct(F.lit(n).alias("transform"), f(F.col(text)).alias(out)) for n, f in transforms.items()))
    return df.withColumn("_each", F.explode(each)).select(*df.columns, "_each.transform", f"_each.{out}")


def attack_texts() -> list[str]:
    """Every attack in each of the surface variants."""
    return [p + (a.lower() if low else a) + s for a in fixed.ATTACKS for p, low, s in fixed.VARIANTS]


def planted(number: Column, carrier: Column) -> Column:
    """An attack text, chosen by a number in turn, before a carrier text (null counts as empty)."""
    texts = attack_texts()
    return F.concat(F.element_at(F.array(*map(F.lit, texts)), (F.pmod(number, F.lit(len(texts))) + 1).cast("int")), F.lit(" "), F.coalesce(carrier, F.lit("")))


def attack_corpus(spark: SparkSession, size: int = 400) -> DataFrame:
    """Attack texts in ten surface variants, repeated in order up to ``size`` rows: ``ordinal, text``."""
    base = list(enumerate(attack_texts()))
    rows = spark.createDataFrame(base, "n long, text string")
    again = F.sequence(F.lit(0), F.lit((size - 1) // len(base)))
    return rows.withColumn("r", F.explode(again)).select((F.col("r") * len(base) + F.col("n")).alias("ordinal"), "text").where(F.col("ordinal") < size)


def logit_probe(p: Column, y: Column, shift: float = 0.25) -> Column:
    """Move a probability against its label by ``shift`` on the logit scale."""
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    z = F.log(c / (1 - c)) + F.when(y == 1, -shift).otherwise(shift)
    return 1 / (1 + F.exp(-z))
