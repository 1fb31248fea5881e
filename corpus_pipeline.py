"""Corpus preparation in five stages; each is written as Parquet and read by the next.

Every stage takes the columns of ``documents``; further columns pass through whatever their
names, the last stage leaves them out. Whole texts are read, however long; an empty table
gives an empty result; ``doc_id`` must be unique. Equal texts are documents of their own
until the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import linededup, minhash, mixing, packing, toxicity
from tamarack.llm.common import materialize, read_table
from tamarack.llm.queries import MIX_WEIGHTS, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose toxicity score is 0.5 or more (ties go).

    Null and empty texts hold no clause and stay; null labels are ignored.
    """
    return toxicity.reject(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep each repeated line in its first document only; every document stays.

    A null or empty text becomes one empty line; a text may lose all its lines and be empty.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(1).alias("_"), *rest).alias("_rest"))  # one column, so no name can clash
    out = linededup.dedup_lines(packed, carry=("_rest",))
    size = F.char_length("kept_text").cast("long")
    col = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": size} | {c: F.col("_rest").getField(c) for c in rest if c != "n_chars"}
    return out.select(*(col[c].alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class, the one with the smallest ``doc_id``.

    Null, empty and blank texts are in no class and all stay.
    """
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spread four fifths of the tokens over sources by weight; no document is repeated.

    Null ``source`` and ``lang`` count as ``unknown``; null and empty texts have no tokens
    and are taken where a source's prefix passes them.
    """
    chosen = mixing.mix(docs, MIX_WEIGHTS, fraction=0.8, max_epochs=1, tokenizer_path=tokenizer_file("word_bpe_49k.json")).select("doc_id")
    return docs.join(chosen, "doc_id", "left_semi").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of 4096; null and empty texts hold the end mark alone."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, connected classes and packing have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
