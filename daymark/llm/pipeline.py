"""From raw documents to token ids: language, exact copies, near copies, mixture, tokens.

Every stage takes the documents its predecessor kept; all but the last return their columns, whatever
else the documents carry.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.llm import bpe, exact, language, mixing, near
from daymark.llm.sift import Sift, fresh
from daymark.session import materialise

#: Two scores closer than this are equal.
SAME_SCORE = 1e-6


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter, and unlabelled ones in no learned language.

    A labelled language is a learned one. Without a label, a text that leaves the model less certain
    than no text at all shows none.
    """
    model = language.train(docs)
    told, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = language.identify(docs, model, added=(told, score))
    unread = float(language.softmax(model.bias / model.temperature).max()) if model else 1.0
    shown = F.col("lang").isNotNull() | (F.col(score) >= unread - SAME_SCORE)
    return found.filter((F.col(told) != language.UNKNOWN) & shown).drop(told, score)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return exact.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (5-word shingles, 0.8) the smallest id stays."""
    classes = near.near_duplicates(docs)
    gone = fresh(docs, "gone")
    dropped = classes.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    dropped = materialise(dropped, "near-dropped")
    # Only documents that may be among the dropped ones are joined with them. Hashes differ by type.
    identity = F.col("doc_id").cast("long")
    clear, unsure = Sift(dropped, F.col(gone)).split(docs, identity)
    return clear.unionByName(unsure.join(dropped, identity == F.col(gone), "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    model = bpe.WordBpe.load(tokenizer_path("word_bpe_49k.json"))
    ids = bpe.encode(docs, model, keep=["doc_id", "source"])
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", keep_language),
    ("exact", drop_exact),
    ("near", drop_near),
    ("mixture", mix_sources),
    ("tokens", encode),
]

#: A trained language model and random rounding have no SQL; tests compare the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
