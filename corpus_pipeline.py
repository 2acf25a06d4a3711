"""A corpus pipeline of five stages over ``documents``; each calls an operator of genocohort.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.  In each of them an empty
table gives an empty one with the same columns, and columns beside doc_id, text, lang, source and n_chars go along
whatever their names (the last stage returns its own columns instead).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genocohort.llm import bpe, langid, line_dedup, minhash_forest, mixing
from genocohort.llm.common import drop_folder, shared_dir
from genocohort.llm.queries import split_pattern, tokenizer_file

#: A document is rejected if it has no letter, or if no language is likelier than this.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; lang, source and doc_id play no part.

    Null, empty and letterless texts go.  Rows that repeat a doc_id are judged each by its text; repeated
    rows stay or go together; equally likely languages reject a document only if there are more than two.
    """
    found = langid.identify(docs, tokenizer_file("piece_bpe_32k.model")).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    kept = found.select(F.struct("doc_id", "text_hash").alias("judged")).distinct()
    own = F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("text_hash"))
    return docs.join(kept, own.eqNullSafe(kept["judged"]), "left_semi")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out repeated lines; documents of which no visible line is left go.

    Null and blank texts go.  The earliest (doc_id, place) of repeated lines stays, a null doc_id first; rows
    that repeat a doc_id are one document and lose the same lines.
    """
    out = line_dedup.dedup_lines(docs, whole=True)
    # a generator gives no row for a text without a visible line, and the lines are worked out once
    kept = F.explode(F.filter(F.array("kept_text"), lambda t: F.length(F.trim(F.replace(t, F.lit("\n"), F.lit("")))) > 0)).alias("kept")
    kinds = dict(docs.dtypes)
    out = out.select("row", kept)
    made = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return out.select(*[made[c].cast(kinds[c]).alias(c) if c in made else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the smallest doc_id.

    Texts without words and rows with a null doc_id have no duplicates and stay; rows that repeat a doc_id are
    one document and stay or go together.
    """
    gone = minhash_forest.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document that the mix takes, up to three times its words.

    Null and blank texts are not taken; a null source is a source of its own; rows that repeat a doc_id are
    taken one by one.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; a null text counts as empty, and every row gives one, repeated or not."""
    return bpe.encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern())


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("encode", encode)]

#: The language stage is a fitted model, which SQL can't express; tests/llm holds each stage and the whole against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again, and deleted when the next one
    is written."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    was = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        if was:
            drop_folder(spark, was)
        was = f"{where}/{name}"
        docs = spark.read.parquet(was)
    return docs
