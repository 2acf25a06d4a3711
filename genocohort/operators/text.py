"""Scans and ranking of texts (FL6-FL8, TK4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Words that say nothing about a question.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "have", "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "that", "the", "this", "to", "was", "what", "with")


def phrases_hit(text, phrases) -> Column:
    body = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.filter(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: body.contains(p))


def banned_phrase_scan(df: DataFrame, text_cols, phrases) -> DataFrame:
    """Rows with a banned phrase, and the phrases found."""
    hits = phrases_hit(F.concat_ws("\n", *text_cols), phrases)
    return df.withColumn("phrases", hits).where(F.size("phrases") > 0)


def redact_tokens(df: DataFrame, text_col: str, tokens_col: str, mask: str = "[removed]") -> DataFrame:
    """Mask a row's own tokens in its text, longest first; ``leaks`` counts those still there."""
    ordered = F.array_sort(F.coalesce(tokens_col, F.array().cast("array<string>")), lambda a, b: F.length(b) - F.length(a))
    clean = F.aggregate(F.filter(ordered, lambda t: t != ""), F.col(text_col), lambda acc, t: F.replace(acc, t, F.lit(mask)))
    out = df.withColumn("redacted", clean)
    return out.withColumn("leaks", F.size(F.filter(F.coalesce(tokens_col, F.array().cast("array<string>")), lambda t: (t != "") & F.coalesce(F.col("redacted").contains(t), F.lit(False)))))


def licence_gate(df: DataFrame, licence_col: str, forbidden) -> DataFrame:
    """Records whose licence text has no forbidden term; a blank one is allowed."""
    return df.where(F.size(phrases_hit(licence_col, forbidden)) == 0)


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9*]{2,}"), F.lit(0)), lambda t: ~t.isin(*STOPWORDS)))


def rank_by_terms(df: DataFrame, questions: DataFrame, text_cols, k: int, id_col: str = "rsid", gene_col: str | None = None, weight_col: str | None = None) -> DataFrame:
    """The ``k`` best rows for each question by shared terms: the row's id counts 100, its gene 40, another term 12.

    Rows become an inverted table of (term, row), which meets the questions' few terms.
    """
    asked = questions.select("question_id", F.explode(terms_of(F.col("text"))).alias("term"))
    rows = df.select(F.col(id_col).alias("id"), (F.col(gene_col) if gene_col else F.lit(None).cast("string")).alias("gene"), (F.col(weight_col) if weight_col else F.lit(0.0)).cast("double").alias("weight"), F.explode(F.array_union(terms_of(F.concat_ws(" ", *text_cols)), F.array(F.lower(F.col(id_col).cast("string"))))).alias("term"))
    points = F.when(F.col("term") == F.lower(F.col("id").cast("string")), 100).when(F.col("term") == F.lower("gene"), 40).otherwise(12)
    score = rows.join(asked, "term").groupBy("question_id", "id").agg(F.sum(points).alias("score"), F.max("weight").alias("weight"))
    w = W.partitionBy("question_id").orderBy(F.desc("score"), F.desc("weight"), "id")
    out = score.withColumns({"rank": F.row_number().over(w)})
    return out.where(F.col("rank") <= k)
