"""Secret scans with corpus-wide ownership frequency (operator 7, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, meet, running, stage

# The base patterns.  Runs shorter than a pattern's least length can't hold a
# longer match, so access and hex state it in the pattern; assign is filtered afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_CHARS = 12
#: A further candidate: a long run of key characters with a digit, a small and a capital letter.
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
#: A candidate seen in more documents or with more owners than this counts as widely copied.
MAX_OWNERS, MAX_REPOSITORIES = 1, 3

SPANS = "array<struct<begin:int,rank:int,end:int,kind:string,value:string>>"


def spans(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """Leftmost non-overlapping matches as an array of (begin, rank, end, kind, value), in code points.

    Their places follow from the running lengths of the matches and of the pieces between them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    pair = F.arrays_zip(F.split(text, pattern, -1).alias("p"), found.alias("m"), value.alias("v"))

    def placed(pairs: Column) -> Column:
        ends = running(pairs, F.lit(0), lambda at, x: at + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0)), "int")
        hit = lambda x: F.struct((x["end"] - F.length(x["pair"]["m"])).alias("begin"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["pair"]["v"].alias("value"))
        return F.transform(F.filter(F.arrays_zip(pairs.alias("pair"), ends.alias("end")), lambda x: x["pair"]["m"].isNotNull()), hit)

    # texts without a match, nearly all, are not split
    return F.when(F.size(found) > 0, bound(pair, placed)).otherwise(F.array().cast(SPANS))


def clear_of(found: Column, others: Column) -> Column:
    """The spans of ``found`` that meet none of ``others``.

    In the order of place, a span meets another if the furthest end of those that begin before its own end lies
    behind its begin.
    """
    mark = lambda what, at: lambda s: F.struct(s[at].alias("at"), F.lit(what).alias("what"), s.alias("s"))
    marks = F.array_sort(F.concat(F.transform(others, mark(1, "begin")), F.transform(found, mark(0, "end"))))

    def judged(m: Column) -> Column:
        furthest = running(m, F.lit(0), lambda most, x: F.when(x["what"] == 1, F.greatest(most, x["s"]["end"])).otherwise(most), "int")
        free = F.filter(F.arrays_zip(m.alias("m"), furthest.alias("most")), lambda x: (x["m"]["what"] == 0) & (x["most"] <= x["m"]["s"]["begin"]))
        return F.transform(free, lambda x: x["m"]["s"])

    return F.when(F.size(found) > 0, bound(marks, judged)).otherwise(found)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and further candidates of every whole text, without the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    assign = F.filter(spans(F.col("text"), ASSIGN, "assign", 0), lambda s: F.length(s["value"]) >= ASSIGN_CHARS)
    opaque = F.filter(spans(F.col("text"), OPAQUE, "opaque", 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    rows = rows.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), assign.alias("a"), spans(F.col("text"), ACCESS, "access", 1).alias("k"), spans(F.col("text"), HEX, "hex", 2).alias("h"), opaque.alias("o"))
    return rows.select("doc_id", "source", "text_hash", F.size("a").alias("n_assign"), F.size("k").alias("n_access"), F.size("h").alias("n_hex"), F.array_sort(F.concat("a", "k", "h")).alias("base"), "o")


def find_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Secrets of every row of ``docs(doc_id, text, source)``: repository = document, owner = source.

    Candidates are the values of the base matches and opaque runs of key characters.  A
    candidate's hash is counted over distinct documents and distinct owners of the whole
    corpus.  One that stays within ``max_owners`` and ``max_repositories`` looks live, else
    it is a widely copied example.  Base spans are always kept; live opaque runs outside them
    are added as kind ``opaque``.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied``.
    Null text counts as empty (the digest of no bytes, empty spans); a null source is an
    owner of its own; rows that repeat a doc_id and text get equal results and count once;
    extra columns are not read.
    """
    rows = stage(scan(docs).withColumn("o", clear_of(F.col("o"), F.col("base"))), "secrets")
    hits = rows.select("doc_id", "source", "text_hash", F.explode(F.concat("base", "o")).alias("s"))
    hits = hits.select("doc_id", "source", "text_hash", F.struct("s.begin", "s.rank", "s.end", "s.kind").alias("span"), F.xxhash64("s.value").alias("c1"), F.xxhash64(F.lit(1), "s.value").alias("c2")).distinct()
    # partial sums of distinct pairs: a candidate of a third of all rows is never gathered in a task
    seen = hits.groupBy("c1", "c2", "source", "doc_id").agg(F.count(F.lit(1)).alias("hits")).groupBy("c1", "c2", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("hits").alias("hits"))
    owned = seen.groupBy("c1", "c2").agg(F.sum("docs").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.sum("hits").alias("n"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    owned = stage(owned.select("c1", "c2", "n", live.alias("live")), "owned")
    judged = meet(hits, owned, ["c1", "c2"], ["doc_id", "span"])
    judged = judged.groupBy("doc_id", "text_hash").agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"), F.collect_set(F.when(F.col("live") & (F.col("span.kind") == "opaque"), F.col("span"))).alias("added"))
    judged = judged.select(F.col("doc_id").alias("j_doc"), F.col("text_hash").alias("j_hash"), "n_live", "n_copied", "added")
    out = rows.join(judged, F.col("doc_id").eqNullSafe(F.col("j_doc")) & (F.col("text_hash") == F.col("j_hash")), "left")
    base = F.transform("base", lambda s: F.struct(s["begin"].alias("begin"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    every = F.array_sort(F.concat(base, F.coalesce("added", F.array().cast("array<struct<begin:int,rank:int,end:int,kind:string>>"))))
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied")])
