"""Append-only snapshots and what changed between them (WN7-WN10, JN23, JN24, ST3, SNK5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scoring import cpic_level, field, low, review_stars, sig_code

# Kinds of change with their severity.
SEVERITY = {
    "vus_resolved_pathogenic": 100, "sig_upgraded": 90, "vus_resolved_benign": 80, "sig_downgraded": 70, "sig_reclassified": 65, "carrier_status_changed": 62, "cpic_level_changed": 60, "finding_added": 55, "finding_removed": 50, "stars_gained": 45, "stars_lost": 40, "repute_changed": 35,
    "newly_evaluable": 30, "no_longer_evaluable": 25, "magnitude_changed": 10,
}
# Place on the benign to pathogenic axis; 0 is off the axis.
AXIS = {2: 1, 3: 2, 1: 3, 4: 4, 5: 5}
CPIC_RANK = {"": -1, "Retired": 0, "D": 1, "C/D": 2, "C": 3, "B/C": 4, "B": 5, "A/B": 6, "A": 7}
REPUTE_RANK = {"Good": 0, "": 1, "Bad": 2}
STATE = ("clinvar_sig_code", "review_stars", "cpic_level", "magnitude", "repute", "carrier", "evaluable")


def ranked(c: Column, table: dict, default: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(default))


def fingerprint(findings: DataFrame) -> DataFrame:
    """The state of each finding worth comparing, without prose, and its digest."""
    entity = F.coalesce(F.nullif(low(field(findings, "entity_type")), F.lit("")), F.lit("snp"))
    covered = field(findings, "coverage", "double")
    able = F.when(entity == "genoset", F.coalesce(covered >= 1.0, F.lit(False))).when(entity == "prs", F.coalesce(field(findings, "reliable", "boolean"), covered >= 0.9, F.lit(False))).otherwise(low(field(findings, "zygosity")) != "no_call")
    rep = F.coalesce(field(findings, "repute"), F.lit(""))
    rows = findings.select(
        *[c for c in ("sample_id", "snapshot_id", "created_ord", "gene") if c in findings.columns], F.concat(entity, F.lit(":"), F.coalesce("rsid", F.lit(""))).alias("entry_key"), "rsid", entity.alias("entity_type"), F.coalesce(field(findings, "clinvar_sig_code", "int"), sig_code(field(findings, "clinical_sig"))).alias("clinvar_sig_code"),
        F.coalesce(field(findings, "review_stars", "int"), review_stars(field(findings, "review_status"))).alias("review_stars"), cpic_level(field(findings, "cpic_level")).alias("cpic_level"), F.round(field(findings, "magnitude", "double"), 1).alias("magnitude"), F.when(rep.isin("Good", "Bad"), rep).otherwise("").alias("repute"), field(findings, "variant_copies", "int").alias("carrier"), able.alias("evaluable"),
    )
    text = F.concat_ws("|", "entry_key", "rsid", "entity_type", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in STATE])
    return rows.withColumn("digest", F.sha2(text, 256))


def append_snapshot(findings: DataFrame, path: str, snapshot_id: str) -> None:
    """Write a snapshot's fingerprints as a partition of their own; a retry replaces only that partition."""
    out = fingerprint(findings).drop("snapshot_id").withColumn("snapshot_id", F.lit(snapshot_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def _significance(o: Column, n: Column) -> Column:
    return (
        F.when((o == 3) & (n >= 4), "vus_resolved_pathogenic").when((o == 3) & n.between(1, 2), "vus_resolved_benign").when((o > 0) & (n > o), "sig_upgraded").when((o > 0) & (n > 0), "sig_downgraded")
        .when(n >= 4, "sig_upgraded").when(n.between(1, 2), "sig_downgraded").otherwise("sig_reclassified")
    )


def diff_pairs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changes between fingerprints joined on ``keys``: added, removed, or one row for each field that moved.

    Rows with equal digests are dropped before anything is compared.
    """
    side = lambda df, p: df.select(*keys, F.struct("digest", *STATE).alias(p))
    both = side(old, "o").join(side(new, "n"), keys, "full_outer").where("o is null or n is null or o.digest <> n.digest")
    text = lambda c: c.cast("string")

    def change(name: str, kind: Column, direction: Column) -> Column:
        o, n = F.col("o")[name], F.col("n")[name]
        return F.when(~o.eqNullSafe(n), F.struct(kind.alias("kind"), F.lit(name).alias("field"), text(o).alias("old"), text(n).alias("new"), direction.alias("direction")))

    o, n = (lambda c: F.col("o")[c]), (lambda c: F.col("n")[c])
    updown = lambda a, b: F.when(b > a, "up").otherwise("down")
    sig = _significance(ranked(o("clinvar_sig_code"), AXIS, 0), ranked(n("clinvar_sig_code"), AXIS, 0))
    way = F.when(sig.isin("vus_resolved_pathogenic", "sig_upgraded"), "up").when(sig.isin("vus_resolved_benign", "sig_downgraded"), "down").otherwise("lateral")
    minus = lambda c: F.coalesce(c.cast("double"), F.lit(-1.0))
    moved = F.array_compact(F.array(
        change("clinvar_sig_code", sig, way), change("review_stars", F.when(n("review_stars") > o("review_stars"), "stars_gained").otherwise("stars_lost"), updown(o("review_stars"), n("review_stars"))),
        change("cpic_level", F.lit("cpic_level_changed"), updown(ranked(o("cpic_level"), CPIC_RANK, -1), ranked(n("cpic_level"), CPIC_RANK, -1))), change("carrier", F.lit("carrier_status_changed"), updown(minus(o("carrier")), minus(n("carrier")))),
        change("repute", F.lit("repute_changed"), updown(ranked(o("repute"), REPUTE_RANK, 1), ranked(n("repute"), REPUTE_RANK, 1))), change("evaluable", F.when(n("evaluable"), "newly_evaluable").otherwise("no_longer_evaluable"), F.when(n("evaluable"), "up").otherwise("down")),
        change("magnitude", F.lit("magnitude_changed"), updown(minus(o("magnitude")), minus(n("magnitude")))),
    ))
    whole = lambda kind, way: F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"), F.lit(way).alias("direction")))
    rows = both.select(*keys, F.explode(F.when(F.col("o").isNull(), whole("finding_added", "up")).when(F.col("n").isNull(), whole("finding_removed", "down")).otherwise(moved)).alias("c")).select(*keys, "c.*")
    return rows.withColumns({"severity": ranked(F.col("kind"), SEVERITY, 0), "material": F.col("kind") != "magnitude_changed"})


def change_history(prints: DataFrame, since: int | None = None, limit: int | None = None) -> DataFrame:
    """Changes between every snapshot of a profile and the next one, all pairs in one join."""
    order = W.partitionBy("sample_id").orderBy("created_ord", "snapshot_id")
    steps = prints.select("sample_id", "snapshot_id", "created_ord").distinct().withColumn("previous", F.lag("snapshot_id").over(order)).where("previous is not null")
    if since is not None:
        steps = steps.where(F.col("created_ord") >= since)
    keys = ["sample_id", "from_id", "to_id", "entry_key"]
    new = prints.join(steps.select("sample_id", "snapshot_id", F.col("previous").alias("from_id")), ["sample_id", "snapshot_id"]).withColumn("to_id", F.col("snapshot_id"))
    old = prints.join(steps.select("sample_id", F.col("previous").alias("snapshot_id"), F.col("snapshot_id").alias("to_id")), ["sample_id", "snapshot_id"]).withColumn("from_id", F.col("snapshot_id"))
    out = diff_pairs(old, new, keys)
    return out.orderBy(F.desc("severity"), "to_id", "entry_key", "field").limit(limit) if limit else out


def latest_snapshot(prints: DataFrame) -> DataFrame:
    return prints.groupBy("sample_id").agg(F.max_by("snapshot_id", F.struct("created_ord", "snapshot_id")).alias("snapshot_id"))


def prune_snapshots(prints: DataFrame, keep: int) -> DataFrame:
    """Snapshots beyond the newest ``keep``, which is at least 1."""
    if keep < 1:
        raise ValueError("at least one snapshot stays")
    w = W.partitionBy("sample_id").orderBy(F.desc("created_ord"), F.desc("snapshot_id"))
    return prints.select("sample_id", "snapshot_id", "created_ord").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") > keep).drop("n")


def addendum(prints: DataFrame) -> DataFrame:
    """Counts of changes between the two newest snapshots; a lone snapshot is a baseline."""
    w = W.partitionBy("sample_id").orderBy("created_ord", "snapshot_id")
    snaps = prints.select("sample_id", "snapshot_id", "created_ord").distinct().withColumn("from_id", F.lag("snapshot_id").over(w))
    last = snaps.groupBy("sample_id").agg(F.max_by(F.struct("snapshot_id", "from_id"), F.struct("created_ord", "snapshot_id")).alias("l")).select("sample_id", F.col("l.snapshot_id").alias("to_id"), F.col("l.from_id").alias("from_id"))
    rows = change_history(prints).groupBy("sample_id", "from_id", "to_id").agg(F.count(F.lit(1)).alias("changes"), F.count_if("material").alias("material"))
    return last.join(rows, ["sample_id", "from_id", "to_id"], "left").select("sample_id", "from_id", "to_id", F.col("from_id").isNull().alias("baseline"), F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("material", F.lit(0)).alias("material"))


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Source versions ``(source, version)`` that differ, missing on a side included."""
    out = old.select("source", F.col("version").alias("old")).join(new.select("source", F.col("version").alias("new")), "source", "full_outer")
    return out.select("source", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new")).where("old <> new")


def unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("entry_key", "digest").intersect(new.select("entry_key", "digest"))
