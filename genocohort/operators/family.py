"""Parents, children and shared segments (JN4, JN5, JN11, JN12, JN15-JN17, WN3, AG32, AG38, PL3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.alleles import complement, genotype_key, normalize_role
from .staging import staged

MIN_SNPS, MIN_CM, MAX_OH = 300, 7.0, 1
#: Parts of the markers by which a pair of samples is looked up.
PAIR_PARTS = 32
#: Width of the bins that turn a range join into an equi join.
BIN = 100_000
# Mean cM per Mb of each chromosome, used without a genetic map.
CM_PER_MB = {
    "1": 1.14, "2": 1.09, "3": 1.11, "4": 1.09, "5": 1.13, "6": 1.10, "7": 1.19, "8": 1.16, "9": 1.29, "10": 1.30, "11": 1.20, "12": 1.28, "13": 1.15, "14": 1.28, "15": 1.42, "16": 1.60, "17": 1.68, "18": 1.28,
    "19": 2.05, "20": 1.61, "21": 1.87, "22": 2.12, "X": 1.02,
}
# Shared cM ranges of relationships with their degree.
BANDS = (
    ("identical twin, or the same person tested twice", 3300, 3800, 0), ("parent or child", 3200, 3800, 1), ("full sibling", 2200, 3400, 2), ("half sibling", 1160, 2440, 2), ("grandparent or grandchild", 1150, 2320, 2), ("aunt, uncle, niece or nephew", 1200, 2280, 3),
    ("great-grandparent or great-grandchild", 460, 1490, 3), ("half aunt, half uncle, half niece or half nephew", 500, 1450, 4), ("first cousin", 390, 1400, 4), ("first cousin once removed", 100, 980, 5), ("half first cousin", 155, 980, 5), ("second cousin", 40, 600, 6),
    ("second cousin once removed", 14, 355, 7), ("third cousin", 0, 235, 8), ("fourth cousin", 0, 140, 10),
)
# What a pair of declared roles should be.
ROLE_PAIRS = {
    ("mother", "self"): "parent or child", ("father", "self"): "parent or child", ("child", "self"): "parent or child", ("self", "sibling"): "full sibling", ("mate", "self"): "unrelated", ("father", "mother"): "unrelated", ("mate", "mother"): "unrelated", ("father", "mate"): "unrelated",
    ("mate", "sibling"): "unrelated", ("child", "mother"): "grandparent or grandchild", ("child", "father"): "grandparent or grandchild", ("father", "sibling"): "parent or child", ("mother", "sibling"): "parent or child", ("child", "sibling"): "aunt, uncle, niece or nephew", ("sibling", "sibling"): "full sibling",
}
UNRELATED_CM, ABOVE_CM, MATE_CM = 20.0, 3800.0, 90.0


def base(key: Column, i: int) -> Column:
    return F.substring(key, i, 1)


def transmission(child: Column, mother: Column, father: Column) -> Column:
    """Chance of the child's key from its parents' keys: 0, 1/4, ... 1; null if one is NN."""
    hits = sum((F.concat(F.least(base(mother, i), base(father, j)), F.greatest(base(mother, i), base(father, j))) == child).cast("int") for i in (1, 2) for j in (1, 2))
    known = (child != "NN") & (mother != "NN") & (father != "NN")
    return F.when(known, hits / 4.0)


def trio_check(child: DataFrame, mother: DataFrame, father: DataFrame) -> DataFrame:
    """Each marker of a family that all three read: ``probability`` and ``mendelian_ok``.  Inputs are ``(fam, rsid, genotype)``."""
    rows = child.select("fam", "rsid", F.col("genotype").alias("child")).join(mother.select("fam", "rsid", F.col("genotype").alias("mother")), ["fam", "rsid"]).join(father.select("fam", "rsid", F.col("genotype").alias("father")), ["fam", "rsid"])
    return rows.withColumn("probability", transmission(F.col("child"), F.col("mother"), F.col("father"))).where("probability is not null").withColumn("mendelian_ok", F.col("probability") > 0)


def trio_summary(rows: DataFrame) -> DataFrame:
    bad = F.count_if(~F.col("mendelian_ok"))
    return rows.groupBy("fam").agg(F.count(F.lit(1)).alias("compared"), bad.alias("violations"), F.round(bad / F.count(F.lit(1)), 4).alias("violation_rate"))


def phase_by_parents(child: DataFrame, mother: DataFrame, father: DataFrame) -> DataFrame:
    """Which parent each allele of a child came from, with the basis, or why that can't be said."""
    key = lambda df, name: df.where("genotype <> 'NN'").select("fam", "rsid", F.col("genotype").alias(name))
    rows = key(child, "c").join(key(mother, "m"), ["fam", "rsid"], "left").join(key(father, "f"), ["fam", "rsid"], "left")
    two = lambda k: F.array(base(F.col(k), 1), base(F.col(k), 2))
    both = F.array_distinct(two("c"))
    bad = (F.col("m").isNotNull() & ~F.arrays_overlap(both, two("m"))) | (F.col("f").isNotNull() & ~F.arrays_overlap(both, two("f")))
    same = lambda k: F.coalesce(base(F.col(k), 1) == base(F.col(k), 2), F.lit(False))
    has = lambda k: F.coalesce(F.array_contains(both, base(F.col(k), 1)), F.lit(False))
    only_m = F.array_except(F.array_intersect(both, two("m")), two("f"))
    only_f = F.array_except(F.array_intersect(both, two("f")), two("m"))
    kind = (
        F.when(F.col("m").isNull() & F.col("f").isNull(), "no_parent_data").when(bad, "inconsistent").when(same("c"), "child_homozygous").when(same("m") & has("m"), "mother_homozygous").when(same("f") & has("f"), "father_homozygous")
        .when(F.coalesce((F.size(only_m) == 1) & (F.size(only_f) == 1), F.lit(False)), "exclusive_alleles").otherwise("ambiguous")
    )
    rows = rows.withColumn("basis", kind)
    other = lambda k: F.when(base(F.col("c"), 1) == base(F.col(k), 1), base(F.col("c"), 2)).otherwise(base(F.col("c"), 1))
    by = lambda h, m, f, x: F.when(F.col("basis") == "child_homozygous", h).when(F.col("basis") == "mother_homozygous", m).when(F.col("basis") == "father_homozygous", f).when(F.col("basis") == "exclusive_alleles", x)
    return rows.select("fam", "rsid", F.col("c").alias("genotype"), "basis", by(base(F.col("c"), 1), base(F.col("m"), 1), other("f"), F.get(only_m, F.lit(0))).alias("maternal"), by(base(F.col("c"), 1), other("m"), base(F.col("f"), 1), F.get(only_f, F.lit(0))).alias("paternal"))


def phase_summary(phased: DataFrame) -> DataFrame:
    n = lambda *kinds: F.count_if(F.col("basis").isin(*kinds))
    known = ("child_homozygous", "mother_homozygous", "father_homozygous", "exclusive_alleles")
    return phased.groupBy("fam").agg(
        F.count(F.lit(1)).alias("child_positions"), n(*known).alias("resolvable"), n("no_parent_data", "inconsistent", "ambiguous").alias("ambiguous"), n("child_homozygous").alias("trivial_homozygous"), n(*known[1:]).alias("informative_heterozygous"), n("inconsistent").alias("inconsistent"),
        n("no_parent_data").alias("no_parent_data"), F.round(n(*known) / F.count(F.lit(1)), 4).alias("rate"),
    )


def liftover(calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """Calls at their place in the other build, ``mapped`` or a reason.

    The chain with the highest score that spans the position decides; if it has a gap there, the call is unmapped.
    On the minus strand the place is counted from the end and alleles are complemented.  Both sides are
    binned, so the range join is a hash join on (chrom, bin).
    """
    if "q_size" not in blocks.columns:  # a block of its own query, as long as the target
        blocks = blocks.withColumn("q_size", F.col("q_start") + F.col("t_end") - F.col("t_start"))
    spans = blocks.groupBy("chrom_no", "chain_id").agg(F.max("score").alias("score"), F.min("t_start").alias("c_start"), F.max("t_end").alias("c_end"))
    calls = calls.withColumn("_id", F.struct(*calls.columns))
    at = F.col("position") - 1
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor((F.col(b) - 1) / BIN)))
    here = calls.select("_id", "chrom_no", at.alias("p"), F.floor(at / BIN).alias("bin"))
    over = here.join(spans.withColumn("bin", bins("c_start", "c_end")), ["chrom_no", "bin"]).where("c_start <= p and p < c_end")
    chosen = over.groupBy("_id", "chrom_no", "p", "bin").agg(F.max_by("chain_id", F.struct("score", -F.col("chain_id"))).alias("chain_id"))
    hit = chosen.join(blocks.withColumn("bin", bins("t_start", "t_end")), ["chrom_no", "chain_id", "bin"]).where("t_start <= p and p < t_end")
    offset = F.col("p") - F.col("t_start")
    place = F.when(F.col("strand") == "-", F.col("q_size") - F.col("q_start") - offset - 1).otherwise(F.col("q_start") + offset) + 1
    hit = hit.select("_id", place.alias("new_position"), F.col("strand").alias("new_strand"))
    out = calls.join(chosen.select("_id", F.lit(True).alias("covered")), "_id", "left").join(hit, "_id", "left").drop("_id")
    minus = F.col("new_strand") == "-"
    return out.withColumns({
        "status": F.when(F.col("new_position").isNotNull(), "mapped").when(F.col("covered"), "gap in the chain").otherwise("no chain"), "new_allele1": F.when(F.col("new_position").isNotNull(), F.when(minus, complement("allele1")).otherwise(F.col("allele1"))),
        "new_allele2": F.when(F.col("new_position").isNotNull(), F.when(minus, complement("allele2")).otherwise(F.col("allele2"))),
    }).drop("covered")


def place_on_map(points: DataFrame, genetic_map: DataFrame, bp: str, out: str) -> DataFrame:
    """Add the cM place ``out`` of column ``bp``, interpolated on the map and clamped to its ends; null without a map.

    An as-of join by windows: map points and rows are put in one order per chromosome, cut into bins; the bins'
    last and first map points bridge them, so no task holds a whole chromosome.
    """
    w = W.partitionBy("chrom_no").orderBy("bp")
    steps = genetic_map.select("chrom_no", F.col("bp").alias("_b0"), F.col("cm").alias("_c0"), F.lead("bp").over(w).alias("_b1"), F.lead("cm").over(w).alias("_c1"), F.row_number().over(w).alias("_k"))
    ends = genetic_map.groupBy("chrom_no").agg(F.min(F.struct("bp", "cm")).alias("_lo"), F.max(F.struct("bp", "cm")).alias("_hi"))
    binned = steps.where("_b1 is not null").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_b0") / BIN), F.floor(F.col("_b1") / BIN))))
    places = points.select("chrom_no", F.col(bp).alias("_p")).distinct().withColumn("_bin", F.floor(F.col("_p") / BIN))
    inside = places.join(binned, ["chrom_no", "_bin"]).where("_b0 <= _p and _p < _b1").select("chrom_no", "_p", (F.col("_c0") + (F.col("_p") - F.col("_b0")) / (F.col("_b1") - F.col("_b0")) * (F.col("_c1") - F.col("_c0"))).alias("_cm"))
    found = places.drop("_bin").join(inside, ["chrom_no", "_p"], "left").join(ends, "chrom_no", "left")  # one row for each chromosome
    cm = F.when(F.col("_p") <= F.col("_lo.bp"), F.col("_lo.cm")).when(F.col("_p") >= F.col("_hi.bp"), F.col("_hi.cm")).otherwise(F.col("_cm"))
    return points.join(found.select("chrom_no", F.col("_p").alias(bp), cm.alias(out)), ["chrom_no", bp], "left")


def centimorgans(segments: DataFrame, genetic_map: DataFrame) -> DataFrame:
    """Genetic length ``cm`` of segments (chrom_no, start_bp, end_bp); by the average rate where there is no map."""
    low, high = F.least("start_bp", "end_bp"), F.greatest("start_bp", "end_bp")
    rows = segments.withColumns({"start_bp": low, "end_bp": high})
    rows = place_on_map(place_on_map(rows, genetic_map, "start_bp", "_s"), genetic_map, "end_bp", "_e")
    rate = F.coalesce(F.create_map(*[F.lit(x) for kv in CM_PER_MB.items() for x in kv])[F.col("chrom_no").cast("string")], F.lit(1.2))
    span = (F.col("end_bp") - F.col("start_bp")) / 1_000_000.0
    return rows.withColumns({"cm_estimated": F.col("_s").isNull(), "cm": F.round(F.coalesce(F.greatest(F.lit(0.0), F.col("_e") - F.col("_s")), span * rate), 4)}).drop("_s", "_e")


def sample_pairs(pooled: DataFrame, pairs: DataFrame) -> DataFrame:
    """IBS state of each marker that both samples of a listed pair read: 2, 1 or 0 shared alleles.

    ``pairs(a, b)`` is a household or candidate list; a cohort is never paired with itself by default.  Each pair is asked
    for in PAIR_PARTS parts of the markers, so that a sample that is in very many pairs has no genome a pair in one task.
    """
    part = F.pmod(F.xxhash64("rsid"), F.lit(PAIR_PARTS)).cast("int")
    wanted = pairs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PAIR_PARTS - 1))))
    rows = pooled.where(genotype_key("allele1", "allele2", "ibd") != "NN").select("sample_id", "rsid", "chrom_no", "position", genotype_key("allele1", "allele2", "ibd").alias("key"))
    left = wanted.join(rows.select(F.col("sample_id").alias("a"), part.alias("_part"), "rsid", "chrom_no", "position", F.col("key").alias("ka")), ["a", "_part"]).drop("_part")
    both = left.join(rows.select(F.col("sample_id").alias("b"), "rsid", F.col("key").alias("kb")), ["b", "rsid"])
    cross = lambda i, j: (base(F.col("ka"), i) == base(F.col("kb"), j)).cast("int")
    return both.withColumn("ibs", F.greatest(cross(1, 1) + cross(2, 2), cross(1, 2) + cross(2, 1))).drop("ka", "kb")


def household_pairs(samples: DataFrame) -> DataFrame:
    """Unordered pairs within a family, from ``samples(sample_id, fam)``."""
    s = samples.select("sample_id", "fam").distinct()
    return s.select(F.col("sample_id").alias("a"), "fam").join(s.select(F.col("sample_id").alias("b"), "fam"), "fam").where("a < b").select("a", "b")


def ibd_segments(ibs: DataFrame, genetic_map: DataFrame, min_snps: int = MIN_SNPS, min_cm: float = MIN_CM, max_oh: int = MAX_OH) -> DataFrame:
    """Runs of markers along a chromosome with a shared allele, of ``min_snps`` markers and ``min_cm`` at least.

    Up to ``max_oh`` opposite homozygotes (IBS 0) inside a run are passed over; the next one ends it before itself
    and a new run starts after it.  Runs begin and end on a shared marker.  Only the places of IBS-0 markers and
    of their neighbours are gathered, per pair and chromosome, and folded in order, in one shuffle.  Runs too short are not
    gathered, and what is found is staged, as its places on the map are looked up several times.
    """
    w = W.partitionBy("a", "b", "chrom_no").orderBy("position", "rsid")
    rows = ibs.select("a", "b", "chrom_no", "ibs", "position", F.row_number().over(w).alias("i"), F.lag("position").over(w).alias("before"), F.lead("position").over(w).alias("after"))
    zero = F.when(F.col("ibs") == 0, F.struct("i", "before", "after"))
    groups = rows.groupBy("a", "b", "chrom_no").agg(F.max("i").alias("last"), F.min("position").alias("first_bp"), F.max("position").alias("last_bp"), F.array_sort(F.collect_list(zero)).alias("zeros"))
    kind = "struct<start:int,start_bp:bigint,end:int,end_bp:bigint>"
    run = lambda acc, end, bp: F.struct(acc["start"].alias("start"), acc["start_bp"].alias("start_bp"), end.cast("int").alias("end"), bp.cast("bigint").alias("end_bp"))

    def state(start: Column, bp: Column, passed: Column, runs: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), bp.cast("bigint").alias("start_bp"), passed.cast("int").alias("passed"), runs.cast(f"array<{kind}>").alias("runs"))

    def step(acc: Column, v: Column) -> Column:
        fresh = state(v["i"] + 1, v["after"], F.lit(0), acc["runs"])
        passed = state(acc["start"], acc["start_bp"], acc["passed"] + 1, acc["runs"])
        closed = state(v["i"] + 1, v["after"], F.lit(0), F.array_append(acc["runs"], run(acc, v["i"] - 1, v["before"])))
        short = v["i"] - acc["start"] < min_snps
        return F.when(v["i"] == acc["start"], fresh).when(acc["passed"] < max_oh, passed).when(short, fresh).otherwise(closed)

    begin = state(F.lit(1), F.col("first_bp"), F.lit(0), F.array())
    folded = groups.withColumn("runs", F.aggregate("zeros", begin, step, lambda acc: F.array_append(acc["runs"], run(acc, F.lit(2**30), F.lit(None)))))
    runs = folded.select("a", "b", "chrom_no", "last", "last_bp", "zeros", F.explode("runs").alias("r")).select("a", "b", "chrom_no", "zeros", "r.start", "r.start_bp", F.least("r.end", "last").alias("end"), F.coalesce("r.end_bp", "last_bp").alias("end_bp"))
    # the end steps back over opposite homozygotes: at most max_oh of them lie in a run
    for _ in range(max_oh):
        at_end = F.get(F.filter("zeros", lambda z: z["i"] == F.col("end")), F.lit(0))
        runs = runs.withColumn("z", at_end).withColumns({"end_bp": F.when(F.col("z").isNotNull(), F.col("z.before")).otherwise(F.col("end_bp")), "end": F.when(F.col("z").isNotNull(), F.col("end") - 1).otherwise(F.col("end"))}).drop("z")
    out = runs.withColumn("snps", F.col("end") - F.col("start") + 1).where((F.col("end") >= F.col("start")) & (F.col("snps") >= min_snps)).select("a", "b", "chrom_no", "snps", "start_bp", "end_bp")
    return centimorgans(staged(out, "segments"), genetic_map).where(F.col("cm") >= min_cm)


def ibd_totals(segments: DataFrame) -> DataFrame:
    return segments.groupBy("a", "b").agg(F.round(F.sum("cm"), 4).alias("total_cm"), F.round(F.max("cm"), 4).alias("longest_cm"), F.count(F.lit(1)).alias("segments"))


def predict_relationship(totals: DataFrame) -> DataFrame:
    """All relationships whose range holds the total: never a single answer.  The bands are a handful of rows."""
    bands = totals.sparkSession.createDataFrame(BANDS, "relationship string, low int, high int, degree int")
    hits = totals.select("a", "b", "total_cm").distinct().join(F.broadcast(bands), F.col("total_cm").between(F.col("low"), F.col("high"))).where(F.col("total_cm").between(UNRELATED_CM, ABOVE_CM))
    hits = hits.groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("degree", "relationship"))), lambda x: x["relationship"]), "; ").alias("relationships"), F.min("degree").alias("degree_low"), F.max("degree").alias("degree_high"))
    state = F.when(F.col("total_cm") > ABOVE_CM, "above_range").when(F.col("total_cm") < UNRELATED_CM, "unrelated_or_distant").when(F.col("relationships").isNotNull(), "range").otherwise("no_band")
    return totals.join(hits, ["a", "b"], "left").withColumn("state", state)


def check_declared_roles(totals: DataFrame, roles: DataFrame) -> DataFrame:
    """Declared roles of a pair against its total: agrees, disagrees, or not checkable."""
    limits = {name: (low, high) for name, low, high, _ in BANDS} | {"unrelated": (0, MATE_CM)}
    table = totals.sparkSession.createDataFrame([(x, y, name, float(limits[name][0]), float(limits[name][1])) for (x, y), name in ROLE_PAIRS.items()], "r1 string, r2 string, expected string, low double, high double")
    role = lambda side: roles.select(F.col("sample_id").alias(side), normalize_role("role").alias(f"role_{side}"))
    out = totals.join(role("a"), "a", "left").join(role("b"), "b", "left")
    out = out.withColumns({"r1": F.least("role_a", "role_b"), "r2": F.greatest("role_a", "role_b")}).join(table, ["r1", "r2"], "left").drop("r1", "r2")
    ok = F.when(F.col("expected").isNull(), "not_checkable").when(F.col("total_cm").between(F.col("low"), F.col("high")), "agrees").otherwise("disagrees")
    return out.withColumn("verdict", ok)


def household(pooled: DataFrame, samples: DataFrame, genetic_map: DataFrame, **limits) -> DataFrame:
    """All pairs of each family: totals (0 for those that share no segment), relationship range, role check."""
    pairs = household_pairs(samples)
    totals = ibd_totals(ibd_segments(sample_pairs(pooled, pairs), genetic_map, **limits))
    full = pairs.join(totals, ["a", "b"], "left").na.fill(0)
    return check_declared_roles(predict_relationship(full), samples)


def chromosome_browser(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """Segments as fractions of their chromosome, per pair; chromosomes without one are there with nulls."""
    grid = segments.select("a", "b").distinct().crossJoin(lengths)  # two dozen chromosomes
    out = grid.join(segments, ["a", "b", "chrom_no"], "left")
    share = lambda c: F.when(F.col("length") > 0, F.round(F.col(c) / F.col("length"), 6))
    return out.select("a", "b", "chrom_no", share("start_bp").alias("start_frac"), share("end_bp").alias("end_frac"), "cm")
