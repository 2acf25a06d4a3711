"""Row-level functions on alleles, genotypes, chromosomes and identifiers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "no call", which differ by use.
NO_CALL = {
    "array": ("", "-", "--", "0", "00", "NN", "DD", "II", "DI", "ID"),
    "pool": ("", "N", "-", "--", "0", "00", "D", "I", "?", "."),
    "strand": ("", "N", "-", "0", "D", "I"),
    "rules": ("", "N", "-", "0", "--"),
    "prs": ("", "N", "-", "--", "0", "D", "I"),
    "star": ("", "N", "-", "--", "0", "00", "?", ".", "NN"),
    "traits": ("", "N", "-", "--", "0", "00", "?", "."),
    "zygosity": ("", "N", "-", "0", "D", "I"),
    "ibd": ("", "N", "-", "--", "0", "00", "D", "I", "?", "."),
}
# Roles and their other spellings.
ROLES = ("self", "mother", "father", "mate", "child", "sibling", "other", "ignore")
ROLE_ALIASES = {
    "me": "self", "myself": "self", "primary": "self", "proband": "self", "mom": "mother", "mum": "mother", "dad": "father", "spouse": "mate", "partner": "mate", "husband": "mate", "wife": "mate",
    "son": "child", "daughter": "child", "brother": "sibling", "sister": "sibling", "skip": "ignore", "exclude": "ignore", "excluded": "ignore",
}
PLUS, MINUS = ("plus", "+", "1", "+1", "fwd", "forward"), ("minus", "-", "-1", "rev", "reverse")


def C(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(key: Column, table: dict) -> Column:
    """The table's value for ``key``, null if it has none."""
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])[key]


def clean(a) -> Column:
    return F.upper(F.trim(F.coalesce(C(a).cast("string"), F.lit(""))))


def is_no_call(a, use: str = "pool") -> Column:
    return clean(a).isin(*NO_CALL[use])


def real_call(a1, a2, use: str = "pool") -> Column:
    return ~is_no_call(a1, use) & ~is_no_call(a2, use)


def genotype_key(a1, a2, use: str = "pool") -> Column:
    """Order-free key of two alleles; NN if either is a no-call."""
    return F.when(real_call(a1, a2, use), F.concat(F.least(clean(a1), clean(a2)), F.greatest(clean(a1), clean(a2)))).otherwise("NN")


def complement(a) -> Column:
    """Base on the other strand; N for what has none, ``-``, D and I stay."""
    x = clean(a)
    return F.when(x.isin("A", "C", "G", "T", "N", "-", "D", "I"), F.translate(x, "ACGT", "TGCA")).otherwise("N")


def complement_key(key) -> Column:
    """Order-free key of a two-base genotype read on the other strand."""
    a, b = complement(F.substring(C(key), 1, 1)), complement(F.substring(C(key), 2, 1))
    return F.concat(F.least(a, b), F.greatest(a, b))


def is_palindromic(a1, a2) -> Column:
    """Heterozygous A/T or C/G: the strand can't be told."""
    return genotype_key(a1, a2, "strand").isin("AT", "CG")


def strand_clean(a) -> Column:
    x = clean(a)
    return F.when(x.isin("A", "C", "G", "T"), x).otherwise("N")


def sort_alleles(a1, a2) -> Column:
    """Two alleles as an array, by alphabet, N last."""
    a, b = strand_clean(a1), strand_clean(a2)
    swap = F.when(a == "N", b != "N").otherwise((b != "N") & (b < a))
    return F.when(swap, F.array(b, a)).otherwise(F.array(a, b))


def genotype_token(a1, a2) -> Column:
    pair = sort_alleles(a1, a2)
    return F.when((pair[0] == "N") & (pair[1] == "N"), "(-;-)").otherwise(F.concat(F.lit("("), pair[0], F.lit(";"), pair[1], F.lit(")")))


def normalize_orientation(value) -> Column:
    token = F.lower(F.trim(C(value).cast("string")))
    return F.when(token.isin(*PLUS), "plus").when(token.isin(*MINUS), "minus").otherwise("")


def orient(a1, a2, stabilized, fallback=None) -> Column:
    """Genotype on the strand that ``stabilized`` names (``fallback`` if that is blank), as a struct."""
    blank = F.coalesce(F.trim(C(stabilized).cast("string")), F.lit("")) == ""
    used = F.when(blank, normalize_orientation(fallback) if fallback is not None else F.lit("")).otherwise(normalize_orientation(stabilized))
    r1, r2 = strand_clean(a1), strand_clean(a2)
    flip = (used == "minus") & ((r1 != "N") | (r2 != "N"))
    o1, o2 = F.when(flip, F.translate(r1, "ACGT", "TGCA")).otherwise(r1), F.when(flip, F.translate(r2, "ACGT", "TGCA")).otherwise(r2)
    pair = sort_alleles(o1, o2)
    return F.struct(
        pair[0].alias("allele1"), pair[1].alias("allele2"), F.concat(pair[0], pair[1]).alias("genotype"), genotype_token(o1, o2).alias("token"), flip.alias("flipped"),
        is_palindromic(a1, a2).alias("ambiguous"), used.alias("orientation"), F.concat(r1, r2).alias("source_genotype"),
    )


def candidate_tokens(a1, a2) -> Column:
    """The genotype's token, then that of the other strand; none with N, none twice."""
    both = F.array(genotype_token(a1, a2), genotype_token(complement(a1), complement(a2)))
    return F.array_distinct(F.filter(both, lambda t: ~t.contains("N") & (t != "(-;-)")))


def normalize_role(text) -> Column:
    role = F.lower(F.trim(F.coalesce(C(text), F.lit(""))))
    return F.when(role.isin(*ROLES), role).otherwise(F.coalesce(lookup(role, ROLE_ALIASES), F.lit("other")))


def normalize_contig(chrom, numeric_sex: bool = False) -> Column:
    """Contig without ``chr``; M becomes MT, and with ``numeric_sex`` 23 and 25 X, 24 Y, 26 MT."""
    x = F.regexp_replace(F.upper(F.trim(F.coalesce(C(chrom).cast("string"), F.lit("")))), "^CHR", "")
    x = F.when(x == "M", "MT").otherwise(x)
    return F.coalesce(lookup(x, {"23": "X", "25": "X", "24": "Y", "26": "MT"}), x) if numeric_sex else x


def chrom_order(chrom) -> Column:
    """Sortable struct: 1 to 22 by number, X, Y, MT, then the rest by name."""
    x = normalize_contig(chrom)
    sex = lookup(x, {"X": 1, "Y": 2, "MT": 3})
    digits = x.rlike("^[0-9]+$")
    return F.struct(
        F.when(digits, 0).when(sex.isNotNull(), 1).otherwise(2).alias("kind"), F.when(digits, x.try_cast("int")).otherwise(F.coalesce(sex, F.lit(0))).alias("number"), F.when(digits | sex.isNotNull(), "").otherwise(x).alias("name")
    )


def rsid_order(rsid) -> Column:
    """Sortable struct in which rs99 precedes rs100."""
    x = F.lower(F.trim(F.coalesce(C(rsid), F.lit(""))))
    kind, number = F.regexp_extract(x, "^(rs|i)([0-9]+)$", 1), F.regexp_extract(x, "^(rs|i)([0-9]+)$", 2)
    return F.struct(F.when(kind != "", 0).otherwise(1).alias("odd"), F.when(kind != "", kind).otherwise(x).alias("kind"), F.coalesce(number.try_cast("long"), F.lit(0)).alias("number"))


def zygosity(a1, a2) -> Column:
    n1, n2 = is_no_call(a1, "zygosity"), is_no_call(a2, "zygosity")
    return F.when(n1 & n2, "no_call").when(n1 | n2, "hemizygous").when(clean(a1) == clean(a2), "homozygous").otherwise("heterozygous")


def copies(a1, a2, allele) -> Column:
    """How many of two alleles are ``allele``; 0 for a blank one."""
    x = clean(allele)
    return F.when(x == "", 0).otherwise((clean(a1) == x).cast("int") + (clean(a2) == x).cast("int"))


def dosage(a1, a2, allele) -> Column:
    """``copies``, but null if a side is a no-call or the allele is blank."""
    return F.when(real_call(a1, a2, "prs") & (clean(allele) != ""), copies(a1, a2, allele))
