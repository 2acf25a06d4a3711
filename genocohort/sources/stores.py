"""Stored tables: findings that are upserted bucket by bucket, and references bucketed for look-ups (SNK1, SNK6, PL5)."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of a findings store and buckets of a reference; a bucket should stay within what a task rewrites or reads well.
FINDING_BUCKETS, REFERENCE_BUCKETS = 64, 64


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


class StaleVersion(RuntimeError):
    """Another writer has put down the version that this one was to be."""


class FindingsStore:
    """Findings by ``key``, in folders by a hash of the first key column.

    A version is one small file that names the folder of each bucket.  An upsert writes new folders for the buckets in which
    a row changes, then the next version's file, in one rename: readers see the version before or after, untouched buckets
    keep their files, and of two writers one fails.  What the driver handles is one line a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = ("sample_id", "rsid"), since: str = "discovered_at", buckets: int = FINDING_BUCKETS):
        self.spark, self.path, self.key, self.since, self.buckets = spark, path.rstrip("/"), key, since, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key[0]).cast("string")), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The newest version, 0 for a store that holds nothing yet."""
        fs, where = _fs(self.spark, f"{self.path}/versions")
        return max((int(x.getPath().getName()) for x in fs.listStatus(where) if x.getPath().getName().isdigit()), default=0) if fs.exists(where) else 0

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Folder of each bucket that has rows."""
        version = self.version() if version is None else version
        if not version:
            return {}
        rows = self.spark.read.text(f"{self.path}/versions/{version}").where("value <> ''").collect()
        return {int(b): f for b, f in (r["value"].split("\t") for r in rows)}

    def _commit(self, version: int, folders: dict[int, str]) -> None:
        fs, new = _fs(self.spark, f"{self.path}/versions/{version}")
        _, draft = _fs(self.spark, f"{self.path}/versions/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray("".join(f"{b}\t{f}\n" for b, f in sorted(folders.items())).encode()))
        out.close()
        if fs.exists(new) or not fs.rename(draft, new):
            fs.delete(draft, False)
            raise StaleVersion(f"{self.path} already has version {version}")

    def _read(self, folders: list[str], schema: StructType | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", True)
        return reader.parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, samples: list | None = None, version: int | None = None) -> DataFrame:
        """All findings, or those of some samples from their buckets only."""
        folders = self.folders(version)
        if samples is not None:
            at = self.spark.createDataFrame([(str(s),) for s in samples], "s string").select(F.pmod(F.xxhash64("s"), F.lit(self.buckets)).cast("int").alias("b")).distinct()
            folders = {b: f for b, f in folders.items() if b in {r["b"] for r in at.collect()}}
        if not folders:
            if not self.folders(version):
                raise FileNotFoundError(f"{self.path} holds no findings")
            return self._read(sorted(self.folders(version).values())).limit(0)
        rows = self._read(sorted(folders.values()))
        return rows if samples is None else rows.where(F.col(self.key[0]).isin(*samples))

    def _rewrite(self, version: int, rows: DataFrame, changed: list[int], folders: dict[int, str]) -> int:
        name = f"{version + 1}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition(len(changed), "_bucket").sortWithinPartitions(*self.key).write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        fs, where = _fs(self.spark, f"{self.path}/data/{name}")
        made = {int(x.getPath().getName().removeprefix("_bucket=")): f"{name}/{x.getPath().getName()}" for x in fs.listStatus(where) if x.getPath().getName().startswith("_bucket=")}
        self._commit(version + 1, {b: f for b, f in folders.items() if b not in changed} | made)
        return version + 1

    def settled(self, fresh: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
        """One row for each key: the last by ``order``, and of equal ones the one with the greatest hash of its columns.  A
        row without a full key is no finding and goes."""
        rest = [c for c in fresh.columns if c not in self.key]
        row = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order], F.xxhash64(*fresh.columns)))
        return fresh.dropna(subset=list(self.key)).groupBy(*self.key).agg(row.alias("_row")).select(*self.key, *[F.col(f"_row.`{c}`").alias(c) for c in rest])

    def upsert(self, fresh: DataFrame, order: tuple[str, ...] = ()) -> int:
        """Fresh rows replace those of their key in every column that they have, but keep the older ``since``; the rest stays.

        Returns the version after it, which is the one before if no value changes.
        """
        version = self.version()
        folders = self.folders(version)
        fresh = self.settled(fresh, order)
        touched = sorted(r["b"] for r in fresh.select(self._bucket().alias("b")).distinct().collect())
        if not touched:
            return version
        held = [folders[b] for b in touched if b in folders]
        if not held:
            return self._rewrite(version, fresh, touched, folders)
        old = self._read(held)
        extra = [c for c in fresh.columns if c not in old.columns]
        old = old.withColumns({c: F.lit(None).cast(dict(fresh.dtypes)[c]) for c in extra})
        values = [c for c in old.columns if c not in self.key]
        new = fresh.select(*self.key, *[F.col(c).alias(f"_n_{c}") for c in values if c in fresh.columns], F.lit(True).alias("_new"))
        both = old.withColumn("_old", F.lit(True)).join(new, list(self.key), "full_outer")
        kinds = dict(old.dtypes)

        def merged(c: str) -> Column:
            if c not in fresh.columns:
                return F.col(c)
            given = F.col(f"_n_{c}").cast(kinds[c])
            return F.when(F.col("_new") & ~(F.col("_old").isNotNull() & F.lit(c == self.since)), given).otherwise(F.col(c))

        differs = [~F.col(f"_n_{c}").cast(kinds[c]).eqNullSafe(F.col(c)) for c in values if c in fresh.columns and c != self.since]
        changes = F.col("_old").isNull()
        for d in differs:
            changes = changes | d
        changed = sorted(r["b"] for r in both.where(F.col("_new") & changes).select(self._bucket().alias("b")).distinct().collect())
        if not changed:
            return version
        rows = both.select(*self.key, *[merged(c).alias(c) for c in values]).where(self._bucket().isin(*changed))
        return self._rewrite(version, rows, changed, folders)

    def erase(self, ids: DataFrame) -> int:
        """Take out all findings of the samples in ``ids``; only their buckets are rewritten, and old versions are dropped."""
        version = self.version()
        folders = self.folders(version)
        ids = ids.select(F.col(self.key[0])).distinct()
        touched = sorted({r["b"] for r in ids.select(self._bucket().alias("b")).distinct().collect()} & set(folders))
        if not touched:
            return version
        rows = self._read([folders[b] for b in touched]).join(ids, self.key[0], "left_anti")
        version = self._rewrite(version, rows, touched, folders)
        self.vacuum()
        return version

    def vacuum(self) -> None:
        """Delete the versions before the newest and the folders that only they name."""
        version = self.version()
        kept = set(self.folders(version).values())
        fs, where = _fs(self.spark, f"{self.path}/versions")
        for x in fs.listStatus(where):
            if x.getPath().getName() != str(version):
                fs.delete(x.getPath(), False)
        _, data = _fs(self.spark, f"{self.path}/data")
        for x in fs.listStatus(data):
            own = [y for y in fs.listStatus(x.getPath()) if y.isDirectory()]
            gone = [y for y in own if f"{x.getPath().getName()}/{y.getPath().getName()}" not in kept]
            for y in [x] if len(gone) == len(own) else gone:
                fs.delete(y.getPath(), True)


class ReferenceStore:
    """Reference tables bucketed and sorted by one key, under one folder.

    A look-up of some keys reads their buckets only, and a join of two tables of the store on the key needs no
    shuffle.  Tables are known to the session's catalog by a name that follows from the path, so that any session can open them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _name(self, table: str) -> str:
        return f"store_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{table}"

    def write(self, table: str, df: DataFrame, key: str = "rsid", buckets: int = REFERENCE_BUCKETS) -> None:
        """Write ``df`` by lower-cased ``key``; a table of that name is replaced."""
        rows = df.withColumn(key, F.lower(F.trim(key)))
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")
        rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{self.path}/{table}").saveAsTable(self._name(table))
        about = [(key, buckets, self.spark.table(self._name(table)).schema.json())]
        self.spark.createDataFrame(about, "key string, buckets int, schema string").coalesce(1).write.mode("overwrite").json(f"{self.path}/_about/{table}")

    def table(self, table: str) -> DataFrame:
        """The stored table, with its buckets, in this session or a new one.

        Joins with it merge its sorted buckets: by its files' size, which packs repeated keys well, it could seem fit to broadcast.
        """
        name = self._name(table)
        if not self.spark.catalog.tableExists(name):
            about = self.spark.read.schema("key string, buckets int, schema string").json(f"{self.path}/_about/{table}").first()
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(about["schema"])).fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({about['key']}) SORTED BY ({about['key']}) INTO {about['buckets']} BUCKETS LOCATION '{self.path}/{table}'")
        return self.spark.table(name).hint("merge")


def lookup_rsids(rsids: list[str]) -> list[str]:
    """Ids in the form of the store; anything that isn't an rsID is an error."""
    wanted = sorted({r.strip().lower() for r in rsids})
    odd = [r for r in wanted if not r.startswith("rs")]
    if odd:
        raise ValueError(f"not an rsID: {', '.join(odd)}")
    return wanted


def look_up(store: ReferenceStore, rsids: list[str], samples: DataFrame, zygosity) -> DataFrame:
    """What is known of some rsIDs in each of ``samples(sample_id)``, from the stored tables ``calls`` and ``variants``.

    One row for each sample and id: whether the sample's files have it, genotype, zygosity and place, whether the reference
    has it, and its annotation.  Only the ids' buckets are read.
    """
    wanted = lookup_rsids(rsids)
    asked = samples.select("sample_id").distinct().select("sample_id", F.explode(F.array(*[F.lit(r) for r in wanted])).alias("rsid"))
    calls = store.table("calls").where(F.col("rsid").isin(*wanted)).select("sample_id", "rsid", "allele1", "allele2", "chromosome", "position", F.lit(True).alias("here"))
    known = store.table("variants").where(F.col("rsid").isin(*wanted)).select("rsid", "gene", "category", "clinical_sig", "interpretation", F.lit(True).alias("listed"))
    rows = asked.join(calls, ["sample_id", "rsid"], "left").join(known, "rsid", "left")
    return rows.select("sample_id", "rsid", F.coalesce("here", F.lit(False)).alias("in_your_data"), F.concat("allele1", "allele2").alias("genotype"), F.when(F.col("here"), zygosity("allele1", "allele2")).alias("zygosity"), "chromosome", "position", F.coalesce("listed", F.lit(False)).alias("in_reference"), "gene", "category", "clinical_sig", "interpretation")
