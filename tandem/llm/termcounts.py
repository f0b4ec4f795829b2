"""Occurrence and record counts of every term, kept up to date by signed deltas.

A count table is a folder of versions ``v=<n>``, each hash-partitioned by term.  An update compares
two snapshots of the records by id, tokenises only the records that were added, changed or deleted,
sums their signed per-term changes, and merges them into the newest version.  A version exists once
its success marker does, so a job that dies half-way leaves the older version in force.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.text import terms
from tandem.runtime import fresh_path

COUNTS = T.StructType([T.StructField("term", T.StringType()), T.StructField("occurrences", T.LongType()), T.StructField("records", T.LongType())])


def snapshot(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text), one row per id: copies count once; rows of one id that differ leave the text that sorts
    last (null first).  Rows without an id are no records."""
    return df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(text_col).alias("text"))


def changes(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(sign, text) of the records to take out (-1) and to put in (+1); equal records drop out before any
    text is tokenised.  Both sides are snapshots; ``old`` None is an empty collection."""
    if old is None:
        return new.filter("text IS NOT NULL").select(F.lit(1).alias("sign"), "text")
    both = old.select("id", F.col("text").alias("was")).join(new.select("id", F.col("text").alias("now")), "id", "full_outer")
    moved = both.filter(~F.col("was").eqNullSafe(F.col("now")))
    signed = F.array(F.struct(F.lit(-1).alias("sign"), F.col("was").alias("text")), F.struct(F.lit(1).alias("sign"), F.col("now").alias("text")))
    return moved.select(F.inline(signed)).filter("text IS NOT NULL")


def term_deltas(signed: DataFrame) -> DataFrame:
    """(term, occurrences, records): the net change of each term.  Every term counts once as an occurrence, and every
    different one once more as a record; both are summed map-side, so a frequent term sends one row per map task and
    the work grows with the length of a record and not with its square.  The empty term holds the change in the
    number of records that have any term."""
    words = signed.select("sign", terms(F.col("text")).alias("_terms")).filter(F.size("_terms") > 0)
    none = F.lit(0)
    said = F.transform("_terms", lambda w: F.struct(w.alias("term"), F.lit(1).alias("occ"), none.alias("rec")))
    held = F.transform(F.array_distinct("_terms"), lambda w: F.struct(w.alias("term"), none.alias("occ"), F.lit(1).alias("rec")))
    marker = F.array(F.struct(F.lit("").alias("term"), none.alias("occ"), F.lit(1).alias("rec")))
    rows = words.select("sign", F.inline(F.concat(said, held, marker)))
    return (
        rows.groupBy("term")
        .agg(F.sum(F.col("sign") * F.col("occ")).cast("long").alias("occurrences"), F.sum(F.col("sign") * F.col("rec")).cast("long").alias("records"))
        .filter("occurrences <> 0 OR records <> 0")
    )


@dataclass
class TermCounts:
    """A persistent count table; ``path`` must lie in a folder that all executors share."""

    spark: SparkSession
    path: str
    buckets: int = 8

    def version(self) -> int:
        """The newest complete version, 0 if there is none."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return 0
        done = [0]
        for st in fs.listStatus(fs_path):
            name = st.getPath().getName()
            if name.startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                done.append(int(name[2:]))
        return max(done)

    def read(self, version: int | None = None) -> DataFrame:
        """(term, occurrences, records) without the marker row of the total."""
        return self._all(version).filter("term <> ''")

    def total(self, version: int | None = None) -> int:
        """The number of records that have a term."""
        return self._all(version).filter("term = ''").agg(F.sum("records")).first()[0] or 0

    def _all(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v == 0:
            return self.spark.createDataFrame([], COUNTS)
        schema = T.StructType([*COUNTS.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/v={v}").select("term", "occurrences", "records")

    def apply(self, deltas: DataFrame, version: int | None = None) -> int:
        """Merges signed changes into ``version`` (the newest if None) and commits a new one.

        Counts that fall to zero disappear.  Returns the new version's number."""
        base = self._all(version)
        merged = base.unionByName(deltas).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).filter("occurrences <> 0 OR records <> 0")
        new = self.version() + 1
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        # written with its bucket as partition, so that a reader of some terms opens one bucket
        merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={new}")
        return new


def marked_terms(counts: DataFrame, total: int, common_share: float = 0.2, rare_records: int = 2) -> DataFrame:
    """(term, occurrences, records, mark): 'common' in more than ``common_share`` of the records that have a
    term, else 'rare' in at most ``rare_records`` of them, else null."""
    mark = F.when(F.col("records") > common_share * total, "common").when(F.col("records") <= rare_records, "rare")
    return counts.select("term", "occurrences", "records", mark.alias("mark"))


def caption_counts(spark: SparkSession, images: DataFrame, export: DataFrame) -> dict[str, tuple[DataFrame, int]]:
    """Counts of the exported captions, and of the images' captions as the export plus the changes since."""
    older, newer = snapshot(export, "id", "caption"), snapshot(images, "id", "caption")
    store = TermCounts(spark, fresh_path(spark, "termcounts"))
    first = store.apply(term_deltas(changes(None, older)))
    second = store.apply(term_deltas(changes(older, newer)), first)
    return {"corpusimage": (store.read(first), store.total(first)), "images": (store.read(second), store.total(second))}
