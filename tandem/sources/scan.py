"""Sources and sinks: image folders, tables with a schema version, diagnostics files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tandem.runtime import fresh_path

EXTENSIONS = ("jpg", "jpeg", "heic", "heif", "png", "tiff", "tif")


def file_format(ext):
    e = F.lower(ext)
    return F.when(e.isin("jpg", "jpeg"), "JPEG").when(e.isin("heic", "heif"), "HEIC").when(e == "png", "PNG").when(e.isin("tiff", "tif"), "TIFF").otherwise(F.upper(e))


def scan_images(spark: SparkSession, folder: str, exclusions: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """(path, filename, fileformat, contenthash[, content]) of the image files below a folder.

    Hidden files and folders are skipped, and files whose path below the folder holds one of the ``exclusions``.  Without
    ``content`` the files are only listed, not read.  The hash is size and whole modification second."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name, ext = F.element_at(F.split("path", "/"), -1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    inside = F.substring(F.col("path"), len(folder.rstrip("/")) + 1, 2**30)
    rows = raw.filter(ext.isin(*EXTENSIONS) & ~inside.contains("/."))
    for e in exclusions:
        rows = rows.filter(~inside.contains(e))
    stamp = F.concat_ws("_", F.col("length").cast("string"), F.unix_seconds("modificationTime").cast("string"))
    cols = ["path", name.alias("filename"), file_format(ext).alias("fileformat"), stamp.alias("contenthash")]
    return rows.select(*cols, *(["content"] if content else []))


def capture_seconds(exif):
    """Epoch seconds of an EXIF time text under the session zone; null for absent and malformed ones."""
    return F.try_to_timestamp(exif, F.lit("yyyy:MM:dd HH:mm:ss")).cast("double")


class BucketTable:
    """A table in hash buckets of its key, of which an update rewrites only those it touches.

    ``path`` holds the files of every update in a folder of its own and small manifests that name the folder in force
    of each bucket.  A manifest appears whole, by one rename, after its files: readers see the table before or after
    an update and nothing in between, and an update that dies leaves the table as it was.  The number of buckets is
    fixed by the first update."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._Path(f"{self.path}/manifests")
        names = [st.getPath().getName() for st in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def state(self) -> tuple[int, dict[int, str]]:
        """(version, folder of each bucket); version 0 is the empty table."""
        have = self._versions()
        if not have:
            return 0, {}
        rows = self.spark.read.text(f"{self.path}/manifests/{have[-1]}").collect()  # one line a bucket
        head, *lines = sorted((r.value.split("\t") for r in rows), key=lambda x: int(x[0]))
        self.buckets = int(head[1])
        return have[-1], {int(b): folder for b, folder in lines}

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None while there is nothing in them."""
        held = self.state()[1]
        folders = [f"{self.path}/{f}" for b, f in sorted(held.items()) if only is None or b in only]
        return self.spark.read.parquet(*folders) if folders else None

    def bucket_of(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame, combine) -> int:
        """Replaces the touched buckets by ``combine(old rows or None, new rows)``; returns the new version."""
        version, held = self.state()
        touched = [r.b for r in rows.select(self.bucket_of().alias("b")).distinct().collect()]  # at most all buckets
        if not touched:
            return version
        new = combine(self.read(touched), rows).withColumn("_bucket", self.bucket_of())
        folder = f"files/{fresh_path(self.spark, 'v').rsplit('/', 1)[1]}"
        new.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        there = {int(st.getPath().getName().split("=")[1]) for st in self._fs.listStatus(self._Path(f"{self.path}/{folder}")) if st.getPath().getName().startswith("_bucket=")}
        held = {b: f for b, f in held.items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in there}
        lines = [f"-1\t{self.buckets}", *(f"{b}\t{f}" for b, f in sorted(held.items()))]
        beside, place = self._Path(f"{self.path}/manifests/_{folder.split('/')[1]}"), self._Path(f"{self.path}/manifests/{version + 1}")
        self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(beside.toString())
        if self._fs.exists(place) or not self._fs.rename(beside, place):
            raise RuntimeError(f"another update of {self.path} came first")
        return version + 1


def overwrite_scope(df: DataFrame, path: str, scope: str) -> None:
    """Overwrites only the partitions of ``scope`` that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)


def in_chunks(df: DataFrame, size: int = 20) -> Iterator[list[Row]]:
    """The rows in order, ``size`` at a time; partitions are fetched one ahead, never all at once."""
    chunk: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        chunk.append(row)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def migrate(df: DataFrame, version: int, steps: dict[int, object]) -> tuple[DataFrame, int]:
    """Applies the steps after ``version`` in order; each is a function of a table."""
    for n in sorted(k for k in steps if k > version):
        df, version = steps[n](df), n
    return df, version


def read_findings_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """Tab-separated report with a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
