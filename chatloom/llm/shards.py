"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

An arrival is written once, as small files that never change. A shard's tier is
the power of ``fan`` that its size has reached; once a tier holds ``fan``
shards, its run is merged, in order, into files of the target size. Readers see
whole versions only: a version is a folder of manifest rows that appears by one
rename, which fails if another writer was first; the loser tries again on top of
the winner. All work on data is DataFrame operations. The driver handles the
paths of one round of compaction, at most ``MOST``, and, to read, the paths of a
version, as Spark does for any scan of files: some 100 bytes for each target size.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "path string, bytes bigint, rows bigint, version bigint"
#: Shards that one round of compaction may rewrite; the next round takes more.
MOST = 50_000
#: Times that a commit begins again behind another writer's.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """Shards of one schema under ``root``, in any store that Spark can write."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan: int = 4, base_bytes: int = 1 << 20):
        self.spark, self.root, self.target, self.fan, self.base = spark, root.rstrip("/"), target_bytes, fan, base_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        self._no_overwrite = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    # Versions.

    def version(self) -> int:
        """The latest committed version, 0 if there is none."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return max([0, *(int(n[1:]) for n in found if n[0] == "v")])

    def entries(self, version: int | None = None) -> DataFrame:
        """path, bytes, rows, version (that added it) of a version's shards."""
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/manifest/v{v:010d}")

    def _commit(self, entries: DataFrame, version: int) -> int:
        """Write the rows beside the manifests, then rename: the one step that others see."""
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        entries.select("path", "bytes", "rows", "version").coalesce(1).write.parquet(staged)
        self._fs.delete(self._path(f"{staged}/_SUCCESS"), False)
        final = self._path(f"{self.root}/manifest/v{version:010d}")
        if self._fs.exists(final):
            raise Conflict(f"version {version} is there already")
        renames = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        renames[0] = self._no_overwrite
        try:
            self._context.rename(self._path(staged), final, renames)
        except Exception as e:
            raise Conflict(f"version {version} could not be committed") from e
        return version

    def _listed(self, folder: str, version: int) -> DataFrame:
        """Manifest rows of the files in a folder: sizes from metadata, row counts from footers."""
        try:
            files = self.spark.read.option("recursiveFileLookup", "true").parquet(folder)
        except AnalysisException as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], ENTRY)
        return (
            files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
            .groupBy("path", "bytes")
            .agg(F.count("*").alias("rows"))
            .withColumn("version", F.lit(version).cast("long"))
        )

    # Writing.

    def append(self, arrival: DataFrame) -> int:
        """Add an arrival as new shards, one per task that has rows; returns the version.

        Rows are kept as they come: repeated ones, nulls and long texts alike, in
        columns of any name. An empty arrival is a version without new shards.
        Another writer's version in between is built upon.
        """
        folder = f"{self.root}/data/a-{uuid.uuid4().hex}"
        arrival.write.option("compression", "zstd").parquet(folder)
        for _ in range(TRIES):
            version = self.version() + 1
            try:
                return self._commit(self.entries(version - 1).unionByName(self._listed(folder, version)), version)
            except Conflict:
                continue
        raise Conflict(f"{TRIES} commits came before others'")

    def plan(self, version: int | None = None) -> DataFrame:
        """path, bytes, bin: which shards merge into which file.

        A tier with fewer than ``fan`` shards waits, and a shard of at least half
        the target stays as it is. Within a tier shards go to bins in order of
        version and path, by the running total of bytes, so each bin holds about
        one target. The windows run over manifest rows, one per file.
        """
        tier = F.floor(F.log(F.greatest(F.col("bytes") / self.base, F.lit(1.0))) / F.log(F.lit(float(self.fan))))
        tiers = self.entries(version).filter(F.col("bytes") < self.target / 2).withColumn("tier", tier)
        run = Window.partitionBy("tier")
        total = F.sum("bytes").over(run.orderBy("version", "path"))
        bins = (
            tiers.withColumn("n", F.count("*").over(run))
            .filter(F.col("n") >= self.fan)
            .withColumn("bin", F.floor((total - F.col("bytes") / 2) / self.target))
            .withColumn("members", F.count("*").over(Window.partitionBy("tier", "bin")))
            .filter("members > 1")
        )
        return bins.select("path", "bytes", F.concat_ws("-", F.col("tier").cast("string"), F.col("bin").cast("string")).alias("bin"))

    def compact(self) -> int | None:
        """One round: merge what ``plan`` names and commit; None if nothing is to do.

        Each bin is one task and one file. If other writers commit meanwhile, the
        merged files replace their sources in the latest version, as long as all
        of them are still in it; else the round is given up with a Conflict and
        its files are left to ``sweep``.
        """
        chosen = self.plan().orderBy("bin", "path").limit(MOST).collect()
        numbers = {b: i for i, b in enumerate(dict.fromkeys(r.bin for r in chosen))}
        if len(numbers) == len(chosen):
            return None
        paths = [r.path for r in chosen]
        read = self.spark.read.parquet(*paths)
        path, number = _free("shard_path", read.columns), _free("shard_number", read.columns)
        # At most MOST rows of a path and a number: a bounded side.
        bins = self.spark.createDataFrame([(r.path, numbers[r.bin]) for r in chosen], f"{path} string, {number} int")
        marked = read.join(F.broadcast(bins), F.col("_metadata.file_path") == F.col(path))
        folder = f"{self.root}/data/c-{uuid.uuid4().hex}"
        marked.repartitionById(len(numbers), number).drop(path, number).write.option("compression", "zstd").parquet(folder)
        gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
        for _ in range(TRIES):
            old = self.version()
            merged = self._listed(folder, old + 1)
            sources, before = self.entries(old).join(F.broadcast(gone), "path", "left_semi").agg(F.count("*"), F.sum("rows")).first()
            if sources != len(paths):
                raise Conflict("another writer has merged some of the same shards")
            after = merged.agg(F.sum("rows")).first()[0]
            if before != after:
                raise RuntimeError(f"merged files hold {after} rows, their sources {before}")
            try:
                return self._commit(self.entries(old).join(F.broadcast(gone), "path", "left_anti").unionByName(merged), old + 1)
            except Conflict:
                continue
        raise Conflict(f"{TRIES} commits came before others'")

    def compact_all(self) -> int:
        """Rounds until no tier is full; returns the version."""
        while self.compact() is not None:
            pass
        return self.version()

    # Reading.

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version, exactly those of its shards, older ones included."""
        entries = self.entries(version).select("path").collect()
        if not entries:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[r.path for r in entries])

    def expire(self, keep: int = 1) -> int:
        """Delete manifests but the latest ``keep``, and files that none of them names; returns their number."""
        latest = self.version()
        versions = range(max(1, latest - keep + 1), latest + 1)
        live = self.entries(latest).select("path")
        for v in versions[:-1]:
            live = live.union(self.entries(v).select("path"))
        gone = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.root}/manifest")) if int(s.getPath().getName()[1:]) not in versions]
        dead = self.entries(0).select("path")
        for m in gone:
            dead = dead.union(self.entries(int(m.getName()[1:])).select("path"))
        n = 0
        # Paths pass the driver one after another; manifests go last, so a cut-off run begins again.
        for r in dead.distinct().join(live, "path", "left_anti").toLocalIterator():
            self._fs.delete(self._path(r.path), False)
            n += 1
        for m in gone:
            self._fs.delete(m, True)
        return n

    def sweep(self, seconds: float = 7 * 86_400) -> int:
        """Delete data files that no version names and that are older than so many seconds, as lost jobs leave them; returns their number.

        The age spares files that a running writer has not committed yet. Files
        are listed by Spark; only the paths of those to be deleted pass the driver,
        one after another.
        """
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/data").select("path", "modificationTime")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0
        live = self.entries(0).select("path")
        for s in self._fs.listStatus(self._path(f"{self.root}/manifest")):
            live = live.union(self.entries(int(s.getPath().getName()[1:])).select("path"))
        plain = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
        old = files.filter(F.col("modificationTime") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(seconds)))).select("path", plain.alias("plain"))
        lost = old.join(live.select(plain.alias("plain")), "plain", "left_anti").select("path")
        n = 0
        for r in lost.toLocalIterator():
            n += self._fs.delete(self._path(r.path), False)
        return n


def _free(name: str, taken: list[str]) -> str:
    """The name, longer where a column has it already."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def arrivals(docs: DataFrame, n: int, key: str = "doc_id") -> list[DataFrame]:
    """docs as n arrivals, by a hash of the key (a null key goes to a fixed one)."""
    slot = F.pmod(F.xxhash64(key), F.lit(n))
    return [docs.filter(slot == i) for i in range(n)]
