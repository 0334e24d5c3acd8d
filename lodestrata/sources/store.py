"""State of an index between runs: collections, manifests, checkpoints, caches, postings."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import bm25
from lodestrata.session import checkpointed


def parsed_time(text: Column) -> Column:
    """A timestamp from any of the formats in which ingestions are recorded, as UTC; null if none fits."""
    forms = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in forms], F.timestamp_seconds(F.when(text.rlike(r"^\s*\d{9,10}\s*$"), F.trim(text).try_cast("bigint"))))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") == 1).drop("_nth")


def latest_manifest(manifest: DataFrame) -> DataFrame:
    """The newest record of each file; records without a time come last, then the larger manifest_id wins."""
    timed = manifest.withColumn("ingested_ts", parsed_time(F.col("ingested_at")))
    return latest(timed, ["filename"], [F.col("ingested_ts").desc_nulls_last(), F.desc("manifest_id")])


def ingest_actions(incoming: DataFrame, manifest: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """incoming(filename, signature) with action: new, changed, unchanged (done and recorded) or resume (recorded only)."""
    known = manifest.select("filename", F.col("ingestion_signature").alias("_old"))
    done = checkpoints.select("filename", "signature", F.lit(True).alias("_done"))
    both = incoming.join(known, "filename", "left").join(done, ["filename", "signature"], "left")
    action = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("signature"), "changed").when(F.col("_done"), "unchanged").otherwise("resume")
    return both.withColumn("action", action).drop("_old", "_done")


def upserted(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """stored with the rows of batch whose key it lacks; of several with one key in the batch one is taken."""
    return stored.unionByName(batch.dropDuplicates([key]).join(stored.select(key), key, "left_anti"))


def without_source(df: DataFrame, source_col: str, name: str) -> DataFrame:
    """All rows but those of exactly this source; null sources stay."""
    return df.filter(~F.col(source_col).eqNullSafe(F.lit(name)))


def checkpoint_keys(done: DataFrame) -> DataFrame:
    return done.select(F.concat_ws("::", "filename", "signature").alias("key")).distinct()


def without_file(keys: DataFrame, filename: str) -> DataFrame:
    return keys.filter(~F.col("key").startswith(filename + "::"))


def save_checkpoints(keys: DataFrame, path: str) -> None:
    """The keys as JSON lines, sorted over all files."""
    keys.select("key").distinct().orderBy("key").write.mode("overwrite").json(path)


def with_captions(images: DataFrame, cache: DataFrame, caption) -> DataFrame:
    """images(img_hash, …) with captions: from the cache, and from the model `caption` (DataFrame to DataFrame with
    img_hash, caption) only for those that it lacks."""
    known = cache.select("img_hash", "caption")
    fresh = caption(images.select("img_hash", "content").dropDuplicates(["img_hash"]).join(known, "img_hash", "left_anti"))
    return images.join(known.unionByName(fresh), "img_hash", "left").withColumn("caption", F.coalesce("caption", F.lit("")))


class Files:
    """What is needed of the file system of a path, whichever of Hadoop's it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.root = self.hadoop.Path(root)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, path: str | None = None) -> list[str]:
        """Names directly under a path, sorted; none if it does not exist."""
        at = self.hadoop.Path(path) if path else self.root
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.hadoop.Path(path))

    def remove(self, path: str) -> None:
        self.fs.delete(self.hadoop.Path(path), True)


class Collections:
    """Named collections as Parquet folders under one root that the cluster shares, on any file system that Spark reads.

    A collection is partitioned into `buckets` by the hash of the source, so that a source is in one folder and the
    number of folders does not grow with the sources.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.files = Files(spark, self.root)

    def _path(self, name: str) -> str:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"no collection name: {name!r}")
        return f"{self.root}/collection_name={name}"

    def _bucket(self, source: Column) -> Column:
        return F.pmod(F.xxhash64(source), F.lit(self.buckets)).cast("int")

    def names(self) -> list[str]:
        return [n.split("=", 1)[1] for n in self.files.names() if n.startswith("collection_name=")]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def add(self, name: str, chunks: DataFrame, key: str = "chunk_hash") -> None:
        """Append the chunks that the collection lacks, at most once each."""
        fresh = chunks.dropDuplicates([key])
        if name in self.names():
            fresh = fresh.join(self.read(name).select(key), key, "left_anti")
        fresh.withColumn("_bucket", self._bucket(F.col("source"))).write.mode("append").partitionBy("_bucket").parquet(self._path(name))

    def delete_source(self, name: str, source: str) -> None:
        """Drop one source: one job rewrites its bucket, by a dynamic partition overwrite; other buckets stay untouched."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(source)).alias("b")).first().b
        path = self._path(name)
        if not self.files.exists(f"{path}/_bucket={bucket}"):
            return
        left = checkpointed(without_source(self.read(name).filter(F.col("_bucket") == bucket), "source", source))
        if left.isEmpty():
            self.files.remove(f"{path}/_bucket={bucket}")
        else:
            left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)

    def delete(self, name: str) -> None:
        self.files.remove(self._path(name))


def write_bm25(chunks: DataFrame, id_col: str, text_col: str, root: str) -> None:
    """The postings and statistics of all chunks as tables; readers pick them up by reading them again."""
    tokens = bm25.tokenised(chunks, id_col, text_col)
    posts, corpus = bm25.postings(tokens), bm25.corpus_stats(tokens)
    tokens.write.mode("overwrite").parquet(f"{root}/tokens")
    posts.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{root}/postings")
    corpus.write.mode("overwrite").parquet(f"{root}/corpus")
    spark = chunks.sparkSession
    stats = bm25.term_stats(spark.read.parquet(f"{root}/postings"), spark.read.parquet(f"{root}/corpus"))
    stats.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{root}/terms")


def read_bm25(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, corpus, stats) of a written index, for bm25.index_topk."""
    return spark.read.parquet(f"{root}/tokens"), spark.read.parquet(f"{root}/corpus"), spark.read.parquet(f"{root}/terms")


def missing_paths(required: list[str], spark: SparkSession | None = None) -> list[str]:
    """Those of the paths that a start needs and that do not exist: local ones, or with a session those it can reach."""
    return [p for p in required if not (Files(spark, p).exists(p) if spark else Path(p).exists())]


def reset_index(spark: SparkSession, root: str, keep: tuple[str, ...] = ()) -> list[str]:
    """Remove everything under an index root but the kept names; refuses roots that are no index folder."""
    files = Files(spark, root)
    path = files.fs.resolvePath(files.root).toUri().getPath() if files.exists(root) else ""
    if path.count("/") < 2 or path == str(Path.home()) or not files.fs.getFileStatus(files.root).isDirectory():
        raise ValueError(f"not an index folder: {root}")
    gone = [n for n in files.names() if n not in keep]
    for n in gone:
        files.remove(f"{root.rstrip('/')}/{n}")
    return gone
