"""Stored tables: written by document, read with a check of version and id; catalogs, overrides, vectors, traces, words of scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
#: Folders that sessions are dealt over.
SHELVES = 32
#: Bytes of files that a task holds before it hands them on.
READ_BYTES = 4_000_000
#: Texts that an embedder gets at once, and how often it is tried.
BATCH, TRIES = 16, 3


def _writes(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the finished writes of a store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/write=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("write=")) for f in found)


def write_store(table: DataFrame, folder: str, version: int = VERSION) -> None:
    """Write a table by ``document_id``: only the documents that it holds are replaced, each as a whole.

    Each write is a folder of its own; of a document the last write holds, so
    that files do not grow with documents and no other document is touched.
    Two writes at once take the same number, and the later fails.
    """
    number = max(_writes(table.sparkSession, folder), default=-1) + 1
    table.withColumn("store_version", F.lit(version)).write.parquet(f"{folder}/write={number}")


def read_store(spark: SparkSession, folder: str, documents: DataFrame, version: int = VERSION) -> tuple[DataFrame, DataFrame]:
    """Rows of the asked documents, and ``document_id, reason`` of those that are not there or of another version."""
    writes = _writes(spark, folder)
    asked = documents.select("document_id").distinct()
    if not writes:
        return spark.createDataFrame([], "document_id string"), asked.select("document_id", F.lit("TABLE_STORE_MISSING").alias("reason"))
    stored = spark.read.option("basePath", folder).parquet(*[f"{folder}/write={n}" for n in writes]).withColumn("document_id", F.col("document_id").cast("string"))
    last = stored.groupBy("document_id").agg(F.max(F.struct("write", "store_version")).alias("last")).join(asked, "document_id", "left_semi").select("document_id", F.col("last.write").alias("write"), (F.col("last.store_version") == version).alias("fits"))
    told = asked.join(last, "document_id", "left").select("document_id", F.when(F.col("fits").isNull(), "TABLE_STORE_MISSING").when(~F.col("fits"), "TABLE_STORE_VERSION").alias("reason"))
    return stored.join(last.filter("fits").select("document_id", "write"), ["document_id", "write"], "left_semi").drop("store_version", "write"), told.filter("reason is not null")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text`` of Markdown files, each whole."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("path"), F.col("value").alias("text"))


def local_path(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder in a file system; null for one in a store that only Spark reaches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return at.getPath() if at.getScheme() == "file" else None


def write_files(texts: DataFrame, folder: str) -> list[int]:
    """Each row (``name, text``; names are distinct) as a file of its own, in a folder for each task; the numbers of those folders.

    ``folder`` is a file system's path that all executors share.  Tasks write
    the files themselves: Spark's writer makes a folder for each, and its
    driver moves them one by one.  A task that is run again writes the same.
    """
    def run(batches):  # noqa: ANN001, ANN202
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        shelf = TaskContext.get().partitionId()
        os.makedirs(f"{folder}/{shelf}", exist_ok=True)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(f"{folder}/{shelf}/{name}", "wb") as file:
                    file.write(text)
        yield pa.RecordBatch.from_pydict({"shelf": pa.array([shelf], pa.int32())})

    return sorted(r["shelf"] for r in texts.select("name", F.col("text").cast("binary").alias("text")).mapInArrow(run, "shelf int").collect())


def read_files(spark: SparkSession, folder: str, shelves: list[int]) -> DataFrame:
    """``path, text`` of the files that :func:`write_files` left, each whole; a task lists and reads one folder, so the driver lists none."""
    def run(batches):  # noqa: ANN001, ANN202
        import os

        import pyarrow as pa

        def batch(names: list[str], texts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string()), "text": pa.array(texts, pa.binary())})

        for some in batches:
            for k in some.column(0).to_pylist():
                names, texts, held = [], [], 0
                with os.scandir(f"{folder}/{shelves[k]}") as files:
                    for found in files:
                        with open(found.path, "rb") as file:
                            names.append(found.name)
                            texts.append(file.read())
                        held += len(texts[-1])
                        if held > READ_BYTES:
                            yield batch(names, texts)
                            names, texts, held = [], [], 0
                yield batch(names, texts)

    n = len(shelves)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, "path string, text binary").select("path", F.col("text").cast("string").alias("text"))


def read_overrides(spark: SparkSession, *folders: str) -> tuple[DataFrame, DataFrame]:
    """Overrides from JSON files, an object or an array each; and the file names that several override."""
    schema = "pdf_filename string, markdown_filename string, document_id string, title string, region string"
    every = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(list(folders))
    twice = every.groupBy("pdf_filename").agg(F.count("*").alias("n")).filter("n > 1").select("pdf_filename", F.lit("DUPLICATE_OVERRIDE").alias("reason"))
    return every.join(twice, "pdf_filename", "left_anti"), twice


def read_scan_words(spark: SparkSession, folder: str) -> DataFrame:
    """``page, text, confidence`` of words that a reader of scans found: tab-separated rows, blank ones and those below 0 left out."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema("page int, conf string, text string").csv(folder)
    return rows.select("page", "text", F.col("conf").try_cast("double").alias("confidence")).filter("coalesce(text, '') <> '' and confidence >= 0")


def scan_review(words: DataFrame) -> DataFrame:
    """``page``, how many words and how sure on average."""
    return words.groupBy("page").agg(F.count("*").alias("n_words"), F.round(F.avg("confidence"), 2).alias("confidence"))


def read_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded answers of a benchmark, a JSON line each."""
    return spark.read.schema("case_id string, repeat int, response string, error_code string").json(folder)


def write_traces(traces: DataFrame, folder: str) -> None:
    """Run traces as JSON lines, those of a session on one shelf; runs are added, never changed.

    Shelves are a fixed number, so files do not grow with sessions.
    """
    shelved = traces.withColumn("shelf", F.pmod(F.xxhash64("session_id"), F.lit(SHELVES)).cast("int"))
    shelved.repartition(SHELVES, "shelf").write.mode("append").partitionBy("shelf").json(folder)


def read_traces(spark: SparkSession, folder: str, runs: DataFrame) -> DataFrame:
    """``run_id, trace``: the trace of each asked run, null unless exactly one is there."""
    stored = spark.read.schema("run_id string, trace string, session_id string").json(folder)
    one = stored.join(runs.select("run_id").distinct(), "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("n"), F.min("trace").alias("trace"))
    return runs.select("run_id").distinct().join(one, "run_id", "left").select("run_id", F.when(F.col("n") == 1, F.col("trace")).alias("trace"))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last rating of each run."""
    return feedback.groupBy("run_id").agg(F.max_by("positive", F.struct("rated_at", "feedback_id")).alias("positive"))


def catalog(documents: DataFrame) -> DataFrame:
    """Every document once: ``document_id, title, region, source_checksum`` of its first chunk or page."""
    first = F.min_by(F.struct("title", "region", "source_checksum"), F.struct("page_number", "title"))
    return documents.groupBy("document_id").agg(first.alias("d")).select("document_id", "d.*")


def live_vectors(index: DataFrame, documents: list[str] | None, withdrawn: DataFrame) -> DataFrame:
    """All points of an index under a filter, those of withdrawn documents left out."""
    some = index if documents is None else index.filter(F.col("document_id").isin(documents))
    return some.join(withdrawn.select("document_id"), "document_id", "left_anti")


def write_index(points: DataFrame, folder: str, size: int, model: str) -> None:
    """Points as Parquet by document, and beside them what they must fit: size, distance, model."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(f"{folder}/points")
    points.sparkSession.range(1).select(F.lit(size).alias("size"), F.lit("cosine").alias("distance"), F.lit("idf").alias("modifier"), F.lit(model).alias("model")).coalesce(1).write.mode("overwrite").json(f"{folder}/schema")


def schema_errors(spark: SparkSession, folder: str, size: int, model: str) -> DataFrame:
    """``field, found, wanted`` where an index doesn't fit."""
    found = spark.read.schema("size int, distance string, modifier string, model string").json(f"{folder}/schema")
    wanted = {"size": str(size), "distance": "cosine", "modifier": "idf", "model": model}
    each = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("found"), F.lit(v).alias("wanted")) for k, v in wanted.items()])).alias("x"))
    return each.select("x.*").filter("not found <=> wanted")


def embed(misses: DataFrame, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``cache_key, vector`` of texts that have none yet: batches go to ``embedder``, which is tried again if it fails."""

    def run(batches):  # noqa: ANN001, ANN202
        import time

        import pandas as pd

        for batch in batches:
            for at in range(0, len(batch), BATCH):
                some = batch.iloc[at : at + BATCH]
                for turn in range(TRIES):
                    try:
                        vectors = embedder(some["text"].tolist())
                        break
                    except Exception:
                        if turn == TRIES - 1:
                            raise
                        time.sleep(2**turn)
                yield pd.DataFrame({"cache_key": some["cache_key"].tolist(), "vector": vectors})

    return misses.select("cache_key", "text").dropDuplicates(["cache_key"]).mapInPandas(run, "cache_key string, vector array<float>")


def rebuild(index: DataFrame, sources: DataFrame) -> DataFrame:
    """``document_id, reason``: whether tables may be rebuilt from an index: each document's checksum there must be its source's."""
    have = index.groupBy("document_id").agg(F.min("source_checksum").alias("low"), F.max("source_checksum").alias("high"))
    met = sources.select("document_id", "source_checksum").join(have, "document_id", "left")
    return met.select("document_id", F.when(F.col("low").isNull(), "NOT_INDEXED").when((F.col("low") != F.col("source_checksum")) | (F.col("high") != F.col("source_checksum")), "CHECKSUM_MISMATCH").alias("reason"))


def may_initialise(count: Column, errors: Column) -> Column:
    """An index is filled at the start only if it is empty; a valid one stays, a broken one is refused."""
    return F.when(count == 0, "initialise").when(errors == 0, "keep").otherwise("refuse")
