"""The index as tables: keyed merges, what is stale or unchanged, an audit of all points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("text", "chunk_id", "document_id", "document_title", "region", "page_number", "section_path", "chunk_index", "citation_snippet", "extraction_method", "source_checksum")


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New points, and old ones whose key isn't new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def stale_ids(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ids of the old points of a document that its new points lack."""
    return old.select("document_id", key).join(new.select("document_id").distinct(), "document_id", "left_semi").join(new.select("document_id", key), ["document_id", key], "left_anti")


def fingerprints(chunks: DataFrame) -> DataFrame:
    """A digest of all chunks of each document, whatever their order.

    Each chunk is hashed with its index; hashes are combined by sums that tasks
    add up before anything is shuffled, so a document may have any number.
    """
    body = F.to_json(F.struct(*sorted(c for c in chunks.columns if c != "document_id")))
    each = chunks.select("document_id", *[F.xxhash64(F.lit(k), body).alias(f"h{k}") for k in range(3)])
    mixed = each.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.bit_xor("h0").alias("x"), *[F.sum(F.col(f"h{k}").cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)])
    return mixed.select("document_id", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("n_chunks", "x", "s1", "s2")]), 256).alias("fingerprint"), "n_chunks")


def unchanged(state: DataFrame, now: DataFrame) -> DataFrame:
    """Documents with ``skip``: checksum, fingerprint, version and number of points are as they were."""
    keys = ("source_checksum", "fingerprint", "version", "n_chunks")
    was = state.select("document_id", *[F.col(k).alias(f"was_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"was_{k}"))
    return now.join(was, "document_id", "left").select("document_id", same.alias("skip"))


def _rules(size: int | None = None) -> dict[str, Column]:
    """What is wrong with a point, by name."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    rules = {f"no_{c}": blank(c) if c != "section_path" else F.col(c).isNull() for c in REQUIRED}
    rules |= {
        "bad_page": F.coalesce(F.col("page_number") < 1, F.lit(True)),
        "bad_checksum": ~F.coalesce(F.col("source_checksum").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "unsafe_status": ~F.coalesce(F.col("coverage_status").rlike("^(indexed_|approved_)"), F.lit(False)),
        "snippet_not_in_text": ~F.coalesce(F.contains("text", "citation_snippet"), F.lit(False)),
        "unverified_ocr": F.col("extraction_method").eqNullSafe("unverified_ocr"),
    }
    if size is not None:
        rules["dense_size"] = F.coalesce(F.size("vector"), F.lit(0)) != size
    return rules


def audit(points: DataFrame, expected: int, excluded: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """One row over all points: how many there are and how many break each rule."""
    rules = _rules(size)
    if excluded is not None:
        points = points.join(excluded.select("document_id", "page_number", F.lit(True).alias("__out")), ["document_id", "page_number"], "left")
        rules["excluded_page"] = F.coalesce("__out", F.lit(False))
    sums = points.agg(F.count("*").alias("n_points"), *[F.count_if(r).alias(k) for k, r in rules.items()])
    # Repeated ids are counted by key first, so no task sees all of them.
    repeated = points.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_ids"))
    return sums.crossJoin(F.broadcast(repeated)).withColumn("expected", F.lit(expected).cast("long"))


def audit_errors(points: DataFrame, most: int = 25, size: int | None = None) -> DataFrame:
    """``chunk_id, errors`` of points that break rules, the first ``most`` by id: what a report shows."""
    errors = F.array_compact(F.array(*[F.when(r, F.lit(k)) for k, r in _rules(size).items()]))
    return points.select("chunk_id", errors.alias("errors")).filter(F.size("errors") > 0).orderBy("chunk_id").limit(most)


def without(points: DataFrame, documents: DataFrame | None = None, ids: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """An index without some documents, and without some points."""
    if documents is not None:
        points = points.join(documents.select("document_id"), "document_id", "left_anti")
    return points if ids is None else points.join(ids.select(key), key, "left_anti")


def document_counts(points: DataFrame, documents: DataFrame) -> DataFrame:
    """``document_id, n_points``: how many points each of some documents has, 0 included."""
    counts = points.groupBy("document_id").agg(F.count("*").alias("n_points"))
    return documents.select("document_id").join(counts, "document_id", "left").fillna({"n_points": 0})


def embedding_misses(chunks: DataFrame, cache: DataFrame, model: str, size: int) -> DataFrame:
    """Chunks whose vector isn't cached under content, model and size."""
    key = F.sha2(F.to_json(F.struct(F.sha2("text", 256).alias("content_hash"), F.lit(size).alias("dims"), F.lit(model).alias("model"))), 256)
    return chunks.withColumn("cache_key", key).join(cache.select("cache_key"), "cache_key", "left_anti")
