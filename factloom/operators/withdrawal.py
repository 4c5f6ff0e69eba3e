"""Withdrawal of documents: ordered steps over stored tables, each of which a rerun takes up where the last one broke off.

A library is a folder of tables in versions; the newest whole version counts,
so a write that breaks off changes nothing.  A withdrawal first notes its
documents, which searches leave out from then on, and then removes what is
derived from them, their points in the index, and at last their pages.  Each
step notes that it is done.  Steps give the same result when they run again,
so one that was cut short, or done but not noted, is simply run once more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import postings

#: The steps after the note, in order.  Pages go last: they are the only thing that can't be derived again.
STEPS = ("derived", "points", "pages", "end")


@dataclass(frozen=True)
class Library:
    """Tables ``manifests, tables, chunks, pages`` in versions, with an index of the chunks."""

    spark: SparkSession
    path: str
    index: postings.TermIndex

    def folders(self, pattern: str) -> list[str]:
        """Whole written folders that fit a pattern, in the order of their names."""
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}/_SUCCESS")
        found = at.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(f.getPath().getParent().toString() for f in found)

    def read(self, name: str) -> DataFrame:
        """The newest whole version of a table."""
        return self.spark.read.parquet(self.folders(f"tables/{name}/v*")[-1])

    def write(self, name: str, df: DataFrame) -> None:
        """A further version of a table."""
        versions = self.folders(f"tables/{name}/v*")
        number = int(versions[-1].rsplit("/v", 1)[1]) + 1 if versions else 0
        df.write.mode("overwrite").parquet(f"{self.path}/tables/{name}/v{number:06d}")

    def open_batches(self) -> list[str]:
        """Withdrawals that have not ended, the oldest first."""
        batches = [p.rsplit("/", 2)[1] for p in self.folders("withdrawals/*/documents")]
        return [b for b in batches if "end" not in self.done(b)]

    def done(self, batch: str) -> set[str]:
        return {p.rsplit("/", 1)[1].removeprefix("done-") for p in self.folders(f"withdrawals/{batch}/done-*")}

    def documents(self, batch: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/withdrawals/{batch}/documents")

    def withdrawn(self) -> DataFrame:
        """``document_id`` of the withdrawals that have not ended: what every search leaves out."""
        parts = [self.documents(b) for b in self.open_batches()]
        return reduce(DataFrame.unionByName, parts).distinct() if parts else self.spark.createDataFrame([], "document_id string")


def created(library: Library, **tables: DataFrame) -> Library:
    """Write a library's tables and index its chunks (``chunk_id, document_id, text``)."""
    for name, df in tables.items():
        library.write(name, df)
    postings.add(library.index, library.read("chunks").select("chunk_id", "text"))
    return library


def _without(library: Library, documents: DataFrame, *names: str) -> None:
    for name in names:
        library.write(name, library.read(name).join(documents, "document_id", "left_anti"))


def _points(library: Library, documents: DataFrame) -> None:
    chunks = library.read("chunks").join(documents, "document_id", "left_semi").select("chunk_id")
    postings.remove(library.index, chunks)
    _without(library, documents, "chunks")


_ACTIONS: dict[str, Callable[[Library, DataFrame], None]] = {
    # Derived tables go first: they list the document, and would make a new upload of it a duplicate.
    "derived": lambda library, documents: _without(library, documents, "manifests", "tables"),
    "points": _points,
    "pages": lambda library, documents: _without(library, documents, "pages"),
    "end": lambda library, documents: None,
}


def note(library: Library, documents: DataFrame) -> str:
    """Note documents (``document_id``) as withdrawn, before anything is touched; returns the withdrawal's name."""
    batch = f"{len(library.folders('withdrawals/*/documents')):06d}-{uuid.uuid4().hex}"
    documents.select("document_id").distinct().write.parquet(f"{library.path}/withdrawals/{batch}/documents")
    return batch


def finish(library: Library, until: str = STEPS[-1]) -> None:
    """Run what is left of all withdrawals, up to a step; a step that fails leaves those after it undone."""
    for batch in library.open_batches():
        done = library.done(batch)
        for step in STEPS[: STEPS.index(until) + 1]:
            if step not in done:
                _ACTIONS[step](library, library.documents(batch))
                library.spark.range(1).select(F.lit(step).alias("step")).write.mode("overwrite").parquet(f"{library.path}/withdrawals/{batch}/done-{step}")


def withdraw(library: Library, documents: DataFrame) -> None:
    """Withdraw documents: a note, then all steps."""
    note(library, documents)
    finish(library)


def search(library: Library, queries: DataFrame, n: int) -> DataFrame:
    """The ``n`` best chunks of each query, of documents that are not withdrawn."""
    gone = library.read("chunks").join(library.withdrawn(), "document_id", "left_semi").select("chunk_id")
    # A withdrawn document's points may still be in the index: as many more are asked for as it has, at most.
    extra = gone.count()
    found = postings.search(library.index, queries, n + extra).join(gone, "chunk_id", "left_anti")
    return postings._best(found.drop("rank"), n)


def compacted(library: Library, path: str) -> Library:
    """The library with an index in ``path`` that holds live points alone."""
    return Library(library.spark, library.path, postings.compact(library.index, path))
