"""Queries of protocols over stored tables: withdrawal step by step, checks of outputs, nested calls, gates, names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.names import file_key
from factloom.operators import gates, postings, spans, withdrawal
from factloom.operators import retrieval as R
from factloom.plans.q_retrieval import RECALL_SQL, _metrics, _vectors
from factloom.plans.registry import query, table
from factloom.plans.staging import shared_folder, staged
from factloom.sources import outputs


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"


@query(
    """
    WITH d AS (SELECT doc_id, coalesce(source = 'src4', FALSE) AS out FROM documents),
    s(step, place) AS (VALUES ('start', 0), ('noted', 1), ('derived', 2), ('points', 3), ('pages', 4), ('end', 5)),
    n AS (SELECT count(*) AS n, count(*) FILTER (WHERE out) AS m FROM d)
    SELECT step, n - CASE WHEN place >= 2 THEN m ELSE 0 END AS n_manifests, n - CASE WHEN place >= 3 THEN m ELSE 0 END AS n_chunks, n - CASE WHEN place >= 3 THEN m ELSE 0 END AS n_points, n - CASE WHEN place >= 4 THEN m ELSE 0 END AS n_pages, CASE WHEN place IN (1, 2, 3, 4) THEN m ELSE 0 END AS n_left_out FROM s, n
    """
)
def withdrawal_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of one source withdrawn, stopped after each step and taken up again: what every table holds then."""
    docs = table(spark, folder, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), "source")
    path = _folder(spark, "library")
    index = postings.TermIndex(spark, f"{path}/index")
    library = withdrawal.Library(spark, path, index)
    manifests = docs.select("document_id", "source")
    withdrawal.created(library, manifests=manifests, tables=manifests, chunks=docs.select("document_id", "chunk_id", "text"), pages=docs.select("document_id", "text"))
    told = []

    def tell(step: str) -> None:
        counts = [library.read(n).count() for n in ("manifests", "chunks")] + [postings.live(index).count(), library.read("pages").count(), library.withdrawn().count()]
        told.append((step, *counts))

    tell("start")
    withdrawal.note(library, docs.filter("source = 'src4'").select("document_id"))
    tell("noted")
    for step in withdrawal.STEPS:
        withdrawal.finish(library, step)
        tell(step)
    return spark.createDataFrame(told, "step string, n_manifests long, n_chunks long, n_points long, n_pages long, n_left_out long")


@query(
    """
    WITH d AS (SELECT *, CASE WHEN lang = 'en' THEN 'whole' WHEN lang = 'de' THEN 'no_manifest' WHEN lang = 'fr' THEN 'extra' ELSE 'header' END AS kind FROM documents)
    SELECT 'artifact=' || source || '-' || kind AS artifact_id, CASE kind WHEN 'no_manifest' THEN 'MISSING' WHEN 'extra' THEN 'UNEXPECTED' WHEN 'header' THEN 'CSV_SCHEMA' ELSE CASE WHEN count(*) > 10000 THEN 'CSV_ROWS' END END AS code,
        CASE kind WHEN 'no_manifest' THEN 'name=manifest.json' WHEN 'extra' THEN 'name=notes.md' WHEN 'header' THEN 'name=rows.csv' ELSE CASE WHEN count(*) > 10000 THEN 'name=rows.csv' ELSE '' END END AS names, CASE kind WHEN 'no_manifest' THEN 1 WHEN 'extra' THEN 3 ELSE 2 END AS n_files
    FROM d GROUP BY source, kind
    """
)
def output_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as artifacts, one for each source and language, sound or flawed: the first rule that each breaks."""
    lang = F.col("lang")
    kind = F.when(lang == "en", "whole").when(lang == "de", "no_manifest").when(lang == "fr", "extra").otherwise("header")
    d = table(spark, folder, "documents").select("doc_id", "n_chars", F.concat_ws("-", F.coalesce("source", F.lit("")), kind).alias("artifact"), kind.alias("kind"))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.concat(F.lit('"a ""cell"", '), F.col("n_chars").cast("string"), F.lit('"')))
    rows = d.select("artifact", F.lit("rows.csv").alias("name"), F.col("doc_id").alias("place"), line.alias("value"))
    once = d.select("artifact", "kind").distinct()
    heads = once.select("artifact", F.lit("rows.csv").alias("name"), F.lit(-1).cast("long").alias("place"), F.when(F.col("kind") == "header", "n_chars,doc_id").otherwise("doc_id,n_chars").alias("value"))
    more = lambda keep, name, value: once.filter(keep).select("artifact", F.lit(name).alias("name"), F.lit(0).cast("long").alias("place"), F.lit(value).alias("value"))
    lines = rows.unionByName(heads).unionByName(more("kind <> 'no_manifest'", "manifest.json", '{"sources": [{"page": 1}]}')).unionByName(more("kind = 'extra'", "notes.md", "# Notes"))
    path = _folder(spark, "outputs")
    # One file for each name of an artifact, its lines in order.
    lines.repartition("artifact", "name").sortWithinPartitions("artifact", "name", "place").select("artifact", "name", "value").write.partitionBy("artifact", "name").text(path)
    wanted = once.select(F.concat(F.lit("artifact="), "artifact").alias("artifact_id"), F.explode(F.array(F.struct(F.lit("name=rows.csv").alias("name"), F.array(F.lit("doc_id"), F.lit("n_chars")).alias("columns")), F.struct(F.lit("name=manifest.json").alias("name"), F.lit(None).cast("array<string>").alias("columns")))).alias("f")).select("artifact_id", "f.*")
    out = outputs.checked(spark, path, wanted, r"/([^/]+)/([^/]+)/[^/]+$")
    return out.select("artifact_id", "code", F.array_join("names", ",").alias("names"), F.col("n_files").cast("int").alias("n_files"))


@query(
    """
    WITH l AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT o_custkey AS run_id, left(sha256(o_custkey::VARCHAR), 32) AS trace_id, 'o' || o_orderkey AS call_id, 1 AS depth, NULL AS parent_id FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)
    UNION ALL SELECT o_custkey, left(sha256(o_custkey::VARCHAR), 32), 'l' || l_orderkey || '-' || l_linenumber, 2, 'o' || l_orderkey FROM l JOIN (SELECT DISTINCT o_custkey, o_orderkey FROM orders) ON o_orderkey = l_orderkey
    UNION ALL SELECT o_custkey, left(sha256(o_custkey::VARCHAR), 32), 'r' || l_orderkey || '-' || l_linenumber, 3, 'l' || l_orderkey || '-' || l_linenumber FROM l JOIN (SELECT DISTINCT o_custkey, o_orderkey FROM orders) ON o_orderkey = l_orderkey WHERE f = 'R'
    """
)
def nested_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as calls of a customer's run, their lines as calls inside of them, and returns inside of lines."""
    # Dealt by order once: duplicates, the join and the events of an order's lines need no other exchange.
    # A line's greatest flag is R if it has R and none greater; numbers are grouped without a sort.
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("ts")).repartition("key").dropDuplicates(["run_id", "key"])
    l = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("no"), (F.when(F.col("l_returnflag") > "R", 2).when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("f")).repartition("key").groupBy("key", "no").agg(F.max("f").alias("f"))  # noqa: E741
    at = F.col("key") * 64
    inner = at + F.col("no") * 6
    event = lambda letter, seq, what: F.struct(seq.cast("long").alias("seq"), F.concat(F.lit(letter), F.col("key").cast("string"), *([F.lit("-"), F.col("no").cast("string")] if letter != "o" else [])).alias("call_id"), F.lit(letter).alias("name"), F.lit(what).alias("what"))
    told = lambda df, events: df.select("run_id", "ts", F.explode(events).alias("e")).select("run_id", "ts", "e.*")
    line, back = [event("l", inner, "open"), event("l", inner + 3, "close")], [event("r", inner + 1, "open"), event("r", inner + 2, "close")]
    every = told(o, F.array(event("o", at, "open"), event("o", at + 63, "close"))).unionByName(told(o.join(l, "key"), F.when(F.col("f") == 1, F.array(*line, *back)).otherwise(F.array(*line))))
    return spans.nested(every).select("run_id", "trace_id", "call_id", "depth", "parent_id")


@query(
    RECALL_SQL
    + """
    , found AS (SELECT d.*, e.label FROM d JOIN embeddings e ON e.vec_id = chunk_id WHERE rank < 5),
    o AS (SELECT count(*) FILTER (WHERE label = 3) AS n_unsafe, count(*) FILTER (WHERE label = asked_label) / count(*) AS citation_accuracy FROM found)
    SELECT n_cases, n_unsafe, round(citation_accuracy, 6) AS citation_accuracy, concat_ws(',', CASE WHEN n_unsafe > 0 THEN 'unsafe_evidence' END, CASE WHEN citation_accuracy < 1 THEN 'citation_accuracy' END, CASE WHEN recall_at_5 < 0.7 THEN 'recall_at_5' END, CASE WHEN recall_at_10 < 0.9 THEN 'recall_at_10' END, CASE WHEN mrr < 0.6 THEN 'mrr' END) AS failed FROM m, o
    """
)
def evaluation_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Gates of a search over vectors: what is found is counted while it is written; a wrong label is a wrong page, one label is unsafe."""
    asked, items = _vectors(spark, folder)
    labels = items.select("chunk_id", "label")
    found = R.dense_leg(asked, items, 5).join(labels, "chunk_id").join(labels.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    flow, seen = gates.watched(found, F.col("label") == 3, F.col("label") == F.col("wanted"))
    staged(flow, "watched")
    out = gates.verdict(_metrics(spark, folder), seen.get)
    return out.select("n_cases", "n_unsafe", F.round("citation_accuracy", 6).alias("citation_accuracy"), F.array_join("failed", ",").alias("failed"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(replace(coalesce(text, ''), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '-') AS key FROM documents")
def folded_names(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts as if they were names of files, in the form that files are paired by."""
    return table(spark, folder, "documents").select("doc_id", file_key(F.coalesce("text", F.lit(""))).alias("key"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'DOC-' || doc_id WHEN source IN ('src1', 'src3') THEN upper(source) END AS target FROM documents")
def evidence_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The target that each document is evidence for: two sources, and before them each English document."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("region"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), "lang")
    named = docs.filter("lang = 'en'").select(F.lit(0).alias("position"), F.upper("document_id").alias("target"))
    regions = docs.filter("region in ('src1', 'src3')").select(F.lit(1).alias("position"), F.upper("region").alias("target")).distinct()
    return gates.targets_of(docs, named.unionByName(regions)).select("doc_id", "target")
