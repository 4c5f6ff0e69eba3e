"""Queries of retrieval and its evaluation, over ``documents``, ``benchmark`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import retrieval as R
from factloom.plans.registry import query, table

TOP = 5


def _items(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("region"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), F.lit(1).alias("page_number"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Queries: each benchmark passage."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Of all vectors, those with an id that 50 divides are the queries."""
    e = table(spark, folder, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _labelled(queries: DataFrame, items: DataFrame) -> DataFrame:
    return queries.join(items.select(F.col("chunk_id").alias("query_id"), "label"), "query_id")


def bm25_sql(where: str = "") -> str:
    return rf"""
    WITH items AS (SELECT doc_id AS chunk_id, coalesce(text, '') AS text, source FROM documents {where}),
    ts AS (SELECT chunk_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) <= 40) AS ts FROM items),
    p AS (SELECT chunk_id, len(ts) AS length, term, count(*) AS tf FROM (SELECT chunk_id, ts, unnest(ts) AS term FROM ts) GROUP BY ALL),
    asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) <= 40)) AS term FROM benchmark),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT query_id, chunk_id, round(sum(ln(1 + ((SELECT count(*) FROM items) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 256.0))), 6) AS score
          FROM p JOIN df USING (term) JOIN asked USING (term) GROUP BY ALL),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM s QUALIFY rank < 20)
    """


@query(bm25_sql() + "SELECT query_id, chunk_id, round(score, 3) AS score, rank FROM bm WHERE rank < 5")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    out = R.bm25_leg(_asked(spark, folder), _items(spark, folder), R.leg_size(TOP))
    return out.filter(F.col("rank") < TOP).select("query_id", "chunk_id", F.round("score", 3).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(bm25_sql("WHERE source IN ('src1', 'src2', 'src3')") + "SELECT query_id, chunk_id, rank FROM bm WHERE rank < 5")
def filtered_search(spark: SparkSession, folder: str) -> DataFrame:
    """The same filter goes under every leg, before anything is ranked."""
    some = R.allowed(_items(spark, folder), regions=["src1", "src2", "src3"])
    return R.bm25_leg(_asked(spark, folder), some, R.leg_size(TOP)).filter(F.col("rank") < TOP).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


DENSE_SQL = """
    WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label, q.label AS asked_label, round(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]))
        / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x)))), 6) AS score FROM q, embeddings e),
    d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM s QUALIFY rank < 20)
"""


@query(DENSE_SQL + "SELECT query_id, chunk_id, rank FROM d WHERE rank < 5")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    queries, items = _vectors(spark, folder)
    return R.dense_leg(queries, items, TOP).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(
    DENSE_SQL
    + """
    , other AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) - 1 AS rank FROM s WHERE label = asked_label QUALIFY rank < 20),
    f AS (SELECT query_id, chunk_id, round(sum(1 / (rank + 2)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM d UNION ALL SELECT query_id, chunk_id, rank FROM other) GROUP BY ALL)
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM f QUALIFY rank < 5
    """
)
def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """A dense leg and one by label, each over-fetched, fused by reciprocal rank."""
    queries, items = _vectors(spark, folder)
    leg = R.label_leg(_labelled(queries, items), items, R.leg_size(TOP))
    return R.fuse([R.dense_leg(queries, items, R.leg_size(TOP)), leg], TOP).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    bm25_sql()
    + """
    , terms AS (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ('a', 'an', 'and', 'in', 'is', 'of', 'the', 'to', 'was', 'what'))) AS term FROM benchmark),
    hit AS (SELECT DISTINCT t.query_id FROM terms t JOIN bm ON bm.query_id = t.query_id AND bm.rank < 5 JOIN documents ON doc_id = chunk_id WHERE contains(lower(text), term))
    SELECT item_id AS query_id, CASE WHEN hit.query_id IS NULL THEN 'insufficient_evidence' ELSE 'candidate_evidence' END AS status FROM benchmark LEFT JOIN hit ON item_id = hit.query_id
    """
)
def sufficiency(spark: SparkSession, folder: str) -> DataFrame:
    items, asked = _items(spark, folder), _asked(spark, folder)
    found = R.bm25_leg(asked, items, R.leg_size(TOP)).filter(F.col("rank") < TOP)
    return R.sufficiency(asked, found.join(items, "chunk_id"))


RECALL_SQL = DENSE_SQL + """
    , gold AS (SELECT query_id, chunk_id FROM s WHERE label = asked_label AND query_id <> chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) <= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS nrank FROM s QUALIFY nrank < 50),
    c AS (SELECT g.query_id, count(*) AS n, count(*) FILTER (WHERE r.nrank < 5) AS at5, count(*) FILTER (WHERE r.nrank < 10) AS at10, min(r.nrank) AS first FROM gold g LEFT JOIN r ON r.query_id = g.query_id AND r.chunk_id = g.chunk_id GROUP BY 1),
    m AS (SELECT count(*) AS n_cases, round(sum(at5) / sum(n), 6) AS recall_at_5, round(sum(at10) / sum(n), 6) AS recall_at_10, round(avg(coalesce(1 / (first + 1), 0)), 6) AS mrr FROM c)
"""


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    queries, items = _vectors(spark, folder)
    ranked = R.dense_leg(queries, items, 50).select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("target"), "rank")
    # One more than three: a query may be among the first of its label.
    same = R.label_leg(_labelled(queries, items), items, 4).filter("query_id <> chunk_id")
    gold = R._best(same.select("query_id", "chunk_id", "score"), 3, "chunk_id")
    return R.evaluate(ranked, gold.select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("target")))


@query(RECALL_SQL + "SELECT * FROM m")
def recall_mrr(spark: SparkSession, folder: str) -> DataFrame:
    """Recall and mean reciprocal rank; three vectors of the query's label are its targets."""
    return _metrics(spark, folder)


@query(RECALL_SQL + "SELECT n_cases, CASE WHEN recall_at_5 < 0.7 OR recall_at_10 < 0.9 OR mrr < 0.6 THEN FALSE ELSE TRUE END AS passed FROM m")
def regression_gate(spark: SparkSession, folder: str) -> DataFrame:
    return R.gate(_metrics(spark, folder)).select("n_cases", "passed")


@query(
    bm25_sql()
    + """SELECT query_id, sum(CASE WHEN contains(regexp_replace(d.text, '\\s+', ' ', 'g'), regexp_replace(b.text, '\\s+', ' ', 'g')) THEN 1 ELSE 0 END)::BIGINT AS n_verbatim, count(*) AS n_found
    FROM bm JOIN documents d ON doc_id = chunk_id JOIN benchmark b ON item_id = query_id WHERE rank < 5 GROUP BY 1"""
)
def verbatim_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the documents found for a passage hold it word for word."""
    found = R.bm25_leg(_asked(spark, folder), _items(spark, folder), R.leg_size(TOP)).filter(F.col("rank") < TOP)
    passages = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("quote"))
    met = found.join(_items(spark, folder).select("chunk_id", "text"), "chunk_id").join(passages, "query_id")
    return met.groupBy("query_id").agg(F.count_if(R.covers(F.col("text"), F.col("quote"))).alias("n_verbatim"), F.count("*").alias("n_found"))


@query("WITH f AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(coalesce(documents.text, ''), benchmark.text)) SELECT query_id, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_documents FROM f GROUP BY 1")
def passage_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage verbatim: words are looked up first, then the text is read."""
    passages = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("quote"))
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # An inner word of the passage is a word of any text that holds it; the first and last may be parts of longer ones.
    words = lambda c: F.split(c, r"[^\p{L}\p{N}]+", -1)
    inner = F.array_distinct(F.filter(F.slice(words(F.col("quote")), F.lit(2), F.greatest(F.lit(0), F.size(words(F.col("quote"))) - 2)), lambda w: w != ""))
    asked = passages.select("query_id", "quote", inner.alias("inner"))
    inside = asked.select("query_id", F.explode("inner").alias("word"))
    held_ = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(inside.select("word").distinct(), "word", "left_semi")
    counts = inside.select("word").distinct().join(held_.groupBy("word").agg(F.count("*").alias("n")), "word", "left")
    rarest = inside.join(counts, "word").groupBy("query_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    pairs = held_.join(rarest, "word").select("doc_id", "query_id")
    found = pairs.join(docs, "doc_id").join(passages, "query_id").filter(F.contains("text", "quote")).select("doc_id", "query_id")
    # Passages without an inner word are looked up by their first characters, three at most.
    short = asked.filter((F.size("inner") == 0) & (F.length("quote") > 0))
    held = found
    if not short.isEmpty():
        keys = short.select("query_id", F.left("quote", F.lit(3)).alias("gram"))
        letters = F.split("text", "")
        grams = F.flatten(F.transform(letters, lambda c, i: F.array(*[F.array_join(F.slice(letters, i + 1, F.lit(n)), "") for n in (1, 2, 3)])))
        stand = docs.select("doc_id", F.explode(F.array_distinct(grams)).alias("gram")).join(keys.select("gram").distinct(), "gram", "left_semi")
        likely = stand.join(keys, "gram").select("doc_id", "query_id")
        held = found.unionByName(likely.join(docs, "doc_id").join(passages, "query_id").filter(F.contains("text", "quote")).select("doc_id", "query_id"))
    told = held.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_documents"))
    # An empty passage stands in every document.
    empty = passages.filter("quote = ''").select("query_id").crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_documents"))))
    return told.unionByName(empty.filter("n_chunks > 0"))


HYBRID_SQL = (
    bm25_sql("WHERE source <> 'src4'")
    + """
    , ev AS (SELECT item_id AS query_id, embedding AS qv FROM benchmark JOIN embeddings ON vec_id = item_id),
    dv AS (SELECT vec_id AS chunk_id, embedding AS v FROM embeddings JOIN documents ON doc_id = vec_id WHERE source <> 'src4'),
    ds AS (SELECT query_id, chunk_id, round(list_sum(list_transform(range(1, 65), lambda i: qv[i]::DOUBLE * v[i])) / (sqrt(list_sum(list_transform(qv, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x)))), 6) AS score FROM ev, dv),
    dl AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM ds QUALIFY rank < 20),
    fs AS (SELECT query_id, chunk_id, round(sum(1 / (rank + 2)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM dl UNION ALL SELECT query_id, chunk_id, rank FROM bm) GROUP BY ALL),
    fused AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM fs QUALIFY rank < 5)
    """
)


def _hybrid(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Passages as queries, with the vector of their number; documents as chunks, those of one source withdrawn."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = _asked(spark, folder).join(vectors.withColumnRenamed("chunk_id", "query_id"), "query_id", "left")
    items = _items(spark, folder)
    return R.search(asked, items, vectors, TOP, withdrawn=items.filter("region = 'src4'").select("document_id"))


@query(HYBRID_SQL + "SELECT query_id, f.chunk_id, f.score, f.rank, source AS region, 'doc-' || f.chunk_id AS document_id FROM fused f JOIN documents ON doc_id = f.chunk_id")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Dense and BM25 legs under one filter, fused, each chunk once, with the evidence itself."""
    rows, _, _ = _hybrid(spark, folder)
    return rows.filter("reason is null").select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), "region", "document_id")


@query(HYBRID_SQL + "SELECT l.leg, l.query_id, l.chunk_id, l.rank FROM (SELECT 'dense' AS leg, query_id, chunk_id, rank FROM dl UNION ALL SELECT 'bm25', query_id, chunk_id, rank FROM bm) l")
def search_debug(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates of each leg before they are fused."""
    _, _, legs = _hybrid(spark, folder)
    return legs["dense"].withColumn("leg", F.lit("dense")).unionByName(legs["bm25"].withColumn("leg", F.lit("bm25"))).select("leg", "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))
