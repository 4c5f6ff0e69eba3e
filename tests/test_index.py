"""Stored indexes against scans of everything, and the stemmer against a plain one."""

from __future__ import annotations

import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions import stem
from factloom.operators import postings, vectors
from factloom.operators import retrieval as R

# --- stems ------------------------------------------------------------------


def consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not consonant(w, i - 1))


def measure(w: str) -> int:
    kinds = [consonant(w, i) for i in range(len(w))]
    return sum(b and not a for a, b in zip(kinds, kinds[1:], strict=False))


def has_vowel(w: str) -> bool:
    return not all(consonant(w, i) for i in range(len(w)))


def ends_short(w: str) -> bool:
    return len(w) > 2 and consonant(w, len(w) - 3) and not consonant(w, len(w) - 2) and consonant(w, len(w) - 1) and w[-1] not in "wxy"


def replaced(w: str, rules: tuple, least: int) -> str:
    for suffix, end in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(suffix):
            begin = w[: -len(suffix)]
            return begin + end if measure(begin) > least and (suffix != "ion" or begin[-1:] in ("s", "t")) else w
    return w


def porter(w: str) -> str:
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    for suffix, end in stem.PLURALS:
        if w.endswith(suffix):
            w = w[: -len(suffix)] + end
            break
    fell = False
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and has_vowel(w[:-2]):
        w, fell = w[:-2], True
    elif w.endswith("ing") and has_vowel(w[:-3]):
        w, fell = w[:-3], True
    if fell:
        if w[-2:] in ("at", "bl", "iz"):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and ends_short(w):
            w += "e"
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = replaced(replaced(replaced(w, stem.SECOND, 0), stem.THIRD, 0), stem.FOURTH, 1)
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not ends_short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def test_stems_equal_a_plain_stemmer(spark):
    rng = random.Random(1)
    suffixes = [s for rules in (stem.PLURALS, stem.SECOND, stem.THIRD, stem.FOURTH) for s, _ in rules] + ["ed", "eed", "ing", "y", "e", "ll", ""]
    words = {"".join(rng.choices("abcdehilnorstuyywxz", k=rng.randrange(6))) + rng.choice(suffixes) + rng.choice(["", "", "s", "ed", "ing", "ly"]) for _ in range(6000)}
    words |= {"caresses", "ponies", "agreed", "hopping", "falling", "filing", "happy", "relational", "generalizations", "oscillators", "x1s", "été", "is"}
    frame = pd.DataFrame({"term": sorted(w for w in words if w and "yyyy" not in w)})
    expected = {w: porter(w) for w in frame["term"]}
    assert expected["generalizations"] == "gener" and expected["hopping"] == "hop"
    assert {r["term"]: r["stem"] for r in stem.stems(spark.createDataFrame(frame)).collect()} == expected
    con = duckdb.connect()
    con.register("words", frame)
    assert dict(con.sql(f"WITH {stem.stems_sql('words')} SELECT term, stem FROM stems").fetchall()) == expected


# --- postings ---------------------------------------------------------------


def ranked(chunks: dict, queries: dict, n: int) -> list[tuple]:
    split = lambda t: [porter(w) for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) <= 40]
    terms = {c: split(t) for c, t in chunks.items()}
    out = []
    for q, text in queries.items():
        scores = {}
        for t in set(split(text)):
            df = sum(t in ts for ts in terms.values())
            for c, ts in terms.items():
                if tf := ts.count(t):
                    scores[c] = scores.get(c, 0) + math.log(1 + (len(chunks) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / 256))
        best = sorted((-round(s, 6), c) for c, s in scores.items())[:n]
        out += [(q, c, rank, -s) for rank, (s, c) in enumerate(best)]
    return sorted(out)


def found(index, queries, n) -> list[tuple]:
    return sorted((r["query_id"], r["chunk_id"], r["rank"], r["score"]) for r in postings.search(index, queries, n).collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    words = [f"w{k}ing" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    chunks = {k: " ".join(rng.choices(words, weights, k=rng.randrange(5, 120))) for k in range(600)}
    chunks |= {600: None, 601: "", 602: "running runs run", 603: "run", 604: "run"}
    queries = {k: " ".join(rng.choices(words, weights, k=6)) for k in range(12)} | {20: "runs", 21: "nothing like it", 22: None, 23: "w0ing w1ing w350ing"}
    return chunks, queries


@pytest.mark.parametrize("block", [128, 4])
def test_search_equals_scoring_everything(spark, corpus, tmp_path, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    chunks, asked = corpus
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    frame = lambda keep: spark.createDataFrame([(c, t) for c, t in chunks.items() if keep(c)], "chunk_id int, text string")
    index = postings.TermIndex(spark, f"file://{tmp_path}/a")
    postings.add(index, frame(lambda c: c % 3))
    postings.add(index, frame(lambda c: c % 3 == 0))
    assert found(index, queries, 5) == ranked(chunks, asked, 5)
    # Removed and written anew: what counts is what is live.
    changed = {c: f"{t} changed words" for c, t in chunks.items() if c % 7 == 0}
    postings.upsert(index, spark.createDataFrame(list(changed.items()), "chunk_id int, text string"))
    gone = {c for c in chunks if c % 5 == 0}
    postings.remove(index, spark.createDataFrame([(c,) for c in sorted(gone)], "chunk_id int"))
    now = {c: t for c, t in (chunks | changed).items() if c not in gone}
    assert found(index, queries, 5) == ranked(now, asked, 5)
    fresh = postings.compact(index, f"file://{tmp_path}/b")
    assert found(fresh, queries, 5) == ranked(now, asked, 5)
    assert fresh.read("removed") is None and fresh.read("chunks").count() == len(now)


def test_a_broken_segment_is_not_one(spark, tmp_path, monkeypatch):
    """A write that dies before its last table leaves nothing that searches see."""
    index = postings.TermIndex(spark, f"file://{tmp_path}/c")
    postings.add(index, spark.createDataFrame([(1, "alpha beta")], "chunk_id int, text string"))
    real = postings.TermIndex.write

    def dies(self, df, segment, name):
        if name == "chunks":
            raise RuntimeError("lost")
        real(self, df, segment, name)

    monkeypatch.setattr(postings.TermIndex, "write", dies)
    with pytest.raises(RuntimeError):
        postings.add(index, spark.createDataFrame([(2, "alpha gamma")], "chunk_id int, text string"))
    queries = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    assert [r["chunk_id"] for r in postings.search(index, queries, 5).collect()] == [1]


# --- vectors ----------------------------------------------------------------


def frame_of(spark, v, ids):
    return spark.createDataFrame([(int(i), [float(x) for x in v[i]]) for i in ids], "chunk_id int, vector array<float>")


def test_exact_search_equals_a_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    v = (centers[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)
    items = frame_of(spark, v, range(900))
    odd = spark.createDataFrame([(2000, [1.0, 2.0]), (2001, None), (2002, [])], "chunk_id int, vector array<float>")
    queries = items.filter("chunk_id % 30 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    index = vectors.fit(items, f"file://{tmp_path}/v")
    vectors.add(index, items.filter("chunk_id < 500").unionByName(odd))
    vectors.add(index, items.filter("chunk_id >= 500"))
    assert index.segments("lists").agg(F.sum("n")).first()[0] == 900
    rows = lambda df: sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in R._best(df, 5, "chunk_id").collect())
    scan = lambda held: sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in R.dense_leg(queries, held, 5).collect())
    assert rows(vectors.search(index, queries, 5, probes=1, exact=True)) == scan(items)
    # Where vectors lie in groups, few lists hold what is near.
    probes = vectors.calibrated(index, queries, 5, 0.9)
    assert probes <= len(index.centroids) // 3
    near = set(rows(vectors.search(index, queries, 5, probes)))
    assert len({(q, c) for q, c, _ in near} & {(q, c) for q, c, _ in scan(items)}) >= 0.9 * len(scan(items))
    vectors.remove(index, items.filter("chunk_id % 4 = 1").select("chunk_id"))
    assert rows(vectors.search(index, queries, 5, probes=2, exact=True)) == scan(items.filter("chunk_id % 4 <> 1"))


def test_an_approximate_search_opens_only_its_lists(spark, tmp_path):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    index = vectors.fit(frame_of(spark, v, range(400)), f"file://{tmp_path}/w")
    vectors.add(index, frame_of(spark, v, range(400)))
    query = frame_of(spark, v, [7]).withColumnRenamed("chunk_id", "query_id")
    plan = vectors.search(index, query, 3, probes=1)
    assert plan.count() <= 3 * 8  # the best of each task
    asked = vectors._unit(v[7:8].astype(float))
    pairs = np.zeros((1, len(index.centroids)), bool)
    pairs[0, (asked @ index.centroids.T).argmax()] = True
    opened = vectors._opened(index, asked, __import__("pyarrow").array([7]), pairs, 3, "chunk_id", "query_id int, chunk_id int, score double")
    text = opened._jdf.queryExecution().toString()
    assert "PartitionFilters" in text and "In(list" in text.replace("EqualTo(list", "In(list")


def test_nothing_to_fit(spark, tmp_path):
    with pytest.raises(ValueError):
        vectors.fit(spark.createDataFrame([(1, None)], "chunk_id int, vector array<float>"), f"file://{tmp_path}/x")
