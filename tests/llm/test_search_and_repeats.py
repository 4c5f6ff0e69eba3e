"""Operators 11, 12 and 13 against brute force, on small tables with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from factloom.llm import entries, lexical, spelling, suffixes

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, share long, label string"
ITEMS = "item_id long, text string, rank int"


def frame(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def plain(rows) -> collections.Counter:
    return collections.Counter(map(tuple, rows))


# --- 11 ---------------------------------------------------------------------


def folded(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def ranked(docs, items) -> list[tuple]:
    terms = [(i, folded(t)) for i, t in docs]
    number, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = collections.Counter(x for _, t in terms for x in set(t))
    asked: dict = collections.defaultdict(list)
    for i, t in items:
        asked[i].extend(folded(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, have in terms:
            tf, score = collections.Counter(have), 0
            for t in wanted:
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * (25 + 75 * len(have) * number // total)))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:10])]
    return out


SEARCHED = [
    (1, "The cat sat on the mat"), (2, None), (3, ""), (4, "cat"), (4, "cat"), (5, "CATs cat-cat, cat_cat;concat"), (None, "cat mat"), (6, "Été été ÉTÉ"), (7, "x" * 70_000 + " mat " + "y z " * 400_000),
    (8, "mat\x00mat\x7fmat mat"), (9, "日本 語 cat"), (10, "\n \t --"), (11, "the " * 3000), *[(100 + k, "tie one two") for k in range(14)],
]
ASKED = [(1, "cat mat"), (2, "Cat CAT été"), (3, None), (4, "absent words"), (5, "tie tie one"), (5, "cat"), (None, "mat"), (6, "日本 z"), (7, "mat mat mat x")]


@pytest.mark.parametrize("pairs", [lexical.MOST_PAIRS, 3])
def test_search_equals_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(lexical, "MOST_PAIRS", pairs)
    found = lexical.ranked(frame(spark, SEARCHED), frame(spark, ASKED, ITEMS))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert plain(found.collect()) == plain(ranked(SEARCHED, ASKED))


def test_search_agrees_with_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    assert plain(entries.op11_lexical_search(spark, SMALL).collect()) == plain(con.sql(lexical.SQL).fetchall())


def test_search_without_rows(spark):
    assert lexical.ranked(frame(spark, []), frame(spark, ASKED, ITEMS)).collect() == []
    assert lexical.ranked(frame(spark, SEARCHED), frame(spark, [], ITEMS)).collect() == []
    assert lexical.ranked(frame(spark, [(1, None), (2, " ")]), frame(spark, ASKED, ITEMS)).collect() == []


def test_matches_across_pieces_are_whole_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 5)
    group = lexical.Group([{"item_id": 1, "term": b"abcdefgh", "times": 1}, {"item_id": 1, "term": b"b", "times": 1}])

    class Sent:
        value = (group,)

    row, term, tf, n = lexical.Scanner(Sent())([b"abcdefgh b abcdefghb b", b"", b"b.b"])
    assert list(zip(row.tolist(), term.tolist(), tf.tolist(), strict=True)) == [(0, 0, 1), (0, 1, 2), (2, 1, 2)]
    assert n.tolist() == [4, 0, 2]


# --- 12 ---------------------------------------------------------------------


def removed(docs, length: int) -> list[tuple]:
    raws = [(i, (t or "").encode()) for i, t in docs]
    seen = collections.Counter(b[k : k + length] for _, b in raws for k in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def repeating(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    text = lambda n, letters="abcdefgh \n": "".join(rng.choices(letters, k=n))
    base, line, wide = text(3000), text(450), "".join(rng.choices("éß日a", k=700))
    rows = [(1, None), (2, ""), (3, base), (4, base), (4, base), (None, base), (None, None), (5, base[:399]), (6, base[:400]), (7, base[7:407] + text(50)), (8, wide), (9, "x" + wide), (10, text(400)), (11, text(401))]
    rows += [(20, "a" * 399), (21, "a" * 400), (22, "b" * 401), (23, "b" * 1500 + text(30)), (24, "ab" * 700), (25, "abc" * 300), (26, text(7) * 120), (27, "c" * 450 + "d" * 450), (28, "d" * 425)]
    for k in range(60):  # near copies, each with changes of its own
        changed = list(base)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(changed))
            changed[at : at + rng.randrange(2)] = text(rng.randrange(3))
        rows.append((100 + k, "".join(changed)))
    rows += [(300 + k, text(rng.randrange(300)) + line[rng.randrange(30) : len(line) - rng.randrange(30)] + text(rng.randrange(300))) for k in range(60)]
    rows += [(500 + k, text(rng.randrange(380, 500), "ab")) for k in range(5)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = repeating(seed)
    found = suffixes.digests(frame(spark, rows))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert plain(found.collect()) == plain(removed(rows, suffixes.LENGTH))


def test_repeats_in_small_slices_strings_and_blocks(spark, monkeypatch):
    """Cuts of texts into slices, strings and blocks change nothing."""
    for name, size in (("SLICE", 900), ("STRING", 50), ("BLOCK", 2000), ("BUCKET", 5000)):
        monkeypatch.setattr(suffixes, name, size)
    rows = repeating(3)
    assert plain(suffixes.digests(frame(spark, rows)).collect()) == plain(removed(rows, suffixes.LENGTH))


def test_repeats_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert plain(entries.op12_suffix_dedup(spark, SMALL).collect()) == plain(removed(rows, suffixes.LENGTH))


def test_suffixes_decide_where_no_phrase_repeats(spark):
    """Windows that only parts of phrases have in common are found by the sorted suffixes."""
    rng = random.Random(9)
    shared = "".join(rng.choices("abcdefgh", k=405))
    rows = [(k, "".join(rng.choices("abcdefgh", k=k)) + shared + "".join(rng.choices("abcdefgh", k=40))) for k in range(1, 60)]
    docs = suffixes.keyed(frame(spark, rows))
    copies, asked = suffixes.repeated_phrases(suffixes.phrases(docs))
    by_suffix = suffixes.decided(suffixes.blocks(docs, asked))
    told = collections.Counter()
    for r in by_suffix.collect():
        told[r["ka"]] += r["size"]
    assert sum(told.values()) > 0
    # Windows at the passage's edges stand in phrases of unlike bytes: copies alone miss some.
    copied = collections.Counter()
    for r in copies.collect():
        copied[r["ka"]] += r["size"]
    assert all(copied[r["ka"]] < 6 <= copied[r["ka"]] + told[r["ka"]] for r in docs.select("ka").collect())
    assert plain(suffixes.digests(frame(spark, rows)).collect()) == plain(removed(rows, suffixes.LENGTH))


def test_the_cover_meets_every_shift():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def test_repeats_without_rows_and_of_one_long_text(spark):
    assert suffixes.digests(frame(spark, [])).collect() == []
    rng = random.Random(4)
    part = "".join(rng.choices("abcdefghij ", k=5000))
    long = "".join(rng.choices("abcdefghij ", k=2_200_000)) + part + "".join(rng.choices("abcdefghij ", k=300_000)) + part
    (row,) = suffixes.digests(frame(spark, [(1, long)])).collect()
    assert (row["n_bytes"], row["n_spans"]) == (len(long), 2)
    assert 10_000 <= row["n_removed"] <= 10_004  # a letter or two may agree beside the passage


def test_repeats_kept_as_bytes(spark):
    rows = [(1, "q" + "ä" * 300), (2, "p" + "ä" * 300), (3, "alone")]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.without_repeats(frame(spark, rows)).collect()}
    assert got == {1: b"q", 2: b"p", 3: b"alone"}


# --- 13 ---------------------------------------------------------------------


def counts(docs) -> dict[str, int]:
    out: collections.Counter = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            out[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 31 == 0 else word] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(docs) -> list[tuple]:
    words = counts(docs)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    form = {w: f for w, vs in near.items() if vs and words[f := min(vs, key=lambda v: (-words[v], v))] >= 10 * words[w]}

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return [(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()]


def spelt(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (None, "Größere größere GRÖSSERE"), (3, "don't-stop_it 12345678"), (3, "don't-stop_it 12345678")]
    stems = ["".join(rng.choices("abé", k=rng.randrange(7, 11))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149, "y" + "x" * 299]
    for stem in stems:
        rows.append((rng.randrange(1000), " ".join([stem] * rng.choice([2, 3, 25, 260, 2600]))))
        for _ in range(4):
            at, kind = rng.randrange(len(stem)), rng.randrange(3)
            other = stem[:at] + ("" if kind == 0 else rng.choice("abcÿ")) + stem[at + (kind != 1) :]
            rows.append((rng.randrange(1000), " ".join([other.upper() if kind else other] * rng.choice([1, 2, 30, 300]))))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_equal_brute_force(spark, seed):
    rows = spelt(seed)
    found = spelling.variants(frame(spark, rows))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = grouped(rows)
    assert seed > 1 or any(r[1] and r[1] != r[2] for r in expected)  # chains of forms occur
    assert plain(found.collect()) == plain(expected)


def test_variants_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = grouped([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert plain(entries.op13_spelling_variants(spark, SMALL).collect()) == plain(expected)


def test_variants_with_hashes_that_clash(spark, monkeypatch):
    """Nodes that share a name have the edges of both; what is found stays exact."""
    real = spelling._hasher()
    rows = spelt(4)
    monkeypatch.setattr(spelling, "_hasher", lambda: lambda points, at, until: real(points, at, until) % np.uint64(5003))
    assert plain(spelling.variants(frame(spark, rows)).collect()) == plain(grouped(rows))


def test_variants_without_words(spark):
    assert spelling.variants(frame(spark, [])).collect() == []
    assert spelling.variants(frame(spark, [(1, "single words only"), (2, None)])).collect() == []


def test_variants_in_a_very_long_text(spark):
    text = " ".join(["telephone"] * 60_000 + ["telephon"] * 5 + ["l" * 20_000] * 2 + ["l" * 19_999] * 2)
    got = {r["word"][:10]: r for r in spelling.variants(frame(spark, [(12, text)])).filter("length(word) < 100").collect()}
    assert got["telephon"]["form"] == "telephone" and got["telephone"]["n"] == 60_000
    assert spelling.variants(frame(spark, [(12, text)])).filter("length(word) > 100 AND n_near = 1").count() == 2


# --- exact copies without ids -----------------------------------------------


def test_many_rows_without_ids(spark):
    """Rows that repeat a null id and a text make no array and meet in no task; of each text one stays."""
    from pyspark.sql import functions as F

    from factloom.llm import exactdup

    n = 1_000_000
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).otherwise("").alias("text"), F.col("id").alias("digest"))
    found = exactdup.groups(docs)
    sums = found.agg(F.count("*").alias("rows"), F.count_if("kept").alias("kept"), F.max("group_size").alias("most")).first()
    assert tuple(sums) == (n, 11, n * 4 // 5)
    left = exactdup.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["text"] for r in left.collect()) == sorted(["", *(f"t{k}" for k in range(0, 50, 5))])


def test_copies_with_and_without_ids(spark):
    from factloom.llm import exactdup

    rows = [(None, "a"), (None, "a"), (3, "a"), (2, "a "), (2, "a "), (None, "b"), (None, "b"), (7, None), (None, ""), (8, "c"), (8, "d"), (9, "only")]
    left = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in exactdup.without_copies(frame(spark, rows)).collect())
    assert left == sorted([(-1, "b"), (3, "a"), (2, "a "), (7, ""), (8, "c"), (8, "d"), (9, "only")])
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exactdup.groups(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    assert sorted(g for g in got if g[0] == 2) == [(2, 2, 2, False), (2, 2, 2, True)]
    assert sorted(g for g in got if g[2] == 3 and g[0] is not None) == [(3, 3, 3, True)]
    assert sum(g[3] for g in got) == 7
