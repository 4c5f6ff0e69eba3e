"""Operator 4: quality rules, with the divergence of histograms from language references.

Base rules count words, symbols, repeated lines and words in repeated windows
of three.  The method compares two histograms of a document with those of its
language: of character classes, and of the language's commonest words, the
further words that cover half of its text in four groups by frequency, and all
others as one.  So a text without its language's words is at 0.56, beyond the
limit.  Both distances are the square root of the Jensen-Shannon
divergence to base 2.  A document fails if either exceeds its limit; documents
under ``LEAST_WORDS`` words are too short to tell and are not failed by it.

References are counted over all rows: a language with at least a thousandth
of the rows has its own, so there are a thousand at most; other rows, and rows
without a language, are held against the sum of all.  Character classes tell
scripts and the general categories of Unicode apart.

Words are common down to ``RARE`` of their language's words.  Buckets of word
hashes are counted first: only words of buckets that reach that share can be
common, so only these are counted one by one and shuffled.

Of the documents of sf0.1 that are labelled good and pass the base rules, 999
in 1000 are below 0.23 by classes and 0.36 by words; half of those labelled bad
are beyond 0.33 and 0.40, symbol junk beyond 0.36 by classes, table junk beyond
0.6 by words, and a text without its language's words is at 0.56.  The limits
lie between.

Rows: a null or empty text has no words.  Repeated rows are judged alike, null
ids stay.  No rows: no rows.  Columns other than ``doc_id, text, lang`` are
ignored.  Nothing here runs Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.staging import release, staged

#: Words under which histograms are not compared.
LEAST_WORDS = 50
#: Common words of a language; the share of its text that they and its further words cover, and most of both.
COMMON = 20
COVERED, MOST_WORDS = 0.5, 1000
#: Share of a language's words down to which a word is common, and buckets of word hashes: four to a common word at least.
RARE, BUCKETS = 1 / 16384, 1 << 16
#: Buckets that reach that share in all languages, at most: with more than 61 languages words are common down to a larger share.
MOST_BUCKETS = 1_000_000
#: Groups of further words, alike in how often their words occur together.
GROUPS = 4
#: Largest distances of character classes and of common words.
MOST_CLASSES, MOST_COMMON = 0.3, 0.45
#: Share of rows from which on a language has its own reference.
SHARE = 0.001
#: The key of the reference for all other rows.
ANY = ""
# Words, spaces and symbols of the base rules.
WORD, SPACE, SYMBOLS = r"[^ \t-\r]+", r"[ \t-\r]+", r"[#*$%&|<>]+"
# Character classes, each counted in what the ones before it leave; what none of them holds is the last.
CLASSES = (
    r"[a-z]+", SPACE, r"[.,;:!?'\"()-]+", r"[A-Z]+", r"[0-9]+", SYMBOLS, r"[@^~=+_/\\{}\[\]`]+",
    r"[\p{IsLatin}&&\p{Ll}]+", r"[\p{IsLatin}&&\p{L}]+", r"[\p{IsCyrillic}&&\p{Ll}]+", r"[\p{IsCyrillic}&&\p{L}]+", r"[\p{IsGreek}&&\p{L}]+", r"[\p{IsHan}&&\p{L}]+",
    r"[\p{IsHiragana}\p{IsKatakana}]+", r"[\p{IsHangul}&&\p{L}]+", r"[\p{IsArabic}&&\p{L}]+", r"[\p{IsDevanagari}&&\p{L}]+", r"\p{Ll}+", r"\p{L}+", r"\p{M}+", r"\p{N}+", r"\p{P}+", r"\p{S}+",
)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either is empty."""
    def share(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, F.transform(counts, lambda x: x / total))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(share(p), share(q), lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def repeat_words(words: str) -> Column:
    """Words in windows of three that the text has more than once, from the column of its sorted windows."""
    col = F.col(words)
    same = lambda x, k: F.get(col, k)["a"] == x["a"]
    starts = F.sort_array(F.transform(F.filter(col, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    # Starts closer than three share words.
    bound = F.transform(F.array(starts), lambda s: _total(F.transform(s, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - p, F.lit(3))).cast("long"))))
    return F.coalesce(F.get(bound, F.lit(0)), F.lit(0).cast("long"))


def common_words(docs: DataFrame, words: int = COMMON) -> tuple[list[str], dict[str, list[str]], dict[str, list[list[str]]], list[float]]:
    """Languages with their own reference, by language the commonest words and the groups of further ones, and how often all rows have those of ``ANY``, if a row needs them."""
    least = docs.count() * SHARE
    rows = docs.groupBy("lang_key").count().filter((F.col("count") >= least) & (F.col("lang_key") != ANY)).collect()
    languages = sorted(r["lang_key"] for r in rows)  # a thousand at most
    each = docs.select(_key(languages).alias("lang_key"), F.explode(F.split("text", SPACE, -1)).alias("word")).filter("word <> ''")
    each = each.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
    buckets = staged(each.groupBy("lang_key", "bucket").agg(F.count("*").alias("n")), "word-buckets")
    total = {r["lang_key"]: r["n"] for r in buckets.groupBy("lang_key").agg(F.sum("n").alias("n")).collect()}
    n_words, rare = sum(total.values()), max(RARE, len(total) / MOST_BUCKETS)
    limit = F.create_map(*[F.lit(x) for lang, n in total.items() for x in (lang, float(n))])[F.col("lang_key")] * rare if total else F.lit(0.0)
    full = buckets.filter(F.col("n") >= limit).select("lang_key", "bucket")  # MOST_BUCKETS rows at most
    likely = each.join(F.broadcast(full), ["lang_key", "bucket"], "left_semi")
    counts = staged(likely.groupBy("lang_key", "word").agg(F.count("*").alias("n")).filter(F.col("n") >= limit), "words")
    rank = F.row_number().over(Window.partitionBy("lang_key").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= MOST_WORDS).collect()
    release(counts, buckets)
    out: dict[str, list[str]] = {lang: [] for lang in [*languages, ANY]}
    further: dict[str, list[list[str]]] = {lang: [[] for _ in range(GROUPS)] for lang in out}
    weight: dict[str, int] = {}

    def share_out(lang: str, ranked: list[tuple[str, int]], n: int) -> None:
        covered = first = sum(times for _, times in ranked[:words])
        out[lang] = [word for word, _ in ranked[:words]]
        for word, times in ranked[words:MOST_WORDS]:
            if covered >= COVERED * n:
                break
            further[lang][int(GROUPS * (covered - first) / (COVERED * n - first))].append(word)
            covered += times

    ranked: dict[str, list[tuple[str, int]]] = {}
    for row in sorted(top, key=lambda r: (r["lang_key"], r["rank"])):
        ranked.setdefault(row["lang_key"], []).append((row["word"], row["n"]))
        weight[row["word"]] = weight.get(row["word"], 0) + row["n"]
    for lang in languages:
        share_out(lang, ranked.get(lang, []), total.get(lang, 0))
    share_out(ANY, sorted(weight.items(), key=lambda x: (-x[1], x[0])), n_words)
    held: list[float] = []
    if ANY in total:  # some row is held against all rows: its words are counted in all of them
        lists = [[w] for w in out[ANY]] + further[ANY]
        seen = {r["word"]: r["count"] for r in each.filter(F.col("word").isin([w for ws in lists for w in ws])).groupBy("word").count().collect()}  # MOST_WORDS at most
        held = [float(sum(seen.get(w, 0) for w in ws)) for ws in lists]
        held.append(n_words - sum(held))
    return languages, out, further, held


def _key(languages: list[str]) -> Column:
    return F.when(F.col("lang_key").isin(languages), F.col("lang_key")).otherwise(F.lit(ANY)) if languages else F.lit(ANY)


def features(docs: DataFrame, words: int = COMMON) -> tuple[DataFrame, list[float]]:
    """Counts of each document, written: base rules, ``classes`` and ``common``; and the common words of all rows."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(ANY)).alias("lang_key"))
    languages, common, further, held = common_words(source, words)
    # Words hold no white space, so the last line break parts the language from the word.
    others = [[f"{lang}\n{x}" for lang, groups in further.items() for x in groups[g]] for g in range(GROUPS)]
    listed = F.create_map(*[x for lang, ws in common.items() for x in (F.lit(lang), F.array(*map(F.lit, ws)).cast("array<string>"))])
    w, text = F.col("words"), F.col("text")
    # Each class is taken out of the text before the next one is counted, so the rest soon is short.
    cut = source.withColumn("lang_key", _key(languages)).select("doc_id", "lang_key", F.length(text).alias("rest0"), F.regexp_replace(text, CLASSES[0], "").alias("rest1"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("lines"))
    for k, c in enumerate(CLASSES[1:], 2):
        left_ = F.col(f"rest{k - 1}")
        cut = cut.withColumn(f"rest{k}", F.when(left_ == "", "").otherwise(F.regexp_replace(left_, c, ""))).withColumn(f"rest{k - 1}", F.length(left_))
    # Of the words only those that some list of the language holds are looked up in each.
    keyed = lambda lists: [f"{lang}\n{x}" for lang, ws in lists for x in ws]
    within = lambda of, words_: F.filter(of, lambda x: F.concat("lang_key", F.lit("\n"), x).isin(words_)) if words_ else F.array().cast("array<string>")
    tops = keyed(common.items())
    cut = cut.withColumn("known", within("words", [*tops, *[x for ws in others for x in ws]]))
    cut = cut.withColumn("tops", within("known", tops))
    cut = cut.withColumn(f"rest{len(CLASSES)}", F.length(f"rest{len(CLASSES)}"))
    left = [F.col(f"rest{k}") - F.col(f"rest{k + 1}") for k in range(len(CLASSES))]
    hashed = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    windows = F.when(F.size(w) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(hashed(i).alias("a"), i.alias("i")))))
    times = lambda ws: F.size(within("known", ws)).cast("long")
    counted = cut.select(
        "doc_id",
        "lang_key",
        F.size(w).cast("long").alias("n_words"),
        (F.col("rest0") - left[CLASSES.index(SPACE)]).cast("long").alias("word_chars"),
        left[CLASSES.index(SYMBOLS)].cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
        F.array(*left, F.col(f"rest{len(CLASSES)}")).cast("array<long>").alias("classes"),
        F.transform(listed[F.col("lang_key")], lambda t: (F.size("tops") - F.size(F.array_remove("tops", t))).cast("long")).alias("common"),
        F.array(*map(times, others)).alias("further"),
    )
    out = counted.select(
        "doc_id", "lang_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat_words("windows").alias("n_repeat_words"),
        "classes",
        F.concat("common", "further", F.array(F.greatest(F.lit(0).cast("long"), F.col("n_words") - _total(F.col("further")) - _total(F.col("common"))))).alias("common"),
    )
    return staged(out, "quality"), held


def judged(docs: DataFrame, words: int = COMMON) -> DataFrame:
    """One row for each of ``docs``: base counts and verdict, both distances, ``kept``."""
    counts, held = features(docs, words)
    sizes = {"classes": len(CLASSES) + 1, "common": words + GROUPS + 1}
    sums = [F.sum(F.get(name, F.lit(k))).alias(f"{name}{k}") for name, n in sizes.items() for k in range(n)]
    found = counts.groupBy("lang_key").agg(*sums).collect()  # a thousand rows at most
    empty = F.array().cast("array<double>")

    def reference(name: str) -> Column:
        table = {r["lang_key"]: [float(r[f"{name}{k}"]) for k in range(sizes[name]) if r[f"{name}{k}"] is not None] for r in found}
        if name == "classes" and table:
            table[ANY] = [sum(v) for v in zip(*table.values(), strict=True)]
        if name == "common" and held:
            table[ANY] = held
        pairs = [x for lang, v in table.items() for x in (F.lit(lang), F.array(*map(F.lit, v)).cast("array<double>"))]
        return F.create_map(*pairs)[F.col("lang_key")] if pairs else empty

    far = lambda name: js_distance(F.col(name).cast("array<double>"), reference(name))
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    out = counts.select("*", ((n < 50) | (100 * repeated > 50 * n)).alias("base_failed"), far("classes").alias("class_distance"), far("common").alias("common_distance"))
    long_enough = n >= LEAST_WORDS
    fails = long_enough & ((F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASSES) | (F.coalesce("common_distance", F.lit(0.0)) > MOST_COMMON))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~fails).alias("kept"), F.round("class_distance", 4).alias("class_distance"), F.round("common_distance", 4).alias("common_distance"))
