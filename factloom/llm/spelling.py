"""Operator 13: spelling variants, found along a trie that is a table of edges.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased.
One code point is taken out of a run in the documents that a hash of id and run
picks, so that words have variants.  Words of at least ``LEAST_CHARS`` code
points that occur at least twice are inserted into two tries: one of words, one
of words read backwards.  Two words at one edit agree in all that lies before
it or in all that lies behind it, so an edit in the second half of a word is
looked for in the first trie and an edit in its first half in the second one.
States ``(word, position, node, edits)`` therefore start at the node of half a
word, where a trie has become thin, and not at its root.

Level by level all states are joined with the edges of their nodes.  An edge
that spells what follows in the word moves a state on; one that differs from it
by a replaced or an added code point moves it on and spends its edit.  A state
that ends at a word's end with its edit spent is a neighbour.  Each pair is
found from one side: taken-out code points are added ones seen from the other
word, and of two code points in one place the smaller is replaced by the larger.
Stretches of a trie without a fork are one edge, so the number of levels
is that of forks along a word and not of its letters.

Nodes are named by 64-bit hashes of prefixes.  Should two prefixes share a hash,
their node has the edges of both; every neighbour is verified by its text, so
results stay exact.  No task sees all words of a node: states and edges meet in
joins, and each state meets each edge of its node, of which there are at most as
many as letters.  Joins build their hash tables of edges, which no node has many
of, and deal states out, so a node that many words reach needs no sorting.

Rows: a null text has no words, a null ``doc_id`` is hashed as an empty string,
and rows that repeat count each.  Very long texts are read whole; very long
words have one row for each of their code points beyond the half, and are shown
once for each.  Of near words with equal counts the smallest in code-point
order is the form.  No rows, or no words: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.bpe import in_batches, narrow
from factloom.llm.spans import SpanHasher, give_back
from factloom.plans.staging import release, staged

#: Code points of a word, its occurrences, and how many times those of a word its form has, at least.
LEAST_CHARS, LEAST_COUNT, FORM_FACTOR = 7, 2, 10
#: One of so many pairs of document and run loses a code point.
DROPPED = 31
#: Words that a task counts before it hands them on.
COUNTED = 200_000
#: States up to which a level is small.
FEW = 100_000
#: Longest word that stands for itself as a key; longer ones are known by a hash of 256 bits.
KEY_CHARS = 64

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_CHARS)
_BACKWARDS = np.int64(0x5851F42D4C957F2D)


def counted(docs: DataFrame) -> DataFrame:
    """``word, n``: words and their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for ids, texts in in_batches(batches):
            for i, text in zip(ids, texts, strict=True):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(_RUN.findall(text.encode().translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % DROPPED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_CHARS:
                            continue
                    held[word] += n
            if len(held) > COUNTED:
                yield _counts(held)
                held = Counter()
        if held:
            yield _counts(held)

    parts = narrow(docs).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


# --- tries ------------------------------------------------------------------


@lru_cache(maxsize=1)
def _hasher() -> SpanHasher:
    return SpanHasher()


def _key(word: Column) -> Column:
    return F.when(F.length(word) <= KEY_CHARS, word).otherwise(F.concat(F.lit("#"), F.sha2(word, 256)))


def _spans(words: list[str], back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words that lie one after the other, where each begins, its length, and where its states start.

    A word that is read backwards starts at its other half.
    """
    length = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return points, np.cumsum(length) - length, length, np.where(back, length - length // 2, length // 2)


def _names(points: np.ndarray, at: np.ndarray, until: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Nodes of stretches of code points: hashes that tell the two tries apart."""
    return _hasher()(points, at, until).view(np.int64) ^ np.where(back, _BACKWARDS, np.int64(0))


def both_ways(words: DataFrame) -> DataFrame:
    """``key, backwards, spelt, n, position, first, last``: each word as it stands and backwards, where its states start, and the nodes of that place and of its end."""
    ways = F.explode(F.array(F.struct(F.lit(False).alias("backwards"), F.col("word").alias("spelt")), F.struct(F.lit(True).alias("backwards"), F.reverse("word").alias("spelt"))))
    turned = words.select(_key(F.col("word")).alias("key"), ways.alias("w"), "n").select("key", "w.backwards", "w.spelt", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = batch.column(1).to_numpy(zero_copy_only=False)
            points, begin, length, start = _spans(batch.column(2).to_pylist(), back)
            first, last = _names(points, begin, begin + start, back), _names(points, begin, begin + length, back)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start, pa.int32()), pa.array(first), pa.array(last)], [*batch.schema.names, "position", "first", "last"])

    return turned.mapInArrow(run, "key string, backwards boolean, spelt string, n long, position int, first long, last long")


def nodes(spelt: DataFrame) -> DataFrame:
    """``key, backwards, depth, node, next, start``: the nodes of each word from its half on; ``next`` is the code point that follows, 0 at the end.

    States of a word start where ``start`` is.  A word one code point longer
    must be met there too, so its nodes begin at the half of the shorter one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = batch.column(1).to_numpy(zero_copy_only=False)
            points, begin, length, start = _spans(batch.column(2).to_pylist(), back)
            least = np.where(back, length // 2, (length - 1) // 2)
            many = length - least + 1
            owner = np.repeat(np.arange(len(back)), many)
            depth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + least[owner]
            at = begin[owner]
            node = _names(points, at, at + depth, back[owner])
            over = depth < length[owner]
            after = np.zeros(len(owner), np.int32)
            after[over] = points[(at + depth)[over]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array(back[owner]), pa.array(depth, pa.int32()), pa.array(node), pa.array(after), pa.array(depth == start[owner])],
                ["key", "backwards", "depth", "node", "next", "start"],
            )
            give_back()

    return spelt.mapInArrow(run, "key string, backwards boolean, depth int, node long, next int, start boolean")


def edges(spelt: DataFrame, rows: DataFrame) -> DataFrame:
    """``node, child, label, follow``: the two tries as one table, stretches without a fork drawn together.

    ``follow`` has the code points that the edges of the child begin with, and
    a full stop if a word ends there.
    """
    forks = rows.groupBy("node").agg((F.max("start") | (F.min("next") == 0) | (F.min("next") < F.max("next"))).alias("kept")).filter("kept").select("node")
    met = rows.select("key", "backwards", "depth", "node").join(forks, "node")
    chains = met.groupBy("key", "backwards").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("chain")).filter(F.size("chain") > 1)
    chains = chains.join(spelt.select("key", "backwards", "spelt"), ["key", "backwards"])
    step = F.explode(F.zip_with(F.slice("chain", F.lit(1), F.size("chain") - 1), F.slice("chain", F.lit(2), F.size("chain") - 1), lambda a, b: F.struct(a["node"].alias("node"), b["node"].alias("child"), F.substring(F.col("spelt"), a["depth"] + 1, b["depth"] - a["depth"]).alias("label"))))
    steps = staged(chains.select(step.alias("e")).select("e.*").distinct().withColumn("head", F.substring("label", 1, 1)), "steps")
    ends = spelt.select(F.col("last").alias("node"), F.lit(".").alias("head")).distinct()
    follow = steps.select("node", "head").unionByName(ends).groupBy("node").agg(F.array_join(F.collect_set("head"), "").alias("follow"))
    return steps.drop("head").join(follow.withColumnRenamed("node", "child"), "child")


# --- the frontier -----------------------------------------------------------


def _spent(states: DataFrame, trie: DataFrame) -> DataFrame:
    """States whose edit is spent follow the edge that spells what is next."""
    size = F.length("label")
    met = states.join(trie, "node").filter((F.substring("spelt", F.col("position") + 1, size) == F.col("label")) & _can_go_on(F.col("position") + size))
    return met.select("backwards", "spelt", "n", (F.col("position") + size).alias("position"), F.col("child").alias("node"), "edits")


def _can_go_on(position: Column) -> Column:
    """Whether a state that spent its edit ends there at a word's end, or has an edge that begins as the word goes on."""
    return F.contains("follow", F.when(position == F.length("spelt"), F.lit(".")).otherwise(F.substring("spelt", position + 1, F.lit(1))))


def _fresh(states: DataFrame, trie: DataFrame) -> DataFrame:
    """States with an edit left meet every edge of their node, and go on, replace a code point or add one."""
    size = F.length("label")
    piece, shorter = F.substring("spelt", F.col("position") + 1, size), F.substring("spelt", F.col("position") + 1, size - 1)
    # One code point differs from another at once; longer labels are measured.
    near = lambda text, length: (F.length(text) == length) & ((size == 1) | (F.levenshtein(text, F.col("label"), 1) == 1))
    kept = piece == F.col("label")
    replaced = (F.col("label") > piece) & _can_go_on(F.col("position") + size) & near(piece, size)
    added = ~kept & _can_go_on(F.col("position") + size - 1) & near(shorter, size - 1)
    moves = F.array_compact(F.array(F.when(kept, 0), F.when(replaced, 1), F.when(added, 2)))
    met = states.join(trie, "node").filter(kept | replaced | added)
    met = met.select("backwards", "spelt", "n", "position", F.col("child").alias("node"), size.alias("size"), F.explode(moves).alias("move"))
    position = F.col("position") + F.col("size") - (F.col("move") == 2).cast("int")
    return met.select("backwards", "spelt", "n", position.alias("position"), "node", (F.col("move") > 0).cast("int").alias("edits"))


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: the pairs of ``words`` at exactly one added or replaced code point, each once; ``near`` is the longer or larger word."""
    spelt = staged(both_ways(words), "spelt")
    trie = staged(edges(spelt, nodes(spelt.select("key", "backwards", "spelt"))), "edges")
    ends = spelt.select(F.col("last").alias("node"), F.col("spelt").alias("near"), F.col("n").alias("near_n"))
    states = spelt.select("backwards", "spelt", "n", "position", F.col("first").alias("node"), F.lit(0).alias("edits"))
    levels = []
    done = (F.col("edits") == 1) & (F.col("position") == F.length("spelt"))
    count = FEW + 1
    while count:
        # Both joins deal edges by node once.  Where few states are left, Spark may send these to the edges instead.
        meets = trie.hint("shuffle_hash") if count > FEW else trie
        moved = _fresh(states.filter("edits = 0"), meets)
        if levels:
            moved = moved.unionByName(_spent(states.filter("edits = 1"), meets))
        moved = staged(moved, "states")
        levels.append(moved)
        states = moved.filter(~done)
        count = states.count()
    pairs = reduce(DataFrame.unionByName, [t.filter(done).select("backwards", "spelt", "n", "node") for t in levels]).join(ends, "node")
    pairs = pairs.filter(F.levenshtein("spelt", "near", 1) == 1)
    told = lambda c: F.when(F.col("backwards"), F.reverse(c)).otherwise(F.col(c))
    pairs = pairs.select("backwards", told("spelt").alias("word"), "n", told("near").alias("near"), "near_n")
    # An edit behind the half is the first trie's, whatever the second one finds.
    half = F.floor(F.length("word") / 2).cast("int")
    first = F.substring("word", F.lit(1), half) == F.substring("near", F.lit(1), half)
    out = staged(pairs.filter(~(F.col("backwards") & first)).drop("backwards").distinct(), "near")
    release(spelt, trie, *levels)
    return out


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n``, one row for each word."""
    words = staged(counted(docs), "words")
    pairs = neighbours(words)
    swapped = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    near = pairs.unionByName(swapped)
    many = near.groupBy("word").agg(F.count("*").alias("n_near"))
    # Only words that are frequent enough can be a form, and only few pairs have one.
    forms = near.filter(F.col("near_n") >= FORM_FACTOR * F.col("n")).groupBy("word").agg(F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    table = words.join(many, "word", "left").join(forms, "word", "left")
    table = table.select("word", F.col("best.form").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.less")).alias("form_n"))
    table = staged(table, "forms")
    # Each form has ten times the occurrences of its word: that bounds the length of a path, which each round doubles.
    most = table.agg(F.max("n")).first()[0] or 1
    hops = max(1, math.ceil(math.log(max(most / LEAST_COUNT, 1), FORM_FACTOR)) + 1)
    roots = table.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(hops)) + 1):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = staged(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
