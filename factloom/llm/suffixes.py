"""Operator 12: removal of long repeated byte strings, by suffixes sorted along a difference cover.

Texts are bytes of UTF-8.  A *window* is a string of ``LENGTH`` bytes of one
text; each byte of a window that also starts anywhere else is removed.

**What can repeat.**  Among the ``GRAM``-byte strings that begin in a window's
first half the one of least hash is the window's anchor, by content alone, so
equal windows have equal anchors.  Neighbouring windows with one anchor are a
phrase.  Phrases whose anchor stands once in the corpus are left out.  Phrases
of equal bytes are one with a weight, as exact copies are in the other
operators; a weight above one says that all their windows repeat.  One phrase
of each kind goes on, if its anchor is shared with a phrase of another kind.

**Suffixes.**  The strings that are left are sorted by the method of the
difference cover modulo ``PERIOD``: the places whose remainder is in ``COVER``
are the sample, and for any two places some shift below ``PERIOD`` brings both
into it.  The sample's triples of words (three times ``PERIOD`` bytes) are
sorted and named by their order; names are strings again, whose triples are
sorted and named in turn (nine times ``PERIOD`` bytes), until two of them and
some bytes span a window.  The remaining suffixes are merged through the
sample: a window that begins ``t`` bytes before a sample place is known by
these bytes, the names at the place, and the bytes behind them.  For each ``t``
records are sorted and adjacent ones compared, over exactly ``LENGTH`` bytes.
Only equality of adjacent prefixes is asked, so names count within a bucket
that a key's hash picks, and buckets need no order among each other.

**Sizes.**  Strings go in blocks of some hundred kilobytes.  A block sends each
distinct key once, with the number of its uses where that matters, so a string
that a third of all texts hold makes one row for each block and not for each
text.  Names return to blocks in the order in which keys were sent.  Buckets
grow in number with the input, and each round is a written table.

Rows: a null text counts as empty.  Texts under ``LENGTH`` bytes stay whole.
Very long texts are cut into slices, which share the bytes that windows at a
cut need.  Rows that repeat a text are copies of each other whatever their ids,
null ids included, and are removed whole if long enough.  Of windows that repeat
none stays, so there are no ties.  No rows: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bloom import member_test
from factloom.llm.spans import SpanHasher, give_back, mixed
from factloom.plans.staging import release, staged

#: Bytes of a string that may not start twice.
LENGTH = 400
#: Bytes of an anchor, and of the places in a window that it is chosen from.
GRAM = 200
#: The difference cover: each number below PERIOD is a difference of two of its members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Bytes of the first triple and of a triple of its names; bytes behind two of these in a window.
FIRST, SECOND = 3 * PERIOD, 9 * PERIOD
REST = LENGTH - 2 * SECOND
#: Bytes that are read together, windows of a string, bytes of a block, of the keys of a bucket, about.
SLICE, STRING, BLOCK, BUCKET = 1 << 21, 1 << 16, 1 << 18, 1 << 25
#: Seed of the second half of a text's key.
SECOND_KEY = 0x5EED

_PLACE = np.uint64((1 << 22) - 1)


@lru_cache(maxsize=1)
def _hasher() -> SpanHasher:
    return SpanHasher()


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, ka, kb, text``: a text's key is 128 bits of its content."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("ka"), F.xxhash64(F.lit(SECOND_KEY), text).alias("kb"), text.alias("text"))


# --- phrases ----------------------------------------------------------------


def _least(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of each ``wide`` neighbouring values, by minima from both ends of blocks."""
    n = len(values)
    padded = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    ahead = np.minimum.accumulate(padded.reshape(-1, wide), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(-1, wide)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - wide + 1], ahead[wide - 1 : n])


def _phrases(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of the phrases of texts that lie one after the other."""
    if len(raw) < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    at = np.arange(len(raw) - GRAM + 1)
    grams = _hasher()(raw, at, at + GRAM)
    chosen = _least((grams & ~_PLACE) | at.astype(np.uint64), LENGTH - GRAM + 1) & _PLACE
    starts = np.arange(len(chosen))
    inside = starts + LENGTH <= ends[np.searchsorted(ends, starts, "right")]
    fresh = np.ones(len(chosen), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | ~inside[:-1]
    first = np.flatnonzero(fresh & inside)
    edges = np.append(np.flatnonzero(fresh | ~inside), len(chosen))
    size = edges[np.searchsorted(edges, first, "right")] - first
    return first, size, grams[chosen[first].astype(np.int64)]


def phrases(docs: DataFrame) -> DataFrame:
    """``anchor, ca, cb, ka, kb, start, size``: the phrases of ``keyed`` texts; ``ca, cb`` are a hash of their bytes."""

    def flush(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        data = b"".join(h[3] for h in held)
        ends = np.cumsum([len(h[3]) for h in held])
        first, size, anchor = _phrases(np.frombuffer(data, np.uint8), ends)
        owner = np.searchsorted(ends, first, "right")
        named = b"".join(hashlib.blake2b(data[a : a + n + LENGTH - 1], digest_size=16).digest() for a, n in zip(first.tolist(), size.tolist(), strict=True))
        names = np.frombuffer(named, "<i8").reshape(-1, 2)
        ka, kb, offset = (np.array([h[k] for h in held], np.int64)[owner] for k in range(3))
        begin = (ends - [len(h[3]) for h in held])[owner]
        cols = [anchor.view(np.int64), names[:, 0], names[:, 1], ka, kb, (first - begin + offset).astype(np.int32), size.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "ca", "cb", "ka", "kb", "start", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held = [], 0
        for batch in batches:
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                whole = text.as_py()
                for at in range(0, max(1, len(whole) - LENGTH + 1), SLICE):
                    piece = whole[at : at + SLICE + LENGTH - 1]
                    if len(piece) < LENGTH:
                        continue
                    held.append((a, b, at, piece))
                    bytes_held += len(piece)
                    if bytes_held >= SLICE // 2:
                        yield flush(held)
                        held, bytes_held = [], 0
            give_back()
        if held:
            yield flush(held)

    return docs.filter(F.octet_length("text") >= LENGTH).select("ka", "kb", "text").mapInArrow(run, "anchor long, ca long, cb long, ka long, kb long, start int, size int")


def repeated_phrases(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ka, kb, start, size`` of phrases all of whose windows repeat, and of the ones that suffixes must decide on."""
    shared = staged(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    some = staged(found.filter(member_test(shared, "anchor")(F.col("anchor"))).join(shared, "anchor"), "phrases")
    kind = ["anchor", "ca", "cb"]
    kinds = staged(some.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("ka", "kb", "start", "size")).alias("one")), "kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor")
    asked = staged(kinds.join(several, "anchor").select("one.*"), "asked")
    copies = staged(some.join(kinds.filter("n > 1").select(*kind), kind, "left_semi").select("ka", "kb", "start", "size").distinct(), "copied")
    release(shared, some, kinds)
    return copies, asked


# --- blocks of strings ------------------------------------------------------

_BLOCK = "block long, data binary, ka array<long>, kb array<long>, start array<int>, windows array<int>, names binary"
_FIELDS = ["block", "data", "ka", "kb", "start", "windows", "names"]


def _merged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of what intervals cover together, in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order].astype(np.int64), np.maximum.accumulate((start + size)[order].astype(np.int64))
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(fresh)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def blocks(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The strings that hold the asked phrases, some hundred kilobytes a row."""
    wanted = asked.groupBy("ka", "kb").agg(F.collect_list("start").alias("start"), F.collect_list("size").alias("size"))
    wanted = staged(wanted, "wanted")
    # Of equal texts one is needed; each task hands on one before anything is shuffled.
    texts = docs.select("ka", "kb", "text").filter(member_test(wanted, "ka")(F.col("ka"))).dropDuplicates(["ka", "kb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            columns = [[number], [b"".join(h[0] for h in held)], *[[[h[k] for h in held]] for k in (1, 2, 3, 4)], [b""]]
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _FIELDS)

        for batch in batches:
            for a, b, text, start, sizes in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.large_binary()), batch.column(3), batch.column(4))), strict=True):
                for begin, end in zip(*(x.tolist() for x in _merged(np.array(start), np.array(sizes))), strict=True):
                    for at in range(begin, end, STRING):
                        until = min(at + STRING, end)
                        held.append((text[at : until + LENGTH - 1], a, b, at, until - at))
                        size += len(held[-1][0])
                        if size >= BLOCK:
                            yield flush()
                            number, held, size = number + 1, [], 0
            give_back()
        if held:
            yield flush()

    met = texts.join(wanted, ["ka", "kb"]).select("ka", "kb", "text", "start", "size")
    out = staged(met.mapInArrow(run, _BLOCK), "blocks")
    release(wanted)
    return out


class Strings:
    """The strings of one block: for each of its bytes the string, the place in it, and what is in the sample."""

    def __init__(self, row: dict) -> None:
        self.raw = np.frombuffer(row["data"], np.uint8)
        windows = np.array(row["windows"], np.int64)
        length = windows + LENGTH - 1
        base = np.cumsum(length) - length
        self.owner = np.repeat(np.arange(len(windows)), length)
        self.place = np.arange(len(self.raw)) - base[self.owner]
        self.after = length[self.owner] - self.place
        self.windows = windows[self.owner]
        self.sampled = np.isin(self.place % PERIOD, COVER)

    def at(self, reach: int) -> np.ndarray:
        """Sample places that ``reach`` bytes follow in their string."""
        return np.flatnonzero(self.sampled & (self.after >= reach))

    def named(self, names: bytes, reach: int) -> np.ndarray:
        """Names by byte, from those of the sample places in their order."""
        out = np.zeros(len(self.raw), np.int64)
        out[self.at(reach)] = np.frombuffer(names, np.int64)
        return out


def _packed(*columns: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers and bytes as strings that sort like the rows."""
    parts = [c.astype(">i8").view(np.uint8).reshape(len(c), 8) if c.ndim == 1 else c for c in columns]
    joined = np.ascontiguousarray(np.concatenate(parts, axis=1))
    return joined.view(f"S{joined.shape[1]}").ravel()


def _first_triples(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Triples of words at sample places, and a hash of each."""
    s = Strings(row)
    at = s.at(FIRST)
    window = np.lib.stride_tricks.sliding_window_view(s.raw, FIRST)[at] if len(at) else np.zeros((0, FIRST), np.uint8)
    return _packed(window), _hasher()(s.raw, at, at + FIRST)


def _name_triples(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Triples of names at sample places."""
    s = Strings(row)
    at, names = s.at(SECOND), s.named(row["names"], FIRST)
    three = [names[at + k * FIRST] for k in range(3)]
    return _packed(*three), _mixed(*three)


def _mixed(*numbers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(numbers[0]), np.uint64)
    for n in numbers:
        out = mixed((out ^ n.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _records(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sample places with what stands before and behind: two names, ``REST`` bytes, the bytes before, least and largest shift."""
    s = Strings(row)
    at = _shifted(s)
    names = s.named(row["names"], SECOND)
    two = names[at], names[at + SECOND]
    behind = at[:, None] + 2 * SECOND + np.arange(REST)
    before = at[:, None] - 1 - np.arange(PERIOD - 1)
    rest = np.where(behind - at[:, None] < s.after[at, None], s.raw[np.minimum(behind, len(s.raw) - 1)], 0).astype(np.uint8)
    left = np.where(before >= at[:, None] - s.place[at, None], s.raw[np.maximum(before, 0)], 0).astype(np.uint8)
    least, most = np.maximum(0, s.place[at] - s.windows[at] + 1), np.minimum(PERIOD - 1, s.place[at])
    return _packed(*two, rest, left, np.stack([least, most], 1).astype(np.uint8)), _mixed(*two)


def _shifted(s: Strings) -> np.ndarray:
    """Sample places that are less than ``PERIOD`` behind the start of some window."""
    return np.flatnonzero(s.sampled & (s.place - s.windows + 1 < PERIOD))


# --- rounds -----------------------------------------------------------------

Keys = Callable[[dict], tuple[np.ndarray, np.ndarray]]


def _distinct(row: dict, keys: Keys, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct keys, the bucket of each, its number of uses, and the key of each place."""
    every, hashes = keys(row)
    distinct, first, inverse, uses = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
    return distinct, (hashes[first] % np.uint64(buckets)).astype(np.int64), uses, inverse


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
        give_back()


def round_trip(table: DataFrame, keys: Keys, buckets: int, judge: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, back: Callable[[dict, np.ndarray], Iterator[pa.RecordBatch]], kinds: str) -> DataFrame:
    """Send the distinct keys of blocks to buckets, judge each bucket's keys together, and bring the answers back.

    ``judge`` has the sorted keys of a bucket, block by block, and their uses,
    and gives a number for each; ``back`` has a block and the numbers of its
    places.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            distinct, bucket, uses, _ = _distinct(row, keys, buckets)
            some = np.unique(bucket).tolist()
            cut = [bucket == b for b in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([row["block"]] * len(some), pa.int64()), pa.array([distinct[c].tobytes() for c in cut], pa.binary()), pa.array([np.minimum(uses[c], 2).astype(np.uint8).tobytes() for c in cut], pa.binary())],
                ["bucket", "block", "keys", "uses"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def answer() -> pa.RecordBatch:
            every = np.frombuffer(b"".join(h["keys"] for h in held), f"S{width}")
            told = judge(every, np.frombuffer(b"".join(h["uses"] for h in held), np.uint8)).astype(np.int64)
            cut = np.split(told, np.cumsum([len(h["uses"]) for h in held])[:-1])
            return pa.RecordBatch.from_arrays(
                [pa.array([h["block"] for h in held], pa.int64()), pa.array([held[0]["bucket"]] * len(held), pa.int64()), pa.array([(c | held[0]["bucket"] << 32).tobytes() for c in cut], pa.binary())],
                ["block", "bucket", "answers"],
            )

        for row in _rows(batches):
            if held and held[0]["bucket"] != row["bucket"]:
                yield answer()
                held = []
            held.append(row)
        if held:
            yield answer()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def told() -> Iterator[pa.RecordBatch]:
            row = next(h for h in held if h["bucket"] < 0)
            distinct, bucket, _, inverse = _distinct(row, keys, buckets)
            numbers = np.zeros(len(distinct), np.int64)
            for h in held:
                if h["bucket"] >= 0:
                    numbers[bucket == h["bucket"]] = np.frombuffer(h["answers"], np.int64)
            return back(row, numbers[inverse])

        for row in _rows(batches):
            if held and held[0]["block"] != row["block"]:
                yield from told()
                held = []
            held.append(row)
        if held:
            yield from told()

    answers = table.mapInArrow(send, "bucket long, block long, keys binary, uses binary").repartition("bucket").sortWithinPartitions("bucket", "block")
    answers = answers.mapInArrow(meet, "block long, bucket long, answers binary")
    both = table.withColumn("bucket", F.lit(-1).cast("long")).withColumn("answers", F.lit(None).cast("binary")).unionByName(answers, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(fetch, kinds)


def _order(keys: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """The name of each key: its place in the order of the bucket's distinct keys."""
    return np.unique(keys, return_inverse=True)[1]


def _named(row: dict, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    values = [row[f] for f in _FIELDS[:-1]] + [numbers.tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], _FIELDS)


def _adjacent(keys: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """By record the shifts, as bits, for which an adjacent record has the same ``LENGTH`` bytes."""
    rows = keys.view(np.uint8).reshape(len(keys), -1)
    names, rest, left = rows[:, :16], rows[:, 16 : 16 + REST], rows[:, 16 + REST : 16 + REST + PERIOD - 1]
    least, most = rows[:, -2], rows[:, -1]
    by = np.random.default_rng(8).integers(0, 1 << 63, 16 + REST + PERIOD, np.uint64) * np.uint64(2) + np.uint64(1)
    whole = (names * by[:16]).sum(1, dtype=np.uint64)
    behind = np.concatenate([np.zeros((len(keys), 1), np.uint64), np.cumsum((rest + np.uint64(1)) * by[16 : 16 + REST], axis=1)], axis=1)
    before = np.concatenate([np.zeros((len(keys), 1), np.uint64), np.cumsum((left + np.uint64(1)) * by[16 + REST : -1], axis=1)], axis=1)
    out = np.zeros(len(keys), np.int64)
    for t in range(PERIOD):
        some = np.flatnonzero((least <= t) & (t <= most))
        if not len(some):
            continue
        # Sorted by a hash of the prefix; what is adjacent is compared byte by byte.
        some = some[np.argsort(mixed(whole[some] + behind[some, REST - t] + before[some, t]))]
        a, b = some[:-1], some[1:]
        same = (names[a] == names[b]).all(1) & (rest[a, : REST - t] == rest[b, : REST - t]).all(1) & (left[a, :t] == left[b, :t]).all(1)
        bit = np.int64(1 << t)
        out[a[same]] |= bit
        out[b[same]] |= bit
        out[some[uses[some] > 1]] |= bit
    return out


def _repeats(row: dict, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``ka, kb, start, size``: the windows of a block that repeat, neighbours together."""
    s = Strings(row)
    at, hit = _shifted(s), np.zeros(len(s.raw), bool)
    for t in range(PERIOD):
        hit[at[(numbers >> t & 1) > 0] - t] = True
    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    if len(begin):
        # A run of windows ends where its string does, as no window begins in a string's last bytes.
        of = s.owner[begin]
        ka, kb, start = (np.array(row[f], np.int64)[of] for f in ("ka", "kb", "start"))
        cols = [ka, kb, (start + s.place[begin]).astype(np.int32), (end - begin).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["ka", "kb", "start", "size"])


def decided(strings: DataFrame) -> DataFrame:
    """``ka, kb, start, size``: windows of the blocks' strings that some other window equals."""
    size = strings.agg(F.sum(F.length("data"))).first()[0] or 0
    sample = size * len(COVER) // PERIOD
    buckets = lambda width: max(16, -(-sample * width // BUCKET))
    first = staged(round_trip(strings, _first_triples, buckets(FIRST), _order, FIRST, _named, _BLOCK), "triples")
    second = staged(round_trip(first, _name_triples, buckets(24), _order, 24, _named, _BLOCK), "names")
    release(first)
    width = 16 + REST + PERIOD - 1 + 2
    out = staged(round_trip(second, _records, buckets(width), _adjacent, width, _repeats, "ka long, kb long, start int, size int"), "decided")
    release(second)
    return out


# --- the operator -----------------------------------------------------------


def repeated(docs: DataFrame) -> DataFrame:
    """``ka, kb, start, size``: what windows start at places ``start`` to ``start + size - 1`` of a ``keyed`` text and repeat."""
    found = staged(phrases(docs), "phrases-found")
    copies, asked = repeated_phrases(found)
    release(found)
    strings = blocks(docs, asked)
    out = staged(copies.unionByName(decided(strings)), "repeated")
    release(copies, asked, strings)
    return out


def cut(text: bytes, start: np.ndarray, size: np.ndarray) -> tuple[bytes, int]:
    """What is left of a text without the bytes of windows, and the number of runs taken out."""
    begin, end = _merged(start, size + LENGTH - 1)
    edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(begin)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans``: what is left of each text, in bytes, as a cut may part a character."""
    return _cut(docs, False)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row for each of ``docs``."""
    return _cut(docs, True)


def _cut(docs: DataFrame, hashed: bool) -> DataFrame:
    """The bytes that stay, or their hash; texts that the filter of texts with repeats lets pass are not shuffled."""
    rows = keyed(docs)
    spans = repeated(rows).groupBy("ka", "kb").agg(F.collect_list("start").alias("start"), F.collect_list("size").alias("size"))
    spans = staged(spans, "spans")
    some = member_test(spans, "ka")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, start, size in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), batch.column(3), strict=True):
                whole = text.as_py()
                kept, n = cut(whole, np.array(start.as_py()), np.array(size.as_py())) if start.is_valid else (whole, 0)
                out.append((hashlib.sha256(kept).hexdigest() if hashed else kept, len(whole), len(whole) - len(kept), n))
            kept, n_bytes, n_removed, n_spans = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string() if hashed else pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", name])
            give_back()

    name = "kept_sha256" if hashed else "kept"
    whole = rows.filter(~some(F.col("ka"))).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), (F.sha2("text", 256) if hashed else F.col("text").cast("binary")).alias(name))
    met = rows.filter(some(F.col("ka"))).join(spans, ["ka", "kb"], "left").select("doc_id", "text", "start", "size")
    return whole.unionByName(met.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} {'string' if hashed else 'binary'}"))
