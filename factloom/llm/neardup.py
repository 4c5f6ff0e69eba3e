"""Operator 2: near-duplicate detection by weighted MinHash.

Words are what white space separates, in lower case; shingles are five
consecutive words (all words of a shorter text), kept as 32-bit hashes with
their counts.  A shingle weighs its count times a damped inverse document
frequency, which lies between ``1 - DAMPING`` for shingles that all documents
share and 1 for those that at most ``RARE`` of them have.  Document frequencies
cover all rows; they are counted in a Count-Min sketch of fixed size, whose
noise, in proportion to the corpus like ``RARE``, is taken off.

Improved consistent weighted sampling draws ``BANDS * ROWS`` shingles from each
document; the chance that two documents draw the same is their weighted Jaccard
similarity.  Documents that agree on a whole band are candidates.  They are
verified by the weighted Jaccard similarity of their whole shingle sets;
components of what passes are the classes.  Pairs that verified ones connect
anyway need no comparing, so there are two passes.  The first pairs each member
of a bucket with the smallest and with its neighbours by signature, in another
order of draws for each band.  The second compares every member outside its
bucket's largest component with all members of other components, in blocks
inside of tasks: those that agree in enough draws by their whole sets, each
pair in the first band that it shares.  Only similar pairs leave a task, and
none that could pass is left out.

Exact copies are one node each.  A bucket that many documents share is counted
before the shuffle, split by Spark when it is joined, and dealt by a hash for
the neighbours.

Rows: null and empty texts are one class, as copies of each other.  A null
``doc_id`` joins no class.  A ``doc_id`` that repeats stands for one document,
whose texts are classed together.  No rows: no rows.  Other columns are kept by
:func:`without_near_copies`.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.bloom import member_test, rows_that_stay
from factloom.llm.bpe import in_batches, narrow
from factloom.llm.spans import SpanHasher, give_back, mixed
from factloom.plans.staging import release, staged

#: Words of a shingle; least weighted Jaccard similarity.
WORDS, SIMILAR = 5, 0.8
#: A pair of similarity 0.8 shares a band with probability 0.99997.
BANDS, ROWS = 20, 4
DRAWS = BANDS * ROWS
#: Share of draws under which a pair is not verified: four deviations below 0.8.
PRUNED = 0.62
#: Most that the weight of a common shingle is lowered by, and the share of documents up to which it is rare.
DAMPING, RARE, LEVELS = 0.25, 0.005, 8
#: Count-Min sketch: rows and counters of a row.
SKETCH_ROWS, SKETCH_BITS = 3, 18
#: Entries of the table that random draws come from.
DRAW_BITS = 16
#: Members of a bucket that one window sorts, and of a side of a block of comparisons, about.
SALT_ROWS = 500
#: Bytes of shingle sets on a side of a block, about.
BLOCK_BYTES = 4_000_000
#: Share of all nodes beyond which a bucket is dealt to several tasks, and how many these are at most.
HOT, MOST_SALTS = 0.001, 1024
#: Members up to which the first pass has compared all pairs of a bucket.
ALL_PAIRED = 3

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


# --- shingles ---------------------------------------------------------------


@lru_cache(maxsize=1)
def _hasher() -> SpanHasher:
    return SpanHasher()


def shingles(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingle hashes, ascending, and how often each occurs."""
    lowered = [t.lower().encode() + b" " for t in texts]
    raw = np.frombuffer(b"".join(lowered), np.uint8)
    space = _SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=1)
    at, until = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = np.cumsum([len(b) for b in lowered])
    owner = np.searchsorted(ends, at, "right")
    words = _hasher()(raw, at, until)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    # Shingles start at all but the last four words of a text, or at its first.
    number = np.where(count >= WORDS, count - WORDS + 1, (count > 0).astype(np.int64))
    whose = np.repeat(np.arange(len(texts)), number)
    start = np.arange(len(whose)) - np.repeat(np.cumsum(number) - number, number) + first[whose]
    summed = np.zeros(len(whose), np.uint64)
    for k, by in enumerate(_odd(WORDS, 1)):
        inside = start + k < first[whose] + count[whose]
        summed[inside] += words[start[inside] + k] * by
    keys, times = np.unique(whose.astype(np.uint64) << np.uint64(32) | mixed(summed) >> np.uint64(32), return_counts=True)
    cut = np.searchsorted(keys >> np.uint64(32), np.arange(1, len(texts)).astype(np.uint64))
    return list(zip(np.split(keys.astype(np.uint32), cut), np.split(times.astype(np.uint32), cut), strict=True))


_RUNS = re.compile(r"[ \t-\r]+")


def shingled(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, hashes, counts``: a text's identity and its shingles; ``counts`` is empty where all are 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_batches(batches):
            found = shingles(texts)
            digests = [hashlib.blake2b(_RUNS.sub(" ", t).strip(" ").encode(), digest_size=16).digest() for t in texts]
            blobs = [h.astype("<u4").tobytes() for h, _ in found]
            counts = [b"" if (c == 1).all() else c.astype("<u4").tobytes() for _, c in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "digest", "hashes", "counts"])

    return narrow(docs).mapInArrow(run, "doc_id long, digest binary, hashes binary, counts binary")


# --- document frequencies ---------------------------------------------------


def _cells(hashes: np.ndarray) -> np.ndarray:
    """The counters of shingles, a row for each row of the sketch."""
    return np.stack([(hashes.astype(np.uint64) * m >> np.uint64(20)) & np.uint64((1 << SKETCH_BITS) - 1) for m in _odd(SKETCH_ROWS, 2)]).astype(np.int64)


def frequency_levels(table: DataFrame) -> np.ndarray:
    """By counter the level of inverse document frequency, 0 (in all documents) to LEVELS - 1 (rare)."""
    width, blocks, shares = 1 << SKETCH_BITS, 4, 8
    size = width // blocks

    def packed(counts: np.ndarray) -> bytes:
        return zlib.compress(counts.astype("<i8").tobytes(), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((SKETCH_ROWS, width), np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                blobs = batch.column(0).slice(start, 500).to_pylist()
                rows += sum(map(bool, blobs))
                cells = _cells(np.frombuffer(b"".join(blobs), "<u4"))
                for k in range(SKETCH_ROWS):
                    counts[k] += np.bincount(cells[k], minlength=width)
            give_back()
        share = TaskContext.get().partitionId() % shares
        if rows:
            out = [(k * blocks + b, packed(counts[k, b * size : (b + 1) * size])) for k in range(SKETCH_ROWS) for b in range(blocks)]
            out.append((SKETCH_ROWS * blocks, packed(np.array([rows]))))
            yield _blocks(out, share)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                counts = np.frombuffer(zlib.decompress(blob.as_py()), "<i8")
                held[k] = held[k] + counts if k in held else counts
        if held:
            yield _blocks([(k, packed(c)) for k, c in held.items()], 0)

    def _blocks(rows: list[tuple[int, bytes]], share: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([share] * len(rows), pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["block", "share", "counts"])

    kinds = "block int, share int, counts binary"
    parts = table.select("hashes").mapInArrow(count, kinds).repartition("block", "share").mapInArrow(add, kinds).repartition("block").mapInArrow(add, kinds)
    got = {r["block"]: np.frombuffer(zlib.decompress(bytes(r["counts"])), "<i8") for r in parts.select("block", "counts").collect()}  # of fixed size
    if not got:
        return np.full((SKETCH_ROWS, width), LEVELS - 1, np.uint8)
    rows = max(1, int(got.pop(SKETCH_ROWS * blocks)[0]))
    counts = np.concatenate([got[k] for k in sorted(got)]).reshape(SKETCH_ROWS, width).astype(float)
    noise = (counts.sum(1, keepdims=True) - counts) / (width - 1)
    share = np.maximum(counts - noise, 1) / rows
    rarity = np.clip(np.log(1 / np.minimum(share, 1)) / np.log(1 / RARE), 0, 1)
    return np.round(rarity * (LEVELS - 1)).astype(np.uint8)


def _rarity(levels: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The weight of one occurrence; the least frequent of a shingle's counters tells."""
    cells = _cells(hashes)
    level = reduce(np.maximum, (levels[k][cells[k]] for k in range(SKETCH_ROWS)))
    return 1 - DAMPING + DAMPING * level / (LEVELS - 1)


def _weights(levels: np.ndarray, hashes: np.ndarray, counts: bytes) -> np.ndarray:
    rarity = _rarity(levels, hashes)
    return rarity * np.frombuffer(counts, "<u4") if counts else rarity


def similarity(levels: np.ndarray, a: bytes, a_counts: bytes, b: bytes, b_counts: bytes) -> float:
    """Weighted Jaccard similarity of two whole shingle sets."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    wx, wy = _weights(levels, x, a_counts), _weights(levels, y, b_counts)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = float(np.minimum(wx[i], wy[j]).sum())
    union = float(wx.sum() + wy.sum()) - both
    return both / union if union else 1.0


# --- consistent weighted sampling -------------------------------------------


class Sampler:
    """Draws from weighted sets, the same for equal members and weights.

    For a member of weight S with random r, c (Gamma 2, 1) and b (uniform),
    t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1); the member of
    least a is drawn, as the pair of member and t.  The random numbers of a
    member are an entry of one table, at a place that each draw hashes anew.
    """

    def __init__(self) -> None:
        rng, n = np.random.default_rng(3), 1 << DRAW_BITS
        self.r, self.c, self.b = rng.gamma(2, 1, n), np.log(rng.gamma(2, 1, n)), rng.random(n)
        self.by, self.name = _odd(DRAWS, 4), _odd(DRAWS, 5)
        self.shift = np.uint64(64 - DRAW_BITS)
        self.tables: dict[float, np.ndarray] = {}

    def _values(self, weight: float) -> np.ndarray:
        if weight not in self.tables:
            if len(self.tables) > 64:
                self.tables.clear()
            t = np.floor(np.log(weight) / self.r + self.b)
            self.tables[weight] = (self.c - self.r * (t - self.b + 1)).astype(np.float32)
        return self.tables[weight]

    def __call__(self, hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Names of what each set draws: sets lie one after the other, none is empty."""
        wide = mixed(hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        kinds, kind = np.unique(weights, return_inverse=True)
        table = np.concatenate([self._values(float(w)) for w in kinds])
        base = kind.astype(np.int64) << DRAW_BITS
        ends = np.cumsum(counts)
        starts = ends - counts
        out = np.empty((len(counts), DRAWS), np.uint64)
        for d in range(DRAWS):
            place = ((wide * self.by[d]) >> self.shift).astype(np.int64)
            a = table[base + place]
            least = np.minimum.reduceat(a, starts)
            hits = np.flatnonzero(a == np.repeat(least, counts))
            drawn = hits[np.searchsorted(hits, starts)]
            at = place[drawn]
            t = np.floor(np.log(weights[drawn]) / self.r[at] + self.b[at]).astype(np.int64).astype(np.uint64)
            out[:, d] = mixed((wide[drawn] + t * np.uint64(0xD6E8FEB86659FD93)) * self.name[d])
        return out


@lru_cache(maxsize=1)
def _sampler() -> Sampler:
    return Sampler()


def signed(table: DataFrame, levels: np.ndarray) -> DataFrame:
    """``doc_id, digest, signature, bands, bytes`` of texts that have words; ``signature`` has a byte for each draw, ``bytes`` tells the size of the set."""
    sent = table.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, by = _sampler(), _odd(ROWS, 6)
        for batch in batches:
            ids, digests, blobs, counts = (c.to_pylist() for c in batch.columns)
            take = [k for k, b in enumerate(blobs) if b]
            while take:
                some, size = [], 0
                while take and size < 500_000:
                    some.append(take.pop())
                    size += len(blobs[some[-1]])
                sets = [np.frombuffer(blobs[k], "<u4") for k in some]
                rarity = _rarity(sent.value, np.concatenate(sets))
                times = np.concatenate([np.frombuffer(counts[k], "<u4") if counts[k] else np.ones(len(s), np.uint32) for k, s in zip(some, sets, strict=True)])
                draws = sampler(np.concatenate(sets), rarity * times, np.array([len(s) for s in sets]))
                bands = mixed((draws.reshape(len(some), BANDS, ROWS) * by).sum(2) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
                short = (draws >> np.uint64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in some], pa.int64()), pa.array([digests[k] for k in some], pa.binary()), pa.array([s.tobytes() for s in short], pa.binary()), pa.array(list(bands), pa.list_(pa.int64())), pa.array([len(blobs[k]) for k in some], pa.int64())],
                    ["doc_id", "digest", "signature", "bands", "bytes"],
                )
            give_back()

    return table.mapInArrow(run, "doc_id long, digest binary, signature binary, bands array<long>, bytes long")


# --- candidates and classes -------------------------------------------------


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``a < b`` of nodes to verify first, from the bands of ``nodes``; ``key, band, node, bytes`` of buckets with other pairs.

    A bucket that holds more than ``HOT`` of all nodes is dealt to several
    tasks, by a salt that its members hash to and that its own row is repeated
    for.  There are at most ``BANDS / HOT`` such buckets.
    """
    keys = nodes.select("node", "bytes", F.posexplode("bands").alias("band", "key"))
    buckets = staged(keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    hot_rows = max(SALT_ROWS, HOT * nodes.count())
    hot = buckets.filter(F.col("n") > hot_rows)
    hot_keys, most = (lambda r: (r["keys"], r["most"] or 0))(hot.agg(F.collect_set("key").alias("keys"), F.max("n").alias("most")).first())
    salts = max(1, min(MOST_SALTS, -(-most // SALT_ROWS)))
    salted = lambda yes, no: F.when(F.col("key").isin(hot_keys), yes).otherwise(no) if hot_keys else no
    # Most keys are of one document alone; a filter keeps them out of the join's shuffle.
    shared = nodes.select("node", "signature", F.posexplode("bands").alias("band", "key")).filter(member_test(buckets, "key")(F.col("key")))
    shared = shared.withColumn("salt", salted(F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(salts)).cast("int"), F.lit(0)))
    spread = buckets.withColumn("salt", F.explode(salted(F.sequence(F.lit(0), F.lit(salts - 1)), F.array(F.lit(0)))))
    met = shared.join(spread, ["key", "salt"])
    star = met.select(F.col("least").alias("a"), F.col("node").alias("b"))
    # Neighbours by signature from the draws after the band's own, in parts of some hundred members of a bucket.
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / salted(F.lit(salts * SALT_ROWS), F.lit(SALT_ROWS))))
    start = (F.col("band") + 1) * ROWS
    turned = F.concat(F.substring("signature", start + 1, F.lit(DRAWS)), F.substring("signature", F.lit(1), start))
    window = Window.partitionBy("key", "salt", "part").orderBy("turned", "node")
    near = met.filter("n > 2").withColumn("part", part).withColumn("turned", turned)
    near = near.select("node", *[F.lag("node", k).over(window).alias(f"lag{k}") for k in (1, 2)])
    near = near.select(F.explode(F.array("lag1", "lag2")).alias("x"), "node").filter("x is not null").select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))
    large = staged(buckets.filter(F.col("n") > ALL_PAIRED).select("key"), "large")
    crowds = staged(keys.filter(member_test(large, "key")(F.col("key"))).join(large, "key").select("key", "band", "node", "bytes"), "crowds")
    pairs = staged(star.unionByName(near).filter("a < b").distinct(), "pairs")
    release(buckets, large)
    return pairs, crowds


def unconnected(crowds: DataFrame, nodes: DataFrame, labels: DataFrame, sets: DataFrame, levels: np.ndarray) -> DataFrame:
    """``a < b``: similar pairs of a bucket's members in different components, each compared in the first band that it shares.

    Those outside a bucket's largest component meet all members of other
    components, in blocks of bounded size, each in one task.  What agrees in
    too few draws is left out; all else is compared by whole sets there, so
    only similar pairs leave a task.
    """
    # A node has a label if an edge or a repeated id reaches it.
    member = crowds.join(labels, "node", "left").select("key", "band", "node", "bytes", F.coalesce("label", "node").alias("label"))
    sizes = member.groupBy("key", "label").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
    heads = sizes.groupBy("key").agg(F.max_by("label", "size").alias("main"), F.sum("size").alias("n"), F.max("size").alias("most"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts")).filter("parts > 1")
    blocks_of = lambda n: F.greatest(F.lit(1), F.ceil(n / SALT_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    heads = staged(heads.select("key", "main", blocks_of(F.col("n")).alias("wide"), blocks_of(F.col("n") - F.col("most")).alias("high")), "open")
    opened = staged(member.filter(member_test(heads, "key")(F.col("key"))).join(heads, "key").drop("bytes"), "opened")
    used = staged(opened.select("node").distinct(), "opened-nodes")
    needed = member_test(used, "node")
    drawn = nodes.filter(needed(F.col("node"))).select("node", "digest", "signature", "bands")
    drawn = staged(drawn.join(sets.filter(needed(F.col("node"))).select("node", "digest", "hashes", "counts").dropDuplicates(["node", "digest"]), ["node", "digest"]).drop("digest"), "drawn")
    rows = opened.join(drawn, "node")
    # Blocks of a bucket: those outside its largest component, by ``i``, against all members, by ``j``.
    hashed = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ["node", "label", "signature", "bands", "hashes", "counts"]
    left = rows.filter("label <> main").select("key", "band", hashed(1, "high").alias("i"), every("wide").alias("j"), F.lit(True).alias("out"), *fields)
    right = rows.select("key", "band", every("high").alias("i"), hashed(2, "wide").alias("j"), F.lit(False).alias("out"), *fields)
    blocks = left.unionByName(right).groupBy("key", "band", "i", "j").agg(F.collect_list(F.struct("out", *fields)).alias("members"))
    sent = nodes.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = _similar_in(batch.column(1)[k].values, batch.column(0)[k].as_py(), sent.value)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])
            give_back()

    return staged(blocks.select("band", "members").mapInArrow(run, "a long, b long").distinct(), "edges")


def _similar_in(held: pa.StructArray, band: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs of one block, in different components, that share no band before this one."""
    out = held.field("out").to_numpy(zero_copy_only=False)
    node, label = (held.field(n).to_numpy(zero_copy_only=False) for n in ("node", "label"))
    draws = np.frombuffer(b"".join(held.field("signature").to_pylist()), np.uint8).reshape(-1, DRAWS)
    bands = held.field("bands").flatten().to_numpy().reshape(-1, BANDS)
    x, y = np.flatnonzero(out), np.flatnonzero(~out)
    if not len(x) or not len(y):
        return node[:0], node[:0]
    sets = [np.frombuffer(h, "<u4") for h in held.field("hashes").to_pylist()]
    weights = [_weights(levels, s, c) for s, c in zip(sets, held.field("counts").to_pylist(), strict=True)]
    whole = np.array([w.sum() for w in weights])
    names, number = np.unique(np.concatenate(sets), return_inverse=True)
    places = np.split(number, np.cumsum([len(s) for s in sets])[:-1])
    own, found = np.zeros(len(names)), ([], [])
    for i in x.tolist():
        near = y[((draws[i] == draws[y]).sum(1) >= PRUNED * DRAWS) & (label[y] != label[i])]
        if len(near):
            shared = bands[near] == bands[i]
            near = near[shared[:, band] & (shared.argmax(1) == band)]
        if not len(near):
            continue
        own[places[i]] = weights[i]
        counts = np.array([len(sets[j]) for j in near])
        least = np.minimum(own[np.concatenate([places[j] for j in near])], np.concatenate([weights[j] for j in near]))
        both = np.add.reduceat(least, np.cumsum(counts) - counts)
        own[places[i]] = 0
        like = near[both >= SIMILAR * (whole[i] + whole[near] - both) - 1e-12]
        found[0].extend([node[i]] * len(like))
        found[1].extend(node[like].tolist())
    return np.array(found[0], np.int64), np.array(found[1], np.int64)


def verified(pairs: DataFrame, nodes: DataFrame, table: DataFrame, levels: np.ndarray) -> DataFrame:
    """The pairs whose similarity is at least ``SIMILAR``, first by their draws, then by their whole sets."""
    sent = table.sparkSession.sparkContext.broadcast(levels)
    side = lambda t, name, cols: t.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])

    @F.pandas_udf("boolean")
    def agree(x, y):  # noqa: ANN001, ANN202
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), DRAWS) for v in (x, y))
        return pd.Series((a == b).mean(1) >= PRUNED)

    likely = pairs.join(side(nodes, "a", ["signature"]), "a").join(side(nodes, "b", ["signature"]), "b").filter(agree("a_signature", "b_signature")).select("a", "b")
    likely = staged(likely, "likely")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            keep = [similarity(sent.value, *(columns[c][k].as_py() for c in ("a_hashes", "a_counts", "b_hashes", "b_counts"))) >= SIMILAR for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([columns[c].filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])
            del columns, batch
            give_back()

    # Only sets that some pair needs are shuffled, and the few that the filter mistakes for them.
    used = staged(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "used")
    sets = table.filter(member_test(used, "node")(F.col("node"))).select("node", "hashes", "counts")
    sets = staged(sets.join(used, "node", "left_semi"), "sets")
    joined = likely.join(side(sets, "a", ["hashes", "counts"]), "a").join(side(sets, "b", ["hashes", "counts"]), "b")
    edges = staged(joined.mapInArrow(run, "a long, b long"), "edges")
    release(sets, used, likely)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of an edge is connected with.

    Labels go to neighbours and then to the label's own label, so paths halve;
    each round is a written table, and rounds end when nothing changes.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "both-ways")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        next_ = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        next_ = staged(next_, "labels")
        roots = next_.select(F.col("node").alias("root"), F.col("label").alias("root_label"))
        jumped = staged(next_.join(roots, next_.label == roots.root, "left").select("node", "old", F.least("label", F.coalesce("root_label", "label")).alias("label")), "labels")
        changed = jumped.filter("old <> label").limit(1).count()
        release(next_, labels)
        labels = jumped
        if not changed:
            release(both)
            return labels.select("node", "label")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, kept``: the smallest ``doc_id`` of a document's class, one row for each of ``docs``."""
    table = staged(shingled(docs), "shingles")
    levels = frequency_levels(table)
    sign = staged(signed(table.filter("doc_id is not null"), levels), "signatures")
    exact = staged(table.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node")), "copies")
    # One node for each distinct text: rows of the copy with the smallest id.
    nodes = sign.join(exact, "digest").filter("doc_id = node").select("node", "digest", "signature", "bands", "bytes").dropDuplicates(["node", "digest"])
    nodes = staged(nodes, "nodes")
    release(sign)
    named = table.filter("doc_id is not null")
    copies = named.select("doc_id", "digest").join(exact, "digest").select("doc_id", "node")
    linked = staged(copies, "linked")
    # Repeated ids hold the classes of their texts together.
    several = linked.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("c")).filter("b <> c").select("doc_id", "b")
    edges = staged(linked.join(several, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), "repeats")
    sets = named.withColumnRenamed("doc_id", "node")
    pairs, crowds = candidates(nodes)
    edges = edges.unionByName(verified(pairs, nodes, sets, levels))
    labels = components(edges)
    more = unconnected(crowds, nodes, labels, sets, levels)
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    release(pairs, crowds, nodes, exact)
    placed = linked.join(labels, linked.node == labels.node, "left").select("doc_id", F.coalesce("label", linked.node).alias("class_id"))
    lone = table.filter("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return placed.unionByName(lone).select("doc_id", "class_id", (F.col("class_id").isNull() | (F.col("doc_id") == F.col("class_id"))).alias("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class, with all columns, and rows without an id.

    Rows that repeat an id which stays all stay: they are one document here.
    """
    found = staged(classes(docs), "classes")
    return rows_that_stay(docs, found.select("doc_id", F.col("kept").alias("stays")))
