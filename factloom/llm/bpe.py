"""Operator 8: byte-level BPE encoding and decoding by speculation and check.

Greedy longest match proposes tokens for each distinct word.  A word's proposal
is right exactly when every adjacent pair of its tokens is compatible, that is,
when merging by rank never joins symbols across the border of the pair.  The
check runs over all pairs of a batch at once in numpy.  Only words that fail it
are merged step by step.

Rows: a null text counts as empty; an empty text has no tokens.  Repeated rows
are encoded once each.  Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.spans import SpanHasher, give_back

ENDLESS = np.int64(1) << 40
#: Distinct words that a worker remembers before it starts anew.
REMEMBERED = 150_000
#: Longest word that is remembered, in bytes.
LONG = 64
#: Characters that are encoded together.
BATCH_CHARS = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The printable character by which such files write each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Lookup:
    """A map from int64 to int64 that looks up and adds whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int, room: int = 0) -> None:
        bits = max(10, int(max(len(keys), room) * 3).bit_length())
        self.shift, self.mask, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, missing, np.int64)
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys, none below 0, that the map lacks."""
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + ~free[~put]) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], self.missing)
        live = np.flatnonzero((found != keys) & (found >= 0))
        slot = slot[live]
        while len(live):
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == keys[live]
            out[live[hit]] = self.values[slot[hit]]
            go = ~hit & (found >= 0)
            live, slot = live[go], slot[go]
        return out


class Vocabulary:
    """Tokens, merges and the tests on them, from a tokenizer's JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            loaded = json.load(file)
        symbols, model = _byte_symbols(), loaded["model"]
        ids = model["vocab"]
        self.size = max([*ids.values(), *(t["id"] for t in loaded["added_tokens"])]) + 1
        self.specials = {t["content"]: t["id"] for t in loaded["added_tokens"]}
        self.token: list[bytes] = [b""] * self.size
        for text, i in ids.items():
            self.token[i] = bytes(symbols[c] for c in text)
        for text, i in self.specials.items():
            self.token[i] = text.encode()
        self.byte_id = np.zeros(256, np.int64)
        for text, i in ids.items():
            if len(text) == 1:
                self.byte_id[symbols[text]] = i
        # The rank of a token is the place of the merge that makes it; bytes have none.
        self.rank = np.full(self.size, -1, np.int64)
        self.left = np.zeros(self.size, np.int64)
        self.right = np.zeros(self.size, np.int64)
        self.merge: dict[int, tuple[int, int]] = {}
        for place, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, made = ids[a], ids[b], ids[a + b]
            self.rank[made], self.left[made], self.right[made] = place, x, y
            self.merge[x << 20 | y] = (place, made)
        pairs, places = np.array(list(self.merge), np.int64), np.array([m[0] for m in self.merge.values()], np.int64)
        self.pair_rank = Lookup(pairs, places, int(ENDLESS))
        self.made = np.array([m[1] for m in self.merge.values()], np.int64)
        # A token is proposed only if its own bytes merge to it.
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(self.size, bool)
        sound[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])].tolist():
            sound[i] &= sound[self.left[i]] and sound[self.right[i]]
        self._grow_trie([i for i in ids.values() if sound[i]])
        lengths = np.array([len(t) for t in self.token], np.int64)
        self.token_length = lengths
        self.token_start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border between tokens a and b.

        The last merge inside the two tokens is undone step by step.  The
        symbols then beside the border lived until that merge, so a merge of
        them with a lower rank would have come first; with an equal rank it
        comes first if it lies further left, which it does when the undone
        merge is on the right.  ``before`` ends the life of the tokens.
        """
        fine = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        until = np.full(len(a), ENDLESS) if before is None else before.astype(np.int64)
        tied = np.zeros(len(a), bool)
        while len(live):
            joins = self.pair_rank(a << 20 | b)
            crossed = (joins < until) | (tied & (joins == until))
            fine[live[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            tied = rb >= ra
            until = np.where(tied, rb, ra)
            a, b = np.where(tied, a, self.right[a]), np.where(tied, self.left[b], b)
        return fine

    def _grow_trie(self, proposed: list[int]) -> None:
        """States are prefixes of tokens; a state that is a token has its id."""
        states: dict[bytes, int] = {b"": 0}
        for i in proposed:
            t = self.token[i]
            for n in range(1, len(t) + 1):
                states.setdefault(t[:n], len(states))
        self.state_token = np.full(len(states), -1, np.int64)
        for i in proposed:
            self.state_token[states[self.token[i]]] = i
        steps = [(states[s[:-1]] << 8 | s[-1], k) for s, k in states.items() if s]
        self.step = Lookup(np.array([s for s, _ in steps], np.int64), np.array([k for _, k in steps], np.int64), -1)

    def propose(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over all words at once: their tokens, and the word of each.

        ``flat`` holds the bytes of all words.  In each round every unfinished
        word walks the trie from its place as far as it goes and takes the
        longest token that it passed; every byte is a token, so it always ends.
        """
        words, at = np.arange(len(starts)), starts.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        go = at < ends
        words, at, ends = words[go], at[go], ends[go]
        while len(words):
            token, state = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
            live, place = np.arange(len(at)), at.copy()
            while len(live):
                state = self.step(state << 8 | flat[place])
                on = state >= 0
                live, place, state = live[on], place[on] + 1, state[on]
                passed = self.state_token[state]
                token[live[passed >= 0]] = passed[passed >= 0]
                on = place < ends[live]
                live, place, state = live[on], place[on], state[on]
            found.append((words, token))
            at = at + self.token_length[token]
            go = at < ends
            words, at, ends = words[go], at[go], ends[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner, tokens = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(owner, kind="stable")
        return tokens[order], owner[order]

    def merged_together(self, table: np.ndarray) -> np.ndarray:
        """Exact merging of many short words: rows of byte ids, padded with -1.

        Each round merges in every row the pair of lowest rank, leftmost first.
        """
        ids, out, rows = table.copy(), np.full_like(table, -1), np.arange(len(table))
        width = ids.shape[1]
        cols = np.arange(width)
        rank = np.full(ids.shape, ENDLESS)
        both = ids[:, 1:] >= 0
        rank[:, :-1][both] = self.pair_rank((ids[:, :-1] << 20 | ids[:, 1:])[both])
        while len(rows):
            at = rank.argmin(axis=1)
            n = np.arange(len(rows))
            best = rank[n, at]
            done = best >= ENDLESS
            if done.any():
                out[rows[done]] = ids[done]
                rows, ids, rank, at, best = rows[~done], ids[~done], rank[~done], at[~done], best[~done]
                n = np.arange(len(rows))
            if not len(rows):
                break
            ids[n, at] = self.made[best]
            take = np.minimum(cols + (cols > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, np.minimum(cols + (cols >= at[:, None]), width - 1), 1)
            ids[:, -1], rank[:, -1] = -1, ENDLESS
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < width)
                x, y = ids[n[ok], left[ok]], ids[n[ok], left[ok] + 1]
                rank[n[ok], left[ok]] = np.where(y >= 0, self.pair_rank(x << 20 | np.maximum(y, 0)), ENDLESS)
        return out

    def merged(self, word: np.ndarray) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals first."""
        ids = self.byte_id[word].tolist()
        n, merge = len(ids), self.merge
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := merge.get(ids[i] << 20 | ids[i + 1]):
                heap.append((found[0], i, found[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, made, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                ahead[after[j]] = i
            for left in (ahead[i], i):
                if left >= 0 and (right := after[left]) < n:
                    if found := merge.get(ids[left] << 20 | ids[right]):
                        heapq.heappush(heap, (found[0], left, found[1], ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 are replaced."""
        lengths = self.token_length[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ids) else 0
        take = np.arange(total) + np.repeat(self.token_start[ids] - ends + lengths, lengths)
        return self.token_bytes[take].tobytes().decode("utf-8", "replace")


class Encoder:
    """Encodes whole texts and remembers the words it has met, within a bound."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        specials = self.vocabulary.specials
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.kind = _kinds()
        self.hashed = SpanHasher()
        self.failed = 0
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.known = Lookup(none, none, -1, REMEMBERED)
        self.flat, self.used = np.zeros(REMEMBERED * 2, np.uint32), 0
        self.start, self.count, self.words = np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, np.int64), 0

    def cuts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pre-tokens start, for texts joined to one array of code points.

        A run of characters of one kind is a pre-token, with one space before
        it.  Of a longer run of white space, the last character stands alone or
        joins what follows; at the end of a text the run stays whole.
        """
        kind, n = self.kind[points], len(points)
        first = np.zeros(n + 1, bool)
        first[begins] = True
        first[n] = True
        white = kind == 0
        before = np.concatenate([[False], white[:-1]])
        changes = np.ones(n, bool)
        changes[1:] = kind[1:] != kind[:-1]
        joined = np.zeros(n, bool)
        joined[1:] = points[:-1] == 32
        follows = np.zeros(n, bool)
        follows[:-1] = ~white[1:]
        follows &= ~first[1:]
        start = first[:-1] | np.where(white, ~before | follows, np.where(before, ~joined, changes))
        # Fixed value: the endings that such vocabularies cut off after an apostrophe.
        marks = np.flatnonzero((points == 39) & start)
        ends = np.append(begins[1:], n)[np.searchsorted(begins, marks, "right") - 1]
        for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
            at = marks[marks + len(ending) < ends]
            for k, letter in enumerate(ending, 1):
                at = at[points[at + k] == ord(letter)]
            start[at + 1] = False
            after = at + 1 + len(ending)
            start[after[after < n]] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit."""
        parts, owner = texts, np.arange(len(texts))
        if self.special and any(map(self.special.search, texts)):
            split = [self.special.split(t) for t in texts]
            parts, owner = [p for s in split for p in s], np.repeat(owner, [len(s) for s in split])
        specials = self.vocabulary.specials
        fixed = {k: specials[p] for k, p in enumerate(parts) if p in specials} if parts is not texts else {}
        coded = self._encode(["" if k in fixed else p for k, p in enumerate(parts)] if fixed else parts)
        for k, i in fixed.items():
            coded[k] = np.array([i], np.uint32)
        if parts is texts:
            return coded
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [np.concatenate(coded[a:b]) for a, b in zip(edges, edges[1:], strict=False)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32)] * len(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        cut = self.cuts(points, (ends - lengths)[lengths > 0])
        raw = np.frombuffer(joined.encode(), np.uint8)
        if len(raw) == len(points):
            at = cut
        else:
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            at = (np.cumsum(width) - width)[cut]
        until = np.append(at[1:], len(raw))
        word = self._words(raw, at, until)
        count = self.count[word]
        stops = np.cumsum(count)
        ids = self.flat[np.arange(stops[-1]) + np.repeat(self.start[word] - stops + count, count)]
        per_text = np.concatenate([[0], stops])[np.searchsorted(cut, ends)]
        return np.split(ids, per_text[:-1])

    def _words(self, raw: np.ndarray, at: np.ndarray, until: np.ndarray) -> np.ndarray:
        """The place of each word in what is remembered; new words are learnt.

        Words over LONG bytes are encoded each time they occur, so that the
        hash stands for short words only.
        """
        if self.words > REMEMBERED:
            self._forget()
        key = (self.hashed(raw, at, until) & np.uint64((1 << 63) - 1)).astype(np.int64)
        word = self.known(key)
        long = until - at > LONG
        word[long] = -1
        fresh = np.flatnonzero((word < 0) & ~long)
        _, first, where = np.unique(key[fresh], return_index=True, return_inverse=True)
        new = fresh[first]
        if len(new):
            begin = self._learn(raw, at[new], until[new])
            self.known.add(key[new], np.arange(begin, begin + len(new)))
            word[fresh] = begin + where
        if long.any():
            begin = self._learn(raw, at[long], until[long])
            word[long] = np.arange(begin, begin + int(long.sum()))
        return word

    def _learn(self, raw: np.ndarray, at: np.ndarray, until: np.ndarray) -> int:
        """Encode words and keep their ids: propose, check every pair, mend what fails."""
        v, n, lengths = self.vocabulary, len(at), until - at
        ids, owner = v.propose(raw, at, until)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(ids[inner] << 20 | ids[inner + 1], return_inverse=True)
        fine = v.compatible(pairs >> 20, pairs & ((1 << 20) - 1))[where]
        fails = np.zeros(n, bool)
        fails[owner[inner[~fine]]] = True
        self.failed += int(fails.sum())
        keep = ~fails[owner]
        owners, found, narrow = [owner[keep]], [ids[keep]], 1
        wrong = np.flatnonzero(fails)
        for width in (8, 10, 12, 14, 16, 20, 24, 32):
            some = wrong[(lengths[wrong] >= narrow) & (lengths[wrong] <= width)]
            narrow = width + 1
            if len(some):
                inside = np.arange(width) < lengths[some, None]
                table = np.where(inside, v.byte_id[raw[np.minimum(at[some, None] + np.arange(width), len(raw) - 1)]], -1)
                table = v.merged_together(table)
                owners.append(np.repeat(some, (table >= 0).sum(1)))
                found.append(table[table >= 0])
        for k in wrong[lengths[wrong] >= narrow].tolist():
            found.append(np.array(v.merged(raw[at[k] : until[k]]), np.int64))
            owners.append(np.full(len(found[-1]), k))
        owner, ids = np.concatenate(owners), np.concatenate(found)
        ids = ids[np.argsort(owner, kind="stable")]
        counts = np.bincount(owner, minlength=n)
        begin, self.words = self.words, self.words + n
        self.flat = _with_room(self.flat, self.used + len(ids))
        self.start, self.count = _with_room(self.start, self.words), _with_room(self.count, self.words)
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[begin : self.words] = self.used + np.cumsum(counts) - counts
        self.count[begin : self.words] = counts
        self.used += len(ids)
        return begin


def _with_room(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 0 white space, 1 letter, 2 number, 3 other."""
    kinds = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            a, b = ord(found[0][0]), ord(found[0][-1])
            kinds[a : b + 1] = kind
    return kinds


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def in_batches(batches: Iterator[pa.RecordBatch], rows: int = 1 << 20) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of rows, some hundred thousand characters or ``rows`` at a time; null becomes empty."""
    for batch in batches:
        ids, texts, chars = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            texts.append(text.as_py() or "")
            chars += len(texts[-1])
            if chars >= BATCH_CHARS or len(ids) == rows:
                yield ids, texts
                ids, texts, chars = [], [], 0
        if ids:
            yield ids, texts
        del ids, texts, batch
        give_back()


def encode_and_decode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>, decoded string``, one row for each of ``docs``."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for ids, texts in in_batches(batches):
            arrays = e.encode(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32())), pa.array([e.vocabulary.decode(a) for a in arrays])], ["doc_id", "ids", "decoded"])

    return narrow(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row for each of ``docs``.

    The same work as :func:`encode_and_decode`; the ids and texts are hashed
    where they are made, so they need not leave the worker.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for ids, texts in in_batches(batches):
            coded = e.encode(texts)
            decoded = [hashlib.sha256(e.vocabulary.decode(a).encode()).hexdigest() for a in coded]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(a) for a in coded], pa.int64()), pa.array([hashlib.sha256(a.astype("<u4").tobytes()).hexdigest() for a in coded]), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return narrow(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
