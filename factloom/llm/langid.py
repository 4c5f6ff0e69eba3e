"""Operator 10: language identification with error-correcting output codes.

Each language has a codeword of bits.  For each bit a logistic regression over
hashed letter n-grams (one to three, of the whole text in lower case, with
everything but letters as a space) tells the languages with a 1 from those with
a 0.  A text's margins are decoded by loss: the language whose codeword has the
least logistic loss, each bit weighted by how far its classifier beats chance
on the training rows.  A prediction is ambiguous where the runner-up comes
close.

Training rows are a documented, bounded sample: of each language about
``SAMPLE`` rows with the lowest hashes of ``doc_id``, taken whole, among the
rows whose language is known and that are not held out.  With many languages
each has fewer, so that they are about ``TRAINED`` in all, but never under
``FEWEST``.  Only the text is an input of a prediction.

Rows: a null text, or one without a letter, is ``und`` with score 0; so is any
text if there is nothing to learn from.  A null ``doc_id`` counts as an empty
one for the hold-out.  Repeated rows are predicted alike.  Columns of the
input are kept by :func:`with_language` and, but for ``lang``, by
:func:`identified`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.bloom import free_names
from factloom.llm.bpe import BATCH_CHARS
from factloom.llm.spans import give_back, mixed

#: Hashed n-grams; training rows of a language; steps of the training.
FEATURES, SAMPLE, STEPS = 4096, 800, 120
#: Training rows in all, about (a dense row takes 16 kB of the driver), and the fewest of a language.
TRAINED, FEWEST = 8000, 20
#: Texts that are counted together.
TEXTS = 200
#: Under this score a prediction is ambiguous.
AMBIGUOUS = 0.6


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: its lower case if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for point in [*range(0xD800), *range(0xE000, 0x110000)]:
        if (c := chr(point)).isalpha():
            table[point] = ord(low) if len(low := c.lower()) == 1 else point
    return table


def profiles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the roots of n-gram counts, a row for each text; whether a text has letters."""
    joined = "".join(f"\n{t or ''}\n" for t in texts)
    points = _letters()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].astype(np.uint64)
    lengths = np.array([len(t or "") + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    keep = points > 0
    keep[1:] |= points[:-1] > 0
    points, owner = points[keep], owner[keep]
    out = np.zeros(len(texts) * FEATURES, np.float32)
    hashed = np.zeros(len(points), np.uint64)
    for n in range(1, 4):
        hashed = hashed[n > 1 :] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
        if n == 1:
            inside &= points > 0
        place = (mixed(hashed) >> np.uint64(64 - 12)).astype(np.int64) + owner[n - 1 :] * FEATURES
        out += np.bincount(place[inside], minlength=len(out)).astype(np.float32)
    out = np.sqrt(out.reshape(len(texts), FEATURES))
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-9), norm[:, 0] > 0


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language: all splits in two for up to six, else distant random ones."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 6:
        splits = [ones for n in range(1, languages) for ones in combinations(range(languages), n) if 0 in ones]
        code = -np.ones((languages, len(splits)))
        for k, ones in enumerate(splits):
            code[list(ones), k] = 1
        return code
    bits, rng = 15 * int(np.ceil(np.log2(languages))), np.random.default_rng(7)
    tries = (rng.choice([-1.0, 1.0], (languages, bits)) for _ in range(200))

    def distance(code: np.ndarray) -> float:
        apart = bits - (code @ code.T + bits) / 2
        return float((apart + np.eye(languages) * bits).min()) if (np.abs(code.sum(0)) < languages).all() else -1

    return max(tries, key=distance)


def train(x: np.ndarray, y: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, bias and reliability of the bits' classifiers; each language counts alike."""
    target = code[y].astype(np.float32)
    each = 1 / np.bincount(y, minlength=len(code))[y]
    each = (each / each.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    wv, bv, rate = w, b, 8.0
    for step in range(STEPS):
        pull = (each * target / (1 + np.exp(np.clip(target * (x @ wv + bv), -30, 30)))).astype(np.float32)
        w_next, b_next = wv + rate * (x.T @ pull - 1e-4 * wv), bv + rate * pull.sum(0)
        pace = step / (step + 3)
        wv, bv = (w_next + pace * (w_next - w)).astype(np.float32), (b_next + pace * (b_next - b)).astype(np.float32)
        w, b = w_next.astype(np.float32), b_next.astype(np.float32)
    wrong = (each * (np.sign(x @ w + b) != target)).sum(0)
    return w, b, np.maximum(1 - 2 * wrong, 0.01)


def decode(margins: np.ndarray, code: np.ndarray, reliable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row by weighted loss, and its share against all others."""
    loss = (np.log1p(np.exp(-np.clip(margins[:, None, :] * code[None], -30, 30))) * reliable).sum(2)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    share /= share.sum(1, keepdims=True)
    return loss.argmin(1), share.max(1)


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Train on a bounded sample of ``docs``: at most about ``sample`` rows of each language."""
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return {"languages": []}
    parts = 1 << 24
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(parts))
    sample = max(FEWEST, min(sample, TRAINED // len(languages)))
    limit = F.create_map(*[F.lit(v) for lang in languages for v in (lang, int(parts * min(1.0, sample / counts[lang])))])
    number = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for at, until in _parts(texts):
                x, lettered = profiles(texts[at:until])
                rows = []
                for k in np.flatnonzero(lettered).tolist():
                    on = np.flatnonzero(x[k])
                    rows.append((number[langs[at + k]], on.astype("<u2").tobytes(), x[k, on].astype("<f2").tobytes()))
                if rows:
                    y, on, v = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(on, pa.binary()), pa.array(v, pa.binary())], ["y", "places", "values"])

    chosen = known.filter(chance < limit[F.col("lang")]).select("lang", "text").mapInArrow(run, "y int, places binary, values binary").collect()
    x, y = np.zeros((len(chosen), FEATURES), np.float32), np.zeros(len(chosen), np.int64)
    order = sorted(range(len(chosen)), key=lambda k: (chosen[k]["y"], bytes(chosen[k]["places"]), bytes(chosen[k]["values"])))
    for k, at in enumerate(order):
        y[k] = chosen[at]["y"]
        x[k, np.frombuffer(chosen[at]["places"], "<u2")] = np.frombuffer(chosen[at]["values"], "<f2")
    seen = sorted(set(y.tolist()))
    languages, y = [languages[k] for k in seen], np.searchsorted(seen, y)
    code = codewords(len(languages))
    w, b, reliable = train(x, y, code) if len(languages) > 1 else (np.zeros((FEATURES, 0), np.float32), np.zeros(0), np.zeros(0))
    return {"languages": languages, "code": code, "w": w, "b": b, "reliable": reliable}


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are counted together: few enough, and not too long."""
    at = 0
    while at < len(texts):
        until, chars = at, 0
        while until < len(texts) and until - at < TEXTS and chars < BATCH_CHARS:
            chars += len(texts[until] or "")
            until += 1
        yield at, until
        at = until


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    names, scores = [], []
    for at, until in _parts(texts):
        x, lettered = profiles(texts[at:until])
        if model["languages"]:
            best, score = decode(x @ model["w"] + model["b"], model["code"], model["reliable"])
        else:
            best, score, lettered = np.zeros(len(x), int), np.zeros(len(x)), np.zeros(len(x), bool)
        names += [model["languages"][k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        scores.append(np.where(lettered, score, 0.0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def language_of(model: dict, spark_context) -> object:  # noqa: ANN001
    """A column function: text to ``struct<lang_pred, score, ambiguous>``."""
    sent = spark_context.broadcast(model)  # of fixed size for a set of languages

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def identify(texts: pd.Series) -> pd.DataFrame:
        names, scores = predict(sent.value, [t if isinstance(t, str) else None for t in texts])
        give_back()
        return pd.DataFrame({"lang_pred": names, "score": scores.astype(float), "ambiguous": scores < AMBIGUOUS})

    # It always tells the same; this keeps filters on the struct from computing it a second time.
    return identify.asNondeterministic()


def with_language(docs: DataFrame, model: dict | None = None, into: str = "identified") -> DataFrame:
    """``docs`` with a struct ``into`` of ``lang_pred, score, ambiguous``, in place of any such column."""
    identify = language_of(model or fit(docs), docs.sparkSession.sparkContext)
    return docs.withColumn(into, identify(F.col("text").cast("string")))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous``, one row for each of ``docs``."""
    named = with_language(docs.select("doc_id", "text"), fit(docs))
    return named.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "identified.lang_pred", "identified.score", "identified.ambiguous")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a language, which ``lang`` then tells; other columns stay.

    Rejected are texts without letters and those whose nearest codewords are
    hard to tell apart (``ambiguous``).  Rows whose language was not known get
    one, rows under a wrong one get another.  If no row can teach a language
    there is no verdict: texts with letters keep what they have.
    """
    model = fit(docs)
    if not model["languages"]:
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    (into,) = free_names(docs, "identified")
    told = with_language(docs, model, into).filter((F.col(into)["lang_pred"] != "und") & ~F.col(into)["ambiguous"])
    return told.select(*[F.col(into)["lang_pred"].alias(c) if c == "lang" else F.col(c) for c in docs.columns])
