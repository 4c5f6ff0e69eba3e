"""Operator 3: secret scans with linking of multipart credentials.

Base spans (assignments, access identifiers, long hexadecimal runs) are
reported wherever they stand.  Weak parts are not telling alone: names of
accounts, tokens of mixed characters, short secrets, endpoints.  Parts take a
role: identifier, secret or endpoint.  A scope is a block of a text, up to an
empty line or a line that opens a section in square brackets, and reaches
``SCOPE`` code points from a part within it.  An interval join as of the part's
place finds the nearest parts of the other roles before and after it, one pass
over the text's parts in order each way, never all pairs.  A weak identifier or
endpoint is reported if a secret lies in its scope, a weak secret if an
identifier or an endpoint does, and a weak part that overlaps a base span is
part of that one.  Base spans count as parts of a scope, and are linked as well.

Rows: a null text counts as empty.  Rows that repeat ``doc_id`` and text are
scanned alike; null ids stay.  No rows: no rows.  Columns other than ``doc_id``
and ``text`` are ignored.  Nothing here runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.frames import computed
from factloom.llm.matching import kinds, listed, matches
from factloom.plans.staging import staged

#: Code points that a scope reaches from a part.
SCOPE = 200
# The base patterns; a run of hexadecimal digits or of an access
# identifier is matched whole, so its least length can stand in the pattern.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
# Weak parts: names of accounts, endpoints, and tokens of mixed characters.
WEAK_ID = r"""(?i)\b(?:user(?:_?name|_?id)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"""\b[a-zA-Z][a-zA-Z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]{4,}|(?i:\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,})"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
SHORT_SECRET = r"""(?i)\b(?:pass|pwd|pin|key|credential|auth|private_?key|secret_?access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#-]{6,}"""
ROLES = {"assign": "secret", "hex": "secret", "access": "identifier", "weak_id": "identifier", "weak_secret": "secret", "endpoint": "endpoint", "short_secret": "secret"}
#: What ends a block: an empty line, or a line that opens a section.
EDGE = r"\n[ \t\r]*(?=\n)|\n(?=[ \t]*\[[^\]\n]{1,80}\])"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _parts(text: Column) -> dict[str, Column]:
    long_value = lambda m: F.length(F.regexp_extract(m["found"], ASSIGNED, 1)) >= 6
    mixed = lambda m: m["found"].rlike("[0-9].*[0-9]") & m["found"].rlike("[a-z]") & m["found"].rlike("[A-Z]")
    every = lambda m: F.lit(True)
    return {
        "assign": kinds("assign", 0, matches(text, ASSIGN), long_value),
        "access": kinds("access", 1, matches(text, ACCESS), every),
        "hex": kinds("hex", 2, matches(text, HEX), every),
        "weak_id": kinds("weak_id", 3, matches(text, WEAK_ID), every),
        "endpoint": kinds("endpoint", 4, matches(text, ENDPOINT), every),
        "weak_secret": kinds("weak_secret", 5, matches(text, WEAK_SECRET), mixed),
        "short_secret": kinds("short_secret", 6, matches(text, SHORT_SECRET), every),
    }


def found(docs: DataFrame) -> DataFrame:
    """A written table of all parts of each text: ``doc_id, text_key``, an array for each kind, and the block edges of texts whose parts can be linked."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    parts = text.select("doc_id", F.xxhash64("text").alias("text_key"), *[bare(c).alias(k) for k, c in _parts(F.col("text")).items()], "text")
    edges = F.when(_linkable(), F.transform(matches(F.col("text"), EDGE), lambda m: F.struct(m["start"].alias("start"), F.lit(-1).alias("rank"), m["end"].alias("end"), F.lit("edge").alias("kind"))))
    return staged(computed(parts, edges=edges).drop("text"), "secrets")


def _linkable() -> Column:
    """Whether a text has a part that can be linked: a weak one, or any beside one of another role."""
    has = [F.greatest(*[F.size(k) for k, r in ROLES.items() if r == role], F.lit(0)) > 0 for role in ("identifier", "secret", "endpoint")]
    return sum(c.cast("int") for c in has) > 1


def linked(table: DataFrame) -> DataFrame:
    """``doc_id, text_key, weak, n_strong``: the weak parts with complementary parts in their scope, and how many base spans have some.

    Each part meets the last one of each role that ends before it and the first
    one that starts after it, by two windows over its block, in order and in
    reverse order, both of which only ever look back.
    """
    rows = table.filter(_linkable()).select("doc_id", "text_key", F.explode(F.concat(*ROLES, "edges")).alias("p")).select("doc_id", "text_key", "p.*").distinct()
    whole = Window.partitionBy("doc_id", "text_key").orderBy("start", "rank")
    rows = rows.withColumn("block", F.count_if(F.col("kind") == "edge").over(whole.rowsBetween(Window.unboundedPreceding, 0))).filter("kind <> 'edge'")
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("kind")]
    rows = rows.withColumn("role", role).withColumn("strong", F.col("kind").isin(*BASE))
    keys = Window.partitionBy("doc_id", "text_key", "block")
    past = keys.orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    ahead = keys.orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    meets = lambda cond, by: F.coalesce((F.max(F.when(cond, F.col("end"))).over(past) > F.col("start") - by) | (F.min(F.when(cond, F.col("start"))).over(ahead) < F.col("end") + by), F.lit(False))
    is_role = lambda *r: F.col("role").isin(*r)
    rows = rows.withColumn("covered", meets(F.col("strong"), 0)).filter(F.col("strong") | ~F.col("covered"))
    near = rows.select("*", meets(is_role("secret"), SCOPE + 1).alias("by_secret"), meets(is_role("identifier", "endpoint"), SCOPE + 1).alias("by_other"))
    good = near.filter(F.when(is_role("secret"), F.col("by_other")).otherwise(F.col("by_secret")))
    weak = F.collect_list(F.when(~F.col("strong"), F.struct("start", "rank", "end", "kind")))
    return good.groupBy("doc_id", "text_key").agg(weak.alias("weak"), F.count_if("strong").alias("n_strong"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of base spans, ``base_sha256``, ``spans``, and how many weak and base spans are linked: one row for each of ``docs``."""
    table = found(docs)
    weak = linked(table).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "weak", "n_strong")
    narrow = table.select("doc_id", "text_key", *BASE)
    joined = narrow.join(weak, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    base = F.concat(*BASE)
    return joined.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        F.when(F.col("weak").isNull(), listed(base)).otherwise(listed(F.concat(base, F.col("weak")))).alias("spans"),
        F.coalesce(F.size("weak"), F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("n_strong", F.lit(0)).cast("long").alias("n_linked_base"),
    )
