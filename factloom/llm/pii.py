"""Operator 9: personal data, by weak supervision.

Base spans (e-mail addresses, IP addresses, payment cards, phone numbers) are
reported wherever their rules hold.  Candidates beyond them come from laxer
patterns: phone numbers without a country code, masked addresses, social
security numbers, bank accounts, persons after a title, any two or three
capitalised words, street addresses, full dates.  Labelers vote on every
candidate, base spans included: its format and check digits (regular
expressions), lists of given names, domains and country codes (gazetteer), and
the words and symbols around it (context).  The votes of all candidates of the
corpus are counted by pattern.  Expectation maximisation over these counts
estimates how reliable each labeler is and how probable each pattern makes
personal data; the patterns' probabilities are the targets of a logistic
regression on features of the span, which decides on the candidates.  Each
reported span carries its probability.

The counts have at most a row for each combination of kind, votes and features,
whatever the corpus, so both models are fitted on them exactly, over all rows.

Rows: a null text counts as empty.  Repeated rows are scanned alike; null ids
stay.  No rows: no rows.  Other columns are kept by :func:`redacted`.  Nothing
here runs Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.frames import computed
from factloom.llm.matching import kinds, let, listed, matches, prefixes
from factloom.plans.staging import staged

# The base patterns.  A run that a match must start with is taken
# from its beginning, or from where the last match ended: leftmost matches
# start there, and long runs are not tried again at each character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
# Laxer patterns of candidates.
MASKED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{2,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z]{2,24}){1,3}"
NATIONAL = r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PERSON = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Mme|Herr|Frau|Sr|Sra)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20}){0,2}"
NAME = r"(?<!\p{L})\p{Lu}\p{Ll}{1,19}(?:\x20\p{Lu}\p{Ll}{1,19}){1,2}(?!\p{L})"
STREET = r"(?<![0-9])[0-9]{1,5}\x20(?:[A-Z][a-z]{1,19}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Square)\b|(?<!\p{L})(?:[Rr]ue|[Aa]venue|[Cc]alle|[Pp]laza)\x20(?:d\p{Ll}{1,2}\x20)?\p{Lu}\p{Ll}{1,19},?\x20[0-9]{1,5}(?![0-9])|(?<!\p{L})\p{Lu}\p{Ll}{2,19}(?:straße|strasse|platz|gasse)\x20[0-9]{1,4}(?![0-9])"
BIRTH = r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-])"
DIALLED = r"(?<![0-9A-Za-z+(./-])0[0-9]{1,4}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9A-Za-z])"
#: Kinds of candidates, and the share of true ones that expectation maximisation starts from.
LAX = {"masked_email": 0.8, "national_phone": 0.6, "social": 0.6, "account": 0.6, "person": 0.6, "street": 0.6, "birth": 0.3, "dialled_phone": 0.4, "name": 0.1}
KINDS = (*BASE, *LAX)
START = {**dict.fromkeys(BASE, 0.9), **LAX}
# Gazetteers: top-level domains, country codes of bank accounts, given names, words that follow no name.
DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "io", "co", "me", "info", "biz", "app", "dev", "de", "fr", "es", "it", "nl", "be", "at", "ch", "uk", "ie", "pl", "pt", "se", "no", "dk", "fi", "cz", "gr", "eu", "us", "ca", "mx", "br", "ar", "in", "cn", "jp", "kr", "au", "nz", "za", "ru", "tr")
COUNTRIES = ("AD", "AE", "AL", "AT", "BA", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IL", "IS", "IT", "LI", "LT", "LU", "LV", "MC", "MT", "NL", "NO", "PL", "PT", "RO", "RS", "SA", "SE", "SI", "SK", "TR", "UA")
GIVEN = (
    "Adam", "Alan", "Albert", "Alejandro", "Alex", "Alexander", "Alice", "Alicia", "Amanda", "Amy", "Ana", "Andrea", "Andreas", "Andrew", "Angela", "Anna", "Anne", "Anthony", "Antoine", "Antonio", "Barbara", "Ben", "Benjamin", "Bernd", "Brian", "Camille", "Carla", "Carlos", "Carmen", "Caroline", "Catherine", "Charles", "Charlotte", "Chloé", "Chris", "Christian", "Christina", "Claire", "Claudia", "Daniel", "David", "Deborah", "Diego", "Dieter", "Elena", "Elizabeth", "Emily", "Emma", "Eric", "Eva", "Felix", "Fernando", "Florian", "Francisco", "Franz", "François", "Frank", "Gabriel", "George", "Gerhard", "Hannah", "Hans", "Heike", "Helen", "Henri", "Henry", "Isabel", "Jack", "Jacques", "James", "Jan", "Jane", "Javier", "Jean", "Jennifer", "Jessica", "John", "Jonas", "Jorge", "José", "Joseph", "Juan", "Julia", "Julie", "Julien", "Jürgen", "Karen", "Karin", "Karl", "Kevin", "Klaus", "Laura", "Léa", "Linda", "Lisa", "Louis", "Lucas", "Lucía", "Luis", "Manuel", "Marc", "María", "Maria", "Marie", "Mark", "Marta", "Martin", "Mary", "Matthew", "Max", "Michael", "Miguel", "Monika", "Nicolas", "Nicole", "Olivier", "Pablo", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Rachel", "Rafael", "Ralf", "Richard", "Robert", "Rosa", "Ruth", "Sabine", "Samuel", "Sandra", "Sara", "Sarah", "Simon", "Sofía", "Sophie", "Stefan", "Stephen", "Steven", "Susan", "Susanne", "Thomas", "Uwe", "Victor", "William", "Wolfgang", "Yves",
)
CUES = r"(?i)(?:e-?mail|mail|contact|write|call|phone|tel|fax|mobile|card|visa|payment|account|iban|bank|ssn|social|born|birth|name|named|address|ip|from|by|dear|signed|author|lives? (?:at|in)|at)[^A-Za-z0-9]{0,4}$"
AGAINST = r"(?i)(?:version|release|isbn|issn|page|vol|no|nr|figure|table|section|id|ref|v)[^A-Za-z0-9]{0,3}$"
#: Rounds of expectation maximisation, steps of the regression, the least probability of a span, and the weight of starting values in rows.
ROUNDS, STEPS, ACCEPT, PRIOR = 60, 400, 0.5, 10
LABELERS = ("format", "gazetteer", "context", "against", "variety")
#: Features, each a small number; ``listed`` and ``shape`` say other things of each kind.
FEATURES = ("size", "ahead", "digits", "cue", "listed", "shape")
OF_KIND = (4, 5)
#: Beyond any place in a text.
FAR = (1 << 31) - 1


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _found(text: Column, numeric: Column) -> dict[str, Column]:
    """For each kind the spans that pass its rule, with their surroundings; ``numeric`` tells whether the text has a digit at all."""
    octet = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (F.when(F.length(q) <= 3, q.cast("int")) <= 255))
    octets = lambda m: F.forall(F.split(m["found"], r"\."), octet)
    size = lambda m: F.length(_digits(m["found"]))
    every = lambda m: F.lit(True)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,found:string,before:string,after:string>>")
    # Most texts lack what most kinds need.
    has = lambda test, c: F.when(test, c).otherwise(none)
    masks = text.contains("at)") | text.contains("at]") | text.contains("at}")
    return {
        "email": has(text.contains("@"), kinds("email", 0, matches(text, EMAIL), every)),
        "ip": has(numeric, kinds("ip", 1, matches(text, IP), octets)),
        "card": has(numeric, kinds("card", 2, matches(text, CARD), lambda m: size(m).between(14, 19) & luhn(_digits(m["found"])))),
        "phone": has(text.contains("+"), kinds("phone", 3, matches(text, PHONE), lambda m: size(m).between(10, 15))),
        "masked_email": has(masks, kinds("masked_email", 4, matches(text, MASKED), every)),
        "national_phone": has(numeric, kinds("national_phone", 5, matches(text, NATIONAL), every)),
        "social": has(numeric, kinds("social", 6, matches(text, SOCIAL), every)),
        "account": has(numeric, kinds("account", 7, matches(text, ACCOUNT), lambda m: checked(m["found"]))),
        "person": kinds("person", 8, matches(text, PERSON), every),
        "street": has(numeric, kinds("street", 9, matches(text, STREET), every)),
        "birth": has(numeric, kinds("birth", 10, matches(text, BIRTH), every)),
        "dialled_phone": has(numeric, kinds("dialled_phone", 11, matches(text, DIALLED), lambda m: size(m).between(8, 13))),
        "name": kinds("name", 12, matches(text, NAME), every),
    }


def checked(account: Column) -> Column:
    """Whether an account number's check digits are right: moved to the end, letters as two digits, it is 1 modulo 97."""
    plain = F.regexp_replace(account, "[^A-Z0-9]", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))
    step = lambda a, x: (F.when(x.rlike("[0-9]"), a * 10 + x.try_cast("int")).otherwise(a * 100 + F.ascii(x) - 55)) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), lambda a, x: F.coalesce(step(a, x), F.lit(0)).cast("int")) == 1


def _votes(s: Column) -> list[Column]:
    """Votes of the labelers on a span, in the order of ``LABELERS``: 1 for, -1 against, 0 none."""
    kind, text, digits = s["kind"], s["found"], _digits(s["found"])
    yes = lambda c: F.when(c, 1).otherwise(0)
    both = lambda c: F.when(c, 1).otherwise(-1)
    words = F.split(text, " ")
    months = r"^(?:(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-]|[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$)"
    shape = (
        F.when(kind.isin("email", "masked_email"), both(text.rlike(r"^[A-Za-z0-9._%+-]{1,64}[^A-Za-z0-9._%+-]{1,6}.*[A-Za-z]{2,}$")))
        .when(kind == "ip", both(~text.rlike(r"(^|\.)0[0-9]")))
        .when(kind == "card", both(digits.rlike("^[2-6]")))
        .when(kind.isin("phone", "national_phone"), both(digits.rlike("^[1-9][0-9]{9,}$")))
        .when(kind == "dialled_phone", both(digits.rlike("^0[1-9][0-9]{7,11}$")))
        .when(kind == "social", both(~digits.rlike(r"^(000|666|9)|^...00|0000$")))
        .when(kind == "account", both(F.length(F.regexp_replace(text, " ", "")).between(15, 34)))
        .when(kind == "birth", both(text.rlike(months)))
        .when(kind == "name", both(F.forall(words, lambda w: F.length(w) > 2) & (F.size(F.array_distinct(words)) == F.size(words))))
        .when(kind == "street", both(text.rlike(r"\p{Lu}\p{Ll}{3}")))
        .otherwise(both(text.rlike(r"\x20[A-Z][a-z]+\x20?[A-Z]?")))
    )
    listed_ = (
        F.when(kind.isin("email", "masked_email"), yes(F.lower(F.regexp_extract(text, r"([A-Za-z]+)$", 1)).isin(*DOMAINS)))
        .when(kind == "account", both(F.left(text, F.lit(2)).isin(*COUNTRIES)))
        .when(kind == "national_phone", both(~digits.rlike("^[01]|^.11")))
        .when(kind == "person", yes(text.rlike(r"^(Mrs?|Ms|Dr|Prof)\.\x20")))
        .when(kind == "name", both(F.get(words, F.lit(0)).isin(*GIVEN)))
        .otherwise(0)
    )
    cue = s["before"].rlike(CUES)
    # A date alone tells no birth, and a sentence begins with a capital letter.
    context = F.when(kind == "birth", both(cue)).otherwise(yes(cue))
    opens = (kind == "name") & (s["before"].rlike(r"[.!?:]\s*$|\n\s*$") | (s["before"] == ""))
    return [shape, listed_, context, F.when(s["before"].rlike(AGAINST) | opens, -1).otherwise(0), F.when((kind != "birth") & (F.length(digits) >= 7), both(~digits.rlike(r"([0-9])\1{5}|0123456|1234567"))).otherwise(0)]


def _features(s: Column, votes: list[Column]) -> list[Column]:
    """Features of a span, small numbers in the order of ``FEATURES``."""
    ahead = F.when(s["before"].rlike(r"[A-Za-z0-9]$"), 2).when(s["before"].rlike(r"[ \t-\r(\[\"':,]$") | (s["before"] == ""), 0).otherwise(1)
    return [F.least(F.lit(3), F.floor(F.length(s["found"]) / 8)).cast("int"), ahead, F.when(F.length(_digits(s["found"])) >= 9, 1).otherwise(0), F.when(s["before"].rlike(CUES), 1).otherwise(0), votes[1] + 1, votes[0] + 1]


def unmet(spans: Column) -> Column:
    """Spans in order without the lax ones that meet a base span or an earlier span; each looks at what ends before it and what begins after."""

    def clear(all_: Column) -> Column:
        ends = prefixes(F.transform(all_, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
        starts = F.transform(F.reverse(all_), lambda s: F.when(s["rank"] < len(BASE), s["start"]).otherwise(FAR))
        nexts = F.reverse(prefixes(starts, F.lit(FAR), lambda a, x: F.least(a, x)))
        alone = lambda s, bound: (s["rank"] < len(BASE)) | ((bound["ended"] <= s["start"]) & (bound["begins"] >= s["end"]))
        bounds = F.arrays_zip(ends.alias("ended"), nexts.alias("begins"))
        return let(bounds, lambda bs: F.filter(all_, lambda s, i: alone(s, F.get(bs, i))))

    return let(F.array_sort(spans), lambda all_: F.when(F.size(all_) > 1, clear(all_)).otherwise(all_))


def candidates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A written table: ``doc_id`` and ``spans``, base ones and lax ones that overlap none before them, with votes and features."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    text = text.withColumn("numeric", F.col("text").rlike("[0-9]"))
    spans = text.select("doc_id", *keep, *[c.alias(k) for k, c in _found(F.col("text"), F.col("numeric")).items()])

    def pair(s: Column) -> Column:
        votes = _votes(s)
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.array(*votes).alias("votes"), F.array(*_features(s, votes)).alias("features"))

    marked = spans.select("doc_id", *keep, unmet(F.concat(*KINDS)).alias("every"))
    return staged(marked.select("doc_id", *keep, F.transform("every", pair).alias("spans")), "candidates")


def estimate(counts: list[tuple[str, tuple[int, ...], int]]) -> tuple[dict[str, list[float]], dict[tuple[str, tuple[int, ...]], float]]:
    """Expectation maximisation over counts of ``(kind, votes)``.

    A labeler that votes is right with some probability, the same for both
    answers; each kind has its own share of true spans.  Returns the labelers'
    reliabilities and the probability of each combination.
    """
    right, share = [0.75] * len(LABELERS), dict(START)
    posterior: dict[tuple[str, tuple[int, ...]], float] = {}
    for _ in range(ROUNDS):
        for kind, votes, _n in counts:
            log = math.log(share[kind] / (1 - share[kind])) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, right, strict=True))
            posterior[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
        for j in range(len(LABELERS)):
            agree = voted = 0.0
            for kind, votes, n in counts:
                if votes[j]:
                    p = posterior[kind, votes]
                    agree += n * (p if votes[j] > 0 else 1 - p)
                    voted += n
            right[j] = min(0.98, max(0.55, (agree + 0.75 * PRIOR) / (voted + PRIOR)))
        for kind in KINDS:
            some = [(posterior[k, v], n) for k, v, n in counts if k == kind]
            share[kind] = min(0.98, max(0.02, (sum(p * n for p, n in some) + START[kind] * PRIOR) / (sum(n for _, n in some) + PRIOR)))
    return {"right": right, "share": [share[k] for k in KINDS]}, posterior


def _place(kind: int, j: int) -> int:
    """Where the classifier's inputs for the values of feature ``j`` begin: the same for all kinds, or each kind's own."""
    common = len(KINDS) + 4 * len(FEATURES)
    return common + 4 * (len(OF_KIND) * kind + OF_KIND.index(j)) if j in OF_KIND else len(KINDS) + 4 * j


INPUTS = len(KINDS) + 4 * len(FEATURES) + 4 * len(OF_KIND) * len(KINDS)


def _inputs(kind: str, features: tuple[int, ...]) -> list[int]:
    """Places of the 1s among the classifier's inputs: the kind and each feature's value."""
    k = KINDS.index(kind)
    return [k, *[_place(k, j) + f for j, f in enumerate(features)]]


def classifier(rows: list[tuple[str, tuple[int, ...], float, int]]) -> list[float]:
    """Weights of a logistic regression on ``(kind, features, probability, count)``."""
    weights, total = [0.0] * INPUTS, sum(r[3] for r in rows) or 1
    inputs = [(_inputs(k, f), p, n / total) for k, f, p, n in rows]
    for _ in range(STEPS):
        slope = [-1e-4 * w for w in weights]
        for on, p, n in inputs:
            miss = n * (p - 1 / (1 + math.exp(-sum(weights[i] for i in on))))
            for i in on:
                slope[i] += miss
        weights = [w + 2.0 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def fit(table: DataFrame) -> list[float]:
    """The span classifier's weights, from the votes and features of all candidates of a written table."""
    flat = table.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    grouped = flat.groupBy("kind", *[F.get("votes", F.lit(j)).alias(f"v{j}") for j in range(len(LABELERS))], *[F.get("features", F.lit(j)).alias(f"f{j}") for j in range(len(FEATURES))]).agg(F.count("*").alias("n"))
    rows = [(r["kind"], tuple(r[f"v{j}"] for j in range(len(LABELERS))), tuple(r[f"f{j}"] for j in range(len(FEATURES))), r["n"]) for r in grouped.collect()]
    rows.sort()
    patterns: dict[tuple[str, tuple[int, ...]], int] = {}
    for kind, votes, _, n in rows:
        patterns[kind, votes] = patterns.get((kind, votes), 0) + n
    _, posterior = estimate([(k, v, n) for (k, v), n in patterns.items()])
    return classifier([(k, f, posterior[k, v], n) for k, v, f, n in rows])


def _accepted(spans: Column, weights: list[float]) -> Column:
    """Base spans, and candidates that the classifier takes for personal data, with their probability."""
    table = F.array(*map(F.lit, weights))

    def told(s: Column) -> Column:
        # The rank is the kind's number.
        margin = F.get(table, s["rank"])
        for j in range(len(FEATURES)):
            begin = s["rank"] * (_place(1, j) - _place(0, j)) + _place(0, j)
            margin = margin + F.get(table, begin + F.get(s["features"], F.lit(j)))
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), (1 / (1 + F.exp(-margin))).alias("probability"))

    return F.filter(F.transform(spans, told), lambda s: (s["rank"] < len(BASE)) | (s["probability"] >= ACCEPT))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of base spans, ``base_sha256``, ``spans``, their ``probabilities``, ``n_added``: one row for each of ``docs``."""
    table = candidates(docs)
    taken = computed(table, taken=_accepted(F.col("spans"), fit(table))).select("doc_id", F.col("taken").alias("spans"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    shares = F.array_join(F.transform("spans", lambda s: F.format_number(s["probability"], 3)), ",")
    return taken.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), shares.alias("probabilities"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of some spans, in order, as its kind in brackets; overlapping spans become one, named by the first.

    The text is first cut into stretches of about the root of the number of
    spans, so that finding a place never runs through all of a long text.
    """
    reached = prefixes(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
    apart = let(reached, lambda r: F.filter(F.transform(spans, lambda s, i: F.struct(F.get(r, i).alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda s: s["start"] >= s["from"]))

    def cut(cuts: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(cuts))).cast("int")

        def stretch(some: Column) -> Column:
            begin = F.get(some, F.lit(0))["from"]
            whole = F.substring(text, begin + 1, F.element_at(some, -1)["start"] - begin)
            one = lambda w: F.array_join(F.transform(some, lambda s: F.concat(F.substring(w, s["from"] - begin + 1, s["start"] - s["from"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))), "")
            return let(whole, one)

        blocks = F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / block).cast("int"))
        return F.array_join(F.transform(blocks, lambda j: let(F.slice(cuts, j * block + 1, block), stretch)), "")

    last = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    return F.concat(let(apart, cut), F.substring(text, last + 1, F.length(text)))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets; ``n_chars``, if there is one, follows. Columns of any name are kept."""
    kept = {c: f"kept_{k}" for k, c in enumerate(docs.columns)}
    table = candidates(docs.select("doc_id", "text", *[F.col(c).alias(k) for c, k in kept.items()]), tuple(kept.values()))
    cut = computed(table, taken=_accepted(F.col("spans"), fit(table)))
    body = F.col(kept["text"]).cast("string")
    cut = computed(cut, new=F.when(F.size("taken") > 0, replaced(body, F.col("taken"))).otherwise(body))
    return cut.select(*[F.col("new").alias(c) if c == "text" else F.length("new").cast("long").alias(c) if c == "n_chars" else F.col(k).alias(c) for c, k in kept.items()])
