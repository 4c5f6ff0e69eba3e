"""Porter's stemmer as expressions, applied step by step to a table of distinct words.

A word is read beside its shape, a string with ``C`` for each consonant and
``V`` for each vowel; the shape of a word's beginning is the beginning of its
shape, so every condition on what precedes a suffix is one on a prefix of it.
The expressions are plain SQL, so any engine with the same few string functions
can run them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The suffixes of each step of Porter's algorithm with what replaces them.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = tuple((s, "") for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"))
_PLURALS = sorted(PLURALS, key=lambda r: -len(r[0]))
_SECOND, _THIRD, _FOURTH = ((tuple(x for x, _ in rules), tuple(sorted(rules, key=lambda r: -len(r[0])))) for rules in (SECOND, THIRD, FOURTH))
_LETTERS = {ord(c): "V" if c in "aeiou" else "C" for c in "abcdefghijklmnopqrstuvwxz"}
#: Rounds that tell which ``y`` are vowels; each settles one of neighbouring ones.
Y_ROUNDS = 3


def shape(word: str, everywhere: str) -> str:
    """The shape of a word; ``everywhere`` is what makes an engine's regular expression replace all matches."""
    out = f"regexp_replace(regexp_replace({word}, '[aeiou]', 'V'{everywhere}), '[^Vy]', 'C'{everywhere})"
    for _ in range(Y_ROUNDS):
        out = f"replace(replace(regexp_replace({out}, '^y', 'C'{everywhere}), 'Vy', 'VC'), 'Cy', 'CV')"
    return out


def _measure(begin: str, everywhere: str) -> str:
    """How often a vowel is followed by a consonant."""
    return f"(length(regexp_replace({begin}, 'V+C+', 'VC'{everywhere})) - length(replace(regexp_replace({begin}, 'V+C+', 'VC'{everywhere}), 'VC', ''))) / 2"


def _begin(suffix: str) -> str:
    return f"left(s, length(w) - {len(suffix)})"


def _without(suffix: str, end: str = "") -> str:
    return f"(left(w, length(w) - {len(suffix)}) || '{end}')"


def _longest(rules: tuple[tuple[str, str], ...], condition: str, everywhere: str) -> str:
    """The longest suffix decides: it is replaced if its condition holds, else nothing is."""
    whens = []
    for suffix, end in sorted(rules, key=lambda r: -len(r[0])):
        holds = condition.format(m=_measure(_begin(suffix), everywhere))
        if suffix == "ion":
            holds += " AND left(right(w, 4), 1) IN ('s', 't') AND length(w) > 3"
        whens.append(f"WHEN right(w, {len(suffix)}) = '{suffix}' THEN CASE WHEN {holds} THEN {_without(suffix, end)} ELSE w END")
    return f"CASE {' '.join(whens)} ELSE w END"


def steps(everywhere: str = "") -> list[str]:
    """Expressions over a word ``w`` and its shape ``s``, each to be applied to what the one before gave."""
    short = "right(s, 3) = 'CVC' AND right(w, 1) NOT IN ('w', 'x', 'y')"
    double = "right(w, 1) = left(right(w, 2), 1) AND length(w) > 1 AND right(s, 1) = 'C'"
    vowel = lambda suffix: f"{_begin(suffix)} LIKE '%V%'"
    m = lambda suffix: _measure(_begin(suffix), everywhere)
    # A mark tells the next step that a suffix fell; no word has one.
    past = f"CASE WHEN right(w, 3) = 'eed' THEN CASE WHEN {m('eed')} > 0 THEN {_without('d')} ELSE w END WHEN right(w, 2) = 'ed' AND {vowel('ed')} THEN {_without('ed')} || '+' WHEN right(w, 3) = 'ing' AND {vowel('ing')} THEN {_without('ing')} || '+' ELSE w END"
    whole = _measure("s", everywhere)
    mended = f"CASE WHEN right(w, 2) IN ('at', 'bl', 'iz') THEN w || 'e' WHEN {double} AND right(w, 1) NOT IN ('l', 's', 'z') THEN left(w, length(w) - 1) WHEN {whole} = 1 AND {short} THEN w || 'e' ELSE w END"
    y = f"CASE WHEN right(w, 1) = 'y' AND {vowel('y')} THEN {_without('y', 'i')} ELSE w END"
    stem_short = "right(left(s, length(s) - 1), 3) = 'CVC' AND left(right(w, 2), 1) NOT IN ('w', 'x', 'y')"
    e = f"CASE WHEN right(w, 1) = 'e' AND ({m('e')} > 1 OR ({m('e')} = 1 AND NOT ({stem_short}))) THEN {_without('e')} ELSE w END"
    ll = f"CASE WHEN right(w, 2) = 'll' AND {whole} > 1 THEN left(w, length(w) - 1) ELSE w END"
    return [_longest(PLURALS, "TRUE", everywhere), past, mended, y, _longest(SECOND, "{m} > 0", everywhere), _longest(THIRD, "{m} > 0", everywhere), _longest(FOURTH, "{m} > 1", everywhere), e, ll]


#: The step that only words get whose past or progressive ending fell.
MENDING = 2


def stems(words: DataFrame) -> DataFrame:
    """``term, stem`` for each ``term`` of a table of distinct lower-case words; words of one or two letters, and those with anything but a-z, stay."""
    plain = words.select("term", F.col("term").alias("w"), (F.col("term").rlike("^[a-z]+$") & (F.length("term") > 2)).alias("fit"))
    for k, step in enumerate(steps()):
        marked = F.endswith("w", F.lit("+"))
        bare = F.regexp_replace("w", r"\+$", "")
        part = plain.select("term", "fit", marked.alias("fell"), bare.alias("w"))
        # A generator between the steps keeps the optimizer from writing them into each other.
        part = part.select("term", "fit", "fell", F.inline(F.array(F.struct("w", F.expr(shape("w", "")).alias("s")))))
        done = F.when(F.col("fit") & (F.col("fell") if k == MENDING else F.lit(True)), F.expr(step)).otherwise(F.col("w"))
        plain = part.select("term", "fit", F.inline(F.array(F.struct(done.alias("w")))))
    return plain.select("term", F.col("w").alias("stem"))


def _replaced(w: str, s: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    for suffix, end in rules:
        if w.endswith(suffix):
            begin = len(w) - len(suffix)
            fits = s[:begin].count("VC") > least and (suffix != "ion" or (len(w) > 3 and w[-4] in "st"))
            return w[:begin] + end if fits else w
    return w


def _kinds_of(w: str) -> str:
    s = w.translate(_LETTERS)
    if "y" in s:
        for _ in range(Y_ROUNDS):
            s = ("C" + s[1:] if s[0] == "y" else s).replace("Vy", "VC").replace("Cy", "CV")
    return s


def stem_of(word: str) -> str:
    """The stem of one word, as :func:`stems` gives it: for tasks that meet the words of a slice, so that no vocabulary is joined."""
    w = word
    if len(w) < 3 or not (w.isascii() and w.isalpha() and w.islower()):
        return w
    for suffix, end in _PLURALS:
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + end
            break
    s, fell = _kinds_of(w), False
    if w.endswith("eed"):
        w = w[:-1] if s[:-3].count("VC") > 0 else w
    elif w.endswith("ed") and "V" in s[:-2]:
        w, fell = w[:-2], True
    elif w.endswith("ing") and "V" in s[:-3]:
        w, fell = w[:-3], True
    s = _kinds_of(w)
    if fell:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and s.endswith("C") and w[-1] not in "lsz":
            w = w[:-1]
        elif s.count("VC") == 1 and s.endswith("CVC") and w[-1] not in "wxy":
            w += "e"
    if w.endswith("y") and "V" in _kinds_of(w)[:-1]:
        w = w[:-1] + "i"
    for rules, least in ((_SECOND, 0), (_THIRD, 0), (_FOURTH, 1)):
        if w.endswith(rules[0]):
            w = _replaced(w, _kinds_of(w), rules[1], least)
    if w.endswith("e"):
        s = _kinds_of(w)
        m = s[:-1].count("VC")
        if m > 1 or (m == 1 and not (s[:-1].endswith("CVC") and w[-2] not in "wxy")):
            w = w[:-1]
    if w.endswith("ll") and _kinds_of(w).count("VC") > 1:
        w = w[:-1]
    return w


def stems_sql(words: str) -> str:
    """CTEs ``st0`` to ``stems`` that give ``term, stem`` for the ``term`` of a table."""
    fell = "w LIKE '%+'"
    parts = [f"st0 AS MATERIALIZED (SELECT term, term AS w, regexp_matches(term, '^[a-z]+$') AND length(term) > 2 AS fit FROM {words})"]
    for k, step in enumerate(steps(", 'g'")):
        held = f"CASE WHEN fit{' AND fell' if k == MENDING else ''} THEN {step} ELSE w END"
        inner = f"SELECT term, fit, fell, w, {shape('w', ", 'g'")} AS s FROM (SELECT term, fit, {fell} AS fell, rtrim(w, '+') AS w FROM st{k})"
        parts.append(f"st{k + 1} AS MATERIALIZED (SELECT term, fit, {held} AS w FROM ({inner}))")
    return ",\n    ".join([*parts, f"stems AS MATERIALIZED (SELECT term, w AS stem FROM st{len(steps())})"])
