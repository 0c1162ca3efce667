"""Text scalars as Column expressions; Python only where Spark has no such function (NFKC, case folding)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.plans.session import ship

# Han ranges of the compact form and of the token estimate.
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"

# What marks text that addresses the reader's tools, and characters that hide or turn text.
INSTRUCTION_RISKS = {
    "override": r"(?i)\b(ignore|disregard|override)\b.{0,40}\b(previous|above|prior|earlier)\b.{0,40}\b(instruction|prompt|rule)s?",
    "role": r"(?i)\b(system prompt|developer message|you are now)\b",
    "chinese": r"忽略.{0,12}(指令|提示|规则)",
    "tool": r"(?i)<\s*/?\s*(system|assistant|tool)\s*>",
    "hidden": r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}]",
}


def squeeze(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode NFKC, row by row within Arrow batches; null stays null."""
    if session := SparkSession.getActiveSession():
        ship(session)
    return _nfkc(text)


def normalize_text(text: Column) -> Column:
    return squeeze(nfkc(text))


def compact_text(text: Column) -> Column:
    """Lower case, only letters a-z, digits and Han characters."""
    return F.regexp_replace(F.lower(text), f"[^0-9a-z{HAN}]+", "")


def article_label(text: Column) -> Column:
    """The first 第…条 (with 之…) of a text, or null."""
    found = F.regexp_extract(text, r"第[零〇一二三四五六七八九十百千万\d]+条(?:之[零〇一二三四五六七八九十百千万\d]+)?", 0)
    return F.when(found != "", found)


def estimate_tokens(text: Column) -> Column:
    """Han characters plus a quarter of the others, rounded up; null is 0."""
    text = F.coalesce(text, F.lit(""))
    han = F.length(F.regexp_replace(text, f"[^{HAN}]", ""))
    return (han + F.ceil((F.length(text) - han) / 4)).cast("long")


def terms(text: Column) -> Column:
    """Search terms of a text in reading order, repeated: words of letters and digits, and pairs of successive Han characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.concat(words, F.regexp_extract_all(low, F.lit(f"(?=([{HAN}]{{2}}))"), F.lit(1)))


def english_stem(word: Column) -> Column:
    """Plain suffix stripping: ies to y, then ing, ed, es, s, of words long enough."""
    return (
        F.when(word.rlike("^.{2,}ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("^.{3,}ing$"), F.regexp_replace(word, "ing$", ""))
        .when(word.rlike("^.{3,}(ed|es)$"), F.regexp_replace(word, "(ed|es)$", ""))
        .when(word.rlike("^.{3,}[^s]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def expanded_terms(text: Column) -> Column:
    """Distinct search terms of two or more characters, with what a reader may call them by.

    Words joined by hyphen, underscore or dot, whole and in their parts; parts of camel case; stems of the parts; pairs
    and triples of successive Han characters, and Han runs of up to twelve as they are. Null has none.
    """
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    grams = lambda n: F.regexp_extract_all(low, F.lit(f"(?=([{HAN}]{{{n}}}))"), F.lit(1))
    runs = F.filter(F.regexp_extract_all(low, F.lit(f"[{HAN}]+"), F.lit(0)), lambda r: F.length(r) <= 12)
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+(?:[-_.][A-Za-z0-9]+)*"), F.lit(0))
    camel = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[-_.]+", " "), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    parts = F.flatten(F.transform(tokens, lambda t: F.split(F.lower(camel(t)), " ")))
    every = F.concat(F.transform(tokens, F.lower), parts, F.transform(parts, english_stem), grams(2), grams(3), runs)
    return F.array_distinct(F.filter(every, lambda t: F.length(t) >= 2))


def target_anchors(text: Column) -> Column:
    """Distinct names in a query, lower case: two or more successive capitalised words, and words all in capitals."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Z][A-Za-z0-9]*(?: [A-Z][A-Za-z0-9]*)+|[A-Z]{2,}[A-Z0-9]*"), F.lit(0)), F.lower))


def identity_text(text: Column) -> Column:
    """Letters and digits only, NFKC, lower case: the same for spellings that differ in width, case and marks."""
    return F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}]+", "")


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no blanks; null for what isn't JSON, and for objects that name a key twice."""
    return F.to_json(F.try_parse_json(text))


def as_of_moment(text: Column) -> Column:
    """A day as its last second, other ISO-8601 times as they are: UTC seconds with Z; null if it is neither."""
    return canonical_timestamp(F.when(F.length(text) == 10, F.concat(text, F.lit("T23:59:59Z"))).otherwise(text))


# What must not leave by an answer: paths of a machine, secrets, hidden characters.
UNSAFE = {
    "local_path": r"(?:^|[\s\"'(])(?:/(?:home|Users|root|etc|var|tmp)/|[A-Za-z]:\\\\)",
    "secret": r"(?i)\b(?:api[_-]?key|secret|password|token)\b\s*[:=]\s*\S{8,}|-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "hidden": INSTRUCTION_RISKS["hidden"],
}


def unsafe_reasons(text: Column) -> Column:
    """Names of what makes a text unsafe to hand out, in fixed order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in UNSAFE.items()]))


def marker_places(text: Column, marker: Column) -> Column:
    """The 1-based places of ``marker`` in a short text; each character is looked at, so windows only."""
    n = F.length(text) - F.length(marker) + 1
    return F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.length(marker)) == marker)).otherwise(F.array().cast("array<int>"))


def quoted_phrases(text: Column, most: int = 8) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(r"[\"“「`]([^\"”」`]{1,200})[\"”」`]"), F.lit(1)), 1, most)


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and 24 hex digits of the SHA-256 of the parts joined by NUL; null parts read as empty."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24))


def risk_flags(text: Column) -> Column:
    """Names of the instruction risks that a text shows, in fixed order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in INSTRUCTION_RISKS.items()]))


def suspicious_layer(text: Column) -> Column:
    """Of 80 Han characters or more: blanks between Han of 15 % or replacement characters of 0.2 % and more."""
    han = F.length(F.regexp_replace(text, f"[^{HAN}]", ""))
    blanks = F.regexp_count(text, F.lit(rf"(?<=[{HAN}])\s+(?=[{HAN}])"))
    lost = F.regexp_count(text, F.lit("�"))
    return (han >= 80) & ((blanks / han >= 0.15) | (lost / F.length(text) >= 0.002))


def excerpt(text: Column, anchor: Column, most: int) -> Column:
    """Up to ``most`` characters around the first place of ``anchor``, with ellipses where text is left out."""
    at = F.greatest(F.lit(1), F.instr(F.lower(text), F.lower(anchor)) - most // 4)
    cut = F.substring(text, at, F.lit(most))
    return F.concat(F.when(at > 1, "…").otherwise(""), cut, F.when(at + most <= F.length(text), "…").otherwise(""))


def canonical_timestamp(text: Column) -> Column:
    """ISO-8601 with zone as UTC seconds with Z; null if it isn't one."""
    return F.date_format(F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
