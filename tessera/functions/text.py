"""Text and scalar functions as column expressions; a pandas UDF only where Spark has no builtin."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The intent vocabulary, and the pattern of decades in a request.
INTENT_TERMS = (
    "acoustic", "afrobeat", "ambient", "blues", "christmas", "classical", "country", "dance", "disco", "drill", "drum and bass", "edm",
    "electronic", "folk", "funk", "gospel", "grunge", "hip hop", "house", "indie", "jazz", "k pop", "latin", "metal", "opera", "piano",
    "pop", "punk", "r b", "rap", "reggae", "rock", "salsa", "soul", "techno", "trap", "workout", "party", "romantic", "sad", "happy",
    "chill", "relaxing", "energetic", "upbeat", "focus", "sleep", "summer",
)
DECADES = r"\b(?:19[5-9]0|20[0-2]0)s?\b|\b[5-9]0s\b|\b(?:00s|2000s|2010s|2020s)\b"
#: Letters with accents and the letters without.
ACCENTED, PLAIN = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"

WORD = r"[\p{L}\p{N}_]{2,}"


def norm_name(c: Column) -> Column:
    """Lower case, runs of other than word characters as one space, trimmed. See norm_name_exact for compatibility forms."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


@F.pandas_udf(T.StringType())
def norm_name_exact(names: pd.Series) -> pd.Series:
    """As norm_name, after NFKC and with full case folding."""

    def one(x: str | None) -> str | None:
        return None if x is None else " ".join(re.sub(r"\W+", " ", unicodedata.normalize("NFKC", x).casefold()).split())

    return names.map(one)


def as_list(c: Column, is_array: bool) -> Column:
    """A null gives an empty array, a scalar an array of one."""
    return F.coalesce(c, F.array()) if is_array else F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))


def first_text(c: Column) -> Column:
    """First element that isn't empty, or the empty string."""
    return F.coalesce(F.get(F.filter(c, lambda x: x != ""), F.lit(0)), F.lit(""))


def parse_year(c: Column) -> Column:
    """The first four characters, if digits, else 0."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, "^([0-9]{4})", 1), F.lit("")), F.lit("9999")).cast("int"), F.lit(0))


def token_set(c: Column) -> Column:
    """Distinct ASCII tokens in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def plain(c: Column) -> Column:
    """Lower case without the accents of ACCENTED."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _field(value: Column, is_array: bool) -> Column:
    return F.array_join(value, ", ") if is_array else value.cast("string")


def field_text(fields: dict[str, tuple[Column, bool]]) -> Column:
    """`field: value` lines, lists joined by commas, in lower case; fields that are null are left out."""
    return F.lower(F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), _field(v, a)) for k, (v, a) in fields.items()]))


def metadata_text(track_id: Column, fields: dict[str, tuple[Column, bool]]) -> Column:
    """`track_id: ..., field: ...` over the fields that are not null."""
    return F.concat_ws(", ", F.concat(F.lit("track_id: "), track_id.cast("string")), *[F.concat(F.lit(f"{k}: "), _field(v, a)) for k, (v, a) in fields.items()])


def dialogue(messages: Column) -> Column:
    """`role: content` lines of an array of (role, content); music speaks as the assistant."""
    line = lambda m: F.concat(F.when(m["role"] == "music", F.lit("assistant")).otherwise(m["role"]), F.lit(": "), m["content"])
    return F.array_join(F.transform(messages, line), "\n")


def present(c: Column, *names: str) -> dict[str, Column]:
    """Fields of a struct that may be missing as texts, empty where it or they are."""
    return {n: F.coalesce(c[n].cast("string"), F.lit("")) for n in names}


def track_sentence(title: Column, artist: Column, album: Column) -> Column:
    return F.concat(title, F.lit(" by "), artist, F.lit(" from "), album)


def intent_terms(c: Column) -> Column:
    """Vocabulary terms in vocabulary order, then decades in text order; the alias r&b follows r b."""
    text = norm_name(c)
    known = F.array_compact(F.array(*[F.when(text.rlike(rf"\b{t}\b"), F.lit(t)) for t in INTENT_TERMS]))
    decades = F.regexp_extract_all(text, F.lit(DECADES), F.lit(0))
    alias = F.when(F.array_contains(known, "r b"), F.array(F.lit("r&b"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(known, decades, alias))


def isrc_country(c: Column) -> Column:
    own = F.upper(F.trim(c))
    return F.when((F.length(own) >= 7) & F.substring(own, 6, 2).rlike("^[0-9]{2}$"), F.substring(own, 1, 2)).otherwise(F.lit(""))


def isrc_year(c: Column) -> Column:
    """Two digits at the sixth place: under 30 in this century, else in the last; 0 where there are none."""
    own = F.upper(F.trim(c))
    yy = F.when((F.length(own) >= 7) & F.substring(own, 6, 2).rlike("^[0-9]{2}$"), F.substring(own, 6, 2).cast("int"))
    return F.coalesce(F.when(yy < 30, yy + 2000).otherwise(yy + 1900), F.lit(0))


def char_bucket(c: Column, buckets: int = 64) -> Column:
    """Sum of place times code point, modulo the buckets, plus 1; 0 for the empty string."""
    total = F.aggregate(F.transform(F.split(c, ""), lambda x, i: (i + 1) * F.coalesce(F.ascii(x), F.lit(0))), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(F.coalesce(c, F.lit(""))) == 0, F.lit(0)).otherwise(total % buckets + 1)


def duration_bucket(ms: Column) -> Column:
    steps = F.when(ms <= 0, 0)
    for bucket, minutes in ((1, 1), (2, 3), (3, 5), (4, 10)):
        steps = steps.when(ms < minutes * 60_000, bucket)
    return steps.otherwise(5)


def signature(messages: Column) -> Column:
    """A hash of (role, turn, text) of all messages, the content of music masked."""
    masked = F.transform(messages, lambda m: F.concat_ws("|", m["role"], m["turn"].cast("string"), F.when(m["role"] == "music", F.lit("<music>")).otherwise(squeeze(m["content"]))))
    return F.sha2(F.array_join(masked, "\n").cast("binary"), 256)


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs, joined by a space."""
    pair = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(tokens) < 2, F.array().cast("array<string>")).otherwise(pair)


def discount(rank: Column, k: int | None = None) -> Column:
    """1 / log2(rank + 1) down to rank k, else 0; 0 without a rank."""
    value = F.lit(1.0) / F.log2(rank + 1)
    inside = rank.isNotNull() if k is None else rank.isNotNull() & (rank <= k)
    return F.when(inside, value).otherwise(F.lit(0.0))


def after_think(c: Column) -> Column:
    """What follows the last </think>, trimmed."""
    return F.trim(F.substring_index(c, "</think>", -1))


def quantised(c: Column, steps: float = 1e4) -> Column:
    """Rounded half up to a fixed step, alike on every engine."""
    return F.floor(c * steps + 0.5) / steps


def progress_text(turn: Column, total: Column) -> Column:
    """How far a conversation has come, empty where it is not known."""
    return F.coalesce(F.format_string("turn %d of %d", turn.cast("int"), total.cast("int")), F.lit("")) if total is not None else F.lit("")


def prompt(history: Column, tracks: Column, profile: Column, goal: Column, progress: Column | None = None) -> Column:
    """The blocks of a response prompt that are present, each under its heading."""
    block = lambda title, c: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.concat(F.lit(f"[{title}]\n"), c))
    more = [] if progress is None else [block("progress", progress)]
    return F.concat_ws("\n\n", block("profile", profile), block("goal", goal), *more, block("dialogue", history), block("tracks", tracks))


@lru_cache(maxsize=1)
def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies print for bytes, printable Latin-1 characters for themselves, the others from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def repair(text: str) -> str:
    """Byte letters back to the bytes that they stand for, other characters as they are, read as UTF-8; what is not valid becomes U+FFFD."""
    letters = _byte_letters()
    return b"".join(bytes([letters[c]]) if c in letters else c.encode() for c in text).decode(errors="replace")


@F.pandas_udf(T.StringType())
def byte_repair(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else repair(x))
