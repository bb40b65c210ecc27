"""Text column expressions (JVM-side built-ins only).

Every function returns a ``Column`` so it stays inside whole-stage codegen or
Spark's interpreted higher-order functions; nothing here runs per row in
Python.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the behaviour being reproduced.
# ---------------------------------------------------------------------------
# Token pattern of the TF-IDF vectoriser: runs of two or more word characters
# (letters, digits, underscore in any script).
TOKEN_PATTERN = r"([\p{L}\p{N}_]{2,})"
# Default filter characters of the sequence tokenizer; each becomes a space.
SEQUENCE_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
# Out-of-vocabulary token of the sequence tokenizer (id 1).
OOV_TOKEN = "<OOV>"
# Integer-encoded reviews: 1 = start marker, 2 = out-of-vocabulary, words from 3.
START_ID = 1
OOV_ID_ENCODED = 2
INDEX_FROM = 3
# Placeholder for ids without a word when decoding.
UNKNOWN_WORD = "?"
# Length of a text preview.
PREVIEW_CHARS = 120
# ---------------------------------------------------------------------------


# Hangul syllables decompose by arithmetic: first code point, last one, and the
# leading, vowel and trailing letters.
SYLLABLES = (0xAC00, 0xD7A3)
# Characters below this one take the short accent map.
NEAR = 0x250
LEADING = "".join(map(chr, range(0x1100, 0x1113)))
VOWELS = "".join(map(chr, range(0x1161, 0x1176)))
TRAILING = "".join(map(chr, range(0x11A8, 0x11C3)))


def _without_marks(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def accent_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to, longer).  ``translate`` strings for the characters whose
    compatibility decomposition without combining marks is one other character,
    followed by those of which nothing is left (deleted: they have no
    counterpart); and the characters that become several ones, syllables apart.
    Generated from ``unicodedata`` for all of Unicode."""
    src, dst, gone, longer = [], [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or SYLLABLES[0] <= cp <= SYLLABLES[1]:
            continue
        ch = chr(cp)
        base = _without_marks(ch)
        if not base:
            gone.append(ch)
        elif len(base) > 1:
            longer[ch] = base
        elif base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src + gone), "".join(dst), longer


def lowercase(c: Column) -> Column:
    return F.lower(c)


def _syllable(ch: Column) -> Column:
    n = F.ascii(ch) - F.lit(SYLLABLES[0])
    each = len(VOWELS) * (len(TRAILING) + 1)

    def letter(letters: str, at: Column) -> Column:
        return F.substr(F.lit(letters), (at + 1).cast("int"), F.lit(1))

    trail = n % (len(TRAILING) + 1)
    return F.concat(letter(LEADING, F.floor(n / each)), letter(VOWELS, F.floor(n % each / (len(TRAILING) + 1))),
                    F.when(trail > 0, letter(TRAILING, trail - 1)).otherwise(F.lit("")))


@lru_cache(maxsize=1)
def near_tables() -> tuple[str, str, str]:
    """(from, to, other): the part of ``accent_tables`` below ``NEAR`` (Latin with all
    its European letters), and the characters there that become several ones."""
    src, dst, longer = accent_tables()
    pairs = [(a, b) for a, b in zip(src, dst) if ord(a) < NEAR]
    gone = [a for a in src[len(dst):] if ord(a) < NEAR]
    return "".join(a for a, _ in pairs) + "".join(gone), "".join(b for _, b in pairs), "".join(a for a in longer if ord(a) < NEAR)


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks.

    A text of characters below ``NEAR`` takes one ``translate`` with a short map; one
    pass over a range class tells.  Only the others meet the tables of all of
    Unicode, whose character class a matcher goes through for each character."""
    src, dst, other = near_tables()
    far = c.rlike(f"[^\\x00-\\x{{{NEAR - 1:x}}}]|[{other}]")
    return F.when(~far, F.translate(c, src, dst)).otherwise(_strip_any(c))


def _strip_any(c: Column) -> Column:
    """Characters that become several ones are rare: only texts that hold one
    are taken apart."""
    src, dst, longer = accent_tables()
    one = F.translate(c, src, dst)
    keys, values = "".join(longer), F.split(F.lit("\t".join(longer.values())), "\t")

    def expanded(ch: Column) -> Column:
        known = F.try_element_at(values, F.nullif(F.instr(F.lit(keys), ch), F.lit(0)))
        return (F.when(ch < F.lit("\x80"), ch)
                .when(ch.between(*map(chr, SYLLABLES)), _syllable(ch)).otherwise(F.coalesce(known, ch)))

    holds = one.rlike(f"[{keys}{chr(SYLLABLES[0])}-{chr(SYLLABLES[1])}]")
    return F.when(holds, F.array_join(F.transform(F.split(one, ""), expanded), "")).otherwise(one)


def normalise(c: Column) -> Column:
    """Lower-case, then strip accents (the vectoriser's preprocessing order).

    A text whose UTF-8 byte length equals its character length is pure ASCII
    and holds no character of the accent map, so the per-character map look-up
    is skipped for it (``octet_length`` is constant time).  ``c`` should be a
    column reference: it is evaluated in the condition and in the branch."""
    low = F.lower(c)
    return F.when(F.octet_length(c) == F.length(c), low).otherwise(strip_accents(low))


def clean_text(c: Column, null_token: str | None = None) -> Column:
    """Text as string; a missing text becomes '' (or ``null_token``)."""
    return F.coalesce(c.cast("string"), F.lit(null_token if null_token is not None else ""))


def word_tokens(c: Column) -> Column:
    """ARRAY<STRING> of word tokens of an already normalised text."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 1)


def separator_class(filters: str = SEQUENCE_FILTERS) -> str:
    """Java regex character class matching every filter character and the
    space."""
    return "[" + "".join("\\" + ch if ch in "\\[]^-&" else ch for ch in filters + " ") + "]"


def sequence_words(c: Column, filters: str = SEQUENCE_FILTERS) -> Column:
    """Words of the sequence tokenizer: lower-case, filter characters to
    spaces, split on spaces, empty pieces dropped.  Splitting directly on the
    class of filter characters and space gives the same pieces without a
    per-character ``translate``."""
    return F.filter(F.split(F.lower(c), separator_class(filters)), lambda w: w != "")


def pad_ids(ids: Column, length, value: int = 0) -> Column:
    """Post-pad with ``value`` and post-truncate to exactly ``length``."""
    length_col = length if isinstance(length, Column) else F.lit(length)
    return F.slice(F.concat(ids, F.array_repeat(F.lit(value), length_col)), 1, length_col)


def attention_mask(ids: Column, length) -> Column:
    """1 for real positions, 0 for padding, exactly ``length`` entries."""
    length_col = length if isinstance(length, Column) else F.lit(length)
    real = F.least(F.size(ids), length_col)
    return F.transform(F.sequence(F.lit(1), length_col), lambda i: F.when(i <= real, 1).otherwise(0))


def preview(c: Column, n: int = PREVIEW_CHARS) -> Column:
    return F.substring(c, 1, n)


def short_name(c: Column) -> Column:
    """Text before the first '-'."""
    return F.split_part(c, F.lit("-"), F.lit(1))


def safe_name(c: Column) -> Column:
    """Path-safe model name: '/' becomes '_'."""
    return F.replace(c, F.lit("/"), F.lit("_"))


def checkpoint_step(path: Column) -> Column:
    """Numeric N of a trailing 'checkpoint-N' (NULL when absent)."""
    return F.nullif(F.regexp_extract(path, r"checkpoint-(\d+)$", 1), F.lit("")).try_cast("long")
