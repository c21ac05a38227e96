"""Text normalisation as Column expressions (JVM side unless noted)."""

from __future__ import annotations

import functools
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.binding import bind

# Letters that Unicode does not decompose, with their ASCII spelling.
_PLAIN = {
    "Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h",
    "Ŧ": "T", "ŧ": "t", "ı": "i", "Ð": "D", "ð": "d", "ĸ": "q", "ŋ": "n", "Ŋ": "N",
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-",
}
_EXPANDED = {
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "ẞ": "SS", "Þ": "TH",
    "þ": "th", "Ĳ": "IJ", "ĳ": "ij",
}


@functools.cache
def _fold_pairs() -> tuple[str, str]:
    """One-to-one fold table, derived from Unicode decomposition by rule."""
    source, target = [], []
    for code in range(0x80, 0x2200):
        char = chr(code)
        plain = _PLAIN.get(char)
        if plain is None and char not in _EXPANDED and char.isalpha():
            base = [c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)]
            if len(base) == 1 and base[0].isascii():
                plain = base[0]
        if plain is not None:
            source.append(char)
            target.append(plain)
    return "".join(source), "".join(target)


def fold(col: Column, unknown: str = "drop") -> Column:
    """ASCII folding.

    ``unknown``: ``drop`` removes characters without an ASCII form, ``keep`` leaves
    them, ``same_length`` also leaves the letters that would expand to two.
    """
    return _fold_rest(F.translate(col, *_fold_pairs()), unknown)


def clean(col: Column) -> Column:
    """Whole texts folded, lower-cased and with single spaces; each step only where a text needs it."""
    plain = bind(F.translate(col, *_fold_pairs()), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(_fold_rest(t, "drop")))
    return bind(F.lower(plain), lambda t: F.when(F.contains(t, F.lit("  ")), collapse_spaces(t)).otherwise(t))


def _fold_rest(out: Column, unknown: str) -> Column:
    """What folding does after the letters with one-letter forms."""
    if unknown != "same_length":
        for char, text in _EXPANDED.items():
            out = F.replace(out, F.lit(char), F.lit(text))
    if unknown == "drop":
        out = F.regexp_replace(out, r"[^\x00-\x7F]", "")
    elif unknown not in ("keep", "same_length"):
        raise ValueError(f"unknown folding mode: {unknown}")
    return out


PIECE_TEXTS = 64  # texts that a task decomposes at once


@F.arrow_udf(T.StringType())
def strip_accents(texts: pa.Array) -> pa.Array:
    """Compatibility decomposition, then ASCII only (no built-in does NFKD)."""

    def plain(piece: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii") for t in piece.to_pylist()], pa.string())

    return pa.concat_arrays([plain(texts.slice(at, PIECE_TEXTS)) for at in range(0, max(1, len(texts)), PIECE_TEXTS)])


def collapse_spaces(col: Column) -> Column:
    return F.regexp_replace(col, " {2,}", " ")


def contiguous(col: Column) -> Column:
    """Text variant with line breaks as spaces."""
    return F.regexp_replace(col, "\r\n|\n|\r", " ")


def tag(col: Column) -> Column:
    """Free text to tag; repeated ``-`` stay, as the space collapse comes last."""
    out = F.lower(fold(col, "keep"))
    out = F.replace(out, F.lit(" & "), F.lit("-"))
    out = F.regexp_replace(F.translate(out, " '.", "---"), "[!?]", "")
    return F.regexp_replace(collapse_spaces(out), "^-+|-+$", "")


def store_tag(col: Column) -> Column:
    return F.translate(F.replace(F.lower(col), F.lit(" & "), F.lit("-")), " '", "--")


# --- fixed values: characters that become "-" in a taxonomy tag
_TAG_SYMBOLS = "¢£¤¥§©ª®°²³µ¶¹º¼½¾×‰€™"
_TAG_PUNCTUATION = (
    r"""!"#$%&'()*+,/:;<=>?@\[\\\]^_`{|}~¡¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿×ˆ˜–—‘’‚“”„†‡•…‰‹›€™"""
)


def taxonomy_tag(col: Column, lowercase: bool = True) -> Column:
    """Free text to the tag form used inside taxonomies."""
    out = F.translate(col, _TAG_SYMBOLS, "-" * len(_TAG_SYMBOLS))
    out = F.translate(out, "éèàù", "eeau")
    out = F.regexp_replace(out, r"(?U)&\w+;", "-")
    out = F.regexp_replace(out, rf"(?U)[\s{_TAG_PUNCTUATION}]", "-")
    if lowercase:
        out = F.lower(out)
    return F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-+|-+$", "")


def emb_code(col: Column) -> Column:
    """Packager codes compared without case, blanks, dots and with CE as EC."""
    out = F.regexp_replace(F.lower(F.trim(col)), "[ .-]", "")
    out = strip_accents(out)
    return F.regexp_replace(out, "ce$", "ec")


def is_prefixed(col: Column) -> Column:
    return (F.length(col) > 3) & (F.substring(col, 3, 1) == ":")


def valid_lang(col: Column) -> Column:
    return F.coalesce(col.rlike(r"^\p{L}{2}$"), F.lit(False))


def word_pattern(body: str) -> str:
    """Alternation guarded against neighbouring word characters."""
    return rf"(?iuU)(?<!\w)(?:{body})(?!\w)"
