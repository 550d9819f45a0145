"""Text functions. All but the Unicode ones are JVM expressions; those work on Arrow batches."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation that the orthographic stage deletes, by set.
ASCII_PUNCT = string.punctuation
ARABIC_PUNCT = "،؛؟٫٬٪﴾﴿ـ«»"
CJK_PUNCT = "、。，．：；？！「」『』（）"
DEVANAGARI_PUNCT = "।॥"
PUNCTUATION = {"narrow": ASCII_PUNCT + ARABIC_PUNCT, "wide": ASCII_PUNCT + ARABIC_PUNCT + CJK_PUNCT + DEVANAGARI_PUNCT}

#: What str.split() takes as space; Java's \s alone is ASCII.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"


def tokenize(c: Column) -> Column:
    """Tokens between Unicode spaces, none empty; null has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda t: t != "")


def tokenize_at(c: Column, delimiter: str) -> Column:
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.filter(F.split(F.coalesce(c, F.lit("")), quoted), lambda t: t != "")


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores; combining marks end a word."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def edge_stripped(c: Column) -> Column:
    """Tokens without punctuation and symbols at their ends, case and inner signs kept, none empty."""
    return F.filter(F.transform(tokenize(c), lambda t: F.regexp_replace(t, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")), lambda t: t != "")


def orthographic(text: str | None, punctuation: str = "wide", turkish: bool = False) -> str:
    """NFKC, lower case, NFKD without combining marks, no punctuation, single spaces. The result isn't recomposed."""
    if not text:
        return ""
    text = unicodedata.normalize("NFKC", text)
    if turkish:
        text = text.replace("İ", "i").replace("I", "ı")
    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return " ".join(text.translate(dict.fromkeys(map(ord, PUNCTUATION[punctuation]))).split())


# Lower-case Latin-1 letters that decompose, and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"
#: Texts of these characters need no Unicode tables: compatibility characters of Latin-1 are left out.
PLAIN = r"^[\x00-\x7F¡«»¿À-ÖØ-öø-ÿ]*$"


def ortho_latin(c: Column, punctuation: str = "narrow") -> Column:
    """The orthographic stage for text of ASCII and precomposed Latin-1 letters, inside the JVM."""
    kept = F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED + PUNCTUATION[punctuation], UNACCENTED)
    return F.btrim(F.regexp_replace(kept, SPACE, " "))


def ortho(c: Column, punctuation: str = "wide", lang: Column | None = None) -> Column:
    """The orthographic stage as a column; where lang starts with tur or is tr, dotted and dotless i are kept apart.

    Texts that PLAIN describes stay in the JVM. The others go through the Unicode tables, on Arrow batches; the null that
    stands there for a plain text costs nothing.
    """
    turkish = F.lit(False) if lang is None else F.coalesce(lang.startswith("tur") | (lang == "tr"), F.lit(False))
    plain = c.isNull() | (~turkish & ((F.octet_length(c) == F.char_length(c)) | c.rlike(PLAIN)))

    @F.pandas_udf("string")
    def others(s: pd.Series, tr: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else orthographic(t, punctuation, x) for t, x in zip(s, tr, strict=True)], dtype=object)

    return F.coalesce(others(F.when(~plain, c), turkish), ortho_latin(c, punctuation))


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "İI", "iı"))


def on_types(tokens: Column, function: Callable[[str], str]) -> Column:
    """function over each distinct token of a batch once, for arrays of tokens."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}
        out = []
        for ts in s:
            for t in ts:
                if t not in seen:
                    seen[t] = function(t)
            out.append([seen[t] for t in ts])
        return pd.Series(out)

    return run(tokens)


def sentences(c: Column) -> Column:
    """Split after sentence ends that spaces follow; blank parts go, and a text without parts is one sentence."""
    parts = F.filter(F.split(F.trim(c), r"(?<=[.!?।؟])\s+"), lambda x: F.trim(x) != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def rejoined(parts: Column) -> Column:
    """array<struct<pos, part>> to the parts in order, joined by a space."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p.getField("part")), " ")


def clean_lemma(c: Column, lang: Column | None = None) -> Column:
    """Lower case without #; where lang is Arabic, also without the marks that NFKD takes apart."""
    clean = F.replace(F.lower(c), F.lit("#"), F.lit(""))
    if lang is None:
        return clean

    @F.pandas_udf("string")
    def bare(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))

    arabic = F.coalesce(lang.startswith("ar"), F.lit(False))
    return F.coalesce(bare(F.when(arabic, clean)), clean)


def valid_output(source: Column, made: Column) -> Column:
    """Not empty, and between 0.6 n - 1 and 1.4 n + 1 tokens, n the source's."""
    n, m = F.size(tokenize(source)), F.size(tokenize(made))
    return (F.trim(made) != "") & (m >= 0.6 * n - 1) & (m <= 1.4 * n + 1)


def first_line(c: Column) -> Column:
    return F.trim(F.split_part(F.btrim(c, F.lit(" \n\t\r")), F.lit("\n"), F.lit(1)))


def prompt(template: str, **fields: Column) -> Column:
    """The template with {name} filled in for each field; a null is empty."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def numbers(c: Column) -> Column:
    """Numbers as they are written, scientific notation included."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0))


def rounds_to(printed: Column, value: Column, digits: int) -> Column:
    """Whether value rounds to what is printed with so many digits, half a unit of the last one allowed."""
    return F.abs(printed - value) <= 0.5 * 10.0**-digits + 1e-12


def as_printed(printed: Column, value: Column) -> Column:
    """Whether value rounds to a number as it is written, at that precision; 1.2e-3 has digits down to 1e-4."""
    mantissa, exponent = F.regexp_extract(printed, r"^-?[0-9]+\.?([0-9]*)", 1), F.regexp_extract(printed, r"[eE]([+-]?[0-9]+)$", 1)
    unit = F.pow(F.lit(10.0), F.coalesce(F.try_to_number(F.ltrim(exponent, F.lit("+")), F.lit("S999")).cast("double"), F.lit(0.0)) - F.char_length(mantissa))
    return F.abs(printed.cast("double") - value) <= 0.5 * unit * (1 + 1e-9)


def p_text(p: Column) -> Column:
    """A p-value with three decimals, those below 0.001 as <0.001. The binary value is rounded, as SQL and printf do: 0.5065 is less than its digits say."""
    return F.when(p < 0.001, F.lit("<0.001")).otherwise(F.format_string("%.3f", F.round(p * 1000) / 1000))


def rouge1(candidate: Column, reference: Column) -> Column:
    """F1 of the words that two token arrays share, each as often as both have it; 0 where either is empty."""
    times = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    shared = F.aggregate(F.transform(F.array_distinct(F.array_intersect(candidate, reference)), lambda t: F.least(times(candidate, t), times(reference, t))), F.lit(0), lambda s, x: s + x)
    total = F.size(candidate) + F.size(reference)
    return F.when(total > 0, 2.0 * shared / total).otherwise(F.lit(0.0))
