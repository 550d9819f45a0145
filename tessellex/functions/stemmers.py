"""Stemmers from their published definitions: Porter's, and Snowball's for English, German, Spanish and, in snowball, eleven more languages."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import snowball


def _form(word: str) -> str:
    """The word as v and c; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _cvc(stem: str) -> bool:
    return _form(stem).endswith("cvc") and stem[-1] not in "wxy"


# The suffixes of steps 2, 3 and 4 of Porter's algorithm and what they become.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    """Porter's stemmer of 1980."""
    w = word.lower()
    if len(w) < 3:
        return w
    for s, r in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(s):
            w = w[: -len(s)] + r
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and "v" in _form(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _form(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _region(word: str, vowels: str) -> int:
    """Where the region after the first non-vowel behind a vowel starts."""
    m = re.search(f"[{vowels}][^{vowels}]", word)
    return m.end() if m else len(word)


def german(word: str) -> str:
    """The Snowball stemmer for German."""
    vowels = "aeiouyäöü"
    w = word.lower().replace("ß", "ss")
    w = re.sub(f"(?<=[{vowels}])u(?=[{vowels}])", "U", w)
    w = re.sub(f"(?<=[{vowels}])y(?=[{vowels}])", "Y", w)
    r1 = _region(w, vowels)
    r2 = r1 + _region(w[r1:], vowels)
    r1 = max(r1, 3)
    s = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1 and (s != "s" or len(w) > 1 and w[-2] in "bdfghklmnrt"):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = _longest(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1 and (s != "st" or len(w) > 5 and w[-3] in "bdfghklmnt"):
        w = w[: -len(s)]
    s = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2:
        cut = w[: -len(s)]
        if s in ("end", "ung"):
            w = cut[:-2] if cut.endswith("ig") and len(cut) - 2 >= r2 and not cut[:-2].endswith("e") else cut
        elif s in ("ig", "ik", "isch"):
            w = w if cut.endswith("e") else cut
        elif s in ("lich", "heit"):
            w = cut[:-2] if cut.endswith(("er", "en")) and len(cut) - 2 >= r1 else cut
        else:
            t = _longest(cut, ("lich", "ig"))
            w = cut[: -len(t)] if t and len(cut) - len(t) >= r2 else cut
    return w.translate(str.maketrans("UYäöü", "uyaou"))


# Words that the English Snowball stemmer treats by themselves, and its tables for steps 2 and 3.
ENGLISH_WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
ENGLISH_KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
ENGLISH_KEPT_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
ENGLISH2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": ""}
ENGLISH3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}


def _short_end(w: str) -> bool:
    return bool(re.search("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))


def english(word: str) -> str:
    """The Snowball stemmer for English."""
    w = word.lower()
    if len(w) < 3:
        return w
    if w in ENGLISH_WORDS:
        return ENGLISH_WORDS[w]
    if w in ENGLISH_KEPT:
        return w
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w.removeprefix("'"))
    head = next((h for h in ("gener", "commun", "arsen") if w.startswith(h)), None)
    r1 = len(head) if head else _region(w, "aeiouy")
    r2 = r1 + _region(w[r1:], "aeiouy")
    w = w.removesuffix("'").removesuffix("'s")
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in ENGLISH_KEPT_AFTER_1A:
        return w
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s and s.startswith("eed"):
        w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    elif s and re.search("[aeiouy]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    s = _longest(w, ENGLISH2)
    if s and len(w) - len(s) >= r1 and (s != "ogi" or w.endswith("logi")) and (s != "li" or w[-3:-2] and w[-3] in "cdeghkmnrt"):
        w = w[: -len(s)] + ENGLISH2[s]
    s = _longest(w, ENGLISH3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + ENGLISH3[s]
    s = _longest(w, [*STEP4, "ion"])
    if s and s != "ou" and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# The suffixes of the Spanish Snowball stemmer, by step.
ES_PRONOUN = "me se sela selo selas selos la le lo las les los nos".split()
ES_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
ES_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
ES_BECOME = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
ES_IDAD, ES_IVA = ["idad", "idades"], ["iva", "ivo", "ivas", "ivos"]
ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
ES_GU = ["en", "es", "éis", "emos"]
ES_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
ACUTE = str.maketrans("áéíóú", "aeiou")


def spanish(word: str) -> str:
    """The Snowball stemmer for Spanish."""
    v = "aeiouáéíóúü"
    w = word.lower()
    r1 = _region(w, v)
    r2 = r1 + _region(w[r1:], v)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in v:
            m = re.search(f"[{v}]", w[2:])
            rv = 2 + m.end() if m else len(w)
        elif w[0] in v:
            m = re.search(f"[^{v}]", w[2:])
            rv = 2 + m.end() if m else len(w)
        else:
            rv = 3
    s = _longest(w[rv:], ES_PRONOUN)
    if s:
        left = w[: -len(s)]
        accented = _longest(left[rv:], ("iéndo", "ándo", "ár", "ér", "ír"))
        if accented:
            w = left[: -len(accented)] + accented.translate(ACUTE)
        elif _longest(left[rv:], ("ando", "iendo", "ar", "er", "ir")) or left[rv:].endswith("yendo") and left.endswith("uyendo"):
            w = left
    done = False
    s = _longest(w, [*ES_PLAIN, *ES_IC, *ES_BECOME, "amente", "mente", *ES_IDAD, *ES_IVA])
    if s:
        left = w[: -len(s)]
        if s == "amente":
            if len(left) >= r1:
                w, done = left, True
                t = _longest(w, ("iv", "os", "ic", "ad"))
                if t and len(w) - 2 >= r2:
                    w = w[:-2]
                    if t == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                        w = w[:-2]
        elif len(left) >= r2:
            w, done = left + ES_BECOME.get(s, ""), True
            more = ("ic",) if s in ES_IC else ("ante", "able", "ible") if s == "mente" else ("abil", "ic", "iv") if s in ES_IDAD else ("at",) if s in ES_IVA else ()
            t = _longest(w, more)
            if t and len(w) - len(t) >= r2:
                w = w[: -len(t)]
    if not done:
        s = _longest(w[rv:], ES_Y)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s = _longest(w[rv:], [*ES_GU, *ES_VERB])
            if s:
                w = w[: -len(s)]
                if s in ES_GU and w.endswith("gu"):
                    w = w[:-1]
    s = _longest(w[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if s:
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(ACUTE)


BY_LANGUAGE: dict[str, Callable[[str], str]] = {
    "en": english, "de": german, "es": spanish, "fr": snowball.french, "it": snowball.italian, "pt": snowball.portuguese, "sv": snowball.swedish, "no": snowball.norwegian,
    "da": snowball.danish, "nl": snowball.dutch, "ru": snowball.russian, "fi": snowball.finnish, "hu": snowball.hungarian, "ro": snowball.romanian,
}
# Three-letter codes, as in names like fra_Latn, of the languages with a stemmer.
CODES = {"eng": "en", "deu": "de", "spa": "es", "fra": "fr", "ita": "it", "por": "pt", "swe": "sv", "nob": "no", "dan": "da", "nld": "nl", "rus": "ru", "fin": "fi", "hun": "hu", "ron": "ro"}
BY_LANGUAGE |= {code: BY_LANGUAGE[short] for code, short in CODES.items()}


def stemmer_of(lang: str | None) -> Callable[[str], str] | None:
    """By a two- or three-letter code, whatever script or region follows it; other languages' stemmers, as Bangla ones, are added to BY_LANGUAGE."""
    return BY_LANGUAGE.get(re.split("[_-]", lang)[0]) if lang else None


def stem_column(token: Column, lang: Column) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([f(w) if (f := stemmer_of(c)) else w for w, c in zip(t, code, strict=True)], dtype=object)

    return run(token, lang)


def stem_arrays(tokens: Column, lang: Column) -> Column:
    """Stems of arrays of tokens; each distinct token and language of a batch once."""

    @F.pandas_udf("array<string>")
    def run(t: pd.Series, code: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], str] = {}
        out = []
        for ts, c in zip(t, code, strict=True):
            f = stemmer_of(c)
            for w in ts if f else ():
                if (c, w) not in seen:
                    seen[c, w] = f(w)
            out.append([seen[c, w] for w in ts] if f else list(ts))
        return pd.Series(out)

    return run(tokens, lang)
