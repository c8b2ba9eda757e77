"""Name normalisers and text features, all as Catalyst expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that do not decompose into base letter + accent.
_EXPANSIONS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
_SINGLE = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "ð": "d", "ŧ": "t"}

# Romanisation of Greek and Cyrillic letters without accents, in the order of the alphabets.
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
_CYRILLIC = dict(zip("абвгдежзиклмнопрстуфхцчшщыэюяіјљњћџѓќ", "a b v g d e zh z i k l m n o p r s t u f kh ts ch sh shch y e iu ia i j lj nj c dz g k".split(), strict=True)) | {"ъ": "", "ь": ""}
# Hiragana by consonant, in the order a i u e o, and the syllables that do not follow their row.
_KANA = {"": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの",
         "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "r": "らりるれろ"}
_IRREGULAR = {"し": "shi", "じ": "ji", "ち": "chi", "ぢ": "ji", "つ": "tsu", "づ": "zu", "ふ": "fu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "wo", "ん": "n", "ゔ": "vu", "ー": ""}

_SPACES = r"(?U)\s+"


def _romanisation() -> dict[str, str]:
    """Letters and two-letter kana syllables of other scripts (lower case, katakana as hiragana) and their Latin form."""
    kana = {k: c + v for c, row in _KANA.items() for k, v in zip(row, "aiueo", strict=True)} | _IRREGULAR
    kana |= dict(zip("ぁぃぅぇぉゃゅょ", ["a", "i", "u", "e", "o", "ya", "yu", "yo"], strict=True))
    for syllable in [k for k, v in kana.items() if v.endswith("i") and len(v) > 1 and k not in "ぃ"]:
        head = kana[syllable][:-1]
        glide = "" if head in ("sh", "ch", "j") else "y"
        kana |= {syllable + small: head + glide + vowel for small, vowel in zip("ゃゅょ", "auo", strict=True)}
    plain = _GREEK | _CYRILLIC
    accented = {}
    for code in [*range(0x0386, 0x03CF), *range(0x0400, 0x0460), *range(0x1F00, 0x2000)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base in plain:
            accented[chr(code)] = plain[base]
    return kana | accented | plain


def _accent_table() -> tuple[str, str]:
    """Lower-case accented Latin letters and their base letters, by Unicode decomposition."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter == letter.lower() and base != letter and base.isascii() and base.isalpha():
            source.append(letter)
            target.append(base)
    for letter, base in _SINGLE.items():
        source.append(letter)
        target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _BASE = _accent_table()
_ROMAN = _romanisation()
_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F5)))
_HIRAGANA = "".join(chr(ord(c) - 0x60) for c in _KATAKANA)
_OTHER_SCRIPTS = "[\u0370-\u03ff\u1f00-\u1fff\u0400-\u045f\u3041-\u3094\u30a1-\u30fc]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def romanise(c: Column | str) -> Column:
    """Greek, Cyrillic and kana in Latin letters, by the longest match of each syllable; names without them pass as they are."""
    text = _col(c)
    pairs = [F.lit(x) for pair in _ROMAN.items() for x in pair]
    syllables = F.regexp_extract_all(F.translate(text, _KATAKANA, _HIRAGANA), F.lit("(?s)([\u3041-\u3094][\u3083\u3085\u3087]|.)"), F.lit(1))
    table = F.create_map(*pairs)
    # a syllable that is no pair of the table is read letter by letter
    letters = lambda x: F.array_join(F.transform(F.split(x, ""), lambda y: F.coalesce(F.element_at(table, y), y)), "")
    latin = F.array_join(F.transform(syllables, lambda x: F.coalesce(F.element_at(table, x), letters(x))), "")
    doubled = F.regexp_replace(F.regexp_replace(latin, "\u3063(?=ch)", "t"), "\u3063([a-z])", "$1$1")
    return F.when(text.rlike(_OTHER_SCRIPTS), doubled).otherwise(text)


def transliterate(c: Column | str) -> Column:
    """Lower-case letters to plain Latin ones: accents are dropped, Greek, Cyrillic and kana romanised, the rest is kept."""
    out = F.regexp_replace(F.translate(romanise(c), _ACCENTED, _BASE), r"\p{Mn}+", "")
    for letter, text in _EXPANSIONS.items():
        out = F.replace(out, F.lit(letter), F.lit(text))
    return out


def simple_name(c: Column | str) -> Column:
    """Lower case, one blank between words, no outer blanks; missing becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(_col(c)), _SPACES, " ")), F.lit(""))


def full_name(c: Column | str) -> Column:
    """``simple_name`` after transliteration and with punctuation read as blanks."""
    plain = F.regexp_replace(transliterate(F.lower(_col(c))), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.coalesce(F.trim(F.regexp_replace(plain, _SPACES, " ")), F.lit(""))


def clean_name(c: Column | str) -> Column:
    """Lower case without brackets, transliterated."""
    bare = F.regexp_replace(F.trim(F.lower(_col(c))), r"[()\[\]{}]+", "")
    return F.lower(transliterate(F.regexp_replace(bare, _SPACES, " ")))


def sorted_words(c: Column | str) -> Column:
    """The words of a normalised name in alphabetical order."""
    words = F.filter(F.split(_col(c), " "), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def pipe_concat(left: Column | str, right: Column | str) -> Column:
    """``left|right`` without leading or trailing pipes; missing sides count as ''."""
    joined = F.concat(F.coalesce(_col(left), F.lit("")), F.lit("|"), F.coalesce(_col(right), F.lit("")))
    return F.btrim(joined, F.lit("|"))


# Keyword families of the three flag groups.
GENRE_KEYWORDS = {
    "rock": ["rock", "alt", "grunge", "punk"],
    "electronic": ["edm", "techno", "house", "trance"],
    "hip_hop": ["hip-hop", "rap"],
    "classical": ["classical", "opera"],
    "metal": ["metal", "hardcore"],
}
MOOD_KEYWORDS = {
    "happy": ["happy", "party"],
    "sad": ["sad", "melancholy"],
    "chill": ["chill", "ambient"],
    "energetic": ["energy", "dance"],
}
GEO_KEYWORDS = {
    "british": ["british", "uk"],
    "latin": ["latin", "latino", "salsa"],
    "asian": ["j-pop", "k-pop", "mandopop"],
}
FLAG_GROUPS = {"genre": GENRE_KEYWORDS, "mood": MOOD_KEYWORDS, "geo": GEO_KEYWORDS}


def keyword_flags(c: Column | str, groups: dict[str, dict[str, list[str]]] | None = None) -> dict[str, Column]:
    """One 0/1 column per keyword family; keywords match anywhere, in any case."""
    text = F.lower(_col(c))
    flags = {}
    for group, families in (groups or FLAG_GROUPS).items():
        for family, words in families.items():
            hit = F.lit(False)
            for word in words:
                hit = hit | F.contains(text, F.lit(word))
            flags[f"{group}_{family}"] = F.coalesce(hit, F.lit(False)).cast("int")
    return flags


def safe_user_id(c: Column | str) -> Column:
    """Letters, digits, '-' and '_' of an id."""
    return F.regexp_replace(_col(c), r"[^\p{L}\p{N}_-]", "")
