"""Text columns: folding, tokens, keys, vintages, styles, countries, amounts, critics and display forms.

Column expressions throughout; accents are folded by a translation table, as
Spark has no Unicode decomposition.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from . import vocab
from .bind import let
from .vocab import WINE, Vocabulary

# Fixed values.
VINTAGE = r"(?<!\d)(19[5-9]\d|20[0-3]\d)(?!\d)"
VOLUME_CHUNK = r"(?i)\d+(?:[.,]\d+)?\s*(?:cl|ml|dl|liter|litre|lt|l)\b"
PACK_CHUNK = r"(?i)\b\d{1,3}\s*(?:er\b|[x×*])"
PERCENT = r"(?i)\d+(?:[.,]\d+)?\s*(?:%|vol\.?)"
SHORT_PARENTHESES = r"\(\s*[^\s)]+(?:\s+[^\s)]+)?\s*\)"


#: Blocks whose characters may decompose to ASCII: Latin letters with marks, superscripts, letter-like signs, ligatures, full-width forms.
FOLD_BLOCKS = ((0xA0, 0x250), (0x1D00, 0x1F00), (0x2070, 0x20A0), (0x2100, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))


def _fold_pairs() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one ASCII character and marks, and that character; and those that decompose to several."""
    src, dst, several = [], [], {}
    for low, high in FOLD_BLOCKS:
        for code in range(low, high):
            parts = unicodedata.normalize("NFKD", chr(code))
            base = "".join(c for c in parts if not unicodedata.combining(c))
            if base == chr(code) or not base.isascii() or not base.strip():
                continue
            if len(base) == 1:
                src.append(chr(code))
                dst.append(base)
            elif base.isalpha():
                several[chr(code)] = base
    return "".join(src), "".join(dst), several


FOLD_FROM, FOLD_TO, FOLD_MANY = _fold_pairs()


def strip_accents(text: Column) -> Column:
    """Letters without marks, and ``ss`` for sharp s; loose combining marks go too."""
    def spelt(t: Column) -> Column:
        out = t
        for sign, letters in FOLD_MANY.items():
            out = F.replace(out, F.lit(sign), F.lit(letters))
        return F.when(t.rlike("[" + "".join(FOLD_MANY) + "]"), out).otherwise(t)  # rare: most texts skip the replacements

    plain = F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), FOLD_FROM, FOLD_TO)
    return F.regexp_replace(let(plain, spelt), r"\p{Mn}+", "")


def fold(text: Column) -> Column:
    return strip_accents(F.lower(text))


def strip_alias(text: Column) -> Column:
    """Text without parentheses of 2 to 40 characters and at most two words."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?=\([^)]{2,40}\))" + SHORT_PARENTHESES, ""))


def extract_vintage(text: Column) -> Column:
    cleaned = F.regexp_replace(F.coalesce(text, F.lit("")), VOLUME_CHUNK, " ")
    return F.nullif(F.regexp_extract(cleaned, VINTAGE, 1), F.lit("")).cast("int")


def _has(words: Iterable[str], t: Column) -> Column:
    return F.array_contains(F.lit(sorted(words)), t)


def _split(text: Column) -> Column:
    t = fold(text)
    for pattern in (VOLUME_CHUNK, PACK_CHUNK, PERCENT, VINTAGE):
        t = F.regexp_replace(t, pattern, " ")
    t = F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    return F.filter(F.split(t, " "), lambda w: (w != "") & ~((F.length(w) > 3) & w.rlike(r"^\d+$")))


def tokenize(text: Column, v: Vocabulary = WINE, keep_alias: bool = False, keep_discriminating: bool = True) -> Column:
    """Words that carry identity, in order, with repeats."""
    raw = F.coalesce(text, F.lit("")) if keep_alias else strip_alias(text)
    critics = r"(?i)\b(?:" + "|".join(v.critics) + r")\s*[:\-]?\s*\d{1,3}(?:\s*(?:/|von)\s*100)?"
    drop = v.legal | v.producer | v.stop | v.packaging | (frozenset() if keep_discriminating else v.discriminating)
    return F.filter(_split(F.regexp_replace(raw, critics, " ")), lambda w: ~_has(drop, w))


def tokenize_keep_producer(text: Column, v: Vocabulary = WINE) -> Column:
    """The same with words for the business kept in place, parentheses and critics too."""
    return F.filter(_split(F.coalesce(text, F.lit(""))), lambda w: ~_has(v.legal | v.stop | v.packaging, w))


def is_distinctive(token: Column, v: Vocabulary = WINE) -> Column:
    return (F.length(token) > 2) & ~token.rlike(r"^\d+$") & ~_has(v.generic, token)


def distinctive_tokens(text: Column, v: Vocabulary = WINE) -> Column:
    return F.filter(tokenize(text, v), lambda w: is_distinctive(w, v))


def query_tokens(text: Column, v: Vocabulary = WINE) -> Column:
    return F.filter(tokenize(text, v, keep_alias=True), lambda w: is_distinctive(w, v) | _has(v.query_styles, w))


def build_query(text: Column, v: Vocabulary = WINE) -> Column:
    return F.array_join(F.slice(tokenize(text, v, keep_alias=True), 1, 10), " ")


def short_query(text: Column, v: Vocabulary = WINE) -> Column:
    """Query words cut to four, unless there are exactly five."""
    return let(query_tokens(text, v), lambda words: F.array_join(F.when(F.size(words) == 5, words).otherwise(F.slice(words, 1, 4)), " "))


def normalized_name(text: Column, v: Vocabulary = WINE) -> Column:
    return F.array_join(tokenize(text, v), " ")


def dedup_key(name: Column, vintage: Column, v: Vocabulary = WINE) -> Column:
    """Sorted tokens and vintage. Country names go if at least two distinctive words stay."""
    def core(words: Column) -> Column:
        bare = F.filter(words, lambda w: ~_has(v.countries, w))
        enough = lambda b: (F.size(b) < F.size(words)) & (F.size(F.filter(b, lambda w: is_distinctive(w, v))) >= 2)
        return let(bare, lambda b: F.when(enough(b), b).otherwise(words))

    sorted_core = F.array_sort(let(tokenize(name, v), core))
    return F.concat(F.array_join(sorted_core, " "), F.lit("|"), F.coalesce(vintage.cast("string"), F.lit("")))


def colour_group(token: Column, v: Vocabulary = WINE) -> Column:
    out = F.lit(None).cast("string")
    for group, words in reversed(v.colours):
        out = F.when(_has(words, token), group).otherwise(out)
    return out


def colour_from_text(text: Column, v: Vocabulary = WINE) -> Column:
    return let(fold(F.coalesce(text, F.lit(""))), lambda t: F.coalesce(*(F.when(t.contains(w), group) for group, words in v.compound_colours for w in words)))


def any_word(words: Iterable[str], edge: str = "a-z0-9") -> str:
    """Pattern that any of the words makes match, with no letter or digit beside it."""
    quoted = "|".join(w.replace(".", r"\.").replace("-", r"\-") for w in words)
    return f"(?<![{edge}])(?:{quoted})(?![{edge}])"


def wine_style(name: Column, type_id: Column | None = None, v: Vocabulary = WINE) -> Column:
    """Style by the source's type, else by name: sparkling, sweet and rosé before colours, colour words before grapes."""
    def decide(x: Column) -> Column:
        t, tokens = x["t"], x["tokens"]
        champagne = t.rlike(any_word(vocab.STYLE_WORDS["champagner"]))
        by_name = F.when(champagne, "champagner")
        for style in ("schaumwein", "suesswein", "rose"):
            by_name = by_name.when(t.rlike(any_word(vocab.STYLE_WORDS[style])), style)
        colour = F.struct(
            t.rlike(any_word(vocab.RED_WORDS)).alias("r"), t.rlike(any_word(vocab.WHITE_WORDS)).alias("w"), t.rlike(any_word(vocab.RED_NAMES)).alias("rn"),
            t.rlike(any_word(vocab.WHITE_NAMES)).alias("wn"), F.exists(tokens, lambda k: _has(vocab.RED_GRAPES, k)).alias("rg"), F.exists(tokens, lambda k: _has(vocab.WHITE_GRAPES, k)).alias("wg"))
        no_word = lambda c: ~c["r"] & ~c["w"]
        by_colour = let(colour, lambda c: F.when(c["r"] & ~c["w"], "rot").when(c["w"] & ~c["r"], "weiss").when(no_word(c) & c["rn"] & ~c["wn"], "rot")
                        .when(no_word(c) & c["wn"] & ~c["rn"], "weiss").when(c["rg"] & ~c["wg"], "rot").when(c["wg"] & ~c["rg"], "weiss").otherwise("unbekannt"))
        by_name = by_name.otherwise(by_colour)
        if type_id is None:
            return by_name
        told = F.lit(None).cast("string")
        for k, style in vocab.STYLE_BY_TYPE.items():
            told = F.when(type_id == k, style).otherwise(told)
        return F.coalesce(F.when((told == "schaumwein") & champagne, "champagner").otherwise(told), by_name)

    return let(F.struct(fold(F.coalesce(name, F.lit(""))).alias("t"), tokenize(name, v).alias("tokens")), decide)


def country(name: Column, region: Column | None = None, by_region: dict[str, str] = vocab.COUNTRY_BY_REGION) -> Column:
    """Country that a name states, else the one that a region implies, else ""."""
    texts = F.struct(fold(F.coalesce(name, F.lit(""))).alias("n"), fold(F.coalesce(region, F.lit("")) if region is not None else F.lit("")).alias("r"))

    def decide(t: Column) -> Column:
        named = [F.when(t["n"].rlike(any_word([w], "a-z")), label) for w, label in vocab.COUNTRY_LABELS.items()]
        implied = [F.when(t["r"].contains(w), label) for w, label in by_region.items()]
        return F.coalesce(*named, *implied, F.lit(""))

    return let(texts, decide)


def private_label(name: Column, brands: list[str]) -> Column:
    t = fold(F.coalesce(name, F.lit("")))
    return F.coalesce(*(F.when(t.contains(fold(F.lit(b))), True) for b in brands if b), F.lit(False))


def looks_like(name: Column, allow: list[str], deny: list[str], deny_endings: list[str] = (), exceptions: list[str] = ()) -> Column:
    """Whether a name has an allowed word and neither a denied one nor a denied ending; exceptions are taken out first."""
    t = fold(F.coalesce(name, F.lit("")))
    cleaned = F.regexp_replace(t, any_word(exceptions), " ") if exceptions else t
    bad = cleaned.rlike(any_word(deny)) if deny else F.lit(False)
    if deny_endings:
        bad = bad | cleaned.rlike("(?:" + "|".join(deny_endings) + r")(?![a-z0-9])")
    return (t.rlike(any_word(allow)) if allow else F.lit(True)) & ~bad


def parse_price(text: Column) -> Column:
    """The first amount, with apostrophes between thousands and comma or point before cents."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"\d{1,3}(?:['’]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?", 0)
    return F.regexp_replace(F.regexp_replace(F.nullif(found, F.lit("")), "['’]", ""), ",", ".").try_cast("double")


def critic_scores(text: Column, aliases: dict[str, str]) -> Column:
    """Map of critic to the highest of its ``<name> <n>/100`` scores from 50 to 100."""
    pattern = r"(?iu)([\p{L}][\p{L} .'&-]{1,40}?)\s*[:\-]?\s*(\d{2,3})\s*/\s*100"
    t = F.coalesce(text, F.lit(""))
    names, points = F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.regexp_extract_all(t, F.lit(pattern), F.lit(2))

    def key(name: Column) -> Column:
        return let(F.trim(fold(name)), lambda n: F.coalesce(*(F.when(n.endswith(a), k) for a, k in sorted(aliases.items(), key=lambda x: -len(x[0])))))

    pairs = F.filter(F.zip_with(names, points, lambda n, p: F.struct(key(n).alias("k"), p.cast("double").alias("p"))), lambda e: e["k"].isNotNull() & e["p"].between(50, 100))
    best = lambda ps, k: F.array_max(F.transform(F.filter(ps, lambda e: e["k"] == k), lambda e: e["p"]))
    return let(pairs, lambda ps: let(F.array_distinct(F.transform(ps, lambda e: e["k"])), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: best(ps, k)))))


def search_url(base: str, query: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(query))


def positive_number(text: Column) -> Column:
    """A number in a text, with comma or point and apostrophes; null if there is none or it is not above zero."""
    value = F.regexp_replace(F.regexp_replace(F.trim(text.cast("string")), "['’]", ""), ",", ".").try_cast("double")
    return F.when((value > 0) & (value < float("inf")), value)


def whole_number(text: Column) -> Column:
    """The whole part of a number in a text; null if there is none."""
    value = text.cast("string").try_cast("double")
    return F.when(F.abs(value) < 2.0**31, value.cast("int"))


def year(text: Column) -> Column:
    """A year of four digits; ``N.V.``, ``0`` and the like are null."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(r"^(?:19|20)\d{2}$"), t.try_cast("int"))


def format_number(x: Column) -> Column:
    """Two places without trailing zeros or point; null for null."""
    return F.when(x.isNotNull(), F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", ""))


def format_chf(x: Column) -> Column:
    return F.concat(F.lit("CHF "), F.replace(F.format_number(x, 2), F.lit(","), F.lit("'")))


def swiss_spelling(text: Column) -> Column:
    return F.replace(text, F.lit("ß"), F.lit("ss"))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def umlauts_to_vowels(text: Column) -> Column:
    """Folded text in which spelt-out umlauts are single vowels, so that both spellings meet."""
    t = fold(text)
    for a, b in (("ae", "a"), ("oe", "o"), ("ue", "u")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


# Fixed values.
COLOUR_WINE = r"(?:Rot|Weiss|Weiß|Ros[ée]|Schaum|Süss|Suess|Dessert)wein"
USUAL_SIZE = r"(?:0[.,]75\s*l|75\s*cl)"
NAME_NOISE = [
    rf"(?iu)\s*[–—-]\s*{COLOUR_WINE}\s*,\s*[^,(]+?\s*\(\s*{USUAL_SIZE}\s*\)\s*$",
    rf"(?iu)\s*[–—-]\s*{COLOUR_WINE}\s*,\s*[^,(]+?\s*$",
    rf"(?iu)\s*[–—-]\s*{COLOUR_WINE}\s*(?=\(|$)",
    rf"(?iu),?\s*\(?\s*{USUAL_SIZE}\s*\)?\s*$",
    r"\s*\((?:19|20)\d{2}\)",
]


def display_name(name: Column) -> Column:
    """A shop's name without colour, country, usual size and vintage, which stand beside it anyway."""
    out = F.coalesce(name, F.lit(""))
    for pattern in NAME_NOISE:
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(F.regexp_replace(out, r"\s{2,}", " "), r"^[ ,;–—-]+|[ ,;–—-]+$", "")


def format_date(at: Column) -> Column:
    return F.date_format(at, "d.M.yyyy")


def rating_text(value: Column, scale: float, count: Column) -> Column:
    """``3.6/5 (42)`` or ``89/100``; "" without a value."""
    shown = F.concat(F.format_string("%.1f" if scale <= 5 else "%.0f", value), F.lit(f"/{scale:.0f}"))
    return F.when(value.isNull(), "").when(F.coalesce(count, F.lit(0)) > 0, F.concat(shown, F.lit(" ("), count, F.lit(")"))).otherwise(shown)
