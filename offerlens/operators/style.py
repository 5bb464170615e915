"""Style type of an item: hard signals first, then an origin that says nothing, then measured taste."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from ..functions.bind import let
from ..functions.prices import number
from ..functions.text import any_word, umlauts_to_vowels

# Fixed values.
SUGAR_SWEET, SUGAR_DRY, ACID_FIRM, ALCOHOL_SWEET = 5.0, 2.0, 5.5, 15.0
NORMAL = {"sweetness": 1.77, "tannin": 3.33, "acidity": 3.39}
WEIGHTS = {"sweetness": 0.5, "tannin": -0.3, "acidity": -0.2}
CUTS = [(0.40, "fruchtsuess"), (0.10, "weich_modern"), (-0.10, "ausgewogen")]
LOWEST = "straff_herb"
MIN_JUDGMENTS = 15
SUGAR = r"(?i)(?:restzucker|zucker|residual\s*sugar|rs)\D{0,12}?(\d{1,3}(?:[.,]\d)?)\s*g"
ACID = r"(?i)(?:gesamts|s)aure\D{0,12}?(\d{1,2}(?:[.,]\d)?)\s*g"
ALCOHOL = r"(?i)(\d{1,2}(?:[.,]\d)?)\s*%\s*(?:vol|alk)"
BLENDS = ["cuvee", "red blend", "white blend"]
ORDINAL = ["fruchtsuess", "weich_modern", "ausgewogen", "straff_herb", "unbekannt"]


@dataclass
class Lists:
    """Word lists of the cascade, read from the user's file."""

    sweet: list[str] = field(default_factory=list)
    brands: list[str] = field(default_factory=list)
    no_origin: list[str] = field(default_factory=list)
    styles: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Lists:
        """From YAML with ``suesse_tokens`` (by language), ``stilmarken``, ``denominationen`` and ``stil_tabelle``."""
        import yaml

        with open(path, encoding="utf-8") as f:
            d = yaml.safe_load(f) or {}
        sweet = d.get("suesse_tokens") or {}
        words = [w for group in sweet.values() for w in group] if isinstance(sweet, dict) else list(sweet)
        return Lists(words, list(d.get("stilmarken") or []), list(d.get("denominationen") or []), dict(d.get("stil_tabelle") or {}))


def _fold_word(w: str) -> str:
    import unicodedata

    t = "".join(c for c in unicodedata.normalize("NFKD", w.lower().replace("ß", "ss")) if not unicodedata.combining(c))
    for a, b in (("ae", "a"), ("oe", "o"), ("ue", "u")):
        t = t.replace(a, b)
    return t


def _pattern(word: str) -> str:
    return any_word([_fold_word(word)]).replace(" ", r"[\s\-]+")


def _hits(text: Column, words: list[str]) -> Column:
    """The words that stand in a text."""
    return F.filter(F.array(*(F.when(text.rlike(_pattern(w)), F.lit(w)) for w in words)), lambda w: w.isNotNull()) if words else F.array().cast("array<string>")


def _measure(text: Column, pattern: str) -> Column:
    return number(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))


def type_of_score(score: Column) -> Column:
    out = F.when(score.isNull(), None)
    for cut, name in CUTS:
        out = out.when(score >= cut, name)
    return out.otherwise(LOWEST)


def taste_score(taste: Column) -> Column:
    """Weighted distance of ``map<string, double>`` tastes from a usual dry red, each within one point; missing ones weigh nothing."""
    total = F.lit(0.0)
    for axis, normal in NORMAL.items():
        off = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), taste[axis] - normal))
        total = total + WEIGHTS[axis] * F.coalesce(off, F.lit(0.0))
    return total


def classify(name: Column, sheet: Column, denomination: Column, vintage: Column, style_name: Column, taste: Column, baseline: Column, lists: Lists) -> Column:
    """``struct(typ, stage, signals, score)``; ``typ`` is ``unbekannt`` where nothing speaks."""
    texts = F.struct(*(umlauts_to_vowels(F.coalesce(c, F.lit(""))).alias(a) for c, a in ((name, "n"), (sheet, "s"), (denomination, "d"), (style_name, "y"))))
    return let(texts, lambda t: let(_signals(t, vintage, taste, baseline, lists), lambda x: _cascade(x, denomination, style_name, lists)))


def _signals(t: Column, vintage: Column, taste: Column, baseline: Column, lists: Lists) -> Column:
    n = t["n"]
    built = vintage.isNull() | n.rlike(_pattern("n v")) | F.exists(F.array(*map(F.lit, BLENDS)), lambda b: t["y"].contains(b))
    judged = taste["sweetness"].isNotNull() & (taste["count"] >= MIN_JUDGMENTS)
    return F.struct(
        _hits(n, lists.sweet).alias("sweet"), _hits(n, lists.brands).alias("brand"), _measure(t["s"], SUGAR).alias("sugar"), _measure(t["s"], ACID).alias("acid"),
        _measure(t["s"], ALCOHOL).alias("alcohol"), (F.size(_hits(t["d"], lists.no_origin)) > 0).alias("origin"), built.alias("built"),
        F.when(judged, taste_score(taste)).alias("own"), F.when(baseline["sweetness"].isNotNull(), taste_score(baseline)).alias("usual"))


def _cascade(x: Column, denomination: Column, style_name: Column, lists: Lists) -> Column:
    verdict = lambda typ, stage, signals, score=None: F.struct(
        (typ if isinstance(typ, Column) else F.lit(typ)).alias("typ"), F.lit(stage).alias("stage"), signals.alias("signals"), (F.lit(None).cast("double") if score is None else score).alias("score"))
    sweet, brand, sugar, acid, alcohol = (x[k] for k in ("sweet", "brand", "sugar", "acid", "alcohol"))
    g = lambda label, v, unit: F.format_string(f"{label} %.1f {unit}", v)
    origin, built, own, usual = x["origin"], x["built"], x["own"], x["usual"]
    table = F.create_map(*(F.lit(x) for kv in lists.styles.items() for x in kv))[style_name] if lists.styles else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    return F.coalesce(
        F.when(F.size(sweet) > 0, verdict("fruchtsuess", 1, F.slice(sweet, 1, 3))),
        F.when(F.size(brand) > 0, verdict("fruchtsuess", 1, F.slice(brand, 1, 2))),
        F.when(sugar >= SUGAR_SWEET, verdict("fruchtsuess", 1, F.array(g("sugar", sugar, "g/l")))),
        F.when((sugar < SUGAR_DRY) & (acid >= ACID_FIRM), verdict("straff_herb", 1, F.array(g("sugar", sugar, "g/l"), g("acid", acid, "g/l")))),
        F.when(alcohol >= ALCOHOL_SWEET, verdict("fruchtsuess", 1, F.array(g("alcohol", alcohol, "%%")))),
        F.when(origin & built, verdict("fruchtsuess", 1, F.array(denomination))),
        F.when(origin, verdict("weich_modern", 2, F.array(denomination))),
        F.when(own.isNotNull(), verdict(type_of_score(own), 2, F.array(F.lit("taste")), F.round(own, 3))),
        F.when(usual.isNotNull(), verdict(type_of_score(usual), 2, F.array(F.lit("style baseline")), F.round(usual, 3))),
        F.when(table.isNotNull(), verdict(table, 2, F.array(style_name))),
        verdict("unbekannt", 0, none))


def ordinal(typ: Column) -> Column:
    return F.array_position(F.lit(ORDINAL), typ)
