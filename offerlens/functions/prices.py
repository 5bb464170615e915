"""Price columns: packs, reference units, tax, discounts, bands and payable totals.

All are plain Column expressions. Text patterns use the look-behind of Java's
regular expressions; nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .bind import let

# Fixed values.
VAT = 0.081
REFERENCE_ML = 750
QUESTIONABLE_DISCOUNT = 45.0
QUESTIONABLE_BARGAIN = 65.0
MAX_UNITS = 24
ML_RANGE = (100, 20000)
BANDS = [("<10", 0.0, 10.0), ("10-20", 10.0, 20.0), ("20-40", 20.0, 40.0), ("40-80", 40.0, 80.0), (">80", 80.0, None)]
NAMED_VOLUMES = [(r"\bpiccolo\b", 200), (r"\bhalbflasche\b", 375), (r"\bdemi\b(?!\s*[-\s]?sec)", 375), (r"\bmagnum\b", 1500),
                 (r"\bdoppelmagnum\b", 3000), (r"\bjeroboam\b", 3000)]
UNIT_PRICE = r"(?i)\(\s*\d+(?:[.,]\d+)?\s*(?:ml|cl|dl|lt?|g|kg)\s*=\s*[^)]*\)"
PACK_TIMES_VOLUME = r"(?i)(?<!\d)(\d{1,3})\s*[x×*]\s*(\d+(?:[.,]\d+)?)\s*(cl|ml|dl|liter|lt|l)\b"
PACK_ONLY = (r"(?iu)(?:(?<!\d)(\d{1,3})\s*er\b|(?<!\d)(\d{1,3})\s*(?:fl(?:aschen)?|bouteilles?)\b"
             r"|(?:karton|harass|kiste|box|caisse|tray|gebinde|pack)\s*(?:à|a|von|of)?\s*(\d{1,3})(?!\d)(?!\s*(?:cl|ml|dl|l)\b))")
VOLUME = r"(?i)(?<![\d.,])(\d+(?:[.,]\d+)?)\s*(cl|ml|dl|liter|lt|l)\b"
CARTON = r"(?i)karton|harass|kiste|caisse|gebinde|tray|\bpack\b"
PER_BOTTLE = r"(?iu)pro\s*flasche|je\s*flasche|/\s*fl\b|par\s*bouteille|st(?:ü|u)ck"
EXCL_VAT = r"(?i)\bexkl?\.?\s*(?:mwst|vat|tva|ust)|\bohne\s*mwst|\bnet(?:to)?\b|\bht\b"
INCL_VAT = r"(?i)\binkl?\.?\s*(?:mwst|vat|tva|ust)|\bbrutto\b|\bttc\b"
POUCH = r"(?i)bag[\s-]?in[\s-]?box|\bbib\b|beutel|tetra|pouch"


def cents(x: Column) -> Column:
    """Rounded to two places; half a cent goes up although it is not a binary number."""
    return F.round(x + F.lit(1e-9), 2)


def number(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").cast("double")


def to_ml(value: Column, unit: Column) -> Column:
    """Millilitres of a volume, or null outside the plausible range."""
    u = F.lower(unit)
    ml = F.round(value * F.when(u == "ml", 1).when(u == "cl", 10).when(u == "dl", 100).when(u.isin("l", "lt", "liter"), 1000)).cast("int")
    return F.when(ml.between(*ML_RANGE), ml)


def _group(text: Column, pattern: str, at: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, at), F.lit(""))


def parse_pack(text: Column) -> Column:
    """``struct(units, bottle_ml, certain, assumed)`` of a basis text.

    ``N x V`` wins; else a count and all distinct volumes are looked for. Several
    volumes, a pouch without volume, a carton without count or more than
    ``MAX_UNITS`` make the result uncertain, and an uncertain one is never
    completed by assumption.
    """
    return let(F.regexp_replace(F.coalesce(text, F.lit("")), UNIT_PRICE, " "), lambda t: let(_pack_parts(t), lambda p: let(_pack_ml(t, p), lambda q: _pack(t, q))))


def _pack_parts(t: Column) -> Column:
    """What the patterns find: ``struct(times, raw_units, pack_ml, volumes)``."""
    times = t.rlike(PACK_TIMES_VOLUME)
    raw_units = F.when(times, _group(t, PACK_TIMES_VOLUME, 1)).otherwise(
        F.coalesce(_group(t, PACK_ONLY, 1), _group(t, PACK_ONLY, 2), _group(t, PACK_ONLY, 3))).cast("int")
    pack_ml = to_ml(number(_group(t, PACK_TIMES_VOLUME, 2)), _group(t, PACK_TIMES_VOLUME, 3))
    amounts, kinds = F.regexp_extract_all(t, F.lit(VOLUME), F.lit(1)), F.regexp_extract_all(t, F.lit(VOLUME), F.lit(2))
    found = F.zip_with(amounts, kinds, lambda a, k: to_ml(number(a), k))
    named = F.array(*(F.when(t.rlike("(?i)" + p), F.lit(ml)) for p, ml in NAMED_VOLUMES))
    volumes = F.array_distinct(F.filter(F.concat(found, named), lambda v: v.isNotNull()))
    return F.struct(times.alias("times"), raw_units.alias("raw_units"), pack_ml.alias("pack_ml"), volumes.alias("volumes"))


def _pack_ml(t: Column, p: Column) -> Column:
    """``struct(units, ml, doubt)`` from the parts."""
    ml = F.when(p["times"], p["pack_ml"]).otherwise(F.array_min(p["volumes"]))
    units = F.when(p["raw_units"] <= MAX_UNITS, p["raw_units"])
    doubt = (F.when(p["times"], p["pack_ml"].isNull()).otherwise(F.size(p["volumes"]) > 1) | (t.rlike(POUCH) & ml.isNull())
             | F.coalesce(p["raw_units"] > MAX_UNITS, F.lit(False)) | (units.isNull() & t.rlike(CARTON)))
    return F.struct(units.alias("units"), ml.alias("ml"), doubt.alias("doubt"))


def _pack(t: Column, q: Column) -> Column:
    ml, doubt = q["ml"], q["doubt"]
    return F.struct(
        q["units"].alias("units"),
        F.when(ml.isNotNull(), ml).when(~doubt, F.lit(REFERENCE_ML)).alias("bottle_ml"),
        (~doubt).alias("certain"),
        (ml.isNull() & ~doubt).alias("assumed"),
    )


def normalize_price(
    amount: Column,
    text: Column,
    vat_included: Column | None = None,
    price_basis: str = "auto",
    default_vat_included: bool = True,
) -> Column:
    """``struct(price, raw, confidence, bottle_ml, units, vat_added, raw_is_pack)`` of a shown price.

    The price is per ``REFERENCE_ML`` including tax. The tax status is the given
    one, else what the text says (excluded before included), else the default.
    """
    options = (vat_included, price_basis, default_vat_included)
    return let(F.coalesce(text, F.lit("")), lambda t: let(parse_pack(t), lambda pack: let(_terms(t, pack, *options), lambda x: _price(amount, pack, x))))


def with_normalized_price(rows: DataFrame, amount: str, text: Column, out: str, vat_included: Column | None = None, price_basis: str = "auto", default_vat_included: bool = True) -> DataFrame:
    """The same as a column of ``rows``, in steps that generated code runs: the choice for large tables."""
    t, clean, parts, q, pack, x = (F.col(f"_{out}{i}") for i in range(6))
    steps = [F.coalesce(text, F.lit("")), F.regexp_replace(t, UNIT_PRICE, " "), _pack_parts(clean), _pack_ml(clean, parts), _pack(t, q), _terms(t, pack, vat_included, price_basis, default_vat_included)]
    for i, step in enumerate(steps):
        rows = rows.withColumn(f"_{out}{i}", step)
    return rows.withColumn(out, _price(F.col(amount), pack, x)).drop(*(f"_{out}{i}" for i in range(6)))


def _terms(t: Column, pack: Column, vat_included: Column | None, price_basis: str, default_vat_included: bool) -> Column:
    """``struct(per, included, certain)``: bottles that the amount pays for, whether tax is in it, and whether that is sure."""
    told = F.when(t.rlike(EXCL_VAT), False).when(t.rlike(INCL_VAT), True).otherwise(F.lit(default_vat_included))
    units = pack["units"]
    if price_basis == "auto":
        per = F.when(units > 1, F.when(t.rlike(PER_BOTTLE), 1).otherwise(units)).otherwise(1)
    elif price_basis == "pack":
        per = F.coalesce(units, F.lit(1))
    else:
        per = F.lit(1)
    certain = pack["certain"] & (units.isNotNull() if price_basis == "pack" else F.lit(True))
    return F.struct(F.when(per == 0, 1).otherwise(per).alias("per"), (F.coalesce(vat_included, told) if vat_included is not None else told).alias("included"), certain.alias("certain"))


def _price(amount: Column, pack: Column, x: Column) -> Column:
    ml, known = pack["bottle_ml"], amount.isNotNull()
    confidence = F.when(~known | ~x["certain"], "low").when((ml == REFERENCE_ML) & ~pack["assumed"], "high").otherwise("medium")
    each = amount / x["per"] * (F.lit(float(REFERENCE_ML)) / F.coalesce(ml, F.lit(REFERENCE_ML)))
    return F.struct(
        F.when(known, cents(each * F.when(x["included"], 1.0).otherwise(1 + VAT))).alias("price"),
        amount.alias("raw"), confidence.alias("confidence"), F.when(known, ml).alias("bottle_ml"), F.when(known, pack["units"]).alias("units"),
        (known & ~x["included"]).alias("vat_added"), F.when(known, x["per"] > 1).alias("raw_is_pack"))


def describe_basis(units: Column, ml: Column, vat_included: Column) -> Column:
    return F.concat_ws(
        ", ", F.when(units > 1, F.concat(F.lit("Karton "), units)),
        F.when(ml != REFERENCE_ML, F.concat(F.regexp_replace(F.format_string("%.1f", ml / 10.0), r"\.0$", ""), F.lit(" cl"))),
        F.when(vat_included, "inkl. MwSt").otherwise("exkl. MwSt"))


def usable(price: Column, confidence: Column) -> Column:
    """Whether a price may rank."""
    return price.isNotNull() & (confidence != "low")


def discount_percent(price: Column, reference: Column) -> Column:
    """Percent under the reference price; null unless ``0 < price < reference``."""
    return F.when((price > 0) & (reference > 0) & (price < reference), F.round((1 - price / reference) * 100, 1))


def rate_discount(percent: Column, private_label: Column) -> Column:
    return F.when(percent.isNull(), "unknown").when(private_label & (percent > QUESTIONABLE_DISCOUNT), "questionable").otherwise("ok")


def price_band(price: Column) -> Column:
    """Half-open band of a price; null gives "", and what lies in no band the last one."""
    out = F.when(price.isNull(), "")
    for label, low, high in BANDS[:-1]:
        out = out.when((price >= low) & (price < high), label)
    return out.otherwise(BANDS[-1][0])


def payable_total(price: Column, raw: Column, units: Column, ml: Column, vat_added: Column, raw_is_pack: Column) -> Column:
    """What is to be paid: the raw amount if it agrees with the computed pack or bottle, else the computed pack."""
    n = F.when(F.coalesce(units, F.lit(0)) == 0, 1).otherwise(units)
    gross = F.when(vat_added, raw * (1 + VAT)).otherwise(raw)
    bottle = price * (F.coalesce(F.nullif(ml, F.lit(0)), F.lit(REFERENCE_ML)) / float(REFERENCE_ML))
    pack = bottle * n
    near = lambda x: F.abs(gross - x) <= F.greatest(F.lit(0.05), x * 0.01)
    plain = F.when(gross.isNotNull(), cents(F.when(F.coalesce(raw_is_pack, F.lit(False)), gross).otherwise(gross * n)))
    return (F.when(price.isNull(), plain).when(near(pack), cents(gross)).when((n > 1) & near(bottle), cents(gross * n))
            .when(ml.isNotNull() | gross.isNull(), cents(pack)).otherwise(plain))


def bargain_percent(market: Column, price: Column, sure: Column) -> Column:
    """Percent under an independent market price; negative values stay. Tenths are counted in doubles, so that a tie rounds as in SQL."""
    return F.when((market > 0) & price.isNotNull() & sure, F.round((market - price) / market * 100 * 10) / 10)


def bargain_plausibility(percent: Column, foreign: Column) -> Column:
    return F.when(percent.isNull(), "unknown").when((percent > QUESTIONABLE_BARGAIN) | foreign, "questionable").otherwise("ok")


def host(url: Column) -> Column:
    """Host of a URL in lower case without a leading ``www.``; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def same_shop(a: Column, b: Column) -> Column:
    """Equal hosts, or one under the other."""
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def independent_price(prices: Column, own_hosts: Column) -> Column:
    """``struct(per_75cl, shop, foreign)``: the least of ``array<struct<per_75cl, url>>`` outside own hosts, ``.ch`` shops first."""
    named = F.transform(prices, lambda p: F.struct(p["per_75cl"].alias("per_75cl"), host(p["url"]).alias("shop")))
    others = F.filter(named, lambda p: p["per_75cl"].isNotNull() & ~F.exists(own_hosts, lambda h: same_shop(F.coalesce(p["shop"], F.lit("")), h)))
    home = F.filter(others, lambda p: p["shop"].endswith(".ch"))
    pick = lambda xs, foreign: F.transform(F.slice(F.array_sort(xs), 1, 1), lambda p: F.struct(p["per_75cl"].alias("per_75cl"), p["shop"].alias("shop"), F.lit(foreign).alias("foreign")))
    return F.get(F.concat(pick(home, False), pick(others, True)), F.lit(0))
