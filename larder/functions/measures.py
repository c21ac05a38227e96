"""Weights, dates and nutrient values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder import fixed
from larder.functions.binding import bind


def _unit_map(index: int) -> Column:
    pairs = []
    for unit, entry in fixed.WEIGHT_FACTORS.items():
        pairs += [F.lit(unit), F.lit(entry[index])]
    return F.create_map(*pairs)


def unit_factor(unit: Column) -> Column:
    return F.try_element_at(_unit_map(0), F.lower(unit))


def unit_kind(unit: Column) -> Column:
    """``g``, ``ml`` or null for an unknown unit."""
    return F.try_element_at(_unit_map(1), F.lower(unit))


def number(text: Column) -> Column:
    """Decimal comma accepted; null when not a number."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def close_to(a: Column, b: Column) -> Column:
    """Equal within 1e-9 of the larger magnitude."""
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * 1e-9


def normalize_weight(value: Column, unit: Column) -> Column:
    """Amount in g or ml; near-integers become the integer below."""
    raw = number(value) * unit_factor(unit)
    low = F.floor(raw).cast("double")
    return F.when(close_to(raw, low), low).otherwise(raw)


def fix_fused_unit(unit: Column) -> Column:
    """Drop the estimate sign read as part of the unit: ``kge`` -> ``kg``."""
    low = F.lower(unit)
    return F.when(low.isin("dle", "cle", "mge", "mle", "ge", "kge", "le"), F.regexp_replace(low, "e$", "")).otherwise(low)


def is_valid_weight(value: Column) -> Column:
    text = F.replace(value, F.lit(","), F.lit("."))
    num = text.try_cast("double")
    leading_zero = text.startswith("0") & ~F.contains(text, F.lit("."))
    return F.coalesce(~leading_zero & (num > 0) & (F.floor(num) == num), F.lit(False))


def is_extreme_weight(amount: Column, count: Column | None = None) -> Column:
    extreme = (amount >= 10000) | (amount <= 10)
    if count is not None:
        extreme = F.coalesce(count.try_cast("int") > 20, F.lit(False)) | extreme
    return extreme


def is_suspicious_weight(amount: Column) -> Column:
    return (amount > 1000) & (F.pmod(F.floor(amount), F.lit(10)) != 0)


def parse_date(day: Column, month: Column, year: Column, first_year: int, last_year: int) -> Column:
    """ISO date from digit groups; impossible or out-of-range dates are null."""
    full = F.when(
        F.length(year) == 2,
        F.concat(F.when(year.try_cast("int") < 69, F.lit("20")).otherwise(F.lit("19")), year),
    ).otherwise(year)
    date = F.try_to_date(F.concat_ws("-", full, month, day), "yyyy-MM-dd")
    return F.when(F.year(date).between(first_year, last_year), F.date_format(date, "yyyy-MM-dd"))


def nutrition_value(value: Column, nutrient: Column) -> Column:
    """Model input: -1 missing, -2 implausible, else the value."""
    limit = F.when(nutrient == "energy-kcal", 3800).otherwise(101)
    return F.when(value.isNull(), F.lit(-1.0)).when((value >= limit) | (value < 0), F.lit(-2.0)).otherwise(value.cast("double"))


def nutrition_vector(nutrients: Column, schema_version: Column) -> Column:
    """Nine model inputs in fixed order from ``map<string,double>``."""
    known = F.coalesce(schema_version, F.lit(999)) > 1002
    return F.array(
        *[
            F.when(known, nutrition_value(F.try_element_at(nutrients, F.lit(n)), F.lit(n))).otherwise(F.lit(-1.0))
            for n in fixed.CATEGORY_NUTRIENTS
        ]
    )


def equal_nutrient(pred_value: Column, pred_unit: Column, value: Column, unit: Column) -> Column:
    """Whether a predicted nutrient agrees with the stored one.

    ``value`` is the stored text.  A stored 0 counts as missing, ``<`` is ignored,
    and a kcal/kJ prediction against another unit is an error.
    """
    current = value.try_cast("double")
    missing = value.isNull() | (value == "") | F.coalesce(current == 0, F.lit(False)) | F.coalesce(unit == "", F.lit(True))
    bare = F.regexp_replace(pred_value, "^[< ]+", "")
    low = F.lower(pred_unit)
    energy = low.isin("kj", "kcal")
    clash = F.raise_error(F.concat(F.lit("energy units differ: "), pred_unit, F.lit(" / "), unit)).cast("boolean")
    return (
        F.when(
            pred_value == "traces",
            F.coalesce((value == "traces") | (F.abs(current) <= 0.0), F.lit(False)),
        )
        .when(missing, False)
        .when(pred_unit.isNull(), True)
        .when(energy & (F.lower(unit) != low), clash)
        .when(energy, F.coalesce(close_to(number(bare), current), F.lit(False)))
        .otherwise(F.coalesce(close_to(normalize_weight(bare, low), normalize_weight(value, unit)), F.lit(False)))
    )


def _ends_like_g(value: Column) -> Column:
    """Trailing 8 or 9 that is a misread ``g``."""
    dotted = F.contains(value, F.lit("."))
    last = value.rlike("[89]$")
    return (
        value.isin("08", "09")
        | ((F.length(value) > 2) & ~dotted & last)
        | (dotted & last & ~value.rlike(r"\.[89]$"))
    )


def match_nutrient_value(text: Column, label: Column) -> Column:
    """struct(value, unit, valid) read from the words of one entity."""
    pattern = fixed.ENTITY_VALUE_PATTERN
    raw = F.regexp_extract(text, pattern, 2)
    found = raw != ""
    prefix = F.trim(F.regexp_extract(text, pattern, 1))
    number_text = F.replace(raw, F.lit(","), F.lit("."))
    value = F.when(prefix != "", F.concat(prefix, F.lit(" "), number_text)).when(F.lower(number_text) == "o", "0").otherwise(number_text)
    read_unit = F.lower(F.regexp_extract(text, pattern, 3))
    has_unit = read_unit != ""
    unit = F.when(read_unit == "mcg", "µg").otherwise(read_unit)
    nine = F.coalesce(
        ~has_unit & label.rlike("^(" + "|".join(fixed.NINE_AS_G_NUTRIENTS) + ")") & _ends_like_g(value), F.lit(False)
    )
    inferred = F.when(nine, "g").when(label.startswith("energy_"), F.split_part(label, F.lit("_"), F.lit(2)))
    kcal, kj = label.startswith("energy_kcal"), label.startswith("energy_kj")
    wrong = (kcal & (unit != "kcal")) | (kj & (unit != "kj")) | ((unit == "kcal") & ~kcal) | ((unit == "kj") & ~kj)
    return F.struct(
        F.when(found, F.when(nine, F.regexp_replace(value, ".$", "")).otherwise(value)).alias("value"),
        F.when(found, F.when(has_unit, unit).otherwise(inferred)).alias("unit"),
        (found & ~(has_unit & wrong)).alias("valid"),
    )


def default_units(nutrients: Column) -> Column:
    """Fill missing units in ``map<string, struct<value,unit>>``."""
    pairs = [F.lit(x) for kv in fixed.NUTRIENT_DEFAULT_UNIT.items() for x in kv]
    table = F.create_map(*pairs)
    return F.transform_values(
        nutrients,
        lambda k, v: F.struct(v["value"].alias("value"), F.coalesce(v["unit"], F.try_element_at(table, k)).alias("unit")),
    )


def nutrient_per_mode(keys: Column) -> Column:
    """Most common of ``100g``/``serving`` over ``<nutrient>_<per>`` keys; first seen wins ties."""
    pers = F.transform(keys, lambda k: F.regexp_extract(k, "_([^_]*)$", 1))
    n100 = F.size(F.filter(pers, lambda p: p == "100g"))
    nserving = F.size(F.filter(pers, lambda p: p == "serving"))
    bad = F.exists(pers, lambda p: ~p.isin("100g", "serving"))
    error = F.raise_error(F.lit("each nutrient key must end with '_100g' or '_serving'")).cast("string")
    return (
        F.when(bad, error)
        .when(n100 > nserving, "100g")
        .when(nserving > n100, "serving")
        .otherwise(F.try_element_at(pers, F.lit(1)))
    )


def keep_per(nutrients: Column, per: Column) -> Column:
    """Entries of the chosen per, keyed without the suffix."""
    kept = F.map_filter(nutrients, lambda k, v: k.endswith(per))
    return F.transform_keys(kept, lambda k, v: F.regexp_replace(k, "_[^_]*$", ""))


def phash_int(bits: Column) -> Column:
    """64 booleans, most significant first, to a signed 64-bit integer."""
    return F.aggregate(
        bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long"))
    )


def vec_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def vec_unit(v: Column) -> Column:
    """Divide by the L2 norm (double precision)."""
    return bind(vec_norm(v), lambda norm: F.transform(v, lambda x: x.cast("double") / norm))
