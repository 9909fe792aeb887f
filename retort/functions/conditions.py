"""Reaction-condition expressions: plausibility, buckets and the repair of positional numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retort.functions.parsing import number

#: Plausible ranges, and names that stand for a temperature or a duration.
TEMPERATURE_RANGE = (-150.0, 350.0)
TIME_RANGE = (1.0 / 3600.0, 8760.0)
TEMPERATURE_NAMES = {"room temperature": 25.0, "rt": 25.0, "ambient": 25.0, "ambient temperature": 25.0, "ice bath": 0.0}
TIME_NAMES = {"overnight": 16.0}


def temperature_bucket(c: Column) -> Column:
    """Upper ends belong to the lower bucket (PR13)."""
    return F.when(c < 0, "<0").when(c <= 25, "0-25").when(c <= 60, "25-60").when(c <= 100, "60-100").when(c.isNotNull(), "100+")


def time_bucket(c: Column) -> Column:
    return F.when(c < 1, "<1h").when(c <= 4, "1-4h").when(c <= 16, "4-16h").when(c <= 24, "16-24h").when(c.isNotNull(), "24h+")


def validate_conditions(temperature: Column, hours: Column) -> Column:
    """Struct of observed, clean and valid values of both, status, and issues (PR16)."""
    t, h = number(temperature), number(hours)
    t_ok, h_ok = t.between(*TEMPERATURE_RANGE), h.between(*TIME_RANGE)
    issues = F.array_compact(F.array(F.when(~t_ok, F.lit("temperature_out_of_plausibility_range")), F.when(~h_ok, F.lit("time_out_of_plausibility_range"))))
    status = (
        F.when(F.size(issues) > 0, "suspicious").when(t.isNull() & h.isNull(), "missing").when(t.isNull() | h.isNull(), "partial").otherwise("valid")
    )
    return F.struct(
        t.alias("temperature_observed_c"),
        F.when(t_ok, t).alias("temperature_clean_c"),
        t_ok.alias("temperature_valid"),
        h.alias("time_observed_h"),
        F.when(h_ok, h).alias("time_clean_h"),
        h_ok.alias("time_valid"),
        status.alias("status"),
        issues.alias("issues"),
    )


def _named(tokens: Column, names: dict[str, float]) -> Column:
    """The value of the last token that is one of the names."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(F.filter(F.transform(tokens, lambda t: F.try_element_at(table, F.lower(t))), lambda v: v.isNotNull()), F.lit(-1))


def _without_first(values: Column, value: Column) -> Column:
    at = F.coalesce(F.array_position(values, value), F.lit(0)).cast("int")
    return F.filter(values, lambda v, i: i != at - 1)


def reparse_middle(reaction: Column) -> Column:
    """Temperature and hours from the middle field of ``reactants>middle>products`` (PR17).

    Tokens are cut at every dot. Named values come first; of the numbers, a negative one is a temperature, a large last
    one is seconds, and what is left in range is a temperature.
    """
    text = F.trim(F.coalesce(reaction, F.lit("")))
    fields = F.split(text, ">", 3)
    three = ~F.contains(text, F.lit(">>")) & (F.size(F.split(text, ">")) >= 3)
    tokens = F.filter(F.transform(F.split(F.get(fields, F.lit(1)), "[.]"), lambda t: F.trim(t)), lambda t: t != "")
    low, high = TEMPERATURE_RANGE

    def parse(tokens: Column) -> Column:
        numbers = F.filter(F.transform(tokens, lambda t: number(t)), lambda v: v.isNotNull())

        def first_pass(s: Column) -> Column:
            named_t, named_h, values = s["t"], s["h"], s["v"]
            negative = F.get(F.filter(values, lambda v: v < 0), F.lit(0))
            take_negative = named_t.isNull() & negative.isNotNull()
            rest = F.when(take_negative, _without_first(values, negative)).otherwise(values)
            return F.transform(F.array(F.struct(F.coalesce(named_t, negative).alias("t"), named_h.alias("h"), rest.alias("rest"), values.alias("v"))), second_pass)[0]

        def second_pass(s: Column) -> Column:
            rest, values = s["rest"], s["v"]
            last = F.try_element_at(rest, F.lit(-1))
            seconds = s["h"].isNull() & ((last > 300) | ((F.size(rest) >= 2) & (last >= 60)))
            seconds = F.coalesce(seconds, F.lit(False))
            left = F.when(seconds, F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest)
            hours = F.when(seconds, last / 3600.0).otherwise(s["h"])
            plausible = F.filter(left, lambda v: v.between(low, high))
            several = s["t"].isNull() & (F.size(plausible) > 1)
            only = F.when(F.size(values) == 1, values[0])
            late = hours.isNull() & (only > high)
            alone = hours.isNull() & only.between(low, high)
            issues = F.array_compact(F.array(F.when(several, F.lit("multi_temperature_profile_primary_selected")), F.when(alone, F.lit("single_numeric_assumed_temperature"))))
            return F.struct(F.coalesce(s["t"], F.get(plausible, F.lit(0))).alias("t"), F.when(late, only / 3600.0).otherwise(hours).alias("h"), issues.alias("issues"), values.alias("v"))

        start = F.struct(_named(tokens, TEMPERATURE_NAMES).alias("t"), _named(tokens, TIME_NAMES).alias("h"), numbers.alias("v"))
        none = F.size(numbers) == 0

        def finish(s: Column) -> Column:
            both, either = s["t"].isNotNull() & s["h"].isNotNull(), s["t"].isNotNull() | s["h"].isNotNull()
            issues = F.coalesce(s["issues"], F.array().cast("array<string>"))
            confidence = (
                F.when(F.size(s["v"]) == 0, F.when(either, "high").otherwise("none")).when(both, "high").when(either & (F.size(issues) == 0), "medium").when(either, "low").otherwise("none")
            )
            method = F.when(F.size(s["v"]) == 0, "alias_only").otherwise("positional_numeric_repair")
            return F.struct(s["t"].alias("temperature_c"), s["h"].alias("time_h"), confidence.alias("confidence"), method.alias("method"), issues.alias("issues"), s["v"].alias("numeric_tokens"))

        empty = F.array().cast("array<string>")
        parsed = F.transform(
            F.array(start),
            lambda s: F.when(none, F.struct(s["t"].alias("t"), s["h"].alias("h"), empty.alias("issues"), s["v"].alias("v"))).otherwise(F.transform(F.array(s), first_pass)[0]),
        )
        return F.transform(parsed, finish)[0]

    def refused(method: str) -> Column:
        return F.struct(
            F.lit(None).cast("double").alias("temperature_c"),
            F.lit(None).cast("double").alias("time_h"),
            F.lit("none").alias("confidence"),
            F.lit(method).alias("method"),
            F.array().cast("array<string>").alias("issues"),
            F.array().cast("array<double>").alias("numeric_tokens"),
        )

    return F.when(~three, refused("not_three_field")).when(F.size(tokens) == 0, refused("empty_middle")).otherwise(F.transform(F.array(tokens), parse)[0])


def condition_confidence(c: Column) -> Column:
    """Numeric worth of a confidence word (PR25)."""
    return F.when(c == "high", 1.0).when(c == "medium", 0.75).when(c == "low", 0.4).when(c == "none", 0.0).otherwise(0.5)
