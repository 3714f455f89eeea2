"""Weather code rules. Code ranges and labels are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme -> (label, lowest code, highest code), first match wins, else "Other".
SCHEMES = {
    "basic": (
        ("Clear", 0, 1),
        ("Cloudy", 2, 3),
        ("Rain", 51, 67),
        ("Snow", 71, 77),
    ),
    "impact": (
        ("Clear", 0, 1),
        ("Partly Cloudy", 2, 3),
        ("Rain", 51, 67),
        ("Snow", 71, 77),
    ),
    "detail": (
        ("Clear", 0, 1),
        ("Partly Cloudy", 2, 3),
        ("Drizzle", 51, 55),
        ("Rain", 61, 67),
        ("Snow", 71, 77),
        ("Thunderstorm", 95, 99),
    ),
}

# Descriptions of the codes shown to people (fixed values).
CODE_NAMES = {
    0: "Clear sky",
    1: "Mainly clear",
    2: "Partly cloudy",
    3: "Overcast",
    51: "Drizzle",
    61: "Rain (slight)",
    63: "Rain (moderate)",
    65: "Rain (heavy)",
    71: "Snow (slight)",
    73: "Snow (moderate)",
}


def is_raining(code: Column) -> Column:
    return code.between(51, 67)


def is_snowing(code: Column) -> Column:
    return code.between(71, 77)


def weather_class(code: Column, scheme: str) -> Column:
    label = F.lit("Other")
    for name, low, high in reversed(SCHEMES[scheme]):
        label = F.when(code.between(low, high), name).otherwise(label)
    return label


def precipitation_bucket(mm: Column) -> Column:
    return (
        F.when(mm == 0, "0 mm (Dry)")
        .when(mm < 2, "0.1–2 mm (Light)")
        .when(mm < 10, "2–10 mm (Moderate)")
        .otherwise("10+ mm (Heavy)")
    )


def condition(raining: Column, snowing: Column) -> Column:
    return F.when(raining, "Rain").when(snowing, "Snow").otherwise("Dry")


def code_name(code: Column) -> Column:
    pairs = [F.lit(x) for item in CODE_NAMES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), code)
