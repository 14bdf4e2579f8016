"""Text blocks of prompts from daily facts: columns in, one text column out.

Numbers have one decimal, halves rounded up.  A fact that is null leaves its line out; a block without facts is empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the blocks.
SKY_WORDS = ["cer senin sau puțin noros", "cer parțial noros", "cer predominant noros", "cer complet acoperit de nori"]


def tenth(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.1f", F.floor(F.round(x.cast("double"), 6) * 10 + 0.5) / 10))


def line(*parts: Column | str) -> Column:
    """The parts joined, with a line end; empty if one of them is null."""
    return F.coalesce(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit("\n")), F.lit(""))


def lines(items: Column, one) -> Column:
    return F.coalesce(F.array_join(F.transform(items, one), ""), F.lit(""))


def day_block(title: Column, tmax: Column, tmin: Column, precipitation: Column, wind: Column, sky: Column, phenomena: Column) -> Column:
    """The facts of a day.  wind: struct mean, low, high; sky: struct value, n; phenomena: array of struct name, n."""
    listed = F.when(F.size(phenomena) > 0, F.concat(F.lit("Fenomene:\n"), lines(phenomena, lambda p: line("  - ", p["name"], ": ", p["n"], " observații")))).otherwise("")
    return F.concat(
        line(title, ":"),
        line("Temperatura medie maximă București: ", tenth(tmax), "°C"),
        line("Temperatura medie minimă București: ", tenth(tmin), "°C"),
        line("Precipitații medii București: ", tenth(precipitation), " l/m²"),
        line("Vânt: Media ", tenth(wind["mean"]), " m/s (min: ", tenth(wind["low"]), ", max: ", tenth(wind["high"]), ")"),
        line("Nebulozitate: Cel mai frecvent ", sky["value"], "/8 (", sky["n"], " măsurători)"),
        listed,
    )


def wind_block(speed: Column, n: Column, word: Column) -> Column:
    body = F.concat(line("ANALIZA VÂNTULUI (Rff1):"), line("- Viteza medie înregistrată: ", tenth(speed), " m/s"), line("- Numărul total de măsurători: ", n), line("- Caracterizare: vânt ", word), F.lit("\n"))
    return F.when(speed.isNotNull(), body).otherwise("")


def sky_block(value: Column, n: Column, hours: Column) -> Column:
    """hours: array of the hours at which the value was seen most, empty if unknown."""
    word = F.when(value <= 2, SKY_WORDS[0]).when(value <= 4, SKY_WORDS[1]).when(value <= 6, SKY_WORDS[2]).otherwise(SKY_WORDS[3])
    body = F.concat(
        line("ANALIZA NEBULOZITĂȚII (Nop):"), line("- Valoarea cea mai frecventă: ", value, "/8 (pe scala 1-8)"), line("- Numărul de înregistrări cu această valoare: ", n), line("- Caracterizare: ", word),
        F.when(F.size(hours) > 0, line("- Cele mai frecvente ore de apariție: ", F.array_join(hours, ", "))).otherwise(""), F.lit("\n"),
    )
    return F.when(value.isNotNull(), body).otherwise("")


def precipitation_block(days: Column) -> Column:
    """days: array of struct day, amount in order; a day without an amount counts as dry."""
    amount = lambda d: F.coalesce(d["amount"], F.lit(0.0))
    total = F.aggregate(days, F.lit(0.0), lambda s, d: s + F.greatest(amount(d), F.lit(0.0)))
    rainy = F.size(F.filter(days, lambda d: amount(d) > 0))
    shown = lines(days, lambda d: line("- ", F.date_format(d["day"], "dd.MM.yyyy"), ": ", tenth(amount(d)), F.when(amount(d) > 0, " l/m² (zi cu precipitații)").otherwise(" l/m² (zi fără precipitații)")))
    body = F.concat(
        line("ANALIZA PRECIPITAȚIILOR:"), shown, line("\nBilanțul precipitațiilor în perioada analizată:"), line("- Total precipitații: ", tenth(total), " l/m²"),
        line("- Zile cu precipitații: ", rainy, " din ", F.size(days)), line("- Media zilnică: ", tenth(total / F.size(days)), " l/m²"), F.lit("\n"),
    )
    return F.when(F.size(days) > 0, body).otherwise("")


def phenomena_block(phenomena: Column, observed: Column) -> Column:
    """phenomena: array of struct name, n, most frequent first; observed: how many observations there were, blanks included."""
    often = F.filter(phenomena, lambda p: p["n"] > 1)
    repeated = F.when(F.size(often) > 0, F.concat(line("\nFENOMENE REPETATE (importante pentru propoziția 3):"), lines(often, lambda p: line("- ", p["name"], ": ", p["n"], " apariții în ultimele 24h")))).otherwise("")
    each = lines(phenomena, lambda p: F.concat(line("- ", p["name"]), line("  Frecvența: ", p["n"], " apariții (", tenth(100 * p["n"] / observed), "% din timpul observat)")))
    return F.when(F.size(phenomena) > 0, F.concat(line("FENOMENE METEOROLOGICE ÎNREGISTRATE:"), line("Inventarul complet al fenomenelor observate:"), each, repeated, F.lit("\n"))).otherwise("")


def temperature_block(days: Column) -> Column:
    """days: array of struct day, tmax, tmin in order."""
    mean = lambda name: F.aggregate(F.filter(days, lambda d: d[name].isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, d: F.struct((a["s"] + d[name]).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))
    tmin = lambda d, lead: F.coalesce(F.concat(F.lit(lead), tenth(d["tmin"]), F.lit("°C")), F.lit(""))
    shown = lines(days, lambda d: F.when(d["tmax"].isNotNull(), line("- ", F.date_format(d["day"], "dd.MM"), " Tmax: ", tenth(d["tmax"]), "°C", tmin(d, ", Tmin: "))).otherwise(F.when(d["tmin"].isNotNull(), line("- ", F.date_format(d["day"], "dd.MM"), tmin(d, " Tmin: "))).otherwise("")))
    return F.concat(line("MEDIA TEMPERATURILOR PENTRU TOATE ZILELE:"), shown, line("Temperatura maximă medie generală: ", tenth(mean("tmax")), "°C"), line("Temperatura minimă medie generală: ", tenth(mean("tmin")), "°C"), F.lit("\n"))
