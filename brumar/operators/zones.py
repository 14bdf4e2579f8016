"""Zones and intervals in narrative paragraphs: extraction, pairing, resolution to stations, rewriting, scoring.

A text stays one row: places of phrases and intervals are arrays built from the pieces between them, so nothing is
shuffled before zones are exploded, and no text goes through Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brumar.functions import text as X

# What paragraphs call zones, in lower case without accents, with the axis and the name of the zone in the zone tables.
CLIMATIC = {
    "litoral": "Litoral", "litoralul": "Litoral",
    "delta dunarii": "Delta Dunării", "delta": "Delta Dunării",
    "campie": "Câmpie (zone joase extracarpatice)", "campia": "Câmpie (zone joase extracarpatice)", "zonele extracarpatice": "Câmpie (zone joase extracarpatice)",
    "zona de deal si podis": "Zona de deal și podiș", "deal si podis": "Zona de deal și podiș", "podisuri": "Zona de deal și podiș",
    "zona submontana": "Zona submontană", "submontana": "Zona submontană",
    "depresiunile intramontane": "Depresiuni intramontane", "depresiuni intramontane": "Depresiuni intramontane",
    "interiorul arcului carpatic": "Depresiuni intramontane", "interiorul carpatic": "Depresiuni intramontane",
    "zona montana": "Zona montană", "zonele montane": "Zona montană", "zona montana inalta": "Zona montană înaltă", "munti": "Zona montană",
    "creste": "Creste montane (peste 2500 m)", "creste montane": "Creste montane (peste 2500 m)",
}
REGIONS = {
    "muntenia": ("region", "Muntenia"), "munteniei": ("region", "Muntenia"), "dobrogea": ("region", "Dobrogea"), "dobrogei": ("region", "Dobrogea"),
    "moldova": ("region", "Moldova"), "moldovei": ("region", "Moldova"), "oltenia": ("region", "Oltenia"), "olteniei": ("region", "Oltenia"),
    "transilvania": ("region_compound", "Transilvania"), "transilvaniei": ("region_compound", "Transilvania"),
    "banatului": ("region_part", "Banat"), "banat": ("region_part", "Banat"), "crisanei": ("region_part", "Crisana"), "crisana": ("region_part", "Crisana"),
    "maramures": ("subregion", "Maramures"), "maramuresului": ("subregion", "Maramures"),
}
NEUTRAL = ["centrul", "central", "centrala", "interiorul", "interior", "mijlocul", "mijloc", "majoritatea", "izolat", "cea mai mare parte a"]
DIRECTION = {"N": "nord", "S": "sud", "E": "est", "V": "vest"}
#: characters before a region in which a direction counts
LOOK_BACK = 40


def directions() -> list[tuple[str, str]]:
    """(word, direction) of all forms, longest first: plain and with article, compound ones by their first part, adjectives."""
    single = [(w + end, d) for d, w in (("N", "nord"), ("S", "sud"), ("E", "est"), ("V", "vest")) for end in ("", "ul")]
    compound = [(f"{DIRECTION[a]}{dash}{DIRECTION[b]}{end}", a) for a in "NS" for b in "EV" for dash in ("-", "") for end in ("", "ul")]
    adjective = [(DIRECTION[d] + "ic" + end, d) for d in "EVNS" for end in ("", "a", "e")]
    return sorted(single + compound + adjective, key=lambda x: -len(x[0]))


def vocabulary() -> list[tuple[str, str, str]]:
    """(phrase, axis, zone) in the order in which phrases claim their place: climatic ones, then regions, longer ones first."""
    longest = lambda d: sorted(d, key=lambda p: -len(p))
    return [(p, "climatic", CLIMATIC[p]) for p in longest(CLIMATIC)] + [(p, *REGIONS[p]) for p in longest(REGIONS)]


def _whole(phrases: list[str]) -> str:
    quoted = "|".join(p.replace("-", r"\-") for p in phrases)
    return rf"(?<![a-z0-9])(?:{quoted})(?![a-z0-9])"


def claim_order(phrases: list[str]) -> None:
    """Phrases are looked for all at once, left to right.  That gives each place to the phrase that claims it first unless a
    phrase begins inside an earlier one of lower rank; a vocabulary with such phrases is refused."""
    for low, a in enumerate(phrases):
        for b in phrases[:low]:
            x, y = a.split(), b.split()
            if any(x[k:][: len(y)] == y[: len(x) - k] for k in range(1, len(x))):
                raise ValueError(f"'{b}' may begin inside '{a}'")


def zones_of(text: Column, words: list[tuple[str, str, str]] | None = None) -> Column:
    """(raw, axis, zone, cardinal, start) of the zones of a text in order of place.

    A region takes the direction found in the ``LOOK_BACK`` characters before it, the longest form that occurs, unless a word
    such as 'centrul' stands there too; climatic zones take none.  Null and empty texts have no zones.
    """
    words = words or vocabulary()
    claim_order([p for p, _, _ in words])
    axis = F.create_map(*[F.lit(x) for p, a, _ in words for x in (p, a)])
    zone = F.create_map(*[F.lit(x) for p, _, z in words for x in (p, z)])

    def one(plain: Column, m: Column) -> Column:
        before = F.substring(plain, F.greatest(m["start"] - LOOK_BACK, F.lit(0)) + 1, F.least(m["start"], F.lit(LOOK_BACK)))
        side = X.let(before, lambda b: F.when(~b.rlike(_whole(NEUTRAL)), F.coalesce(*[F.when(b.rlike(_whole([w])), F.lit(d)) for w, d in directions()])))
        return F.struct(F.substring(text, m["start"] + 1, F.length(m["hit"])).alias("raw"), axis[m["hit"]].alias("axis"), zone[m["hit"]].alias("zone"), F.when(axis[m["hit"]] != "climatic", side).alias("cardinal"), m["start"].alias("start"))

    pattern = _whole([p for p, _, _ in words])
    return X.let(X.strip_accents(text), lambda plain: F.transform(X.placed(plain, pattern), lambda m: one(plain, m)))


def predictions(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row id, sentence, start, axis, zone, cardinal, low, high, moved): each zone with the nearest interval of its sentence.

    Ties go to the interval listed first, bracketed ones before worded ones.  Sentences without an interval give nothing.
    """
    s = df.select(row_id, F.posexplode(X.sentences(F.col(text))).alias("sentence", "s"))
    s = s.select(row_id, "sentence", "s", X.intervals(F.col("s")).alias("i")).where(F.size("i") > 0)
    s = s.select(row_id, "sentence", "i", F.explode(zones_of(F.col("s"))).alias("z"))
    near = F.array_min(F.transform("i", lambda i, k: F.struct(F.abs(F.col("z.start") - i["middle"]).alias("d"), k.alias("k"), i["low"].alias("low"), i["high"].alias("high"))))
    s = s.withColumn("n", near).withColumn("g", X.snapped(F.col("n.low"), F.col("n.high")))
    return s.select(row_id, "sentence", "z.start", "z.axis", "z.zone", "z.cardinal", "g.low", "g.high", "g.moved")


def zone_table(stations: DataFrame, climatic: DataFrame | None = None) -> DataFrame:
    """(axis, zone, cardinal, entity, county, place): the stations of every zone that paragraphs can name.

    stations: entity, region, county, cardinal, in the order of ``entity``; climatic: zone, entity.  A region is listed whole (cardinal null) and by
    direction; Transilvania is its two halves; Banat and Crisana are the one region that holds both; Maramures is its county.
    """
    parts = [F.struct(F.lit("region").alias("axis"), F.col("region").alias("zone"))]
    parts += [F.when(F.col("region").isin("TransilvaniaN", "TransilvaniaS"), F.struct(F.lit("region_compound").alias("axis"), F.lit("Transilvania").alias("zone")))]
    parts += [F.when(F.col("region") == "Banat-Crisana", F.struct(F.lit("region_part").alias("axis"), F.lit(z).alias("zone"))) for z in ("Banat", "Crisana")]
    s = stations.where("region is not null").select("entity", "county", "cardinal", F.explode(F.array_compact(F.array(*parts))).alias("z"))
    whole = s.select("z.axis", "z.zone", F.lit(None).cast("string").alias("cardinal"), "entity", "county")
    out = whole.unionByName(s.where("cardinal is not null").select("z.axis", "z.zone", "cardinal", "entity", "county"))
    mm = stations.where("county = 'MM'").withColumn("c", F.explode(F.array(F.lit(None).cast("string"), *[F.lit(d) for d in DIRECTION])))
    out = out.unionByName(mm.select(F.lit("subregion").alias("axis"), F.lit("Maramures").alias("zone"), F.col("c").alias("cardinal"), "entity", "county"))
    if climatic is not None:
        at = climatic.join(stations.select("entity", "county"), "entity", "left")
        out = out.unionByName(at.select(F.lit("climatic").alias("axis"), "zone", F.lit(None).cast("string").alias("cardinal"), "entity", "county"))
    return out.distinct()


def at_stations(zones: DataFrame, table: DataFrame) -> DataFrame:
    """The zones with the stations they cover, one row a station; zones that the table does not hold give none."""
    on = (zones["axis"] == table["axis"]) & (zones["zone"] == table["zone"]) & zones["cardinal"].eqNullSafe(table["cardinal"])
    return zones.join(table, on).select(*[zones[c] for c in zones.columns], table["entity"], table["county"])


def counties(zones: DataFrame, table: DataFrame) -> DataFrame:
    """(axis, zone, cardinal, counties): the counties of each zone, each once, in the order of the first station."""
    first = at_stations(zones.select("axis", "zone", "cardinal").distinct(), table).where("county is not null").groupBy("axis", "zone", "cardinal", "county").agg(F.min("entity").alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "county")))
    return first.groupBy("axis", "zone", "cardinal").agg(F.array_join(F.transform(listed, lambda x: x["county"]), ",").alias("counties"))


def label(axis: Column, zone: Column, cardinal: Column) -> Column:
    """The zone's name, with its direction where that tells zones of one name apart."""
    word = reduce(lambda c, d: c.when(cardinal == d, F.lit(DIRECTION[d])), list(DIRECTION)[1:], F.when(cardinal == "N", F.lit("nord")))
    return F.when(cardinal.isNotNull() & axis.isin("region", "region_part", "subregion"), F.concat(zone, F.lit(" ("), word, F.lit(")"))).otherwise(zone)


def last_mention(pred: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of several predictions for one place the last counts."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return pred.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_mention(zones: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first mention of every (axis, zone, cardinal) of ``by``."""
    kept = [c for c in zones.columns if c not in (*by, "axis", "zone", "cardinal")]
    got = zones.groupBy(*by, "axis", "zone", "cardinal").agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("f"))
    return got.select(*by, "axis", "zone", "cardinal", "f.*")


_QUALIFIED = r"(?iu)(?:(?<![\p{L}\d])(sub|peste|de\s+la|p[aâ]n[aă](?:\s+la)?|[iî]ntre)\s+)?\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\](?:\s*(?:°\s*C|deg\s*C|C))?"


def rewritten(text: Column) -> Column:
    """'[x, y] °C' in fluent words on the grid of two degrees.

    'sub' and 'de la' stay at the lowest cell of the paragraph, 'peste' and 'până la' at the highest; any other cell reads
    'intre x si y °C'.  A text without brackets stays as it is.
    """
    group = lambda k: F.regexp_extract_all(text, F.lit(_QUALIFIED), F.lit(k))
    cells = F.transform(F.arrays_zip(group(1).alias("q"), group(2).alias("a"), group(3).alias("b")), lambda z: F.struct(
        X.one_space(X.strip_accents(z["q"])).alias("q"),
        X.snapped(z["a"].cast("double"), z["b"].cast("double"))["low"].cast("bigint").alias("x"),
    ))
    s = lambda n: n.cast("string")

    def word(c: Column, low: Column, high: Column) -> Column:
        return (
            F.when(c["q"].isin("sub", "de la") & (c["x"] == low), F.concat(c["q"], F.lit(" "), s(c["x"]), F.lit(" °C")))
            .when((c["q"] == "peste") & (c["x"] == high), F.concat(F.lit("peste "), s(c["x"] + 2), F.lit(" °C")))
            .when(c["q"].isin("pana", "pana la") & (c["x"] == high), F.concat(F.lit("pana la "), s(c["x"] + 2), F.lit(" °C")))
            .otherwise(F.concat(F.lit("intre "), s(c["x"]), F.lit(" si "), s(c["x"] + 2), F.lit(" °C")))
        )

    def said(cs: Column) -> Column:
        ends = F.struct(F.array_min(F.transform(cs, lambda c: c["x"])).alias("low"), F.array_max(F.transform(cs, lambda c: c["x"])).alias("high"))
        return X.let(ends, lambda e: F.transform(cs, lambda c: word(c, e["low"], e["high"])))

    def joined(words: Column) -> Column:
        return F.when(F.size(words) > 0, F.array_join(F.transform(F.split(text, _QUALIFIED), lambda p, k: F.concat(p, F.coalesce(F.get(words, k), F.lit("")))), "")).otherwise(text)

    return X.let(cells, lambda cs: X.let(said(cs), joined))


def interval_score(truth: DataFrame, pred: DataFrame, value: DataFrame, by: list[str], width: float = 2.0) -> DataFrame:
    """Scores predicted intervals of entities against the entities that should be named and their true values.

    truth: by + entity; pred: by + entity, low, high; value: entity, t.  Named and expected: the distance of the value to
    the interval; expected only: ``width``; named only: the distance, ``width`` at least; without a value: not scored.
    accuracy = 1 / (1 + mean distance / width); with nothing to score the mean distance is ``width``.
    """
    k = [*by, "entity"]
    j = truth.select(*k).distinct().withColumn("in_truth", F.lit(True)).join(pred.select(*k, "low", "high").withColumn("in_pred", F.lit(True)), k, "full").join(value.select("entity", "t"), "entity", "left")
    t, p = F.coalesce("in_truth", F.lit(False)), F.coalesce("in_pred", F.lit(False))
    d = X.point_distance(F.col("t"), F.col("low"), F.col("high"))
    kind = F.when(F.col("t").isNull(), "unscorable").when(t & p, "intersection").when(t, "missed").otherwise("false_positive")
    dist = F.when(F.col("t").isNull(), None).when(t & p, d).when(t, F.lit(width)).otherwise(F.greatest(d, F.lit(width)))
    got = j.withColumn("kind", kind).withColumn("d", dist).groupBy(*by).agg(F.avg("d").alias("d_bar"), *[F.count_if(F.col("kind") == x).alias(f"n_{x}") for x in ("intersection", "missed", "false_positive", "unscorable")])
    return got.withColumn("d_bar", F.coalesce("d_bar", F.lit(width))).withColumn("accuracy", 1 / (1 + F.col("d_bar") / width))


def compliance(pred: DataFrame, by: list[str]) -> DataFrame:
    """by + (n_intervals, n_moved, compliance): the share of predictions that lay on the grid as they were written."""
    got = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n_intervals"), F.count_if("moved").alias("n_moved"))
    return got.withColumn("compliance", 1 - F.col("n_moved") / F.col("n_intervals"))
