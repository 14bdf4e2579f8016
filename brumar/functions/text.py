"""Text columns: folding, cutting, parsing.  Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that are left out before texts are compared.
STOP_WORDS = """
a al ale alor ai alei alui cel cea cei cele celor celui un o unei unui unor niște
acel acea acei acele acest această acești aceste același aceeași aceiași aceleași
de la în pe cu din până pentru prin sub peste lângă despre între către spre fără dintre printre
și dar sau ori ci iar însă deci că să dacă deși fiindcă întrucât precum astfel decât cât
eu tu el ea noi voi ei ele mine tine sine mie ție lui nouă vouă lor mă te se ne vă le li
meu mea mei mele tău ta tăi tale său sa săi sale nostru noastră noștri noastre vostru voastră voștri voastre
cine ce care cui cărei cărui căror altul alta alții altele altcineva altceva
sunt ești este e suntem sunteți eram erai era erați erau fi fie fost fiind am are avem aveți au
aveam aveai avea aveați aveau avut având vei va vom veți vor aș ar ați trebui poate putea pot
nu mai doar cam foarte prea chiar numai tot toate toți toată oare totuși mereu uneori aproape cumva oarecum
""".split()
# The five labels of a structured report; each may be written with or without accents.
SECTION_LABELS = ["PRIMA PROPOZIȚIE", "A DOUA PROPOZIȚIE", "A TREIA PROPOZIȚIE", "A PATRA PROPOZIȚIE", "PROPOZIȚIA FINALĂ"]
ACCENTED, PLAIN = "ăâîșțşţĂÂÎȘȚŞŢáéíóúàèìòùäëïöü", "aaiststAAISTSTaeiouaeiouaeiou"


def fold_cedilla(text: Column) -> Column:
    return F.translate(text, "şŞţŢ", "șȘțȚ")


def strip_accents(text: Column) -> Column:
    """Lower case without the accents of Romanian and its neighbours."""
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def one_space(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{85}\p{Z}]+", " "))


def without_thoughts(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)<think>.*?</think>", "")


def words(text: Column) -> Column:
    """Lower-case words, digits included."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def content_words(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Words that are no function words, with repetitions and in order."""
    return F.filter(words(text), lambda w: ~w.isin(list(stop)))  # a list of literals becomes a hash set


# Words for time that are never left out.
TIME_WORDS = """
azi astăzi ieri alaltăieri mâine poimâine acum atunci înainte după apoi dimineață dimineața prânz seara seară noapte noaptea ziua zi
""".split()


def comparable(text: Column, stop: list[str] | None = STOP_WORDS) -> Column:
    """A text made ready for comparison: comma letters, single blanks, lower case and, unless ``stop`` is None, without function words.

    Words are what lies between blanks, marks included; words for time stay.  Null and empty texts give ''.
    """
    plain = F.lower(one_space(fold_cedilla(F.coalesce(text, F.lit("")))))
    if stop is None:
        return plain
    gone = [w for w in stop if w not in TIME_WORDS]
    return F.array_join(F.filter(F.split(plain, " "), lambda w: ~w.isin(gone)), " ")


def sentence_count(text: Column) -> Column:
    return F.greatest(F.lit(0), F.size(F.split(text, r"[.!?]+")) - 1)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=\.)\s+")


def _loose(label: str) -> str:
    return "".join({"Ț": "[ȚŢT]?", "Ă": "[ĂA]"}.get(c, c) for c in label).replace("IE", "I[AE]")


def label_pattern(label: str) -> str:
    """A label anywhere, whatever the case and the accents of its last word, and the rest of its line."""
    return rf"(?iu){_loose(label)}:[ \t]*([^\n]*)"


def labelled(text: Column, label: str) -> Column:
    """The longest non-empty text behind a label, '-' counting as empty; null if there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(label_pattern(label)), F.lit(1)), lambda s: F.trim(s))
    found = F.filter(found, lambda s: (s != "") & (s != "-"))
    return F.array_max(F.transform(found, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]  # of equal ones the first


def structured(text: Column) -> Column:
    """The labelled sentences joined in order, or the whole text if no label has one."""
    clean = without_thoughts(text)
    joined = F.concat_ws(" ", *[labelled(clean, x) for x in SECTION_LABELS])
    return one_space(F.when(joined == "", clean).otherwise(joined))


def line_sections(text: Column) -> list[Column]:
    """The sections of a text read line by line, one column a label, empty if there is none.

    A label opens a section only at the start of a line; notes may stand between it and the colon.  Lines up to the next
    label join the open section, those before the first label belong to none.  A label that comes again goes on with its
    section; '-' stays.
    """
    lines = F.regexp_replace(text, r"\r\n?|[\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]", "\n")
    any_label = "|".join(_loose(x) for x in SECTION_LABELS)
    pieces = F.split(lines, rf"(?imud)(?=^[\s\p{{Z}}&&[^\n]]*(?:{any_label})[^:\n]*:)")

    def of(label):
        head = rf"(?iu)\A[\s\p{{Z}}]*{_loose(label)}[^:\n]*:"
        return F.array_join(F.transform(F.filter(pieces, lambda s: s.rlike(head)), lambda s: F.regexp_replace(s, head, "")), " ")

    return [one_space(of(x)) for x in SECTION_LABELS]


def last_scores(text: Column) -> Column:
    """The mean of the last bracketed list of four or five numbers that all lie in 0..1."""
    lists = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    numbers = F.transform(lists, lambda s: F.transform(F.split(s, r"\s*,\s*"), lambda x: F.trim(x).try_cast("double")))
    good = F.filter(numbers, lambda a: F.size(a).isin(4, 5) & F.forall(a, lambda x: F.coalesce(x.between(0, 1), F.lit(False))))
    last = F.try_element_at(good, F.lit(-1))
    return F.when(last.isNotNull(), F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last))


def judge_score(text: Column) -> Column:
    """The last bracketed whole number up to 100, else the last bare one."""
    pick = lambda p: F.try_element_at(F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda s: s.try_cast("int")), lambda n: n.isNotNull() & (n <= 100)), F.lit(-1))
    return F.coalesce(pick(r"\[\s*(\d+)\s*\]"), pick(r"(?<![\d.,])(\d+)(?![\d]|[.,]\d)"))


def response_field(record: Column) -> Column:
    """The answer in a JSON record: ``response`` itself, or its ``text`` or ``content`` if it is an object; '' if there is none."""
    whole = F.get_json_object(record, "$.response")
    inside = F.coalesce(*[F.nullif(F.get_json_object(record, f"$.response.{k}"), F.lit("")) for k in ("text", "content")])
    return F.coalesce(F.when(F.startswith(F.ltrim(whole), F.lit("{")), F.coalesce(inside, whole)).otherwise(whole), F.lit(""))


def loose_response(record: Column) -> Column:
    """The answer without thoughts, on one line."""
    return one_space(without_thoughts(response_field(record)))


def motivation(reply: Column) -> Column:
    """A judge's reason: what the third step says, up to the fourth step or a final score; without such a step, the last line before the last
    line that holds a bracketed number.  Null if there is neither."""
    lead = r"(?iu)^\s*motiva[tț]ie\s*[:\-]\s*"
    step = F.regexp_extract(reply, r"(?isu)(?<![\p{L}\d])PASUL\s*3(?![\p{L}\d])[\s:.\-]*(?:motiva[tț]ie[\s:.\-]*)?(.*?)(?=(?<![\p{L}\d])PASUL\s*4(?![\p{L}\d])|\[\s*\d{1,3}\s*\](?:\s*$)?|\z)", 1)
    has_step = reply.rlike(r"(?iu)(?<![\p{L}\d])PASUL\s*3(?![\p{L}\d])")
    rows = F.filter(F.transform(F.split(reply, r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    scored = r"\[\s*\d+\s*\]"
    last = F.array_max(F.transform(rows, lambda x, k: F.when(x.rlike(scored), k)))
    before = F.filter(rows, lambda x, k: (k < last) & ~x.rlike(scored))
    fallback = F.regexp_replace(F.try_element_at(before, F.lit(-1)), lead, "")
    return F.when(has_step, F.nullif(one_space(F.regexp_replace(step, lead, "")), F.lit(""))).otherwise(F.trim(fallback))


def run_name(name: Column) -> Column:
    """(model, date, past_days, seed) of a result file's name; a name without a seed has seed 1."""
    p = r"^(.*)_(\d{4}-\d{2}-\d{2})_(\d+)_past_days(?:_seed(\d+))?"
    g = lambda i: F.nullif(F.regexp_extract(name, p, i), F.lit(""))
    return F.struct(g(1).alias("model"), g(2).alias("date"), g(3).cast("int").alias("past_days"), F.when(g(1).isNotNull(), F.coalesce(g(4).cast("int"), F.lit(1))).alias("seed"))


def snapped(low: Column, high: Column, width: float = 2.0) -> Column:
    """(low, high, moved): the cell of the grid that holds the middle of an interval, and whether that changed it."""
    a = width * F.floor((low + high) / 2 / width)
    return F.struct(a.cast("double").alias("low"), (a + width).cast("double").alias("high"), ((F.abs(a - low) > 1e-9) | (F.abs(a + width - high) > 1e-9)).alias("moved"))


def point_distance(t: Column, low: Column, high: Column) -> Column:
    return F.when((t + low + high).isNotNull(), F.greatest(F.lit(0.0), low - t, t - high))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where it is used inside of lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def placed(text: Column, pattern: str) -> Column:
    """(start, hit) of every match of a pattern, from the lengths of the matches and of what lies between them."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    one = lambda z, h, k: F.struct((total(F.slice(z["gaps"], 1, k + 1)) + total(F.slice(z["hits"], 1, k))).alias("start"), h.alias("hit"))
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern).alias("gaps"))
    got = let(found, lambda z: F.transform(z["hits"], lambda h, k: one(z, h, k)))
    return F.when(text.isNotNull(), got).otherwise(F.array().cast("array<struct<start:int,hit:string>>"))


_NUMBER, _UNIT = r"(-?\d+(?:\.\d+)?)", r"(?:°\s*C|deg\s*C|grad[ei]?(?:\s+Celsius)?|C(?![\p{L}\d]))"
_APART = r"(?<![\p{L}\d])"
_BRACKET = rf"(?iu)\[\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\](?:\s*°?\s*C)?"
_WORDED = {"between": rf"(?iu){_APART}[iî]ntre\s+{_NUMBER}\s+[sș]i\s+{_NUMBER}(?:\s*{_UNIT})?", "over": rf"(?iu){_APART}peste\s+{_NUMBER}\s*{_UNIT}", "under": rf"(?iu){_APART}sub\s+{_NUMBER}\s*{_UNIT}"}


def _ends(pattern: str, ends) -> callable:
    number = lambda hit, k: F.regexp_extract(hit, pattern, k).cast("double")

    def of(text: Column) -> Column:
        def one(m: Column) -> Column:
            low, high = ends(lambda k: number(m["hit"], k))
            return F.struct(low.alias("low"), high.alias("high"), (m["start"] + F.length(m["hit"]) / 2).alias("middle"))

        return F.transform(placed(text, pattern), one)

    return of


_FORMS = [_ends(_BRACKET, lambda n: (n(1), n(2))), _ends(_WORDED["between"], lambda n: (n(1), n(2))), _ends(_WORDED["over"], lambda n: (n(1), n(1) + 2)), _ends(_WORDED["under"], lambda n: (n(1) - 2, n(1)))]


def bracket_intervals(text: Column) -> Column:
    """(low, high, middle) of every '[x, y]'; middle is the place of its middle."""
    return _FORMS[0](text)


def worded_intervals(text: Column) -> Column:
    """(low, high, middle) of 'între A și B', 'peste A °C' (A, A+2) and 'sub A °C' (A-2, A); the last two need a unit."""
    return F.concat(*[f(text) for f in _FORMS[1:]])


def intervals(text: Column) -> Column:
    """Bracketed intervals, then worded ones."""
    return F.concat(bracket_intervals(text), worded_intervals(text))


def wind_band(speed: Column) -> Column:
    return F.when(speed < 3, "slab").when(speed < 6, "moderat").when(speed.isNotNull(), "puternic")


def sky_band(oktas: Column) -> Column:
    return F.when(oktas <= 2, "senin").when(oktas <= 4, "variabil").when(oktas <= 6, "noros").when(oktas.isNotNull(), "acoperit")
