"""Problem 2: prompt and answer pairs that are unusable, with the kind of their defect.

Several noisy labelling functions vote on each kind of defect: for, against or not at all.  Each looks at one thing only, and many
sound answers have one vote against them: telegrams have no full stop, copies end where the prompt does, brief answers have few
words.  A label model per kind, fitted by expectation-maximisation on the counts of the vote patterns over all rows (at most 3
to the number of functions patterns, whatever the number of rows), gives each pattern the posterior of the defect.  The cutoff of
each kind is the one that separates best all rows with an answer from the same rows with defects planted by rule, each row with
every kind; the plants of the other kinds count as sound.  Of these, too, only counts of patterns are gathered.  A record keeps
every kind whose posterior exceeds its cutoff.

Defined results: a record without an answer (null messages, no assistant message, null content) is ``empty``; several messages of
one role are joined; a null prompt is taken as an empty one, for which no answer is a copy or in the wrong language; repeated
records are each judged; a stock phrase that declines is a ``refusal`` only, as so few words say little about their language, a
longer answer that declines in another language is both; an empty table gives no defects; ids may be of any type.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brumar.common import spread

KINDS = ("empty", "truncated", "refusal", "copied_question", "other_language")

# Frequent words of each language, without accents.
WORDS = {
    "ro": "si de la cu in un o a fost pe din este au s-a iar ora cel mai nu pentru prin sub peste care cele fata dintre ziua zilei vremea cerul vantul precum sunt ale lui ca",
    "en": "the of and to in was a with is than on at for it that this were be cannot i by from had day previous not write help your please stations showed",
    "fr": "le la les des et de du un une a ete plus que avec est dans pour ne pas je vous ce sur on au aux jours temps vent ciel",
    "de": "der die das und war in mit im zu den von ein eine als ist nicht auf um wurden des dem bei ich kann lag wehte",
    "hu": "a az es volt mint egy nem hogy is meg lett ban ben ora borusabb napokon elozo reggel szel eg",
    "it": "il la di e che un una con per del della non e stato stata piu alle si sono rispetto ai giorni nel cielo vento",
    "es": "el la los las de y que en un una con por para del al es fue mas no se dia cielo viento",
}
# Letters that belong to one language and not to Romanian or English.
LETTERS = {"fr": "éèêëàçùûœ", "de": "äöüß", "hu": "őűáéóöüúí", "it": "òùìèà", "es": "ñ¿¡áéíóú"}
# How answers decline.
SORRY = r"imi pare rau|ne pare rau|imi cer scuze|scuze|din pacate|regret|i'?m sorry|i am sorry|sorry|apologi[sz]e|unfortunately|i regret|desole|malheureusement|regrette|leider|entschuldig|tut mir leid|sajnal|elnezest|mi dispiace|purtroppo|spiacente|lo siento|lamento"
UNABLE = r"nu (?:imi |va |iti )?(?:pot|putem|am (?:posibilitatea|acces|cum)|dispun|sunt (?:in masura|capabil|autorizat)|este (?:posibil|permis))|trebuie sa (?:refuz|declin)|refuz sa|(?:cannot|can't|can not|could not|unable to|not able to|won'?t|will not|must decline|decline to|not allowed)|(?:ne|n') ?(?:peux|puis|peut|suis|est) (?:pas|malheureusement)|pas en mesure|kann (?:ich )?(?:\w+ ){0,6}nicht|nicht (?:in der lage|moglich)|nem (?:tudok|tudom|all modomban|segithetek)|non (?:posso|sono in grado|e possibile)|no puedo|no es posible"
AVOID = r"ca (?:model|asistent|inteligenta)|model lingvistic|asistent virtual|as an? (?:ai|language model|assistant)|language model|adresati-va|va recomand sa|reformulati|pot ajuta cu|alta (?:intrebare|solicitare)|aceasta solicitare|this request|another question|please contact|rephrase|en tant que|als (?:ki|sprachmodell)|mint (?:mesterseges|nyelvi)|come modello|como modelo|redactarea acestui|cereri|cererea"
BLANK = r"(?:n ?/? ?a|null|none|nan|nimic|fara raspuns|no answer|no response|todo|tbd|raspuns|answer|gol|empty|lipsa|x+|-+|\.+)"
LABELS = r"(?:prima|a doua|a treia|a patra|a cincea) propozitie|propozitia finala|(?:bucuresti|bucharest|bucarest|bukarest|capitala|ilfov|raspuns|raspunsul|diagnoza|diagnosis|answer|assistant)\b"
# Words after which an answer can't end.
OPEN_WORDS = set("si sau iar la de cu in pe din pentru un o a prin sub peste ca iar, cel mai fost au s-a the of and to with a in was at et de la le les und der die das mit im es az e di che il con".split())

_SETS = {k: frozenset(v.split()) for k, v in WORDS.items()}
_HIDDEN = re.compile(r"[­͏​-‏‪-‮⁠-⁤﻿]")
_WORD = re.compile(r"[^\W\d_][\w'-]*")
_TOKEN = re.compile(r"\w+(?:[.,]\d+)?")
_LABEL, _SORRY, _UNABLE, _AVOID = (re.compile(p) for p in (LABELS, r"\b(?:" + SORRY + ")", r"\b(?:" + UNABLE + ")", r"\b(?:" + AVOID + ")"))
_BLANK = re.compile(r"\W*(?:" + BLANK + r")?\W*")
_CUT_NUMBER = re.compile(r"(?<!ora )(?<![\d./-])-?\d{1,3}\.$")  # a decimal number that lost its decimals
_JOINED = re.compile(r"\b(?:și|si|iar|and|et|und|és|e)\b")
_READING = re.compile(r"\d+[.,]\d")
_TELEGRAM = re.compile(r"(?:^|[.\n:])\s*[^.:\n]{1,40}:(?:\s*[^\W\d][^\W\d]*(?:\s[^\W\d]+)?\s+[-−]?\d+(?:[.,]\d+)?\s*°\s*C\s*[,;]?){2,}\s*$")


_MARKS = re.compile("[\u0300-\u036f]+")
_LETTER_SETS = {k: frozenset(v) for k, v in LETTERS.items()}
_ROMANIAN = frozenset("ăâîșțşţ")
_ACCENTED = re.compile(r"[^\x00-\x7f]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


def folded(text: str) -> str:
    """Lower case without accents."""
    return _MARKS.sub("", unicodedata.normalize("NFD", text.lower()))


def language_counts(words: list[str]) -> dict[str, int]:
    """How many words are frequent words of each language."""
    count = Counter(words)
    return {k: sum(count[w] for w in count.keys() & s) for k, s in _SETS.items()}


def language_scores(counts: dict[str, int], n_words: int, low: str) -> dict[str, float]:
    """Share of each language's frequent words, and a bonus for letters of its own; ``low`` in lower case with accents."""
    n = max(n_words, 1)
    got = {k: c / n for k, c in counts.items()}
    if not low.isascii():
        letters = Counter(_ACCENTED.findall(low))
        for k, own in _LETTER_SETS.items():
            got[k] += 2 * sum(letters[c] for c in letters.keys() & own) / len(low)
        got["ro"] += 0.5 * sum(letters[c] for c in letters.keys() & _ROMANIAN) / n
    return got


def _grams(tokens: list[str], n: int = 4) -> set[tuple[str, ...]]:
    return set(zip(*(tokens[i:] for i in range(n)))) or ({tuple(tokens)} if tokens else set())


#: what is expected of a labelling function before any data: rows are truth yes and no, columns votes +, 0, -
BOTH, HINT, VETO = [[0.72, 0.18, 0.10], [0.02, 0.28, 0.70]], [[0.40, 0.59, 0.01], [0.02, 0.97, 0.01]], [[0.002, 0.996, 0.002], [0.002, 0.698, 0.30]]
FUNCTIONS = {
    "empty": [BOTH, BOTH, BOTH, BOTH],
    "truncated": [BOTH, BOTH, HINT, HINT, HINT, VETO, VETO, VETO, VETO],
    "refusal": [BOTH, HINT, HINT, BOTH, BOTH],
    "copied_question": [BOTH, BOTH, BOTH, BOTH],
    "other_language": [BOTH, BOTH, BOTH, BOTH],
}


def _sign(yes: bool, no: bool = False) -> str:
    return "+" if yes else "-" if no else "0"


class Asked:
    """What the functions look at in a prompt."""

    def __init__(self, prompt: str | None) -> None:
        u = _HIDDEN.sub("", prompt or "")
        fu = folded(u)
        by_line = [_TOKEN.findall(x) for x in fu.split("\n")]
        tu = [t for x in by_line for t in x]
        self.blank, self.grams = not fu.strip(), _grams(tu)
        self.lines = [q for q in map(" ".join, by_line) if len(q) > 8]
        wu = [t for t in tu if t[0].isalpha()]
        scores = language_scores(language_counts(wu), len(wu), u.lower())
        self.language, self.words = max(scores, key=scores.get), set(wu)


class Answered:
    """What the functions look at in an answer, and the votes that need no prompt."""

    def __init__(self, answer: str | None) -> None:
        a = _HIDDEN.sub("", answer or "").strip()
        low, fa = a.lower(), folded(a)
        said = _LABEL.sub(" ", fa)
        words = _WORD.findall(said)
        letters = sum(map(len, words))
        if letters <= 20:  # digits change nothing else
            letters += sum(c.isdigit() for c in said)
        full_words = len(words) >= 4
        readings = len(_READING.findall(a))

        # empty: no sign of speech; little left behind the labels; a stand-in; hardly a word
        nothing = not any(c.isalnum() for c in a)
        self.empty = _sign(nothing, full_words) + _sign(letters < 4, letters > 20) + _sign(bool(_BLANK.fullmatch(said)), full_words) + _sign(len(words) < 4, len(words) > 8 or readings > 0)

        # refusal: it can't; it is sorry at the start; it points elsewhere; it brings no readings; most of its sentences do one of these
        unable, sorry, avoid = bool(_UNABLE.search(fa)), bool(_SORRY.search(fa[: len(fa) // 4 + 80])), bool(_AVOID.search(fa))
        declining = 0.0
        if unable or sorry or avoid:
            parts = [x for x in _SENTENCE.split(fa) if len(x) > 12] or [fa]
            declining = sum(len(x) for x in parts if _UNABLE.search(x) or _SORRY.search(x) or _AVOID.search(x)) / max(1, sum(map(len, parts)))
        self.refusal = _sign(unable, not unable) + _sign(sorry) + _sign(avoid) + _sign(not readings and len(words) >= 3, readings >= 3) + _sign(declining >= 0.4, declining < 0.15)

        ta = _TOKEN.findall(fa)
        self.grams, self.flat = _grams(ta), " ".join(ta)
        self.words = [w for w in words if len(w) < 16]
        self.counts = language_counts(self.words)
        self.scores = language_scores(self.counts, len(self.words), _LABEL.sub(" ", low))
        self.language = max(self.scores, key=self.scores.get)
        self.few_words = len(self.words) < (25 if declining >= 0.4 else 8)  # a stock phrase says little about a language; neither do a few words

        # truncated: no closing mark; an open end; a bare word at the end; a number without its decimals; a bracket left open
        # against it: a telegram ends so; what is made of the prompt, or holds it, ends where the prompt does; hardly anything was said
        end = a[-1:] if a else ""
        cut_number = bool(_CUT_NUMBER.search(a))
        dots = a.endswith(("...", "…"))
        closed = end in ".!?”\"»)]’|" and not dots and not cut_number
        last = words[-1] if words else ""
        tail = _SENTENCE.split(a)[-1].rstrip()
        listed = tail.count("°") > 0 and tail.count(" la ") >= 1 and not _JOINED.search(tail.lower())
        self.truncated = (
            _sign(not closed, closed)
            + _sign(full_words and (dots or end in ",;:-(" or (last in OPEN_WORDS and not closed)), closed)
            + _sign(full_words and not closed and (listed or (end.isalpha() and not tail.endswith("°C"))))
            + _sign(full_words and cut_number)
            + _sign(full_words and not closed and a.count("(") + a.count("„") + a.count("“") != a.count(")") + a.count("”") + a.count("“"))
            + _sign(False, bool(_TELEGRAM.search(a[-200:])) and a[-80:].count("°") >= 3)
        )
        self.said_little = _sign(False, not full_words or (declining >= 0.4 and readings < 3))


def votes_of(q: Asked, s: Answered) -> dict[str, str]:
    """For each kind the votes of its functions: + for, - against, 0 no opinion.  No function sees what another one says."""
    # copied question: the answer is made of the prompt; the prompt is in the answer; whole lines of it are; it begins as it does
    both = len(q.grams & s.grams)
    inside, back = both / max(len(s.grams), 1), both / max(len(q.grams), 1)
    given = sum(x in s.flat for x in q.lines)
    begins = bool(q.lines) and q.lines[0] in s.flat[: len(q.lines[0]) + 60]
    copied = _sign(inside >= 0.6, inside < 0.4) + _sign(back >= 0.4, back < 0.25) + _sign(given >= max(1, 0.4 * len(q.lines)), given <= 0.2 * len(q.lines)) + _sign(begins, not begins)

    # other language: the frequent words are of another one; more so than of the prompt's; hardly any of the prompt's; few words of the prompt
    if s.few_words or q.blank:
        other = "0000"
    else:
        la, lu, sa, n = s.language, q.language, s.scores, len(s.words)
        home = s.counts[lu]
        away = max((c for k, c in s.counts.items() if k != lu), default=0)
        known = sum(w in q.words for w in s.words)
        other = _sign(la != lu and sa[la] > 1.2 * sa[lu], la == lu) + _sign(away > 1.5 * home and away >= 3, home >= away) + _sign(home <= 0.1 * n, home > 0.12 * n) + _sign(known < 0.15 * n, known > 0.3 * n)

    truncated = s.truncated + _sign(False, inside >= 0.5) + _sign(False, back >= 0.4) + s.said_little
    return {"empty": s.empty, "truncated": truncated, "refusal": s.refusal, "copied_question": copied, "other_language": other}


def votes(prompt: str | None, answer: str | None) -> dict[str, str]:
    """The votes on one pair."""
    return votes_of(Asked(prompt), Answered(answer))


class LabelModel:
    """Naive Bayes over votes with unknown truth, fitted by expectation-maximisation on pattern counts.

    ``expected`` holds, for each function, what is expected of it before any data; it weighs as much as ``strength`` of the rows.
    Where a function votes both ways, having no opinion says nothing; where it votes one way only, its silence counts.  A vote
    is taken to be right more often than not: it moves the odds at least ``LEAST``-fold the way it points, whatever the counts say.
    """

    CODE = {"+": 0, "0": 1, "-": 2}
    LEAST = 8.0

    def __init__(self, patterns: list[str], counts: list[float], expected: list | None = None, rounds: int = 100, strength: float = 0.02, share: float = 0.03) -> None:
        v = np.array([[self.CODE[c] for c in p] for p in patterns])
        w = np.array(counts, float)
        m = v.shape[1]
        expected = expected or [BOTH] * m
        self.share, self.table = share, np.array(expected)
        pseudo = max(10.0, strength * w.sum()) * self.table.copy()
        for _ in range(rounds):
            for j in range(m):
                self._sensible(j, both_ways=expected[j] is BOTH)
            q = self._posterior(v)
            before = self.table.copy()
            for j in range(m):
                for truth, weight in enumerate((w * q, w * (1 - q))):
                    # the weight of the prior is that of the side's own rows at most
                    prior = pseudo[j, truth] * min(1.0, (weight.sum() + 20) / max(10.0, strength * w.sum()))
                    n = np.bincount(v[:, j], weight, 3) + prior
                    self.table[j, truth] = n / n.sum()
            self.share = float(np.clip((w * q).sum() / w.sum(), 1e-4, 0.5))
            if np.abs(self.table - before).max() < 1e-7:
                break
        for j in range(m):
            self._sensible(j, both_ways=expected[j] is BOTH)

    def _sensible(self, j: int, both_ways: bool) -> None:
        yes, no = self.table[j]
        if both_ways:
            yes, no = yes / (1 - yes[1]), no / (1 - no[1])
            yes[1] = no[1] = 0.5
        for truth, other, vote in ((no, yes, 0), (yes, no, 2)):
            spare = max(0.0, truth[vote] - other[vote] / self.LEAST)
            truth[vote] -= spare
            truth[2 - vote if both_ways else 1] += spare
        self.table[j] = yes, no

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        yes = np.log(self.share) + sum(np.log(self.table[j, 0, v[:, j]]) for j in range(v.shape[1]))
        no = np.log(1 - self.share) + sum(np.log(self.table[j, 1, v[:, j]]) for j in range(v.shape[1]))
        return 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))

    def posterior(self, patterns: list[str]) -> np.ndarray:
        return self._posterior(np.array([[self.CODE[c] for c in p] for p in patterns])) if patterns else np.zeros(0)


# Plain examples from which planted defects are made.
_REFUSED = ["Îmi pare rău, dar nu pot scrie această diagnoză.", "I'm sorry, but I cannot help with this request.", "Ca model lingvistic, nu dispun de acces la date. Pot ajuta cu o altă întrebare.", "Din păcate, nu sunt în măsură să răspund la această solicitare."]
_FOREIGN = [
    "The day was warmer than the previous ones, with a mean high of 12.3 °C. The sky was cloudy and the wind was weak at the stations. It was 3.1 °C in the morning.",
    "Le temps a été plus chaud que les jours précédents, avec une moyenne de 12.3 °C. Le ciel était couvert et le vent est resté faible. Au matin on relevait 3.1 °C.",
    "Das Wetter war wärmer als an den Vortagen, das mittlere Maximum lag bei 12.3 °C. Der Himmel war bedeckt und der Wind wehte mit 3.1 m/s. Um sechs Uhr wurden 2.0 °C gemessen.",
    "Il tempo è stato più caldo rispetto ai giorni precedenti, con una media di 12.3 °C. Il cielo era coperto e il vento debole. Alle sei del mattino si registravano 3.1 °C.",
]
_EMPTY = ["", " ", "-", "...", "N/A", "null", "​"]


@lru_cache(maxsize=len(_REFUSED) + len(_FOREIGN) + len(_EMPTY))
def _stock(answer: str) -> Answered:
    """One of the plain examples, looked at once."""
    return Answered(answer)


def with_defects(i: int, u: str, a: str) -> dict[str, str]:
    """For each kind an answer with that defect, made by rule from a pair as it comes; ``i`` varies them, and a copy may lack its last fifth."""
    cut = a[: len(a) * (40 + i * 7 % 50) // 100].rstrip()
    return {
        "empty": _EMPTY[i % len(_EMPTY)],
        "refusal": _REFUSED[i % len(_REFUSED)],
        "copied_question": u if i % 3 else "Răspuns: " + u[: len(u) * 4 // 5],
        "other_language": _FOREIGN[i % len(_FOREIGN)],
        "truncated": cut if cut[-1:].isalpha() else cut.rstrip(" .!?0123456789-") + (" …" if i % 2 else ""),
    }


def planted(pairs: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Pairs with a planted defect, by kind."""
    made = [(u, with_defects(i, u, a)) for i, (u, a) in enumerate(pairs)]
    return {k: [(u, m[k]) for u, m in made] for k in KINDS}


def chosen_cutoff(bad: np.ndarray, good: np.ndarray, n_bad: np.ndarray | None = None, n_good: np.ndarray | None = None) -> float:
    """The cutoff with the best F1 on labelled rows, or on patterns of so many rows each; of a stretch of equally good ones, the middle."""
    n_bad, n_good = (np.ones(len(x)) if n is None else np.asarray(n, float) for x, n in ((bad, n_bad), (good, n_good)))
    grid = np.arange(0.05, 0.96, 0.05)
    f1 = np.array([2 * n_bad[bad > c].sum() / max(1, n_bad[bad > c].sum() + n_bad.sum() + n_good[good > c].sum()) for c in grid])
    best = np.flatnonzero(np.isclose(f1, f1.max()))
    return float(grid[best[len(best) // 2]])


def judged(df: DataFrame, row_id: str, messages: str) -> DataFrame:
    """(row id, defect, posterior) of every record and kind of defect that it has."""
    of = lambda role: F.array_join(F.filter(F.transform(F.filter(F.col(f"`{messages}`"), lambda m: m["role"] == role), lambda m: m["content"]), lambda c: c.isNotNull()), "\n")
    texts = df.select(F.col(f"`{row_id}`").alias("id"), of("user").alias("u"), of("assistant").alias("a"))
    rows = spread(texts, "id").withColumn("i", F.xxhash64("u", "a").bitwiseAND(2**31 - 1))
    kind = df.schema[row_id].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows with an answer as they are ("") and with each kind of defect planted: counts of (planted, kind, pattern)
        labelled: Counter = Counter()
        schema = None
        for b in batches:
            got = []
            for u, a, i in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                q = Asked(u)
                got.append(v := votes_of(q, Answered(a)))
                if a:
                    made = with_defects(i, u or "", a)
                    each = {"": v} | {k: votes_of(q, (_stock if k in ("empty", "refusal", "other_language") else Answered)(x)) for k, x in made.items()}
                    labelled.update((planted, k, pattern) for planted, x in each.items() for k, pattern in x.items())
            columns = [b.column(0), *[pa.array([g[k] for g in got], pa.string()) for k in KINDS], *[pa.nulls(len(got), t) for t in (pa.string(), pa.string(), pa.string(), pa.int64())]]
            out = pa.RecordBatch.from_arrays(columns, ["id", *KINDS, "planted", "defect", "pattern", "n"])
            schema = out.schema
            yield out
        if labelled:
            m = len(labelled)
            columns = [*[pa.nulls(m, schema.field(k).type) for k in ("id", *KINDS)], *[pa.array([x[j] for x in labelled], pa.string()) for j in range(3)], pa.array(labelled.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    columns = f"id {kind}, " + ", ".join(f"{k} string" for k in KINDS) + ", planted string, defect string, pattern string, n bigint"
    cast = rows.mapInArrow(vote, columns).persist(StorageLevel.MEMORY_AND_DISK)
    # one count for all kinds: patterns of five kinds together are few, as they are bounded by 3 ** (number of functions) each
    long = cast.where("planted is null").select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("defect"), F.col(k).alias("pattern")) for k in KINDS])).alias("q")).select("id", "q.*")
    counts: dict[str, dict[str, int]] = {k: {} for k in KINDS}
    for r in long.groupBy("defect", "pattern").count().collect():
        counts[r["defect"]][r["pattern"]] = r["count"]
    models = {k: LabelModel(list(c), list(c.values()), FUNCTIONS[k]) for k, c in counts.items() if c}
    # rows of the kind's own plants are bad; rows as they come, a few of which have defects of their own, and other plants are good
    bad: dict[str, dict[str, int]] = {k: {} for k in KINDS}
    good: dict[str, dict[str, int]] = {k: {} for k in KINDS}
    for r in cast.where("planted is not null").groupBy("planted", "defect", "pattern").agg(F.sum("n").alias("n")).collect():
        side = (bad if r["planted"] == r["defect"] else good)[r["defect"]]
        side[r["pattern"]] = side.get(r["pattern"], 0) + r["n"]
    accepted = []
    for k, model in models.items():
        cutoff = chosen_cutoff(model.posterior(list(bad[k])), model.posterior(list(good[k])), list(bad[k].values()), list(good[k].values())) if bad[k] else 0.5
        patterns = list(counts[k])
        accepted += [(k, pattern, float(p)) for pattern, p in zip(patterns, model.posterior(patterns)) if p > cutoff]
    table = df.sparkSession.createDataFrame(accepted, "defect string, pattern string, posterior double")
    return long.join(F.broadcast(table), ["defect", "pattern"]).select(F.col("id").alias(row_id), "defect", F.round("posterior", 6).alias("posterior"))
