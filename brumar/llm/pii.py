"""Problem 9: personal information inside free text, by a semi-Markov conditional random field.

A text is cut into segments that are either single tokens outside of any entity or whole entities.
Candidate entities are found generously (several spans and types for one place); features look at
whole spans, at the words around them and at the kinds of two entities that stand close together; a dynamic programme over the
candidates, whose length is bounded, chooses boundaries and types together, so that a name inside a street or an address inside
an e-mail loses to the entity around it.  Weights are fitted by maximum conditional likelihood
(forward-backward over the segment lattice) on sentences made by rule, of which every label is known.

Positions are code points of the text as it stands; before matching, spaces of all kinds, full-width
forms, invisible characters and combining accents are brought into plain form with a map back.

Defined results: null, empty and blank texts hold no items and stay as they are; very long texts are
worked on whole; a list of given names that is empty only removes one feature.
"""

from __future__ import annotations

import hashlib
import math
import random
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brumar.common import spread

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: most given names that are sent to the workers (more are an error), sentences the field is fitted on, given names in them
MOST_NAMES, TRAINING, FIT_NAMES = 50_000, 1500, 2000

# Street words, titles, words that announce an item, words that are no part of a name.
STREET = r"(?:strada|str|bulevardul|bulevard|bdul|b-dul|bd|calea|aleea|al|[șşs]oseaua|[șşs]os|pia[țţt]a|p-[țţt]a|intrarea|intr|splaiul|spl|drumul|fund[ăa]tura|prelungirea)"
STREET_EN = r"(?:street|st|lane|road|rd|avenue|ave|drive|way|court|square|terrace|close|place)"
TITLES = set("dl dna d-na d-l domnul doamna dlui dnei domnului doamnei domnisoara dr ing prof mr mrs ms miss sir dra".split())
CALLS = set("subsemnatul subsemnata petentul petenta solicitantul solicitanta redactat intocmit observator observatorul semneaza semnat contrasemnat vorbit contact reviewed attention of by de la cu mentiune reluat serviciu titular titularul numele domiciliat meteorolog signed prepared from".split())
NOT_NAMES = set(
    "bucuresti ilfov capitala romania baneasa filaret afumati aeroport parc statia strada bulevardul calea aleea piata intrarea soseaua sos luna ziua in la pe s-a cerul vremea vantul maximele temperatura nebulozitatea presiunea comparativ izolat dimineata ora buletin act cod cnp tel nr lot lotul prima doua treia patra cincea propozitie propozitia finala a raspunsul diagnoza stilul scoruri scores sentence style confidence file stamp wind aer fenomene istoric cantitatea medie tmax tmin rff1 nop zilele dinainte tinta sarcina date de intrare pentru podisul getic campia romana subcarpatii munteniei depresiunea brasovului dobrogea maramures oltenia olteniei moldova moldovei muntenia transilvania crisana banat litoral ianuarie februarie martie aprilie mai iunie iulie august septembrie octombrie noiembrie decembrie bucharest weather data mean daily high low stimate coleg buna catre serviciul adapostul instrumentele termometrul transmisia giruete datele cheia sunati vezi fisierul the please rain gauge keeper january february march april june july september october november december nord sud est vest n e v s".split()
)
SURNAME = re.compile(r"(?:escu|eanu|anu|ariu|oiu|iuc|ciuc|iuta|aru|ache|andru|oreanu|worthy|worth|ham|combe|combley|wick|wickle|ley|low|down|holme|field|ford|ton|son|bury|stone|by)$")
ID_WORDS, TEL_WORDS, MAIL_WORDS = (re.compile(p) for p in (r"\b(?:cnp|cod(?:ul)? numeric|buletin\w*|c\.?i|b\.?i|seri[ae]|identitate|personal\w*)\b[^a-z0-9]*(?:nr[^a-z0-9]*)?$", r"\b(?:tel\w*|mobil|sunati|la|contact|on|phone|call|fax|ori|sau)\b\W*$", r"\b(?:mail|e-mail|adresa|contact|to|scrie\w*)\b\W*$"))
#: names, street names and so on of the sentences for fitting are built from these parts
_PARTS = "bor ma lun te vi rad cos ne stan gri pe lo du ma ri can tu mi ver pos da gal hor zam nis tro fil".split()

_L = r"\p{L}\p{M}"
_HIDDEN = re.compile(r"[­͏؜​-‏‪-‮⁠-⁤﻿]")
_ODD = re.compile(r"[ ­͏ -‏‐‑ -  -⁤　﻿！-～\p{M}]")
_EMAIL = re.compile(rf"(?<![\w.+-])[\w+][\w.+-]*(?:\s?(?:@|\(at\)|\[at\])\s?)[\w-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\])\s?)[\w-]+)*", re.I)
_PHONE = re.compile(r"(?:(?<![\w.,/])|(?<=\d[./])(?=\+))(?:\+|\(|\d)[\d()]*(?:[ ./\-]{1,2}\(?\d[\d()]*)*")
_DATE = re.compile(r"(?<!\d)(?:\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})(?!\d)")
_CODE = re.compile(r"(?<![\w.+-])[1-9] ?\d{6} ?\d{6}(?!\d)")
_CARD = re.compile(r"(?<![\w-])[A-Z]{2}(?: ?[Nn][Rr]\.?)? ?\d{6}(?!\d)")
_WORDS = rf"(?:\p{{Lu}}\.|[{_L}][{_L}'’\-]*)"
_STREET = re.compile(rf"(?<![\w-])(?:(?:nr\.? ?)?\d{{1,4}} ?[A-Z]?,? )?{STREET}\b\.?\s{{1,2}}(?:{_WORDS}\s{{1,2}}){{0,5}}?{_WORDS}(?:,?\s{{1,2}}(?:nr|num[ăa]rul|no)\.?\s?|,?\s{{1,2}}|,)\d{{1,4}}(?: ?[A-Z]\b)?(?:,\s{{1,2}}(?:bl|sc|et|ap|corp|sector\w*)\.?\s?[\w]+)*", re.I)
_STREET_ONLY = re.compile(rf"(?<![\w-])\d{{1,4}}[A-Z]?,? {STREET}\b\.?\s{{1,2}}(?:\p{{Lu}}[{_L}'’\-]*\s?(?:de\s)?){{1,4}}", re.I)
_STREET_EN = re.compile(rf"(?<![\w.,-])\d{{1,4}}[A-Z]?,? (?:\p{{Lu}}[{_L}'’\-]*\s){{1,4}}?(?i:{STREET_EN})\b")
_CAP = rf"(?:\p{{Lu}}[{_L}]+(?:[-’']\p{{Lu}}[{_L}]+)*|\p{{Lu}}\.)"
_NAME = re.compile(rf"(?<![\w@.+-])(?={_CAP})(?:{_CAP}(?:\s{{1,2}}|(?<=\.)(?=\p{{Lu}})))+{_CAP}(?![\w@])", re.M)
_CAPWORD = re.compile(_CAP)
_NO_DIGIT, _DIGIT_GROUP, _GROUP_START = (re.compile(p) for p in (r"\D", r"\d+(?=[ ./\-()]|$)", r"^|(?<=[\d)][ ./\-]{1,2})(?=\(?\d)"))
_AT_SIGN = re.compile(r"@|[(\[]at[)\]]", re.I)
_DOMAIN, _LETTER = re.compile(r"(?:@|at[)\]]).*(?:\.|dot[)\]])\s?[a-z]{2,}$"), re.compile(r"[a-z]")
_HOME, _HOME_PREFIX = re.compile(r"(?:\+|00)40|\(?0[1-9]"), re.compile(r"^(?:\+|00)40(?:\s?\(0\)\s?)?|^\(?0")
_ANY_WORD, _STREET_WORD, _NUMBER_WORD = re.compile(rf"[{_L}][{_L}'’\-]*"), re.compile(STREET + "|nr|bl|sc|ap|et", re.I), re.compile(r"\b(?:nr|num[ăa]rul|no)\b", re.I)
_ABBREVIATED, _NEW_SENTENCE, _NUMBER_FIRST = re.compile(r"^\P{L}*\p{L}+\.|\b(?:nr|bl|sc|ap|et)\.", re.I), re.compile(r"[.!?]\s+\p{Lu}"), re.compile(r"\d|nr", re.I)
_DEGREE = re.compile(r"[°º˚\d]\s*$")  # what stands before it is a reading, so the letter is its unit and no initial
_HEAD, _THEN = re.compile(r"[\w-]+"), re.compile(r"\s?[,;(]?\s?(?:tel|cnp|cod num|mobil|despre|si contra|domicil|-|\()")
_TOKENS = re.compile(r"\w+")
# The words of STREET and STREET_EN, and the last part of those with a hyphen.
STREET_TOKENS = frozenset("strada str bulevardul bulevard bdul dul bd calea aleea al șoseaua şoseaua soseaua șos şos sos piața piaţa piata ța ţa ta intrarea intr splaiul spl drumul fundătura fundatura prelungirea".split())
STREET_EN_TOKENS = frozenset("street st lane road rd avenue ave drive way court square terrace close place".split())
#: characters between two entities within which one has a bearing on the next
NEAR = 12


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text in plain characters and, where lengths differ, the place of each character in the original."""
    if not _ODD.search(text):
        return text, None
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        if _HIDDEN.match(c):
            continue
        if unicodedata.combining(c) and out:
            if c == "̧":
                c = "̦" if out[-1] in "sStT" else c
            joined = unicodedata.normalize("NFC", out[-1] + c)
            if len(joined) == 1:
                out[-1] = joined
            continue
        if "！" <= c <= "～":
            c = chr(ord(c) - 0xFEE0)
        elif c in "‐‑":
            c = "-"
        elif c != "\n" and unicodedata.category(c) in ("Zs", "Zl", "Zp"):
            c = " "
        out.append(c)
        at.append(i)
    at.append(len(text))
    return "".join(out), at


@lru_cache(100_000)
def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def valid_code(digits: str) -> tuple[bool, bool]:
    """Whether a personal code holds a possible date, and its check digit."""
    dated = digits[0] in "12345678" and 1 <= int(digits[3:5]) <= 12 and 1 <= int(digits[5:7]) <= 31
    check = sum(int(a) * b for a, b in zip(digits, (2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9))) % 11  # fixed values
    return dated, int(digits[12]) == (1 if check == 10 else check)


def candidates(text: str, given: frozenset[str]) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(start, end, kind, features) of every span that might be an entity."""
    got: list[tuple[int, int, str, tuple[str, ...]]] = []
    before = lambda i: fold(text[max(0, i - 32) : i])
    if _AT_SIGN.search(text):
        for m in _EMAIL.finditer(text):
            s = m.group().rstrip(".-")
            whole = fold(s)
            f = ["e_sign" if "@" in s else "e_spelt", "e_dot" if _DOMAIN.search(whole) else "e_no_dot", "e_call" if MAIL_WORDS.search(before(m.start())) else "e_no_call", "e_tight" if " " not in s else "e_spaced"]
            f.append("e_clear" if "@" in s and f[1] == "e_dot" else "e_unclear")
            f.append("e_letters" if _LETTER.match(whole) else "e_no_letters")
            got.append((m.start(), m.start() + len(s), "email", tuple(f)))
    for m in _PHONE.finditer(text):
        s = m.group()
        if len(s) < 6 or len(_NO_DIGIT.sub("", s)) < 6:
            continue
        stops = [e.end() for e in _DIGIT_GROUP.finditer(s)]
        dated, inside = (set().union(*(range(e.start() + k, e.end()) for e in _DATE.finditer(s))) for k in (0, 1))
        # a number before may belong to the run, so every group of digits may begin a phone, but for those inside a date
        starts = (e.end() for e in _GROUP_START.finditer(s))
        for start, stop in ((a, x) for a in starts if a not in inside for x in stops[bisect_right(stops, a) : bisect_right(stops, a) + 15]):
            part = s[start:stop]
            d = _NO_DIGIT.sub("", part)
            if not 7 <= len(d) <= 15:
                continue
            country = part[0] == "+" or d.startswith("00")
            national = _HOME_PREFIX.sub("", part) if _HOME.match(part) else None
            size = len(_NO_DIGIT.sub("", national)) if national is not None else 0
            f = ["t_nine" if size == 9 else "t_other_size", "t_mobile" if national and _NO_DIGIT.sub("", national)[:1] in "237" else "t_area"]
            f.append("t_country" if country else "t_home")
            if country and national is None:
                f.append("t_abroad" if 10 <= len(d) <= 14 and part[0] == "+" else "t_bad_abroad")
            f.append("t_call" if TEL_WORDS.search(before(m.start() + start)) else "t_no_call")
            f.append("t_paired" if part.count("(") == part.count(")") else "t_unpaired")
            after = text[m.start() + stop : m.start() + stop + 1]
            f.append("t_goes_on" if after.isdigit() or after == "-" and stop < len(s) else "t_ends")
            if not dated.isdisjoint(range(start, stop)) if start else _DATE.match(part):
                f.append("t_date")
            if d[0] != "0" and part[0] not in "+(":
                f.append("t_no_zero")
            if "." in part and len(part.split(".")) == 2:
                f.append("t_decimal" if "(" not in part else "t_point")
            got.append((m.start() + start, m.start() + stop, "phone", tuple(f)))
    for m in _CODE.finditer(text):
        dated, check = valid_code(_NO_DIGIT.sub("", m.group()))
        got.append((m.start(), m.end(), "id_number", ("i_dated" if dated else "i_undated", "i_check" if check else "i_no_check", "i_both" if dated and check else "i_not_both", "i_call" if ID_WORDS.search(before(m.start())) else "i_no_call")))
    for m in _CARD.finditer(text):
        got.append((m.start(), m.end(), "id_number", ("c_card", "c_nr" if "r" in m.group().lower()[2:] else "c_direct", "c_call" if ID_WORDS.search(before(m.start())) else "c_no_call")))
    heard = set(_TOKENS.findall(text.lower()))  # most texts hold no street word at all
    patterns = [(p, k) for p, k, w in ((_STREET, "ro", STREET_TOKENS), (_STREET_ONLY, "first", STREET_TOKENS), (_STREET_EN, "en", STREET_EN_TOKENS)) if not w.isdisjoint(heard)]
    for pattern, kind in patterns:
        for m in pattern.finditer(text, overlapped=kind == "ro"):
            words = _ANY_WORD.findall(m.group())
            inner = [w for w in words if not _STREET_WORD.fullmatch(w)]
            upper = sum(w[0].isupper() for w in inner)
            f = ["a_" + kind, "a_named" if inner and upper * 2 >= len(inner) else "a_low", "a_nr" if _NUMBER_WORD.search(m.group()) else "a_bare", "a_long" if len(inner) > 4 else "a_short"]
            f.append("a_break" if "\n" in m.group() or _NEW_SENTENCE.search(_ABBREVIATED.sub("", m.group())) else "a_flow")
            f.append("a_word" if not _NUMBER_FIRST.match(m.group()) else "a_number")
            if inner and not inner[0][0].isupper():
                f.append("a_low_first")
            got.append((m.start(), m.end(), "address", tuple(f)))
    for m in _NAME.finditer(text):
        toks = [(t.start() + m.start(), t.end() + m.start()) for t in _CAPWORD.finditer(m.group())]
        for i in range(len(toks)):
            for n in range(2, len(toks) - i + 1):
                span = text[toks[i][0] : toks[i + n - 1][1]]
                words = [fold(text[a:b]) for a, b in toks[i : i + n]]
                if sum(w.endswith(".") for w in words) == n or (len(words[0]) == 2 and words[0][1] == "." and _DEGREE.search(text, max(0, toks[i][0] - 3), toks[i][0])):
                    continue
                known = [any(p in given for p in w.split("-")) for w in words]
                family = [bool(SURNAME.search(w)) and len(w) > 4 and not w.endswith(".") for w in words]
                initial = [w.endswith(".") and len(w) == 2 for w in words]
                bad = sum(w.rstrip(".") in NOT_NAMES or w.rstrip(".") in TITLES for w in words)
                if n > 3 and (bad or sum(not (k or x or y) for k, x, y in zip(known, family, initial)) > 1):
                    break  # nor can a longer one be a name: four and more words with at most one that looks like none
                head = _HEAD.findall(before(toks[i][0]))
                f = [f"n_known{min(2, sum(known))}", f"n_family{min(2, sum(family))}", "n_both" if any(known) and any(x and not k for x, k in zip(family, known)) else "n_not_both", f"n_bad{min(2, bad)}", *([f"n_size{n}"] if n < 4 else [])]
                if not any(known) and not any(family):
                    f.append("n_nobody" if call_before(head) else "n_nobody_calls")
                if any(initial):
                    f.append("n_initial_family" if any(family) else "n_initial")
                if any(initial[1:]) and n == 2 and not family[0]:
                    f.append("n_initial_last")
                call = call_before(head)
                f.append("n_title" if head and head[-1] in TITLES else "n_call" if call else "n_no_call")
                if n > 3:
                    f.append(f"n_long{min(2, n - sum(k or x for k, x in zip(known, family)))}")
                if call:
                    f.append("n_after_" + head[-1])
                if i + n < len(toks) and i == 0:
                    f.append("n_left")
                if "\n" in span:
                    f.append("n_line")
                after = fold(text[toks[i + n - 1][1] : toks[i + n - 1][1] + 12])
                f.append("n_then" if _THEN.match(after) else "n_other")
                if sum(w.isupper() for w in span.split()) == n and not any(known):
                    f.append("n_shout")
                got.append((toks[i][0], toks[i + n - 1][1], "name", tuple(f)))
    return got


def call_before(head: list[str]) -> bool:
    """Whether the word before announces a name."""
    return bool(head) and (head[-1] in TITLES or head[-1] in CALLS)


def _scores(cands, weights: dict[str, float]) -> list[float]:
    return [sum(weights.get(f, 0.0) for f in c[3]) + weights[c[2]] for c in cands]


def _follows(a, b) -> str:
    """The feature of two entities that stand close together."""
    return f"x_{a[2]}_{b[2]}" if b[0] - a[1] > 1 else f"x_{a[2]}_then_{b[2]}"


def best(cands, weights: dict[str, float]):
    """The segments of the most probable segmentation, by dynamic programming over candidates in order of their ends.

    What stands before a candidate is either far, where only the best score counts, or within ``NEAR`` characters, where the
    kinds of both entities count too.
    """
    if not cands:
        return []
    cands = sorted(cands, key=lambda c: (c[1], c[0]))
    score, ends = _scores(cands, weights), [c[1] for c in cands]
    top, via = [], []  # the best segmentation that ends with each candidate, and its candidate before
    peak: list[tuple[float, int]] = []  # the best of the first candidates, or of none
    for k, c in enumerate(cands):
        far = bisect_left(ends, c[0] - NEAR)
        value, back = max((0.0, -1), peak[far - 1]) if far else (0.0, -1)
        for j in range(far, bisect_right(ends, c[0])):
            if j < k and top[j] + (t := weights.get(_follows(cands[j], c), 0.0)) > value:
                value, back = top[j] + t, j
        top.append(value + score[k])
        via.append(back)
        peak.append(max((top[k], k), peak[-1]) if peak else (top[k], k))
    value, k = peak[-1]
    out = []
    while k >= 0 and value > 0:
        out.append(cands[k])
        k = via[k]
    return out[::-1]


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def _expected(cands, weights: dict[str, float]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Marginal probability of every candidate and of every two close ones in a row; candidates in order of their ends."""
    n = len(cands)
    score, ends = _scores(cands, weights), [c[1] for c in cands]
    close = [[j for j in range(bisect_left(ends, c[0] - NEAR), bisect_right(ends, c[0])) if j < k] for k, c in enumerate(cands)]
    if not any(close) and all(a[1] <= b[0] for a, b in zip(cands, cands[1:])):
        return [1 / (1 + math.exp(-x)) if x > -700 else 0.0 for x in score], {}
    t = {(j, k): weights.get(_follows(cands[j], cands[k]), 0.0) for k in range(n) for j in close[k]}
    alpha, total = [], []  # of all segmentations that end with a candidate; of those that end with one of the first, or none
    for k, c in enumerate(cands):
        far = bisect_left(ends, c[0] - NEAR)
        value = total[far - 1] if far else 0.0
        for j in close[k]:
            value = _log_sum(value, alpha[j] + t[j, k])
        alpha.append(value + score[k])
        total.append(_log_sum(total[-1] if total else 0.0, alpha[k]))
    after: list[list[int]] = [[] for _ in cands]
    for j, k in t:
        after[j].append(k)
    by_start = sorted(range(n), key=lambda k: -cands[k][0])
    beta = [0.0] * n
    rest: list[tuple[int, float]] = []  # starts, descending, with the sum of what may begin there or later, or of nothing
    for j in sorted(range(n), key=lambda j: -cands[j][1]):
        while len(rest) < n and cands[by_start[len(rest)]][0] >= cands[j][1]:
            k = by_start[len(rest)]
            rest.append((-cands[k][0], _log_sum(rest[-1][1] if rest else 0.0, score[k] + beta[k])))
        far = bisect_left(rest, (-(cands[j][1] + NEAR), -math.inf))
        value = rest[far - 1][1] if far else 0.0
        for k in after[j]:
            value = _log_sum(value, t[j, k] + score[k] + beta[k])
        beta[j] = value
    z = total[-1]
    one = [math.exp(min(0.0, alpha[k] + beta[k] - z)) for k in range(n)]
    return one, {(j, k): math.exp(min(0.0, alpha[j] + x + score[k] + beta[k] - z)) for (j, k), x in t.items()}


def sentences(n: int, given: list[str], seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences made by rule, with the places, ends and kinds of their entities."""
    r = random.Random(seed)
    given = given or ["Ana", "Ion"]
    word = lambda k=3: "".join(r.choice(_PARTS) for _ in range(r.randint(2, k))).capitalize()
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def name():
        g = r.choice(given) if r.random() < 0.75 else word()
        if r.random() < 0.1:
            g += "-" + r.choice(given)
        elif r.random() < 0.15:
            g = " ".join([g, *(r.choice(given) for _ in range(r.randint(1, 3)))])
        s = word(2) + r.choice(["escu", "eanu", "ariu", "iuc", "oiu", "iuță", "anu", "worthy", "combley", "low", "wick"]) if r.random() < 0.6 else word()
        if r.random() < 0.2:
            s = s.upper()
        if r.random() < 0.12:
            return f"{g[0]}. {s}"
        return f"{g} {s}" if r.random() < 0.6 else f"{s} {g}"

    def street():
        w = r.choice([word(), f"{r.choice(given)} {word(2)}eanu", f"{word()} {word()}", f"{word()}ilor de {word(2)}", f"{word()} de Jos"])
        if r.random() < 0.25:
            return f"{r.randint(1, 200)} {word()} {r.choice(['', word() + ' '])}{r.choice(['Lane', 'Road', 'Street'])}"
        s = r.choice(["Strada", "Str.", "str.", "Bd.", "Bulevardul", "Calea", "Aleea", "Șos.", "Sos.", "Piața", "Piata", "Intrarea", "STRADA"])
        nr = r.choice([" nr. ", ", nr ", " ", " nr. "]) + str(r.randint(1, 220)) + r.choice(["", "", "", "A", "B"])
        return f"{s} {w}{nr}" + r.choice(["", "", f", bl. B{r.randint(1, 30)}, ap. {r.randint(1, 60)}", f", sc. {r.choice('ABC')}"])

    def phone():
        a = "7" + digits(8)
        return r.choice([f"0{a[:3]} {a[3:6]} {a[6:]}", f"0{a[:3]}-{a[3:6]}-{a[6:]}", f"0{a[:3]}.{a[3:6]}.{a[6:]}", f"0{a[:3]}/{a[3:]}", f"0{a}", f"+40{a}", f"+40 {a[:3]} {a[3:6]} {a[6:]}", f"0040 {a[:3]} {a[3:]}", f"+40 (0){a[:3]} {a[3:5]} {a[5:7]} {a[7:]}", f"021 {a[1:4]} {a[4:6]} {a[6:8]}", f"(021) {a[1:4]}.{a[4:8]}", f"+44 7700 {digits(6)}"])

    def code():
        if r.random() < 0.45:
            return r.choice(["XB", "RT", "MZ", "KX"]) + r.choice([" ", "", " nr. ", " nr "]) + digits(6)
        while True:
            d = r.choice("1256") + f"{r.randint(0, 99):02}{r.randint(1, 12):02}{r.randint(1, 28):02}" + digits(5)
            for c in "0123456789":
                if valid_code(d + c)[1]:
                    d += c
                    return d if r.random() < 0.8 else f"{d[0]} {d[1:7]} {d[7:]}"

    def email():
        a = r.choice([fold(r.choice(given)) + digits(2), f"{fold(word())}.{fold(word())}", f"{word()}.{word()}", fold(word()) + "+date", f"{fold(word())}_{fold(word())}{digits(1)}"])
        d = f"{fold(word())}.{r.choice(['example', 'test', 'invalid', 'ro', 'com'])}"
        return r.choice([f"{a}@{d}", f"{a}@{d}", f"{a}@mail.{d}", f"{a} @ {d}", f"{a}(at){d.replace('.', '(dot)')}", f"{a} [at] {d}", f"{a}@{d}".upper()])

    make = {"name": name, "address": street, "phone": phone, "id_number": code, "email": email}
    shapes = [
        "Redactat de {name}, tel. {phone}.", "Observator: {name}.", "Am vorbit cu dna {name} despre citire.", "Subsemnatul, {name}, CNP {id_number}, domiciliat în {address}, cere extrasul.",
        "Contact: {email}; {phone}.", "Contact: {phone}, {email}.", "Sunați la {phone} sau la {phone}.", "Buletin {id_number} notat; mail {email}.", "Act seria {id_number}, eliberat.", "Cheia este la {name} ({address}).", "Mențiune: {address}.", "Reluat: {name}.",
        "Pluviometrul de pe {address} a fost verificat.", "Răspunsul a fost semnat de {name} și contrasemnat de {name}.", "Please send it to {email}, attention of {name}.", "The gauge stands at {address}; call {phone}.", "Mențiune: {phone}.", "Reluat: {id_number}.", "Datele se trimit la adresa {email} până la ora 9.", "Reviewed by {name}.",
        "Colega {name} preia tura de noapte.", "La ora 6 {name} a notat bruma.", "I-am scris lui {name}.", "Tabelul lipsea, iar {name} a refăcut citirile.", "{name} lipsește azi.", "Yesterday {name} wrote the log.",
    ]
    nothing = [
        lambda: f"Lotul nr. {digits(6)} conține {digits(4)} de rânduri.", lambda: f"File stamp 1{r.randint(4, 7)}{digits(11)}, lot 2024-{digits(4)}.", lambda: f"Fișierul SirDate_1{digits(12)} a fost reîncărcat.", lambda: f"Cod 07{digits(2)} în tabela B, {r.randint(100, 900)} {digits(3)} de citiri.",
        lambda: f"Vânt @{r.randint(1, 30)} m/s la etaj.", lambda: f"Wind @ {r.randint(1, 30)} m above ground.", lambda: f"{r.randint(2010, 2024)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}:{r.randint(0, 59):02} {word()} a fost {fold(word())}.", lambda: f"Băneasa Aeroport și Filaret Parc au raportat.",
        lambda: f"Stația {digits(5)}, coordonate {digits(2)}.{digits(2)} N, {digits(2)}.{digits(2)} E.", lambda: "Calea ferată a rămas deschisă, iar pe bulevard vizibilitatea a scăzut.", lambda: f"Pe strada principală s-a format polei, în {r.randint(2, 30)} de locuri.", lambda: f"Temperatura a fost de {r.randint(-10, 30)}.{digits(1)} °C la Filaret, {r.randint(1, 30)}.{digits(1)} °C la Băneasa.",
        lambda: f"Scoruri: [0.{digits(2)}, 0.{digits(2)}, 0.{digits(2)}]", lambda: f"În {r.choice(['Câmpia Română', 'Podișul Getic', 'Subcarpații Munteniei', 'Depresiunea Brașovului'])} mediile au fost {r.randint(1, 30)}.", lambda: f"Presiunea a fost de {r.randint(980, 1030)}.{digits(1)} hPa, {word()} {fold(word())} {r.randint(10, 99)}%.",
        lambda: f"În intervalul {r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1990, 2024)}, ora {r.randint(1, 9)}: {word()}.", lambda: f"Vă rugăm să verificați maxima din {r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1990, 2024)}.", lambda: f"{r.randint(2010, 2024)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} | max {r.randint(1, 30)}.{digits(1)} | min {r.randint(1, 30)}.{digits(1)}",
        lambda: f"Luna {fold(word())} {r.randint(1990, 2024)} a fost {fold(word())}.", lambda: f"{word()} {word()} au fost {fold(word())}.", lambda: f"Vezi https://arhiva.{fold(word())}/diagnoze/2014/{digits(2)} pentru scan.",
    ]
    nothing += [
        lambda: f"Maxima a fost de {r.randint(-9, 39)}.{digits(1)} °C. {r.choice(['Vântul', 'Cerul', 'Nebulozitatea', 'Dimineața', word()])} a fost {fold(word())}.", lambda: f"A plouat la {word()} {word()} și la {word()}.", lambda: f"Medie de {r.randint(1, 39)} m/s. {word()} {fold(word())} {fold(word())}.",
        lambda: f"Furtuna „{word()}” a trecut prin {word()} {word()}.", lambda: f"{r.choice(['Vântul', 'Cerul', 'Ceața', 'Ploaia'])} a {fold(word())}.",
    ]
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.4:
                text += r.choice(nothing)() + r.choice([" ", "\n"])
                continue
            for part in re.split(r"(\{\w+\})", r.choice(shapes)):
                kind = part[1:-1]
                if kind in make:
                    part = make[kind]()
                    gold.append((len(text), len(text) + len(part), kind))
                text += part
            text += r.choice([" ", "\n"])
        yield text, gold


def fit(given: list[str], n: int = TRAINING, rounds: int = 60, rate: float = 0.5, ridge: float = 0.002) -> dict[str, float]:
    """Weights that make the known segmentations of the sentences most probable (adaptive gradient steps)."""
    names = frozenset(fold(g) for g in given)
    data = []
    for text, gold in sentences(n, given):
        cands = sorted(candidates(text, names), key=lambda c: (c[1], c[0]))
        if not cands:
            continue
        want = {(start, kind): end for start, end, kind in gold}
        # the span with the entity's own end is the right one; where none has it, the longest that draws nothing else in
        right: dict[tuple[int, str], int] = {}
        for k, c in enumerate(cands):
            key = (c[0], c[2])
            if key in want and not any(c[0] < at < c[1] for at, _, _ in gold) and (key not in right or cands[right[key]][1] != want[key]):
                right[key] = k
        chosen = sorted(right.values())
        rows = {(j, k) for j, k in zip(chosen, chosen[1:]) if 0 <= cands[k][0] - cands[j][1] <= NEAR}
        data.append((cands, set(chosen), rows))
    w: dict[str, float] = {k: -1.0 for k in KINDS}
    seen: dict[str, float] = {}
    for _ in range(rounds):
        grad: dict[str, float] = {}
        for cands, right, rows in data:
            one, two = _expected(cands, w)
            for k, p in enumerate(one):
                d = (k in right) - p
                if abs(d) > 1e-4:
                    for f in (cands[k][2], *cands[k][3]):
                        grad[f] = grad.get(f, 0.0) + d
            for (j, k), p in two.items():
                f = _follows(cands[j], cands[k])
                grad[f] = grad.get(f, 0.0) + ((j, k) in rows) - p
        for f, g in grad.items():
            g = g / len(data) - ridge * w.get(f, 0.0)
            seen[f] = seen.get(f, 0.0) + g * g
            w[f] = w.get(f, 0.0) + rate * g / math.sqrt(seen[f] + 1e-8)
    w["x_name_then_name"] = -20.0  # two names with nothing but a blank between them are one
    return w


@lru_cache(4)
def fitted(given: tuple[str, ...]) -> dict[str, float]:
    """Weights for a list of given names; fitted once a process."""
    return fit(list(given))


def entities(text: str | None, given: frozenset[str], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in code points."""
    if not text or text.isspace():
        return []
    clean, at = plain(text)
    found = best(candidates(clean, given), weights)
    if at is None:
        return [c[:3] for c in found]
    return [(at[a], at[b - 1] + 1, kind) for a, b, kind, _ in found]


def found(df: DataFrame, row_id: str, text: str, given: DataFrame, name_column: str = "prenume") -> DataFrame:
    """(row id, items array of (tip, poz, pana), redacted): the entities of every row and the text with placeholders."""
    names = [r[0] for r in given.select(name_column).where(f"`{name_column}` is not null").distinct().limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} given names")
    # the sentences for fitting are made with some of the names, drawn by their hash; all of them are known to the field
    weights = fitted(tuple(sorted(names, key=lambda x: hashlib.md5(x.encode()).digest())[:FIT_NAMES]))
    known = frozenset(fold(n) for n in names)
    kind = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("tip", pa.string()), ("poz", pa.int32()), ("pana", pa.int32())]))
        for b in batches:
            items, texts = [], []
            for t in b.column(1).to_pylist():
                got = entities(t, known, weights)
                items.append([{"tip": k, "poz": a, "pana": e} for a, e, k in got])
                for a, e, k in reversed(got):
                    t = t[:a] + PLACEHOLDER[k] + t[e:]
                texts.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, shape), pa.array(texts, pa.string())], [b.schema.names[0], "items", "redacted"])

    rows = df.select(F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{text}`").alias("x"))
    return spread(rows, "row_id").mapInArrow(run, f"row_id {kind}, items array<struct<tip:string,poz:int,pana:int>>, redacted string").withColumnRenamed("row_id", row_id)
