"""The text problems against brute force, round trips and held-out cases, and their edge cases."""

import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("brumar.llm")

from brumar.llm import defects, lookalike, mixing, overlap, pii, tokens  # noqa: E402

VOCAB = "/opt/tokenizers/byte_bpe_50k.json"
has_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary here")
NAMES = ["Ana", "Ion", "Maria", "Andrei", "Elena", "Radu", "Ioana", "Mihai"]


def form(*texts):
    return lookalike.consistent(pa.array(list(texts), pa.string())).to_pylist()


def test_alike_texts_get_one_form():
    same = ["Ştiinţă ﬁnă 12 °C", "Știință finǎ".replace("ǎ", "ă") + " 12 °C", "Ştiinţă ﬁnă １２ ºС", "Știință​ fi­nă 12 ˚C", "Știință fină 12 ℃", "Știință͏ fină 12 °С"]
    assert len(set(form(*same))) == 1
    differ = ["Stiinta", "Știință", "știință", "m2", "m²", "12", "13", "a b", "ab"]
    assert len(set(form(*differ))) == len(differ)
    assert form(None, "", "a\nb", "​") == [None, "", "a\nb", ""]
    # the order of marks of different classes does not matter; marks never move over a row
    assert len(set(form("ậ", "ậ", "ậ"))) == 1
    assert form("a", "̂b") == ["a", "̂b"]
    assert form("x" * 100_000 + "ﬂ")[0] == "x" * 100_000 + "fl"
    assert lookalike.consistent(pa.array([], pa.string())).to_pylist() == []
    assert lookalike.consistent(pa.array(["z", "ﬁ", None, "ș"])[1:]).to_pylist() == ["fi", None, "ș"]


def test_the_form_is_the_canonical_one():
    """Over all code points: where only accents are at stake, the form is NFC, from whatever spelling."""
    import unicodedata as u

    folded = set(map(chr, lookalike.NO_WIDTH)) | set(lookalike.CYRILLIC) | set(lookalike.GREEK) | set(lookalike.OTHER)
    soft = "\u015e\u015f\u0162\u0163"
    chars = [c for c in map(chr, range(0x80, 0x30000)) if not 0xD800 <= ord(c) < 0xE000 and u.category(c) not in ("Cf", "Zs", "Zl", "Zp", "Cn", "Co") and u.normalize("NFKC", c) == u.normalize("NFC", c) and not folded & set(u.normalize("NFD", c)) and c not in soft]
    assert len(chars) > 100_000
    for spelling in ("NFC", "NFD"):
        got = form(*[u.normalize(spelling, c) for c in chars])
        assert [c for c, g in zip(chars, got) if g != u.normalize("NFC", c)] == []
    # several marks in a row, and marks that block one another
    r = random.Random(0)
    marks = [chr(c) for c in (0x300, 0x301, 0x302, 0x304, 0x307, 0x308, 0x30C, 0x323, 0x328, 0x331, 0x345, 0x5B0, 0x93C)]
    texts = ["".join(r.choice("aeouAEIYǖạlαωक") + "".join(r.choices(marks, k=r.randint(0, 4))) for _ in range(4)) for _ in range(3000)]
    texts = [t for t in texts if not folded & set(u.normalize("NFD", t))]
    assert form(*texts) == [u.normalize("NFC", t) for t in texts]


def test_alike_pairs_against_brute_force(spark):
    base = ["Vânt slab, 3 °C", "Vant slab, 3 °C", "Cer senin", "", None, "   ", " "]
    twist = [lambda s: s, lambda s: s.replace(" ", " "), lambda s: s.replace("°", "º"), lambda s: s.replace("a", "а")]
    rows = []
    for i, (b, f) in enumerate(itertools.product(base, twist)):
        rows += [(3 * i, None if b is None else f(b)), (3 * i + 1, None if b is None else f(b))]
    got = sorted(map(tuple, lookalike.alike_pairs(spark.createDataFrame(rows, "id bigint, x string"), "id", "x").collect()))
    c = dict(zip([i for i, _ in rows], form(*[t for _, t in rows])))
    want = sorted((a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x and y and c[a].strip() and x != y and c[a] == c[b])
    assert got == want and got
    classes = lookalike.alike_classes(spark.createDataFrame(rows, "id bigint, x string"), "id", "x").collect()
    assert {x["id"] for x in classes} == {i for i, t in rows if t and c[i].strip()}
    links = sum(x["n_rows"] - sum(y["class"] == x["class"] and dict(rows)[y["id"]] == dict(rows)[x["id"]] for y in classes) for x in classes)
    assert links == 2 * len(got)
    assert lookalike.alike_pairs(spark.createDataFrame([], "id bigint, x string"), "id", "x").count() == 0
    with pytest.raises(ValueError):
        lookalike.with_consistent(spark.createDataFrame([(1, "a")], "id int, consistent string"), "consistent", "consistent")


@has_vocab
def test_encoding_equals_the_public_tokenizer():
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(VOCAB)
    ref.encode_special_tokens = True
    r = random.Random(1)
    letters = "aăâîșțeiou  \n\t.,0123456789'@Șdсж汉🤖é́<|>"
    texts = ["", " ", "\n\n  a", "a" * 3000, "ab12" * 500, "<|endoftext|>", "It's we'll", "  x", *["".join(r.choice(letters) for _ in range(r.randint(1, 80))) for _ in range(400)]]
    t = tokens.Transducer(VOCAB, most_words=0)
    mine = [t.encode(x) for x in texts]
    assert mine == [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]
    assert ["".join(t.decode(i)) for i in mine] == texts
    small = tokens.Transducer(VOCAB, most_states=50, most_words=3)  # forgetting changes nothing
    assert [small.encode(x) for x in texts[:120]] == mine[:120]
    assert t.encode(None) == []
    euro = [i for i, b in t.bytes_of.items() if b == b"\xe2"] + [t.byte_id[0x41]]
    assert "".join(t.decode(euro)) == "�A"
    (special,) = t.special
    assert "".join(t.decode([t.byte_id[0x41], special])) == "A<|endoftext|>"


@has_vocab
def test_encoded_frames(spark):
    df = spark.createDataFrame([(1, "Vânt slab", "x"), (2, None, "y"), (3, "", "z")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(df, "doc_id", "text").collect()}
    assert got[2] == [] and got[3] == [] and got[1] == tokens.transducer().encode("Vânt slab")
    assert tokens.encoded(df.limit(0), "doc_id", "text").count() == 0
    assert all(r["same"] for r in tokens.round_trip(df, "doc_id", "text").collect())


def test_flight_keeps_the_balance():
    r = np.random.default_rng(0)
    for k in range(20):
        n = r.integers(1, 500, 400).astype(float)
        p = np.full(400, 0.37)
        q = mixing.flight(p, n, np.random.default_rng(k), False)
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert q.sum() == pytest.approx(p.sum()) and (q * n).sum() == pytest.approx((p * n).sum())
        q = mixing.flight(p, n, np.random.default_rng(k), True)
        assert set(q) <= {0.0, 1.0} and abs((q * n).sum() - (p * n).sum()) <= 0.001 * (p * n).sum()
    mean = np.mean([mixing.flight(np.full(7, 0.4), np.arange(1.0, 8), np.random.default_rng(k), True) for k in range(3000)], axis=0)
    assert np.abs(mean - 0.4).max() < 0.08
    assert len(mixing.flight(np.zeros(0), np.zeros(0), np.random.default_rng(0), True)) == 0


def test_large_documents_are_decided_so_that_the_rest_can_mend():
    n = np.array([5000.0, 3000.0, 900.0])
    for seed in range(200):
        uses = mixing.decide_large(n, 0.64, 7000.0, 2100.0, 1.0, np.random.default_rng(seed), 3)
        assert set(uses) <= {0.0, 1.0} and 0 <= 7000 - (uses * n).sum() <= 2100 + 1e-6
    many = [mixing.decide_large(n, 0.5, 50_000.0, 91_100.0, 1.0, np.random.default_rng(k), 3) for k in range(2000)]
    assert np.abs(np.mean(many, axis=0) - 0.5).max() < 0.05  # where the rest can mend, every one by its probability
    assert np.isnan(mixing.decide_large(n, 0.5, 5000.0, 100.0, 1.0, np.random.default_rng(0), 1)).sum() == 2


TABLES = "/root/testdata/sf0.01"


@has_vocab
@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_shares_of_the_tables(spark):
    from brumar.llm import queries

    rows = queries.p8_shares(spark, TABLES).collect()
    assert sum(r["real_share"] for r in rows) == pytest.approx(1)
    for r in rows:
        assert r["most_uses"] <= r["max_repeat"] and abs(r["tokens"] - r["wanted_tokens"]) <= 0.005 * r["wanted_tokens"]


def test_needs_shares_what_small_sources_lack():
    got = mixing.needs({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000.0, "b": 60.0, "c": 0.0}, 400.0)
    assert got["c"] == 0 and got["b"] == 60 and got["a"] == pytest.approx(340)


@has_vocab
def test_mixing_frames(spark):
    r = random.Random(0)
    docs = [(i, " ".join("vânt" for _ in range(r.randint(1, 60))), ["a", "b", None, "x"][i % 4]) for i in range(800)] + [(900, None, "a"), (901, "", "b")]
    target = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("none", 0.1, 3), (None, 0.0, 1)], "source string, target_share double, max_repeat int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    chosen, report = mixing.mixed(df, target, "doc_id", "text", "source")
    rows, rep = chosen.collect(), {x["source"]: x for x in report.collect()}
    assert {x["source"] for x in rows} == {"a", "b"} and all(x["uses"] <= {"a": 2, "b": 1}[x["source"]] for x in rows)
    assert len({x["doc_id"] for x in rows}) == len(rows)
    assert rep["none"]["real_share"] == 0 and rep["a"]["real_share"] / rep["b"]["real_share"] == pytest.approx(2, rel=0.02)
    chosen, report = mixing.mixed(df.limit(0), target, "doc_id", "text", "source")
    assert chosen.count() == 0 and report.count() == 3


def prompt(values, date="2020-01-02"):
    it = iter(values)
    lines = [f"Date pentru {date}", f"Tmax {next(it)} °C", f"Tmin {next(it)} °C", f"precipitații {next(it)}"]
    return "\n".join(lines + [f"- ieri: {x}" for x in it])


def test_overlaps_against_brute_force(spark):
    r = random.Random(5)
    value = lambda: f"{r.randint(-99, 399) / 10:.1f}"
    train, test = [], []
    for i in range(60):
        v = [value() for _ in range(r.choice([9, 12, 15]))]
        train.append((i, prompt(v)))
        w = list(v)
        kind = i % 6
        if kind == 1:
            for k in r.sample(range(len(w)), 2):
                w[k] = value()
        elif kind == 2:
            w = w[:-3]
        elif kind == 3:
            w = [x.replace(".", ",") for x in w]
        elif kind == 4:
            w = [value() for _ in w]
        elif kind == 5:
            w = w + [value()] * 2
        test.append((1000 + i, prompt(w, "03.01.2020").replace("\n", "\n\n").upper()))
    test += [(2000, None), (2001, "  "), (2002, "fără cifre"), (2003, test[0][1])]
    train += [(500, None), (501, "fără cifre")]
    cols = "id bigint, text string"
    got = {(x["train_id"], x["test_id"]) for x in overlap.cross_split(spark.createDataFrame(train, cols), spark.createDataFrame(test, cols)).collect()}
    want = {(i, 1000 + i) for i in range(60) if i % 6 != 4} | {(0, 2003), (501, 2002)}
    assert got == want
    assert overlap.cross_split(spark.createDataFrame([], cols), spark.createDataFrame(test, cols)).count() == 0


COLS = "id bigint, text string"


def pairs_of(spark, train, test, **k):
    return {(x["train_id"], x["test_id"]) for x in overlap.cross_split(spark.createDataFrame(train, COLS), spark.createDataFrame(test, COLS), **k).collect()}


@pytest.mark.parametrize("n", [7, 9, 12, 20])
def test_recall_of_changed_and_dropped_readings(spark, n):
    """Against all pairs counted: those with 0.7 of their readings in common, or all of the shorter one."""
    r = random.Random(n)
    value = lambda: f"{r.randint(-150, 360) / 10:.1f}" if r.random() > 0.15 else "0.0"
    train, test = {}, {}
    for i in range(400):
        v = [value() for _ in range(n)]
        w = list(v)
        for p in sorted(r.sample(range(n), r.randint(1, max(1, int(0.3 * n)))), reverse=True):
            if i % 2:
                w[p] = value()
            elif len(w) > 3:
                del w[p]
        train[i], test[1000 + i] = v, w
    want = set()
    for (i, v), (j, w) in itertools.product(train.items(), test.items()):
        m = sum((Counter(v) & Counter(w)).values())
        if m >= 0.7 * max(len(v), len(w)) or m == min(len(v), len(w)) and m >= 0.6 * max(len(v), len(w)):
            want.add((i, j))
    rows = [(i, prompt(v)) for i, v in train.items()], [(j, prompt(w, "03.01.2020")) for j, w in test.items()]
    got = pairs_of(spark, *rows)
    assert not got - want and len(got) >= (0.94 if n == 7 else 0.985) * len(want)
    # coverage decides: without the exact check fewer than one in a thousand other pairs come out
    loose = pairs_of(spark, *rows, share=0.0, share_inside=0.5)
    assert len(loose - want) <= 0.001 * len(train) * len(test) and len(loose & want) >= 0.9 * len(want)


def test_the_order_of_the_suffixes_decides():
    """Spans come from neighbours in sorted order; the same rows unsorted give other spans."""
    r = random.Random(3)
    base = [r.randint(1, 400) for _ in range(3)]
    part = [(bytes([i]), i % 2 == 0, i % 2 == 1, 0, 1, None, base + [r.randint(1, 3) for _ in range(6)], 9) for i in range(40)]
    part.sort(key=lambda x: x[6])
    want = set()
    for a in part:
        for b in part:
            if a[1] and b[2]:
                n = next((k for k, (x, y) in enumerate(zip(a[6], b[6])) if x != y), 9)
                want.add((a[0], b[0], 0, 1, 1, n, 9))
    assert set(overlap.shared(part)) == want
    mixed_up = list(part)
    r.shuffle(mixed_up)
    assert set(overlap.shared(mixed_up)) != want


def test_long_prompts_are_covered_to_their_end(spark):
    r = random.Random(4)
    v = [f"{x / 10:.1f}" for x in r.sample(range(20, 990), 300)]
    w = list(v)
    w[-1] = "1.1"
    (row,) = overlap.cross_split(spark.createDataFrame([(1, prompt(v))], COLS), spark.createDataFrame([(2, prompt(w))], COLS)).collect()
    assert row["covered"] == pytest.approx(299 / 300) and row["longest"] == 300
    part = [(b"a", True, False, 0, 1, None, list(range(90)), 90), (b"b", False, True, 0, 1, None, list(range(90)), 90)]
    assert [s[5] for s in overlap.shared(part)] == [overlap.REACH]


def test_a_stretch_that_all_prompts_share_gives_no_pairs(spark):
    r = random.Random(6)
    block = [f"{x}.5" for x in range(10, 20)]
    some = lambda: [f"{r.randint(1000, 90000) / 100:.2f}" for _ in range(5)]
    rows = lambda first, n: [(first + i, prompt(some() + block + some())) for i in range(n)]
    train, test = rows(0, 700), rows(10_000, 700)
    test += [(20_000 + i, t.replace("2020-01-02", "5.1.2020")) for i, t in train[:50]]
    near = [(30_000 + i, t.replace(t.split("ieri: ")[1].split("\n")[0], "99.9")) for i, t in train[50:100]]
    test += near
    want = {(i, 20_000 + i) for i in range(50)} | {(i, 30_000 + i) for i in range(50, 100)}
    assert pairs_of(spark, train, test) == want
    # the part of all prompts is there, and pairs of rare tokens part it
    seqs = [[round(float(x) * 100) for x in re.findall(r"\d+\.\d+", t)] for _, t in train + test[:700]]
    flat, of = np.array(sum(seqs, [])), np.repeat(np.arange(1400), 20)
    w = overlap.Weights({round(float(x) * 100): 0.02 for x in block})
    assert np.unique(overlap.beginnings(flat, of, w)[2], return_counts=True)[1].max() >= 1400
    batch = pa.RecordBatch.from_pydict({"c": [bytes([i % 256, i // 256]) for i in range(1400)], "in_train": [i < 700 for i in range(1400)], "in_test": [i >= 700 for i in range(1400)], "seq": seqs})
    key = np.concatenate([b.column(0).to_numpy() for b in overlap._rare(iter([batch]), w, 0.6)])
    assert np.unique(key, return_counts=True)[1].max() < 40


def shuffled_bytes(spark):
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_suffixes_are_moved_once_and_packed(spark):
    r = random.Random(12)
    rows = lambda first, n: [(first + i, prompt([f"{r.randint(-150, 360) / 10:.1f}" for _ in range(12)])) for i in range(n)]
    train, test = rows(0, 3000), rows(10_000, 1500)
    test[0] = (10_000, train[5][1].replace("2020-01-02", "7.8.2021"))
    before = shuffled_bytes(spark)
    assert pairs_of(spark, train, test) == {(5, 10_000)}
    assert shuffled_bytes(spark) - before < 800 * len(train + test)


def test_parts_end_only_pairs_that_have_too_little_in_common(monkeypatch):
    r = random.Random(13)
    seqs = [[r.randint(1, 60) for _ in range(r.choice([8, 12, 20]))] for _ in range(300)]
    seqs += [s[:-2] + [r.randint(1, 60) for _ in range(r.randint(0, 3))] for s in seqs] + [list(range(400)), list(range(380))]
    batch = pa.RecordBatch.from_pydict({"c": [7 * i for i in range(len(seqs))], "in_train": [i % 5 > 0 for i in range(len(seqs))], "in_test": [i % 3 == 0 for i in range(len(seqs))], "seq": seqs})
    w = overlap.Weights({})
    of, key, view, at, *_ = overlap._suffixes(batch, w, overlap.BITS)
    enough = set()
    parts = {}
    for i, k in zip(of.tolist(), key.view(np.int64).tolist()):
        parts.setdefault(k, set()).add(i)
    for k, members in parts.items():
        for i, j in itertools.permutations(members, 2):
            m, longest = sum((Counter(seqs[i]) & Counter(seqs[j])).values()), max(len(seqs[i]), len(seqs[j]))
            if i % 5 > 0 and j % 3 == 0 and (m >= 0.7 * longest or m == min(len(seqs[i]), len(seqs[j])) and m >= 0.6 * longest):
                enough |= {(k, 7 * i), (k, 7 * j)}
    run = lambda: [x for b in overlap._parted(overlap._packed(iter([batch.slice(0, 250), batch.slice(250)]), w, overlap.BITS, 3), 0.7, 0.6) for x in b.select(["hot", "key", "c", "view", "at"]).to_pylist()]
    got = run()
    assert not any(x["hot"] for x in got) and enough and {(x["key"], x["c"]) for x in got} >= enough
    assert {(x["key"], x["c"], x["view"], x["at"]) for x in got} <= set(zip(key.view(np.int64).tolist(), (7 * of).tolist(), view.tolist(), at.tolist()))
    assert len(got) < 0.75 * len(key)
    # keys that come too often are named and not moved, and nothing gets lost
    monkeypatch.setattr(overlap, "OFTEN", 1)
    got = run()
    named = {x["key"] for x in got if x["hot"]}
    assert named and {(x["key"], x["c"]) for x in got} | {(k, c) for k, c in enough if k in named} >= enough


def test_prompts_without_readings_go_by_their_words(spark):
    a = "Descrie pe scurt vremea din municipiul București pentru cititorii de azi, folosind datele de la cele 12 stații"
    train = [(1, a), (2, "???"), (3, "Scrie altceva despre munte și despre mare, fără nicio cifră"), (4, None)]
    test = [(11, a.replace("cititorii", "cititori")), (12, a.replace("12", "13")), (13, "???"), (14, "Scrie altceva despre munte și despre mare, fără nicio cifra!"), (15, ""), (16, a.upper())]
    assert pairs_of(spark, train, test) == {(1, 11), (1, 16), (2, 13), (3, 14)}


def test_classes_are_not_multiplied_out(spark):
    r = random.Random(8)
    v = [[f"{r.randint(-99, 399) / 10:.1f}" for _ in range(12)] for _ in range(3)]
    train = [(i, prompt(v[0])) for i in range(30)] + [(100, prompt(v[1]))]
    near = [*v[0][:5], "77.7", *v[0][6:]]
    test = [(500 + i, prompt(v[0], "2.1.2020")) for i in range(20)] + [(600, prompt(near)), (601, prompt(v[2])), (602, None)]
    got = {x["id"]: x for x in overlap.linked_classes(spark.createDataFrame(train, COLS), spark.createDataFrame(test, COLS)).collect()}
    assert {got[500 + i]["class"] for i in range(20)} == {got[500]["class"]} and got[500]["n_links"] == 1 and got[500]["n_train"] == 30
    assert (got[600]["n_links"], got[600]["n_train"]) == (1, 30) and got[600]["covered"] == pytest.approx(11 / 12)
    assert (got[601]["n_links"], got[601]["n_train"]) == (0, 0) and 602 not in got
    assert overlap.linked_classes(spark.createDataFrame([], COLS), spark.createDataFrame([], COLS)).count() == 0


def test_two_changes_anywhere_are_found(spark):
    v = ["3.1", "14.2", "0.0", "7.5", "21.6", "11.9", "8.4", "17.3", "5.5"]
    test = []
    for n, (a, b) in enumerate(itertools.combinations(range(9), 2)):
        w = list(v)
        w[a], w[b] = "99.1", "88.2"
        test.append((100 + n, prompt(w)))
    assert len(pairs_of(spark, [(1, prompt(v))], test)) >= len(test) - 1


PROMPT = "Se cere diagnoza vremii la București pentru 2019-03-07.\nMaxima medie a zilei a fost 13.7 grade, iar minima medie 8.6 grade.\nCantitatea medie de apă: 29.5 l/mp. Vânt mediu 2.3 m/s.\nCerul: 5 optimi în 44 de observații.\nRespectă structura cu cinci propoziții și nu inventa valori."
SOUND = "BUCUREȘTI. Vremea a fost caldă față de zilele precedente, cu o maximă medie de 13.7 °C. Cerul a fost noros, iar vântul a suflat slab până la 9.2 m/s. La ora 6 se înregistrau 8.6 °C la Filaret, 8.1 °C la Băneasa și 8.4 °C la Afumați."


def test_defects_found_and_sound_answers_left(spark):
    r = random.Random(2)
    rows, want = [], set()

    def add(answer, kind=None, question=PROMPT):
        i = len(rows)
        msgs = [("system", "Rol"), ("user", question)] + ([("assistant", answer)] if answer != "absent" else [])
        rows.append((i, msgs))
        if kind:
            want.add((i, kind))

    for k in range(300):
        n = [f"{r.randint(-90, 350) / 10} °C" for _ in range(4)]
        text = SOUND.replace("13.7 °C", n[0]).replace("8.6 °C", n[1])
        add([text, text.replace("ș", "s").replace("ă", "a").replace("ț", "t").replace("â", "a"), text + " Valoarea din tabel („Cerul: 5 optimi în 44 de observații.”) a fost verificată.", "BUCUREȘTI. Temperatura maximă a fost de 2.1 °C la Filaret, 2.9 °C la Băneasa și 1.7 °C la Afumați.", text + " Stația nu a transmis valoarea de la ora 12."][k % 5])
    for a in ("", None, "...", "N/A", "​", "PRIMA PROPOZIȚIE:\nA DOUA PROPOZIȚIE:", "absent"):
        add(a, "empty")
    for a in (SOUND[:145], SOUND[:143], SOUND[:201], SOUND[:118], SOUND[:90] + "…"):
        add(a.rstrip(), "truncated")
    for a in ("Îmi pare rău, dar nu pot scrie această diagnoză.", "I'm sorry, but I can't help with this.", "Ca model lingvistic, nu dispun de acces la date."):
        add(a, "refusal")
    for a in (PROMPT, "Răspuns: " + PROMPT, PROMPT[: len(PROMPT) * 4 // 5], PROMPT.upper()):
        add(a, "copied_question")
    english = "The day was warmer than the previous ones, with a mean high of 12.1 °C. The sky was cloudy and the wind was weak at the stations in the city."
    add(english, "other_language")
    add("Le temps a été plus chaud que les jours précédents, avec une maximale moyenne de 12.1 °C. Le ciel était couvert et le vent est resté faible dans la ville.", "other_language")
    add(english, None, "Weather data for Bucharest on 2019-03-07. The mean daily high was 13.7 and the mean daily low was 8.6 at the stations. Write the diagnosis for the day in five sentences.")
    df = spark.createDataFrame(rows, "train_id bigint, messages array<struct<role:string,content:string>>")
    got = {(x["train_id"], x["defect"]) for x in defects.judged(df, "train_id", "messages").collect()}
    assert got == want
    nothing = spark.createDataFrame([(1, None)], "train_id bigint, messages array<struct<role:string,content:string>>")
    assert [x["defect"] for x in defects.judged(nothing, "train_id", "messages").collect()] == ["empty"]
    assert defects.judged(nothing.limit(0), "train_id", "messages").count() == 0


def test_the_label_model_decides():
    """Any vote, or most votes, would take sound answers for truncated ones; the model learns which votes to trust."""
    r = random.Random(4)
    telegram = "BUCUREȘTI. Vremea a fost caldă, cu o maximă medie de 13.7 °C. Temperatura maximă: Filaret 7.1 °C, Băneasa 7.0 °C, Afumați 6.9 °C"
    answers = [(SOUND.replace("13.7", f"{r.randint(1, 300) / 10}"), False) for _ in range(900)] + [(telegram.replace("7.1", f"{r.randint(1, 90) / 10}"), False) for _ in range(30)]
    answers += [(PROMPT.rstrip("."), False) for _ in range(12)] + [(SOUND[: r.choice([90, 110, 150, 190])].rstrip(" .0123456789"), True) for _ in range(25)]
    got = [defects.votes(PROMPT, a)["truncated"] for a, _ in answers]
    count = Counter(got)
    m = defects.LabelModel(list(count), list(count.values()), defects.FUNCTIONS["truncated"])
    post = dict(zip(count, m.posterior(list(count))))
    truth = [t for _, t in answers]
    planted = defects.planted([(PROMPT, a) for a, _ in answers[:60]])
    bad, good = (m.posterior([defects.votes(u, a)["truncated"] for k, p in planted.items() if (k == "truncated") == yes for u, a in p]) for yes in (True, False))
    cutoff = defects.chosen_cutoff(bad, good)
    assert [post[v] > cutoff for v in got] == truth
    assert ["+" in v for v in got] != truth  # any vote
    # cutoffs matter: one that nothing was validated on gives other rows
    assert any((post[v] > 0.01) != t for v, t in zip(got, truth))


def test_cutoffs_come_from_all_rows(spark, monkeypatch):
    """Each row with an answer is labelled as it is and with every kind of defect planted, however many rows there are."""
    rows = [(i, [("user", PROMPT), ("assistant", SOUND.replace("13.7", f"{i % 40}.{i // 40}"))]) for i in range(400)] + [(400, [("user", PROMPT)])]
    seen = {}
    real = defects.chosen_cutoff

    def chosen(bad, good, *n):
        seen[len(seen)] = [sum(x) for x in n] or [len(bad), len(good)]
        return real(bad, good, *n)

    monkeypatch.setattr(defects, "chosen_cutoff", chosen)
    df = spark.createDataFrame(rows, "train_id bigint, messages array<struct<role:string,content:string>>")
    got = {(x["train_id"], x["defect"]) for x in defects.judged(df, "train_id", "messages").collect()}
    assert got == {(400, "empty")}
    assert list(seen.values()) == [[400, 400 * 5]] * 5
    # patterns with counts give the cutoff of the rows one by one
    bad, good = np.array([0.9, 0.6, 0.6, 0.2]), np.array([0.1, 0.1, 0.4, 0.7])
    assert defects.chosen_cutoff(np.array([0.9, 0.6, 0.2]), np.array([0.1, 0.4, 0.7]), [1, 2, 1], [2, 1, 1]) == defects.chosen_cutoff(bad, good)


def test_a_record_keeps_several_defects(spark):
    long_no = "I'm sorry, but I cannot help with this request for the city. As an AI language model I am not able to write a weather report for the day that was given. Unfortunately I cannot do so at all, and I must decline to write it. Please contact another service for this request."
    rows = [(str(i), [("user", PROMPT), ("assistant", SOUND.replace("13.7", f"{i}.3"))]) for i in range(200)]
    rows += [("x", [("user", PROMPT), ("assistant", long_no)]), ("y", [("user", PROMPT), ("assistant", "I'm sorry, but I can't help with this.")])]
    df = spark.createDataFrame(rows, "train_id string, messages array<struct<role:string,content:string>>")
    got = {(x["train_id"], x["defect"]) for x in defects.judged(df, "train_id", "messages").collect()}
    assert got == {("x", "refusal"), ("x", "other_language"), ("y", "refusal")}


def test_label_model_finds_the_rare_class():
    r = np.random.default_rng(0)
    truth = r.random(5000) < 0.03
    votes = ["".join("+" if r.random() < (0.85 if t else 0.02) else "0" if r.random() < 0.1 else "-" for _ in range(4)) for t in truth]
    names = sorted(set(votes))
    m = defects.LabelModel(names, [votes.count(n) for n in names])
    post = dict(zip(names, m.posterior(names)))
    guess = np.array([post[v] > 0.5 for v in votes])
    assert (guess == truth).mean() > 0.99


@pytest.fixture(scope="module")
def field():
    return pii.fit(NAMES), frozenset(pii.fold(n) for n in NAMES)


def test_entities_of_held_out_sentences(field):
    weights, given = field
    right = wrong = total = 0
    for text, gold in pii.sentences(300, NAMES, seed=123):
        got, want = {(a, k) for a, _, k in pii.entities(text, given, weights)}, {(a, k) for a, _, k in gold}
        right, wrong, total = right + len(got & want), wrong + len(got - want), total + len(want)
    assert right / total > 0.96 and wrong / total < 0.02  # a third of the names have no word and no ending that tells


def test_entities_in_context(field):
    weights, given = field
    find = lambda t: [(t[a:b], k) for a, b, k in pii.entities(t, given, weights)]
    assert find("Redactat de Ana Popescu, tel. 0708 123 456.") == [("Ana Popescu", "name"), ("0708 123 456", "phone")]
    assert find("domiciliat în Strada Mihai Zăvoreanu nr. 12, cere") == [("Strada Mihai Zăvoreanu nr. 12", "address")]
    assert find("The gauge stands at 108 Misty Ford Lane; call +44 7700 900123.") == [("108 Misty Ford Lane", "address"), ("+44 7700 900123", "phone")]
    assert find("mail ion.popescu @ posta.example. Vânt @4 m/s") == [("ion.popescu @ posta.example", "email")]
    assert find("În intervalul 05.01.2015, ora 7: 142 431 de citiri. Calea ferată a rămas deschisă. Vânt 12.3 m/s.") == []
    # places are code points of the text as it stands
    odd = "​🤖 Redactat de A­na Popescu, tel. ０７０８ 123 456."
    (a, b, k), (c, d, m) = pii.entities(odd, given, weights)
    assert odd[a:b] == "A­na Popescu" and odd[c:d] == "０７０８ 123 456" and (k, m) == ("name", "phone")
    assert pii.entities(None, given, weights) == pii.entities("  ", given, weights) == pii.entities("", given, weights) == []
    long = "Vremea a fost rece. " * 20_000 + "Observator: Ana Popescu."
    assert [(k, long[a:b]) for a, b, k in pii.entities(long, given, weights)] == [("name", "Ana Popescu")]


def test_entities_inside_runs(field):
    weights, given = field
    find = lambda t: [(t[a:b], k) for a, b, k in pii.entities(t, given, weights)]
    for t in ("ora 12 0721 234 567", "2014-05-03 0721 234 567 apel", "12/+40 721 234 567"):
        assert [k for _, k in find(t)] == ["phone"] and find(t)[0][0].endswith("721 234 567") and find(t)[0][0][0] in "0+"
    for c in "/-. ":
        assert find(f"Mențiune: 0721234567{c}0722345678.") == [("0721234567", "phone"), ("0722345678", "phone")]
    assert find("2014-05-03 2014-05-04 06 00") == []
    assert find("Observator: Ana Maria Ioana Elena Popescu.") == [("Ana Maria Ioana Elena Popescu", "name")]
    # a name over the sixth word of a run of capitals
    spans = {t[a:b] for t in ["NOTA PRIVIND DATELE TRANSMISE ASEARA ANA POPESCU LA SEDIU"] for a, b, k, _ in pii.candidates(t, given) if k == "name"}
    assert "ANA POPESCU" in spans and ("ANA POPESCU", "name") in find("NOTA PRIVIND DATELE TRANSMISE ASEARA ANA POPESCU LA SEDIU")


def test_segmentations_against_all_of_them():
    """Best segmentation and marginals, with the bearing of close entities on each other, against enumeration."""
    r = random.Random(2)
    for _ in range(150):
        cands = []
        for _ in range(r.randint(1, 7)):
            a = r.randint(0, 60)
            cands.append((a, a + r.randint(2, 15), r.choice(pii.KINDS), (f"f{r.randint(0, 3)}",)))
        cands = sorted(set(cands), key=lambda c: (c[1], c[0]))
        w = {f"f{i}": r.uniform(-2, 2) for i in range(4)} | {k: r.uniform(-1, 1) for k in pii.KINDS} | {f"x_{a}_{then}{b}": r.uniform(-2, 2) for a in pii.KINDS for b in pii.KINDS for then in ("", "then_")}
        every = []
        for n in range(len(cands) + 1):
            for pick in itertools.combinations(range(len(cands)), n):
                c = [cands[k] for k in pick]
                if all(x[1] <= y[0] for x, y in zip(c, c[1:])):
                    v = sum(w[x[2]] + w[x[3][0]] for x in c) + sum(w[pii._follows(x, y)] for x, y in zip(c, c[1:]) if y[0] - x[1] <= pii.NEAR)
                    every.append((v, pick))
        top = max(every)[1]
        assert [cands.index(c) for c in pii.best(cands, w)] == list(top)
        z = sum(np.exp(v) for v, _ in every)
        one, two = pii._expected(cands, w)
        for k in range(len(cands)):
            assert one[k] == pytest.approx(sum(np.exp(v) for v, p in every if k in p) / z)
        for (j, k), m in two.items():
            assert m == pytest.approx(sum(np.exp(v) for v, p in every if (j, k) in zip(p, p[1:])) / z)


def test_entities_of_texts_from_elsewhere(field):
    """Sentences written by hand, none of them by the rules of the fitting sentences; [..|kind] marks what is to be found."""
    weights, given = field
    marked = [
        "Pentru lămuriri scrieți-i lui [Radu Bercea|name] la [rbercea@observator.example|email] înainte de prânz.",
        "Colega noastră [Elena Dobre|name] preia tura; o găsiți la [0745 118 920|phone].",
        "Am trimis coletul pe [Str. Fântânilor nr. 8, bl. C2|address], cu acordul dlui [Mihai Tudoran|name].",
        "Cererea nr. 4471 a fost depusă de [Ioana Petrescu|name], CNP [2850312400017|id_number].",
        "Pluviometrul a adunat 12.4 l/m² între 06 și 18, iar vântul a atins 14 m/s.",
        "Numărul nou este [+40 (0)722 445 910|phone], cel vechi nu mai răspunde.",
        "Semnează: [IONESCU MARIA|name]",
        "Please ask [Andrei Moraru|name] ([andrei.moraru@station.test|email]) for the key.",
        "Cartea de identitate [XB 448210|id_number] a fost prezentată la ghișeu.",
        "În 1998-07-14 s-au înregistrat 38.2 °C; seria 1998-2008 are 4012 valori.",
        "Locuiește pe [Bulevardul Unirii nr. 44|address] și sună de pe [021 318 45 60|phone].",
    ]
    right = wrong = total = 0
    for m in marked:
        text, want = "", set()
        for part in re.split(r"(\[[^\]|]+\|\w+\])", m):
            if part.startswith("[") and "|" in part:
                inner, kind = part[1:-1].split("|")
                want.add((len(text), kind))
                part = inner
            text += part
        got = {(a, k) for a, _, k in pii.entities(text, given, weights)}
        right, wrong, total = right + len(got & want), wrong + len(got - want), total + len(want)
    assert right >= 0.9 * total and wrong <= 1


def test_found_frames(spark):
    docs = spark.createDataFrame([(1, "Observator: Ana Popescu.", "x"), (2, None, "y"), (3, "", "z")], "doc_id bigint, text string, items string")
    given = spark.createDataFrame([("Ana",), (None,)], "prenume string")
    got = {r["doc_id"]: r for r in pii.found(docs, "doc_id", "text", given).collect()}
    assert got[1]["redacted"] == "Observator: [NAME]." and [(i["tip"], i["poz"]) for i in got[1]["items"]] == [("name", 12)]
    assert got[2]["redacted"] is None and got[2]["items"] == [] and got[3]["redacted"] == ""
    assert pii.found(docs.limit(0), "doc_id", "text", given.limit(0)).count() == 0
