"""Problem 3: records of the evaluation splits that the training split repeats, exactly or almost.

A prompt is a sequence of tokens: its readings (numbers with decimals, in order), which layout,
spelling and the way dates are written leave alone, or all its words where it has fewer than
``FEW`` readings.  Prompts with one and the same sequence form a class; only classes go on.

The suffix array over all sequences is kept in parts, one for each way a suffix begins: the fewest first
tokens that hold ``bits`` of information, a token's information being the logarithm of its share of all
tokens.  Rare readings begin a part after three tokens, rain of zero takes many more, so that frequent
stretches make no part of their own.  Parts with one side or one class end at once.  The others are
sorted by suffix, and a walk over neighbours gives the length of the common prefix of every training and
evaluation suffix of a part as the smallest between neighbours from one to the other.  These are the
shared spans.  Two changed readings may break every long span of a short prompt, so the same is
done for the sequence in the order of two hashes of its tokens, where other tokens are neighbours.

Spans are merged, over all orders, into the tokens of each record that are covered.  Coverage decides:
a pair needs ``covered`` of the longer sequence, on either side.  An exact count of common tokens follows, which only takes away.

Suffixes are moved once, packed by bucket of their part, each with the length of its sequence and 64 bits that its tokens set.
A pair of suffixes whose bits differ so much that their sequences can't have enough tokens in common ends in its part, and only
suffixes with a partner left go on to be sorted; so what goes on grows with the pairs that are found and not with chance ones.

A part in which the training and evaluation suffixes left would give more than ``HOT`` pairs a suffix, or one of more pairs than
``MOST`` suffixes can give, is not walked.  Its classes go on by pairs of their rarest tokens, as in joins by prefix filter: sequences
that have at least ``share_inside`` of the longer one in common share at least two of the first
n - share_inside * n + 2 tokens in any fixed order.  So no pair is lost and no frequent stretch multiplies out.

Defined results: null and blank prompts match nothing; prompts without any word match if their text is the same; those that go by
words need the same numbers, and a share of ``share_words``; several user messages of one record count each; repeated rows each
give their pairs (``cross_split``) or share a class (``linked_classes``); empty tables give nothing; very long prompts are taken whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brumar.common import join_small, spread

#: a number with decimals that is no part of a date
READING = r"(?:(?<!\w)[-−])?(?<!\d)(?<!\d[.,])\d+[.,]\d{1,2}(?![.,]?\d)"
#: prompts with fewer readings go by their words
FEW = 4
#: information of the first tokens of a suffix that name its part; tokens rarer than 1 in 2**RARE count as RARE
BITS, RARE = 24.0, 8.0
#: tokens, all different, that shares are counted with, so that those of a small table mean something
BESIDES = 50_000
#: orders of the tokens besides their own: for all sequences, and for those of up to BRIEF tokens
SHUFFLED, SHUFFLED_BRIEF, BRIEF = 1, 3, 12
#: pairs a suffix, and suffixes, above which a part is split otherwise
HOT, MOST = 32, 4096
#: times a key may come in a batch of rows to be moved suffix by suffix; suffixes that one task sorts; length that stands for all longer ones
OFTEN, SUFFIXES, MANY = 256, 1_000_000, 255
#: tokens of a suffix that the walk compares; spans that go on are taken up again every STEP tokens
REACH, STEP = 64, 32
#: sequences up to LONG tokens are split by pairs of rare tokens, from SHORT on by single ones (either holds for all lengths that can match)
LONG, SHORT = 106, 64


def readings(text: Column) -> Column:
    """The readings of a text in hundredths."""
    plain = F.regexp_extract_all(text, F.lit(READING), F.lit(0))
    return F.transform(plain, lambda x: F.round(F.translate(x, ",−", ".-").cast("double") * 100).cast("bigint"))


def _words(text: Column) -> Column:
    flat = F.lower(F.translate(text, "ăâîșțşţĂÂÎȘȚŞŢ", "aaiststAAISTST"))
    return F.filter(F.split(flat, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well spread 64-bit hash of each number."""
    z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Weights:
    """Information of tokens: of the frequent ones by their share, of all others ``RARE``; at least one bit."""

    def __init__(self, frequent: dict[int, float]) -> None:
        self.token = np.array(sorted(frequent), np.int64)
        self.bits = np.array([min(RARE, max(1.0, -math.log2(frequent[t]))) for t in sorted(frequent)])

    def of(self, tokens: np.ndarray) -> np.ndarray:
        out = np.full(len(tokens), RARE)
        if len(self.token) and len(tokens):
            at = np.minimum(np.searchsorted(self.token, tokens), len(self.token) - 1)
            hit = self.token[at] == tokens
            out[hit] = self.bits[at[hit]]
        return out


def orders(tokens: np.ndarray, seq: np.ndarray) -> list[np.ndarray]:
    """Places of the tokens in each order; ``seq`` numbers the sequence of each token, ascending."""
    own = np.arange(len(tokens))
    return [own] + [np.lexsort((own, _mix(tokens, s + 1), seq)) for s in range(SHUFFLED_BRIEF)]


def used(view: int, length):
    """Whether sequences of a length are taken in an order: changes break up brief ones most."""
    return (view <= SHUFFLED) | (length <= BRIEF)


def beginnings(tokens: np.ndarray, seq: np.ndarray, weights: Weights, bits: float = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, tokens needed, hash of these) of every suffix that holds ``bits``, for sequences laid end to end."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate([[0.0], np.cumsum(weights.of(tokens))])
    at = np.arange(n)
    need = np.searchsorted(total, total[:-1] + bits - 1e-9)  # the place behind the last token needed
    end = np.searchsorted(seq, seq, side="right")
    ok = need <= end
    at, need = at[ok], need[ok]
    # a polynomial over the tokens, taken back to the first place of the suffix
    base = np.uint64(0xD6E8FEB86659FD93)
    inverse = np.uint64(pow(int(base), -1, 2**64))
    with np.errstate(over="ignore"):
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base))])
        back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse))])
        run = np.concatenate([[np.uint64(0)], np.cumsum(_mix(tokens) * power[:-1])])
        key = _mix((run[need] - run[at]) * back[at])
    return at, need - at, key.view(np.int64)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all rows of the column ``seq``, and the row of each."""
    col = batch.column(batch.schema.get_field_index("seq"))
    length = np.diff(col.offsets.to_numpy())
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(length)), length)


def signatures(tokens: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """64 bits for each sequence, of which each of its tokens sets one."""
    out = np.zeros(n_rows, np.uint64)
    np.bitwise_or.at(out, row, np.uint64(1) << (_mix(tokens, 5) >> np.uint64(58)))
    return out


def plausible(n_a: np.ndarray, s_a: np.ndarray, n_b: np.ndarray, s_b: np.ndarray, share: float, share_inside: float) -> np.ndarray:
    """Whether sequences of these lengths and signatures may have enough tokens in common; false only where they have not.

    A bit that one signature has and the other lacks is at least one token without its like.  Lengths from ``MANY`` on may stand for any longer one.
    """
    n_a, n_b = n_a.astype(np.int64), n_b.astype(np.int64)
    longest, shorter = np.maximum(n_a, n_b), np.minimum(n_a, n_b)
    most = np.minimum(n_a - np.bitwise_count(s_a & ~s_b), n_b - np.bitwise_count(s_b & ~s_a))
    inside = shorter >= share_inside * longest - 1e-9
    return inside & ((most >= share * longest - 1e-9) | (most >= shorter)) | (longest >= MANY)


def _suffixes(b: pa.RecordBatch, weights: Weights, bits: float) -> tuple[np.ndarray, ...]:
    """(row of the batch, key of 48 bits, view, at, signature, length) of every suffix of a batch; ``at`` counts from 1.

    Suffixes that share a key by chance are told apart by the walk, which compares their tokens.
    """
    tokens, row = _flat(b)
    first = np.searchsorted(row, np.arange(b.num_rows))
    length = np.bincount(row, minlength=b.num_rows)
    got = []
    for view, order in enumerate(orders(tokens, row)):
        at, _, key = beginnings(tokens[order], row, weights, bits)
        keep = used(view, length[row[at]])
        at, key = at[keep], key[keep]
        with np.errstate(over="ignore"):
            got.append((row[at], _mix(key, view) >> np.uint64(16), np.full(len(at), view), at - first[row[at]] + 1))
    of, key, view, at = (np.concatenate(x) for x in zip(*got))
    return of, key, view, at, signatures(tokens, row, b.num_rows)[of], length[of]


PACKED = "bucket int, base bigint, n int, key binary, sign binary, off binary, place binary, length binary, often binary"


def _packed(batches: Iterator[pa.RecordBatch], weights: Weights, bits: float, buckets: int) -> Iterator[pa.RecordBatch]:
    """The suffixes of a batch by bucket of their keys, a column of bytes for each value, as they are most of what is moved.

    ``often`` has the keys that a batch has more than ``OFTEN`` times, and their sides; these suffixes are not moved.
    """
    for b in batches:
        of, key, view, at, sign, length = _suffixes(b, weights, bits)
        if not len(of):
            continue
        c, side = b.column(b.schema.get_field_index("c")).to_numpy(), np.zeros(b.num_rows, np.int64)
        for bit, name in ((2, "in_train"), (1, "in_test")):
            side += bit * b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        bucket = ((_mix(key, 11) >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)
        names, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        many = count[inverse] > OFTEN
        place = (at << 4) | (view << 2) | side[of]
        out = []
        for frequent in (True, False):
            rows = np.flatnonzero(many == frequent)
            rows = rows[np.argsort(bucket[rows], kind="stable")]
            cuts = np.flatnonzero(np.diff(bucket[rows])) + 1
            for r in np.split(rows, cuts) if len(rows) else []:
                k = int(bucket[r[0]])
                if frequent:
                    name, at_name = np.unique(key[r], return_inverse=True)
                    sides = np.zeros(len(name), np.uint64)
                    np.bitwise_or.at(sides, at_name, side[of[r]].astype(np.uint64))
                    out.append((k, 0, 0, b"", b"", b"", b"", b"", np.concatenate([name, sides]).tobytes()))
                    continue
                base = int(c[of[r]].min())
                off = c[of[r]] - base
                fit = lambda x: x.astype(np.uint16 if x.max() < 2**16 else np.int64).tobytes()
                out.append((k, base, len(r), key[r].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), sign[r].tobytes(), fit(off), fit(place[r]), np.minimum(length[r], MANY).astype(np.uint8).tobytes(), b""))
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], [x.split()[0] for x in PACKED.split(", ")])


PARTED = "hot boolean, key bigint, c bigint, view int, at int, in_train boolean, in_test boolean"


def _parted(batches: Iterator[pa.RecordBatch], share: float, share_inside: float) -> Iterator[pa.RecordBatch]:
    """The suffixes that have a plausible partner in their part, for whole parts; of hot parts only the classes, or the key if there are too many."""
    got: list[list[np.ndarray]] = [[], [], [], [], []]
    often: dict[int, int] = {}
    read = lambda x, n: np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.int64).astype(np.int64)
    for b in batches:
        for base, n, key, sign, off, place, length, frequent in zip(*(col.to_pylist() for col in b.columns[1:])):
            if frequent:
                names, sides = np.split(np.frombuffer(frequent, np.uint64), 2)
                for k, s in zip(names.tolist(), sides.tolist()):
                    often[k] = often.get(k, 0) | s
            else:
                whole = np.zeros((n, 8), np.uint8)
                whole[:, :6] = np.frombuffer(key, np.uint8).reshape(n, 6)
                for to, x in zip(got, (whole.view(np.uint64)[:, 0], np.frombuffer(sign, np.uint64), read(off, n) + base, read(place, n), np.frombuffer(length, np.uint8))):
                    to.append(x)

    def rows(hot: bool, key=None, c=None, place=None) -> pa.RecordBatch:
        n = len(key if key is not None else c)
        of = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x).cast(t)
        place = [None] * 4 if place is None else [(place >> 2) & 3, place >> 4, (place & 2) > 0, (place & 1) > 0]
        cols = [pa.array(np.full(n, hot)), of(None if key is None else key.view(np.int64), pa.int64()), of(c, pa.int64()), of(place[0], pa.int32()), of(place[1], pa.int32()), of(place[2], pa.bool_()), of(place[3], pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in PARTED.split(", ")])

    if not got[0]:
        both = [k for k, s in often.items() if s == 3]
        if both:
            yield rows(True, key=np.array(both, np.uint64))
        return
    key = np.concatenate(got[0])
    order = np.argsort(key, kind="stable")
    key, sign, c, place, length = (np.concatenate(x)[order] for x in got)
    got.clear()
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    train, test = (place & 2) > 0, (place & 1) > 0
    nt, ne = np.add.reduceat(train.astype(np.int64), start), np.add.reduceat(test.astype(np.int64), start)
    live = (nt > 0) & (ne > 0) & (np.minimum.reduceat(c, start) < np.maximum.reduceat(c, start))
    names = key[start]
    for k, s in often.items():  # those of other batches count too
        i = int(np.searchsorted(names, np.uint64(k)))
        if i < len(names) and int(names[i]) == k:
            often[k], live[i] = s | 2 * int(nt[i] > 0) | int(ne[i] > 0), False
    big = live & (nt * ne > MOST * MOST // 4)
    too_many = np.concatenate([names[big], np.array([k for k, s in often.items() if s == 3], np.uint64)])
    if len(too_many):
        yield rows(True, key=too_many)
    live &= ~big
    # all pairs of the parts that are left, some millions at a time; a pair that can't have enough in common ends here
    of_train, of_test = np.flatnonzero(train), np.flatnonzero(test)
    first_t, first_e = np.cumsum(nt) - nt, np.cumsum(ne) - ne
    parts = np.flatnonzero(live)
    pairs = nt[parts] * ne[parts]
    block = np.cumsum(pairs) // (MOST * MOST // 4)
    for g in np.split(parts, np.flatnonzero(np.diff(block)) + 1) if len(parts) else []:
        n = nt[g] * ne[g]
        in_part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(ne[g], n)
        a, e = of_train[np.repeat(first_t[g], n) + in_part // wide], of_test[np.repeat(first_e[g], n) + in_part % wide]
        ok = (c[a] != c[e]) & plausible(length[a], sign[a], length[e], sign[e], share, share_inside)
        kept = np.unique(np.concatenate([a[ok], e[ok]]))
        if not len(kept):
            continue
        t, e = (np.bincount(group[kept], x[kept], minlength=len(start)) for x in (train, test))
        hot = (t * e > HOT * (t + e))[group[kept]]
        if hot.any():
            yield rows(True, c=np.unique(c[kept[hot]]))
        yield rows(False, key=key[kept[~hot]], c=c[kept[~hot]], place=place[kept[~hot]])


def _within(batches: Iterator[pa.RecordBatch], weights: Weights, bits: float) -> Iterator[pa.RecordBatch]:
    """(key, c) of every suffix."""
    for b in batches:
        of, key, *_ = _suffixes(b, weights, bits)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(b.schema.get_field_index("c")).take(pa.array(of))], ["key", "c"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For suffixes with their sequences: the token before each, its first tokens in its order, the length of the sequence."""
    for b in batches:
        tokens, row = _flat(b)
        first = np.searchsorted(row, np.arange(b.num_rows + 1))
        in_order = [tokens[o] for o in orders(tokens, row)]
        view, at = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("view", "at"))
        before = [int(in_order[v][i + k - 2]) if k > 1 else None for v, k, i in zip(view, at, first)]
        suffix = [in_order[v][i + k - 1 : min(i + k - 1 + REACH, j)] for v, k, i, j in zip(view, at, first, first[1:])]
        yield pa.RecordBatch.from_arrays([*b.select(["key", "c", "in_train", "in_test", "view", "at"]).columns, pa.array(before, pa.int64()), pa.array(suffix, pa.list_(pa.int64())), pa.array(np.diff(first).astype(np.int32))], ["key", "c", "in_train", "in_test", "view", "at", "before", "suffix", "n"])


def _rare(batches: Iterator[pa.RecordBatch], weights: Weights, share: float) -> Iterator[pa.RecordBatch]:
    """(key, c, in_train, in_test, signature, length) for pairs of the rarest tokens of each sequence, or single ones of long sequences."""
    for b in batches:
        tokens, row = _flat(b)
        keys, of = [], []
        for i in range(b.num_rows):
            mine = tokens[row == i] if b.num_rows < 50 else tokens[np.searchsorted(row, i) : np.searchsorted(row, i + 1)]
            n, count, named = len(mine), Counter(), []
            for t in np.sort(mine):  # repeated tokens are told apart by number
                count[t] += 1
                named.append((t, count[t]))
            if not n:
                continue
            t, k = np.array([x for x, _ in named], np.int64), np.array([k for _, k in named], np.int64)
            name = _mix(t.view(np.uint64) ^ _mix(k, 7), 3)
            name = name[np.lexsort((name, -weights.of(t)))]
            keep = n - math.ceil(share * n - 1e-9)
            with np.errstate(over="ignore"):
                if n <= LONG:
                    head = name[: keep + 2]
                    x, y = np.triu_indices(len(head), 1)
                    lo, hi = np.minimum(head[x], head[y]), np.maximum(head[x], head[y])
                    keys.append(_mix(lo) * np.uint64(3) + _mix(hi, 1))
                    of.append(np.full(len(x), i))
                if n >= SHORT:
                    head = name[: keep + 1]
                    keys.append(_mix(head, 9))
                    of.append(np.full(len(head), i))
        if keys:
            of = np.concatenate(of)
            take = b.take(pa.array(of)).select(["c", "in_train", "in_test"])
            sign, length = signatures(tokens, row, b.num_rows)[of], np.bincount(row, minlength=b.num_rows)[of]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *take.columns, pa.array(sign.view(np.int64)), pa.array(length.astype(np.int32))], ["key", "c", "in_train", "in_test", "sign", "n"])


def common_prefixes(rows: list[list[int]]) -> list[int]:
    """Length of the common prefix of each suffix with the one before it."""
    out = [0]
    for a, b in zip(rows, rows[1:]):
        n = min(len(a), len(b))
        k = 0
        while k < n and a[k] == b[k]:
            k += 1
        out.append(k)
    return out


def shared(part: list[tuple]) -> Iterator[tuple]:
    """(training class, evaluation class, view, place in each, length, length of the longer sequence) of the spans of one sorted part.

    Rows are (class, in training, in evaluation, view, place, token before, suffix, length of the sequence).  A span that could begin further left is
    left to the suffix that does, but for every STEP-th place, as the walk compares no more than REACH tokens.
    """
    prefix = common_prefixes([r[6] for r in part])
    few = [i for i, r in enumerate(part) if r[2]] if sum(r[2] for r in part) <= sum(r[1] for r in part) else [i for i, r in enumerate(part) if r[1]]
    seen = set()
    for i in few:  # from each suffix of the smaller side to all others, up and down
        for step in (1, -1):
            length, j = REACH, i
            while 0 <= j + step < len(part):
                length = min(length, prefix[max(j, j + step)])  # the smallest between neighbours from one suffix to the other
                j += step
                if not length:
                    break
                a, b = part[min(i, j)], part[max(i, j)]
                if a[0] == b[0] or (min(i, j), max(i, j)) in seen:
                    continue
                if part[j][1] and part[j][2]:
                    seen.add((min(i, j), max(i, j)))  # met from both ends
                for x, y in ((a, b), (b, a)):
                    if x[1] and y[2] and (x[5] != y[5] or x[5] is None or x[4] % STEP == 1):
                        yield x[0], y[0], x[3], x[4], y[4], length, max(x[7], y[7])


SPANS = ["c_train", "c_test", "view", "at_train", "at_test", "span", "longest"]


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks the sorted parts that lie in one task, part by part."""
    key, part, out = None, [], []
    for pdf in batches:
        for k, *r in pdf.itertuples(index=False, name=None):
            if k != key:
                out.extend(shared(part))
                key, part = k, []
            before = r[5]
            part.append((*r[:5], None if before is None or before != before else before, r[6].tolist(), r[7]))
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=SPANS)
            out = []
    out.extend(shared(part))
    if out:
        yield pd.DataFrame(out, columns=SPANS)


def covered_tokens(a: np.ndarray, b: np.ndarray, weights: Weights, bits: float = BITS) -> tuple[int, int]:
    """Tokens of either sequence that lie in spans they share, over all orders (what the walk finds for one pair)."""
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    on = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for view, (oa, ob) in enumerate(zip(orders(a, np.zeros(len(a), int)), orders(b, np.zeros(len(b), int)))):
        if not (used(view, len(a)) and used(view, len(b))):
            continue
        (pa_, la, ka), (pb, lb, kb) = beginnings(a[oa], np.zeros(len(a), int), weights, bits), beginnings(b[ob], np.zeros(len(b), int), weights, bits)
        for cover, order, place, length, hit in ((on[0], oa, pa_, la, np.isin(ka, kb)), (on[1], ob, pb, lb, np.isin(kb, ka))):
            for p, n in zip(place[hit], length[hit]):
                cover[order[p : p + n]] = True
    return int(on[0].sum()), int(on[1].sum())


def _merged(spans, a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The spans of a pair merged into the tokens of either sequence that they cover."""
    on = np.zeros(len(a), bool), np.zeros(len(b), bool)
    oa, ob = orders(a, np.zeros(len(a), int)), orders(b, np.zeros(len(b), int))
    for s in spans:
        on[0][oa[s["view"]][s["at_train"] - 1 : s["at_train"] - 1 + s["span"]]] = True
        on[1][ob[s["view"]][s["at_test"] - 1 : s["at_test"] - 1 + s["span"]]] = True
    return int(on[0].sum()), int(on[1].sum())


def _links(train: DataFrame, test: DataFrame, bits: float, covered: float, share: float, share_inside: float, share_words: float) -> tuple[DataFrame, DataFrame]:
    """((is_train, id, c) of every prompt, links between classes)."""
    both = train.select(F.lit(True).alias("is_train"), "id", "text").unionByName(test.select(F.lit(False).alias("is_train"), "id", "text"))
    once = lambda x: F.explode(F.array(x))  # a column of its own, so that what follows does not work it out again
    both = both.where(F.length(F.trim("text")) > 0).select("is_train", "id", "text", once(readings(F.col("text"))).alias("r"))
    by_words = F.size("r") < FEW
    both = both.select("is_train", "id", "text", "r", once(F.when(by_words, _words(F.col("text")))).alias("w"))
    seq = F.when(by_words, F.transform("w", lambda w: F.xxhash64(w))).otherwise(F.col("r"))
    digits = F.when(by_words, F.md5(F.array_join(F.array_sort(F.filter("w", lambda w: w.rlike(r"\p{N}"))), " ")))
    both = both.select("is_train", "id", seq.alias("seq"), digits.alias("digits"), F.when(F.size(seq) == 0, F.trim("text")).alias("bare"))
    c = F.unhex(F.md5(F.concat_ws(" ", F.coalesce("bare", "digits", F.lit("")), F.array_join(F.transform("seq", lambda x: x.cast("string")), " "))))
    rows = spread(both.select("is_train", "id", "seq", "digits", c.alias("c")), "c").persist(StorageLevel.MEMORY_AND_DISK)
    classes = rows.groupBy("c").agg(F.first("seq").alias("seq"), F.first("digits").alias("digits"), F.max("is_train").alias("in_train"), F.max(~F.col("is_train")).alias("in_test"))
    # numbers of classes are a third of their hashes; sorted first, so that a part that is lost gets the same numbers again
    classes = classes.sortWithinPartitions("c").withColumn("number", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    same = classes.where("in_train and in_test").select(F.col("c").alias("c_train"), F.col("c").alias("c_test"), F.size("seq").alias("matched"), F.size("seq").alias("longest"), F.lit(1.0).alias("covered"))
    # tokens with at least 1 in 2 ** RARE of all, so at most 2 ** RARE of them
    tokens = classes.select(F.explode("seq").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    all_tokens = (tokens.agg(F.sum("n")).first()[0] or 0) + BESIDES
    weights = Weights({r["t"]: r["n"] / all_tokens for r in tokens.where(F.col("n") > all_tokens / 2**RARE).collect()})

    plain = classes.where(F.size("seq") > 0).select(F.col("number").alias("c"), "in_train", "in_test", "seq")
    least = min(share, share_words)
    buckets = min(2**15, max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * all_tokens // SUFFIXES))
    packed = plain.mapInArrow(lambda b: _packed(b, weights, bits, buckets), PACKED).repartition(buckets, "bucket")
    parts = packed.mapInArrow(lambda b: _parted(b, least, share_inside), PARTED).persist(StorageLevel.MEMORY_AND_DISK)
    # classes with a plausible partner; no others go on
    going = parts.where("c is not null").select("c")
    keys = parts.where("c is null").select("key")
    if keys.limit(1).count():
        within = plain.mapInArrow(lambda b: _within(b, weights, bits), "key bigint, c bigint")
        of_keys = join_small(within, keys, ["key"], "left_semi").select("c").distinct().persist(StorageLevel.MEMORY_AND_DISK)
        going = going.unionByName(of_keys)
    else:
        of_keys = None
    going = join_small(classes.withColumnRenamed("c", "name").withColumnRenamed("number", "c"), going.distinct(), ["c"], "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    found = (
        parts.where("not hot")
        .select("key", "c", "view", "at", "in_train", "in_test")
        .join(going.select("c", "seq"), "c")
        .mapInArrow(_cut, "key bigint, c bigint, in_train boolean, in_test boolean, view int, at int, before bigint, suffix array<bigint>, n int")
        .repartition("key")
        .sortWithinPartitions("key", "suffix")
        .mapInPandas(_walk, "c_train bigint, c_test bigint, view int, at_train int, at_test int, span int, longest int")
    )
    # tokens of all spans together are the most that can be covered, so pairs that share one stretch by chance end here
    merged = found.groupBy("c_train", "c_test").agg(F.collect_list(F.struct("view", "at_train", "at_test", "span")).alias("spans"), F.sum("span").alias("most"), F.max("longest").alias("longest"))
    merged = merged.where(F.col("most") >= covered * F.col("longest")).select("c_train", "c_test", "spans")
    # parts that would multiply out: by pairs of rare tokens
    cand = merged
    if parts.where("hot").limit(1).count():
        classes_of = parts.where("hot and c is not null").select("c")
        classes_of = classes_of if of_keys is None else classes_of.unionByName(of_keys)
        hot = join_small(going.select("c", "in_train", "in_test", "seq"), classes_of.distinct(), ["c"], "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
        rare = hot.mapInArrow(lambda b: _rare(b, weights, share_inside), "key bigint, c bigint, in_train boolean, in_test boolean, sign bigint, n int")
        n = rare.groupBy("key").agg(F.count_if("in_train").alias("nt"), F.count_if("in_test").alias("ne"), F.min("c").alias("c0"), F.max("c").alias("c1"))
        rare = rare.join(n.where("nt > 0 and ne > 0 and c0 <> c1").select("key"), "key")  # counted before rows move
        one, two = (rare.where(side).select("key", F.col("c").alias(f"c_{x}"), F.col("sign").alias(f"s_{x}"), F.col("n").alias(f"n_{x}")) for side, x in (("in_train", "train"), ("in_test", "test")))
        most = F.least(F.expr("n_train - bit_count(s_train & ~s_test)"), F.expr("n_test - bit_count(s_test & ~s_train)"))  # as in ``plausible``
        shorter, longer = F.least("n_train", "n_test"), F.greatest("n_train", "n_test")
        split = one.join(two, "key").where("c_train <> c_test").where(shorter >= share_inside * longer - 1e-9).where((most >= least * longer - 1e-9) | (most >= shorter))
        cand = merged.unionByName(split.select("c_train", "c_test").distinct().withColumn("spans", F.lit(None).cast("array<struct<view:int,at_train:int,at_test:int,span:int>>")))
    cand = cand.groupBy("c_train", "c_test").agg(F.max_by("spans", F.col("spans").isNull()).alias("spans"))  # without spans: all are looked for again

    @F.pandas_udf("matched int, on_train int, on_test int")
    def score(a: pd.Series, b: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for x, y, s in zip(a, b, spans):
            m = sum((Counter(x.tolist()) & Counter(y.tolist())).values())
            if m < min(share, share_words, share_inside) * max(len(x), len(y)):
                out.append((m, 0, 0))  # too few, however they lie
            else:
                out.append((m, *(covered_tokens(x, y, weights, bits) if s is None else _merged(s, x, y))))
        return pd.DataFrame(out, columns=["matched", "on_train", "on_test"])

    a, b = (going.select(F.col("c").alias(f"c_{x}"), F.col("name").alias(f"name_{x}"), F.col("seq").alias(f"s_{x}"), F.col("digits").alias(f"d_{x}")) for x in ("train", "test"))
    longer, shorter = F.greatest(F.size("s_train"), F.size("s_test")), F.least(F.size("s_train"), F.size("s_test"))
    scored = cand.join(a, "c_train").join(b, "c_test").where(F.col("d_train").eqNullSafe(F.col("d_test"))).where(shorter >= share_inside * longer).withColumn("s", score("s_train", "s_test", "spans"))
    near = scored.select(F.col("name_train").alias("c_train"), F.col("name_test").alias("c_test"), "d_test", "s.matched", longer.alias("longest"), shorter.alias("shorter"), (F.least("s.on_train", "s.on_test") / longer).alias("covered"))
    enough = (F.col("matched") >= F.when(F.col("d_test").isNotNull(), share_words).otherwise(share) * F.col("longest")) | ((F.col("matched") == F.col("shorter")) & (F.col("matched") >= share_inside * F.col("longest")))
    near = near.where(F.col("covered") >= covered).where(enough).select("c_train", "c_test", "matched", "longest", "covered")
    return rows.select("is_train", "id", "c"), same.unionByName(near)


PARAMETERS = {"bits": BITS, "covered": 0.4, "share": 0.7, "share_inside": 0.6, "share_words": 0.8}


def cross_split(train: DataFrame, test: DataFrame, **parameters: float) -> DataFrame:
    """(train_id, test_id, matched, longest, covered): pairs of train(id, text) and test(id, text) that repeat each other.

    ``longest`` is the length of the longer sequence, ``covered`` the share of it that lies in shared spans.
    """
    rows, links = _links(train, test, **(PARAMETERS | parameters))
    of_train = rows.where("is_train").select(F.col("id").alias("train_id"), F.col("c").alias("c_train"))
    of_test = rows.where("not is_train").select(F.col("id").alias("test_id"), F.col("c").alias("c_test"))
    pairs = links.join(of_train, "c_train").join(of_test, "c_test")
    return pairs.groupBy("train_id", "test_id").agg(F.max("matched").alias("matched"), F.max("longest").alias("longest"), F.max("covered").alias("covered"))


def linked_classes(train: DataFrame, test: DataFrame, **parameters: float) -> DataFrame:
    """(id, class, n_train, n_links, covered) of every prompt of test(id, text): its class, how many training classes and rows
    it is linked to, and the most of it that any of them covers.  Copies are not multiplied out."""
    rows, links = _links(train, test, **(PARAMETERS | parameters))
    sizes = rows.where("is_train").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    per = links.join(sizes.withColumnRenamed("c", "c_train"), "c_train").groupBy(F.col("c_test").alias("c")).agg(F.count(F.lit(1)).alias("n_links"), F.sum("n").alias("n_train"), F.max("covered").alias("covered"))
    got = rows.where("not is_train").join(per, "c", "left")
    return got.select("id", F.lower(F.hex("c")).alias("class"), F.coalesce("n_train", F.lit(0)).alias("n_train"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("covered", F.lit(0.0)).alias("covered"))


def prompts_of(train: DataFrame, row_id: str = "train_id", messages: str = "messages") -> DataFrame:
    """(id, text) of every user message of chat records."""
    return train.select(F.col(row_id).alias("id"), F.explode(messages).alias("m")).where("m.role = 'user'").select("id", F.col("m.content").alias("text"))
