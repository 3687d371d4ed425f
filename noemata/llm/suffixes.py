"""Exact removal of repeated passages, by a logarithmic family of sorted suffix arrays.

A byte is removed where it lies in a string of `length` bytes that also starts earlier: in a document of smaller id, or
further up in the same document. Strings are judged on the input. Matches never cross documents.

Suffixes are sampled by content: of the k-grams in each stretch of `length` bytes the one of least hash is an anchor, so two
equal strings share an anchor at the same place. Around an anchor lies its context, all bytes of strings that hold it.
Suffixes at anchors are dealt out by their first k bytes (as a hash), and each task keeps a family of arrays over its part:
batches come in the order of documents, each is sorted into an array, merge-scanned against the levels that exist and
then added as a level; levels of equal size merge, so there are logarithmically many. Suffixes are ordered by 128-bit
hashes of the compared bytes rather than by the bytes, which finds the same matches in fixed-size rows.

Two rounds. First whole contexts: of equal ones all but the first are repeats from end to end, which settles the inside of
repeated passages. Only where different contexts share an anchor (at the ends of passages) a second round looks closer: up to PAIRED
contexts of an anchor are compared in pairs, byte by byte; with more, every string of them is a suffix of its own. Before anything is shuffled, each task settles what repeats within its own rows and
sends one row for each context or string, so a passage that a third of all documents hold costs a row for each task.

A line that all documents have, in other surroundings each time, is an anchor with as many contexts. Where a task alone has
more than CROWD of an anchor, these don't go to the anchor's task but are compared string by string, and the anchor's task
is told to do the same with the rest; so what meets in one task is CROWD rows for each task at most.

Cases: null or empty texts, and texts shorter than `length`, lose nothing; a very long text is worked on in stretches, with
the same result; rows of the same id are judged each by itself, and none is earlier than another, equal or not; rows without
id come after all others, and none of them is earlier than another; an empty table gives an empty result. Columns of other names are ignored by deduplicate() and kept by deduplicated().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, release, remembered, slices, table, texts, written

U = np.uint64
LENGTH, GRAM = 100, 32
#: Bytes of text worked on at once; suffixes settled at once before the shuffle; suffixes of one batch of the family.
CHUNK, LOCAL, BATCH = 1 << 18, 250_000, 1 << 16
LAST_ID = (1 << 63) - 1
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_TABLES = np.random.default_rng(17).integers(1, 1 << 63, (2, 256), dtype=np.int64).view(U)


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2 ** 64, at least n of each."""
    held = remembered("suffixes")
    if which not in held or len(held[which][0]) < n:
        found = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            powers = np.full(max(n, CHUNK + 4096), base, U)
            powers[0] = 1
            found.append(np.multiply.accumulate(powers))
        held[which] = (found[0], found[1])
    return held[which]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U(32))


class Hashes:
    """Hashes of any stretch of a buffer, from running sums."""

    def __init__(self, data: np.ndarray, which: int):
        n = len(data)
        power, self.inverse = _powers(which, n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_TABLES[which][data] * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, U)


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (or most) of x over each stretch of width places; len(x) - width + 1 values."""
    step = 1
    while 2 * step <= width:
        x = least(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return least(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Places of the anchors in texts that lie end to end (ends: where each ends, ascending). Of equal hashes all are anchors."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64)
    h = Hashes(data, 0).all_of(gram)
    width = length - gram + 1
    stop = np.repeat(ends, np.diff(ends, prepend=0))  # where the text of each place ends
    at = np.arange(n)
    h[(at + gram > stop)[: len(h)]] = U(0xFFFFFFFFFFFFFFFF)
    least = _sliding(h, width, np.minimum)
    least[(at + length > stop)[: len(least)]] = 0
    pad = np.zeros(width - 1, U)
    most = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    return np.flatnonzero(most[: len(h)] == h)


def units(found: list[bytes], length: int):
    """Groups of (row, bytes, their offset in the document, the document's size, where its own anchors begin) of about CHUNK bytes. Long documents go in stretches that overlap by what contexts need."""
    group, held = [], 0
    margin = 2 * length
    for i, text in enumerate(found):
        if len(text) < length:
            continue
        for start in range(0, len(text), CHUNK):
            lo, hi = max(0, start - margin), min(len(text), start + CHUNK + margin)
            if group and held + hi - lo > CHUNK:
                yield group
                group, held = [], 0
            group.append((i, text[lo:hi], lo, len(text), start))
            held += hi - lo
    if group:
        yield group


class Family:
    """A logarithmic family of sorted arrays of 128-bit keys, each with the row where the key came first. add() takes a batch in the order of rows (doc, then sub) and tells which keys came earlier: in a smaller doc, or before in the same row."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []  # keys (two halves), doc, and the last sub of that doc that has the key

    @staticmethod
    def _array(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The order of an array: by the first half; by both where the first halves of different keys coincide."""
        order = np.argsort(k1, kind="stable")
        a, b = k1[order], k2[order]
        return np.lexsort((k2, k1)) if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any() else order

    def add(self, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, sub: np.ndarray) -> np.ndarray:
        order = self._array(k1, k2)
        k1, k2, doc, sub = k1[order], k2[order], doc[order], sub[order]
        turn = np.ones(len(k1), bool)
        turn[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        first, group = np.flatnonzero(turn), np.cumsum(turn) - 1
        new1, new2 = k1[first], k2[first]
        least, of = doc[first], np.full(len(first), -1)  # the smallest doc of each key; the level that has the key
        places = np.zeros(len(first), np.int64)
        last = sub[first].copy()
        for i, (m1, m2, docs, subs) in enumerate(self.levels):  # merge-scan
            at = np.searchsorted(m1, new1)
            while True:
                at = np.minimum(at, len(m1) - 1)
                same = m1[at] == new1
                hit = same & (m2[at] == new2)
                of[hit], places[hit], least[hit], last[hit] = i, at[hit], docs[at[hit]], subs[at[hit]]
                on = same & (m2[at] < new2) & (at + 1 < len(m1))
                if not on.any():
                    break
                at += on
        known = of >= 0
        again = (doc > least[group]) | (known & (doc[first] == least) & (sub[first] == last))[group] & turn
        again[1:] |= ~turn[1:] & (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1])
        # The last row of the smallest doc that has the key: its next row isn't later than this one.
        ends = np.flatnonzero(doc == least[group])
        last[group[ends]] = sub[ends]
        for i in np.unique(of[group[ends]]).tolist() if len(ends) and known.any() else []:
            if i >= 0:
                of_level = group[ends][of[group[ends]] == i]
                self.levels[i][3][places[of_level]] = last[of_level]
        if not known.all():
            self.levels.append([new1[~known], new2[~known], least[~known], last[~known]])
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(a, b, strict=True)]
            by = self._array(both[0], both[1])
            self.levels.append([x[by] for x in both])
        out = np.zeros(len(k1), bool)
        out[order] = again
        return out


def repeated(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, sub: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which rows have a row of the same key in a smaller doc, or further up in the same row (doc, sub). Rows of the same key at the same place are one occurrence."""
    n = len(k1)
    if not n:
        return np.zeros(0, bool)
    order = np.arange(n)
    rising = (doc[1:] > doc[:-1]) | (doc[1:] == doc[:-1]) & ((sub[1:] > sub[:-1]) | (sub[1:] == sub[:-1]) & (place[1:] >= place[:-1]))
    if not rising.all():
        order = np.lexsort((place, sub, doc))
    d, u, p = doc[order], sub[order], place[order]
    if ((d[1:] == d[:-1]) & (u[1:] == u[:-1]) & (p[1:] == p[:-1])).any():
        order = np.lexsort((k2, k1, place, sub, doc))
    key = _mix(k1 + k2 * U(0x9E3779B97F4A7C15))[order]  # for a given k2 as good as k1
    k2, doc, sub, place = k2[order], doc[order], sub[order], place[order]
    own = np.ones(n, bool)
    own[1:] = (key[1:] != key[:-1]) | (k2[1:] != k2[:-1]) | (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (place[1:] != place[:-1])
    family, at = Family(), np.flatnonzero(own)
    again = np.zeros(len(at), bool)
    for start in range(0, len(at), BATCH):
        some = at[start : start + BATCH]
        again[start : start + BATCH] = family.add(key[some], k2[some], doc[some], sub[some])
    out = np.zeros(n, bool)
    out[order] = again[np.cumsum(own) - 1]
    return out


def merged(doc: np.ndarray, sub: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the stretches of each row."""
    if not len(doc):
        return doc, sub, lo, hi
    order = np.lexsort((lo, sub, doc))
    doc, sub, lo, hi = doc[order], sub[order], lo[order], hi[order]
    turn = np.ones(len(doc), bool)
    turn[1:] = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])
    # The farthest end so far within a row: ends raised by a step for each row can be accumulated in one go.
    rank = np.cumsum(turn) - 1
    reach = int(hi.max()) + 1
    far = np.maximum.accumulate(hi + rank * reach) - rank * reach
    turn[1:] |= lo[1:] > far[:-1]
    at = np.flatnonzero(turn)
    return doc[at], sub[at], lo[at], far[np.append(at[1:], len(doc)) - 1]


SCHEMA = "route long, kind int, k1 long, k2 long, doc long, sub long, lo long, hi long"
#: A suffix to be compared; a stretch lo..hi that repeats; a context to be compared byte by byte with the others of its
#: anchor; a context whose anchor has too many others for that, to be compared string by string; a suffix of an anchor that
#: has many contexts in one task alone, which isn't brought together with the others; and the word of that to the task that
#: has the rest.
SUFFIX, STRETCH, FEW, MANY, HOT, MARK = range(6)
#: Contexts of one anchor up to which they are compared in pairs; contexts of one anchor in one flush up to which they go to one task.
PAIRED, CROWD = 1024, 16


def _rows(kind: int, route, doc, sub, lo, hi, k1=None, k2=None, extra=None) -> pa.RecordBatch:
    """For a suffix and a context lo is its place, and hi has in its halves how far it reaches to the left and to the right."""
    none = np.zeros(len(doc), np.int64)
    columns = [pa.array(c) for c in (route, np.full(len(doc), kind, np.int32), none if k1 is None else k1.view(np.int64), none if k2 is None else k2.view(np.int64), doc, sub, lo, hi)]
    names = ["route", "kind", "k1", "k2", "doc", "sub", "lo", "hi"]
    if extra is not None:
        columns, names = [*columns, extra], [*names, "bytes"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _reach(left, right):
    return (left << 32) | right


def _stretch(place: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place - (reach >> 32), place + (reach & 0xFFFFFFFF)


class Local:
    """Suffixes of one task. flush() settles what repeats among them and passes on one row for each key."""

    def __init__(self, with_bytes: bool = False):
        self.parts, self.count, self.with_bytes = [], 0, with_bytes

    def add(self, *columns: np.ndarray) -> bool:
        self.parts.append(columns)
        self.count += len(columns[0])
        return self.count >= LOCAL

    def flush(self):
        if not self.parts:
            return
        k1, k2, doc, sub, place, reach = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.count = [], 0
        again = repeated(k1, k2, doc, sub, place)
        none = lambda n: pa.nulls(n, pa.binary()) if self.with_bytes else None
        d, u, a, b = merged(doc[again], sub[again], *_stretch(place[again], reach[again]))
        if len(d):
            yield _rows(STRETCH, d * 31 + (a >> 12), d, u, a, b, extra=none(len(d)))
        once = ~again
        k1, k2, doc, sub, place, reach = (x[once] for x in (k1, k2, doc, sub, place, reach))
        if self.with_bytes:  # strings: equal ones are settled, so a key is here once
            yield _rows(SUFFIX, k1.view(np.int64), doc, sub, place, reach, k1, k2, extra=none(len(doc)))
            return
        _, of, n = np.unique(k1, return_inverse=True, return_counts=True)
        crowded = n[of] > CROWD
        for kind, at in ((SUFFIX, np.flatnonzero(~crowded)), (HOT, np.flatnonzero(crowded))):
            route = k1[at] if kind == SUFFIX else _mix(k1[at] ^ k2[at])
            yield _rows(kind, route.view(np.int64), doc[at], sub[at], place[at], reach[at], k1[at], k2[at])
        marks = np.unique(k1[crowded])
        zero = np.zeros(len(marks), np.int64)
        yield _rows(MARK, marks.view(np.int64), zero, zero, zero, zero, marks)


def _contexts(length: int, gram: int):
    def found(batches):
        release("suffixes")
        local, side = Local(), length - gram
        for batch in (part for whole in batches for part in slices(whole)):
            ids, subs, all_texts = np.asarray(batch.column("doc")), np.asarray(batch.column("sub")), texts(batch)
            for group in units(all_texts, length):
                data = np.frombuffer(b"".join(g[1] for g in group), np.uint8)
                row, offset, size, core = (np.array([g[k] for g in group], np.int64) for k in (0, 2, 3, 4))
                sizes = np.array([len(g[1]) for g in group], np.int64)
                ends = np.cumsum(sizes)
                at = anchors(data, ends, length, gram)
                which = np.searchsorted(ends, at, "right")
                place = at - (ends - sizes)[which] + offset[which]  # in the document
                mine = (place >= core[which]) & (place < core[which] + CHUNK)  # each anchor once
                at, which, place = at[mine], which[mine], place[mine]
                left, right = np.minimum(place, side), np.minimum(size[which] - place, length)
                key = Hashes(data, 0).of(at, at + gram)
                context = Hashes(data, 1).of(at - left, at + right) + _reach(left, right).view(U) * U(0x9E3779B97F4A7C15)
                if local.add(key, _mix(context), ids[row[which]], subs[row[which]], place, _reach(left, right)):
                    yield from local.flush()
        yield from local.flush()
        release("suffixes")

    return found


def _reopened(length: int):
    """Open contexts with their bytes, or all strings of them."""

    def found(batches):
        release("suffixes")
        local = Local(with_bytes=True)
        for batch in batches:
            few = []
            for doc, sub, text, open_ in zip(batch.column("doc").to_pylist(), batch.column("sub").to_pylist(), texts(batch), batch.column("open").to_pylist(), strict=True):
                starts = []
                for x in open_:
                    lo, hi = x["lo"] - (x["hi"] >> 32), x["lo"] + (x["hi"] & 0xFFFFFFFF)
                    if x["kind"] == FEW:
                        few.append((x["k1"], doc, sub, x["lo"], x["hi"], text[lo:hi]))
                    else:
                        starts.append((0, 0, lo, hi - length + 1))
                if starts:  # the stretches in which strings start, without overlaps
                    _, _, lo, hi = merged(*(np.array(x, np.int64) for x in zip(*starts, strict=True)))
                    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                        for c in range(a, b, CHUNK):
                            d = min(b, c + CHUNK)
                            data = np.frombuffer(text[c : d + length - 1], np.uint8)
                            whole = lambda x, n=d - c: np.full(n, x, np.int64)
                            if local.add(Hashes(data, 0).all_of(length), Hashes(data, 1).all_of(length), whole(doc), whole(sub), np.arange(c, d), whole(length)):
                                yield from local.flush()
            if few:
                k1, doc, sub, lo, hi, own = zip(*few, strict=True)
                k1 = np.array(k1, np.int64)
                yield _rows(FEW, k1, *(np.array(x, np.int64) for x in (doc, sub, lo, hi)), k1, extra=pa.array(own, pa.binary()))
        yield from local.flush()
        release("suffixes")

    return found


class SuffixArray:
    """The suffixes at the anchors of contexts, in order of anchor and bytes, with the length of the prefix that each has in common with the next one."""

    def __init__(self, key: np.ndarray, reach: np.ndarray, own: list[bytes], side: int, length: int):
        n, width = len(key), -(-length // 8) * 8
        left, right = reach >> 32, reach & 0xFFFFFFFF
        after, before = np.zeros((n, width), np.uint8), np.zeros((n, side), np.uint8)  # what comes after the anchor's start, and what comes before it backwards
        for i, text in enumerate(own):
            data = np.frombuffer(text, np.uint8)
            after[i, : right[i]] = data[left[i] :]
            before[i, : left[i]] = data[: left[i]][::-1]
        words = after.view(">u8")
        self.order = np.lexsort((*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), key))
        self.key, self.left, self.right, self.before = key[self.order], left[self.order], right[self.order], before[self.order]
        after = after[self.order]
        self.common = np.zeros(n, np.int64)  # with the next suffix; 0 with one of another anchor
        for start in range(0, n - 1, 20_000):
            i = np.arange(start, min(n - 1, start + 20_000))
            differs = np.hstack([after[i] != after[i + 1], np.ones((len(i), 1), bool)])
            self.common[i] = np.where(self.key[i] == self.key[i + 1], np.argmax(differs, 1), 0)
        self.common = np.minimum(self.common, np.append(np.minimum(self.right[1:], self.right[:-1]), 0) if n else self.common)

    def pairs(self):
        """(i, j, l, r): places in the array of two suffixes of one anchor, and how far what surrounds the anchor is the same to the left and to the right."""
        n = len(self.key)
        at, running = np.arange(n), self.common.copy()  # the common prefix of i and i + step is the least of those between
        step = 1
        while True:
            at = at[(at + step < n) & (running[at] > 0)] if len(at) else at
            if not len(at):
                return
            for start in range(0, len(at), 20_000):
                i = at[start : start + 20_000]
                differs = np.hstack([self.before[i] != self.before[i + step], np.ones((len(i), 1), bool)])
                left = np.minimum(np.argmax(differs, 1), np.minimum(self.left[i], self.left[i + step]))
                yield i, i + step, left, running[i]
            on = at[at + step + 1 < n]
            running[on] = np.minimum(running[on], self.common[on + step])
            at, step = on, step + 1


def paired(key: np.ndarray, doc: np.ndarray, sub: np.ndarray, place: np.ndarray, reach: np.ndarray, own: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of at least `length` bytes around the anchor that a context shares with an earlier one of the same key."""
    array = SuffixArray(key, reach, own, length - gram, length)
    doc, sub, place = (x[array.order] for x in (doc, sub, place))
    out = []
    for i, j, left, right in array.pairs():
        hit = (left + right >= length) & (right >= gram)
        i, j, left, right = i[hit], j[hit], left[hit], right[hit]
        first = (doc[i] < doc[j]) | (doc[i] == doc[j]) & (place[i] < place[j])
        later = np.where(first, j, i)
        real = (doc[i] != doc[j]) | (sub[i] == sub[j]) & (place[i] != place[j])  # rows of one id aren't earlier than each other
        out.append((doc[later][real], sub[later][real], (place[later] - left)[real], (place[later] + right)[real]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _settle(length: int, gram: int, last: bool):
    """Suffixes dealt out by key: stretches that repeat and, but for the last round, contexts that share an anchor with others."""

    def settled(batches):
        rows = gathered(batches)
        if rows is None:
            return
        kind, k1, k2, doc, sub, lo, hi = (np.asarray(rows.column(c).combine_chunks()) for c in ("kind", "k1", "k2", "doc", "sub", "lo", "hi"))
        done, of, few = kind == STRETCH, (kind == SUFFIX) | (kind == HOT), kind == FEW
        parts = [(doc[done], sub[done], lo[done], hi[done])]
        again = repeated(k1[of].view(U), k2[of].view(U), doc[of], sub[of], lo[of])
        parts.append((doc[of][again], sub[of][again], *_stretch(lo[of][again], hi[of][again])))
        if few.any():
            own = rows.column("bytes").filter(pa.array(few)).to_pylist()
            parts.append(paired(k1[few], doc[few], sub[few], lo[few], hi[few], own, length, gram))
        d, u, a, b = merged(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        yield _rows(STRETCH, d, d, u, a, b)
        if not last:
            once = np.flatnonzero(of)[~again]
            alone = once[kind[once] == HOT]
            once = once[kind[once] == SUFFIX]
            # The rows of a context; then the anchors that several contexts have.
            once = once[np.lexsort((lo[once], sub[once], doc[once], k2[once], k1[once]))]
            s1, s2 = k1[once], k2[once]
            turn = np.ones(len(s1), bool)
            turn[1:] = s1[1:] != s1[:-1]
            new = turn.copy()
            new[1:] |= s2[1:] != s2[:-1]
            number = np.bincount(np.cumsum(turn) - 1, new)[np.cumsum(turn) - 1] if len(s1) else np.zeros(0)
            number = np.where(np.isin(s1, k1[kind == MARK]), PAIRED + 1, number)
            for what, at in ((FEW, once[(number > 1) & (number <= PAIRED)]), (MANY, np.concatenate([once[number > PAIRED], alone]))):
                yield _rows(what, doc[at], doc[at], sub[at], lo[at], hi[at], k1[at])
        release()

    return settled


def stretches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[F.Column, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(doc, sub, text, columns to keep) and (doc, sub, spans): the stretches of each row that repeat, as an array of (lo, hi), which may overlap. doc: the id, the largest number where it is null; sub: tells texts of one id apart."""
    doc, text_hash = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), F.xxhash64("text")
    several = docs.select(doc.alias("doc"), text_hash.alias("h")).groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b")
    named = docs.select(doc.alias("doc"), (text_hash if several.take(1) else F.lit(0).cast("long")).alias("sub"), "text", *keep)
    first = named.select("doc", "sub", "text").mapInArrow(_contexts(length, gram), SCHEMA).repartition("route").mapInArrow(_settle(length, gram, False), SCHEMA)
    first = written(first.select("kind", "k1", "doc", "sub", "lo", "hi"), "contexts")
    open_ = first.where(F.col("kind") != STRETCH).groupBy("doc", "sub").agg(F.collect_set(F.struct("kind", "k1", "lo", "hi")).alias("open"))
    # Equal exchanges of the texts in one plan: they are shuffled once for this and for what uses the result.
    again = named.join(open_, ["doc", "sub"]).mapInArrow(_reopened(length), SCHEMA + ", bytes binary")
    second = again.repartition("route").mapInArrow(_settle(length, gram, True), SCHEMA)
    both = first.where(F.col("kind") == STRETCH).select("doc", "sub", "lo", "hi").unionAll(second.select("doc", "sub", "lo", "hi"))
    return named, both.groupBy("doc", "sub").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _runs(spans: list | None) -> list[tuple[int, int]]:
    if not spans:
        return []
    lo, hi = (np.array([s[k] for s in spans], np.int64) for k in ("lo", "hi"))
    none = np.zeros(len(lo), np.int64)
    _, _, lo, hi = merged(none, none, lo, hi)
    return list(zip(lo.tolist(), hi.tolist(), strict=True))


def _keep(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in runs:
        out.append(text[at:lo])
        at = hi
    out.append(text[at:])
    return b"".join(out)


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    named, spans = stretches(docs, length, gram)

    def measured(batches):
        for batch in batches:
            out = []
            for doc, text, found in zip(batch.column("doc").to_pylist(), texts(batch), batch.column("spans").to_pylist(), strict=True):
                runs = _runs(found)
                out.append((None if doc == LAST_ID else doc, len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_keep(text, runs)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return named.join(spans, ["doc", "sub"], "left").mapInArrow(measured, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _whole(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the characters that they hold in part."""
    out = []
    for lo, hi in runs:
        while lo < hi and text[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows of docs, with repeated passages taken out of text (characters held in part stay) and n_chars, where there is one, as the text then has."""
    names, null = docs.columns, F.col("text").isNull()
    named, spans = stretches(docs, length, gram, (null.alias("_null"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"]))
    joined = named.join(spans, ["doc", "sub"], "left").drop("doc", "sub")
    kept = [c for c in joined.columns if c not in ("text", "spans", "_null")]
    schema = "text string" + "".join(f", {c} {joined.schema[c].dataType.simpleString()}" for c in kept)

    def shortened(batches):
        for batch in batches:
            out = []
            for text, none, found in zip(texts(batch), batch.column("_null").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                out.append(None if none else _keep(text, _whole(text, _runs(found))).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *[batch.column(c) for c in kept]], names=["text", *kept])

    found = joined.mapInArrow(shortened, schema)
    value = lambda i, c: F.col("text") if c == "text" else F.length("text").cast("long") if c == "n_chars" else F.col(f"c{i}")
    return found.select(*[value(i, c).alias(c) for i, c in enumerate(names)])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


#: The same in SQL: every string of 100 bytes of every document.
SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, p, md5(b[p + 1 : p + 100]) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
again AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS turn FROM again),
numbered AS (SELECT doc_id, p, sum(turn) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
runs AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM numbered GROUP BY doc_id, k),
parts AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS e FROM runs UNION ALL SELECT d.doc_id, coalesce(max(r.hi), 0), d.n FROM d LEFT JOIN runs r USING (doc_id) GROUP BY d.doc_id, d.n),
kept AS (SELECT doc_id, string_agg(CASE WHEN e > a THEN hex(b[a + 1 : e]) ELSE '' END, '' ORDER BY a) AS x FROM parts JOIN d USING (doc_id) GROUP BY doc_id),
counted AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(x)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
