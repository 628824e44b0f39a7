"""Exact removal of byte strings that repeat across documents, by a hash-compared suffix sort.

A byte goes if it lies in a string of SPAN = 50 bytes that also starts in a document with a smaller id.

1. Texts are packed into blocks of bounded size, in chunks, written once to a bucketed table that later steps read without moving it.
2. Anchors: of every run of SPAN bytes the place with the least hash of GRAM = 24 bytes. The choice depends on the run alone, so equal
   strings have equal anchors. Each chunk sends the hashes of its anchors, mixed anew, to buckets by hash, which answer those that occur in
   another document too. Nothing else of the text leaves the chunk in this step.
3. For shared anchors the chunk sends each distinct surrounding (all strings of SPAN bytes that hold the anchor lie in it) once,
   with its least and greatest id.
4. A bucket sorts, for each anchor, the suffixes of its surroundings that start a string of SPAN bytes. Runs of many suffixes are first
   split by the suffixes' words of 8 bytes, one after the other. Prefix polynomial hashes
   give the hash of any range; binary search over them finds how far two suffixes agree, so a comparison takes a logarithmic
   number of steps; a merge sort over these comparisons runs for all anchors side by side. Neighbours that agree over SPAN bytes
   are compared byte by byte before they count as equal. The least id of each class goes back to the chunks.
5. Each block marks, for every anchor, the strings whose class has a smaller id than their document, and cuts marked bytes.

Hot anchors, which stand at more than about HOT places, are split by content: the buckets of step 2 add up the chunks' numbers of places
(powers of two, so up to twice too many) and name them with their answer. Of these a chunk sends, instead of surroundings, each distinct
string of SPAN bytes around them with its least and greatest id, to a bucket by the string's hash. Only equal strings meet there, whatever
their anchor; the bucket sorts them by their bytes and answers the least id of those that repeat.

Sizes: a chunk sends a row per bucket, and the number of buckets follows the input, so a bucket has about BUCKET_BYTES of text
to answer for, and HOT surroundings of one anchor at most. A surrounding or string that many documents of a chunk share travels once.

Defined cases: null texts are empty; texts of fewer than SPAN bytes lose nothing; rows with a null id neither lose nor take bytes;
rows of one id are one document and take nothing from each other; repeated rows lose alike; an empty table gives an empty
result; more columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from decision_lens.llm.blocks import ANSWERED, ANSWERED_DDL, NO_ID, SENT, SENT_DDL, blocks_of, each_bucket, each_chunk, each_chunk_with, restored, several, squeezed, unpacked
from decision_lens.llm.textkit import INVERSE, mixed, powers, prefix_hash, quoted, range_hash

SPAN, GRAM = 50, 24
REACH = SPAN - GRAM
AROUND = SPAN + REACH
BUCKET_BYTES = 8 << 20
STEP_BITS = 16
STEP = 1 << STEP_BITS - 1  # strings whose anchors are sought at a time; places within them have STEP_BITS
MIX = np.random.default_rng(50).integers(1, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SUFFIXES = 150_000
FEW = 16  # of more suffixes, words of WORD bytes are sorted before suffixes are merged
WORD = 8
HOT = 1 << 14
SEVERAL = np.uint8(128)
BY_STRING = 255  # in place of the first string of an answer: ``around`` is the hash of a string


def words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as a number."""
    out = np.empty(len(raw) - 7, dtype=np.uint64)
    for i in range(min(8, len(out))):
        out[i::8] = raw[i:i + (len(raw) - i) // 8 * 8].view(np.uint64)
    return out


class Anchors:
    """Anchors of a block: places, hashes, documents and surroundings."""

    def __init__(self, blob):
        self.ids, self.bounds, self.data = unpacked(blob)
        sizes = np.diff(self.bounds)
        # places where a string of SPAN bytes of one document starts
        edge = np.zeros(len(self.data) + 1, dtype=np.int8)
        long = np.flatnonzero(sizes >= SPAN)
        edge[self.bounds[long]] += 1
        edge[self.bounds[long + 1] - SPAN + 1] -= 1
        inside = np.cumsum(edge, dtype=np.int8).view(bool)
        found = [x for at in range(0, len(self.data) - SPAN + 1, STEP) for x in self.anchors(at, inside)]
        place, self.hash = (np.concatenate([np.zeros(0, dtype=t), *found[i::2]]) for i, t in enumerate((np.int64, np.uint64)))
        first = np.concatenate([[True], place[1:] != place[:-1]])[:len(place)]
        self.place, self.hash = place[first], self.hash[first]
        self.doc = np.searchsorted(self.bounds, self.place, side="right") - 1
        self._prefix = None

    def anchors(self, at: int, inside: np.ndarray):
        """Places and hashes of the anchors of the STEP strings from ``at`` on; arrays of this length stay in the cache."""
        w = words_at(self.data[at:at + STEP + SPAN - 1])
        h = w[:-16] * MIX[0]
        h += w[8:-8] * MIX[1]
        h += w[16:] * MIX[2]
        h = mixed(h)
        least = h >> np.uint64(STEP_BITS)
        least <<= np.uint64(STEP_BITS)
        least |= np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        place = (least[inside[at:at + len(least)]] & np.uint64((1 << STEP_BITS) - 1)).astype(np.int64)
        place = place[np.concatenate([[True], place[1:] != place[:-1]])[:len(place)]]
        # mixed anew: anchors have the least hashes, which would fill the first buckets only
        return at + place, mixed(h[place] ^ MIX[0])

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = prefix_hash(self.data)
        return self._prefix

    def strings(self) -> np.ndarray:
        """Hash of the string of SPAN bytes at each byte; strings that run over the end of a text count as well."""
        n = len(self.data)
        return mixed((self.prefix[SPAN:] - self.prefix[:-SPAN]) * powers(INVERSE, n + 1)[:n - SPAN + 1] + np.uint64(SPAN))

    def only(self, mask: np.ndarray) -> None:
        self.place, self.hash, self.doc = self.place[mask], self.hash[mask], self.doc[mask]

    def around(self):
        """Bytes that the document has before and after each anchor, REACH at most, and the hash of the surrounding."""
        left = np.minimum(self.place - self.bounds[self.doc], REACH)
        right = np.minimum(self.bounds[self.doc + 1] - self.place - GRAM, REACH)
        h = range_hash(self.prefix, self.place - left, self.place + GRAM + right)
        return left, right, mixed(h + (left * 64 + right).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def short_of(h: np.ndarray, bits: int) -> np.ndarray:
    """32 bits of a hash below the bits that name its bucket."""
    return (h << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)


def runs(keys: np.ndarray):
    """Starts of runs of equal values, and their end."""
    return np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else [], len(keys)).astype(np.int64)


def among(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is one of the sorted known ones; their upper bits tell most others apart before the search."""
    if not len(known):
        return np.zeros(len(h), dtype=bool)
    upper = np.zeros(1 << 20, dtype=bool)
    upper[known >> np.uint64(44)] = True
    out = upper[h >> np.uint64(44)]
    rest = h[out]
    out[out] = known[np.minimum(np.searchsorted(known, rest), len(known) - 1)] == rest
    return out


def known_anchors(blob) -> Anchors:
    """Anchors of the documents that have an id."""
    a = Anchors(blob)
    a.only(a.ids[a.doc] != NO_ID)
    return a


def extremes(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest id of each run."""
    return (np.minimum.reduceat(ids, at[:-1]), np.maximum.reduceat(ids, at[:-1])) if len(ids) else (ids, ids)


def anchor_hashes(blobs, bits: int):
    """(bucket, short hashes, marks) of a chunk; a mark has the bits of the number of places, and SEVERAL if in several documents."""
    found = [(a.hash, a.ids[a.doc]) for a in map(known_anchors, several(blobs))]
    h, ids = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(h)
    h, ids = h[order], ids[order]
    at = runs(h)
    one, (least, most) = h[at[:-1]], extremes(ids, at)
    marks = np.ceil(np.log2(np.diff(at))).astype(np.uint8) | np.where(least != most, SEVERAL, np.uint8(0))
    buckets = bucket_of(one, bits)
    cut = runs(buckets)
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(buckets[x]), short_of(one[x:y], bits).tobytes(), marks[x:y].tobytes()


def shared_hashes(rows, hot: int = HOT):
    """Of the rows (part, chunk, hashes, marks) of a bucket, each chunk's hashes that another document has as well, and bits of the hot ones."""
    arrays = [np.frombuffer(r[2], dtype=np.uint32) for r in rows]
    marks = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
    all_ = np.concatenate(arrays)
    order = np.argsort(all_, kind="stable")
    at = runs(all_[order])
    mask, is_hot = np.zeros(len(all_), dtype=bool), np.zeros(len(all_), dtype=bool)
    mask[order] = np.repeat(np.diff(at) > 1, np.diff(at))
    mask |= marks >= SEVERAL
    places = np.left_shift(np.int64(1), (marks & (SEVERAL - np.uint8(1))).astype(np.int64))
    is_hot[order] = np.repeat(np.add.reduceat(places[order], at[:-1]) > hot, np.diff(at))
    first = 0
    for r, a in zip(rows, arrays):
        part = slice(first, first + len(a))
        own = a[mask[part]]
        first += len(a)
        if len(own):
            yield r[0], r[1], own.tobytes() + np.packbits(is_hot[part][mask[part]]).tobytes()


def shared_and_hot(answer: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(answer) * 8 // 33
    return np.frombuffer(answer, dtype=np.uint32, count=n), np.unpackbits(np.frombuffer(answer, dtype=np.uint8, offset=4 * n), count=n).astype(bool)


SURROUNDING = np.dtype([("anchor", "<u8"), ("around", "<u8"), ("least", "<i8"), ("most", "<i8"), ("left", "u1"), ("right", "u1"), ("bytes", f"V{AROUND}")])
STRING = np.dtype([("hash", "<u8"), ("least", "<i8"), ("most", "<i8"), ("bytes", f"S{SPAN}")])
ANSWER = np.dtype([("around", "<u8"), ("first", "u1"), ("last", "u1"), ("least", "<i8")])


def shared_anchors(shared: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and short hashes of the shared anchors as one number each, sorted, and whether they are hot."""
    split = [shared_and_hot(v) for _, v in shared]
    known = np.concatenate([(np.uint64(b) << np.uint64(32)) | h.astype(np.uint64) for (b, _), (h, _) in zip(shared, split)])
    order = np.argsort(known)
    return known[order], np.concatenate([x for _, x in split])[order]


def surroundings(blobs, shared: list[tuple[int, bytes]], bits: int):
    """(bucket, distinct surroundings of shared anchors) of a chunk; strings of hot anchors have buckets of their own, from 1 << bits."""
    if not shared:
        return
    known, hot = shared_anchors(shared)
    around, strings = [], []
    for a in map(known_anchors, several(blobs)):
        own = (bucket_of(a.hash, bits).astype(np.uint64) << np.uint64(32)) | short_of(a.hash, bits).astype(np.uint64)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = known[at] == own
        strings.append(hot_strings(a, hit & hot[at]))
        a.only(hit & ~hot[at])
        around.append(own_surroundings(a))
    for first, parts, key in ((0, around, "anchor"), (1 << bits, strings, "hash")):
        out = distinct(np.concatenate(parts), key, "around" if parts is around else "hash")
        buckets = bucket_of(out[key], bits)
        cut = runs(buckets)
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield first + int(buckets[x]), squeezed(out[x:y].tobytes())


def distinct(found: np.ndarray, key: str, same: str) -> np.ndarray:
    """One record of those that agree in ``same``, with their least and greatest id; sorted by ``key``."""
    order = np.argsort(found[same])
    at = runs(found[same][order])
    out = found[order[at[:-1]]]
    out["least"], out["most"] = extremes(found["least"][order], at)[0], extremes(found["most"][order], at)[1]
    return out if key == same else out[np.argsort(out[key], kind="stable")]


def own_surroundings(a: Anchors) -> np.ndarray:
    """Distinct surroundings of a block's anchors."""
    left, right, around = a.around()
    ids = a.ids[a.doc]
    order = np.argsort(around)
    at = runs(around[order])
    one = order[at[:-1]]
    out = np.zeros(len(one), dtype=SURROUNDING)
    out["anchor"], out["around"], out["left"], out["right"] = a.hash[one], around[one], left[one], right[one]
    out["least"], out["most"] = extremes(ids[order], at)
    padded = np.concatenate([np.zeros(REACH, dtype=np.uint8), a.data, np.zeros(AROUND, dtype=np.uint8)])
    column = np.arange(AROUND)
    taken = np.lib.stride_tricks.sliding_window_view(padded, AROUND)[a.place[one]]
    short = np.flatnonzero((left[one] < REACH) | (right[one] < REACH))
    taken[short] *= (column >= REACH - left[one][short, None]) & (column < REACH + GRAM + right[one][short, None])
    out["bytes"] = np.ascontiguousarray(taken).view(f"V{AROUND}")[:, 0]
    return out


def hot_strings(a: Anchors, hot: np.ndarray) -> np.ndarray:
    """Distinct strings of SPAN bytes around the hot anchors of a block."""
    place, doc = a.place[hot], a.doc[hot]
    start = place[:, None] - REACH + np.arange(REACH + 1)
    inside = (start >= a.bounds[doc][:, None]) & (start + SPAN <= a.bounds[doc + 1][:, None])
    start, first = np.unique(start[inside], return_index=True)
    if not len(start):
        return np.zeros(0, dtype=STRING)
    ids = np.broadcast_to(a.ids[doc][:, None], inside.shape)[inside][first]
    text = np.lib.stride_tricks.sliding_window_view(a.data, SPAN)
    h = a.strings()[start]
    order = np.argsort(h)
    at = runs(h[order])
    one = order[at[:-1]]
    out = np.zeros(len(one), dtype=STRING)
    out["hash"] = h[one]
    out["least"], out["most"] = extremes(ids[order], at)
    out["bytes"] = np.ascontiguousarray(text[start[one]]).view(f"S{SPAN}")[:, 0]
    return out


def string_answers(rows):
    """For each chunk, its strings that a smaller id than one of its documents has as well, equal byte by byte."""
    parts = [np.frombuffer(restored(r[2]), dtype=STRING) for r in rows]
    all_ = np.concatenate(parts)
    order = np.argsort(all_["bytes"], kind="stable")
    at = runs(all_["bytes"][order])
    least = np.zeros(len(all_), dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(all_["least"][order], at[:-1]), np.diff(at))
    first = 0
    for r, p in zip(rows, parts):
        mine = least[first:first + len(p)]
        first += len(p)
        useful = mine < p["most"]
        if useful.any():
            out = np.zeros(int(useful.sum()), dtype=ANSWER)
            out["around"], out["first"], out["last"], out["least"] = p["hash"][useful], BY_STRING, BY_STRING, mine[useful]
            yield r[0], r[1], squeezed(out.tobytes())


class Suffixes:
    """Suffixes of a byte array, compared over ``limit`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, limit: int):
        self.data, self.limit = data, limit
        self.prefix = prefix_hash(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common start of suffixes a and b, by binary search; equal ones are known by their whole hash."""
        out = np.full(len(a), self.limit, dtype=np.int64)
        turn = powers(INVERSE, len(self.prefix))
        pa_, pb, ta, tb = self.prefix[a], self.prefix[b], turn[a], turn[b]
        rest = np.flatnonzero((self.prefix[a + self.limit] - pa_) * ta != (self.prefix[b + self.limit] - pb) * tb)
        a, b, pa_, pb, ta, tb = (x[rest] for x in (a, b, pa_, pb, ta, tb))
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.limit - 1, dtype=np.int64)
        for _ in range(int(self.limit - 1).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - pa_) * ta == (self.prefix[b + mid] - pb) * tb
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[rest] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        at = np.minimum(n, self.limit - 1)
        return np.where(n >= self.limit, or_equal, self.data[a + at] < self.data[b + at])

    def sort(self, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Merge sort of the suffixes within runs of equal segment, all segments at once: order of ``starts``.

        A step merges runs of ``width``: the new place of a suffix of the right run is its own less the number of the left run's
        suffixes after it, found by binary search; the suffixes of the left run fill the places that are left, in their order.
        """
        order = np.arange(len(starts))
        bounds = runs(segment)
        size = np.diff(bounds)
        first = np.repeat(bounds[:-1], size)
        end = np.repeat(bounds[1:], size)
        width = 1
        while width < (size.max() if len(size) else 0):
            within = np.flatnonzero(end - first > width)
            f = first[within]
            right = (within - f) // width % 2 == 1
            own, f = within[right], f[right]
            start = f + (own - f) // width * width
            low, high, me = start - width, start.copy(), starts[order[own]]
            open_ = np.arange(len(own))
            while len(open_):
                mid = (low[open_] + high[open_]) >> 1
                # suffixes of the left run stand before equal ones of the right run
                before = self.less(starts[order[mid]], me[open_], np.ones(len(open_), dtype=bool))
                low[open_[before]] = mid[before] + 1
                high[open_[~before]] = mid[~before]
                open_ = open_[low[open_] < high[open_]]
            place = own - (start - low)
            free = np.zeros(len(order), dtype=bool)
            free[within] = True
            free[place] = False
            fresh_order = order.copy()
            fresh_order[place], fresh_order[np.flatnonzero(free)] = order[own], order[within[~right]]
            order, width = fresh_order, 2 * width
        return order


def classes(found: np.ndarray) -> np.ndarray:
    """Least id of the class of each string of SPAN bytes, (surroundings, REACH + 1); NO_ID where there is no such string.

    ``found`` holds distinct surroundings, sorted by anchor. Anchors are taken a bounded number of suffixes at a time, one anchor
    at least.
    """
    first = np.arange(REACH + 1)
    valid = (first >= REACH - found["left"][:, None]) & (first + SPAN <= REACH + GRAM + found["right"][:, None].astype(np.int64))
    least = np.where(valid, found["least"][:, None], NO_ID)
    bounds = runs(found["anchor"])
    size = np.diff(bounds)
    several = np.flatnonzero(size > 1)
    group = np.cumsum(size[several]) * (REACH + 1) // SUFFIXES
    for g in np.split(several, runs(group)[1:-1]):
        if len(g):
            rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in g.tolist()])
            least[rows] = sorted_classes(found[rows], valid[rows])
    return least


def sorted_classes(found: np.ndarray, valid: np.ndarray) -> np.ndarray:
    data = np.frombuffer(found["bytes"].tobytes(), dtype=np.uint8)
    least = np.full(valid.shape, NO_ID)
    row, s = np.nonzero(valid)
    if not len(row):
        return least
    number = np.repeat(np.arange(len(runs(found["anchor"])) - 1), np.diff(runs(found["anchor"])))
    segment = number[row] * (REACH + 1) + s
    by = np.argsort(segment, kind="stable")
    row, s, segment = row[by], s[by], segment[by]
    starts = row * AROUND + s
    order, tied = by_words(data, starts, segment)
    order = order[Suffixes(data, SPAN).sort(starts[order], tied)]
    order = confirmed_order(data, starts, segment, order)
    same = neighbours(data, starts[order])[0] & (segment[1:] == segment[:-1])
    label = np.concatenate([[0], np.cumsum(~same)])
    class_least = np.full(label[-1] + 1, NO_ID)
    np.minimum.at(class_least, label, found["least"][row[order]])
    least[row[order], s[order]] = class_least[label]
    return least


def by_words(data: np.ndarray, starts: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes within runs of more than FEW of one segment by their words of WORD bytes, and runs that are left to sort.

    A merge sort takes the square of the logarithm of a run's length for each suffix, this a fixed number of sorts of numbers.
    """
    order, first = np.arange(len(starts)), np.concatenate([[True], segment[1:] != segment[:-1]])
    words = words_at(np.concatenate([data, np.zeros(WORD, dtype=np.uint8)])).byteswap()
    for at in (*range(0, SPAN - WORD, WORD), SPAN - WORD):
        bounds = np.append(np.flatnonzero(first), len(first))
        size = np.diff(bounds)
        many = np.flatnonzero(np.repeat(size > FEW, size))
        if not len(many):
            break
        own, key = np.cumsum(first)[many], words[starts[order[many]] + at]
        by = np.lexsort((key, own))
        order[many], key = order[many[by]], key[by]
        first[many[1:]] |= key[1:] != key[:-1]
        if at == SPAN - WORD:
            first[many] = True  # equal in all words
    return order, np.cumsum(first)


def neighbours(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each string of SPAN bytes and the next: whether they are equal, and whether the next is less, byte by byte."""
    strings = np.lib.stride_tricks.sliding_window_view(data, SPAN)
    equal, falls = np.ones(max(0, len(starts) - 1), dtype=bool), np.zeros(max(0, len(starts) - 1), dtype=bool)
    for at in range(0, len(equal), 50_000):
        text = strings[starts[at:at + 50_001]]
        differ = text[1:] != text[:-1]
        where, row = differ.argmax(axis=1), np.arange(len(differ))
        equal[at:at + len(row)] = ~differ[row, where]
        falls[at:at + len(row)] = text[1:][row, where] < text[:-1][row, where]
    return equal, falls


def confirmed_order(data: np.ndarray, starts: np.ndarray, segment: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The order, with every segment sorted anew by its bytes in which hashes have misled the sort."""
    falls = neighbours(data, starts[order])[1] & (segment[1:] == segment[:-1])
    if not falls.any():
        return order
    order = order.copy()
    for wrong in np.unique(segment[1:][falls]):
        where = np.flatnonzero(segment == wrong)
        order[where] = sorted(order[where].tolist(), key=lambda i: data[starts[i]:starts[i] + SPAN].tobytes())
    return order


def answers(rows):
    """For each chunk, where its surroundings hold strings with a smaller id than one of its documents."""
    parts = [np.frombuffer(restored(r[2]), dtype=SURROUNDING) for r in rows]
    all_ = np.concatenate(parts)
    order = np.argsort(all_["around"])
    at = runs(all_["around"][order])
    one = all_[order[at[:-1]]]
    one["least"] = extremes(all_["least"][order], at)[0]
    by = np.argsort(one["anchor"], kind="stable")
    least = np.empty((len(one), REACH + 1), dtype=np.int64)
    least[by] = classes(one[by])
    which = np.zeros(len(all_), dtype=np.int64)
    which[order] = np.repeat(np.arange(len(one)), np.diff(at))
    first = 0
    for r, p in zip(rows, parts):
        mine = least[which[first:first + len(p)]]
        first += len(p)
        useful = (mine < p["most"][:, None]) & (mine != NO_ID)
        # runs of strings with one least id
        start = useful.copy()
        start[:, 1:] &= ~useful[:, :-1] | (mine[:, 1:] != mine[:, :-1])
        i, s = np.nonzero(start)
        if not len(i):
            continue
        stop = useful.copy()
        stop[:, :-1] &= ~useful[:, 1:] | (mine[:, 1:] != mine[:, :-1])
        out = np.zeros(len(i), dtype=ANSWER)
        out["around"], out["first"], out["last"], out["least"] = p["around"][i], s, np.nonzero(stop)[1], mine[i, s]
        yield r[0], r[1], squeezed(out.tobytes())


def cut(blobs, replies: list[bytes]):
    """(id, n_bytes, n_removed, n_spans, kept bytes) of each text of a chunk."""
    known = np.frombuffer(b"".join(map(restored, replies)), dtype=ANSWER)
    known = known[np.argsort(known["around"], kind="stable")]
    is_string = known["first"] == BY_STRING
    known, by_string = ((np.ascontiguousarray(x["around"]), x) for x in (known[~is_string], known[is_string]))
    at = runs(known[0])
    for blob in several(blobs):
        yield from cut_block(blob, *known, at, *by_string)


def cut_block(blob, hashes: np.ndarray, known: np.ndarray, at: np.ndarray, strings: np.ndarray, by_string: np.ndarray):
    """As ``cut`` of one block: answers for surroundings, in runs of one hash, and for strings, sorted by hash."""
    a = Anchors(blob)
    step = np.zeros(len(a.data) + 1, dtype=np.int32)
    a.only(a.ids[a.doc] != NO_ID)
    if len(by_string) and len(a.place):
        h = a.strings()
        start = np.flatnonzero(among(strings, h))
        doc = np.searchsorted(a.bounds, start, side="right") - 1
        start, doc = (x[start + SPAN <= a.bounds[doc + 1]] for x in (start, doc))
        ids = a.ids[doc]
        start = start[(ids != NO_ID) & (by_string["least"][np.searchsorted(strings, h[start])] < ids)]
        step[start] += 1
        step[start + SPAN] -= 1
    if len(known) and len(a.place):
        _, _, around = a.around()
        which = np.flatnonzero(among(hashes, around))
        i = np.searchsorted(hashes[at[:-1]], around[which])
        lo, hi = at[i], at[i + 1]
        place = np.repeat(which, hi - lo)
        entry = known[np.arange(len(place)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        hit = entry["least"] < a.ids[a.doc[place]]
        place, entry = a.place[place[hit]] - REACH, entry[hit]
        np.add.at(step, place + entry["first"], 1)
        np.add.at(step, place + entry["last"] + SPAN, -1)
    gone = np.cumsum(step[:-1]) > 0
    for i, x, y in zip(a.ids.tolist(), a.bounds[:-1].tolist(), a.bounds[1:].tolist()):
        g = gone[x:y]
        edges = np.count_nonzero(g[1:] & ~g[:-1]) + (int(g[0]) if y > x else 0)
        n = int(np.count_nonzero(g))
        yield None if i == NO_ID else i, y - x, n, int(edges), (a.data[x:y][~g] if n else a.data[x:y]).tobytes()


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", with_kept: bool = False, hot: int = HOT) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans (removed runs), kept_sha256, and the kept bytes if asked for."""
    blocks = blocks_of(docs, key, text)
    size = docs.agg(F.sum(F.octet_length(quoted(text).cast("string")))).first()[0] or 0
    bits = max(6, int(size // BUCKET_BYTES).bit_length())
    hashes = each_chunk(blocks, lambda part, chunk, blobs: ((part, chunk, *x) for x in anchor_hashes(blobs, bits)), SENT, SENT_DDL)
    shared = each_bucket(hashes, lambda bucket, rows: ((p, c, bucket, x) for p, c, x in shared_hashes(rows, hot)), ANSWERED, ANSWERED_DDL)
    around = each_chunk_with(blocks, shared, lambda part, chunk, blobs, found: ((part, chunk, x, y, None) for x, y in surroundings(blobs, found, bits)),
                             SENT, SENT_DDL)
    replies = each_bucket(around, lambda bucket, rows: ((p, c, bucket, x) for p, c, x in (string_answers if bucket >> bits else answers)(rows)), ANSWERED, ANSWERED_DDL)
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_kept)
    done = each_chunk_with(
        blocks, replies, lambda part, chunk, blobs, found: ((*x[:4], hashlib.sha256(x[4]).hexdigest(), x[4])[:len(schema)] for x in cut(blobs, [a for _, a in found])),
        schema, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
    return done.withColumnRenamed("id", key)
