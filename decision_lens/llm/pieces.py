"""SentencePiece encoding and decoding with sampled segmentations, by forward filtering and backward sampling.

A text, after one blank in front, falls into units: runs of characters that begin where a blank follows a non-blank, around line
feeds, cut after UNIT characters. No piece of the vocabulary reaches over such an end except that the cut bounds the longest unit. Within a
unit all ways to cut it into pieces form a lattice. Forward filtering sums the weights of the ways to each place; going back
from the end, each piece is drawn with the probability that it has among all ways, so a segmentation is drawn with the
probability of its pieces' weights. Draws are hashes of (seed, row key, place of the unit, step): a row is cut alike in every
run, task and batch. Distinct units of a batch are filtered once, many at a time.

Weights: a byte-pair vocabulary holds ranks, not probabilities, so a piece of rank r weighs (r + 2)^-ALPHA (Zipf); characters
without a piece are written as byte pieces. A literal U+2581 is written as bytes too, so decoding gives back every text.

Defined cases: null texts have null ids and decode to null; empty texts have no ids; rows with a null key are seeded by the text alone
(as key 0); repeated rows are cut alike; an empty table gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from decision_lens.llm.textkit import fresh, map_texts, mixed, quoted

MARK = "▁"
MODEL = "piece_bpe_32k.model"
ALPHA = 1.0
UNIT = 32
LONGEST = 16
TABLE_BITS = 20
LATTICE_CELLS = 500_000
SEED = 17


def model_path(name: str = MODEL) -> str:
    """Place of a public vocabulary file. Pass another path where these files lie elsewhere."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def _code_hash(codes: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """Hash of a run of code points, one character longer than ``h``."""
    before = np.full(len(codes), 0x51ED270B, dtype=np.uint64) if h is None else h
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + codes.astype(np.uint64) + np.uint64(1))


class Vocabulary:
    """Pieces of a SentencePiece model with a hash table from code points to ids."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        self.byte_id = np.zeros(256, dtype=np.int32)
        for i in range(n):
            if m.is_byte(i):
                self.byte_id[int(self.pieces[i][3:-1], 16)] = i
        self.bytes = [b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_id):
            self.bytes[i] = bytes([b])
        rank = np.arange(n, dtype=np.float64)
        self.weight = (rank + 2.0) ** -alpha
        self.byte_weight = float((n + 2.0) ** -alpha)
        usable = [(p.replace(MARK, " "), i) for i, p in enumerate(self.pieces) if i not in special and len(p) <= LONGEST]
        self.longest = max(len(p) for p, _ in usable)
        size = 1 << TABLE_BITS
        # pieces and their beginnings by hash: the piece's id, if it is one, and whether a longer piece begins so
        self.key, self.used = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=bool)
        self.id, self.more = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=bool)
        for text, i in usable:
            h = None
            for n_read, c in enumerate(text, 1):
                h = _code_hash(np.array([ord(c)]), h)
                at = int(h[0]) & (size - 1)
                while self.used[at] and self.key[at] != h[0]:
                    at = (at + 1) & (size - 1)
                self.key[at], self.used[at] = h[0], True
                if n_read == len(text):
                    self.id[at] = i
                else:
                    self.more[at] = True
        # longest walk of a look-up
        run = best = 0
        for x in self.used.tolist():
            run = run + 1 if x else 0
            best = max(best, run)
        self.probes = best + 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of the piece or beginning with each hash, or -1."""
        last = (1 << TABLE_BITS) - 1
        at = (h & np.uint64(last)).astype(np.int64)
        used, same = self.used[at], self.key[at] == h
        out = np.where(used & same, at, -1)
        open_ = np.flatnonzero(used & ~same)
        for step in range(1, self.probes):
            if not len(open_):
                break
            a = (at[open_] + step) & last
            same = self.used[a] & (self.key[a] == h[open_])
            out[open_[same]] = a[same]
            open_ = open_[self.used[a] & ~same]
        return out

    def lattice(self, codes: np.ndarray):
        """Of units of one length (n, L): ids (n, L end, longest), -1 for none and -2 for bytes, and forward weights (n, L + 1).

        The unit's piece that ends before place j + 1 and has k + 1 characters stands at [j, k].
        """
        n, length = codes.shape
        k_max = min(self.longest, length)
        ids = np.full((n, length, k_max), -1, dtype=np.int32)
        for start in range(length):
            h, own = None, np.arange(n)
            for k in range(min(k_max, length - start)):
                h = _code_hash(codes[own, start + k], h)
                slot = self.find(h)
                ids[own, start + k, k] = np.where(slot >= 0, self.id[slot], -1)
                longer = np.flatnonzero((slot >= 0) & self.more[slot])
                if not len(longer):
                    break
                h, own = h[longer], own[longer]
        single = ids[:, :, 0]
        single[(single < 0) | (codes == ord(MARK))] = -2
        if (codes == ord(MARK)).any():
            # a literal mark is never part of a piece
            for j, k in ((j, k) for j in range(length) for k in range(1, min(k_max, j + 1))):
                bad = (codes[:, j - k:j + 1] == ord(MARK)).any(axis=1)
                ids[bad, j, k] = -1
        w = np.where(ids >= 0, self.weight[np.maximum(ids, 0)], np.where(ids == -2, self.byte_weight, 0.0))
        forward = np.zeros((n, length + 1))
        forward[:, 0] = 1.0
        for j in range(length):
            k = min(k_max, j + 1)
            w[:, j, :k] *= forward[:, j - np.arange(k)]
            forward[:, j + 1] = w[:, j, :k].sum(axis=1)
            # long units would underflow: keep each place's sum near 1 by a common factor of all later ones
            if j % 8 == 7:
                scale = forward[:, j + 1].copy()
                scale[scale == 0] = 1.0
                forward[:, max(0, j + 2 - k_max):j + 2] /= scale[:, None]
        return ids, w

    def encode(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
        """Ids of each text."""
        if not texts:
            return []
        codes = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        starts = unit_starts(codes, first)
        lengths = np.diff(np.append(starts, len(codes)))
        doc = np.searchsorted(first, starts, side="right") - 1
        place = np.arange(len(starts)) - np.searchsorted(starts, first)[doc]
        draw = mixed(keys.astype(np.uint64)[doc] * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
        unit_out, row_out, step_out = [], [], []
        for length in np.unique(lengths).tolist():
            where = np.flatnonzero(lengths == length)
            for part in range(0, len(where), 200_000):
                u = where[part:part + 200_000]
                found = self.sampled(codes[starts[u][:, None] + np.arange(length)], draw[u])
                unit_out.append(u[found[0]])
                row_out.append(found[1])
                step_out.append(found[2])
        unit, ids, step = (np.concatenate(x) for x in (unit_out, row_out, step_out))
        order = np.lexsort((step, unit))
        unit, ids = unit[order], ids[order]
        cut = np.searchsorted(doc[unit], np.arange(1, len(texts)))
        return np.split(ids, cut)

    def sampled(self, codes: np.ndarray, draw: np.ndarray):
        """(unit, id, place in the unit) of a drawn segmentation of units of one length."""
        n, length = codes.shape
        h = None
        for j in range(length):
            h = _code_hash(codes[:, j], h)
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        distinct = codes[one]
        unit_out, id_out, place_out = [], [], []
        part = max(1, LATTICE_CELLS // (length * min(length, self.longest)))
        by = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[by], np.arange(0, len(one) + part, part))
        for at, x, y in zip(range(0, len(one), part), cuts[:-1], cuts[1:]):
            ids, sums = self.lattice(distinct[at:at + part])
            np.cumsum(sums, axis=2, out=sums)
            rows = by[x:y]
            end = np.full(len(rows), length)
            step = 0
            while len(rows):
                own, j = which[rows] - at, end - 1
                u = (mixed(draw[rows] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
                s = sums[own, j]
                k = (s <= (u * s[:, -1])[:, None]).sum(axis=1)
                k = np.minimum(k, s.shape[1] - 1)
                unit_out.append(rows)
                id_out.append(np.where(ids[own, j, k] == -2, -1 - codes[rows, j].astype(np.int64), ids[own, j, k]))
                place_out.append(j - k)
                end = j - k
                more = end > 0
                rows, end = rows[more], end[more]
                step += 1
        return self.spelled(*(np.concatenate(x) for x in (unit_out, id_out, place_out)))

    def spelled(self, unit: np.ndarray, ids: np.ndarray, place: np.ndarray):
        """Characters without a piece (their code is -1 - id) become byte pieces."""
        place = place * 4
        raw = np.flatnonzero(ids < 0)
        if not len(raw):
            return unit, ids.astype(np.int32), place
        more_u, more_i, more_p = [], [], []
        for r in raw.tolist():
            for b, byte in enumerate(chr(-1 - int(ids[r])).encode()):
                more_u.append(unit[r])
                more_i.append(self.byte_id[byte])
                more_p.append(place[r] + b)
        keep = ids >= 0
        return (np.concatenate([unit[keep], np.array(more_u, dtype=unit.dtype)]), np.concatenate([ids[keep], more_i]).astype(np.int32),
                np.concatenate([place[keep], np.array(more_p, dtype=place.dtype)]))

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids))
        return raw.decode()[1:]


def unit_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units begin: at texts, blanks after non-blanks, around line feeds, and UNIT characters after a start."""
    blank, feed = codes == 32, codes == 10
    start = np.zeros(len(codes), dtype=bool)
    start[1:] = (blank[1:] & ~blank[:-1]) | feed[1:] | feed[:-1]
    start[first] = True
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, len(codes)))
    long = np.flatnonzero(size > UNIT)
    if not len(long):
        return at
    more = [np.arange(at[i] + UNIT, at[i] + size[i], UNIT) for i in long.tolist()]
    return np.sort(np.concatenate([at, *more]))


_LOADED: dict[tuple[str, float], Vocabulary] = {}


def loaded(path: str, alpha: float) -> Vocabulary:
    """One vocabulary a worker and file."""
    if (path, alpha) not in _LOADED:
        _LOADED[path, alpha] = Vocabulary(path, alpha)
    return _LOADED[path, alpha]


FIELDS = [T.StructField("ids", T.ArrayType(T.IntegerType()))]


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, alpha: float = ALPHA, seed: int = SEED,
            carry: list[str] | None = None, drop_text: bool = False, decoded: str | None = None) -> DataFrame:
    """Documents with the piece ids of their texts and, under the name ``decoded``, what these ids spell.

    Both are made by one Python worker a task: two of them, in turn, would hold two vocabularies.
    """
    path = path or model_path()
    inner = fresh(docs.columns, "row_key_")
    keyed = docs.withColumn(inner, F.coalesce(quoted(key).cast("long"), F.lit(0)))

    def encode(texts, keys):
        vocabulary = loaded(path, alpha)
        out = vocabulary.encode([(t or b"").decode() for t in texts], np.array(keys, dtype=np.int64).view(np.uint64), seed)
        ids = [None if t is None else x[:0] if not t else x for t, x in zip(texts, out)]
        return [ids] if decoded is None else [ids, [None if x is None else vocabulary.decode(x.tolist()) if len(x) else "" for x in ids]]

    keep = docs.columns if carry is None else carry
    fields = FIELDS if decoded is None else [*FIELDS, T.StructField(decoded, T.StringType())]
    return map_texts(keyed, text, fields, encode, keep=keep, with_rows=(inner,), drop_text=drop_text)


def decoded(rows: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """Rows with the text that their ids spell."""
    path = path or model_path()
    keep = [c for c in rows.columns if c != text]
    source = rows.select(*[quoted(c) for c in keep], quoted(ids).alias("ids_of_row_"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(text, T.StringType())])

    def run(batches):
        import pyarrow as pa
        vocabulary = loaded(path, alpha)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [None if x is None else vocabulary.decode(x) if x else "" for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*keep, text])

    return source.mapInArrow(run, schema)
