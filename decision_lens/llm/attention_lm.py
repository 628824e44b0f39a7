"""Language-model scoring: a causal self-attention model in numpy on subword ids, beside a word-count base.

Texts are taken in blocks of bounded size, in chunks, and spelled: a block is staged once, as the subword ids of its distinct words and its
texts' sequences of these words, beside its chunk's number of training windows and training counts of subword ids. Bytes and hashes of words
follow from their ids, so neither text nor hashes are staged. The distinct words of each chunk go to buckets by word hash with their training
counts. Buckets add the counts of a word over all chunks and answer every chunk that asked for it, so word counts are never gathered on the
driver or broadcast: they grow with the corpus. When the slots are known, blocks send all their training windows to lots of shards, as packed
slots; shards are staged so, once. Chunks, buckets and lots are so large that the number of messages does not grow with the square of the input.

Network: each subword id has a slot, its own if it is one of the most frequent ids of the training texts, else a shared tail
slot, within which ids are weighted by their training counts. Ids that begin a word and ids that go on with one have slots of
their own. A slot's vector goes through one masked self-attention layer with learned distance weights, a residual sum and a
hidden layer; the next slot is predicted as a group, then a member of the group. The result is a probability over all ids of
the vocabulary. Training (Adam, hand-written gradients) learns from every window of every training text once, whatever the size
of the table. Windows are dealt to shards of about SHARD by hash, and within a shard to ROUNDS rounds. In each round every shard
goes on from the common parameters and moments over its windows of that round, in Spark; shards are summed by partition, then
over partitions, and their mean by number of windows starts the next round. The driver holds one model.

Scoring: a text is its words, each as subword ids after a blank, then an end id. Windows of STRIDE targets see CONTEXT more ids
before them and score every id once. The ids of a word, and that the next one begins a word, give the network's probability
of the word in its context. A word seen c times in N training tokens of V distinct ones has the probability
W * network + (1 - W) * (max(c - D, 0) / N + D * V / N * network), with D from the numbers of words seen once and twice. W =
NETWORK_WEIGHT does not depend on the corpus, so context counts alike on every size; the network alone can spell unknown words.
log10 probabilities add up over the text.

Defined cases: null and empty texts hold the end only; rows with a null id are held out and never learned from; repeated rows count
and score alike; without training texts every slot and tail id is equally likely; an empty table gives an empty result;
more columns are not carried. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from decision_lens.llm.blocks import ANSWERED, ANSWERED_DDL, NO_ID, SENT, SENT_DDL, blobs_of, blocks_of, each_bucket, each_chunk, each_chunk_with, restored, squeezed, table_of, unpacked
from decision_lens.llm.suffix_dedup import bucket_of, runs
from decision_lens.llm.textkit import LOWER, SPACED, mixed, quoted, word_hashes, word_spans
from decision_lens.session import stage

VOCABULARY = "byte_bpe_50k.tiktoken"
N_IDS = 50_257
END = 50_256
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FEED = 198
LONG_WORD = 512
GROUPS, MEMBERS = 32, 16
SLOTS = GROUPS * MEMBERS
BEGIN = SLOTS // 2  # slots below begin a word or end the text, the others go on with a word
TAIL_BEGIN, TAIL_ON, BOS, PAD = BEGIN - 1, SLOTS - 1, SLOTS, SLOTS + 1
STRIDE, CONTEXT = 24, 8
WIDTH, HIDDEN = 16, 32
SHARD = 65_536
DEALT = 1 << 17  # windows that a task deals to lots of shards at a time
LOTS, LOT = 128, 16  # up to LOTS shards are lots of their own; a lot holds LOT shards at most
SPELLED = 1 << 16  # words that are spelled at a time
ROUNDS, BATCH, RATE = 4, 64, 0.02
SCORED = 256  # windows that are scored at a time
SEEN = CONTEXT + 1 + STRIDE
NO_PLACE, TEXT_HEAD = 65_535, 65_534  # in windows: a place outside the text, and the one before its first id
PIECES = 16
BUCKET_BYTES = 32 << 20
FOLDS = 10
NETWORK_WEIGHT = 0.5  # fixed beforehand: either part costs log10 2 a token at most
_CODERS: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file. Pass another path where these files lie elsewhere."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def coder(path: str):
    """One byte-pair coder a worker and file."""
    if path not in _CODERS:
        import base64

        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _CODERS[path] = tiktoken.Encoding("subwords", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[path]


def beginning(path: str) -> np.ndarray:
    """True for the ids that begin a word: those of a leading blank, and the end."""
    enc = coder(path)
    out = np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(N_IDS - 1)] + [True])
    return out


def subwords(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each after a blank, one after the other, and where each word starts (and the end)."""
    enc = coder(path)
    if not words:
        return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
    if max(map(len, words)) <= LONG_WORD:
        ids = enc.encode_to_numpy((b"\n " + b"\n ".join(words)).decode(), disallowed_special=()).astype(np.int32)
        feeds = np.flatnonzero(ids == FEED)
        if len(feeds) == len(words):
            keep = np.ones(len(ids), dtype=bool)
            keep[feeds] = False
            return ids[keep], np.append(feeds - np.arange(len(feeds)), len(ids) - len(feeds))
    out = []
    for w in words:
        text = w.decode()
        parts = [text[i:i + LONG_WORD] for i in range(0, len(text), LONG_WORD)]
        out.append([x for i, p in enumerate(parts) for x in enc.encode_ordinary(p if i else " " + p)])
    return np.array([x for o in out for x in o], dtype=np.int32), np.concatenate([[0], np.cumsum([len(o) for o in out])])


def told_apart(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, sorted, a place of each, and which of them each value is."""
    order = np.argsort(h)
    at = runs(h[order])
    one, which = order[at[:-1]], np.empty(len(h), dtype=np.int64)
    which[order] = np.repeat(np.arange(len(one)), np.diff(at))
    return h[one], one, which


class Block:
    """Words of a block of texts: distinct words by hash, and each text's sequence of them."""

    def __init__(self, blob, folds: int):
        self.ids, self.bounds, data = unpacked(blob)
        low = LOWER[data]
        # words must not run over the end of a text
        inner = self.bounds[1:-1]
        starts, ends = word_spans(low, SPACED)
        first = np.searchsorted(starts, inner)
        crossing = inner[(first > 0) & (ends[np.maximum(first - 1, 0)] > inner)] if len(starts) else inner[:0]
        if len(crossing):
            crossing = crossing[np.concatenate([[True], crossing[1:] != crossing[:-1]])]
            starts = np.insert(starts, np.searchsorted(starts, crossing), crossing)
            ends = np.insert(ends, np.searchsorted(ends, crossing), crossing)
        self.raw = low.tobytes()
        self.hash, one, self.word = told_apart(word_hashes(low, starts, ends))
        self.spans = starts[one], ends[one]
        doc = np.searchsorted(self.bounds, starts, side="right") - 1
        self.n_words = np.bincount(doc, minlength=len(self.ids))
        self.count(folds)

    def count(self, folds: int) -> None:
        """Training counts of the distinct words."""
        rest = np.array([0 if i == NO_ID else zlib.crc32(str(i).encode()) % folds for i in self.ids.tolist()], dtype=np.int64)
        self.held_out = rest == 0
        self.doc = np.repeat(np.arange(len(self.ids)), self.n_words)
        self.trained = np.bincount(self.word, weights=~self.held_out[self.doc], minlength=self.n_distinct).astype(np.int64)

    @property
    def n_distinct(self) -> int:
        return len(self.hash)

    def words(self, which=slice(None)) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(*(x[which].tolist() for x in self.spans))]

    def stream(self, ids: np.ndarray, at: np.ndarray, docs: np.ndarray | None = None):
        """Subword ids of the texts (all, or those in ``docs``), each with its end, and where each text starts (and the end)."""
        ids, at = np.append(ids, END), np.append(at, len(ids) + 1)
        own, n_words = self.word, self.n_words
        if docs is not None:
            first = np.concatenate([[0], np.cumsum(n_words)])
            own = np.concatenate([own[:0], *[own[first[d]:first[d + 1]] for d in docs.tolist()]])
            n_words = n_words[docs]
        last = np.cumsum(n_words)
        word = np.insert(own, last, self.n_distinct)
        size = np.diff(at)[word]
        total = np.cumsum(size)
        flat = ids[np.repeat(at[word] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        ends = total[last + np.arange(len(last))] if len(last) else total[:0]
        return flat, np.concatenate([[0], ends]).astype(np.int64)


class Spelled(Block):
    """A block of texts by the subword ids of its distinct words, ``sub`` and ``at``; its bytes follow from these."""

    def __init__(self, blob, folds: int, path: str):
        raw, self.path = restored(blob), path
        n, distinct, n_words, n_sub = np.frombuffer(raw, dtype=np.int64, count=4).tolist()
        form = [("ids", np.int64, n), ("n_words", np.int64, n), ("size", np.int32, distinct), ("sub", np.uint16, n_sub), ("word", word_type(distinct), n_words)]
        place = 32
        for name, kind, count in form:
            setattr(self, name, np.frombuffer(raw, dtype=kind, count=count, offset=place))
            place += count * np.dtype(kind).itemsize
        self.sub, self.word = self.sub.astype(np.int32), self.word.astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.count(folds)

    @property
    def n_distinct(self) -> int:
        return len(self.size)

    @property
    def hash(self) -> np.ndarray:
        """Hashes of the distinct words, from the bytes of their subwords."""
        text, edge = id_bytes(self.path)
        length = np.diff(edge)[self.sub]
        end = np.cumsum(length)
        data = text[np.repeat(edge[self.sub] - (end - length), length) + np.arange(end[-1] if len(end) else 0)]
        bounds = np.concatenate([[0], end])[self.at]
        # after the blank
        return word_hashes(data, bounds[:-1] + 1, bounds[1:])


def word_type(distinct: int):
    return np.uint16 if distinct <= 1 << 16 else np.uint32


def spelled(b: Block, ids: np.ndarray, at: np.ndarray) -> bytes:
    head = np.array([len(b.ids), b.n_distinct, len(b.word), len(ids)], dtype=np.int64)
    return squeezed(b"".join(x.tobytes() for x in (head, b.ids, b.n_words.astype(np.int64), np.diff(at).astype(np.int32), ids.astype(np.uint16),
                                                   b.word.astype(word_type(b.n_distinct)))))


def id_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids, one after the other, and where each id's start (and the end)."""
    key = path, "bytes"
    if key not in _CODERS:
        enc = coder(path)
        parts = [enc.decode_single_token_bytes(i) for i in range(N_IDS - 1)]
        _CODERS[key] = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([0, *map(len, parts)])
    return _CODERS[key]


def window_index(bounds: np.ndarray):
    """Text and first target of every window."""
    n = -(-np.diff(bounds) // STRIDE)
    doc = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, bounds[doc] + number * STRIDE, number


def training_windows(b: Block, ids: np.ndarray, at: np.ndarray, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ids (n, SEEN) of the windows of a block's training texts whose hashes fall into the share."""
    docs = np.flatnonzero(~b.held_out)
    flat, bounds = b.stream(ids, at, docs)
    doc, start, number = window_index(bounds)
    order = mixed(b.ids[docs][doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64))
    if share < 1:
        pick = order < np.uint64(int(share * 2.0 ** 64))
        doc, start, order = doc[pick], start[pick], order[pick]
    place = start[:, None] - CONTEXT - 1 + np.arange(SEEN)
    head, end = bounds[doc][:, None], bounds[doc + 1][:, None]
    if not len(doc):
        return order, np.zeros((0, SEEN), dtype=np.uint16)
    out = np.where((place >= head) & (place < end), flat[np.clip(place, 0, len(flat) - 1)], np.where(place == head - 1, TEXT_HEAD, NO_PLACE))
    return order, out.astype(np.uint16)


WINDOW = np.dtype([("order", "<u8"), ("ids", "<u2", (SEEN,))])


def shard_of(order: np.ndarray, n_shards: int) -> np.ndarray:
    """Shards of windows by their hashes."""
    return (mixed(order + np.uint64(1)) % np.uint64(n_shards)).astype(np.int64)


def by_value(values: np.ndarray):
    """(value, its places) of all values."""
    by = np.argsort(values, kind="stable")
    cut = runs(values[by])
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(values[by[x]]), by[x:y]


def dealt_windows(blob, n_shards: int):
    """(shard, windows) of the windows that ``first_pass`` gives, both compressed."""
    w = np.frombuffer(zlib.decompress(blob), dtype=WINDOW)
    for shard, own in by_value(shard_of(w["order"], n_shards)):
        yield shard, zlib.compress(w[own].tobytes(), 1)


def packed_slots(slots: np.ndarray) -> bytes:
    """Windows of slots, compressed: the lower 8 bits of each, then the others, bit by bit."""
    flat = slots.ravel()
    return squeezed(b"".join([flat.astype(np.uint8).tobytes(), np.packbits((flat >> 8 & 1).astype(bool)).tobytes(), np.packbits((flat >> 9).astype(bool)).tobytes()]))


def unpacked_slots(blob, n: int) -> np.ndarray:
    size = n * SEEN
    raw = np.frombuffer(restored(blob), dtype=np.uint8)
    high, highest = (np.unpackbits(x, count=size).astype(np.int16) for x in (raw[size:size + (size + 7) // 8], raw[size + (size + 7) // 8:]))
    return (raw[:size] + (high << 8) + (highest << 9)).reshape(n, SEEN)


def first_pass(blob, bits: int, folds: int, path: str):
    """All that one block gives, as rows (kind, bucket, order, a, b): words, subword counts, spellings, training windows with their number.

    For a look at a single block; ``scored`` takes the same parts in turn, from the spelled block.
    """
    b = Block(blob, folds)
    yield from (("words", bucket, 0, words, counts) for bucket, words, counts in word_rows(b, bits))
    ids, at = subwords(b.words(), path)
    yield "ids", -1, 0, id_counts(ids, np.diff(at), b.trained, int((~b.held_out).sum())), b""
    yield "subwords", -1, 0, zlib.compress(np.diff(at).astype(np.int32).tobytes() + ids.astype(np.uint16).tobytes(), 1), b""
    order, seen_ids = training_windows(b, ids, at)
    if len(order):
        out = np.zeros(len(order), dtype=WINDOW)
        out["order"], out["ids"] = order, seen_ids
        yield "window", -1, len(order), zlib.compress(out.tobytes(), 1), b""


def spelled_chunk(blobs: list, folds: int, path: str) -> tuple[list[bytes], int, bytes]:
    """(spelled blocks, number of their training windows, training counts of subword ids); a word of several blocks is spelled once."""
    blocks = [Block(blob, folds) for blob in blobs]
    words = Words(blocks)
    spelling = [subwords(words.taken(blocks, at, at + SPELLED), path) for at in range(0, len(words.hash), SPELLED)]
    ids = np.concatenate([np.zeros(0, dtype=np.int32), *[x for x, _ in spelling]])
    size = np.concatenate([np.zeros(0, dtype=np.int64), *[np.diff(at) for _, at in spelling]])
    first = np.cumsum(size) - size
    data, n_windows = [], 0
    for b, which in zip(blocks, words.of_block):
        at = np.concatenate([[0], np.cumsum(size[which])])
        data.append(spelled(b, ids[np.repeat(first[which] - at[:-1], size[which]) + np.arange(at[-1])], at))
        n_windows += training_count(b, at)
    ends = sum(int((~b.held_out).sum()) for b in blocks)
    return data, n_windows, id_counts(ids, size, words.trained, ends)


def spelled_block(blob, folds: int, path: str) -> tuple[bytes, int, bytes]:
    """As ``spelled_chunk`` for one block."""
    (data,), n_windows, counts = spelled_chunk([blob], folds, path)
    return data, n_windows, counts


def training_count(b: Block, at: np.ndarray) -> int:
    n_ids = np.bincount(b.doc, weights=np.diff(at)[b.word], minlength=len(b.ids)) + 1
    return int(np.ceil(n_ids[~b.held_out] / STRIDE).sum())


def id_counts(ids: np.ndarray, size: np.ndarray, trained: np.ndarray, ends: int) -> bytes:
    """Training counts of the subword ids of words, ``size`` each, that stand ``trained`` times, and of ends."""
    count = np.bincount(ids, weights=np.repeat(trained, size), minlength=N_IDS).astype(np.int64)
    count[END] = ends
    seen = np.flatnonzero(count)
    return squeezed(seen.astype(np.int32).tobytes() + count[seen].tobytes())


def counts_of(blob) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their counts."""
    raw = restored(blob)
    n = len(raw) // 12
    return np.frombuffer(raw, dtype=np.int32, count=n), np.frombuffer(raw, dtype=np.int64, offset=4 * n)


class Words:
    """Distinct words of a chunk by hash, their training counts, and which of them each block's are."""

    def __init__(self, blocks: list[Block]):
        hashes = [b.hash for b in blocks]
        self.hash, self.one, which = told_apart(np.concatenate(hashes))
        self.first = np.cumsum([0, *map(len, hashes)])
        self.trained = np.bincount(which, weights=np.concatenate([b.trained for b in blocks]), minlength=len(self.hash)).astype(np.int64)
        self.of_block = np.split(which, self.first[1:-1])

    def taken(self, blocks: list[Block], start: int, stop: int) -> list[bytes]:
        """Bytes of some of the words, from the blocks that hold them."""
        one = self.one[start:stop]
        block = np.searchsorted(self.first, one, side="right") - 1
        out = np.empty(len(one), dtype=object)
        for i, b in enumerate(blocks):
            own = np.flatnonzero(block == i)
            out[own] = b.words(one[own] - self.first[i])
        return out.tolist()


def word_rows(b: Block | Words, bits: int):
    """(bucket, hashes, training counts) of a block's or chunk's distinct words, both packed: hashes as differences, byte by byte."""
    h = b.hash
    buckets = bucket_of(h, bits)
    cut = runs(buckets)
    gap = np.diff(h, prepend=np.uint64(0))
    gap[cut[:-1]] = h[cut[:-1]]
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(buckets[x]), squeezed(gap[x:y].view(np.uint8).reshape(-1, 8).T.tobytes()), squeezed(b.trained[x:y].astype(np.uint32).tobytes())


def hashes_of(blob) -> np.ndarray:
    gap = np.frombuffer(restored(blob), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(gap.T).view(np.uint64)[:, 0], dtype=np.uint64)


def totals_of(rows):
    """Training counts of a bucket's words for each chunk that holds them; then a row without a chunk: words, distinct ones, seen once, twice."""
    hashes = [hashes_of(r[2]) for r in rows]
    counts = np.concatenate([np.frombuffer(restored(r[3]), dtype=np.uint32) for r in rows]).astype(np.int64)
    distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
    first = 0
    for r, h in zip(rows, hashes):
        yield r[0], r[1], squeezed(total[which[first:first + len(h)]].astype(np.uint32).tobytes()), 0, 0, 0, 0
        first += len(h)
    yield None, None, b"", int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())


def added(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, as a product: short rows are slow to reduce."""
    return x @ np.ones(x.shape[-1], dtype=x.dtype)


def limited_exp(x: np.ndarray, limit: float) -> None:
    """Exponentials in place, of ``limit`` at most."""
    if x.size and not x.max() <= limit:
        np.minimum(x, x.dtype.type(limit), out=x)
    np.exp(x, out=x)


def by_group(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """Order of target slots by group; groups and members in this order; each group's part."""
    t = targets.ravel()
    order = np.argsort((t // MEMBERS).astype(np.uint8), kind="stable")
    t = t[order]
    g = t // MEMBERS
    cut = np.searchsorted(g, np.arange(GROUPS + 1)).tolist()
    return order, g, t % MEMBERS, [(i, slice(cut[i], cut[i + 1])) for i in range(GROUPS) if cut[i] < cut[i + 1]]


class Model:
    """Slots by training counts, and a network over them."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray, seed: int = 5):
        order = np.lexsort((np.arange(N_IDS), -counts))
        order = order[(counts[order] > 0) & (order != END)]
        first, on = order[begins[order]][:BEGIN - 2], order[~begins[order]][:SLOTS - BEGIN - 1]
        self.slot = np.where(begins, TAIL_BEGIN, TAIL_ON).astype(np.int16)
        self.slot[first], self.slot[on] = np.arange(len(first)), BEGIN + np.arange(len(on))
        self.slot[END] = BEGIN - 2
        self.tail_log = np.zeros(N_IDS)
        for tail in (TAIL_BEGIN, TAIL_ON):
            own = self.slot == tail
            weight = counts[own] + 0.5
            self.tail_log[own] = np.log(weight / weight.sum())
        r = np.random.default_rng(seed)
        n = lambda *s, d: r.normal(0, d, s).astype(np.float32)
        self.p = {"embed": n(SLOTS + 2, WIDTH, d=0.3), "query": n(WIDTH, WIDTH, d=0.25), "key": n(WIDTH, WIDTH, d=0.25), "value": n(WIDTH, WIDTH, d=0.25),
                  "near": np.zeros(STRIDE + CONTEXT, dtype=np.float32), "hidden": n(WIDTH, HIDDEN, d=0.25), "hidden_base": np.zeros(HIDDEN, dtype=np.float32),
                  "group": np.zeros((HIDDEN, GROUPS), dtype=np.float32), "group_base": np.zeros(GROUPS, dtype=np.float32),
                  "member": np.zeros((GROUPS, HIDDEN, MEMBERS), dtype=np.float32), "member_base": np.zeros((GROUPS, MEMBERS), dtype=np.float32)}
        reach = np.arange(STRIDE)[:, None] + CONTEXT - np.arange(STRIDE + CONTEXT)
        self.reach, self.ahead = np.clip(reach, 0, None), reach < 0

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, key and value of each slot: one product a slot, not a place."""
        p = self.p
        return p["embed"] @ (p["query"] / np.float32(WIDTH ** 0.5)), p["embed"] @ p["key"], p["embed"] @ p["value"]

    def forward(self, x_ids: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        """Keys, values, queries, weights (not divided by their sum), 1 / their sum, their means of values, and these beside the places' own vectors.

        For windows of input slots (n, CONTEXT + STRIDE). Where rows of 16 or 32 numbers meet one number each, it is repeated: short rows are slow.
        """
        x_ids = x_ids.astype(np.intp)
        own_ids = x_ids[:, CONTEXT:]
        of_query, of_key, of_value = tables or self.tables()
        q, k, v = of_query.take(own_ids, axis=0), of_key.take(x_ids, axis=0), of_value.take(x_ids, axis=0)
        s = q @ k.transpose(0, 2, 1)
        s += np.where(self.ahead, np.float32(-1e9), self.p["near"][self.reach])
        padded = np.flatnonzero((x_ids[:, :CONTEXT + 1] == PAD) @ np.ones(CONTEXT + 1, dtype=np.float32))
        if len(padded):
            s[padded] += np.where(x_ids[padded] == PAD, np.float32(-1e9), np.float32(0))[:, None, :]
        limited_exp(s, 60)
        r = 1 / added(s.reshape(-1, s.shape[-1]))
        mean = s @ v
        mean.ravel()[:] *= np.repeat(r, WIDTH)
        return k, v, q, s, r, mean, (self.p["embed"].take(own_ids, axis=0) + mean).reshape(-1, WIDTH)

    def hidden(self, z: np.ndarray) -> np.ndarray:
        """Hidden values and a one, from rows of ``forward``."""
        p = self.p
        h = z @ np.concatenate([p["hidden"], np.zeros((WIDTH, 1), dtype=z.dtype)], axis=1)
        h += np.append(p["hidden_base"], p["hidden_base"].dtype.type(1))
        return np.maximum(h, np.zeros_like(h), out=h)

    def members(self, h: np.ndarray, parts: list[tuple[int, slice]]) -> np.ndarray:
        """Of rows in order of their group, the members' values."""
        member = np.concatenate([self.p["member"], self.p["member_base"][:, None]], axis=1)
        out = np.empty((len(h), MEMBERS), dtype=h.dtype)
        for i, part in parts:
            np.dot(h[part], member[i], out=out[part])
        return out

    def groups(self, h: np.ndarray) -> np.ndarray:
        return h @ np.concatenate([self.p["group"], self.p["group_base"][None]])

    def log_probability(self, x_ids: np.ndarray, targets: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of the target slots, and of any slot that begins a word, (n * STRIDE)."""
        order, g, m, parts = by_group(targets)
        h = self.hidden(self.forward(x_ids, tables)[-1].take(order, axis=0))
        rows = np.arange(len(g))
        lg, lm = self.groups(h), self.members(h, parts)
        own = lg[rows, g] + lm[rows, m]
        np.exp(lg, out=lg)
        np.exp(lm, out=lm)
        sums = lg @ np.repeat(np.eye(2, dtype=lg.dtype), GROUPS // 2, axis=0)
        begin, all_ = np.log(sums[:, 0]), np.log(added(sums))
        own -= all_ + np.log(added(lm))
        out, first = np.empty_like(own), np.empty_like(own)
        out[order], first[order] = own, begin - all_
        return out, first

    def gradients(self, x_ids: np.ndarray, targets: np.ndarray, known: np.ndarray) -> dict:
        p, out = self.p, {}
        k, v, q, s, r, mean, z = self.forward(x_ids)
        # rows stand in order of their target's group, so that each group's members are one product
        order, g, m, parts = by_group(targets)
        w = (known.ravel() / max(1, known.sum())).astype(np.float32)[order]
        z = z.take(order, axis=0)
        h = self.hidden(z)
        rows = np.arange(len(g))

        def error(e, right):
            limited_exp(e, 80)
            e.ravel()[:] *= np.repeat(w / added(e), e.shape[1])
            e[rows, right] -= w
            return e

        eg, em = error(self.groups(h), g), error(self.members(h, parts), m)
        both = h.T @ eg
        out["group"], out["group_base"] = both[:-1], both[-1]
        of_members, dh = np.zeros((GROUPS, HIDDEN + 1, MEMBERS), dtype=h.dtype), np.empty((len(h), HIDDEN), dtype=h.dtype)
        back = np.ascontiguousarray(p["member"].transpose(0, 2, 1))
        for i, part in parts:
            e = em[part]
            np.dot(h[part].T, e, out=of_members[i])
            np.dot(e, back[i], out=dh[part])
        out["member"], out["member_base"] = of_members[:, :-1], of_members[:, -1]
        dh += eg @ p["group"].T
        dh *= h[:, :-1] > 0
        out["hidden"], out["hidden_base"] = z.T @ dh, np.ones(len(dh), dtype=dh.dtype) @ dh
        back = np.empty_like(order)
        back[order] = rows
        dz = (dh @ p["hidden"].T).take(back, axis=0)
        # what the weights' softmax takes off is the product of dz and the weighted mean of the values
        off = added(dz * mean.reshape(-1, WIDTH)) * r
        d = (dz.ravel() * np.repeat(r, WIDTH)).reshape(q.shape)
        ds = d @ v.transpose(0, 2, 1)
        ds.ravel()[:] -= np.repeat(off, ds.shape[-1])
        ds *= s
        out["near"] = np.bincount(self.reach.ravel(), weights=np.ones(len(ds), dtype=ds.dtype) @ ds.reshape(len(ds), -1), minlength=len(p["near"])).astype(np.float32)
        dq = (ds @ k).reshape(-1, WIDTH)
        dq *= np.float32(WIDTH ** -0.5)
        of_all = np.empty((*x_ids.shape, 2 * WIDTH), dtype=ds.dtype)
        np.matmul(ds.transpose(0, 2, 1), q, out=of_all[..., :WIDTH])
        np.matmul(s.transpose(0, 2, 1), d, out=of_all[..., WIDTH:])
        of_all = of_all.reshape(-1, 2 * WIDTH)
        all_ = p["embed"].take(x_ids, axis=0)
        both = all_.reshape(-1, WIDTH).T @ of_all
        out["query"], out["key"], out["value"] = all_[:, CONTEXT:].reshape(-1, WIDTH).T @ dq, both[:, :WIDTH], both[:, WIDTH:]
        dx = (of_all @ np.concatenate([p["key"], p["value"]], axis=1).T).reshape(all_.shape)
        dz += dq @ p["query"].T
        dx[:, CONTEXT:] += dz.reshape(q.shape)
        place = np.arange(p["embed"].size).reshape(p["embed"].shape).take(x_ids, axis=0)
        out["embed"] = np.bincount(place.ravel(), weights=dx.ravel(), minlength=p["embed"].size).astype(dx.dtype).reshape(p["embed"].shape)
        return out

    def start(self) -> dict:
        """State of the training: parameters and Adam's two moments."""
        return {**self.p, **{f"{name} {k}": np.zeros_like(x) for name in ("first", "second") for k, x in self.p.items()}}

    def slots(self, ids: np.ndarray) -> np.ndarray:
        """Slots of windows of ids; a place outside the text is PAD."""
        out = np.append(self.slot, np.int16(PAD))[np.minimum(ids, N_IDS)]
        return np.where(ids == TEXT_HEAD, np.int16(BOS), out)

    def train(self, state: dict, ids: np.ndarray, turn: int, turns: int, seed: int = 5) -> dict:
        """The state after one of ``turns`` rounds, which share the windows of ids (n, SEEN) among them: each is learned from in one round."""
        return self.train_slots(state, self.slots(ids), turn, turns, seed)

    def train_slots(self, state: dict, slots: np.ndarray, turn: int, turns: int, seed: int = 5) -> dict:
        """As ``train``, from windows of slots."""
        steps = -(-len(slots) // (turns * BATCH))
        slots = slots[np.random.default_rng(seed).permutation(len(slots))[turn::turns]]
        inputs, targets = slots[:, :-1], slots[:, CONTEXT + 1:].astype(np.int64)
        known = (targets < SLOTS).astype(np.float32)
        targets[targets >= SLOTS] = 0
        # all parameters in one array, and the moments in two
        size = [x.size for x in self.p.values()]
        place = dict(zip(self.p, (slice(a, a + n) for a, n in zip(np.cumsum([0, *size]).tolist(), size))))
        flat, m, v = (np.concatenate([np.ravel(state[ahead + k]) for k in self.p]).astype(np.float32) for ahead in ("", "first ", "second "))
        shaped = lambda x: {k: x[place[k]].reshape(state[k].shape) for k in place}
        self.p, g, moved = shaped(flat), np.zeros_like(flat), np.empty_like(flat)
        for step, at in enumerate(range(0, len(slots), BATCH), turn * steps + 1):
            pick = slice(at, at + BATCH)
            rate = RATE * (1 - 0.9 * step / (turns * steps))
            for k, x in self.gradients(inputs[pick], targets[pick], known[pick]).items():
                g[place[k]] = x.ravel()
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            v *= np.float32(0.99)
            v += np.float32(0.01) * g
            np.sqrt(v, out=moved)
            moved += np.float32(1e-8 * (1 - 0.99 ** step) ** 0.5)
            np.divide(m, moved, out=moved)
            moved *= np.float32(rate * (1 - 0.99 ** step) ** 0.5 / (1 - 0.9 ** step))
            flat -= moved
        return {**shaped(flat), **{f"first {k}": x for k, x in shaped(m).items()}, **{f"second {k}": x for k, x in shaped(v).items()}}

    def positions(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every place: log probability of its id, and that a word begins there."""
        slots = self.slot[flat]
        doc, start, _ = window_index(bounds)
        lp, begin = self.tail_log[flat], np.zeros(len(flat))
        padded, tables = np.append(slots, np.int16(PAD)), self.tables()
        for at in range(0, len(doc), SCORED):
            d, s = doc[at:at + SCORED], start[at:at + SCORED]
            target = s[:, None] + np.arange(STRIDE, dtype=np.int64)
            real = target < bounds[d + 1][:, None]
            source = s[:, None] - 1 - CONTEXT + np.arange(STRIDE + CONTEXT)
            head = bounds[d][:, None] - 1
            x = np.where(source > head, padded[np.minimum(np.maximum(source, 0), len(slots))], np.where(source == head, BOS, PAD))
            own, first = self.log_probability(x, np.where(real, padded[np.minimum(target, len(slots))], 0).astype(np.int64), tables)
            where = target[real]
            lp[where] += own.reshape(real.shape)[real]
            begin[where] = first.reshape(real.shape)[real]
        return lp, begin


class Counts:
    """Training tokens, distinct ones, seen once and twice, and training texts."""

    def __init__(self, words: int, distinct: int, once: int, twice: int, texts: int):
        self.tokens, self.distinct, self.texts = words + texts, distinct + int(texts > 0), texts
        once, twice = once + int(texts == 1), twice + int(texts == 2)
        self.cut = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def mixed(self, c: np.ndarray, network: np.ndarray) -> np.ndarray:
        """Natural log probability of words seen c times to which the network gives ``network``."""
        if not self.tokens:
            return network
        with np.errstate(divide="ignore"):
            own = np.log((1 - NETWORK_WEIGHT) * np.maximum(c - self.cut, 0) / self.tokens)
        return np.logaddexp(own, network + np.log(NETWORK_WEIGHT + (1 - NETWORK_WEIGHT) * self.cut * self.distinct / self.tokens))


def text_scores(model: Model, counts: Counts, b: Block, c: np.ndarray, ids: np.ndarray, at: np.ndarray):
    """n_known, base and model log10 probability of each text of a block; c, ids, at: training counts and subwords of its distinct words."""
    n = len(b.ids)
    c = np.append(c, counts.texts)
    flat, bounds = b.stream(ids, at)
    lp, begin = model.positions(flat, bounds)
    last = np.cumsum(b.n_words)
    word = np.insert(b.word, last, b.n_distinct)
    doc = np.repeat(np.arange(n), b.n_words + 1)
    size = np.diff(np.append(at, at[-1] + 1))[word]
    first = np.cumsum(size) - size
    inside = np.add.reduceat(lp, first) if len(first) else lp
    after = np.append(begin[first[1:]], 0.0) if len(first) else begin
    after[word == b.n_distinct] = 0.0
    network = inside - begin[first] + after
    add = lambda x: np.bincount(doc, weights=x, minlength=n)
    return add(c[word] > 0).astype(np.int64), add(counts.base(c)[word]), add(counts.mixed(c[word], network)) / np.log(10)


def flat_state(state: dict) -> np.ndarray:
    return np.concatenate([np.ravel(state[k]) for k in sorted(state)]).astype(np.float64)


def shaped_state(flat: np.ndarray, like: dict) -> dict:
    keys = sorted(like)
    parts = np.split(flat, np.cumsum([like[k].size for k in keys])[:-1])
    return {k: x.reshape(like[k].shape).astype(np.float32) for k, x in zip(keys, parts)}


def shards_of(model: Model, blocks: DataFrame, shard_windows: int, folds: int, path: str) -> DataFrame | None:
    """(n, slots): all training windows in shards, each in one row and sorted by hash. They are sent and staged as packed slots, once each."""
    total = blocks.agg(F.sum("n_windows")).first()[0] or 0
    if not total:
        return None
    n_shards = max(1, round(total / shard_windows))
    # a message goes from so many windows to a lot, not to a shard: the number of messages is the product of both
    lot = min(LOT, -(-n_shards // LOTS))
    n_lots = -(-n_shards // lot)
    sent = blocks.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("lot", pa.int64()), ("n", pa.int64()), ("shard", pa.binary()), ("hash", pa.binary()), ("slots", pa.binary())])

    def deal(batches):
        kept, n = [], 0

        def rows():
            order, slots = (np.concatenate(x) for x in zip(*kept))
            shard = shard_of(order, n_shards)
            return table_of([(k, len(own), squeezed((shard[own] % lot).astype(np.uint8).tobytes()), (order[own] >> np.uint64(32)).astype(np.uint32).tobytes(),
                              packed_slots(slots[own])) for k, own in by_value(shard // lot)], schema).to_batches()

        for batch in batches:
            for b in (Spelled(blob, folds, path) for chunk in batch.column(0) for blob in blobs_of(chunk)):
                order, ids = training_windows(b, b.sub, b.at)
                kept.append((order, sent.value.slots(ids)))
                n += len(order)
                # of several blocks, so that rows of one lot are packed together
                if n >= DEALT:
                    yield from rows()
                    kept, n = [], 0
        if n:
            yield from rows()

    def joined_lot(t):
        n = t.column("n").to_pylist()
        shard = np.frombuffer(b"".join(map(restored, t.column("shard").to_pylist())), dtype=np.uint8)
        order = np.frombuffer(b"".join(t.column("hash").to_pylist()), dtype=np.uint32)
        slots = np.concatenate([unpacked_slots(x, k) for x, k in zip(t.column("slots").to_pylist(), n)])
        made = [(t.column("lot")[0].as_py() * lot + k, len(own), packed_slots(slots[own][sorted_windows(order[own], slots[own])])) for k, own in by_value(shard)]
        return table_of(made, pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("slots", pa.binary())]))

    return stage(blocks.select("data").mapInArrow(deal, "lot long, n long, shard binary, hash binary, slots binary").repartition(n_lots, "lot")
                 .groupBy("lot").applyInArrow(joined_lot, "shard long, n long, slots binary"))


def sorted_windows(order: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Places of windows by hash; where hashes agree, slots decide, so that the order does not depend on partitions."""
    by = np.argsort(order, kind="stable")
    at = runs(order[by])
    size = np.diff(at)
    tied = np.flatnonzero(np.repeat(size > 1, size))
    own = by[tied]
    by[tied] = own[np.lexsort([*slots[own].T[::-1], order[own]])]
    return by


def trained(model: Model, shards: DataFrame | None) -> Model:
    """The model, trained on all windows: shards in parallel, averaged after every round."""
    if shards is None:
        return model
    spark = shards.sparkSession
    state = model.start()
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model, state))

        def learn(batches, turn=turn, sent=sent):
            total_, n = None, 0
            for batch in batches:
                for shard, size, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    own = flat_state(sent.value[0].train_slots(sent.value[1], unpacked_slots(blob, size), turn, ROUNDS, seed=shard)) * size
                    total_, n = own if total_ is None else total_ + own, n + size
            if n:
                parts = np.array_split(total_, PIECES)
                yield pa.RecordBatch.from_pydict({"piece": pa.array(range(PIECES), pa.int32()), "n": pa.array([n] * PIECES, pa.int64()),
                                                  "sum": pa.array([x.tobytes() for x in parts], pa.binary())})

        def added(t):
            sums = np.sum([np.frombuffer(x, dtype=np.float64) for x in t.column("sum").to_pylist()], axis=0)
            return pa.table({"piece": t.column("piece").slice(0, 1), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "sum": pa.array([sums.tobytes()], pa.binary())})

        ddl = "piece int, n long, sum binary"
        rows = sorted(shards.mapInArrow(learn, ddl).groupBy("piece").applyInArrow(added, ddl).collect(), key=lambda r: r["piece"])
        state = shaped_state(np.concatenate([np.frombuffer(r["sum"], dtype=np.float64) for r in rows]) / rows[0]["n"], state)
        sent.unpersist()
    model.p = {k: state[k] for k in model.p}
    return model


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS, path: str | None = None, shard_windows: int = SHARD) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    path = path or vocabulary_path()
    made = pa.schema([("data", pa.list_(pa.binary())), ("n_windows", pa.int64()), ("id_counts", pa.binary())])
    blocks = blocks_of(docs, key, text, lambda blobs: spelled_chunk(blobs, folds, path), made, "data array<binary>, n_windows long, id_counts binary")
    size = docs.agg(F.sum(F.octet_length(quoted(text).cast("string")))).first()[0] or 0
    bits = max(4, int(size // BUCKET_BYTES).bit_length())
    words = each_chunk(blocks, lambda part, chunk, blobs: ((part, chunk, *x) for x in word_rows(Words([Spelled(x, folds, path) for x in blobs]), bits)), SENT, SENT_DDL)
    reply = pa.schema([*ANSWERED, *[(c, pa.int64()) for c in ("words", "distinct", "once", "twice")]])
    replies = stage(each_bucket(words, lambda bucket, rows: ((p, c, bucket, *x) for p, c, *x in totals_of(rows)), reply,
                                ANSWERED_DDL + ", words long, distinct long, once long, twice long"))
    sums = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "distinct", "once", "twice")]).first()

    def id_rows(batches):
        for batch in batches:
            for seen, count in map(counts_of, batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_pydict({"id": pa.array(seen), "n": pa.array(count)})

    # one row per id of the vocabulary at most
    per_id = blocks.select("id_counts").mapInArrow(id_rows, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    of_ids = np.zeros(N_IDS, dtype=np.int64)
    for r in per_id:
        of_ids[r["id"]] = r["n"]
    model = Model(of_ids, beginning(path))
    model = trained(model, shards_of(model, blocks, shard_windows, folds, path))
    counts = Counts(*sums, int(of_ids[END]))
    known = docs.sparkSession.sparkContext.broadcast((model, counts))
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(part, chunk, blobs, found):
        own = [Spelled(x, folds, path) for x in blobs]
        c = np.concatenate([np.zeros(0, dtype=np.int64), *[np.frombuffer(restored(a), dtype=np.uint32).astype(np.int64) for _, a in sorted(found)]])
        for b, which in zip(own, Words(own).of_block):
            seen, base, score = text_scores(*known.value, b, c[which], b.sub, b.at)
            n = len(b.ids)
            yield from zip([None if i == NO_ID else i for i in b.ids.tolist()], b.held_out.tolist(), (b.n_words + 1).tolist(), seen.tolist(),
                           [known.value[1].tokens] * n, base.tolist(), score.tolist())

    found = replies.where("chunk IS NOT NULL").select("part", "chunk", "bucket", "answer")
    done = each_chunk_with(blocks, found, finish, schema,
                           "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumnRenamed("id", key)
