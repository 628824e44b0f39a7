"""Benchmark decontamination: a broadcast hash set of normalised item n-grams, scanned over the token windows of whole texts.

Items are read in blocks of a bounded number of bytes, so that what is sent to the tasks has a known size at any size of the
benchmark: 20 bytes a window, with one window a word at most, and the words themselves. A benchmark within one block takes one scan of the documents, a larger one a scan per block, whose results are
joined. Equal hashes are confirmed on the words themselves.

Defined cases: null and empty texts have no words; items without words match nothing; an item with a null id marks words but
is not counted or listed; rows that repeat are scanned alike; empty tables give empty or clean results; input columns with the
name of a result are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from decision_lens.llm.textkit import ALNUM, LOWER, SLICE_BYTES, joined, map_texts, ngram_hashes, quoted, word_hashes, word_spans
from decision_lens.session import stage

WINDOW_WORDS = 10
BLOCK_BYTES = 16 << 20
BITS = 22

FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("hit_words", T.ArrayType(T.LongType())), T.StructField("hit_spans", T.ArrayType(T.LongType())),
          T.StructField("items", T.ArrayType(T.StringType()))]


class Windows(NamedTuple):
    """Windows of one length in order of their hashes: their bytes within the words of the block, and their items."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    items: np.ndarray
    maybe: np.ndarray


class WindowSet:
    """The windows of a block of items as arrays: 20 bytes a window, and the words themselves to confirm them."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], n: int):
        codes: dict[str | None, int] = {}
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        words, held = [], 0
        for group in grouped(items, SLICE_BYTES):
            code = np.array([codes.setdefault(i, len(codes)) for i, _ in group], dtype=np.int32)
            data, _, text_ends = joined([t for _, t in group])
            low = LOWER[data]
            starts, ends = word_spans(low, ALNUM)
            hashed, sizes = word_hashes(low, starts, ends), ends - starts
            doc = np.searchsorted(text_ends, starts, side="right")
            # words in a row, a blank after each
            kept = ALNUM[low]
            low[~kept] = 32
            kept[ends] = True
            words.append(low[kept].tobytes())
            at = held + np.cumsum(sizes + 1) - sizes - 1
            held += len(words[-1])
            length = np.minimum(np.bincount(doc, minlength=len(group)), n)
            for size in np.unique(length[length > 0]).tolist():
                grams = ngram_hashes(hashed, size)
                first = np.arange(len(grams))
                last = first + size - 1
                pick = (doc[first] == doc[last]) & (length[doc[first]] == size)
                first, last = first[pick], last[pick]
                found[size].append((grams[pick], at[first].astype(np.int32), (at[last] + sizes[last]).astype(np.int32), code[doc[first]]))
        self.words, self.ids = b"".join(words), list(codes)
        self.windows = {size: self.ordered(*map(np.concatenate, zip(*parts))) for size, parts in found.items()}

    def ordered(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: np.ndarray) -> Windows:
        order = np.lexsort((items, hashes))
        hashes, starts, ends, items = hashes[order], starts[order], ends[order], items[order]
        # a window that an item holds again is listed once
        keep = np.ones(len(hashes), dtype=bool)
        last = 0
        for i in (np.flatnonzero((hashes[1:] == hashes[:-1]) & (items[1:] == items[:-1])) + 1).tolist():
            last = last if keep[i - 1] == 0 else i - 1
            keep[i] = self.words[starts[i]:ends[i]] != self.words[starts[last]:ends[last]]
        maybe = np.zeros(1 << BITS, dtype=bool)
        maybe[hashes >> np.uint64(64 - BITS)] = True
        return Windows(hashes[keep], starts[keep], ends[keep], items[keep], maybe)

    def scan(self, texts: list[bytes | None]) -> list:
        data, text_starts, text_ends = joined(texts)
        low = LOWER[data]
        starts, ends = word_spans(low, ALNUM)
        hashed = word_hashes(low, starts, ends)
        doc = np.searchsorted(text_ends, starts, side="right")
        step = np.zeros(len(starts) + 1, dtype=np.int64)
        items = [set() for _ in texts]
        for size, w in self.windows.items():
            grams = ngram_hashes(hashed, size)
            near = np.flatnonzero(w.maybe[grams >> np.uint64(64 - BITS)])
            near = near[doc[near] == doc[near + size - 1]]
            lo, hi = (np.searchsorted(w.hashes, grams[near], side=side) for side in ("left", "right"))
            seen: dict[bytes, list[int]] = {}
            for i, a, b in zip(near[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                window = b" ".join(low[x:y].tobytes() for x, y in zip(starts[i:i + size], ends[i:i + size]))
                codes = seen.get(window)
                if codes is None:
                    codes = seen[window] = [k for k, x, y in zip(w.items[a:b].tolist(), w.starts[a:b], w.ends[a:b]) if self.words[x:y] == window]
                if codes:
                    step[i] += 1
                    step[i + size] -= 1
                    items[doc[i]].update(codes)
        hit = np.cumsum(step[:-1]) > 0
        place = np.flatnonzero(hit)
        first_word = np.searchsorted(starts, text_starts)
        words_of = np.bincount(doc, minlength=len(texts))
        cut = np.searchsorted(place, first_word)
        hits = np.split(place - first_word[doc[place]], cut[1:]) if len(texts) else []
        # runs of hit words as byte ranges of their text
        edge = np.flatnonzero(np.diff(place) != 1) + 1 if len(place) else np.zeros(0, dtype=np.int64)
        new_doc = np.flatnonzero(np.diff(doc[place])) + 1 if len(place) else edge
        heads = np.unique(np.concatenate([[0] if len(place) else [], edge, new_doc]).astype(np.int64))
        tails = np.append(heads[1:], len(place)) - 1 if len(heads) else heads
        spans: list[list[int]] = [[] for _ in texts]
        for a, b in zip(place[heads].tolist(), place[tails].tolist()):
            d = doc[a]
            spans[d] += [int(starts[a] - text_starts[d]), int(ends[b] - text_starts[d])]
        return [words_of, np.array([len(h) for h in hits], dtype=np.int64), hits, spans, [sorted(self.ids[k] for k in s if self.ids[k] is not None) for s in items]]


def grouped(items: Iterable[tuple[str | None, str | None]], limit: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in lists of about ``limit`` bytes of text, one item at least."""
    group, held = [], 0
    for item_id, text in items:
        group.append((item_id, (text or "").encode()))
        held += len(group[-1][1])
        if held >= limit:
            yield group
            group, held = [], 0
    if group:
        yield group


def scanned(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, text: str = "text", item: str = "item_id",
            item_text: str = "text", block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Documents with n_words, n_hit, hit_words (their places), hit_spans (byte ranges, flat) and items (ids of found items)."""
    items = benchmark.select(quoted(item).cast("string").alias("id"), quoted(item_text).cast("string").alias("body"))
    total = items.agg(F.sum(F.octet_length("body")), F.sum(F.octet_length("id"))).first()
    blocks = 1 + (sum(x or 0 for x in total) // block_bytes)
    out, keep = docs, docs.columns if carry is None else carry
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "body"), F.lit(blocks)) == b) if blocks > 1 else items
        found = WindowSet(((r[0], r[1]) for r in part.toLocalIterator()), n)
        known = docs.sparkSession.sparkContext.broadcast(found)
        if b == 0:
            out = map_texts(docs, text, FIELDS, lambda texts, known=known: known.value.scan(texts), keep=[*dict.fromkeys([*keep, text])])
        else:
            out = map_texts(stage(out), text, FIELDS,
                            lambda texts, hits, spans, names, known=known: merged(known.value.scan(texts), hits, spans, names),
                            with_rows=("hit_words", "hit_spans", "items"))
    return out if text in keep else out.drop(text)


def merged(now: list, hits: list, spans: list, names: list) -> list:
    """Results of one block united with those of the blocks before."""
    n_words, _, new_hits, new_spans, new_names = now
    words = [sorted({*a, *b.tolist()}) for a, b in zip(hits, new_hits)]
    ranges = []
    for a, b in zip(spans, new_spans):
        flat: list[int] = []
        for lo, hi in sorted([*zip(a[0::2], a[1::2]), *zip(b[0::2], b[1::2])]):
            if flat and lo <= flat[-1]:
                flat[-1] = max(flat[-1], hi)
            else:
                flat += [lo, hi]
        ranges.append(flat)
    return [n_words, [len(w) for w in words], words, ranges, [sorted({*a, *b}) for a, b in zip(names, new_names)]]


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """Documents without those that hold an item window (remove="documents"), or with the hit words cut out (remove="spans").

    A cut leaves one blank; the scan is not repeated on the rest. Columns stay as they were, n_chars follows the text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row_"), quoted(text).cast("string").alias("body_of_row_"))
    marked = scanned(rows, benchmark, text="body_of_row_", **options)
    if remove == "documents":
        return marked.where("n_hit = 0").select("row_.*")
    cut = map_texts(marked, "body_of_row_", [T.StructField("cut_text_", T.StringType())], without, with_rows=("hit_spans",))
    own = {text: F.col("cut_text_"), "n_chars": F.length("cut_text_").cast("long")}
    field = lambda c: F.col("row_")[c]
    return cut.select(*[(F.when(F.col("n_hit") > 0, own[c]).otherwise(field(c)) if c in own else field(c)).alias(c) for c in docs.columns])


def without(texts: list[bytes | None], spans: list) -> list:
    out = []
    for t, flat in zip(texts, spans):
        t, parts, at = t or b"", [], 0
        for lo, hi in zip(flat[0::2], flat[1::2]):
            parts.append(t[at:lo].rstrip(b" "))
            at = hi
        out.append(b" ".join([*parts, t[at:].lstrip(b" ") if parts else t]).decode(errors="replace"))
    return [out]
