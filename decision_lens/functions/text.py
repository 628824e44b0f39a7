"""Text expressions: readability counts, bounded terms, repair of almost-JSON."""

from __future__ import annotations

import json
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

# executors get the helpers below with the job, whether or not they have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: characters outside words, at the end of sentences, vowels -----------------
BLANK, SENTENCE_END, VOWELS = b" \t\n\r", b".!?", b"aeiouyAEIOUY"
#: bytes that are counted at once, and texts that are repaired at once, of a batch of any size
PIECE_BYTES, PIECE_ROWS = 1 << 20, 16
COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("words", "sentences", "vowels")])


def run_counts(texts: pa.Array) -> pa.Array:
    """Runs of word characters, sentence ends and vowels of every text, in one pass over the bytes of a batch, a piece at a time.

    The three classes are ASCII or their complement, so bytes tell the same runs as characters.
    """
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    first = int(offsets[0])
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, dtype=np.uint8)[first:int(offsets[-1])] if body is not None and offsets[-1] > first else np.zeros(0, np.uint8)
    at = offsets - first
    begins = at[:-1][at[:-1] < at[1:]]
    tables, upto = [], np.zeros((len(COUNTS), len(at)), np.int64)
    for chars, inside in ((BLANK, False), (SENTENCE_END, True), (VOWELS, True)):
        table = np.full(256, not inside)
        table[list(chars)] = inside
        tables.append(table)
    for low in range(0, len(data), PIECE_BYTES):
        part = data[low:low + PIECE_BYTES]
        own = begins[np.searchsorted(begins, low):np.searchsorted(begins, low + len(part))] - low
        for table, counted in zip(tables, upto):
            member = table[part]
            start = member.copy()
            start[1:] &= ~member[:-1]
            start[0] &= not (low and table[data[low - 1]])  # a run that goes on from the piece before
            start[own] = member[own]  # no run goes on from the text before
            counted += np.searchsorted(np.flatnonzero(start), at - low)
    return pa.StructArray.from_arrays([pa.array(np.diff(x), pa.int64()) for x in upto], names=COUNTS.names)


def bounded(term: str) -> Column:
    """Pattern for a term that no letter, digit or underscore touches."""
    return F.lit(f"(^|[^\\p{{L}}\\p{{N}}_]){re.escape(term)}($|[^\\p{{L}}\\p{{N}}_])")


def mentions(low: Column, term: str) -> Column:
    """Whether lower-case text holds a lower-case term as a whole; the cheap search goes first."""
    return F.contains(low, F.lit(term)) & F.regexp_like(low, bounded(term))


def with_readability(df: DataFrame, text: str, name: str = "readability") -> DataFrame:
    """Adds Flesch reading ease, its 0-1 score and the Flesch-Kincaid grade; null for blank text.

    Syllables are runs of vowels, at least one per word.
    """
    counts = F.arrow_udf(run_counts, COUNTS)(F.coalesce(F.col(text), F.lit("")))
    counted = df.withColumn("_counts", counts).withColumns({
        "_words": F.col("_counts.words").cast("double"), "_sentences": F.col("_counts.sentences").cast("double"), "_vowels": F.col("_counts.vowels").cast("double")}).drop("_counts")
    per_sentence = F.col("_words") / F.greatest(F.lit(1.0), F.col("_sentences"))
    per_word = F.try_divide(F.greatest(F.col("_words"), F.col("_vowels")), F.col("_words"))
    ease = 206.835 - 1.015 * per_sentence - 84.6 * per_word
    grade = 0.39 * per_sentence + 11.8 * per_word - 15.59
    return counted.withColumn(name, F.when(F.col("_words") > 0, F.struct(
        (F.least(F.lit(100.0), F.greatest(F.lit(0.0), ease)) / 100.0).alias("score"),
        ease.alias("flesch_reading_ease"), grade.alias("flesch_kincaid_grade")))).drop(
        "_words", "_sentences", "_vowels")


# One token per match: a whole string, an unfinished string, a comment, a bare word, or a bracket.
# Strings are taken without steps back: what ends one can't be inside it.
_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|"[^"\\]*+(?:\\.[^"\\]*+)*+\Z|//[^\n]*|#[^\n]*|\bN/A\b|[{}\[\],]', re.S)
_FENCE = re.compile(r"```(?:json)?\s*(\{.*?)\s*```", re.S)
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
# --- fixed values: what tells an explanation in prose: opening, later word, sentences that follow at most
PROSE_CUES = (("we", "declined", 5), ("thank you", "unable", 5), ("hello", "regret", 5), ("", "declined", 3))
DECLINED = "declined"
LONG_QUOTE = 50
MOST_FEATURES = 5

# One token per match, in either kind of quotes: a string that opens after no word and closes before none, one that never closes, a bare word, a mark.
_LOOSE = re.compile(r"""(?<![\w\\])(?P<q>["'])(?P<text>(?:\\.|(?!(?P=q)(?!\w))[^\\])*)(?P<end>(?P=q)|\Z)|(?P<word>\w+)|(?P<mark>[:\[\],{}])""", re.S)
_SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+\Z", re.S)


def _balanced(text: str) -> tuple[str, str]:
    """(first complete object or '', text from the first brace closed where it breaks off)."""
    start = text.find("{")
    if start < 0:
        return "", ""
    stack, unfinished = [], False
    for m in _TOKEN.finditer(text, start):
        t = m.group()
        if t in "{[":
            stack.append("}" if t == "{" else "]")
        elif t in "}]" and stack and stack[-1] == t:
            stack.pop()
            if not stack:
                return text[start:m.end()], text[start:m.end()]
        elif t[0] == '"' and m.end() == len(text) and (len(t) == 1 or t[-1] != '"'):
            unfinished = True
    tail = text[start:].rstrip()
    return "", tail + ('"' if unfinished else "") + "".join(reversed(stack))


def _tidy(text: str, judge: bool) -> str:
    """Trailing commas dropped; for judge output also comments and bare N/A. Strings stay untouched."""
    out, last, comma = [], 0, None
    for m in _TOKEN.finditer(text):
        gap, t = text[last:m.start()], m.group()
        if gap.strip():
            comma = None
        out.append(gap)
        last = m.end()
        if t[0] in "/#":
            out.append("" if judge else t)
            continue
        if t in "}]" and comma is not None:
            out[comma] = ""
        comma = len(out) if t == "," else None
        out.append('"N/A"' if t == "N/A" and judge else t)
    return "".join(out) + text[last:]


def _plain(text: str) -> str:
    """A string's content without its escapes."""
    try:
        return json.loads('"' + text.replace("\\'", "'").replace('\\"', '"').replace('"', '\\"') + '"', strict=False)
    except ValueError:
        return text


def _tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) with kinds string, open (a string that never closes), word and mark."""
    out = []
    for m in _LOOSE.finditer(text):
        if m["q"]:
            out.append(("string" if m["end"] else "open", m["text"]))
        else:
            out.append(("word", m["word"]) if m["word"] else ("mark", m["mark"]))
    return out


def _after(tokens: list, name: str) -> int:
    """Place of the token behind ``name:``, or -1."""
    for i, (kind, text) in enumerate(tokens[:-2]):
        if text == name and kind != "mark" and tokens[i + 1] == ("mark", ":"):
            return i + 2
    return -1


def _prose(text: str) -> str | None:
    """The first passage of sentences that announces a decision, by PROSE_CUES."""
    sentences = [s for s in _SENTENCE.findall(text) if s.strip()]
    for opening, later, more in PROSE_CUES:
        for i, s in enumerate(sentences):
            low = s.lower()
            start = re.search(rf"\b{opening}\b", low) if opening else re.search(r"\S", low)
            if start and re.search(later, low[start.start():]) and s.rstrip()[-1:] in ".!?":
                passage = s[start.start():] + "".join(t for t in sentences[i + 1:i + 1 + more] if t.rstrip()[-1:] in ".!?")
                return re.sub(r"\s+", " ", passage).strip()
    return None


def _fields(text: str) -> tuple[str | None, list[str] | None]:
    """(explanation, features) of a text that is no JSON: named fields in any quotes, a quoted decision, then prose."""
    tokens = _tokens(text)
    at = _after(tokens, "consumer_explanation")
    value = _plain(tokens[at][1]) if at >= 0 and tokens[at][0] in ("string", "open") else None
    strings = [t for kind, t in tokens if kind == "string"]
    if not value:
        value = next((_plain(t) for t in strings if DECLINED in t), None) or _prose(text) or next((_plain(t) for t in strings if len(t) >= LONG_QUOTE), None)
    if not value:
        return None, None
    at, found = _after(tokens, "top_features"), []
    if at >= 0 and tokens[at] == ("mark", "["):
        for kind, t in tokens[at + 1:]:
            if (kind, t) == ("mark", "]"):
                break
            if kind == "string":
                found.append(_plain(t))
    return value, found[:MOST_FEATURES]


def _is_response(d) -> bool:
    analysis = d.get("analysis") if isinstance(d, dict) else None
    return (isinstance(analysis, dict) and isinstance(d.get("consumer_explanation"), str)
            and isinstance(analysis.get("top_features"), list))


def _is_judgement(d) -> bool:
    parts = [d.get(k) for k in ("cemat_evaluation", "regulatory_compliance", "counterfactual_extraction")] \
        if isinstance(d, dict) else []
    return (len(parts) == 3 and all(isinstance(p, dict) for p in parts)
            and isinstance(parts[0].get("understandability_items"), dict)
            and isinstance(parts[0].get("actionability_items"), dict) and isinstance(parts[2].get("changes"), list))


def _candidates(text: str, judge: bool):
    """(stage, text) in the order in which repairs are tried."""
    fence = _FENCE.search(text)
    if fence:
        text = fence.group(1)
        yield "fenced", text
    whole, closed = _balanced(text)
    yield "embedded", whole
    plain = _CONTROL.sub(" ", whole)
    yield "control_chars", plain
    if judge:  # a comment or a bare word may hide the end of the object: clear them and scan again
        start = text.find("{")
        whole, closed = _balanced(_tidy(text[start:], True) if start >= 0 else "")
        plain = _CONTROL.sub(" ", whole)
    yield "tidied", _tidy(plain, judge)
    yield "closed", _tidy(_CONTROL.sub(" ", closed), judge)


def _repair(text: str | None, judge: bool) -> tuple:
    """(stage, valid JSON, explanation, features) of one broken text; all null if nothing helps."""
    if text is None:
        return None, None, None, None
    accept = _is_judgement if judge else _is_response
    for stage, candidate in _candidates(text, judge):
        try:
            if candidate and accept(json.loads(candidate)):
                return stage, candidate, None, None
        except ValueError:
            continue
    value, features = (None, None) if judge else _fields(text)
    return ("pattern" if value is not None else None), None, value, features


_REPAIRED = T.StructType([
    T.StructField("stage", T.StringType()), T.StructField("json", T.StringType()),
    T.StructField("explanation", T.StringType()), T.StructField("features", T.ArrayType(T.StringType()))])


def _repaired(texts: pa.Array, judge: bool) -> pa.Array:
    """Repairs of a batch, some texts at a time, so that only their packed results are held besides the batch."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
    parts = []
    for at in range(0, max(1, len(texts)), PIECE_ROWS):
        rows = [_repair(t, judge) for t in texts.slice(at, PIECE_ROWS).to_pylist()]
        parts.append(pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=_REPAIRED.names))
    return pa.concat_arrays(parts)


@F.arrow_udf(_REPAIRED)
def repair_response(texts: pa.Array) -> pa.Array:
    """Repaired response text; feed null for texts that already parsed, so only broken ones cost Python."""
    return _repaired(texts, False)


@F.arrow_udf(_REPAIRED)
def repair_judgement(texts: pa.Array) -> pa.Array:
    return _repaired(texts, True)
