"""Large single JSON documents read by many tasks, and documents written one per part file.

A document is read as text cut at a character that JSON never escapes (a comma or a closing brace), so Spark splits the file by
bytes. What a split means depends on the text before it: whether it starts inside a string, how deep it is nested, and which member of the
document it belongs to. The number of plain quotes modulo 2 gives the first; with both possible starts tried, the second is
a running sum over splits; the third is the last member that an earlier split opened. Two passes over the text suffice: one for
the sums (a row per split), one that cuts elements. An element that lies in several splits comes back as pieces, which are joined by
running counts. Nothing but a row or two for each split is ordered.

Elements have a total order (path, block, place): later files, and later places of a file, come later.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

QUOTE, BACKSLASH, COMMA, COLON = (ord(c) for c in '"\\,:')
BLANKS = b" \t\r\n"
MOST_SPLITS = 500_000


def fragments(spark: SparkSession, path: str, cut: str) -> DataFrame:
    return spark.read.option("lineSep", cut).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def runs(batches, cut: bytes):
    """(path, block, text with its cuts) of consecutive rows of one split."""
    for batch in batches:
        path, block = batch.column(0), np.asarray(batch.column(1))
        names = np.asarray(path.dictionary_encode().indices)
        borders = np.flatnonzero((block[1:] != block[:-1]) | (names[1:] != names[:-1])) + 1 if len(block) else []
        for a, b in zip([0, *borders], [*borders, len(block)]):
            if b > a:
                values = batch.column(2).slice(a, b - a).to_pylist()
                yield path[int(a)].as_py(), int(block[a]), cut.join([*values, b""])


def quotes_of(data: np.ndarray) -> np.ndarray:
    """True for quotes that open or close a string: those after an even number of backslashes."""
    quote = data == QUOTE
    back = data == BACKSLASH
    if not back.any():
        return quote
    place = np.arange(len(data))
    other = np.maximum.accumulate(np.where(back, -1, place))  # last character before each place that is no backslash
    before = np.concatenate([[0], np.where(back, place - other, 0)[:-1]])
    return quote & (before % 2 == 0)


def nesting(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(inside a string, change of depth) of every byte, when the first one is inside a string or not."""
    toggles = np.cumsum(quotes_of(data))
    within = (toggles + inside) % 2 == 1
    change = np.zeros(len(data), dtype=np.int64)
    for c, by in (("{", 1), ("[", 1), ("}", -1), ("]", -1)):
        change[(data == ord(c)) & ~within] = by
    return within, change


SPLIT_DDL = "path string, block long, odd int, out_sum long, in_sum long, head string"


def split_sums(parts: DataFrame, cut: str) -> DataFrame:
    """A row per split: parity of its quotes, and its change of depth if it starts outside or inside a string."""
    mark = cut.encode()

    def run(batches):
        found: dict[tuple, list] = {}
        for path, block, text in runs(batches, mark):
            data = np.frombuffer(text, dtype=np.uint8)
            odd, out_sum, in_sum, head = found.setdefault((path, block), [0, 0, 0, ""])
            sums = [int(nesting(data, bool(start ^ odd))[1].sum()) for start in (0, 1)]
            found[path, block] = [odd ^ int(quotes_of(data).sum() % 2), out_sum + sums[0], in_sum + sums[1], head or text[:64].lstrip(BLANKS + b"\xef\xbb\xbf")[:1].decode(errors="replace")]
        rows = [(p, b, *v) for (p, b), v in found.items()]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "block", "odd", "out_sum", "in_sum", "head"])

    return parts.mapInArrow(run, SPLIT_DDL)


def starts(sums: DataFrame) -> DataFrame:
    """(path, block, inside, depth, listed): what every split starts with, and whether its document is a list."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    step = F.when(F.col("inside") == 1, F.col("in_sum")).otherwise(F.col("out_sum"))
    first = F.first("head").over(Window.partitionBy("path").orderBy("block"))
    return known.withColumn("step", step).select("path", "block", F.col("inside").cast("int").alias("inside"),
                                                 F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth"), (first == "[").alias("listed"))


class Cutter:
    """Cuts the elements of a split; keeps what is open from one batch to the next."""

    def __init__(self, inside: bool, depth: int, listed: bool):
        self.inside, self.depth, self.level = inside, depth, 1 if listed else 2
        self.open = depth >= self.level  # an element of an earlier split goes on
        self.member = "" if listed else None  # not known yet
        self.begun, self.text, self.rest = False, b"", b""

    def feed(self, text: bytes):
        """Finished elements as (member, starts here, ends here, text)."""
        data = np.frombuffer(text, dtype=np.uint8)
        within, change = nesting(data, self.inside)
        after = self.depth + np.cumsum(change)
        before = after - change
        marks = np.flatnonzero(~within & (((data == COMMA) & (after == self.level)) | ((change == 1) & (after == self.level)) | ((change == -1) & (before == self.level))))
        at = 0
        for m in marks.tolist():
            part = text[at:m]
            if change[m] == 1:  # a member opens; its name stands before the colon
                if self.level == 2:
                    self.member = self.name(self.rest + part)
                self.rest, self.open, self.begun, self.text = b"", True, True, b""
            else:
                self.text += part
                if self.text.strip(BLANKS) or not self.begun:
                    yield self.member, self.begun, True, self.text
                self.text, self.begun = b"", True
                self.open = change[m] != -1
            at = m + 1
        if self.open:
            self.text += text[at:]
        elif self.level == 2:
            self.rest = (self.rest + text[at:])[-4096:]
        self.inside, self.depth = bool((self.inside + int(quotes_of(data).sum())) % 2), int(after[-1]) if len(after) else self.depth

    def left(self):
        if self.open:  # also without text yet: the next split must know that an element has begun
            yield self.member, self.begun, False, self.text

    @staticmethod
    def name(text: bytes) -> str:
        head = text.rstrip(BLANKS)
        if not head.endswith(b":"):
            return ""
        head = head[:-1].rstrip(BLANKS)
        data = np.frombuffer(head, dtype=np.uint8)
        q = np.flatnonzero(quotes_of(data))
        return head[q[-2] + 1:q[-1]].decode(errors="replace") if len(q) >= 2 else ""


PIECE_DDL = "path string, block long, place long, member string, begins boolean, ends boolean, piece binary, last string"


def pieces(parts: DataFrame, at: DataFrame, cut: str) -> DataFrame:
    """Elements and parts of elements of every split; ``last`` names the member that is open at its end, if the split knows."""
    mark = cut.encode()
    names = ["path", "block", "place", "member", "begins", "ends", "piece", "last"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.binary(), pa.string())

    def run(batches):
        now, cutter, place = None, None, 0

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        def end():
            # the last row of a split always names its member, so that later splits can ask for it
            rows = [(*now, place + i, *x, cutter.member) for i, x in enumerate(cutter.left())]
            return rows or [(*now, place, cutter.member, True, True, None, cutter.member)]

        for batch in batches:
            entry = {(p, b): (i, d, s) for p, b, i, d, s in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5)))}
            for path, block, text in runs([batch.select([0, 1, 2])], mark):
                if (path, block) != now:
                    if cutter is not None:
                        yield table(end())
                    now, place = (path, block), 0
                    inside, depth, listed = entry[now]
                    cutter = Cutter(bool(inside), depth, listed)
                rows = []
                for found in cutter.feed(text):
                    rows.append((*now, place, *found, None))
                    place += 1
                if rows:
                    yield table(rows)
        if cutter is not None:
            yield table(end())

    placed = parts.join(F.broadcast(at), ["path", "block"]).select("path", "block", "value", "inside", "depth", "listed")
    return placed.mapInArrow(run, PIECE_DDL)


def elements(spark: SparkSession, path: str, cut: str = "}", keep: str | None = None) -> DataFrame:
    """(source_order, member, value): every element of the lists and objects right below the top of the documents of a path.

    An element of an object is ``"name": value``. A document that is a list has one member without a name. ``keep`` selects members
    by a name; the elements of a bare list always stay.
    """
    from decision_lens.session import stage
    parts = fragments(spark, path, cut)
    at = stage(starts(split_sums(parts, cut)))
    if at.count() > MOST_SPLITS:  # a row per split is broadcast; at the usual 128 MB a split this is some 60 TB
        raise ValueError("too many splits; raise spark.sql.files.maxPartitionBytes")
    found = stage(pieces(parts, at, cut))
    tails = found.where("last is not null").groupBy("path", "block").agg(F.max("last").alias("last"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    open_at = at.select("path", "block").join(tails, ["path", "block"], "left").withColumn("earlier", F.last("last", ignorenulls=True).over(before))
    rows = found.where("piece is not null").join(F.broadcast(open_at.drop("last")), ["path", "block"]).withColumn(
        "member", F.coalesce("member", "earlier", F.lit(""))).drop("earlier", "last")
    order = F.struct("path", "block", "place")
    whole = rows.where("begins and ends").select(order.alias("source_order"), "member", F.decode("piece", "utf-8").alias("value"))
    broken = rows.where("not (begins and ends)")
    number = F.sum(F.col("begins").cast("long")).over(Window.partitionBy("path").orderBy("block", "place"))
    glued = broken.withColumn("number", number).groupBy("path", "number").agg(
        F.min(order).alias("source_order"), F.min_by("member", order).alias("member"), F.array_sort(F.collect_list(F.struct(order.alias("o"), F.hex("piece").alias("h")))).alias("ps"))
    glued = glued.select("source_order", "member", F.decode(F.unhex(F.array_join(F.transform("ps", lambda p: p["h"]), "")), "utf-8").alias("value"))
    out = whole.unionByName(glued).where(F.trim(F.translate("value", "\t\r\n", "   ")) != "")
    return out if keep is None else out.where(F.col("member").isin(keep, ""))


def entry_record(value: Column, record: str) -> Column:
    """Struct (key, value) of an element: a named one, or a record alone (null key)."""
    named = F.ltrim(F.translate(value, "\t\r\n", "   ")).startswith('"')
    as_map = F.map_entries(F.from_json(F.concat(F.lit("{"), value, F.lit("}")), f"map<string,{record}>"))
    alone = F.struct(F.lit(None).cast("string").alias("key"), F.from_json(value, record).alias("value"))
    return F.when(named, F.get(as_map, F.lit(0))).otherwise(alone)


def write_documents(rows: DataFrame, path: str, member: str | None, value: str = "value", key: str | None = None) -> None:
    """One JSON document for each part: a bare list (no member), an object with a list, or with an object keyed by ``key``."""
    entry = F.col(value) if key is None else F.concat(F.to_json(F.array(F.col(key))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(key)))) - 2), F.lit(": "), F.col(value))
    opened, closed = ("[", "]") if member is None else ('{"metadata": {"n": 1}, "%s": %s' % (member, "{" if key else "["), "}}" if key else "]}")

    def run(batches):
        first = True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                text = (opened if first else ", ") + ", ".join(lines)
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([(opened if first else "") + closed])], names=["value"])

    rows.select(entry.alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)
