r"""Repair of conversation structure: turns are aligned to the grammar (s?(ua)+)? at the least cost.

A conversation's rows are put in order and judged: the first of these faults counts: blank (no visible character), duplicate (role
and text stand earlier in the conversation), truncated (the last visible character is none of . ! ?). Edits: Keep (0), Rerole to
user or assistant (2), Delete (3, the only edit for blank and duplicate rows), Insert a user or assistant turn without text (2);
a truncated row that stays costs 1 more. Among the cheapest audits (the initials of the edits in order) the least one is taken.

Method: the grammar has one string of each feasible length. Rows are aligned to all of them by Wagner-Fischer; written from the
end, these strings share their suffixes, so cell (row, symbols left) is the same for every length and one table serves them all.
A plain left-to-right repair gives the incumbent cost; Ukkonen bands keep the cells that may lie on a path of that cost. Every
length of the least cost is traced back and their audits are compared.

Spark orders rows in blocks of turn numbers, finds duplicates by digests with pre-aggregation, and sends one character a row to the
alignment; texts stay in the JVM and meet the edits again in a join. A conversation is one unit of the alignment: time grows with
its length times the band, memory is bounded by keeping every n-th row of the table (about the square root) and computing the
rows between again.

Defined cases: a null role or text is one blank; rows without a conversation form one with a null id; null turns come first; rows of
one turn are ordered by role and text; roles count by their first character, so an unknown one can only be reroled or deleted; an empty
table gives empty results; very long texts are never cut; further columns are not carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from decision_lens.llm.textkit import quoted
from decision_lens.session import stage

DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
TURNS_A_BLOCK = 256
CELLS = 4 << 20
FAR = 1 << 28
FAULTS = ("", "blank", "duplicate", "truncated")
INITIALS = "sua"
VISIBLE = r"[^\x20\x09-\x0D]"


class Suffixes:
    """Costs of aligning rows i.. to the last r symbols of ..uaua, in bands that hold every path of at most ``limit``."""

    def __init__(self, kinds: list[int], faults: list[int], limit: int):
        n = len(kinds)
        self.kinds, self.forced = kinds, [f in (1, 2) for f in faults]
        self.extra = [CUT if f == 3 else 0 for f in faults]
        base = sum(DELETE if f else e for f, e in zip(self.forced, self.extra))
        self.half = max(0, (limit - base) // 2)
        self.low = [0] * (n + 1)
        self.low[n] = -self.half
        for i in range(n - 1, -1, -1):
            self.low[i] = self.low[i + 1] + (not self.forced[i])
        self.width = 2 * self.half + 1
        self.steps = 2 * np.arange(self.width)
        self.every = 1 if (n + 1) * self.width <= CELLS else max(1, isqrt(n))
        self.rows: dict[int, np.ndarray] = {}
        self.last = np.full(self.width, FAR)
        self.last[self.half] = 0
        self.last = self._inserted(self.last, n)

    def _inserted(self, row: np.ndarray, i: int) -> np.ndarray:
        if self.low[i] < 0:
            row[:-self.low[i]] = FAR
        return np.minimum.accumulate(row - self.steps) + self.steps

    def before(self, i: int, after: np.ndarray) -> np.ndarray:
        """Row i from row i + 1."""
        if self.forced[i]:
            return self._inserted(after + DELETE, i)
        row = np.full(self.width, FAR)
        row[:-1] = after[1:] + DELETE
        at = (np.arange(self.width) + self.low[i]) % 2  # u where an even number of symbols is left
        kept = after + np.where(at == self.kinds[i] - 1, 0, REROLE) + self.extra[i] if self.kinds[i] in (1, 2) else after + REROLE + self.extra[i]
        return self._inserted(np.minimum(row, kept), i)

    def get(self, row: np.ndarray, i: int, r: int) -> int:
        k = r - self.low[i]
        return int(row[k]) if r >= 0 and 0 <= k < self.width else FAR

    def even(self, row: np.ndarray, i: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        r = np.arange(self.low[i], self.low[i] + self.width)
        at = (r >= least) & (r % 2 == 0)
        return r[at], row[at]


def incumbent(kinds: list[int], faults: list[int]) -> int:
    """Cost of a plain repair from left to right, or of deleting everything."""
    cost, want, first, paired = 0, 1, True, False
    for kind, fault in zip(kinds, faults):
        if fault in (1, 2):
            cost += DELETE
            continue
        cost += CUT * (fault == 3)
        if kind == 0 and first:
            want = 1
        elif kind == 3 - want:  # the other one of u and a: the missing turn goes in between
            cost, paired = cost + INSERT, True
        else:
            cost += REROLE * (kind != want)
            want, paired = 3 - want, True
        first = False
    if not first:
        cost += INSERT * (want == 2) if paired else 2 * INSERT
    return min(cost, DELETE * len(kinds))


@lru_cache(1 << 14)
def aligned(kinds: tuple[int, ...], faults: tuple[int, ...]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; kinds index INITIALS (3: another), faults index FAULTS."""
    kinds, faults = list(kinds), list(faults)
    n = len(kinds)
    if not n:
        return 0, ""
    table = Suffixes(kinds, faults, incumbent(kinds, faults))
    row = table.rows[n] = table.last
    system: dict[int, tuple[int, int]] = {}  # symbols after the system turn -> cost, its row
    for i in range(n - 1, -1, -1):
        if kinds[i] == 0 and not table.forced[i]:
            for r, c in zip(*(x.tolist() for x in table.even(row, i + 1, 2))):
                c += DELETE * i + table.extra[i]
                if c < system.get(r, (FAR,))[0]:
                    system[r] = (c, i)
        row = table.before(i, row)
        if i % table.every == 0:
            table.rows[i] = row
    lengths, costs = table.even(row, 0, 0)
    best = min(int(costs.min(initial=FAR)), min((c for c, _ in system.values()), default=FAR))
    walks = [(0, int(r), "") for r, c in zip(lengths, costs) if c == best]
    walks += [(i + 1, r, "D" * i + "K") for r, (c, i) in system.items() if c == best]
    return best, min(traced(table, walks))


def traced(table: Suffixes, walks: list[tuple[int, int, str]]) -> Iterator[str]:
    """Least audits of the given starts; between kept rows the table is computed again, once for all walks."""
    n = len(table.kinds)
    walks = [[i, r, [head]] for i, r, head in walks]
    for start in range(0, n + 1, table.every):
        end = min(start + table.every, n)
        block = {end: table.rows.get(end, table.last)}
        for i in range(end - 1, start - 1, -1):
            block[i] = table.rows[i] if i in table.rows else table.before(i, block[i + 1])
        for w in walks:
            i, r, said = w
            while i < end or (i == n == end and r > 0):
                here = table.get(block[i], i, r)
                if i < n and table.get(block[i + 1], i + 1, r) + DELETE == here:
                    said.append("D")
                    i += 1
                elif r and table.get(block[i], i, r - 1) + INSERT == here:
                    said.append("I")
                    r -= 1
                else:
                    said.append("K" if table.kinds[i] == 1 + r % 2 else "R")
                    i, r = i + 1, r - 1
            w[0], w[1] = i, r
    return ("".join(w[2]) for w in walks)


def edits(audit: str) -> tuple[list[int | None], list[str | None]]:
    """For every turn after the repair: the row that it comes from (from 1) and its new role, null where nothing is new."""
    n = len(audit) - audit.count("D")
    source, roles, at, left = [], [], 0, n
    for op in audit:
        at += op != "I"
        if op == "D":
            continue
        role = "assistant" if left % 2 else "user"
        source.append(None if op == "I" else at)
        roles.append(None if op == "K" else role)
        left -= 1
    return source, roles


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with reproducible faults: crc32 of `conv:turn` mod 20 drops (0), empties (1), strips .!? (2), repeats (3) or reroles (4)."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(quoted(conv).cast("string"), blank), F.lit(":"), F.coalesce(quoted(turn).cast("string"), blank))
    t = rows.select(quoted(conv).alias("conv_id"), quoted(turn).cast("long").alias("turn"), F.coalesce(quoted(role).cast("string"), blank).alias("role"),
                    F.coalesce(quoted(text).cast("string"), blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault")).where("fault <> 0")
    said = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return t.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), again.alias("copy")).drop("copy")


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def judged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows in order: conv_id, place (from 1), turn, role, text, fault (place in FAULTS), kind (place in INITIALS, else 3). Staged."""
    blank = F.lit(" ")
    t = rows.select(quoted(conv).alias("conv_id"), quoted(turn).cast("long").alias("turn"), F.coalesce(quoted(role).cast("string"), blank).alias("role"),
                    F.coalesce(quoted(text).cast("string"), blank).alias("text"))
    t = t.withColumn("block", F.floor(F.col("turn") / TURNS_A_BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    t = t.withColumn("at", F.row_number().over(inside))
    sizes = t.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block"))) - F.col("n")
    sizes = sizes.select(F.col("conv_id").alias("c_"), F.col("block").alias("b_"), upto.alias("before"))
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    t = t.join(sizes, same("conv_id", "c_") & same("block", "b_")).select(
        "conv_id", (F.col("before") + F.col("at")).cast("int").alias("place"), "turn", "role", "text",
        F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)).alias("kind"),
        F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3).alias("fault"),
        F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("digest"))
    t = stage(t.withColumn("kind", F.when(F.length(F.substring("role", 1, 1)) == 1, F.col("kind") - 1).otherwise(3)))
    # where role and text of a conversation stand first, for those that stand again
    again = t.where("fault <> 1").groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("conv_id").alias("c_"), F.col("digest").alias("d_"), "first")
    t = t.join(again, same("conv_id", "c_") & (F.col("digest") == F.col("d_")), "left")
    fault = F.when((F.col("fault") != 1) & (F.col("place") > F.col("first")), 2).otherwise(F.col("fault"))
    return t.select("conv_id", "place", "turn", "role", "text", fault.alias("fault"), "kind")


REPORT = "conv_id {0}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, source array<int>, roles array<string>"


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation of judged rows: counts of faults, cost, audit, and for each repaired turn its row and new role."""
    letter = F.char((65 + F.col("kind") * 4 + F.col("fault")).cast("long"))
    codes = turns.select("conv_id", "place", letter.alias("code")).groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "").alias("codes"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = []
            for text in batch.column(1).to_pylist():
                code = np.frombuffer(text.encode(), dtype=np.uint8).astype(int) - 65
                kinds, faults = code // 4, code % 4
                legal = (kinds[:-1] == 0) & (kinds[1:] == 1) | (kinds[:-1] == 1) & (kinds[1:] == 2) | (kinds[:-1] == 2) & (kinds[1:] == 1)
                cost, audit = aligned(tuple(kinds.tolist()), tuple(faults.tolist()))
                made.append((*[int((faults == f).sum()) for f in (1, 2, 3)], int((~legal).sum()), cost, audit, *edits(audit)))
            kinds_of = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())]
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate(kinds_of)]
            names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit", "source", "roles"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv_id", *names])

    return stage(codes.mapInArrow(run, REPORT.format(kind)))


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Turns after the repair: conv_id, at (from 0), row (place of the row it comes from, null if inserted), role, text."""
    each = found.select("conv_id", F.posexplode(F.arrays_zip("source", "roles")).alias("at", "x")).select(
        F.col("conv_id").alias("c_"), "at", F.col("x.source").alias("row"), F.col("x.roles").alias("new"))
    kept = each.where("row is not null").join(turns, same("c_", "conv_id") & (F.col("row") == F.col("place")))
    put = each.where("row is null").select(F.col("c_").alias("conv_id"), "at", "row", F.col("new").alias("role"), F.lit("").alias("text"))
    return kept.select(F.col("c_").alias("conv_id"), "at", "row", F.coalesce("new", "role").alias("role"), "text").unionByName(put)


def gaps(turns: DataFrame) -> DataFrame:
    """Turn numbers that are missing between a conversation's first and last; pre-aggregated by blocks of turns."""
    block = F.floor(F.col("turn") / TURNS_A_BLOCK).alias("block")
    b = turns.where("turn is not null").select("conv_id", "turn", block).distinct().groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    return b.groupBy("conv_id").agg((F.max("hi") - F.min("lo") + 1 - F.sum("n")).alias("gaps"))


def digests(all_rows: DataFrame, turns: DataFrame, found: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation of the whole table, with the digest of its repaired text; those without rows have zeros."""
    lines = repaired(turns, found).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "at", F.concat("role", F.lit(":"), "text").alias("line")))), lambda x: x["line"]), "\n").alias("said"))
    lines = lines.select(F.col("conv_id").alias("l_"), F.sha2(F.col("said").cast("binary"), 256).alias("repaired_sha256"))
    holes = gaps(turns).withColumnRenamed("conv_id", "g_")
    out = all_rows.select(quoted(conv).alias("conv_id")).distinct().join(found.drop("source", "roles").withColumnRenamed("conv_id", "f_"), same("conv_id", "f_"), "left")
    out = out.join(holes, same("conv_id", "g_"), "left").join(lines, same("conv_id", "l_"), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
