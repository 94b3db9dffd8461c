"""Repair of the turn structure of conversations by weighted CYK parsing over spans of rows.

A repaired conversation is empty, or pairs of a user's and an assistant's turn, behind a system turn or not. Rows may be kept (0), given
the role user or assistant (1), or deleted (2, which blank and repeated rows must be); a user's or an assistant's turn without text may be
inserted anywhere (5), and a truncated row that is not deleted costs 5 more. The cheapest edits are found, and among these the ones whose
initials (Delete, Insert, Keep, Rerole, in order) make the least string in ASCII.

The grammar is in Chomsky normal form. Its nonterminals are all the kinds of stretches that a repaired conversation can be cut
into, so what is known of two adjacent spans tells all about both together. A cell is the least (cost, edits) by which a span of rows
becomes a nonterminal. Cells are combined bottom-up by length of span, over all places to cut it, and closed under insertions at both ends.
Of equal cost, no edits are the beginning of others over the same rows (the rest could be insertions only, which cost), so the least
strings of the parts make the least string of the whole. Spans of up to ``BLOCK`` rows are parsed over all cuts; the blocks of a longer
conversation are combined two by two, for which one cut suffices, as every nonterminal is a stretch. Spans that have been seen are remembered.

Rows are ordered by ranges of (conv_id, turn, role, text), so a conversation of any length is sorted in many tasks. What meets in one
task of a conversation is a letter a row, as in its result, and its texts pass through a task one after the other.

Defined cases: null role or text: one space; turns in order, nulls first, then by role and text; repeated rows are rows; null conv_id is
one conversation; a row is blank with no other character than space and \\t..\\r, a duplicate if an earlier row has its role and text,
truncated if its last such character is none of ``.!?`` (the first that holds); a role's initial is its first character, so an empty role has none and
cannot be kept; more gaps than a long holds are the greatest long; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK = 16
#: Stretches of a repaired conversation: nothing, s, u..u, a..a, u..a, a..u, s..u, s..a.
NONE, S, UU, AA, UA, AU, SU, SA = range(8)
KINDS = 8
#: left, right, whole: which two stretches on end make which.
RULES = (
    (UU, AA, UA), (UA, UA, UA), (AA, UU, AU), (AU, AU, AU), (UA, UU, UU), (UU, AU, UU), (AU, AA, AA), (AA, UA, AA),
    (S, UU, SU), (SA, UU, SU), (SU, AU, SU), (S, UA, SA), (SU, AA, SA), (SA, UA, SA),
    (NONE, NONE, NONE), *((NONE, k, k) for k in range(1, KINDS)), *((k, NONE, k) for k in range(1, KINDS)),
)
WHOLE = (NONE, UA, SA)
#: How a row is told to the parser: its initial (o: another), a capital if it is truncated, a dash if it must be deleted.
INITIALS = "sua"

Cell = tuple[int, str]
Cells = tuple[Cell | None, ...]


def _least(*cells: Cell | None) -> Cell | None:
    return min((c for c in cells if c is not None), default=None)


#: What insertions alone make.
INSERTED: Cells = tuple({NONE: (0, ""), UU: (INSERT, "I"), AA: (INSERT, "I"), UA: (2 * INSERT, "II"), AU: (2 * INSERT, "II")}.get(k) for k in range(KINDS))


def _joined(left: Cells, right: Cells, into: list[Cell | None]) -> bool:
    """Puts what left and right make together into the cells; whether a cell became less."""
    changed = False
    for a, b, whole in RULES:
        x, y = left[a], right[b]
        if x is not None and y is not None:
            made = (x[0] + y[0], x[1] + y[1])
            if into[whole] is None or made < into[whole]:
                into[whole] = made
                changed = True
    return changed


def _closed(cells: list[Cell | None]) -> Cells:
    """The cells with what insertions before and after the span make of them."""
    changed = True
    while changed:
        changed = _joined(INSERTED, tuple(cells), cells)
        changed = _joined(tuple(cells), INSERTED, cells) or changed
    return tuple(cells)


@lru_cache(maxsize=1 << 16)
def span(word: str) -> Cells:
    """The cells of a span of at least one row."""
    cells: list[Cell | None] = [None] * KINDS
    if len(word) == 1:
        cells[NONE] = (DELETE, "D")
        if word != "-":
            more = TRUNCATED if word.isupper() else 0
            kept = {"s": S, "u": UU, "a": AA}.get(word.lower())
            for k in (UU, AA):
                cells[k] = (REROLE + more, "R")
            if kept is not None:
                cells[kept] = _least(cells[kept], (more, "K"))
    for k in range(1, len(word)):
        _joined(span(word[:k]), span(word[k:]), cells)
    return _closed(cells)


def cheapest(word: str) -> Cell:
    """The cost and the edits of a whole conversation, a character a row."""
    row = [span(word[i : i + BLOCK]) for i in range(0, len(word), BLOCK)]
    while len(row) > 1:
        above = []
        for i in range(0, len(row) - 1, 2):
            cells: list[Cell | None] = [None] * KINDS
            _joined(row[i], row[i + 1], cells)
            above.append(_closed(cells))
        row = above + row[len(row) & ~1 :]
    return min(c for k in WHOLE if (c := row[0][k]) is not None) if row else (0, "")


def _space(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(" "))


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, at, turn, role, text, key: rows in order of at; key tells role and text."""
    rows = turns.select("conv_id", "turn", _space("role").alias("role"), _space("text").alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    key = F.unhex(F.sha2(F.concat_ws("\n", F.sha2(F.col("role").cast("binary"), 256), "text").cast("binary"), 256))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("at"), "turn", "role", "text", key.alias("key"))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, at, turn, initial, fault (blank, duplicate, truncated or null) of every row of placed()."""
    first = rows.groupBy("conv_id", "key").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    solid = F.rtrim(F.regexp_replace("text", r"[\x20\x09-\x0D]+$", ""))
    own = rows.select("conv_id", "at", "turn", "key", F.substring("role", 1, 1).alias("initial"), (solid == "").alias("blank"), (~F.substr(solid, F.lit(-1)).isin(".", "!", "?")).alias("open"))
    again = own.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    return again.select("conv_id", "at", "turn", "initial", fault.alias("fault"))


PARSED = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ALLOWED = ("su", "ua", "au")


def parsed(found: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of faults()."""
    known = F.col("initial").isin(*INITIALS)
    initial = F.when(known, F.col("initial")).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    wide = lambda c: c.cast("decimal(20,0)")
    gaps = F.coalesce(wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn"), F.lit(0))
    most = F.lit((1 << 63) - 1).cast("decimal(21,0)")
    count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    rows = found.withColumn("pair", F.concat(initial, letter)).groupBy("conv_id").agg(
        F.least(gaps, most).cast("long").alias("gaps"), *[count(f) for f in ("blank", "duplicate", "truncated")], F.array_sort(F.collect_list(F.struct("at", "pair"))).alias("rows")
    )
    letters = lambda k: F.array_join(F.transform("rows", lambda x: F.substring(x["pair"], k, 1)), "")
    words = rows.select("conv_id", "gaps", "blank", "duplicate", "truncated", letters(1).alias("initials"), letters(2).alias("word"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            illegal = [sum(s[i : i + 2] not in ALLOWED for i in range(len(s) - 1)) for s in b.column("initials").to_pylist()]
            cells = [cheapest(w) for w in b.column("word").to_pylist()]
            new = [pa.array(illegal, pa.int64()), pa.array([c for c, _ in cells], pa.int64()), pa.array([a for _, a in cells], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *new], names=[*b.schema.names[:5], "illegal", "cost", "audit"])

    return words.mapInArrow(run, PARSED.format(id=dict(found.dtypes)["conv_id"]))


def repaired(rows: DataFrame, parses: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text: the turns of the repaired conversations, in order within each partition.

    A conversation's edits come before its rows in one sorted stream, so a task holds one conversation's edits and no more than a batch of texts.
    """
    edits = parses.select("conv_id", F.lit(-1).cast("long").alias("at"), "audit", F.lit("").alias("role"), F.lit("").alias("text"))
    texts = rows.select("conv_id", "at", F.lit("").alias("audit"), "role", "text")
    stream = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, i, place, odd, conv = "", 0, 0, 0, None
        for b in batches:
            out: list[tuple] = []

            def inserts() -> None:
                nonlocal i, place
                while i < len(audit) and audit[i] == "I":
                    out.append((conv, place, "I", role_at(), ""))
                    i, place = i + 1, place + 1

            def role_at() -> str:
                return ("user", "assistant")[(place + odd) % 2]

            for conv, at, edits, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):  # noqa: B007
                if at < 0:
                    audit, i, place = edits, 0, 0
                    odd = (len(audit) - audit.count("D")) % 2
                else:
                    if audit[i] != "D":
                        out.append((conv, place, audit[i], role if audit[i] == "K" else role_at(), text))
                        place += 1
                    i += 1
                inserts()
            ids, places, kinds, roles, told = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field("conv_id").type), pa.array(places, pa.int64()), pa.array(kinds, pa.string()), pa.array(roles, pa.string()), pa.array(told, pa.string())],
                names=["conv_id", "place", "edit", "role", "text"],
            )

    return stream.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of each conversation's ``role:text`` lines, of turns in order within each partition as repaired() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, kind = None, None, None
        for b in batches:
            kind, done = b.schema.field("conv_id").type, []
            for conv, place, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    state, last = hashlib.sha256(), conv
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield _hashes(done, kind)
        if state is not None:
            yield _hashes([(last, state.hexdigest())], kind)

    return turns.mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, sha256 string")


def _hashes(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], kind), pa.array([x for _, x in done], pa.string())], names=["conv_id", "sha256"])


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was found of each conversation (parsed()), and the repaired turns (repaired()). Both read tables in the shared folder."""
    scratch = Scratch(turns.sparkSession)
    rows = scratch.save(placed(turns), "placed")
    parses = scratch.save(parsed(faults(rows)), "parsed")
    return parses, repaired(rows, parses)
