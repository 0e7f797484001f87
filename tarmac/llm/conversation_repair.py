"""Conversation structure repair: Wagner-Fischer alignment with the alternating grammar.

A conversation should read ``(s?(ua)+)?`` in its roles' initials: perhaps a
system turn, then user and assistant in turn, ending with the assistant. The
edits that get it there at least cost are found by aligning its turns with the
alternating string of each feasible length (each length whose least possible
cost does not exceed the incumbent's). Each alignment is a Wagner-Fischer
table cut to Ukkonen's band: cells from which the incumbent's cost cannot be
kept are left out. Among alignments of equal cost the backtraced audits
(the edits' initials, in order) are compared and the ASCII-least one stays.

A conversation may hold any share of all rows, so it is aligned in pieces:

* turns are range-partitioned and sorted by (conv_id, turn, ...), numbered,
  and coded by one letter each (role, and its first fault);
* up to 1,024 successive letters make a segment, aligned by itself from
  every state (what the last kept turn was) to every state, in pieces of
  ``PIECE`` turns;
* the segments' tables, not the turns, meet per conversation, where the
  cheapest chain of states is picked.

An insert always belongs to the turn that follows it (or to the end of the
conversation), so two audits of the same turns never are prefixes of each
other, and the least audit of the whole is made of least audits of its parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import join_small, shuffle_partitions, stage

#: Edits and their costs; a truncated turn that is not deleted costs one more.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Bits of a turn's number within its segment, turns aligned in one table, and tables kept in a worker.
SEGMENT_BITS, PIECE, TABLES_KEPT = 10, 32, 50_000
#: Characters of a conversation's repaired text held at once.
TEXT_CHARS = 1 << 20
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)

BLANK_RE, LAST_RE = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*$"
_WRITTEN = {"u": "user", "a": "assistant"}
_STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NO_COST = 1 << 60

Found = tuple[int, str]


# -- one alignment ---------------------------------------------------------------

def _gap(rows: int, letters: int) -> int:
    return INSERT * (letters - rows) if letters > rows else DELETE * (rows - letters)


def align(roles: str, fixed: list[bool], cut: list[bool], target: str, limit: int) -> Found | None:
    """Cost and ASCII-least audit of turning ``roles`` into ``target``, or None
    if it costs more than ``limit``. ``fixed`` turns must go, ``cut`` ones are
    truncated. Nothing is inserted after the last turn."""
    b, n = len(roles), len(target)
    gone = np.concatenate(([0], np.cumsum(fixed))).tolist()
    left, away = b - gone[b], DELETE * gone[b]
    cost = [[NO_COST] * (n + 2) for _ in range(b + 2)]
    for i in range(b, -1, -1):
        row, below, done = cost[i], cost[i + 1], i - gone[i]
        for j in range(n, -1, -1):
            if away + _gap(done, j) + _gap(left - done, n - j) > limit:
                continue
            if i == b:
                row[j] = 0 if j == n else NO_COST
                continue
            best = DELETE + below[j]
            if j < n:
                if target[j] != "s" and INSERT + row[j + 1] < best:
                    best = INSERT + row[j + 1]
                if not fixed[i] and (roles[i] == target[j] or target[j] != "s"):
                    step = below[j + 1] + (KEEP if roles[i] == target[j] else REROLE) + (CUT if cut[i] else 0)
                    if step < best:
                        best = step
            row[j] = best
    if cost[0][0] > limit:
        return None
    i = j = 0
    audit = []
    while i < b:
        now = cost[i][j]
        if DELETE + cost[i + 1][j] == now:
            audit.append("D")
            i += 1
        elif j < n and target[j] != "s" and INSERT + cost[i][j + 1] == now:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if roles[i] == target[j] else "R")
            i, j = i + 1, j + 1
    return cost[0][0], "".join(audit)


def _family(roles: str, fixed: list[bool], cut: list[bool], lead: str, first: str, least: int, limit: int, best: Found | None = None) -> Found | None:
    """The best alignment with ``lead`` and an alternating string from ``first``
    on of ``least``, least + 2, ... letters: as cheap as ``best``, or at most ``limit``."""
    gone = sum(fixed)
    rows, pair = len(roles) - gone, first + ("a" if first == "u" else "u")
    lengths = range(least, max(least, rows + limit // INSERT) + 1, 2)
    for n in sorted(lengths, key=lambda n: (_gap(rows, n + len(lead)), n)):
        if DELETE * gone + _gap(rows, n + len(lead)) > limit:
            break
        if found := align(roles, fixed, cut, lead + (pair * (n // 2 + 1))[:n], limit):
            best = min(best, found) if best else found
            limit = min(limit, best[0])
    return best


def _incumbent(roles: str, fixed: list[bool], cut: list[bool], first: str, least: int) -> int:
    """The cost of one alignment of the family: wrong turns reroled where they stand, the end cut off or turns put in front."""
    kept = [r for r, f in zip(roles, fixed) if not f]
    n = max(least, len(kept) - (len(kept) - least) % 2)
    other = "a" if first == "u" else "u"
    front = max(0, n - len(kept))
    wrong = sum(r != (first if (k + front) % 2 == 0 else other) for k, r in enumerate(kept[:n]))
    return DELETE * sum(fixed) + REROLE * wrong + CUT * sum(cut) + _gap(len(kept), n)


def table(codes: str) -> list[Found | None]:
    """The best (cost, audit) that leads from state x to state y, at 4 * x + y, over the turns ``codes``."""
    roles = codes.translate(_ROLES)
    fixed, cut = [c in "SUAX" for c in codes], [c in "0123" for c in codes]
    best = {(first, least): _family(roles, fixed, cut, "", first, least, _incumbent(roles, fixed, cut, first, least)) for first in "ua" for least in (1, 2)}
    none = (DELETE * len(codes), "D" * len(codes))  # no letter: the state stays
    out: list[Found | None] = [None] * 16
    for x in (START, SYSTEM, ASSISTANT):
        out[5 * x] = none
        out[4 * x + USER], out[4 * x + ASSISTANT] = best["u", 1], best["u", 2]
    out[5 * ASSISTANT] = min(none, best["u", 2])
    out[5 * USER], out[4 * USER + ASSISTANT] = min(none, best["a", 2]), best["a", 1]
    if any(r == "s" and not f for r, f in zip(roles, fixed)):  # only a kept system turn is one
        out[SYSTEM] = align(roles, fixed, cut, "s", none[0])
        for least, y in ((1, USER), (2, ASSISTANT)):
            out[y] = _family(roles, fixed, cut, "s", "u", least, out[y][0], out[y])
    return out


# -- pieces, segments, conversations ------------------------------------------------

def joined(tables: list[list[Found | None]]) -> list[Found | None]:
    """The table of successive turns from the tables of their parts."""
    out: list[Found | None] = [None] * 16
    for x in range(4):
        now: dict[int, Found] = {x: (0, "")}
        for t in tables:
            ahead: dict[int, Found] = {}
            for mid, (cost, audit) in now.items():
                for y in range(4):
                    if step := t[4 * mid + y]:
                        found = (cost + step[0], audit + step[1])
                        if y not in ahead or found < ahead[y]:
                            ahead[y] = found
            now = ahead
        for y, found in now.items():
            out[4 * x + y] = found
    return out


def chain(tables: list[list[Found | None]]) -> list[tuple[int, str]]:
    """(state before, audit) of each segment of a conversation, edits at its end included.

    Audits are compared part by part: of two beginnings the order is known
    from the ranks of what came before and the last parts."""
    cost, rank, steps = {START: 0}, {START: 0}, []
    for t in tables:
        found = {}
        for y in range(4):
            ways = [(cost[x] + t[4 * x + y][0], rank[x], t[4 * x + y][1], x) for x in cost if t[4 * x + y]]
            if ways:
                found[y] = min(ways)
        order = sorted(found, key=lambda y: found[y][1:3])
        cost, rank = {y: w[0] for y, w in found.items()}, {y: k for k, y in enumerate(order)}
        steps.append({y: (w[3], w[2]) for y, w in found.items()})
    tail = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # turns to insert at the end
    state = min(cost, key=lambda y: (cost[y] + INSERT * tail[y], rank[y]))
    parts, end = [], "I" * tail[state]
    for step in reversed(steps):
        state, audit = step[state]
        parts.append((state, audit + end))
        end = ""
    return parts[::-1]


def written(state: int, audit: str, codes: str) -> tuple[str, int]:
    """The turns that the edits leave, as letters: u, a inserted; D deleted, K
    kept, U, A reroled for each turn in order. And the cost."""
    out, i, cost = [], 0, 0
    for edit in audit:
        letter = "a" if state == USER else "u"
        if edit == "D":
            out.append("D")
            cost, i = cost + DELETE, i + 1
            continue
        if edit == "I":
            out.append(letter)
            cost += INSERT
        else:
            if edit == "K" and codes[i].translate(_ROLES) == "s":
                letter = "s"
            out.append("K" if edit == "K" else letter.upper())
            cost, i = cost + (KEEP if edit == "K" else REROLE) + (CUT if codes[i] in "0123" else 0), i + 1
        state = _STATE_OF[letter]
    return "".join(out), cost


def illegal_pairs(roles: str) -> int:
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:]))


#: Codes: s u a x (other) as they are; 0 1 2 3 when truncated; S U A X when the turn must go.
_ROLES = str.maketrans("0123SUAX", "suaxsuax")
_TABLE = "array<struct<cost: int, audit: string>>"


def _align_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, list[Found | None]] = {}
    for pdf in batches:
        out = []
        for codes in pdf["codes"]:
            parts = [codes[i:i + PIECE] for i in range(0, len(codes), PIECE)]
            for part in parts:
                if part not in known:
                    if len(known) >= TABLES_KEPT:
                        known = {}
                    known[part] = table(part)
            whole = joined([known[p] for p in parts]) if len(parts) > 1 else known[codes]
            out.append([None if f is None else {"cost": f[0], "audit": f[1]} for f in whole])
        yield pdf.assign(found=out)


_PICKED = "conv_id bigint, seg bigint, first bigint, cost bigint, illegal bigint, audit string, turns string"


def _pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cheapest chain of each conversation's segments, which come in order."""
    def flush(held: list) -> list[tuple]:
        if not held:
            return []
        rows, before = [], ""
        for (conv, seg, first, codes, _), (state, audit) in zip(held, chain([h[4] for h in held])):
            turns, cost = written(state, audit, codes)
            roles = before + codes.translate(_ROLES)
            rows.append((conv, seg, first, cost, illegal_pairs(roles), audit, turns))
            before = roles[-1]
        return rows

    names, held = [c.split()[0] for c in _PICKED.split(", ")], []
    for pdf in batches:
        out = []
        for conv, seg, first, codes, found in pdf[["conv_id", "seg", "first", "codes", "found"]].itertuples(index=False):
            conv = None if pd.isna(conv) else int(conv)
            if held and held[0][0] != conv:
                out += flush(held)
                held = []
            held.append((conv, seg, first, codes, [None if f is None else (f["cost"], f["audit"]) for f in found]))
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
    yield pd.DataFrame(flush(held), columns=names).astype({"conv_id": "Int64"})


# -- turns as Spark rows ---------------------------------------------------------------

PLACE = ["conv_id", "turn", "role", "text_key", "uid"]


def _nothing(c: Column) -> Column:
    return F.coalesce(c, F.lit(" "))


def with_faults(turns: DataFrame) -> DataFrame:
    """PLACE columns, fault and code of each turn (conv_id, turn, role, text,
    uid). A turn's first fault counts: blank, duplicate (role and text seen
    earlier in the conversation), truncated."""
    plain = turns.withColumn("text_key", F.md5("text"))
    of_same = plain.groupBy("conv_id", "role", "text_key").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("named"), "turn", "uid")).alias("earliest"))
    again = stage(of_same.where("n > 1").select(F.col("conv_id").alias("of_conv"), F.col("role").alias("of_role"), F.col("text_key").alias("of_text"), "earliest.uid"), "repeated-turns")
    same = F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("role") == F.col("of_role")) & (F.col("text_key") == F.col("of_text"))
    known = join_small(plain.withColumnRenamed("uid", "own"), again, same, "left").withColumn("later", F.col("uid") != F.col("own"))
    fault = (F.when(~F.col("text").rlike(BLANK_RE), "blank").when(F.coalesce("later", F.lit(False)), "duplicate")
             .when(~F.col("text").rlike(LAST_RE), "truncated"))
    which = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), F.upper("which")).when(F.col("fault") == "truncated", F.translate("which", "suax", "0123")).otherwise(F.col("which"))
    faulty = known.select("conv_id", "turn", "role", "text_key", F.col("own").alias("uid"), fault.alias("fault"), which.alias("which"))
    return faulty.withColumn("code", code).drop("which")


def _plan(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged: the turns in order (PLACE columns, fault, code, at), and what to do with each segment of them."""
    spark = turns.sparkSession
    by = [F.col(c).asc_nulls_first() for c in PLACE]
    marked = stage(with_faults(turns), "turn-faults")
    ordered = marked.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    ordered = stage(ordered, "ordered-turns")  # the numbers are fixed by being written
    codes = F.expr("array_join(transform(array_sort(collect_list(struct(at, code))), x -> x.code), '')")
    segments = ordered.groupBy("conv_id", F.shiftright("at", SEGMENT_BITS).alias("seg")).agg(F.min("at").alias("first"), codes.alias("codes"))
    aligned = stage(segments.mapInPandas(_align_segments, f"conv_id bigint, seg bigint, first bigint, codes string, found {_TABLE}"), "aligned-segments")
    picked = aligned.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "seg").mapInPandas(_pick, _PICKED)
    return ordered, stage(picked, "segment-edits")


def _edits(ordered: DataFrame, picked: DataFrame) -> DataFrame:
    """The PLACE columns of each turn, its ``edit`` (turns inserted before it, what becomes of it, turns inserted at the end) and ``at``."""
    one = F.regexp_extract_all("turns", F.lit("[ua]*[DKUA](?:[ua]+$)?"), F.lit(0))
    each = picked.select("first", F.posexplode(one).alias("k", "edit")).select((F.col("first") + F.col("k")).alias("of"), "edit")
    return ordered.join(each, F.col("at") == F.col("of")).select(*PLACE, "edit", "at")


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, uid of each turn; null roles and texts are one space; staged."""
    return stage(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _nothing(F.col("role").cast("string")).alias("role"),
                              _nothing(F.col("text").cast("string")).alias("text"), F.monotonically_increasing_id().alias("uid")), "turns")


def _lines(edit: Column, role: Column, text: Column) -> Column:
    """(role, text, edit) of the turns that one turn leaves."""
    inserted = lambda part: F.transform(F.split(part, ""), lambda c: F.struct(F.when(c == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"), F.lit("insert").alias("edit")))
    some = lambda part: F.when(part == "", F.array().cast("array<struct<role: string, text: string, edit: string>>")).otherwise(inserted(part))
    op = F.regexp_extract(edit, "[DKUA]", 0)
    own = F.struct(F.when(op == "K", role).when(op == "U", "user").otherwise("assistant").alias("role"), text.alias("text"), F.when(op == "K", "keep").otherwise("rerole").alias("edit"))
    return F.concat(some(F.regexp_extract(edit, "^[ua]*", 0)), F.when(op == "D", F.array().cast("array<struct<role: string, text: string, edit: string>>")).otherwise(F.array(own)), some(F.regexp_extract(edit, "[ua]*$", 0)))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (ascending in the
    conversation, with gaps), turn (null for inserted ones), role, text, edit
    (keep, rerole or insert). ``turns`` has conv_id, turn, role and text; see
    ``repair_report`` for nulls and ties."""
    rows = _numbered(turns)
    edits = _edits(*_plan(rows)).select(F.col("uid").alias("of"), "edit", "at")
    lines = rows.join(edits, F.col("uid") == F.col("of")).select("conv_id", "turn", "at", F.posexplode(_lines(F.col("edit"), F.col("role"), F.col("text"))).alias("k", "line"))
    widest = F.lit(1 << 20)
    return lines.select("conv_id", (F.col("at") * widest + F.col("k")).alias("place"), F.when(F.col("line.edit") != "insert", F.col("turn")).alias("turn"), "line.role", "line.text", "line.edit")


# -- digests -----------------------------------------------------------------------------

_TEXTS = "conv_id bigint, part int, no int, text string, sha string"
_LINE = re.compile("[ua]*$")


def _digest_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of the conversations that lie in this partition as a whole and
    are short; the repaired text of others in bounded pieces. An edit's row
    comes before its turn's."""
    part, names = TaskContext.get().partitionId(), [c.split()[0] for c in _TEXTS.split(", ")]
    out: list[tuple] = []
    lines: list[str] = []
    conv, edit, size, no, whole, begun = None, "", 0, 0, False, False

    def piece() -> None:
        nonlocal size, no, whole
        if lines:
            out.append((conv, part, no, "\n".join(lines), None))
        lines.clear()
        size, no, whole = 0, no + 1, False

    for pdf in batches:
        for now, role, text, own in pdf[["conv_id", "role", "text", "edit"]].itertuples(index=False):
            now = None if pd.isna(now) else int(now)
            if not begun or now != conv:
                if whole:
                    out.append((conv, part, 0, None, hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()))
                    lines.clear()
                elif begun:
                    piece()
                conv, size, no, whole, begun = now, 0, 0, begun, True  # the first one may have begun in the partition before
            if isinstance(own, str):
                edit = own
                continue
            tail = _LINE.search(edit).group()
            body = edit[:len(edit) - len(tail)]
            lines += [f"{_WRITTEN[c]}:" for c in body[:-1]]
            if body[-1] != "D":
                lines.append(f"{role if body[-1] == 'K' else _WRITTEN[body[-1].lower()]}:{text}")
            lines += [f"{_WRITTEN[c]}:" for c in tail]
            size += len(text)
            if size >= TEXT_CHARS:
                piece()
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        out.clear()
    piece()  # the last one may go on in the next partition
    yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})


def _digest_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each conversation from its pieces, which come in order."""
    conv, sha = None, None
    for pdf in batches:
        out = []
        for now, text in pdf[["conv_id", "text"]].itertuples(index=False):
            now = None if pd.isna(now) else int(now)
            if sha is None or now != conv:
                if sha is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha = now, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(text.encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(out, columns=["conv_id", "sha"]).astype({"conv_id": "Int64"})
    if sha is not None:
        yield pd.DataFrame([(conv, sha.hexdigest())], columns=["conv_id", "sha"]).astype({"conv_id": "Int64"})


def digests(rows: DataFrame, ordered: DataFrame, picked: DataFrame) -> DataFrame:
    """(conv_id, sha) of each conversation's repaired ``role:text`` lines.

    Edits and texts are range-partitioned alike, so a long conversation is
    spread; its pieces then pass one task in order, one piece at a time, as
    the digest demands."""
    spark = rows.sparkSession
    edits = _edits(ordered, picked).select(*PLACE, "edit", F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv_id", "turn", "role", F.md5("text").alias("text_key"), "uid", F.lit(None).cast("string").alias("edit"), "text")
    by = [F.col(c).asc_nulls_first() for c in PLACE]
    both = edits.union(texts).repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by, F.col("edit").desc_nulls_last())
    parts = stage(both.select("conv_id", "role", "text", "edit").mapInPandas(_digest_parts, _TEXTS), "repaired-texts")
    pieces = parts.where("text IS NOT NULL").repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "part", "no")
    return parts.where("sha IS NOT NULL").select("conv_id", "sha").union(pieces.select("conv_id", "text").mapInPandas(_digest_pieces, "conv_id bigint, sha string"))


# -- reports --------------------------------------------------------------------------------

REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair_report(turns: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text; other
    columns are ignored): the REPORT columns.

    Turns are taken by turn (nulls first), ties by role, then by the text's
    MD5; repeated rows are turns of their own. A null role or text is one
    space, which makes a blank turn; a role with another initial than s, u, a
    (or none) cannot be kept. Null conv_ids are one conversation. ``gaps``
    ignores null turns. ``of`` (conv_id) names conversations that are reported
    also without turns, with zeros, an empty audit and the empty text's
    digest. An empty table gives an empty result.
    """
    rows = _numbered(turns)
    ordered, picked = _plan(rows)
    faults = ordered.groupBy("conv_id").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
                                            F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("named"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("named"), F.lit(0).cast("long"))
    audit = F.expr("array_join(transform(array_sort(collect_list(struct(seg, audit))), x -> x.audit), '')")
    edits = picked.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    parts = [faults.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated"), edits,
             digests(rows, ordered, picked).withColumnRenamed("sha", "repaired_sha256")]
    if of is not None:
        parts.append(of.select(F.col("conv_id").cast("long").alias("conv_id")).distinct())
    all_of = parts[0]
    for more in parts[1:]:
        all_of = all_of.unionByName(more, allowMissingColumns=True)
    filled = {c: F.lit(0).cast("long") for c in REPORT[1:7]} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return all_of.groupBy("conv_id").agg(*(F.coalesce(F.max(c), empty).alias(c) for c, empty in filled.items()))


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after the damage that the CRC-32 of ``conv_id:turn``, modulo
    20, does: 0 drops the turn, 1 empties its text, 2 takes ``.!?`` out, 3
    repeats it, 4 sets the role user. Nulls count as one space."""
    named = F.concat(_nothing(F.col("conv_id").cast("string")), F.lit(":"), _nothing(F.col("turn").cast("string")))
    rows = conversations.select("conv_id", "turn", _nothing(F.col("role").cast("string")).alias("role"), _nothing(F.col("text").cast("string")).alias("text"), (F.crc32(named) % 20).alias("h")).where("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "h")
    return changed.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
