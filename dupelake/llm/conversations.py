"""Repair of the turn structure of conversations by a cheapest-edit dynamic program over a sorted stream.

Rows are repartitioned by conversation and sorted by turn; ``mapInPandas`` then sees every conversation as consecutive rows, possibly
over many Arrow batches, and carries the state of the program from batch to batch. A repaired conversation's role initials match
``(s?(ua)+)?``; the four states are: nothing yet, after s, after u, after a. Edits of a row: Keep 0, Rerole to user or assistant 2,
Delete 3 (the only choice for blank and repeated rows); Insert an empty user or assistant turn anywhere 2; a truncated row that is
not deleted costs 1 more. Of equally cheap edit strings the least in ASCII order wins.

Edit strings that have consumed the same rows and end with a row's letter are never beginnings of one another, so four costs and
the order of the four strings are all the program has to carry; both stay in a small range, so a row's step is looked up in a table
of the steps met so far. One two-byte step number per row is the backpointer; beyond ``SPILL_BYTES`` of a conversation they go to an
anonymous file of the task, which is gone when the task ends or dies. The hash of the repaired rows is carried along the four
strings, so no text is kept: a task holds one Arrow batch, whatever the length of a conversation. Whether role and text were met
earlier in the conversation is settled before by a window over the same partitioning, whose sort spills.

Order of the rows of a conversation: turn (nulls first), role, text. Defined cases: null role and text are one space; a null conv_id
is a conversation of its own; ``copies`` 0 leaves a row out (its conversation stays, with zeros, an empty edit string and the hash of
the empty text), 2 stands for two adjacent rows; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import array
import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Characters that make no text, and those that end a sentence.
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPILL_BYTES = 1 << 20
LONG_MAX = (1 << 63) - 1

_FAULTS = ("", "truncated", "duplicate", "blank")
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: State after an inserted or reroled turn.
_TURN = (2, 2, 3, 2)
_ROLES = {2: b"user", 3: b"assistant"}
#: A state that is more than this above the cheapest one cannot be on a cheapest way: five make up for any difference of states.
_HOPELESS = 8

PLAN = ("conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string")


class Steps:
    """Transitions of the program, built when they are first met.

    A situation is a tuple of (state, cost above the cheapest, rank) of the states that can be on a cheapest way. A step is
    (added cost, next situation, [(state, from state, inserts, letter)]).
    """

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.steps: list[tuple] = []

    def get(self, situation: tuple, initial: str, fault: int) -> int:
        key = situation, initial, fault
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.steps)
            self.steps.append(self._build(*key))
        return found

    @staticmethod
    def _build(situation, initial, fault):
        best: dict[int, tuple] = {}
        for state, cost, rank in situation:
            at = state
            for inserts in range(3):
                spent = cost + INSERT * inserts
                moves = [(at, DELETE, "D")]
                if fault < 2:
                    moves.append((_TURN[at], REROLE + TRUNCATED * fault, "R"))
                    if at in _NEXT.get(initial, {}):
                        moves.append((_NEXT[initial][at], KEEP + TRUNCATED * fault, "K"))
                for to, price, letter in moves:
                    way = spent + price, rank, "I" * inserts + letter, state
                    if to not in best or way < best[to]:
                        best[to] = way
                at = _TURN[at]
        least = min(way[0] for way in best.values())
        live = sorted((way[1:3], to) for to, way in best.items() if way[0] - least <= _HOPELESS)
        ranks = {to: i for i, (_, to) in enumerate(live)}
        return (least, tuple(sorted((to, best[to][0] - least, ranks[to]) for to in ranks)),
                [(to, best[to][3], len(best[to][2]) - 1, best[to][2][-1]) for to in ranks])


def ending(situation: tuple) -> tuple[int, int, int]:
    """(added cost, state, inserts) of the cheapest end."""
    ways = []
    for state, cost, rank in situation:
        at = state
        for inserts in range(3):
            if at == 3 or (at == 0 and not inserts):
                ways.append((cost + INSERT * inserts, rank, inserts, state))
            at = _TURN[at]
    cost, _, inserts, state = min(ways)
    return cost, state, inserts


class Repair:
    """One conversation, row by row."""

    def __init__(self, steps: Steps, spill_bytes: int = SPILL_BYTES):
        self.steps, self.situation, self.cost = steps, ((0, 0, 0),), 0
        self.back, self.file, self.spill = array.array("H"), None, spill_bytes
        self.hashes = {0: hashlib.sha256()}
        self.counts, self.illegal, self.before = [0] * 4, 0, None
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            if self.first is None:
                self.first = turn
            if turn != self.last:
                self.turns, self.last = self.turns + 1, turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.counts[fault] += 1
        number = self.steps.get(self.situation, initial, fault)
        added, self.situation, ways = self.steps.steps[number]
        self.cost += added
        self.back.append(number)
        if len(self.back) * 2 >= self.spill:
            self._spill()
        hashes, body = {}, None
        for to, state, inserts, letter in ways:
            h = self.hashes[state]
            if inserts or letter != "D":
                h = h.copy()
                at = self._inserted(h, state, inserts)
                if letter != "D":
                    body = body or b":" + text.encode("utf-8", "surrogatepass")
                    h.update((b"\n" if at else b"") + (role.encode("utf-8", "surrogatepass") if letter == "K" else _ROLES[to]))
                    h.update(body)
            hashes[to] = h
        self.hashes = hashes

    @staticmethod
    def _inserted(h, state: int, inserts: int) -> int:
        for _ in range(inserts):
            h.update((b"\n" if state else b"") + _ROLES[_TURN[state]] + b":")
            state = _TURN[state]
        return state

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.back.tofile(self.file)
        self.back = array.array("H")

    def _backwards(self) -> Iterator[int]:
        yield from reversed(self.back)
        if self.file is not None:
            at = self.file.tell()
            while at:
                size = min(at, self.spill)
                at -= size
                self.file.seek(at)
                part = array.array("H", self.file.read(size))
                yield from reversed(part)
            self.file.close()

    def close(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        added, state, inserts = ending(self.situation)
        h = self.hashes[state].copy()
        self._inserted(h, state, inserts)
        letters = bytearray(b"I" * inserts)
        for number in self._backwards():
            _, state, k, letter = next(w for w in self.steps.steps[number][2] if w[0] == state)
            letters += letter.encode() + b"I" * k
        letters.reverse()
        gaps = 0 if self.first is None else min(LONG_MAX, self.last - self.first + 1 - self.turns)
        return gaps, self.counts[3], self.counts[2], self.counts[1], self.illegal, self.cost + added, letters.decode(), h.hexdigest()


def _stream(spill_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, open_id, repair, done = Steps(), None, None, []
        for frame in frames:
            columns = (frame[c].tolist() for c in ("conv_id", "has_turn", "turn", "role", "text", "fault", "copies"))
            for conv_id, has_turn, turn, role, text, fault, copies in zip(*columns):
                if repair is None or conv_id != open_id:
                    if repair is not None:
                        done.append((open_id, *repair.close()))
                    open_id, repair = conv_id, Repair(steps, spill_bytes)
                for again in range(copies):
                    repair.add(turn if has_turn else None, role, text, max(fault, 2) if again else fault)
            if done:
                yield pd.DataFrame(done, columns=[c.split()[0] for c in PLAN.split(", ")])
                done = []
        if repair is not None:
            yield pd.DataFrame([(open_id, *repair.close())], columns=[c.split()[0] for c in PLAN.split(", ")])

    return run


def ordered_turns(turns: DataFrame) -> DataFrame:
    """The rows of conversations in one place and order, with their first fault: 3 blank, 2 duplicate, 1 truncated, 0 none."""
    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")),
                        copies.alias("copies")).withColumn("there", F.col("copies") > 0)
    same = Window.partitionBy("conv_id", "role", "text", "there").orderBy(F.col("turn").asc_nulls_first())
    ink = F.rtrim(F.col("text"), F.lit(BLANK))
    fault = (F.when(F.length(ink) == 0, 3).when(F.col("again") > 1, 2)
             .when(~F.substring(ink, -1, 1).isin(*ENDS), 1).otherwise(0))
    return (rows.repartition("conv_id").withColumn("again", F.row_number().over(same)).withColumn("fault", fault)
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again"))


def plan_repairs(turns: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``turns`` has conv_id, turn, role, text and may have ``copies``. ``gaps`` counts turn numbers missing between the least and the
    greatest, ``illegal`` adjacent roles other than system-user, user-assistant and assistant-user; faults are each row's first.
    """
    kind = turns.schema["conv_id"].dataType
    sent = ordered_turns(turns).select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").isNotNull().alias("has_turn"),
                                       F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "role", "text", "fault", "copies")
    return sent.mapInPandas(_stream(spill_bytes), PLAN).withColumn("conv_id", F.col("conv_id").cast(kind))


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), role, text, edit (K, R or I), following the edit strings of ``plans``."""
    inside = Window.partitionBy("conv_id").orderBy("row")
    rows = (ordered_turns(turns).withColumn("copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), "copies")).otherwise(F.array().cast("array<int>"))))
            .withColumn("row", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "again", "copy")) - 1)
            .select(F.col("conv_id").alias("of"), F.col("row").alias("at"), "role", "text"))
    pieces = plans.select("conv_id", F.posexplode(F.regexp_extract_all("audit", F.lit("(I*[DKR]|I+$)"), F.lit(1))).alias("row", "piece"))
    placed = (pieces.withColumn("made", F.length(F.replace("piece", F.lit("D"), F.lit(""))))
              .withColumn("first", F.sum("made").over(inside) - F.col("made"))
              .join(rows, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("at")), "left"))
    made = (placed.select("conv_id", "first", "role", "text", F.posexplode(F.split(F.replace("piece", F.lit("D"), F.lit("")), "")).alias("j", "edit"))
            .where("edit <> ''").withColumn("position", F.col("first") + F.col("j")))
    shift = F.max(((F.col("position") == 0) & (F.col("edit") == "K") & F.col("role").startswith("s")).cast("int")).over(Window.partitionBy("conv_id"))
    given = F.when((F.col("position") - shift) % 2 == 0, "user").otherwise("assistant")
    return made.select("conv_id", "position", F.when(F.col("edit") == "K", F.col("role")).otherwise(given).alias("role"),
                       F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows with faults planted by a checksum of conversation and turn (a null is one space)."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
                                (F.crc32(key.cast("binary")) % 20).alias("code"))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"))


#: ``plan_repairs`` of ``damage``. The program carries whole strings and whole repaired texts here.
ORACLE_SQL = r"""
with recursive tab as (select list(v order by n) t from (select n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from (select range n from range(256)))),
d as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, xor(list_reduce(list_prepend(4294967295::bigint,
        list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda ch: ord(ch)::bigint)),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 code from conversations, tab),
r as (select conv_id, turn, case when code = 4 then 'user' else role end role,
        case when code = 1 then '' when code = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text,
        unnest(range(case code when 0 then 0 when 3 then 2 else 1 end)) copy from d),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ink from r),
f as (select *, case when ink = '' then 3 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
        when right(ink, 1) not in ('.', '!', '?') then 1 else 0 end fault,
        lag(role[1]) over (partition by conv_id order by i) || role[1] pair from o),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 3) blank,
        count(*) filter (fault = 2) duplicate, count(*) filter (fault = 1) truncated,
        count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) illegal, count(*) len from f group by conv_id),
ins(q, k, here, made, extra) as (values (0, 0, 0, '', ''), (1, 0, 1, '', ''), (2, 0, 2, '', ''), (3, 0, 3, '', ''),
        (0, 1, 2, 'I', 'user:' || chr(10)), (1, 1, 2, 'I', 'user:' || chr(10)), (2, 1, 3, 'I', 'assistant:' || chr(10)), (3, 1, 2, 'I', 'user:' || chr(10)),
        (0, 2, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 2, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
        (2, 2, 2, 'II', 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 2, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
step(here, letter, initial, too) as (values (0, 'D', null, 0), (1, 'D', null, 1), (2, 'D', null, 2), (3, 'D', null, 3),
        (0, 'R', null, 2), (1, 'R', null, 2), (2, 'R', null, 3), (3, 'R', null, 2),
        (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3)),
dp as (select conv_id, 0::bigint i, 0 q, 0 cost, '' path, '' made from n
  union all
  select * from (select dp.conv_id, f.i, step.too q,
        dp.cost + 2 * ins.k + case letter when 'D' then 3 when 'R' then 2 else 0 end + case when letter <> 'D' and f.fault = 1 then 1 else 0 end cost,
        dp.path || ins.made || letter path, dp.made || ins.extra || case letter when 'D' then '' when 'K' then f.role || ':' || f.text || chr(10)
            else case step.too when 2 then 'user:' else 'assistant:' end || f.text || chr(10) end made
    from dp join f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i + 1 join ins on ins.q = dp.q
    join step on step.here = ins.here and (step.initial is null or step.initial = f.role[1]) and (f.fault < 2 or letter = 'D')
    qualify row_number() over (partition by dp.conv_id, step.too order by
        dp.cost + 2 * ins.k + case letter when 'D' then 3 when 'R' then 2 else 0 end + case when letter <> 'D' and f.fault = 1 then 1 else 0 end,
        dp.path || ins.made || letter) = 1)),
e as (select dp.conv_id, dp.cost + 2 * ins.k cost, dp.path || ins.made path, dp.made || ins.extra made
    from dp join n on n.conv_id is not distinct from dp.conv_id and dp.i = n.len join ins on ins.q = dp.q
    where ins.here = 3 or (ins.here = 0 and ins.k = 0)
    qualify row_number() over (partition by dp.conv_id order by dp.cost + 2 * ins.k, dp.path || ins.made) = 1)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate,
    coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(cost, 0)::bigint as cost,
    coalesce(path, '') audit, sha256(coalesce(left(made, length(made) - 1), '')) repaired_sha256
from (select distinct conv_id from conversations) c left join n on n.conv_id is not distinct from c.conv_id
left join e on e.conv_id is not distinct from c.conv_id
"""
