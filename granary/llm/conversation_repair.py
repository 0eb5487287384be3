"""Repair of a conversation's structure: the cheapest edits that make its turns alternate.

A conversation is its rows in order of turn (nulls first, then role, text digest). Its lattice has a node (rows consumed,
grammar state) and an edge for each edit: Keep, Rerole, Delete consume a row, Insert doesn't. Bidirectional Dijkstra
(Nicholson, 1966; Pohl, 1971) takes turns on a forward heap from the start and a reverse heap from the accepting ends. It
goes on until the two heaps' tops together exceed the cheapest meeting, so that every equal-cost crossing is known. Edges
on cheapest paths through a crossing are then walked from the start, by least initial: the least audit.

Costs follow from an audit and its rows, so no cheapest audit is a proper prefix of another, and nodes that share a prefix
have consumed the same rows: the walk holds a few grammar states at a time.

1. What the search needs of a row (initial, fault flags, digest of role and text) is sorted by conversation, without texts,
   and read as a stream. A task holds a few dozen bytes a row of one conversation at a time.
2. Each conversation's report goes in front of its rows, sorted in the same order with their texts. A second stream repairs
   row by row: a text is passed on as it comes. A digest (of all text, in order) and a report (one cell) are sequential
   by nature; that is all that a long conversation takes to one task.

Edge cases. Null role or text: one space. Null ids form one conversation. Roles other than user, assistant and system keep
their first letter as initial, which may be one the grammar allows; an empty role has no initial and can't be kept.
Repeated rows are duplicates. Turns are compared as 64-bit integers. A conversation whose rows are all absent gets zeros
and an empty audit. An empty table gives an empty result. Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, fresh, materialize, table

#: Costs of edits; an undeleted truncated row adds TRUNCATED.
RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar states: 0 start, 1 after system, 2 after user, 3 after assistant. What an initial leads to; starts and ends.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = 4, (0, 3)
LEGAL = ("su", "ua", "au")
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_INF = 1 << 40
_INTO = {q: [(p, c) for (p, c), t in STEPS.items() if t == q] for q in range(STATES)}
_FROM = {q: [(t, c) for (p, c), t in STEPS.items() if p == q] for q in range(STATES)}


def _out(q: int, initial: str, fault: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, edit) of the edits that consume a row."""
    yield q, DELETE, "D"
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    for t, c in _FROM[q]:
        if c == initial:
            yield t, more, "K"
        if c != "s":
            yield t, more + RE_ROLE, "R"


def _in(q: int, initial: str, fault: int) -> Iterator[tuple[int, int]]:
    """(state before, cost) of the edits that consume a row and lead to q."""
    yield q, DELETE
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    for p, c in _INTO[q]:
        if c == initial:
            yield p, more
        elif c != "s":
            yield p, more + RE_ROLE


def search(initials: list[str], faults: array | list[int]) -> tuple[int, str]:
    """Cost and least audit of the cheapest edits."""
    n = len(initials)
    size = (n + 1) * STATES
    ahead, back = array("q", [_INF]) * size, array("q", [_INF]) * size
    ahead[0] = 0
    front, rear = [(0, 0)], []
    for q in ENDS:
        back[n * STATES + q] = 0
        rear.append((0, n * STATES + q))
    best = 0 if n == 0 else _INF
    # an edge is a crossing as soon as both its ends have labels; heaps' tops above best leave none out
    while front and rear and front[0][0] + rear[0][0] <= best:
        if len(front) <= len(rear):
            d, v = heapq.heappop(front)
            if d > ahead[v]:
                continue
            i, q = divmod(v, STATES)
            moves = [(v - q + t, INSERT) for t, c in _FROM[q] if c != "s"]
            if i < n:
                moves += [((i + 1) * STATES + t, w) for t, w, _ in _out(q, initials[i], faults[i])]
            mine, other, heap = ahead, back, front
        else:
            d, v = heapq.heappop(rear)
            if d > back[v]:
                continue
            i, q = divmod(v, STATES)
            moves = [(v - q + p, INSERT) for p, c in _INTO[q] if c != "s"]
            if i:
                moves += [((i - 1) * STATES + p, w) for p, w in _in(q, initials[i - 1], faults[i - 1])]
            mine, other, heap = back, ahead, rear
        for t, w in moves:
            if d + w < mine[t]:
                mine[t] = d + w
                heapq.heappush(heap, (d + w, t))
            if d + w + other[t] < best:
                best = d + w + other[t]
    return best, _least(initials, faults, ahead, back, best)


def _edges(v: int, n: int, initials: list[str], faults) -> Iterator[tuple[int, int, str]]:
    i, q = divmod(v, STATES)
    for t, c in _FROM[q]:
        if c != "s":
            yield v - q + t, INSERT, "I"
    if i < n:
        for t, w, edit in _out(q, initials[i], faults[i]):
            yield (i + 1) * STATES + t, w, edit


def _least(initials: list[str], faults, ahead: array, back: array, best: int) -> str:
    """The least audit among cheapest paths, from both sides' labels.

    good marks nodes of cheapest paths: sources of crossings, and from them back along tight edges; beyond a crossing the
    reverse labels tell.
    """
    n = len(initials)
    good = bytearray(len(ahead))
    todo = []
    for v in range(len(ahead)):
        if ahead[v] < _INF and (ahead[v] + back[v] == best or any(ahead[v] + w + back[t] == best for t, w, _ in _edges(v, n, initials, faults))):
            good[v] = 1
            todo.append(v)
    while todo:
        v = todo.pop()
        i, q = divmod(v, STATES)
        before = [(v - q + p, INSERT) for p, c in _INTO[q] if c != "s"]
        if i:
            before += [((i - 1) * STATES + p, w) for p, w in _in(q, initials[i - 1], faults[i - 1])]
        for u, w in before:
            if not good[u] and ahead[u] + w == ahead[v] < _INF:
                good[u] = 1
                todo.append(u)
    at, spent, audit = {0}, 0, []
    ends = {n * STATES + q for q in ENDS}
    while spent < best or not at & ends:
        found: dict[str, tuple[set, int]] = {}
        for v in at:
            for t, w, edit in _edges(v, n, initials, faults):
                if spent + w + back[t] == best or (good[t] and ahead[t] == spent + w):
                    found.setdefault(edit, (set(), spent + w))[0].add(t)
        edit = min(found)
        at, spent = found[edit]
        audit.append(edit)
    return "".join(audit)


class _Conversation:
    """What is gathered of a conversation, a few dozen bytes a row."""

    def __init__(self):
        self.initials: list[str] = []
        self.faults = array("b")
        self.seen: set[bytes] = set()
        self.counts = [0, 0, 0, 0]
        self.turns = self.illegal = 0
        self.low = self.high = None

    def add(self, turn, initial: str, blank: bool, cut: bool, digest: bytes) -> None:
        if turn is not None and turn != self.high:  # turns rise
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        if self.initials and self.initials[-1] + initial not in LEGAL:
            self.illegal += 1
        fault = BLANK if blank else DUPLICATE if digest in self.seen else CUT if cut else NONE
        self.seen.add(digest)
        self.counts[fault] += 1
        self.initials.append(initial)
        self.faults.append(fault)

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = search(self.initials, self.faults)
        return (gaps, *self.counts[1:], self.illegal, cost, audit)


def _rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, absent: Column | None) -> DataFrame:
    """conv, turn, role, text, digest, gone."""
    known = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    out = df.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), known(role_col).alias("role"), known(text_col).alias("text"),
        (F.lit(False) if absent is None else absent).alias("gone"),
    )
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return out.withColumn("digest", digest)


def audits(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None
) -> DataFrame:
    """conv and the columns of REPORT, a row for each conversation. absent: rows that name a conversation but aren't there."""
    rows = _rows(df, conv_col, turn_col, role_col, text_col, absent)
    bare = F.rtrim("text", F.lit(ASCII_SPACE))
    light = rows.select(
        "conv", "turn", "role", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), "digest", "gone"
    )
    order = ["conv", "turn", "role", "digest"]
    light = light.repartition("conv").sortWithinPartitions(*order).drop("role")
    kind = dict(light.dtypes)["conv"]

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = [f.split()[0] for f in REPORT.split(", ")]
        done: list[tuple] = []
        now, talk, schema = None, None, None

        def out():
            cols = [pa.array([r[0] for r in done], schema.field("conv").type)]
            cols += [pa.array([r[1][k] for r in done], pa.string() if c == "audit" else pa.int64()) for k, c in enumerate(names)]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, ["conv", *names])

        for batch in batches:
            schema = batch.schema
            for conv, turn, initial, blank, cut, digest, gone in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if talk is None or conv != now:
                    if talk is not None:
                        done.append((now, talk.report()))
                    now, talk = conv, _Conversation()
                if not gone:
                    talk.add(turn, initial, blank, cut, digest)
            if done:
                yield out()
        if talk is not None:
            done.append((now, talk.report()))
            yield out()

    return light.mapInArrow(run, f"conv {kind}, {REPORT}")


def _repaired(batches, head: int) -> Iterator[tuple]:
    """(conv, report, pieces) of each conversation in a stream of reports, each before its rows; pieces: its repaired (role,
    text), to be read before the next. head: columns of a report."""

    def each():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)))

    stream = each()
    ahead = next(stream, None)

    def pieces(audit: str):
        nonlocal ahead
        state = 0
        for edit in audit:
            if edit == "I":
                to, c = next((t, c) for t, c in _FROM[state] if c != "s")
                yield ("user" if c == "u" else "assistant"), ""
                state = to
                continue
            ahead = next(stream) if ahead is None else ahead
            role, text = ahead[1 + head :]
            ahead = None
            if edit == "R":
                to, c = next((t, c) for t, c in _FROM[state] if c != "s")
                role, state = ("user" if c == "u" else "assistant"), to
            elif edit == "K":
                state = STEPS[state, role[:1]]
            if edit != "D":
                yield role, text

    while ahead is not None:
        conv, report = ahead[0], ahead[1 : 1 + head]
        ahead = None
        yield conv, report, pieces(report[-1])
        ahead = next(stream, None) if ahead is None else ahead


def _with_reports(df: DataFrame, report: DataFrame, *cols, absent: Column | None) -> DataFrame:
    """Reports, each in front of its conversation's rows, as sorted streams."""
    rows = _rows(df, *cols, absent).where("not gone")
    names = report.columns[1:]
    kinds = dict(report.dtypes)
    rows = rows.select("conv", *[F.lit(None).cast(kinds[c]).alias(c) for c in names], "role", "text", F.lit(1).alias("lead"), "turn", "digest")
    heads = report.select("conv", *names, *[F.lit(None).cast(k).alias(c) for c, k in (("role", "string"), ("text", "string"))], F.lit(0).alias("lead"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"))
    both = heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "lead", "turn", "role", "digest")
    return both.drop("lead", "turn", "digest")


def digests(
    df: DataFrame, report: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None
) -> DataFrame:
    """report with repaired_sha256, of the repaired `role:text` lines joined by newlines."""
    both = _with_reports(df, report, conv_col, turn_col, role_col, text_col, absent=absent)
    head = len(report.columns) - 1

    def run(batches) -> Iterator:
        import pyarrow as pa

        schema, out = None, []

        def spied():
            nonlocal schema
            for b in batches:
                schema = b.schema
                yield b

        def flush():
            cols = [pa.array([r[k] for r in out], schema.field(k).type) for k in range(head + 1)] + [pa.array([r[-1] for r in out], pa.string())]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, [*schema.names[: head + 1], "repaired_sha256"])

        for conv, told, pieces in _repaired(spied(), head):
            h, joint = hashlib.sha256(), ""
            for role, text in pieces:
                h.update(f"{joint}{role}:{text}".encode())
                joint = "\n"
            out.append((conv, *told, h.hexdigest()))
            if len(out) >= 500:
                yield flush()
        if out:
            yield flush()

    fields = ", ".join(f"`{c}` {t}" for c, t in report.dtypes)
    return both.mapInArrow(run, f"{fields}, repaired_sha256 string")


def repair(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None
) -> DataFrame:
    """The repaired conversations: rows conv_id, turn (from 0), role, text."""
    report = materialize(audits(df, conv_col, turn_col, role_col, text_col, absent), "conversation-audits")
    both = _with_reports(df, report, conv_col, turn_col, role_col, text_col, absent=absent)
    head, kind = len(report.columns) - 1, dict(report.dtypes)["conv"]

    def run(batches) -> Iterator:
        import pyarrow as pa

        out, names = [], ["conv_id", "turn", "role", "text"]
        schema = None

        def spied():
            nonlocal schema
            for b in batches:
                schema = b.schema
                yield b

        def flush():
            types = [schema.field(0).type, pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[k] for r in out], types[k]) for k in range(4)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for conv, _, pieces in _repaired(spied(), head):
            for nth, (role, text) in enumerate(pieces):
                out.append((conv, nth, role, text))
                if len(out) >= 500:
                    yield flush()
        if out:
            yield flush()

    return both.mapInArrow(run, f"conv_id {kind}, turn long, role string, text string")


def damage(df: DataFrame) -> tuple[DataFrame, str]:
    """The contract's damage to rows (conv_id, turn, role, text): the rows, and the column that marks dropped ones."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code, gone = fresh(df, "code"), fresh(df, "gone")
    hit = df.withColumn(code, F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20)
    c = F.col(code)
    text = F.when(c == 1, F.lit("")).when(c == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    role = F.when(c == 4, F.lit("user")).otherwise(known("role"))
    out = hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), (c == 0).alias(gone), F.explode(F.when(c == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias(code))
    return out.drop(code), gone


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, gone = damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    report = materialize(audits(rows, absent=F.col(gone)), "conversation-audits")
    return digests(rows, report, absent=F.col(gone)).withColumnRenamed("conv", "conv_id")


SQL = r"""
with recursive raw as (
  select row_number() over () as rid, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
  from conversations),
coded as (
  select *, xor(list_reduce(
      list_transform(range(1, len(key) + 1), lambda i: ascii(substr(key, i::integer, 1))::ubigint),
      lambda c, b: list_reduce(range(8)::ubigint[], lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end, xor(c, b)),
      4294967295::ubigint), 4294967295::ubigint) % 20 as code
  from raw),
hurt as (
  select rid, copy, conv_id, turn, case when code = 4 then 'user' else role end as role,
         case when code = 1 then '' when code = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from coded, range(2) c(copy) where code <> 0 and (copy = 0 or code = 3)),
nth as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(strlen(role) || ':' || role || text), rid, copy) as i,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, role[1] as initial
  from hurt),
judged as (
  select *, case when bare = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
                 when bare[-1] not in ('.', '!', '?') then 3 else 0 end as fault,
         lag(initial) over (partition by conv_id order by i) as initial0
  from nth),
figures as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
         count(*) filter (fault = 1)::bigint as blank, count(*) filter (fault = 2)::bigint as duplicate, count(*) filter (fault = 3)::bigint as truncated,
         count(*) filter (initial0 is not null and initial0 || initial not in ('su', 'ua', 'au'))::bigint as illegal
  from judged group by conv_id),
lattice as (
  select conv_id, n as i, {'c': 0::bigint, 's': ''} as w0, {'c': 10::bigint, 's': 'II'} as w1, {'c': 5::bigint, 's': 'I'} as w2, {'c': 0::bigint, 's': ''} as w3
  from figures
  union all
  select conv_id, i,
         list_min([r0, {'c': 5 + w2.c, 's': 'I' || w2.s}]), list_min([r1, {'c': 5 + w2.c, 's': 'I' || w2.s}]), w2, w3
  from (
    select conv_id, i, r0, r1, list_min([r2, {'c': 5 + r3.c, 's': 'I' || r3.s}]) as w2, list_min([r3, {'c': 5 + r2.c, 's': 'I' || r2.s}]) as w3
    from (
      select l.conv_id, l.i - 1 as i,
        list_min([{'c': 2 + w0.c, 's': 'D' || w0.s}]
          || case when ok then [{'c': 1 + cut + w2.c, 's': 'R' || w2.s}] else [] end
          || case when ok and initial = 's' then [{'c': cut + w1.c, 's': 'K' || w1.s}] else [] end
          || case when ok and initial = 'u' then [{'c': cut + w2.c, 's': 'K' || w2.s}] else [] end) as r0,
        list_min([{'c': 2 + w1.c, 's': 'D' || w1.s}]
          || case when ok then [{'c': 1 + cut + w2.c, 's': 'R' || w2.s}] else [] end
          || case when ok and initial = 'u' then [{'c': cut + w2.c, 's': 'K' || w2.s}] else [] end) as r1,
        list_min([{'c': 2 + w2.c, 's': 'D' || w2.s}]
          || case when ok then [{'c': 1 + cut + w3.c, 's': 'R' || w3.s}] else [] end
          || case when ok and initial = 'a' then [{'c': cut + w3.c, 's': 'K' || w3.s}] else [] end) as r2,
        list_min([{'c': 2 + w3.c, 's': 'D' || w3.s}]
          || case when ok then [{'c': 1 + cut + w2.c, 's': 'R' || w2.s}] else [] end
          || case when ok and initial = 'u' then [{'c': cut + w2.c, 's': 'K' || w2.s}] else [] end) as r3
      from lattice l join (select *, fault not in (1, 2) as ok, case when fault = 3 then 5 else 0 end as cut from judged) j
        on j.conv_id is not distinct from l.conv_id and j.i = l.i))),
told as (
  select conv_id, w0.c as cost, w0.s as audit from lattice where i = 0),
edits as (
  select conv_id, audit, p, audit[p] as edit, (len(regexp_replace(audit[1:p], 'I', '', 'g')))::bigint as i,
         (len(regexp_replace(audit[1:p], 'D', '', 'g')))::bigint as e
  from (select conv_id, audit, unnest(range(1, len(audit) + 1)) as p from told)),
pieces as (
  select e.conv_id, e.p, e.e, e.edit, j.role, j.text, first_value(e.edit = 'K' and j.initial = 's') over (partition by e.conv_id order by e.p) as led
  from edits e left join judged j on j.conv_id is not distinct from e.conv_id and j.i = e.i and e.edit <> 'I'
  where e.edit <> 'D'),
made as (
  select conv_id, sha256(string_agg(
      case when edit = 'K' then role when (e - led::integer) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end,
      chr(10) order by p)) as repaired_sha256
  from pieces group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
       coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join figures f on c.conv_id is not distinct from f.conv_id
left join told t on c.conv_id is not distinct from t.conv_id
left join made m on c.conv_id is not distinct from m.conv_id
"""
