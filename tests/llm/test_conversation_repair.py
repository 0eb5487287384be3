"""Conversation repair against a plain search over all edits, and the query against its contract in Python."""

import hashlib
import random
import re
import zlib
from array import array

import pytest
from pyspark.sql import functions as F

from granary.llm import conversation_repair as cr

GRAMMAR = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, audit string, lead int, digest string"


def plain(initials, faults):
    """(cost, audit, roles of edits) by dynamic programming from the end, strings and all."""
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    table = {0: (0, ""), 3: (0, "")}

    def inserts(layer):
        for _ in range(4):
            for q, to in steps.items():
                for c, t in to.items():
                    if c != "s" and t in layer:
                        option = (layer[t][0] + 5, "I" + layer[t][1])
                        layer[q] = min(layer.get(q, option), option)
        return layer

    table = inserts(table)
    for initial, fault in zip(reversed(initials), reversed(list(faults))):
        new = {}
        for q in steps:
            options = [(table[q][0] + 2, "D" + table[q][1])]
            if fault not in (cr.BLANK, cr.DUPLICATE):
                more = 5 if fault == cr.CUT else 0
                options += [(table[t][0] + more, "K" + table[t][1]) for c, t in steps[q].items() if c == initial]
                options += [(table[t][0] + more + 1, "R" + table[t][1]) for c, t in steps[q].items() if c != "s"]
            new[q] = min(options)
        table = inserts(new)
    return table[0]


@pytest.mark.parametrize("seed", range(6))
def test_search(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n = rng.randint(0, 12 if seed else 4)
        initials = [rng.choice("uauas x" if seed % 2 else "ua") for _ in range(n)]
        faults = array("b", [rng.choice([0, 0, 0, 1, 2, 3] if seed % 3 else [0, 3]) for _ in range(n)])
        assert cr.search(initials, faults) == plain(initials, faults)


def test_long_conversation():
    rng = random.Random(1)
    initials, faults = [rng.choice("uas") for _ in range(3000)], array("b", [rng.choice([0, 0, 0, 3, 1]) for _ in range(3000)])
    assert cr.search(initials, faults) == plain(initials, faults)


def contract(rows):
    """The contract's results, row by row."""
    blank, last = (lambda t: not t.strip(" \t\n\x0b\x0c\r")), (lambda t: t.rstrip(" \t\n\x0b\x0c\r")[-1])
    convs = {}
    for conv, turn, role, text in rows:
        known = lambda v: " " if v is None else str(v)
        code, kept = zlib.crc32(f"{known(conv)}:{known(turn)}".encode()) % 20, convs.setdefault(conv, [])
        role, text = known(role), known(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        kept += [] if code == 0 else [(turn, role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in kept:
            faults.append(1 if blank(text) else 2 if (role, text) in seen else 3 if last(text) not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in kept]
        cost, audit = plain(initials, faults)
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        rest, made, state = iter(kept), [], ""
        for edit in audit:
            row = next(rest) if edit != "I" else None
            if edit == "K":
                made.append((row[1], row[2]))
            elif edit in "RI":
                role = "user" if (state or "s")[-1] in "sa" else "assistant"
                made.append((role, row[2] if row else ""))
            state = "".join(r[0][0] for r in made)
        assert GRAMMAR.fullmatch(state)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest, made))
    return out


@pytest.fixture(scope="module")
def talks(spark):
    rng, rows = random.Random(6), []
    for conv in [*range(150), None]:
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(["Yes.", "No!", "Cut off", "", " \n", "Why?", None, "Naïve — 漢字.", "x" * rng.randint(1, 50) + "."])
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant"] * 6 + ["system", "tool", None, "unknown"]), text))
    rows += [(900, 0, "user", "Again."), (900, 0, "user", "Again."), (900, 0, "assistant", "Same turn."), (901, None, None, None)]
    rows += [(950, t, ("user", "assistant")[t % 2], f"{t} " + "long " * 200 + ".") for t in range(3000)]  # one long conversation
    return rows, spark.createDataFrame([(*r, False, "x", 1, "y") for r in rows], SCHEMA).repartition(3).cache()


def test_query(spark, talks, tmp_path):
    rows, df = talks
    df.select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = cr.op13_conversation_repair(spark, str(tmp_path))
    names = ["conv_id", *[f.split()[0] for f in cr.REPORT.split(", ")], "repaired_sha256"]
    assert sorted([tuple(r) for r in got.select(names).collect()], key=str) == sorted([x[:-1] for x in contract(rows)], key=str)


def test_repair(spark, talks):
    rows, df = talks
    hurt, gone = cr.damage(df)
    got = {}
    for r in cr.repair(hurt, absent=F.col(gone)).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {x[0]: x[-1] for x in contract(rows) if x[-1]}


def test_clean_conversations_stay(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Words {t}.") for c in range(5) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {(r.audit, r.cost) for r in cr.audits(df).collect()} == {("KKKK", 0)}
    assert sorted(map(tuple, cr.repair(df).collect())) == rows


def test_text_ids_and_empty_table(spark):
    kind = "conv_id string, turn int, role string, text string"
    assert cr.audits(spark.createDataFrame([], kind)).count() == cr.repair(spark.createDataFrame([], kind)).count() == 0
    one = spark.createDataFrame([("a", 1, "", "x."), ("a", 2, "user", "Hi."), ("a", 3, "assistant", "Ho.")], kind)
    assert [tuple(r) for r in cr.repair(one).collect()] == [("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho.")]
