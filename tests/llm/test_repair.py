"""Repairs against a full search, and long conversations against whole ones."""

import hashlib
import itertools
import random
import zlib

from pyspark.sql import functions as F

from depweave.llm import repair
from depweave.llm.edit_lattice import BLANK, DUPLICATE, TRUNCATED, cheapest, replay

SCHEMA = "conv_id long, turn long, role string, text string"


def good(initials):
    if initials[:1] == ["s"]:
        initials = initials[1:]
        if not initials:
            return False
    return len(initials) % 2 == 0 and all(x == "ua"[k % 2] for k, x in enumerate(initials))


def all_edits(rows, most):
    """The least (cost, audit) over every sequence of edits with up to ``most`` insertions."""
    best = None
    for inserted in range(most + 1):
        for places in itertools.combinations_with_replacement(range(len(rows) + 1), inserted):
            options = []
            for k in range(len(rows) + 1):
                options += [[("I", "u", 5), ("I", "a", 5)]] * places.count(k)
                if k < len(rows):
                    initial, fault = rows[k]
                    more = 5 if fault == TRUNCATED else 0
                    options.append([("D", "", 2)] + ([] if fault in (BLANK, DUPLICATE) else [("K", initial, more), ("R", "u", 1 + more), ("R", "a", 1 + more)]))
            for way in itertools.product(*options):
                if good([x for e, x, _ in way if e != "D"]):
                    one = (sum(c for _, _, c in way), "".join(e for e, _, _ in way))
                    best = one if best is None or one < best else best
    return best


def test_cheapest_edits_are_the_least_of_all():
    rng = random.Random(3)
    for _ in range(250):
        rows = [(rng.choice("suaax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 4))]
        assert cheapest(rows) == all_edits(rows, 2), rows


def brute(rows):
    """The contract over a list of (conv_id, turn, role, text), one conversation after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 1:
                text = ""
            elif kind == 2:
                text = "".join(x for x in text if x not in ".!?")
            elif kind == 4:
                role = "user"
            after += [(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        after.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        turns = [x[2:] for x in after]
        marks = []
        for k, (role, text) in enumerate(turns):
            said = [x for x in text if x not in " \t\n\x0b\x0c\r"]
            marks.append(1 if not said else 2 if (role, text) in turns[:k] else 3 if said[-1] not in ".!?" else 0)
        numbers = {x[1] for x in after if x[0]}
        cost, audit = cheapest([(r[:1], m) for (r, _), m in zip(turns, marks)])
        said = "\n".join(f"{r}:{t}" for r, t in replay(audit, turns))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (gaps, *(marks.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def odd_rows():
    rng = random.Random(9)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([0, 1, 2, 5, 9, 40])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "  \t\n", "", None, "cut off", "x. ", "Why?", f"Word {rng.random()}.", "é" * 3000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += rows[:7]  # repeated rows
    return rows


def as_dict(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_reports_of_odd_rows_short_and_long(spark):
    rows = odd_rows()
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("clash")).withColumn("kind", F.lit(1))
    want = brute(rows)
    assert as_dict(repair.report(repair.damaged(turns))) == want
    assert as_dict(repair.report(repair.damaged(turns), block=3)) == want  # most are searched block by block
    parts = repair.repaired(repair.damaged(turns), block=3).orderBy("conv_id", "block", "turn").collect()
    for conv in {r["conv_id"] for r in parts}:
        said = "\n".join(f"{r['role']}:{r['text']}" for r in parts if r["conv_id"] == conv)
        assert hashlib.sha256(said.encode()).hexdigest() == want[conv][-1]
        assert good([r["role"][:1] for r in parts if r["conv_id"] == conv])


def test_one_conversation_of_most_rows(spark):
    rng = random.Random(2)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Turn {k}."])) for k in range(3000)] + [(2, 0, "user", "Hi.")]
    assert as_dict(repair.report(repair.damaged(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_nothing(spark):
    assert repair.report(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    dropped = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = as_dict(repair.report(repair.damaged(spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA))))
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
