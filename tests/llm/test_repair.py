"""Repair of conversations against exhaustive search and a plain dynamic program."""

import hashlib
import random
import re
import zlib

import pytest

from objwatch.llm import repair

ROWS = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        out += [(conv, turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def faults(rows):
    """[(initial, fault)] of a conversation's rows in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def cheapest(rows):
    """(cost, audit) by backward dynamic programming over whole edit strings."""
    go = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    known = faults(rows)
    best = None
    for i in range(len(known), -1, -1):
        new = []
        for q in range(4):
            ways = []
            if i == len(known):
                ways += [(0, "")] if q in (0, 3) else []
            else:
                r, fault = known[i]
                ways.append((best[q][0] + 2, "D" + best[q][1]))
                if fault not in ("blank", "duplicate"):
                    late = 5 * (fault == "truncated")
                    ways += [(best[go[q][w]][0] + late + (w != r), ("R" if w != r else "K") + best[go[q][w]][1]) for w in ("u", "a", *("s" if r == "s" else "")) if w in go[q]]
            new.append(min(ways, default=(10**9, "")))
        for _ in range(4):
            new = [min(new[q], *[(new[go[q][w]][0] + 5, "I" + new[go[q][w]][1]) for w in "ua" if w in go[q]]) for q in range(4)]
        best = new
    return best[0]


def exhaustive(rows, most=3):
    known, found = faults(rows), []

    def go(i, left, cost, audit, roles):
        if i == len(known) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if left:
            for w in "ua":
                go(i, left - 1, cost + 5, audit + "I", roles + w)
        if i < len(known):
            r, fault = known[i]
            go(i + 1, left, cost + 2, audit + "D", roles)
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                go(i + 1, left, cost + late, audit + "K", roles + (r or "?"))
                for w in "ua":
                    go(i + 1, left, cost + late + 1, audit + "R", roles + w)

    go(0, most, 0, "", "")
    return min(found)


def repaired(rows, audit):
    left, out = list(rows), []
    for e in audit:
        want = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if e == "I":
            out.append((want, ""))
            continue
        _, _, role, text = left.pop(0)
        if e != "D":
            out.append((role if e == "K" else want, text))
    assert not left
    return out


def plain(rows):
    out, convs = {}, {r[0] for r in rows}
    for conv in convs:
        mine = in_order([r for r in damaged(rows) if r[0] == conv])
        turns = {t for _, t, _, _ in mine if t is not None}
        known = faults(mine)
        count = lambda f: sum(x == f for _, x in known)  # noqa: E731, B023
        pairs = [a[0] + b[0] for a, b in zip(known, known[1:], strict=False)]
        cost, audit = cheapest(mine)
        text = "\n".join(f"{r}:{t}" for r, t in repaired(mine, audit))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversation(r, conv, n):
    texts = ["Yes.", "No", "What?", "Go!", " ", "", None, "Long words \n", "End. \t", "é 中。", "x" * 300 + "."]
    return [(conv, r.choice([None, 3]) if r.random() < 0.1 else k, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ultra"]), r.choice(texts)) for k in range(n)]


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, ROWS).withColumnsRenamed({}).selectExpr("*", "1 as place", "'x' as audit", "2 as kind").write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_repair(spark, str(tmp_path)).collect()
    out = {r["conv_id"]: tuple(r[c] for c in (*repair.PLAN, "repaired_sha256")) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("seed", range(150))
def test_lattice_equals_exhaustive_search(seed):
    r = random.Random(seed)
    rows = [(1, k, role or " ", text or " ") for k, (_, _, role, text) in enumerate(conversation(r, 1, r.randrange(6)))]
    codes = "".join("d" if f in ("blank", "duplicate") else (c if c in ("s", "u", "a") else "x").upper() if f == "truncated" else c if c in ("s", "u", "a") else "x" for c, f in faults(rows))
    assert repair.Lattice().cheapest(codes) == cheapest(rows) == exhaustive(rows)


def test_one_lattice_for_many_and_long_conversations():
    r, lattice = random.Random(5), repair.Lattice()
    for n in (0, 1, 7, 40, 300):
        rows = [(1, k, role or " ", (text or " ") + str(k) * (k % 3)) for k, (_, _, role, text) in enumerate(conversation(r, 1, n))]
        codes = "".join("d" if f in ("blank", "duplicate") else (c if c in ("s", "u", "a") else "x").upper() if f == "truncated" else c if c in ("s", "u", "a") else "x" for c, f in faults(rows))
        assert lattice.cheapest(codes) == cheapest(rows)
    cost, audit = lattice.cheapest("ua" * 100_000 + "u" + "ua" * 100_000)
    assert (cost, len(audit)) == (2, 400_001) and len(lattice.columns) < 200


def test_query_equals_plain_version(spark, tmp_path):
    """Nulls everywhere, repeated rows and turns, conversations of one id that fall to nothing, clashing names."""
    r = random.Random(11)
    rows = [x for c in range(60) for x in conversation(r, c, r.randrange(1, 12))] + conversation(r, None, 9) + conversation(r, 999, 70)
    rows += [x for x in rows if r.random() < 0.1]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Hi."), (2001, None, None, None)]
    want = plain(rows)
    assert want[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, tmp_path, rows) == want


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (1, 4, "assistant", "Yes."), (1, 5, "user", "cut"), (2, 0, "user", "")]
    got = [tuple(x) for x in repair.repair(spark.createDataFrame(rows, ROWS)).orderBy("conv_id", "place").collect()]
    assert got == [(1, 1, "system", "Be kind."), (1, 2, "user", "Hello?"), (1, 3, "assistant", "Yes.")]
    assert [tuple(x) for x in repair.plans(spark.createDataFrame(rows, ROWS)).orderBy("conv_id").collect()] == [(1, 1, 0, 0, 1, 1, 4, "KDKKD"), (2, 0, 1, 0, 0, 0, 2, "D")]


def test_no_conversations(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}
