"""The filter audit against a plain version, and its tries against dictionaries."""

import random
import re
from itertools import permutations

import duckdb
import pytest
from brute import DOCS

from objwatch.llm import audit, tries
from objwatch.llm.audit import BIT

LABELS = "doc_id bigint, quality int, toxic int"


def plain(rows, labels):
    """{(part, order, step): counts} of (doc_id, text, source)."""
    fails, good, toxic = [], {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    for doc, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A"} if len(words) < 200 else set()
        own |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        own |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        own |= {"E"} if doc is not None and any(o is not None and o < doc and (x or "") == t for o, x, _ in rows) else set()
        fails.append((doc, part or "", own))
    out = {}
    for part in {p for _, p, _ in fails}:
        mine = [(d, own) for d, p, own in fails if p == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                here = [(d, own) for d, own in left if f in own]
                left = [(d, own) for d, own in left if f not in own]
                removed[f] += len(here)
                failing = [own for _, own in mine if f in own]
                out[part, "".join(order), k + 1] = [len(left), len(here), len(failing) - len(here), sum(own == {f} for own in failing), sum(d in good for d, _ in here), sum(d in toxic for d, _ in here)]
        for (p, order, k), x in out.items():
            if p == part:
                x.append(removed[order[k - 1]])
    return {k: tuple(x) for k, x in out.items()}


def run(spark, rows, labels, **more):
    docs = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], DOCS)
    marks = spark.createDataFrame(labels, LABELS)
    found = audit.audit(docs, marks).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found}
    assert len(got) == len(found)
    return got


def corpus(seed, n=150):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcde fgh\n") for _ in range(r.choice([3, 40, 2500]))) for _ in range(12)]
    pool += [" ".join(f"w{i}" for i in range(250)), "x " * 300, "UP " * 210, "a#b " * 5, "", None, "é中 " * 220, "same start " * 50 + "one", "same start " * 50 + "two", "same start " * 50]
    return [(r.choice([None, *range(80)]) if r.random() < 0.2 else i, r.choice(pool), r.choice(["a", "b", None])) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_audit_equals_plain_counts(spark, seed, monkeypatch):
    """Null ids, texts and sources, repeated rows and ids, many copies; blocks and ranges of few texts."""
    monkeypatch.setattr(tries.flag_copies, "__defaults__", (None, 7, 3000, 400))
    rows = corpus(seed)
    labels = [(i % 90, i % 2, int(i % 5 == 0)) for i in range(100)] + [(None, 1, 1), (3, None, None)]
    assert run(spark, rows, labels) == plain(rows, labels)


def test_audit_of_nothing(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(None, None, None)], []) == plain([(None, None, None)], [])


def test_very_long_texts_and_clashing_names(spark):
    long = "word " * 100_000
    rows = [(1, long + "a", "s"), (2, long + "b", "s"), (3, long + "a", "s"), (4, long, "t")]
    docs = spark.createDataFrame([(d, t, s, "x", 1, 2, "y") for d, t, s in rows], "doc_id bigint, text string, source string, part string, mask int, n int, key string")
    got = audit.label_counts(docs, spark.createDataFrame([(3, 0, 1)], LABELS)).collect()
    assert {(r["part"], r["mask"], r["n"], r["good"], r["toxic"]) for r in got} == {("s", BIT["B"], 2, 0, 0), ("s", BIT["B"] | BIT["E"], 1, 0, 1), ("t", BIT["B"], 1, 0, 0)}


def test_sql_equals_plain_counts(tmp_path):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(corpus(9, 60))]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 60, 2)]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    duck.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    found = duck.sql(f"SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM ({audit.ORACLE_SQL})").fetchall()
    assert {x[:3]: x[3:] for x in found} == plain(rows, labels)


@pytest.mark.parametrize("seed", range(4))
def test_trie_holds_each_text_once(seed):
    r = random.Random(seed)
    texts = [bytes(r.choice(b"ab") for _ in range(r.choice([0, 1, 5, 30, 31]))) for _ in range(400)]
    trie, want = tries.Trie(), {}
    for i, t in enumerate(texts):
        k = r.randrange(50)
        trie.insert(t, k, i)
        want.setdefault(t, []).append((k, i))
    assert sorted((least, sorted(rows)) for least, rows in trie.terminals()) == sorted((min(rows)[0], sorted(rows)) for rows in want.values())
    todo, nodes = [trie.root], 0
    while todo:
        node = todo.pop()
        nodes += 1
        assert node is trie.root or node.rows or len(node.children) > 1
        assert all(first == child.label[0] for first, child in node.children.items())
        todo += node.children.values()
    assert nodes <= 2 * len(want) + 1


def test_separators_follow_the_texts(spark):
    """Where texts begin alike, prefixes are as long as it takes to tell them apart; copies do not count."""
    texts = ["a" * 500 + f"{i:03d}" for i in range(200)] + ["hot copy"] * 5000 + [f"{i:02d}" for i in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = tries.separators(df, "text", sum(map(len, texts)), 16)
    assert found == sorted(set(found)) and 10 <= len(found) <= 15 and sum(len(x) > 500 for x in found) >= 8
    import bisect

    weights = [0] * 16
    for t in set(texts):
        weights[bisect.bisect_right(found, t.encode())] += 1
    assert max(weights) <= 2 * 251 / 16
