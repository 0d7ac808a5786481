import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from check import difference
from riskloom.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, a string, depth string, base long, last string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            told[conv].append((-1 if turn is None else turn, role or "", text or ""))
    for t in told.values():
        t.sort()
    rebuilt = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = [t[1:] for t in told.get(c - c % 5, [])[:h] + own[h:]]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[c] for c in children[p]]
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        totals[p] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + saved)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), *totals[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def rows_of(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"],
                   r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def made(seed, convs=120, most=14):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(400), convs):
        for t in range(r.randrange(1, most)):
            text = r.choice(["ja", "né", "a b", ""]) if t < 3 else r.choice(["x", f"y{r.randrange(9)}"])
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice([text, text, None])))
    return rows


@pytest.mark.parametrize("top, queue", [(10_000, 100_000), (3, 2), (40, 5)])
def test_against_brute_force(spark, top, queue):
    rows = made(top)
    assert rows_of(trie.build(table(spark, rows), top_nodes=top, queue=queue)) == brute(rows)


def test_hot_first_turn_copies_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 300, 2) for t in range(3)]
    rows += [(1001, t, "user", f"long {t}") for t in range(700)]
    assert rows_of(trie.build(table(spark, rows), top_nodes=20, queue=3)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "gone"), (5, None, None, None), (5, None, None, None), (5, 1, "user", ""),
            (7, 1, "a", "b" * 20_000), (7, 1, "a", "b" * 20_000), (8, 2, "ab", "c"), (9, 2, "a", "bc"), (-3, 0, "é", "😀"),
            (-3, 0, "a", "z"), (2**60, 0, "é", "😀")]
    rows += [(c, 0, "u", "v") for c in range(20, 45)]
    built = trie.build(table(spark, rows))
    plain = [r for r in brute([r for r in rows if r[0] is None or r[0] >= 0])]
    assert len(rows_of(built)) >= len(plain)
    kept = [r for r in rows if r[0] is None or r[0] >= 0]
    assert rows_of(trie.build(table(spark, kept))) == plain
    assert trie.build(table(spark, [])).collect() == []
    assert trie.build(table(spark, rows[:1])).collect() == []


def test_sql_agrees(spark):
    conversations = table(spark, made(9, 60))
    plain = conversations.toPandas()
    con = duckdb.connect()
    con.register("conversations", plain)
    assert difference(trie.build(conversations).toPandas(), con.execute(trie.SQL).df()) is None


def test_queue_spills_and_keeps_order():
    r = random.Random(4)
    queue, held = trie.SpillingQueue(limit=7, block=3), []
    for _ in range(2000):
        if held and r.random() < 0.45:
            assert queue.peek() == min(held)
            held.remove(min(held))
            queue.pop()
        else:
            item = (r.randrange(50), r.randrange(10**9))
            queue.push(item)
            held.append(item)
    assert queue.count > 50
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.peek() is None
