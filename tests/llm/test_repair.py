"""Conversation repair: the auction against plain search, whole conversations against plain Python, and the SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from footreach.llm import repair

SPOKEN = re.compile("[^\x20\x09-\x0D]")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damaged(rows):
    """Rows (conv, turn, role, text) of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 1:
            text = ""
        elif hit == 2:
            text = re.sub("[.!?]", "", text)
        elif hit == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = SPOKEN.findall(text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired turns) by a uniform-cost search over whole strings: the first one to reach the end is the least."""
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, state, turns = heapq.heappop(todo)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, turns
        if (cost, audit, i, state) in done:
            continue
        done.add((cost, audit, i, state))
        own = "assistant" if state == "u" else "user"
        if not audit.endswith("III"):
            heapq.heappush(todo, (cost + 2, audit + "I", i, own[0], turns + ((own, ""),)))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, state, turns))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                heapq.heappush(todo, (cost + 2 + extra, audit + "R", i + 1, own[0], turns + ((own, text),)))
                if (state, role[:1]) in NEXT:
                    heapq.heappush(todo, (cost + extra, audit + "K", i + 1, NEXT[state, role[:1]], turns + ((role, text),)))


def expected(conv, rows):
    rows = damaged(rows)
    faults = faults_of(rows)
    cost, audit, turns = cheapest(rows, faults)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    said = "\n".join(f"{r}:{t}" for r, t in turns)
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())


def made(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "What?  ", " \t", "", None, "and then", "ok!", "é…"]
    rows = []
    for c in [*range(convs), None]:
        for k in range(rng.randint(1, most)):
            turn = rng.choice([k, k, k, k + 2, None])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("fragment", [2, 256])
def test_repairs_equal_plain_search(spark, fragment):
    rows = made(3, 60, 9) + [(900, 0, "user", "Same.")] * 7 + [(901, None, None, None)] * 3
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS audit", "1 AS conv").repartition(7)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = {c: expected(c, x) for c, x in by.items()}
    got = {r.conv_id: tuple(r) for r in repair.repaired(df, fragment=fragment).collect()}
    assert got == want


def test_the_sql_says_the_same(spark):
    rows = made(5, 80, 8)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(con.sql(repair.OP11_SQL).fetchall(), key=key)
    assert sorted(map(tuple, repair.repaired(df).collect()), key=key) == want


def test_a_long_conversation_is_the_same_in_one_fragment_and_in_many(spark):
    rng = random.Random(8)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice([f"Line {k}.", f"line {k}", "Again."])) for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    one, many = (repair.repaired(df, fragment=f).collect() for f in (1000, 16))
    assert one == many and len(one[0].audit) > 600


def test_prices_are_distances_and_tight_arcs_lie_on_cheapest_paths():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(k, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "a", "", "b.", "c"])) for k in range(rng.randint(0, 7))]
        faults = faults_of(rows)
        codes = [{"s": 0, "u": 1, "a": 2}.get(r[1][0], 3) | {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f] << 2 for r, f in zip(rows, faults)]
        lat = repair.Lattice(repair.steps_of(codes, [1] * len(codes)), repair.LAST_EXIT, True)
        cost, audit, _ = cheapest(rows, faults)
        assert (lat.auction(repair.E), lat.trace(repair.E)[0]) == (cost, audit)
        assert all(lat.price[n] <= length + lat.price[to] for n, arcs in lat._arcs.items() for to, length, _ in arcs)


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.repaired(df).count() == 0
    gone = spark.createDataFrame([(c, 0, "user", "Hi.") for c in range(40)], "conv_id bigint, turn bigint, role string, text string")
    empty = [r for r in repair.repaired(gone).collect() if zlib.crc32(f"{r.conv_id}:0".encode()) % 20 == 0]
    assert empty and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in empty)
