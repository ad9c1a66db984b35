"""Conversation structure repair: cheapest edits to legal turn order, by the auction algorithm for shortest paths.

A conversation's rows, in order, make a lattice: node (i, state) says that i rows are behind and which role came last
(nothing, system, user, assistant). Arcs take a row (Keep, Rerole, Delete) or Insert an empty turn beside it; their
lengths are the edits' integer costs, so a cheapest repair is a shortest path to a legal end.

*Auction.* Every node has a price, at first a lower bound of its distance to the end (what every path must pay for the
rows ahead), so that price <= length + next price holds on each arc. The path grows from the start along its least arc
while that arc is tight; where none is tight, the node's price rises to the least of length + next price and the path gives up
its last node. When the end is reached the start's price is the least cost, and exactly the tight arcs lie on cheapest
paths. Those are walked with Delete < Insert < Keep < Rerole; a node's arcs have different letters, so the first walk that
reaches the end is the least string.

*Long conversations.* Rows are dealt by range of (conversation, turn, role, text) and cut into fragments of at most
`FRAGMENT` rows, so a conversation of any length spreads over tasks and an auction stays small. Conversations of several
fragments get a 4 x 4 matrix per fragment (cost from entry to exit state, by auctions), folded backwards to the prices at the fragments'
borders; with these every fragment is traced by itself for each entry state. The last step streams a conversation's fragments
in order, joins the pieces and hashes the repaired text with constant memory (but for the audit, which is one string).
Copies of a row are one row with a count before they meet.

Defined cases: a null text, role, or id in the damage key counts as one space; a null turn sorts first; rows of one turn are
ordered by role and text; a null conversation id is a conversation. A role without a first letter can't be kept. Repeated
rows are rows: the later ones are duplicates. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footreach.session import cut_lineage

FRAGMENT, FRAGMENT_BYTES = 64, 4_000_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
INF = 1 << 60
E, S, U, A = range(4)
OTHER, NONE, BLANK, DUPLICATE, CUT = 3, 0, 1, 2, 3
_INITIALS = {"s": 0, "u": 1, "a": 2}
#: Where keeping a role's initial leads, by state: a legal order is (s?(ua)+)?.
_KEPT = {(E, 0): S, (E, 1): U, (S, 1): U, (A, 1): U, (U, 2): A}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_SPOKEN = re.compile("[^\x20\x09-\x0D]")
LAST_EXIT = [0, INF, INF, 0]


class Lattice:
    """Arcs and prices of one fragment. steps: (initial, fault, weight), a weight being that many forced deletions in a row."""

    def __init__(self, steps: list[tuple[int, int, int]], exits: list[int], last: bool):
        self.n, self.last, self.steps, self.exits = len(steps), last, steps, exits
        ahead = [min(exits)]
        for initial, fault, weight in reversed(steps):
            extra = TRUNCATED if fault == CUT else 0
            ahead.append(ahead[-1] + (DELETE * weight if fault in (BLANK, DUPLICATE) else min(DELETE, extra + (REROLE if initial == OTHER else KEEP))))
        ahead.reverse()
        self.price = [p for p in ahead for _ in range(4)]
        self.sink = 4 * (self.n + 1)
        self.price.append(0)
        self._arcs: dict[int, list] = {}

    def arcs(self, node: int) -> list[tuple[int, int, str]]:
        """(to, length, letter) in the order of the letters; leaving comes first, as it adds no letter."""
        known = self._arcs.get(node)
        if known is not None:
            return known
        i, state = divmod(node, 4)
        insert = (4 * i + (A if state == U else U), INSERT, "I")
        if i == self.n:
            out = [(self.sink, self.exits[state], "")] if self.exits[state] < INF else []
            if self.last:  # between fragments, what is inserted belongs to the next one
                out.append(insert)
        else:
            initial, fault, weight = self.steps[i]
            out = [(node + 4, DELETE * weight, "D"), insert]
            if fault not in (BLANK, DUPLICATE):
                extra = TRUNCATED if fault == CUT else 0
                to = _KEPT.get((state, initial))
                if to is not None:
                    out.append((4 * (i + 1) + to, KEEP + extra, "K"))
                out.append((4 * (i + 1) + (A if state == U else U), REROLE + extra, "R"))
        self._arcs[node] = out
        return out

    def auction(self, state: int) -> int:
        """Least cost from an entry state; prices stay valid for further calls."""
        price, path = self.price, [state]
        while path[-1] != self.sink:
            node, least, to = path[-1], INF, -1
            for nxt, length, _ in self.arcs(node):
                if length + price[nxt] < least:
                    least, to = length + price[nxt], nxt
            if price[node] < least:  # no tight arc: the price rises, the path contracts
                price[node] = least
                if len(path) > 1:
                    path.pop()
                elif least >= INF:
                    return INF
            else:
                path.append(to)
        return price[state]

    def trace(self, state: int) -> tuple[str, int]:
        """(letters, exit state) of the least string among the cheapest paths: depth first over tight arcs. After `auction`."""
        price, dead = self.price, set()
        path, at, letters = [state], [0], []
        while path[-1] != self.sink:
            node, arcs = path[-1], self.arcs(path[-1])
            if at[-1] == len(arcs):
                dead.add(path.pop())
                at.pop()
                letters.pop()
                continue
            to, length, letter = arcs[at[-1]]
            at[-1] += 1
            if to not in dead and price[node] == length + price[to]:
                letters.append(letter * (self.steps[node // 4][2] if letter == "D" else 1))
                path.append(to)
                at.append(0)
        return "".join(letters), path[-2] % 4


def steps_of(codes: list[int], copies: list[int]) -> list[tuple[int, int, int]]:
    """Rows with counts as lattice steps: later copies of a row are duplicates, deleted together."""
    out = []
    for code, n in zip(codes, copies):
        initial, fault = code & 3, code >> 2
        if fault in (BLANK, DUPLICATE):
            out.append((initial, fault, n))
        else:
            out.append((initial, fault, 1))
            if n > 1:
                out.append((initial, DUPLICATE, n - 1))
    return out


def reaches(steps: list, entry: int, leave: int) -> bool:
    """Whether an exit state can follow an entry state at all: nothing leads back to the first two states."""
    if leave == S:
        return entry == S or entry == E and any(i == 0 and f not in (BLANK, DUPLICATE) for i, f, _ in steps)
    return leave > S or entry == E


# ---- rows ----------------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """conv (text key), turn, role, text, copies: the rows after the seeded damage."""
    base = conversations.selectExpr(
        "CASE WHEN conv_id IS NULL THEN 'null' ELSE concat('=', conv_id) END AS conv", "cast(turn AS bigint) AS turn", "coalesce(cast(role AS string), ' ') AS role",
        "coalesce(cast(text AS string), ' ') AS text", "crc32(concat(coalesce(cast(conv_id AS string), ' '), ':', coalesce(cast(turn AS string), ' '))) % 20 AS hit")
    return base.filter("hit <> 0").selectExpr(
        "conv", "turn", "CASE WHEN hit = 4 THEN 'user' ELSE role END AS role",
        "CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '') ELSE text END AS text", "CASE WHEN hit = 3 THEN 2L ELSE 1L END AS copies")


_FRAGMENTS = "conv string, part int, frag bigint, turns array<bigint>, roles array<string>, texts array<string>, copies array<bigint>, codes array<int>"


def _code(role: str, text: str, later: bool) -> int:
    spoken = _SPOKEN.search(text)
    if not spoken:
        fault = BLANK
    elif later:
        fault = DUPLICATE
    else:
        fault = NONE if text.rstrip("\x20\t\n\x0b\x0c\r")[-1] in ".!?" else CUT
    return _INITIALS.get(role[:1], OTHER) | fault << 2


def _cut_fragments(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place, cut into fragments."""
    part, serial, conv, rows, size, out = TaskContext.get().partitionId(), 0, None, [], 0, []
    schema = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("frag", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
                        ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32()))])

    def close():
        nonlocal rows, size, serial
        if rows:
            out.append((conv, part, serial, *map(list, zip(*rows))))
            serial += 1
        rows, size = [], 0

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return made

    held = 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            for c, turn, role, text, copies, later in zip(*(x.to_pylist() for x in b.slice(at, 256).columns)):
                if c != conv or len(rows) >= limit or size >= FRAGMENT_BYTES:
                    close()
                    conv = c
                rows.append((turn, role, text, copies, _code(role, text, later)))
                size += len(text)
                held += len(text)
            if held > FRAGMENT_BYTES and out:
                yield batch()
                held = 0
    close()
    if out:
        yield batch()


def fragments(rows: DataFrame, limit: int = FRAGMENT) -> DataFrame:
    """Damaged rows as fragments in the order of (part, frag) within a conversation."""
    one = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    keyed = one.withColumn("digest", F.md5("text")).withColumn("place", place)
    firsts = keyed.groupBy("conv", "role", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marked = keyed.join(firsts, ["conv", "role", "digest"], "left").select("conv", "turn", "role", "text", "copies", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("later"))
    order = ["conv", "turn", "role", "text"]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _cut_fragments(batches, limit), _FRAGMENTS)


# ---- borders of long conversations ---------------------------------------------------------------

def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        costs = []
        for codes, copies, last in zip(*(b.column(c).to_pylist() for c in ("codes", "copies", "last"))):
            steps, m = steps_of(codes, copies), [INF] * 16
            for leave in range(4):
                lat = Lattice(steps, [0 if e == leave else INF for e in range(4)], last)
                for entry in range(4):
                    if reaches(steps, entry, leave):
                        m[4 * entry + leave] = lat.auction(entry)
            costs.append(m)
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), b.column("frag"), pa.array(costs, pa.list_(pa.int64()))], names=["conv", "part", "frag", "m"])


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Prices at the end of each fragment of one conversation, from its last fragment backwards (16 numbers a fragment)."""
    pdf = pdf.sort_values(["part", "frag"], ascending=False)
    exits, out = LAST_EXIT, []
    for m in pdf["m"]:
        out.append(exits)
        exits = [min(INF, min(int(m[4 * s + e]) + exits[e] for e in range(4))) for s in range(4)]
    return pdf[["conv", "part", "frag"]].assign(exits=out)


def _trace_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters and exit state for each entry state that can lead to the end."""
    for b in batches:
        audits, ends = [], []
        for codes, copies, last, exits in zip(*(b.column(c).to_pylist() for c in ("codes", "copies", "last", "exits"))):
            lat = Lattice(steps_of(codes, copies), exits, last)
            traced = [lat.trace(s) if lat.auction(s) < INF else ("", -1) for s in range(4)]
            audits.append([t[0] for t in traced])
            ends.append([t[1] for t in traced])
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), b.column("frag"), pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))],
                                         names=["conv", "part", "frag", "audits", "ends"])


def border_traces(frags: DataFrame) -> DataFrame:
    """conv, part, frag, audits, ends for the fragments of conversations that have several."""
    many = frags.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("part", "frag")).alias("end")).filter("n > 1").drop("n")
    light = frags.select("conv", "part", "frag", "codes", "copies").join(many, "conv").withColumn("last", F.col("end") == F.struct("part", "frag")).drop("end")
    tasks = int(frags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = cut_lineage(light.repartition(tasks, "conv", "part", "frag"))  # a long conversation's auctions go to all tasks, however few bytes they are
    costs = light.mapInArrow(_matrices, "conv string, part int, frag bigint, m array<bigint>")
    exits = costs.groupBy("conv").applyInPandas(_fold, "conv string, part int, frag bigint, exits array<bigint>")
    return light.join(exits, ["conv", "part", "frag"]).mapInArrow(_trace_all, "conv string, part int, frag bigint, audits array<string>, ends array<int>")


# ---- joining the pieces --------------------------------------------------------------------------

class _Report:
    """What is said of one conversation while its fragments pass."""

    def __init__(self, conv: str):
        self.conv, self.counts = conv, [0] * 4
        self.illegal = self.cost = self.turns = 0
        self.low = self.high = self.before = None
        self.state, self.audit, self.sha, self.said = E, [], hashlib.sha256(), False

    def say(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.said else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.said = True

    def add(self, turns, roles, texts, copies, codes, audit: str) -> None:
        for turn, n, code in zip(turns, copies, codes):
            fault, initial = code >> 2, code & 3
            if fault in (BLANK, DUPLICATE):
                self.counts[fault] += n
            else:
                self.counts[fault] += 1
                self.counts[DUPLICATE] += n - 1
            self.illegal += n - 1 + (self.before is not None and (self.before, initial) not in _LEGAL)
            self.before = initial
            if turn is not None and turn != self.high:
                self.turns += 1
                self.low = turn if self.low is None else self.low
                self.high = turn
        self.audit.append(audit)
        at, row = 0, 0
        while at < len(audit):
            letter, own = audit[at], "assistant" if self.state == U else "user"
            if letter == "I":
                self.say(own, "")
                self.cost += INSERT
                self.state = A if self.state == U else U
                at += 1
                continue
            if letter == "D":
                self.cost += DELETE * copies[row]
            else:
                self.cost += (REROLE if letter == "R" else KEEP) + (TRUNCATED if codes[row] >> 2 == CUT else 0) + DELETE * (copies[row] - 1)
                self.say(own if letter == "R" else roles[row], texts[row])
                self.state = (A if self.state == U else U) if letter == "R" else _KEPT[self.state, codes[row] & 3]
            at += copies[row]
            row += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


_REPORT = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in order, each behind its traces if its conversation has several."""
    report, traced, out = None, None, []
    names = [c.split(" ")[0] for c in _REPORT.split(", ")]

    def batch():
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        out.clear()
        return made

    for b in batches:
        for at in range(0, b.num_rows, 64):
            for conv, turns, roles, texts, copies, codes, audits, ends in zip(*(b.slice(at, 64).column(c).to_pylist() for c in ("conv", "turns", "roles", "texts", "copies", "codes", "audits", "ends"))):
                if report is None or report.conv != conv:
                    if report:
                        out.append(report.row())
                    report = _Report(conv)
                if audits is not None:
                    traced = audits, ends
                    continue
                if traced is None:
                    lat = Lattice(steps_of(codes, copies), LAST_EXIT, True)
                    lat.auction(E)
                    audit = lat.trace(E)[0]
                else:
                    audit, traced = traced[0][report.state], None
                report.add(turns, roles, texts, copies, codes, audit)
            if len(out) > 1000:
                yield batch()
    if report:
        out.append(report.row())
    if out:
        yield batch()


def repaired(conversations: DataFrame, rows: DataFrame | None = None, fragment: int = FRAGMENT) -> DataFrame:
    """One row per conversation id of `conversations`: its faults, the cheapest edits and the digest of the repaired turns.

    `rows` (conv, turn, role, text, copies; by default the damaged conversations) are what is repaired.
    """
    frags = cut_lineage(fragments(damage(conversations) if rows is None else rows, fragment))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("audits", "array<string>"), ("ends", "array<int>"))]
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("turns", "array<bigint>"), ("roles", "array<string>"), ("texts", "array<string>"), ("copies", "array<bigint>"), ("codes", "array<int>"))]
    traces = border_traces(frags).select("conv", "part", "frag", F.lit(0).alias("kind"), *empty, "audits", "ends")
    stream = frags.select("conv", "part", "frag", F.lit(1).alias("kind"), "turns", "roles", "texts", "copies", "codes", *nothing).unionByName(traces)
    found = stream.repartition("conv").sortWithinPartitions("conv", "part", "frag", "kind").mapInArrow(_chain, _REPORT)
    ids = conversations.select("conv_id").distinct().withColumn("conv", F.expr("CASE WHEN conv_id IS NULL THEN 'null' ELSE concat('=', conv_id) END"))
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, "conv", "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                                                  F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op11(spark, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# ---- the same in SQL -----------------------------------------------------------------------------

def _best(*options: tuple[str, str, str, str]) -> str:
    """Least (cost, audit) among options (condition, cost, audit, repaired) as a struct."""
    made = [f"CASE WHEN {cond} THEN {{'c': {cost}, 'a': {audit}, 't': {text}}} END" for cond, cost, audit, text in options]
    return f"list_sort(list_filter([{', '.join(made)}], lambda x: x IS NOT NULL))[1]"


def _taken(state: str) -> str:
    """Best way onward from a state by taking the row of level i; b.e .. b.a are the bests behind it."""
    def said(role, nxt):
        return f"concat({role}, ':', text, CASE WHEN ({nxt}).t IS NULL THEN '' ELSE concat(chr(10), ({nxt}).t) END)"
    nxt, role = ("b.a", "'assistant'") if state == "u" else ("b.u", "'user'")
    options = [("true", f"(b.{state}).c + 3", f"concat('D', (b.{state}).a)", f"(b.{state}).t"), ("NOT forced", f"({nxt}).c + 2 + cut", f"concat('R', ({nxt}).a)", said(role, nxt))]
    for initial, to in {"e": (("s", "b.s"), ("u", "b.u")), "s": (("u", "b.u"),), "a": (("u", "b.u"),), "u": (("a", "b.a"),)}[state]:
        options.append((f"NOT forced AND left(role, 1) = '{initial}'", f"({to}).c + cut", f"concat('K', ({to}).a)", said("role", to)))
    return _best(*options)


def _closed(state: str) -> str:
    """The same after inserting up to two turns before the row."""
    def put(roles, nxt):
        return f"concat('{roles}', CASE WHEN ({nxt}).t IS NULL THEN '' ELSE concat(chr(10), ({nxt}).t) END)"
    after_one, one = ("a", "assistant:") if state == "u" else ("u", "user:")
    after_two, two = ("u", "assistant:\\nuser:") if state == "u" else ("a", "user:\\nassistant:")
    options = [("true", f"r{state}.c", f"r{state}.a", f"r{state}.t"), ("true", f"r{after_one}.c + 2", f"concat('I', r{after_one}.a)", put(one, f"r{after_one}")),
               ("true", f"r{after_two}.c + 4", f"concat('II', r{after_two}.a)", put(two, f"r{after_two}"))]
    return _best(*options).replace("'assistant:\\nuser:'", "concat('assistant:', chr(10), 'user:')").replace("'user:\\nassistant:'", "concat('user:', chr(10), 'assistant:')")


OP11_SQL = f"""
WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) AS k FROM conversations),
hit AS (SELECT *, xor(list_reduce(list_prepend(4294967295::bigint, range(8 * length(k))),
  lambda c, i: xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(k, (i // 8 + 1)::bigint, 1)) ELSE 0 END) >> 1,
    CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(k, (i // 8 + 1)::bigint, 1)) ELSE 0 END) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS h FROM base),
bad AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM bad),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  regexp_extract(text, '[^\\x20\\x09-\\x0D]([\\x20\\x09-\\x0D]*)$') AS tail FROM placed),
faults AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN left(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM seen),
lattice AS (SELECT conv_id, i, role, text, coalesce(fault IN ('blank', 'duplicate'), false) AS forced, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM faults),
sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND concat(before, left(role, 1)) NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY 1),
back AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': '', 't': NULL::varchar}} AS e, {{'c': 4, 'a': 'II', 't': concat('user:', chr(10), 'assistant:')}} AS s,
    {{'c': 2, 'a': 'I', 't': 'assistant:'}} AS u, {{'c': 0, 'a': '', 't': NULL::varchar}} AS a FROM sums
  UNION ALL
  SELECT conv_id, i, {_closed('e')}, {_closed('s')}, {_closed('u')}, {_closed('a')} FROM (
    SELECT b.conv_id, l.i, {_taken('e')} AS re, {_taken('s')} AS rs, {_taken('u')} AS ru, {_taken('a')} AS ra
    FROM back b JOIN lattice l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.i = b.i - 1))
SELECT c.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.e.c, 0)::bigint AS cost, coalesce(b.e.a, '') AS audit, sha256(coalesce(b.e.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1"""
