"""Verdicts that the methods add to the base results, against plain Python: key spans and owners, compression bands."""

import random
import re

import duckdb
import pytest
import zstandard
from brute import ASSIGN, quality_base
from edges import ROWS, SF

from footreach.llm import quality, secrets

KEYED = re.compile(r"(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk|pk|rk)[_-][A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|[A-Za-z0-9+/_-]{24,}={0,2}")


def mixed(v):
    return bool(re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v)) and len(set(v)) >= 12


def judged(rows, max_owners, least, share):
    """(doc, owner, text) rows -> spans said row by row: every base span, and key spans of values that are live."""
    per_row, owners, texts = [], {}, {}
    for doc, owner, text in rows:
        text = text or ""
        base = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
        base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        key = [(m.start(), 3, m.end(), m[0]) for m in KEYED.finditer(text) if mixed(m[0]) and not any(a < m.end() and m.start() < e for a, _, e, _ in base)]
        per_row.append((doc, base, key))
        for *_, v in base + key:
            owners.setdefault(v, set()).add(owner)
            texts.setdefault(v, set()).add(text)
    limit = max(least, share * len({t or "" for *_, t in rows}))

    def live(v):
        if len(owners[v]) == 1 or len(texts[v]) == 1:
            return True
        return len(owners[v]) <= max_owners and len(texts[v]) <= limit
    return sorted((str(d), ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e, _ in sorted([*base, *[s for s in key if live(s[3])]], key=lambda s: s[:2]))) for d, base, key in per_row)


@pytest.mark.parametrize("share", [0.0, 0.03, 0.2])
def test_key_spans_equal_ownership_counted_by_hand(spark, monkeypatch, share):
    """Values of one owner, of two below and above the limit (on both sides of the corpus's share), of many, and of one text copied around."""
    monkeypatch.setattr(secrets, "REPOSITORY_SHARE", share)
    rng = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    keys = ["ghp_" + "".join(rng.choice(letters) for _ in range(24)) for _ in range(12)] + ["".join(rng.choice(letters) for _ in range(30)) for _ in range(12)] + ["x" * 30, "A1" * 15]
    rows = []
    for i, k in enumerate(keys):
        holders = (["a"], ["a", "b"], ["a", "b"], ["a", "b", "c"], [None, "d"], [None])[i % 6]
        for c in range((2, 3, 14, 8, 2, 60)[i % 6]):
            own = f" {rng.random()} " if i % 4 else " the same text "
            rows.append((len(rows), holders[c % len(holders)], f"note{own}key {k} and token = {k[:14]}x end"))
    rows += [(len(rows) + j, t[3], t[1]) for j, t in enumerate(ROWS)] + [(5000, "z", None), (None, "z", keys[0])] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 AS live", "'q' AS hash").repartition(6)
    got = secrets.secret_spans(df, max_repositories=5)
    said = sorted((str(r.doc_id), ",".join(f"{secrets.KINDS[s.rank]}:{s.start}:{s.end}" for s in r.spans)) for r in got.collect())
    assert said == judged([(d, o, t) for d, o, t in rows], secrets.MAX_OWNERS, 5, share)


def test_key_spans_of_the_whole_table(spark):
    rows = duckdb.sql(f"select doc_id, source, text from '{SF}/documents.parquet'").fetchall()
    got = sorted((str(r.doc_id), r.spans) for r in secrets.op9(spark, SF).collect())
    assert got == judged(rows, secrets.MAX_OWNERS, secrets.MAX_REPOSITORIES, secrets.REPOSITORY_SHARE)


def test_kept_of_the_whole_table_and_of_odd_texts(spark):
    """Ratios of the whole text, of every full chunk and of the tail, against the limits of their lengths."""
    zip_ = zstandard.ZstdCompressor(level=3, write_content_size=False)
    bands = ((64, 0, 1e9), (128, 0.30, 1.25), (256, 0.22, 1.05), (1024, 0.18, 0.90), (4096, 0.15, 0.78), (1e18, 0.10, 0.72))

    def fits(b):
        low, high = next((lo, hi) for below, lo, hi in bands if len(b) < below)
        return low <= len(zip_.compress(b)) / len(b) <= high

    def kept(text):
        b = (text or "").encode("utf-8", "surrogatepass")
        if not b or quality_base(text)[5] or not fits(b):
            return False
        full = [b[i:i + 4096] for i in range(0, len(b) - 4095, 4096)]
        tail = b[4096 * len(full):]
        bad = sum(not 0.12 <= len(zip_.compress(c)) / 4096 <= 0.78 for c in full) + (bool(full and tail) and not fits(tail))
        return bad <= 0.25 * (len(full) + bool(full and tail))

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    plain = [" ".join(word() for _ in range(n)) for n in (5, 12, 40, 200, 900, 3000)]
    noise = ["".join(chr(rng.randint(33, 0x2FFF)) if rng.random() < 0.85 else " " for _ in range(n)) for n in (60, 300, 3000, 9000)]
    dull = [" ".join(f"{'a' * (i % 40)}{i}" for i in range(n)) for n in (60, 400, 3000)]
    texts = plain + noise + dull + [a + " " + b for a in plain[3:] for b in noise[1:] + dull] + [t for _, t, *_ in ROWS]
    table = duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()
    rows = list(enumerate([*texts, *[t for t, in table]]))
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {i: kept(t) for i, t in rows}
    assert got == want and any(not want[i] and not quality_base(t)[5] for i, t in rows)
