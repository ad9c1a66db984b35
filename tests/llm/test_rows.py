"""Operators that judge each document by itself: edge cases and whole tables against plain Python."""

import duckdb
import pytest
from brute import ALNUM, LOWER, license_base, quality_base
from edges import ROWS, SF, key_of

from footreach.llm import licenses, packing, quality, tokens, toxicity
from footreach.llm.batches import lower_bytes


@pytest.fixture(scope="session")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_quality_edges(edge_docs):
    got = sorted(((r.doc_id, *tuple(r)[1:7]) for r in quality.quality_rules(edge_docs).collect()), key=key_of)
    assert got == sorted(((d, *quality_base(t)) for d, t, *_ in ROWS), key=key_of)


def test_quality_bands(edge_docs):
    kept = {r.doc_id: r for r in quality.quality_rules(edge_docs).collect()}
    assert not kept[1].kept and kept[1].zstd_ratio is None
    assert not kept[19].kept and not kept[20].kept
    assert kept[16].n_chunks == 0


def test_random_text_is_incompressible(spark):
    import base64
    import random
    rng = random.Random(5)
    noise = " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(400))
    words = ["".join(rng.choice("aeiounrtsl") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    plain = " ".join(rng.choice(words) for _ in range(3000))
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame([(1, noise), (2, plain)], "doc_id bigint, text string")).collect()}
    assert got == {1: False, 2: True}


def test_every_chunk_of_a_text_is_judged(spark):
    """One bad full chunk, and a bad tail, in texts whose whole ratio is within its band."""
    import random
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiounrtsl") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    plain = " ".join(rng.choice(words) for _ in range(3000))
    texts = [(1, "spam " * 820 + plain[:4086]), (2, plain[:8192] + "spam " * 400), (3, plain[:8186])]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    zip_ = quality.zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False)
    verdict = {d: quality.compression(t.encode(), zip_) for d, t in texts}
    assert all(lo <= verdict[d][0] <= hi for d, t in texts for lo, hi in [quality.limits(len(t))])
    assert {d: v[1:] for d, v in verdict.items()} == {1: (1, 1, False), 2: (2, 1, False), 3: (1, 0, True)}
    assert {d: (r.n_chunks, r.n_bad_chunks) for d, r in got.items()} == {1: (1, 1), 2: (2, 1), 3: (1, 0)}
    assert not got[1].kept and not got[2].kept and got[3].kept


def test_quality_query(spark):
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    rows = quality.op1(spark, SF).collect()
    assert len(rows) == len(docs) and all(tuple(r)[1:7] == quality_base(docs[r.doc_id]) for r in rows)
    assert sum(r.kept for r in rows) > 0.8 * len(rows)


def test_token_counts_are_the_librarys(spark, edge_docs, library):
    path, lib = library
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(edge_docs, path).collect()), key=key_of)
    n = {t: len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ROWS}
    assert got == sorted(((d, len((t or "").encode()), n[t], n[t] > 2048) for d, t, *_ in ROWS), key=key_of)
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    rows = tokens.op2(spark, SF).collect()
    said = dict(zip(docs, (len(e.ids) for e in lib.encode_batch(list(docs.values()), add_special_tokens=False))))
    assert {r.doc_id: r.n_tokens for r in rows} == said


def test_chunk_maps_compose_at_any_cut(library):
    import random
    path, lib = library
    rng = random.Random(3)
    machine = tokens.compiled(path)
    pool = ["a", "B", "é", "Σ", "İ", "中", " ", "\n", "\x1c", "\x85", "1", "½", "²", "'s", "'LL", "<|endoftext|>", "<|", "!", "##", "\U0001f600", "́", "the", "ing", "world", "_", "\x00"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert machine.count(text) == n and machine.count(text, chunk_chars=rng.randint(1, 7)) == n
    maps = [machine.chunk_map(c) for c in ("ab c", "d", "e f", " g", "h")]
    left = maps[0]
    for m, prefix in zip(maps[1:], machine.scan(maps)[1:]):
        left = machine.compose(left, m)
        assert prefix == left


def test_states_may_be_forgotten(library, monkeypatch):
    machine = tokens.Tokenizer(library[0])
    words = ["internationalisation", "tokenizer", "transducer", "thndheer"]
    before = [machine.words.count(w.encode()) for w in words]
    monkeypatch.setattr(tokens, "MAX_STATES", 3)
    monkeypatch.setattr(tokens, "MAX_FITS", 2)
    assert [machine.words.count(w.encode()) for w in words * 2] == before * 2


def test_very_long_words_and_texts_without_spaces(library, monkeypatch):
    """Counts stay right where the table is emptied inside a word, and no long word is kept."""
    import random
    rng = random.Random(6)
    machine = tokens.Tokenizer(library[0])
    monkeypatch.setattr(tokens, "MAX_STATES", 40)
    for alphabet in ("abcdefghij", "thein", "é漢xyz", "01239ab!?"):
        text = "".join(rng.choice(alphabet) for _ in range(3000))
        n = len(library[1].encode(text, add_special_tokens=False).ids)
        assert machine.count(text) == n == machine.count(text, chunk_chars=100)
    assert len(machine.words.states) < 100 and max(map(len, machine.known), default=0) <= tokens.LONG_WORD


def test_license_edges(edge_docs):
    got = sorted(((r.doc_id, *tuple(r)[1:6]) for r in licenses.license_spans(edge_docs).collect()), key=key_of)
    assert got == sorted(((d, *license_base(t)) for d, t, *_ in ROWS), key=key_of)
    assert {r.doc_id: r.labels for r in licenses.license_spans(edge_docs).collect()}[15] == "apache,mit"


def test_matching_statistics_and_base_places():
    import random
    rng = random.Random(2)
    machine = licenses.automaton()
    texts = [t.split() for _, _, t in licenses.TEMPLATES] + [t.split() for t, _ in licenses.PHRASES] + [t.split() for _, t in licenses.NAMES]
    words = [w for t in texts for w in t] + ["x", "y"]

    def longest(seq, i):
        n = 0
        for a in texts:
            for p in range(len(a)):
                q = 0
                while q <= min(i, p) and seq[i - q] == a[p - q]:
                    q += 1
                n = max(n, q)
        return n

    for k in range(400):
        seq = " ".join(rng.choice([rng.choice(words), rng.choice(licenses.PHRASES)[0], rng.choice(licenses.TEMPLATES)[2]]) for _ in range(rng.randint(0, 8))).split()
        base, matches = machine.stream([w.encode() for w in seq])
        assert (len(base), min((s for s, _ in base), default=None)) == license_base(" ".join(seq))[1:3]
        if k < 60:
            ref = [longest(seq, i) for i in range(len(seq))]
            assert [(e, n) for e, n, _ in matches] == [(i, n) for i, n in enumerate(ref) if n >= 3 and (i + 1 == len(ref) or ref[i + 1] != n + 1)]


def test_broken_notice_is_one_span():
    machine = licenses.automaton()
    notice = licenses.TEMPLATES[0][2].split()
    seq = ["x"] * 5 + notice[:12] + ["y", "z"] + notice[12:] + ["x"] * 3
    spans, best = machine.spans(machine.stream([w.encode() for w in seq])[1])
    assert ("gpl", 5, 5 + len(notice) + 1) in [s[:3] for s in spans] and best == 1.0
    spans, best = machine.spans(machine.stream([w.encode() for w in notice[:8]])[1])
    assert not spans and 0 < best < licenses.MIN_COVER


SENTENCES = {
    "released under the GNU Lesser General Public License": "lgpl", "GNU Affero General Public License": "agpl", "the general public license fee": "",
    "Attribution-ShareAlike 4.0": "cc-by-sa", "cc by nc sa 4.0": "cc-by,cc-by-nc-sa", "Released under the MIT license.": "mit", "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "licensed under CC BY-NC 4.0": "cc-by,cc-by-nc", "See the Mozilla Public License, v. 2.0": "mpl", "the terms of the license and the software": "", "GNU General Public License version 3": "gpl",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License": "lgpl",
    "Permission is hereby granted, free of charge, to any person": "", "Creative Commons Attribution-NonCommercial-NoDerivatives": "cc-by-nc-nd", "BSD 3-Clause": "bsd",
}


def test_license_sentences(spark):
    docs = spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id bigint, text string")
    assert {list(SENTENCES)[r.doc_id]: r.labels for r in licenses.license_spans(docs).collect()} == SENTENCES


def test_runs_and_chains_equal_exhaustive_search():
    """All maximal common runs, and the heaviest of all chains of them."""
    import random
    rng = random.Random(12)
    words = "a b c d e".split()
    for _ in range(250):
        texts = [[rng.choice(words) for _ in range(rng.randint(3, 9))] for _ in range(3)]
        code = lambda seq: [w.encode() for w in seq]
        machine = licenses.SuffixAutomaton([("x", code(t[:1]), code(t)) for t in texts], [])
        seq = [rng.choice([*words, "z"]) for _ in range(rng.randint(0, 14))]
        got = machine.runs(machine.stream(code(seq))[1])
        for k, t in enumerate(texts):
            runs = []
            for i in range(len(seq)):
                for p in range(len(t)):
                    if seq[i] == t[p] and (i + 1 == len(seq) or p + 1 == len(t) or seq[i + 1] != t[p + 1]):
                        n = 0
                        while n <= min(i, p) and seq[i - n] == t[p - n]:
                            n += 1
                        if n >= licenses.MIN_MATCH:
                            runs.append((i, p, n))
            assert sorted(got.get(k, [])) == sorted(runs)
            if runs:
                def heaviest(last, weight):
                    top = weight
                    for e, p, n in runs:
                        if last is None:
                            top = max(top, heaviest((e, p), machine.weight[k][p + 1] - machine.weight[k][p + 1 - n]))
                        elif e > last[0] and p > last[1]:
                            own = min(n, e - last[0], p - last[1])
                            if e - own - last[0] <= licenses.MAX_GAP and p - own - last[1] <= licenses.MAX_GAP:
                                top = max(top, heaviest((e, p), weight + machine.weight[k][p + 1] - machine.weight[k][p + 1 - own]))
                    return top
                assert machine.best_chain(k, runs)[0] == pytest.approx(heaviest(None, 0.0))


def test_license_query(spark):
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    rows = licenses.op5(spark, SF).collect()
    assert len(rows) == len(docs) and all(tuple(r)[1:6] == license_base(docs[r.doc_id]) and 0 <= r.score <= 1 for r in rows)


def reference_packing(pieces, capacity, per_source):
    """The tightest compatible bin by looking at all bins."""
    bins, out = [], [None] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i)):
        n, s, c = pieces[i]
        fits = [(b[0], j) for j, b in enumerate(bins) if b[0] >= n and b[1].count(s) < per_source and (c is None or c not in b[2])]
        room, j = min(fits) if fits else (capacity, len(bins))
        if not fits:
            bins.append([capacity, [], set()])
        out[i] = (j, capacity - room)
        bins[j][0] -= n
        bins[j][1].append(s)
        bins[j][2].add(c)
    return out


def test_packing_is_best_fit():
    import random
    rng = random.Random(4)
    for _ in range(100):
        pieces = [(rng.randint(1, 50), rng.choice("abc"), rng.choice([None, 1, 2, 3])) for _ in range(rng.randint(0, 120))]
        assert packing.pack(pieces, 50, 2) == reference_packing(pieces, 50, 2)


def check_packing(rows, docs, capacity=packing.CAPACITY, per_source=packing.PER_SOURCE):
    """Every word of every document is packed once, bins don't overflow or overlap, and conflicts hold. docs: [(id, n, source, copy key)]."""
    from collections import Counter, defaultdict
    assert Counter(r.doc_id for r in rows for _ in range(r.piece_length)) == Counter(d for d, n, *_ in docs for _ in range(n))
    assert Counter(r.doc_id for r in rows if r.bin_id is None) == Counter(d for d, n, *_ in docs if not n)
    info = {d: (s, c) for d, n, s, c in docs}
    bins = defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        assert all(a.bin_offset + a.piece_length == b.bin_offset for a, b in zip(own, own[1:])) and own[0].bin_offset == 0
        assert sum(r.piece_length for r in own) <= capacity
        if len(own) > 1:
            assert max(Counter(info[r.doc_id][0] for r in own).values()) <= per_source and max(Counter(info[r.doc_id][1] for r in own).values()) == 1


def words(t):
    return len((t or "").encode().split())


def test_packing_edges(edge_docs):
    check_packing(packing.packed(edge_docs).collect(), [(d, words(t), s, (t or "").lower()) for d, t, _, s, _ in ROWS])


def test_packing_query(spark, monkeypatch):
    docs = duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()
    for rows in (4000, 17):
        monkeypatch.setattr(packing, "SHARD_ROWS", rows)
        check_packing(packing.op7(spark, SF).collect(), [(d, words(t), s, (t or "").lower()) for d, t, s in docs])


def test_toxicity_edges(spark, edge_docs):
    labels = spark.createDataFrame([(18, 1), (18, 0), (6, 0), (7, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    got = toxicity.scores(edge_docs, toxicity.fit(edge_docs, labels), ["doc_id"]).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    empty = toxicity.fit(edge_docs, labels.limit(0))
    assert all(r.score < 1e-9 for r in toxicity.scores(edge_docs, empty, ["doc_id"]).collect())


def test_toxicity_held_out(spark):
    """Trained on rows outside the held-out fifth; ranks and classifies the held-out ones."""
    sf = SF.replace("sf0.001", "sf0.1")
    labels = dict(duckdb.sql(f"select doc_id, max(toxic) from '{sf}/labels.parquet' group by 1").fetchall())
    rows = toxicity.op3(spark, sf).collect()
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.97 and sum(s >= 0.5 for s in neg) <= 0.01 * len(neg) and sum(s >= 0.5 for s in pos) >= 0.8 * len(pos)


def test_toxicity_bound_keeps_class_shares(spark, monkeypatch):
    """Where the bound on labelled rows acts, both classes keep their share and clean held-out rows stay clean."""
    sf = SF.replace("sf0.001", "sf0.1")
    monkeypatch.setattr(toxicity, "MAX_ROWS", 600)
    labels = dict(duckdb.sql(f"select doc_id, max(toxic) from '{sf}/labels.parquet' group by 1").fetchall())
    learned = spark.read.parquet(f"{sf}/labels.parquet").filter(~toxicity.held_out(toxicity.F.col("doc_id")))
    sample = [r.toxic for r in toxicity.sample_of_labels(learned).collect()]
    assert len(sample) == 600 and abs(sum(sample) / 600 - sum(labels.values()) / len(labels)) < 0.03
    held = [(r.predicted, labels[r.doc_id]) for r in toxicity.op3(spark, sf).collect() if r.held_out and r.doc_id in labels]
    found = [y for p, y in held if p]
    assert sum(found) >= 0.9 * len(found) and sum(found) >= 0.4 * sum(y for _, y in held)


def test_toxicity_of_one_kind_and_of_repeated_ids(spark, monkeypatch):
    """One kind of labels says that kind; an id on many rows, of equal and of different texts, stays within the bound."""
    docs = spark.createDataFrame([(1, f"some plain words number {i % 7}") for i in range(500)] + [(2, f"text {i}") for i in range(300)] + [(k, "other words here") for k in range(3, 30)], "doc_id bigint, text string")
    for kind in (0, 1):
        labels = spark.createDataFrame([(k, kind) for k in range(1, 30)], "doc_id bigint, toxic int")
        got = [r.score for r in toxicity.scores(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()]
        assert max(abs(s - kind) for s in got) < 0.01
    monkeypatch.setattr(toxicity, "MAX_ROWS", 50)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id bigint, toxic int")
    rows = [r for r in toxicity.fit_features(docs, labels).collect()]
    assert len(rows) == 50 and len({(r.rank, r.digest) for r in rows}) == 50
    at, w = toxicity.fit(docs, labels)
    assert len(at) == len(w)


def test_ftrl_equals_its_formulas(monkeypatch):
    """The model's steps against the published update, coordinate by coordinate in plain Python."""
    import math
    import random

    import numpy as np
    monkeypatch.setattr(toxicity, "L1", 0.5)
    rng = random.Random(3)
    rows = [(np.array(sorted(rng.sample(range(12), rng.randint(0, 6))) + [1 << toxicity.BITS], np.int32), int(rng.random() < 0.4)) for _ in range(60)]
    z, n = {}, {}

    def weight(i):
        l1 = 0 if i == 1 << toxicity.BITS else toxicity.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for at, y in rows:
            w = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - step * w[i]
                n[i] = n.get(i, 0.0) + g * g
    at, got = toxicity.fit_rows(rows)
    assert len(at) > 6 and dict(zip(at.tolist(), got.tolist())) == pytest.approx({i: weight(i) for i in z if weight(i) or i == 1 << toxicity.BITS}, abs=1e-4)


def test_empty_tables(spark, no_docs, library):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    for df in (quality.quality_rules(no_docs), tokens.token_counts(no_docs, library[0]), licenses.license_spans(no_docs), packing.packed(no_docs),
               toxicity.scores(no_docs, toxicity.fit(no_docs, labels), ["doc_id"])):
        assert df.count() == 0


def test_words_are_those_of_the_contract():
    text = "ABC déf_ghi-3 Àé中x\x7f\x80y Z"
    assert [w.decode() for w in __import__("footreach.llm.batches", fromlist=["ALNUM"]).ALNUM.findall(lower_bytes(text))] == ALNUM.findall(text.translate(LOWER))
