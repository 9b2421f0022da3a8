"""Periodic runs of words against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quillstone.llm import periodic_runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHERE = "/root/testdata/sf0.001"


def brute_runs(words, exponent=4, least=6):
    """Start, length and smallest period of every maximal run."""
    n, out = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p):
                out.setdefault((i, j + p - i), p)
            i = j
    return sorted((a, n, p) for (a, n), p in out.items())


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    words = words if doc_id is None else planted(words, doc_id)
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    spelt = "".join(f"{a},{n},{p}\n" for a, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(spelt), sha(kept))


@pytest.mark.parametrize("seed", range(120))
def test_runs_are_brute_force(seed):
    """Few letters, repeated stretches and repeats of repeats."""
    r = random.Random(seed)
    texts = []
    for _ in range(6):
        letters = r.choice([1, 2, 3, 30])
        make = lambda n: [r.randrange(letters) for _ in range(n)]
        t = make(r.choice([0, 1, 5, 30, 60]))
        for _ in range(r.choice([0, 1, 2, 3])):
            unit = make(r.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33]))
            if r.random() < 0.4:
                unit = unit[:3] * r.choice([3, 5, 9]) + unit
            times = r.choice([2, 3, 4, 5, 7])
            t += unit * times + unit[: r.randrange(len(unit) + 1)] + make(r.choice([0, 3, 20]))
        texts.append([b"%d" % x for x in t])
    assert R._batch_runs(texts) == [brute_runs(t) for t in texts]


def test_highly_periodic_regions_inside_larger_periods():
    """A unit that is mostly one word: larger scales see its windows as periodic ones."""
    for ones in (5, 20, 70, 200):
        t = ([b"a"] * ones + [b"b"]) * 5 + [b"c"] + ([b"x", b"y", b"z"] * (ones // 3 + 2) + [b"d"]) * 4
        assert R._batch_runs([t]) == [brute_runs(t)]


def test_positions_are_chosen_by_their_context():
    r = np.random.default_rng(1)
    for scale in (4, 8):
        ids = np.tile(r.integers(0, 3, 50), 3)
        hashes, width = R.mix(ids.astype(np.uint64)), 1
        while width < scale:
            hashes, width = R._windows(hashes, width), 2 * width
        chosen = set(R.synchronising(hashes, np.zeros(len(hashes), bool), scale).tolist())
        context = lambda i: tuple(ids[i : i + 2 * scale])
        places = range(len(ids) - 2 * scale + 1)
        by = {}
        for i in places:
            by.setdefault(context(i), set()).add(i in chosen)
        assert all(len(x) == 1 for x in by.values())
        assert all(any(j in chosen for j in range(i, i + scale)) for i in places if i + 3 * scale <= len(ids))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_is_brute_force(spark):
    from quillstone.llm.queries import op11_sync_runs

    docs = spark.read.parquet(f"{WHERE}/documents.parquet").collect()
    got = rows_of(op11_sync_runs(spark, WHERE))
    assert got == sorted((brute_row(r["doc_id"], r["text"]) for r in docs), key=str)
    assert sum(g[1] > 0 for g in got) >= 10


@pytest.mark.parametrize("at_once", [1, 1 << 17])
def test_odd_rows(spark, odd_documents, no_documents, monkeypatch, at_once):
    monkeypatch.setattr(R, "WORDS_AT_ONCE", at_once)
    short = odd_documents.filter("text is null or length(text) < 10000")
    assert rows_of(R.run_digests(short)) == sorted((brute_row(r["doc_id"], r["text"]) for r in short.collect()), key=str)
    assert R.run_digests(odd_documents).count() == odd_documents.count() and R.run_digests(no_documents).count() == 0
    lines = next(r for r in R.periodic_runs(odd_documents).collect() if r["doc_id"] == 15)
    assert [tuple(x) for x in lines["runs"]] == [(0, 150, 3)] and lines["collapsed"] == "the same line"


def test_long_texts_and_other_blanks(spark):
    unit = " ".join(f"u{k}" for k in range(1000))
    rows = [(3, f"start {unit} " * 1 + f"{unit} " * 5 + "end"), (4, "a\x85a a b\x0bb\x0cb b\tb\nb b")]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in R.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: [(1, 6000, 1000)], 4: [(1, 7, 1)]}
