"""Repeated byte strings and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from faultline.llm import runs, substring_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept string"
LONG = " ".join(f"word{i % 977} and" for i in range(40_000))
PASSAGE = " ".join(f"passage{i}" for i in range(40))
ROWS = [(1, f"one {PASSAGE} end", "x"), (2, None, None), (3, "", "y"), (None, f"no id {PASSAGE}", "z"), (4, f"é{PASSAGE}", None), (4, f"é{PASSAGE}", None),
        (5, LONG, "l"), (6, "\n\n \t", "w"), (7, "a" * 150, "n"), (8, "b" * 1000, "s"), (9, f"clean text {'xyz ' * 3}", "c"), (9, "another text", "c")]


def sha(b):
    return hashlib.sha256(b).hexdigest()


# repeated byte strings


def without_repeats(texts, length):
    """[(removed bytes, maximal runs, kept bytes)] by counting every window."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append((sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_transform_finds_the_windows_that_occur_again(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        length, letters = rnd.choice([3, 5, 8, 20, 40]), rnd.choice([1, 2, 3, 26])
        base = bytes(97 + rnd.randrange(letters) for _ in range(rnd.randrange(1, 200)))
        cuts = [sorted(rnd.randrange(len(base) + 1) for _ in range(2)) for _ in range(rnd.randrange(1, 12))]
        parts = [base[i:j] for i, j in cuts if j - i >= length]
        if not parts:
            continue
        weight = [rnd.choice([1, 1, 2]) for _ in parts]
        seen = Counter()
        for p, w in zip(parts, weight, strict=True):
            seen.update({k: n * w for k, n in Counter(p[i:i + length] for i in range(len(p) - length + 1)).items()})
        want = {(k, i) for k, p in enumerate(parts) for i in range(len(p) - length + 1) if seen[p[i:i + length]] > 1}
        assert {(k, i) for k, a, b in substring_dedup.repeated_windows(parts, weight, length) for i in range(a, b)} == want


def test_segments_hold_every_window_once_under_a_name_of_its_content(monkeypatch):
    rnd = random.Random(2)
    texts = [bytes(97 + rnd.randrange(3) for _ in range(n)) for n in (0, 9, 10, 11, 300, 1000)] + [b"z" * 500]
    for piece in (7, 64, 1 << 20):
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        for gram in (4, 10):
            names, seen = {}, Counter()
            for k, at, n, key, tie, data in substring_dedup.segments(texts, gram, 10):
                assert data == texts[k][at:at + n + 9]
                assert tie or len({data[i:i + 10] for i in range(n)}) == n
                for i in range(n):
                    seen[k, at + i] += 1
                    assert names.setdefault(data[i:i + 10], key) == key
            assert seen == Counter({(k, i): 1 for k, t in enumerate(texts) for i in range(len(t) - 9)})


@pytest.mark.parametrize("bucket", [substring_dedup.BUCKET, 2])
def test_repeats_are_cut_from_odd_rows(spark, bucket):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = substring_dedup.without_repeats(docs, bucket=bucket)  # a clashing column is replaced
    assert out.columns == ["doc_id", "text", "n_bytes", "spans", "kept"]
    got = sorted((r.doc_id or -1, r.text or "", sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in out.collect())
    want = without_repeats([r[1] for r in ROWS], 200)
    assert got == sorted((r[0] or -1, r[1] or "", *w) for r, w in zip(ROWS, want, strict=True))
    assert any(w[0] for w in want)


def test_repeats_of_an_empty_table(spark):
    assert substring_dedup.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_passage_of_very_many_contexts_is_split_by_longer_grams(spark):
    rnd = random.Random(4)
    words = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(n))
    passage = words(60)
    texts = [f"{words(8)} {passage} {words(8)}" for _ in range(300)] + [words(100) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substring_dedup.without_repeats(docs, bucket=20).select(
        "doc_id", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"), F.size("spans").alias("n_spans")).collect()}
    assert got == {i: w[:2] for i, w in enumerate(without_repeats(texts, 200))}


def test_substring_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = without_repeats([r.text for r in docs], 200)
    rows = E.queries()["op11_substring_dedup"](spark, SF).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == {r.doc_id: (len((r.text or "").encode()), n, s, sha(k)) for r, (n, s, k) in zip(docs, want, strict=True)}
    assert len(rows) == len(docs)


# periodic runs


def runs_of(w, least=12):
    """(start, length, smallest period) of all runs, by trying every period."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("least", [2, 12])
def test_runs_equal_brute_force(least):
    rnd = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 8)):
            n, kinds = rnd.choice([0, 1, 2, 5, 13, 40, 120, 300]), rnd.choice([1, 2, 2, 3, 5, 50])
            w = [str(rnd.randrange(kinds)) for _ in range(n)]
            for _ in range(rnd.randint(0, 3) if n > 4 else 0):
                p, s = rnd.randint(1, max(1, n // 3)), rnd.randrange(n)
                for i in range(s + p, min(n, s + p * rnd.randint(2, 9) + rnd.randrange(p))):
                    w[i] = w[i - p]
            texts.append(w)
        got = runs.runs_batch(pa.array([" ".join(w) for w in texts], pa.string()), least).to_pylist()
        for w, g in zip(texts, got, strict=True):
            found = runs_of(w, least)
            assert [(r["start"], r["length"], r["period"]) for r in g["runs"]] == found
            assert (g["n_words"], g["collapsed"]) == (len(w), collapsed(w, found))


def test_grammar_extends_positions_exactly():
    import numpy as np

    rnd = np.random.default_rng(5)
    for kinds in (1, 2, 4, 100):
        s = rnd.integers(0, kinds, 400)
        s[100:300] = s[50:250]
        s[[0, 90, 399]] = -1 - np.arange(3)
        rounds = runs.grammar(s)
        x = rnd.integers(1, 398, 500)
        y = rnd.integers(1, 398, 500)
        x, y = x[x != y], y[x != y]
        after, before = runs.extensions(rounds, x, y, 1), runs.extensions(rounds, x, y, -1)
        for a, b, f, p in zip(x.tolist(), y.tolist(), after.tolist(), before.tolist(), strict=True):
            n = m = 0
            while max(a, b) + n < 400 and s[a + n] == s[b + n]:
                n += 1
            while min(a, b) - m - 1 >= 0 and s[a - m - 1] == s[b - m - 1]:
                m += 1
            assert (f, p) == (n, m)


def test_runs_of_odd_rows(spark):
    rows = [*ROWS, (10, " ".join(["go\x0bon x"] * 20), None), (11, "la " * 100_000, "r"), (12, " ".join(["a b"] * 6 + ["c"] * 12), "t")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = runs.with_runs(docs, out="kept")  # a clashing column is replaced
    assert out.columns == ["doc_id", "text", "kept"]
    got = {(r.doc_id, r.text): r.kept for r in out.collect()}
    assert len(got) == len(rows) - 1 and out.count() == len(rows)
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = [(0, 100_000, 1)] if i == 11 else None if i == 5 else runs_of(w)  # the others are short
        g = got[i, t]
        if found is None:  # 977 pairs of words repeat all along
            found = [(0, 80_000, 1954)]
        assert ([tuple(r) for r in g.runs], g.n_words) == (found, len(w))
        assert g.collapsed == collapsed(w, found)
    assert runs.with_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_runs_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in E.queries()["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = runs_of(w)
        best = min(found, key=lambda z: (-z[1], z[0], z[2])) if found else (None,) * 3
        assert got[r.doc_id] == (n, len(found), *best, 1000 * best[1] // best[2] if found else None,
                                 sha("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()), sha(collapsed(w, found).encode()))
