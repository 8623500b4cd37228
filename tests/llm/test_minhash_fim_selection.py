"""b-bit MinHash, fill-in-middle scatter and importance selection against brute force, and on odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import bbit_minhash, fim_scatter, importance_select
from test_matching import components_of


# -- near duplicates ----------------------------------------------------------


def near_copies(rng, n, words, most):
    rows = []
    for i in range(n):
        own = list(words)
        for at in rng.choice(len(own), size=int(rng.integers(0, most)), replace=False):
            own[at] = f"x{rng.integers(40)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("n,num", [(5, 85), (3, 80)])
def test_near_duplicates_equal_brute_force(spark, small, n, num):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = bbit_minhash.near_duplicates(docs, n, num, 100).collect()
    assert Counter(tuple(r)[:3] for r in rows) == components_of([tuple(r) for r in docs.select("doc_id", "text").collect()], n, num, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_links_through_a_bucket_of_many_components(spark, monkeypatch):
    """Near copies of one text that are mostly not similar to the pivot, and buckets larger than a block."""
    monkeypatch.setattr(bbit_minhash, "BLOCK", 16)
    monkeypatch.setattr(bbit_minhash, "SPREAD", 10)
    rows = near_copies(np.random.default_rng(3), 150, [f"w{i}" for i in range(300)], 14)
    rows += [(500 + i, " ".join(f"y{(i * 7 + j) % 90}" for j in range(60))) for i in range(30)]
    got = bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 85, 100).collect()
    assert Counter(tuple(r)[:3] for r in got) == components_of(rows, 5, 85, 100)
    assert 1 < len({r.component_id for r in got if r.doc_id < 500}) < 150


def test_near_duplicates_on_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = bbit_minhash.near_duplicates(odd, 5, 85, 100).collect()
    assert Counter(tuple(r)[:3] for r in got if r.doc_id is not None) == components_of(rows, 5, 85, 100)
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None] == [(9, None, True)]
    assert bbit_minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("size", [6, 7, 40, 400, 5000])
def test_estimates_follow_the_similarity(size):
    rng = np.random.default_rng(size)
    most, off, shared = bbit_minhash.most_unequal(0.85), [], 0
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        b = a.copy()
        b[:max(1, int(size * 0.08))] = rng.integers(0, 1 << 62, max(1, int(size * 0.08))).astype(np.uint64)
        least = bbit_minhash.minima([a, np.unique(b)])
        bits = bbit_minhash.pack(least)
        share = 1 - bbit_minhash.unequal(bits[0], bits[1]) / bbit_minhash.MINIMA
        off.append((share - 0.25) / 0.75 - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        keys = bbit_minhash.band_keys(least)
        shared += bool((keys[0] == keys[1]).any())
        if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.85:
            assert bbit_minhash.unequal(bits[0], bits[1]) <= most
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06 and shared >= 58


def test_bit_counts_agree_in_spark_and_numpy(spark):
    words = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, (40, 2, 4))
    rows = spark.createDataFrame([(i, x[0].tolist(), x[1].tolist()) for i, x in enumerate(words)], "i long, a array<long>, b array<long>")
    got = dict(map(tuple, rows.select("i", bbit_minhash._unequal("a", "b")).collect()))
    bits = words.view(np.uint64)
    assert [got[i] for i in range(40)] == bbit_minhash.unequal(bits[:, 0], bits[:, 1]).tolist()


# -- fill in the middle -------------------------------------------------------


def filled(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(tokens), form, len(p), len(m), out


def test_fill_in_middle_of_odd_texts(spark, odd, none, monkeypatch):
    monkeypatch.setattr(fim_scatter, "SLICE", 40)
    rng = np.random.default_rng(1)
    bits = ["a", "B", "z", " ", "é", "東", "\n", "<", ">", "P", "S", "M", "<P>", "", "😀", "abc", "\u0000"]
    rows = [(i, None if rng.random() < 0.05 else "".join(rng.choice(bits, size=rng.integers(0, 12)))) for i in range(600)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string").repartition(3), odd, none):
        want = [filled(*r) for r in docs.select("doc_id", "text").collect()]
        out = fim_scatter.transform(docs)
        assert Counter(map(tuple, out.collect())) == Counter(want)
        back = fim_scatter.restore(out.withColumn("restored", F.lit("x"))).select("doc_id", "restored")
        assert Counter(map(tuple, back.collect())) == Counter((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    assert {w[2] for w in (filled(*r) for r in rows)} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_shifts_in_chunks(chunk, monkeypatch):
    monkeypatch.setattr(fim_scatter, "CHUNK", chunk)
    texts = ["", "one two", "é<", ">x", None, "middle of it\n" * 5]
    want = [filled(i, t) for i, t in enumerate(texts)]
    digests = [hashlib.sha256(f"1:{i}".encode()).hexdigest() for i in range(len(texts))]
    got = fim_scatter.cut(pa.array(texts, pa.string()), [np.array([int(d[8 * k:8 * k + 8], 16) for d in digests]) for k in range(4)])
    assert got["output"].to_pylist() == [w[5] for w in want]
    assert fim_scatter.join(got["output"], got["form"]).to_pylist() == [t or "" for t in texts]


def test_restore_refuses_a_broken_output():
    with pytest.raises(ValueError):
        fim_scatter.join(pa.array(["<P>a<S>b"]), np.array([fim_scatter.PSM]))


# -- importance selection -----------------------------------------------------


def drawn(docs, target, percent, min_words, longest):
    def features(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    have, want = (Counter(b for r in t for b in features(r[-1])[1]) for t in (docs, target))
    s, t = sum(have.values()), sum(want.values())
    rows = []
    for doc_id, text in docs:
        w, f = features(text)
        weight = sum(math.floor(1000 * math.log((want[b] + 1) * (s + 10_000) / ((have[b] + 1) * (t + 10_000)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    best = able[:len(able) * percent // 100]
    return Counter([(*r[:4], i + 1) for i, r in enumerate(best)]) + (Counter((*r[:4], None) for r in rows) - Counter((*r[:4], None) for r in best))


@pytest.mark.parametrize("longest,percent", [(1, 10), (3, 50)])
def test_selection_equals_brute_force(spark, small, longest, percent):
    docs, target = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    want = drawn([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in target.select("text").collect()], percent, 20, longest)
    got = importance_select.select(docs.repartition(7), target, percent, 20, longest, finish=5)
    assert Counter(map(tuple, got.collect())) == want


def test_selection_on_odd_rows(spark, odd, none, marks):
    want = drawn([tuple(r) for r in odd.select("doc_id", "text").collect()], [("x",)] * marks.count(), 40, 2, 1)
    assert Counter(map(tuple, importance_select.select(odd, marks, 40, 2, finish=1).collect())) == want
    assert importance_select.select(none, none).count() == 0
    assert {r["rank"] for r in importance_select.select(odd, none, percent=0).collect()} == {None}


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_kth_key_with_ties(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(rng.integers(0, 4, 900) ** 3, rng.integers(0, 30, 900)))]
    keys = spark.createDataFrame(rows, "neg long, id long, row long").repartition(parts)
    for k in (1, 2, 450, 899, 900):
        assert importance_select.kth_key(keys, k, finish=1) == sorted(rows)[k - 1]
    assert importance_select.kth_key(keys, 0) is None
