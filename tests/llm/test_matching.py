"""Jaccard join, line dedup and top-k search against brute force, and on odd input."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskloom.llm import graph, line_winnow, near_join, nra_topk
from riskloom.staging import stage

WORD = r"[^\x20\x09-\x0D]+"


def sets_of(rows, n):
    out = []
    for doc_id, text in rows:
        w = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append((doc_id, frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    return out


def components_of(rows, n, num, den):
    sets = [x for x in sets_of(rows, n) if x[0] is not None]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        common = Counter(j for g in s for j in held[g])
        for j, c in common.items():
            if den * c >= num * (len(s) + len(sets[j][1]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in s:
            held[g].append(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 60)])
def test_join_equals_brute_force(spark, tiny, n, num):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = Counter(tuple(r)[:3] for r in near_join.join_components(docs, n, num, 100).collect())
    assert got == components_of([tuple(r) for r in docs.select("doc_id", "text").collect()], n, num, 100)


def test_join_of_a_chain_of_near_copies(spark):
    """Copies that each differ from the next: links go through, whatever sets meet first in a bucket."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        own = list(words)
        for at in rng.choice(300, size=int(rng.integers(0, 9)), replace=False):
            own[at] = f"x{rng.integers(40)}"
        rows.append((i, " ".join(own)))
    rows += [(500 + i, " ".join(f"y{(i * 7 + j) % 90}" for j in range(60))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r)[:3] for r in near_join.join_components(docs, 3, 90, 100).collect())
    assert got == components_of(rows, 3, 90, 100)


def test_blocks_get_their_cells_in_passes(spark, monkeypatch):
    """Rows with cells are made a part at a time, and the join is that of one pass."""
    rows, staged = [], []
    rng = np.random.default_rng(8)
    for i in range(60):
        own = [f"g{i // 20}w{j}" for j in range(120)]
        for at in rng.choice(120, size=12, replace=False):
            own[at] = f"x{rng.integers(1 << 40)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    write = near_join.write_stage
    monkeypatch.setattr(near_join, "PASS_ROWS", 20, raising=False)
    monkeypatch.setattr(near_join, "write_stage", lambda df, name, by=(): staged.append(name) or write(df, name, by))
    got = Counter(tuple(r)[:3] for r in near_join.join_components(docs, 2, 70, 100).collect())
    assert got == components_of(rows, 2, 70, 100)
    assert staged.count("near-met") > 2


def test_join_on_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = near_join.join_components(odd, 3, 90, 100).collect()
    assert Counter(tuple(r)[:3] for r in got if r.doc_id is not None) == components_of(rows, 3, 90, 100)
    assert [tuple(r)[1:3] for r in got if r.doc_id is None] == [(11, None)]
    assert near_join.join_components(none).count() == 0
    kept = near_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 10, 11]
    assert {r.text for r in kept.where("doc_id = 2").collect()} == {"another text under an id that is taken"}
    assert near_join.keep_one(none).columns == none.columns and near_join.keep_one(none).count() == 0


def test_keep_one_tells_rows_apart_by_id_and_text(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a, "x"), (5, a + " more", "y"), (5, "like nothing else in this table at all", "z"), (1, a, "x"), (1, a, "w"), (7, None, "n"), (7, None, "n"), (None, a, "q")]
    got = near_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, __t string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, a), (5, rows[2][1]), (7, None), (7, None), (None, a)])


@pytest.mark.parametrize("size", [1, 5, 17, 60, 300, 2000])
@pytest.mark.parametrize("num", [60, 80, 90])
def test_similar_sets_share_a_signature(size, num):
    rng = np.random.default_rng(size)
    scheme = near_join.Scheme(num, 100)
    for _ in range(25):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        out, new = rng.integers(0, size + 1), rng.integers(0, size + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[:size - out], rng.integers(0, 1 << 62, new).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= num * (len(a) + len(b) - common):
            made = [set(np.concatenate([near_join.signatures(x, t, scheme.parts(t)) for t in scheme.bands(len(x))]).tolist()) for x in (a, b)]
            assert made[0] & made[1]


@pytest.mark.parametrize("size", [1, 6, 60, 700])
@pytest.mark.parametrize("num", [60, 80])
def test_similar_sets_share_a_first_shingle(size, num):
    """Whatever is marked as common: two similar sets meet by their first shingles, of which there are fewer than parts."""
    rng, scheme = np.random.default_rng(size), near_join.Scheme(num, 100)
    for _ in range(25):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        out, new = rng.integers(0, size // 2 + 1, 2)
        b = np.unique(np.concatenate([rng.permutation(a)[:size - out], rng.integers(0, 1 << 62, new).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        marked = rng.integers(0, 256, 1 << 10).astype(np.uint8)
        if len(b) and 100 * common >= num * (len(a) + len(b) - common):
            made = [set(near_join.first_places(near_join.places(x, marked), scheme.prefix(len(x))).tolist()) for x in (a, b)]
            assert made[0] & made[1]
    own = scheme.bands(size)[0]
    if scheme.prefixed(own):
        assert scheme.prefix(size) < len(near_join.signatures(a, own, scheme.parts(own)))
    assert scheme.prefixed(own) or size < 6


def test_first_shingles_are_seldom_those_that_many_sets_hold(spark, monkeypatch):
    """Texts that share a passage and little else do not meet, so they are not compared."""
    rng, staged = np.random.default_rng(2), {}
    passage = " ".join(f"p{j}" for j in range(40))
    rows = [(i, passage + " " + " ".join(f"w{i}x{j}" for j in range(80))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + f" more{rng.integers(1 << 40)}") for i in range(0, 300, 50)]
    monkeypatch.setattr(near_join, "write_stage", lambda df, name, by=(): staged.update({name: (out := stage(df, name, by))}) or out)
    monkeypatch.setattr(near_join, "SHARE", 2, raising=False)
    got = Counter(tuple(r)[:3] for r in near_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect())
    assert got == components_of(rows, 5, 80, 100)
    members = staged["near-rows"].where("kind = 2").select("node", "pivot")
    assert {x for r in members.collect() for x in r} == {r.node for r in staged["near-rows"].where("kind = 0 and (doc_id >= 1000 or doc_id % 50 = 0)").collect()}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys((1, 2, 3, 7, 8, 9), 1), 20: 20, 21: 20, **dict.fromkeys(range(100, 141), 100)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_pieces_and_of_one_piece(spark, monkeypatch):
    """Few edges are one piece and need no rounds; more are contracted piece by piece, with the same result."""
    rng, names = np.random.default_rng(5), []
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(900 + i, 901 + i) for i in range(60)] + [(None, 7)], "a long, b long")
    monkeypatch.setattr(graph, "stage", lambda df, name: names.append(name) or stage(df, name))
    whole = sorted(map(tuple, graph.components(edges).collect()))
    assert names == ["components"]
    monkeypatch.setattr(graph, "PIECE", 40)
    assert sorted(map(tuple, graph.components(edges.repartition(12)).collect())) == whole and len(names) > 2
    assert {n for n, _ in whole if n >= 900} == set(range(900, 961)) and all(label == 900 for n, label in whole if n >= 900)


def test_join_ends_when_no_bucket_is_apart(spark, monkeypatch):
    """Copies leave nothing to compare in blocks, so no further pass is made over their buckets."""
    names = []
    monkeypatch.setattr(near_join, "write_stage", lambda df, name, by=(): names.append(name) or stage(df, name, by))
    rows = [(i, " ".join(f"w{(i // 4) * 40 + j}" for j in range(30)) + (" one" if i % 4 else " two")) for i in range(40)]
    got = Counter(tuple(r)[:3] for r in near_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect())
    assert got == components_of(rows, 3, 90, 100)
    assert names.count("near-placed") == 1 and names.count("near-candidates") == 1


def deduped(rows, min_words=50):
    rows = sorted(rows)
    lines = {d: t.split("\n") for d, t in rows}
    seen, out = defaultdict(list), {}
    for d, _ in rows:
        own, gone = lines[d], set()
        size = [len(re.findall(WORD, x)) for x in own]
        for i, x in enumerate(own):
            for e, j in seen[x]:
                if i and j and own[i - 1] == lines[e][j - 1]:
                    continue
                k = 0
                while i + k < len(own) and j + k < len(lines[e]) and (e, j + k) < (d, i + k) and own[i + k] == lines[e][j + k]:
                    k += 1
                if sum(size[i:i + k]) >= min_words:
                    gone |= set(range(i, i + k))
            seen[x].append((d, i))
        out[d] = "\n".join(x for i, x in enumerate(own) if i not in gone)
    return out


def test_line_dedup_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in line_winnow.dedup_lines(docs).collect()}
    assert got == deduped(rows) and sum(got[d] != t for d, t in rows) > 50


def test_line_dedup_finds_runs_of_short_lines(spark):
    line = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    run = [line(x, 13) for x in "pqrs"]
    rows = [(1, "\n".join([line("a", 8), *run, line("b", 8)])), (2, "\n".join([line("c", 8), *run])), (3, "\n".join([*run[:3], line("e", 9)])),
            (4, "\n".join([line("u", 60), line("v", 5), line("u", 60)]))]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_winnow.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == (line("c", 8), 4) and got[3] == (rows[2][1], 0)
    assert got[4] == ("\n".join([line("u", 60), line("v", 5)]), 1)


def test_line_dedup_looks_past_the_first_place_of_short_lines(spark):
    """Lines A, B come first in other company, too few words to go; A, B, C repeat later."""
    line = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = []
    for t in range(12):
        a, b, c = (line(f"{x}{t}_", 18) for x in "abc")
        rows += [(10 * t, "\n".join([a, b, line(f"u{t}_", 9)])), (10 * t + 1, "\n".join([line(f"v{t}_", 9), a, b, c])),
                 (10 * t + 2, "\n".join([a, b, c, line(f"w{t}_", 9)]))]
    rows += [(200, line("x", 60)), (201, "\n".join([line("x", 60), line("y", 9)])), (202, "\n".join(["", line("x", 60), line("y", 9), ""]))]
    got = {r.doc_id: r.text for r in line_winnow.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == deduped(rows)
    assert all(got[10 * t + 2] == line(f"w{t}_", 9) for t in range(12)) and got[202] == "\n"


def test_line_dedup_of_random_lines_equals_brute_force(spark):
    """Few distinct lines in any company, with lines without words among them."""
    rng = np.random.default_rng(11)
    lines = ["", " ", *(" ".join(f"l{i}_{j}" for j in range(n)) for i, n in enumerate([1, 3, 5, 8, 12, 20, 60]))]
    rows = [(i, "\n".join(lines[j] for j in rng.integers(0, len(lines), rng.integers(1, 25)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (20, 50):
        got = {r.doc_id: r.text for r in line_winnow.dedup_lines(docs, min_words=least).collect()}
        assert got == deduped(rows, least)


def test_line_dedup_on_odd_rows(odd, none):
    got = line_winnow.dedup_lines(odd)
    assert got.count() == odd.count() and set(odd.columns) == set(got.columns)
    assert {r.text for r in got.where("doc_id = 4 or doc_id = 3").collect()} == {None, ""}
    assert line_winnow.dedup_lines(odd, min_words=5, drop_empty=True).where("doc_id in (3, 4, 5)").count() == 3
    assert line_winnow.dedup_lines(none).count() == 0


def test_top_k_with_ties_and_broken_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 8) / 16]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (420, []), (440, [0.5]), (441, [3e38] * 8)]
    got = nra_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=20, k=20).collect()
    x = {i: [int(np.floor(64 * np.float32(c).astype(float))) for c in v] for i, v in rows if i is not None and v is not None and i not in (401, 402, 403)}
    x[441] = [min(c, 1 << 62) for c in x[441]]
    for q in [i for i in x if i % 20 == 0]:
        score = {i: max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * b for a, b in zip(x[q], v)))) for i, v in x.items() if i != q}
        want = sorted(score.items(), key=lambda s: (-s[1], s[0]))[:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert nra_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lists_are_read_until_outsiders_cannot_qualify():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6)) ** 3 * 40 // 1
    q = rng.normal(size=(20, 6)) * 30 // 1
    q[3], q[4, 1:] = 0, 0
    lists, barred = nra_topk.Lists(x), np.arange(500) == 17
    for vector in q:
        own, score, depth = lists.top(vector, 5, barred)
        assert 17 not in own and (score == x[own] @ vector).all()
        assert len(own) < 10 or not vector.any()
        assert depth < 500 if (vector != 0).sum() < 2 else depth > 5
        order = [i for i in np.argsort(-(x @ vector), kind="stable") if i != 17]
        assert set(order[:5]) <= set(own)


def test_top_k_of_few_rows_and_of_huge_and_empty_vectors():
    ids = np.arange(30)
    rng = np.random.default_rng(2)
    for x in (rng.integers(-(1 << 61), 1 << 61, (30, 3)), rng.integers(-1, 2, (30, 3)), np.zeros((30, 0), np.int64)):
        for query, rows, scores in nra_topk.block_top(ids, x, ids[::10], x[::10], 7):
            want = sorted((-sum(int(a) * int(b) for a, b in zip(x[i], x[query])), i) for i in range(30) if i != query)[:7]
            assert [(-s, i) for i, s in zip(rows.tolist(), scores.tolist())] == want
    (_, rows, scores), = nra_topk.block_top(ids[:3], np.ones((3, 2), np.int64), ids[:1], np.ones((1, 2), np.int64), 7)
    assert rows.tolist() == [1, 2] and scores.tolist() == [2, 2]


def test_queries_of_a_chunk_read_lists_together():
    """The batch gives every query its k best rows with exact scores, at fewer reads than all where bounds decide."""
    rng = np.random.default_rng(3)
    for n, dims, top in ((900, 3, 1000), (900, 32, 30), (15, 4, 3)):
        x = rng.integers(-top, top + 1, (n, dims)).astype(np.float64)
        barred = np.arange(n) == np.arange(0, n, 9)[:, None]
        for q, no, (rows, score) in zip(x[::9], barred, nra_topk.Lists(x).top_many(x[::9], 10, barred), strict=True):
            want = np.where(no, -np.inf, x @ q)
            kth = np.sort(want)[-min(10, n - 1)]
            assert set(np.flatnonzero(want >= kth)) <= set(rows) and np.array_equal(score, want[rows])
            assert dims > 3 or len(rows) <= nra_topk.LAST


def test_finer_counts_tell_large_sets_apart(spark, monkeypatch):
    """Unrelated sets of thousands of shingles pass 256 cells and fail at 4096; links of large sets stay as they are."""
    rng = np.random.default_rng(8)
    a, b = (rng.integers(0, 1 << 64, 8000, dtype=np.uint64, endpoint=False) for _ in "ab")
    apart = [int(np.abs(np.frombuffer(near_join.cell_counts(a, c), np.uint8).astype(int) - np.frombuffer(near_join.cell_counts(b, c), np.uint8)).sum())
             for c in (near_join.CELLS, near_join.FINE)]
    assert apart[0] * 9 <= 16000 < apart[1] * 9
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[s:s + n]) for s, n in ((0, 200), (3, 200), (0, 190), (100, 200), (250, 60), (252, 60), (0, 12), (0, 12), (390, 2))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for large in (1 << 30, 50, 1):
        monkeypatch.setattr(near_join, "LARGE", large)
        found.append(sorted(near_join.join_components(docs, 5, 80, 100).collect()))
    assert found[0] == found[1] == found[2] and [r.component_id for r in found[0]] == [0, 0, 0, 3, 4, 4, 6, 6, 8]


def test_blocks_meet_by_size_and_bits():
    """Blocks give the pairs that all cells of all pairs give, and bits leave few pairs of unrelated sets for that."""
    rng = np.random.default_rng(4)
    for m, low, high in ((700, 60, 115), (700, 400, 780), (700, 900, 1700), (30, 60, 115)):
        n = rng.integers(low, high, m)
        cells = np.stack([np.bincount(rng.integers(0, 256, k), minlength=256) for k in n])
        for a, b in rng.integers(0, m, (m // 5, 2)):
            cells[b] = cells[a]
            np.add.at(cells[b], rng.integers(0, 256, n[a] // 12), 1)
            n[b] = cells[b].sum()
        side, label = rng.integers(0, 3, m), rng.integers(0, m // 2, m)
        group = {"side": side, "node": rng.permutation(m) - m // 2, "label": label, "n": n, "cells": np.minimum(cells, 255).astype(np.uint8)}
        apart = np.stack([np.abs(cells - c).sum(axis=1) for c in cells])
        close = (apart * 180 <= (n[:, None] + n) * 20) & (side[:, None] != 1) & (side > 0) & (label[:, None] != label)
        node = group["node"]
        want = {(min(node[x], node[y]), max(node[x], node[y])) for x, y in zip(*np.nonzero(close))}
        found, more = near_join.close_in_block(group, False, 80, 100)
        assert len(want) > 1 and not more and {tuple(p) for p in found.tolist()} == want
        order = [sorted((apart[x, y] / (n[x] + n[y]), y) for y in np.flatnonzero(close[x])) for x in range(m)]
        found, more = near_join.close_in_block(group, True, 80, 100)
        assert {tuple(p) for p in found.tolist()} == {(min(node[x], node[o[0][1]]), max(node[x], node[o[0][1]])) for x, o in enumerate(order) if o}
        assert more == any(len(o) > 1 for o in order)
        asks, meets = np.flatnonzero(side != 1), np.flatnonzero(side > 0)
        looked = sum(len(x) for x, _ in near_join.possible_pairs(group, asks, meets, 80, 100))
        assert m < 100 or looked < len(asks) * len(meets) / 10
