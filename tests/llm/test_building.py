"""Mixing, packing, sharding and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import ceil

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from riskloom.llm import line_winnow, mixing, near_join, packing, sharding
from riskloom.llm.queries import LEVELS, WEIGHTS, REGISTRY

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = r"[^\x20\x09-\x0D]+"


def water(budget, children):
    """Shares of (weight, capacity): all that can be given, by weight, capped."""
    given, left = {}, dict(enumerate(children))
    while left:
        total = sum(w for w, _ in left.values())
        full = [i for i, (w, c) in left.items() if total and budget * w / total >= c - 1e-9]
        if not full:
            given |= {i: budget * w / total if total else 0 for i, (w, c) in left.items()}
            break
        for i in full:
            given[i] = left[i][1]
        budget -= sum(left.pop(i)[1] for i in full)
    return given


def mixed(rows, levels, weight, share, epochs, seed=7):
    """(doc_id, epoch) of the mixture by the plain rule; rows are (doc_id, text, path)."""
    tokens = {d: len(re.findall(WORD, t or "")) for d, t, _ in rows}
    leaves = defaultdict(list)
    for d, _, p in rows:
        leaves[p].append(d)

    def capacity(prefix):
        return sum(epochs * tokens[d] for p, ds in leaves.items() if p[:len(prefix)] == prefix for d in ds
                   if all(weight(p[:k + 1]) > 0 for k in range(levels)))

    budget = {(): share * sum(tokens.values())}
    for level in range(levels):
        below = {}
        for prefix, b in budget.items():
            children = sorted({p[:level + 1] for p in leaves if p[:level] == prefix})
            got = water(b, [(weight(c), capacity(c)) for c in children])
            below |= {c: got[i] for i, c in enumerate(children)}
        budget = below
    out = set()
    for p, ds in leaves.items():
        size, left = sum(tokens[d] for d in ds), int(budget[p] + 1e-6)
        full = left // size if size else 0
        left -= full * size
        out |= {(d, e) for e in range(full) for d in ds}
        order = sorted(ds, key=lambda d: (hashlib.md5(f"{seed}|{full}|{d}".encode()).hexdigest()[:15], d))
        end = 0
        for d in order if left else []:
            end += tokens[d]
            if end > left:
                break
            out.add((d, full))
    return out


def test_mix_equals_plain_rule(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1)
    rows = [(r.doc_id, r.text, (f"domain{int(r.source[3:]) % 3}", r.lang, r.source)) for r in docs.collect()]
    top, lang = {"domain0": 0.5}, {"en": 0.5, "de": 0.25}
    weight = lambda p: (top.get(p[0], 0.25), lang.get(p[1], 0.125) if len(p) > 1 else 0, 1.0)[len(p) - 1]
    for share, epochs in ((0.5, 3), (2.0, 3), (0.02, 1)):
        got = [(r.doc_id, r.epoch) for r in mixing.mix(docs, LEVELS, WEIGHTS, share, epochs).select("doc_id", "epoch").collect()]
        assert len(got) == len(set(got)) and set(got) == mixed(rows, 3, weight, share, epochs)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000), ("c", "w", 1000)], "p string, q string, tokens long")
    got = {r.q: r.budget for r in mixing.tree_budgets(leaves, ["p", "q"], ["case p when 'c' then 0 else 1 end", "1"], 600.0, 1).collect()}
    assert got == {"x": 10, "y": 290, "z": 300, "w": 0}
    got = {r.q: r.budget for r in mixing.tree_budgets(leaves, ["p", "q"], ["case p when 'c' then 0 else 1 end", "1"], 2500.0, 1).collect()}
    assert got == {"x": 10, "y": 1000, "z": 1000, "w": 0}


def test_ranges_do_not_change_the_mixture(spark, tiny, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    a = {tuple(r) for r in mixing.mix(docs, {"lang": "lang"}, ["1"]).select("doc_id", "epoch").collect()}
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 8)
    assert a == {tuple(r) for r in mixing.mix(docs, {"lang": "lang"}, ["1"]).select("doc_id", "epoch").collect()}


def test_mix_on_odd_rows(odd, none):
    got = mixing.mix(odd, LEVELS, WEIGHTS, share_of_tokens=9.0, max_epochs=2)
    assert {c for c in got.columns if not c.startswith("mix_")} == set(odd.columns)
    assert max(Counter(tuple(r) for r in got.select("doc_id", "epoch", F.md5("text")).collect()).values()) <= 2
    assert mixing.mix(none, LEVELS, WEIGHTS).count() == 0


def pieces_of(rows, capacity=4096):
    tokenizer, out = Tokenizer.from_file(TOKENIZER), Counter()
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), capacity):
            out[d, k // capacity, k, len(ids[k:k + capacity]), zlib.crc32(ids[k:k + capacity].tobytes())] += 1
    return out


def check_packing(docs, capacity=4096):
    rows = packing.pack(docs, TOKENIZER, capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces_of(
        [tuple(r) for r in docs.select("doc_id", "text").collect()], capacity)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), ceil(sum(r.length for r in rows) / capacity)


def test_packing(spark, tiny):
    used, least = check_packing(spark.read.parquet(f"{tiny}/documents.parquet"))
    assert used == least


def test_packing_in_many_groups(spark, tiny, monkeypatch):
    monkeypatch.setattr(packing, "BINS", 3)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    items = packing.pieces(docs, TOKENIZER).withColumn("uid", F.monotonically_increasing_id())
    rows = packing.place(items.select("uid", "length"), bins=3).collect()
    assert len({r.uid for r in rows}) == len(rows) == items.count()
    total = items.agg(F.sum("length")).first()[0]
    assert len({r.sequence_id for r in rows}) <= ceil(total / 4096) + 2


def test_little_text_is_tokenised_at_a_time(monkeypatch):
    """A batch of many texts goes in slices, with the pieces that the batch has as a whole."""
    import pyarrow as pa
    sizes, whole, ids = [], packing.token_arrays, packing.WordIds(TOKENIZER)
    monkeypatch.setattr(packing, "token_arrays", lambda texts, ids: sizes.append(texts.nbytes) or whole(texts, ids))
    texts = [f"some words of text {i} " * 5_000 for i in range(60)]
    batch = pa.record_batch({"doc_id": pa.array(range(60)), "text": pa.array(texts)})
    got = [r for part in packing.cut([batch], ids, 4096, 1) for r in part.to_pylist()]
    assert max(sizes) < (2 << 20) + 200_000 and len(sizes) > 1
    flat, starts = whole(batch.column("text"), ids)
    for r in got:
        own = np.append(flat[starts[r["doc_id"]]:starts[r["doc_id"] + 1]], np.uint32(1)).astype("<u4")
        assert zlib.crc32(own[r["start"]:r["start"] + 4096].tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in got) == len(flat) + 60


def test_packing_on_odd_rows(odd, none):
    check_packing(odd)
    assert packing.pack(none, TOKENIZER).count() == 0


@pytest.mark.parametrize("text", ["don't WON'T it's", "ÀÉÎ straße ﬁn İstanbul", "áb é", "x<|endoftext|>y <|startoftext|>", "100,000.5%!!! ~~", "日本語 текст",
                                  "a b c\x1cd", "ΑΣ ΣΑΣ.", "'s's 'll'", "🙂🙂 ok", "µªº ÿŸ"])
def test_ids_of_words_are_ids_of_the_text(text):
    import pyarrow as pa
    ids, _ = packing.token_arrays(pa.array([text, None, text]), packing.WordIds(TOKENIZER))
    own = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert ids.tolist() == own + own


def test_letters_are_tokenised_once_whatever_their_case_and_marks():
    import pyarrow as pa
    text = "Wordy wordy, WORDY. Éclair éclair; x2 don't ÿÞ!? ſtrange \u212aelvin a\x1cb ×"
    ids, asked = packing.WordIds(TOKENIZER), []
    ids.tokenize = lambda core: asked.append(core) or ids.whole.model.tokenize(core)
    got, _ = packing.token_arrays(pa.array([text]), ids)
    assert len(asked) == 3 and len(set(asked)) == 3
    assert got.tolist() == [i for w in text.split(" ") for i in ids.whole.encode(w, add_special_tokens=False).ids]


def test_local_search_beats_the_start():
    rng = np.random.default_rng(0)
    better = 0
    for _ in range(30):
        lengths = rng.integers(200, 700, 60).tolist()
        start = packing.best_fit(lengths, 1000)
        end = packing.local_search(start, lengths, 1000)
        assert sorted(i for b in end for i in b) == list(range(60)) and all(sum(lengths[i] for i in b) <= 1000 for b in end)
        assert len(end) <= len(start)
        bad = [[i] for i in range(60)]
        better += len(packing.local_search(bad, lengths, 1000)) < 60
    assert better == 30


def test_local_search_goes_on_past_bins_without_a_step():
    lengths = np.random.default_rng(7).integers(1100, 2000, 400).tolist()
    start = packing.best_fit(lengths, 4096)
    end = packing.local_search(start, lengths, 4096)
    assert sorted(i for b in end for i in b) == list(range(400)) and all(sum(lengths[i] for i in b) <= 4096 for b in end)
    assert len(end) <= 0.98 * len(start)
    assert packing.local_search([[0], [1]], [4096, 4096], 4096) == [[0], [1]] and packing.local_search([], [], 4096) == []


def test_few_sequences_where_bins_stay_underfull(spark):
    lengths = np.random.default_rng(8).integers(1100, 2000, 600).tolist()
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    whole = len(packing.local_search(packing.best_fit(lengths, 4096), lengths, 4096))
    rows = packing.place(items, bins=50).collect()
    assert sorted(r.uid for r in rows) == list(range(600))
    assert len({r.sequence_id for r in rows}) <= 1.03 * whole


def check_shards(docs, shards):
    rows = sharding.shard_documents(docs, shards).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    count = [len(slots.get(i, ())) for i in range(shards)]
    assert max(count) - min(count) <= 1
    groups = defaultdict(Counter)
    for r in rows:
        groups[r.size, r.text_crc32][r["shard"]] += 1
    return groups


def test_copies_share_shards(spark, small):
    groups = check_shards(spark.read.parquet(f"{small}/documents.parquet"), 16)
    assert sum(len(g) for g in groups.values() if sum(g.values()) > 1) <= 1.05 * sum(sum(g.values()) > 1 for g in groups.values())


def test_a_group_of_a_third_is_in_as_few_shards_as_fit(spark):
    docs = spark.range(1600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 400)).alias("text"))
    groups = check_shards(docs, 16)
    hot = sorted(groups[4, zlib.crc32(b"hot")].values())
    assert sum(hot[-6:]) > 0.9 * sum(hot)


def test_shards_of_odd_rows(odd, none):
    check_shards(odd, 4)
    check_shards(odd, 16)
    assert sharding.shard_documents(none).count() == 0


def test_pipeline_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    names, now = docs.columns, docs
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, now, tiny)
        rows = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
        if name == "packed":
            assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.collect()) == pieces_of(rows(now))
            break
        assert out.columns == names and out.count() > 0
        if name == "quality":
            assert set(rows(out)) < set(rows(now))
        elif name == "line_dedup":
            assert {d for d, _ in rows(out)} <= {d for d, _ in rows(now)}
        elif name == "near_dedup":
            found = near_join.join_components(now, 5, 80, 100).collect()
            assert sorted(d for d, _ in rows(out)) == sorted({r.component_id for r in found})
        else:
            assert set(rows(out)) <= set(rows(now))
        now = out


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 11))


def test_emptied_documents_leave_the_pipeline(spark, tiny):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", "a", 5), (2, text, "en", "a", 5), (3, "short", "en", "a", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, tiny).collect()}
    assert got == {1: text, 3: "short"}
    assert line_winnow.dedup_lines(docs).where("doc_id = 2").first().text == ""
