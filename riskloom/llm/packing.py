"""Best-fit packing of tokenised documents with swap-based local search.

Tokens come from a public tokenizer file; distinct words of a batch are tokenised once.
A document is its ids and an end id; only longer ones than a sequence are cut.  Pieces
are hashed into groups of about ``BINS`` sequences and every group is packed best fit,
longest first.  While a group has more bins than its total length needs, its least
filled bin is drained: documents move to other underfull bins, one is exchanged for a
smaller one, or two for a smaller one.  Every step goes to a bin filled no less and so
increases the sum of squared fills; a bin from which no step is left is passed over, and
the search ends when that is all of them in a sweep that emptied none.  What lies in
underfull bins is packed again together with that of other groups, in as few groups as
hold it, while that saves groups or sequences.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import Words, slices
from riskloom.staging import stage

CAPACITY, END = 4096, 1
#: Bytes of text that are tokenised at a time.
SLICE = 2 << 20
#: Sequences per group, on average.
BINS = 600
#: A bin filled to this share is not packed again.
FULL = 0.995


#: What may follow the letters of a word, and letters below U+0100.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN = r"^(?P<core>[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"


class WordIds:
    """Ids of words, without white space in them, as little-endian bytes."""

    def __init__(self, path: str, keep: int = 200_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.whole, self.keep = Tokenizer.from_file(path), keep
        model, level = self.whole.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenize = model.tokenize
        self.chars = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(128, 256)}
        self.known, self.cores, self.tails = {}, {}, {"": b""}
        # Plain letters can go to the model directly where the file says what the short way assumes.
        self.short = self._is_lower_bpe()

    def _is_lower_bpe(self) -> bool:
        probes = ["abC", "Éàß.", "don't", "x,", "ÿÞ!?"]
        return all(self._fast(p) == self._slow(p) for p in probes)

    def _slow(self, word: str) -> bytes:
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def _fast(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if not core.isalpha() or max(core) >= "Ā":
            return self._slow(word)
        return self._core(core.lower()) + self._slow(word[len(core):])

    def _core(self, core: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(core if core.isascii() else core.translate(self.chars))]).tobytes()

    def _kept(self, words: pa.Array, often: np.ndarray, held: dict, make: Callable[[str], bytes]) -> list[bytes]:
        """Ids of distinct words; those marked ``often`` are kept for later calls while there is room."""
        words = words.to_pylist()
        out = list(map(held.get, words))
        again = often.tolist()
        for i, got in enumerate(out):
            if got is None:
                out[i] = got = make(words[i])
                if again[i] and len(held) < self.keep:
                    held[words[i]] = got
        return out

    def of(self, words: pa.Array, count: np.ndarray) -> list[bytes]:
        """Ids of distinct words that stand ``count`` times each.

        Words of plain letters and marks behind them are taken apart first, so letters are
        tokenised once whatever their case and marks.
        """
        if not self.short or not len(words):
            return self._kept(words, count > 1, self.known, self._slow)
        parts = pc.extract_regex(words, PLAIN)
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        core = pc.utf8_lower(pc.struct_field(parts, "core").filter(pa.array(plain))).dictionary_encode()
        tail = pc.struct_field(parts, "tail").filter(pa.array(plain)).dictionary_encode()
        code, often = core.indices.to_numpy(zero_copy_only=False), np.zeros(len(core.dictionary), np.int64)
        np.add.at(often, code, count[plain])
        cores = self._kept(core.dictionary, often > 1, self.cores, self._core)
        tails = self._kept(tail.dictionary, np.ones(len(tail.dictionary), bool), self.tails, self._slow)
        if len(self.tails) > self.keep // 2:
            self.tails = {"": b""}
        made = [cores[c] + tails[t] for c, t in zip(code.tolist(), tail.indices.to_pylist())]
        if plain.all():
            return made
        made, rest = iter(made), iter(self._kept(words.filter(pa.array(~plain)), count[~plain] > 1, self.known, self._slow))
        return [next(made if p else rest) for p in plain.tolist()]


def token_arrays(texts: pa.Array, ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and where each starts (one more at the end)."""
    w = Words(texts)
    made = ids.of(w.distinct, np.bincount(w.codes, minlength=len(w.distinct)))
    length = np.fromiter(map(len, made), np.int64, len(made)) // 4
    flat = np.frombuffer(b"".join(made), "<u4")
    begin = np.concatenate([[0], np.cumsum(length)])
    size = length[w.codes] if len(w.codes) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(begin[w.codes] - ends[:-1], size) + np.arange(ends[-1]) if len(size) else np.zeros(0, np.int64)
    return flat[at], ends[w.starts]


def cut(batches: Iterator[pa.RecordBatch], ids: WordIds, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    """Pieces of some batches of documents, about ``SLICE`` bytes of text at a time."""
    for batch in batches:
        for part in slices(batch, size=SLICE):
            flat, starts = token_arrays(part.column("text"), ids)
            doc, piece, start, length, crc = [], [], [], [], []
            for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                own = np.append(flat[starts[i]:starts[i + 1]], np.uint32(end)).astype("<u4")
                for k in range(0, len(own), capacity):
                    one = own[k:k + capacity]
                    doc.append(doc_id)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(len(one))
                    crc.append(zlib.crc32(one.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every document's pieces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: cut(batches, WordIds(tokenizer), capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, longest item first into the fullest bin with room."""
    bins, room = [], []  # room: sorted (left, bin)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at == len(room):
            b, left = len(bins), capacity
            bins.append([])
        else:
            left, b = room.pop(at)
        bins[b].append(i)
        if left > lengths[i]:
            bisect.insort(room, (left - lengths[i], b))
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Drain least filled bins by moves and exchanges while there are more bins than the total length needs."""
    bins = [list(b) for b in bins]
    fill = np.array([sum(lengths[i] for i in b) for b in bins])
    spare, emptied, stuck = len(bins) - ceil(sum(lengths) / capacity), False, fill >= capacity
    while spare > 0:
        if stuck.all():
            if not emptied:
                break
            emptied, stuck = False, fill >= capacity
            continue
        src = int(np.where(stuck, capacity + 1, fill).argmin())
        step = _step(bins, fill, lengths, capacity, src)
        if step is None:
            stuck[src] = True
            continue
        out, back, dst = step
        bins[src] = [i for i in bins[src] if i not in out] + back
        bins[dst] = [i for i in bins[dst] if i not in back] + out
        gain = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
        fill[src] -= gain
        fill[dst] += gain
        if not bins[src]:
            fill[src], stuck[src], emptied, spare = capacity, True, True, spare - 1
    return [b for b in bins if b]


def _step(bins, fill, lengths, capacity, src):
    """Items that leave ``src``, items that come back, and the other bin: a move, an exchange of one for one, or of two for one."""
    room = np.where(fill < fill[src], 0, capacity - fill)
    room[src] = 0
    own = sorted(bins[src], key=lambda i: -lengths[i])
    for i in own:
        fits = np.flatnonzero(room >= lengths[i])
        if len(fits):
            return [i], [], int(fits[room[fits].argmin()])
    others = [(b, j) for b in np.flatnonzero(room > 0).tolist() for j in bins[b]]
    if not others:
        return None
    where = np.array([b for b, _ in others])
    size = np.array([lengths[j] for _, j in others])
    left = room[where]
    best = None
    for i in dict((lengths[i], i) for i in own).values():
        gain = lengths[i] - size
        gain = np.where((gain > 0) & (gain <= left), gain, 0)
        at = int(gain.argmax())
        if gain[at] > (best[0] if best else 0):
            best = int(gain[at]), [i], at
    if best is None:
        seen = set()
        for a in range(len(own)):
            for c in range(a + 1, len(own)):
                both = lengths[own[a]] + lengths[own[c]]
                if both in seen:
                    continue
                seen.add(both)
                gain = both - size
                gain = np.where((gain > 0) & (gain <= left), gain, 0)
                at = int(gain.argmax())
                if gain[at] > (best[0] if best else 0):
                    best = int(gain[at]), [own[a], own[c]], at
    return best and (best[1], [others[best[2]][1]], others[best[2]][0])


def place(items: DataFrame, capacity: int = CAPACITY, bins: int = BINS) -> DataFrame:
    """``uid``, ``sequence_id``, ``offset`` for items (unique ``uid``, ``length`` up to ``capacity``)."""
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths, uid = pdf["length"].tolist(), pdf["uid"].to_numpy()
        packed = local_search(best_fit(lengths, capacity), lengths, capacity)
        out = []
        for b, members in enumerate(packed):
            offset, total = 0, sum(lengths[i] for i in members)
            for i in members:
                out.append((uid[i], lengths[i], b, offset, total))
                offset += lengths[i]
        got = pd.DataFrame(out, columns=["uid", "length", "bin", "offset", "fill"]).astype("int64")
        got["grp"] = int(pdf["grp"].iloc[0])
        return got

    done, level, bound, result = None, 0, int(capacity * FULL), ("uid", "sequence_id", "offset")
    left, before, least, groups_before = items.select("uid", "length"), None, 0, 0
    total = items.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, ceil(total / (capacity * bins)))
    while True:
        grouped = left.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)).cast("long"))
        packed = stage(grouped.groupBy("grp").applyInPandas(
            fill, "uid long, length long, bin long, offset long, fill long, grp long"), "packed")
        packed = packed.withColumn("sequence_id", F.lit(level << 48) + F.col("grp") * (1 << 24) + F.col("bin"))
        under, head = F.col("fill") < bound, F.col("offset") == 0
        again, used, short = packed.agg(F.coalesce(F.sum(F.when(under, F.col("length"))), F.lit(0)), F.count_if(head), F.count_if(head & under)).first()
        if before is not None and (used > least or used == least and groups == groups_before):
            return done.unionByName(before.select(*result))  # nothing saved: as it was before
        last = groups == 1
        kept = (packed if last else packed.where(~under)).select(*result)
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        before, least, groups_before = packed.where(under), short, groups
        left, groups, level = before.select("uid", "length"), max(1, ceil(again / (capacity * bins))), level + 1


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` of every piece.

    ``tokenizer`` is the path of a tokenizer file on all machines.  A null text is empty: its
    only id is ``end``.  Rows that repeat a doc_id are packed each.  An empty table gives no
    rows.  Other columns of ``docs`` are ignored.
    """
    made = stage(pieces(docs, tokenizer, capacity, end).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return made.join(place(made, capacity), "uid").drop("uid")
