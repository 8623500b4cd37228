"""Fill-in-middle transformation of whole batches by displacement scatter.

A text is cut into a prefix, a middle and a suffix at two hashed token boundaries and
written in another order between sentinels.  A batch is one run of bytes: a scan finds
the token starts and from them the cuts; every cut is a step in how far its bytes move, so
the steps, put down in a difference array and summed up, give each byte its place in the
output, and one scatter writes all outputs.  Restoring finds the sentinels in the outputs,
sums up steps of the same kind and gathers.  No row is handled by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import as_texts, slices, text_bytes

FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
#: Bytes of text that are cut at a time, and bytes whose shifts are summed up at a time.
SLICE, CHUNK = 2 << 20, 1 << 20
_P, _S, _M = b"PSM"


def _chunks(size: int, at: np.ndarray, step: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Chunks of 0 .. size with the shift of each place: the running sum of the steps at or before it."""
    order = np.argsort(at, kind="stable")
    at, step, carry = at[order], step[order], 0
    for a in range(0, size, CHUNK):
        b = min(a + CHUNK, size)
        i, j = np.searchsorted(at, [a, b])
        shift = np.zeros(b - a, np.int64)
        np.add.at(shift, at[i:j] - a, step[i:j])
        shift[0] += carry
        shift = np.cumsum(shift)
        carry = int(shift[-1])
        yield a, b, shift


def _sentinels(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and text number of every sentinel."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mid = data[1:-1]
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & ((mid == _P) | (mid == _S) | (mid == _M)))
    row = np.searchsorted(starts, at, side="right") - 1
    inside = at + 3 <= starts[row + 1]
    return at[inside], row[inside]


def _steps(starts: list[np.ndarray], shifts: list[np.ndarray], end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the shift changes and by how much, for texts of consecutive segments with one shift each."""
    at = np.concatenate([*starts, end])
    step = np.concatenate([shifts[0], *[b - a for a, b in zip(shifts, shifts[1:])], -shifts[-1]])
    return at, step


def cut(texts: pa.Array, h: list[np.ndarray], plain_at: int = 90, spm_below: int = 20) -> dict:
    """Token counts, forms, cut lengths in code points and outputs of some texts.

    ``h`` holds four unsigned hashes per text: two choose the cuts, the third is compared
    with ``plain_at`` and the fourth with ``spm_below``, both modulo 100.
    """
    data, starts = text_bytes(texts)
    a, e = starts[:-1], starts[1:]
    letter = ((data | 0x20) - np.uint8(97)) < 26
    first = (data & 0xC0) != 0x80
    again = np.zeros(len(data), bool)
    again[1:] = letter[1:] & letter[:-1]
    again[a[a < len(data)]] = False
    token = np.flatnonzero(first & ~again)
    base = np.searchsorted(token, starts)
    n = np.diff(base)

    def place(k: np.ndarray) -> np.ndarray:
        """Byte where token ``k`` of each text starts; its end when there is no such token."""
        inner = k < n
        out = e.copy()
        out[inner] = token[(base[:-1] + k)[inner]]
        return out

    x, y = h[0] % (n + 1), h[1] % (n + 1)
    p, m = place(np.minimum(x, y)), place(np.maximum(x, y))
    taken = np.zeros(len(n), bool)
    taken[_sentinels(data, starts)[1]] = True
    form = np.where((a == e) | taken | (h[2] % 100 >= plain_at), PLAIN, np.where(h[3] % 100 < spm_below, SPM, PSM))

    def chars(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        bounds = np.stack([lo, hi], axis=1).ravel()
        sums = np.add.reduceat(np.concatenate([first, [False]]), bounds, dtype=np.int64)[::2] if len(bounds) else np.zeros(0, np.int64)
        return np.where(hi > lo, sums, 0)

    moved = form != PLAIN
    out_starts = np.concatenate([[0], np.cumsum(e - a + 9 * moved)])
    o = out_starts[:-1]
    to_p = np.where(form == PSM, o + 3, o + 6 + (e - m))
    to_s = np.where(form == PSM, o + 6 + (p - a), o + 3)
    to_m = o + 9 + (p - a) + (e - m)
    move = [np.where(moved, to - at, o - a) for to, at in ((to_p, a), (to_m, p), (to_s, m))]
    out = np.empty(out_starts[-1], np.uint8)
    for lo, hi, shift in _chunks(len(data), *_steps([a, p, m], move, e)):
        out[np.arange(lo, hi) + shift] = data[lo:hi]
    for to, name in ((to_p, _P), (to_s, _S), (to_m, _M)):
        at = to[moved] - 3
        out[at], out[at + 1], out[at + 2] = ord("<"), name, ord(">")
    return {"n": n, "form": form, "prefix_chars": chars(a, p), "middle_chars": chars(p, m), "moved": moved, "output": as_texts(out, out_starts)}


def join(outputs: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts from which ``cut`` made these outputs."""
    data, starts = text_bytes(outputs)
    a, e = starts[:-1].copy(), starts[1:]
    moved = form != PLAIN
    at, row = _sentinels(data, starts)
    at = at[moved[row]]
    if len(at) != 3 * moved.sum() or not (np.bincount(row[moved[row]], minlength=len(form))[moved] == 3).all():
        raise ValueError("an output does not hold its three sentinels")
    s1, s2, s3 = (np.where(moved, 0, a) for _ in range(3))
    s1[moved], s2[moved], s3[moved] = at.reshape(-1, 3).T
    psm = form == PSM
    from_p, from_s, from_m = np.where(psm, s1, s2) + 3, np.where(psm, s2, s1) + 3, s3 + 3
    size_p = np.where(moved, np.where(psm, s2, s3) - from_p, 0)
    size_m = np.where(moved, e - from_m, 0)
    back = np.concatenate([[0], np.cumsum(e - a - 9 * moved)])
    r = back[:-1]
    places = [r, r + size_p, r + size_p + size_m]
    move = [np.where(moved, src - to, a - r) for src, to in zip((from_p, from_m, from_s), places)]
    out = np.empty(back[-1], np.uint8)
    for lo, hi, shift in _chunks(len(out), *_steps(places, move, back[1:])):
        out[lo:hi] = data[np.arange(lo, hi) + shift]
    return as_texts(out, back)


def transform(docs: DataFrame, seed: str = "1", plain_at: int = 90, spm_below: int = 20) -> DataFrame:
    """``doc_id``, ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars``, ``output`` for every row.

    Tokens are runs of letters A to Z of either case and single other characters.  Cuts and
    form follow from the sha256 of ``seed:doc_id``, so equal rows give equal results and no
    run or partitioning matters.  Null and empty texts and texts that hold a sentinel stay as
    they are (form plain, null lengths; a null text gives the empty one).  A missing doc_id
    hashes as the empty text and stays null.  Texts of any length go whole; a task holds about
    ``SLICE`` bytes of them, or one text, at a time.  An empty table gives an empty one.
    Other columns of ``docs`` are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                got = cut(part.column("text"), [part.column(f"h{i}").to_numpy() for i in range(4)], plain_at, spm_below)
                lengths = [pa.array(got[c], pa.int64(), mask=~got["moved"]) for c in ("prefix_chars", "middle_chars")]
                form = pa.DictionaryArray.from_arrays(pa.array(got["form"], pa.int8()), pa.array(FORMS)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got["n"], pa.int64()), form, *lengths, got["output"]],
                                                 names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame, name: str = "restored") -> DataFrame:
    """``outputs`` (``form``, ``output`` and any other columns) with the texts they were made from, in a column ``name``.

    A column of that name is replaced.  A null output or form counts as an empty plain text.
    An output without the three sentinels of its form is an error.
    """
    names = [c for c in outputs.columns if c != name]
    schema = outputs.select(*names).schema.add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "output", SLICE):
                form = np.array([FORMS.index(f or "plain") for f in part.column("form").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, join(part.column("output"), form)], names=[*names, name])

    return outputs.select(*names).mapInArrow(run, schema)
