"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A gram is two neighbouring lines, named by their hashes.  Of every ``window``
neighbouring grams the one with the smallest hash is a fingerprint (grams without words
lose to others), and so is every gram, or single line, that reaches ``min_words`` alone.
A run of whole lines that two places share and that has ``min_words`` words holds a
common fingerprint: one line or two are one themselves, longer runs hold a window.

That holds for a window of 2; with a larger one runs of 3 to ``window`` lines can have none.

Fingerprints that occur twice only name candidates.  What is compared are contexts: from
every line the shortest run forward, and the shortest run back, that has ``min_words``
words.  A repeated run of ``min_words`` words is the union of the contexts inside it, and
each of them holds a fingerprint of the run, so only contexts around repeated
fingerprints are written.  The first place of a context, by doc_id and line, keeps it and
all later ones are deleted: no place is compared with a single other document, and no
pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.staging import stage

WORD = r"[^\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _keys(docs: DataFrame, d: str = "d", r: str = "r") -> DataFrame:
    """Names of rows: ``d`` (doc_id, the lowest number when missing) and ``r`` (hash of the text)."""
    return docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))),
                             r: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})


def _fingerprints(window: int, min_words: int) -> Column:
    """Fingerprints of a row with line hashes ``h`` and word counts ``n``: structs (a, b, pos), b 0 for a single line."""
    size = F.size("h")
    steps = F.when(size > 1, F.sequence(F.lit(0), size - 2)).otherwise(F.array().cast("array<int>"))
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    words = lambda i: F.get("n", i) + F.get("n", i + 1)
    order = F.transform(steps, lambda i: F.when(words(i) > 0, F.xxhash64(F.get("h", i), F.get("h", i + 1))).otherwise(F.lit((1 << 63) - 1)))
    long_grams = F.filter(steps, lambda i: words(i) >= min_words)

    def minima(g: Column) -> Column:
        count = F.size(g)

        def least(i):
            part = F.slice(g, i + 1, window)
            return i + F.lit(window) - F.array_position(F.reverse(part), F.array_min(part)).cast("int")

        at = F.when(count >= window, F.transform(F.sequence(F.lit(0), count - window), least)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.array_distinct(at), lambda i: words(i) > 0)

    pairs = F.array_union(long_grams, _let(order, minima))
    singles = F.filter(every, lambda i: F.get("n", i) >= min_words)
    return F.concat(
        F.transform(pairs, lambda i: F.struct(F.get("h", i).alias("a"), F.get("h", i + 1).alias("b"), i.alias("pos"))),
        F.transform(singles, lambda i: F.struct(F.get("h", i).alias("a"), F.lit(0).cast("long").alias("b"), i.alias("pos"))))


def _contexts(min_words: int) -> Column:
    """Contexts of a row's lines that hold one of its sorted line numbers ``hits``: structs (a, b, s, e), lines s to e."""
    size = F.size("h")
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    # Lines without words never complete a context, they only lengthen it at the end away from its words.
    worded = F.filter(every, lambda i: F.get("n", i) > 0) if min_words > 0 else every
    most = max(1, min_words)

    def lines_needed(counts: Column) -> Column:
        """How many of the counts reach min_words, null when all are too few."""
        return F.aggregate(counts, F.struct(F.lit(0).alias("t"), F.lit(0).alias("c")),
                           lambda x, v: F.when((x["c"] > 0) & (x["t"] >= min_words), x).otherwise(
                               F.struct((x["t"] + v).alias("t"), (x["c"] + 1).alias("c"))),
                           lambda x: F.when((x["c"] > 0) & (x["t"] >= min_words), x["c"]))

    def spans(q: Column, m: Column, last: Column, first: Column) -> Column:
        index = F.sequence(F.lit(0), F.size(q) - 1)
        forward = F.flatten(F.transform(F.filter(index, lambda k: F.get(last, k).isNotNull()), lambda k: F.transform(
            F.sequence(F.coalesce(F.get(q, k - 1), F.lit(-1)) + 1, F.get(q, k)),
            lambda i: F.struct(i.alias("s"), F.get(q, F.get(last, k)).alias("e")))))
        back = F.flatten(F.transform(F.filter(index, lambda k: F.get(first, k).isNotNull()), lambda k: F.transform(
            F.filter(F.sequence(F.get(q, k), F.coalesce(F.get(q, k + 1), size) - 1),
                     lambda p: (p != F.get(q, k)) | (F.get(last, F.get(first, k)) != k)),
            lambda p: F.struct(F.get(q, F.get(first, k)).alias("s"), p.alias("e")))))
        return F.concat(forward, back)

    def found(q: Column) -> Column:
        index = F.sequence(F.lit(0), F.size(q) - 1)
        return _let(F.transform(q, lambda i: F.get("n", i)), lambda m: _let(
            F.transform(index, lambda k: k + lines_needed(F.slice(m, k + 1, most)) - 1), lambda last: _let(
                F.transform(index, lambda k: k + 1 - lines_needed(F.reverse(F.slice(
                    m, F.greatest(k + 2 - most, F.lit(1)), F.least(k + 1, F.lit(most)))))),
                lambda first: spans(q, m, last, first))))

    marks = F.flatten(F.transform(F.sequence(F.lit(0), F.size("hits") - 1), lambda k: F.concat(
        F.array_repeat(F.lit(False), F.get("hits", k) - F.coalesce(F.get("hits", k - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    near = _let(marks, lambda mark: F.filter(
        _let(worded, lambda q: F.when(F.size(q) > 0, found(q)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))),
        lambda x: F.exists(F.slice(mark, x["s"] + 1, x["e"] - x["s"] + 1), lambda y: y)))
    return F.transform(near, lambda x: _let(F.slice("h", x["s"] + 1, x["e"] - x["s"] + 1), lambda own: F.struct(
        F.xxhash64(own).alias("a"), F.xxhash64(F.lit(1), own).alias("b"), x["s"].alias("s"), x["e"].alias("e"))))


def repeated_runs(docs: DataFrame, window: int = 2, min_words: int = 50) -> DataFrame:
    """``d``, ``r`` (see ``_keys``) and ``gone``: the numbers of the lines that repeat an earlier run."""
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    arrays = _keys(docs).where("text is not null").select(
        "d", "r", F.transform(lines, lambda x: F.xxhash64(x)).alias("h"),
        F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("n"))
    arrays = stage(arrays, "winnow-lines")
    places = arrays.select("d", "r", F.inline(_fingerprints(window, min_words))).distinct()
    places = stage(places, "winnow-places")
    again = places.groupBy("a", "b").agg(F.count("*").alias("m")).where("m > 1").select("a", "b")
    hits = places.join(again, ["a", "b"]).groupBy("d", "r").agg(F.sort_array(F.collect_set("pos")).alias("hits"))
    contexts = stage(arrays.join(hits, ["d", "r"]).select("d", "r", F.inline(_contexts(min_words))), "winnow-contexts")
    first = (contexts.groupBy("a", "b").agg(F.min(F.struct("d", "r", "s")).alias("f"), F.count("*").alias("m"))
             .where("m > 1").select("a", "b", "f"))
    runs = contexts.join(first, ["a", "b"]).where(F.struct("d", "r", "s") != F.col("f")).select("d", "r", F.struct("s", "e").alias("run"))
    runs = runs.distinct().groupBy("d", "r").agg(F.collect_set("run").alias("runs"))
    return runs.select("d", "r", F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["s"], x["e"])))).alias("gone"))


def dedup_lines(docs: DataFrame, window: int = 2, min_words: int = 50, drop_empty: bool = False) -> DataFrame:
    """``docs`` with later repeats of runs of whole lines deleted from ``text``, and ``n_lines``, ``n_removed``.

    A run counts when it has ``min_words`` words and equals, line by line, any earlier
    place; the earliest place by (doc_id, line) keeps it, also within one document.  Null texts stay null with 0 lines; an empty text is one empty
    line.  Rows with the same doc_id and text are one document: what goes goes from all of
    them.  Rows without a doc_id come before all others.  A document can end empty; with
    ``drop_empty`` those that lost all their words are left out.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    cut = repeated_runs(docs, window, min_words)
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    cut = cut.withColumnsRenamed({"d": "__d", "r": "__r", "gone": "__gone"})
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    rest = _let(lines, lambda x: F.array_join(F.transform(keep, lambda i: F.get(x, i)), "\n"))
    out = (_keys(docs, "__d", "__r").join(cut, ["__d", "__r"], "left")
           .withColumns({"__text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(rest),
                         "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
                         "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}))
    if drop_empty:
        out = out.where("n_removed = 0 or __text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.select(*[F.col("__text").alias("text") if c == "text" else F.col(c) for c in names], "n_lines", "n_removed")
