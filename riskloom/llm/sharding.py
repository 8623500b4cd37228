"""Balanced label propagation: linked documents move together under capacity quotas, in DataFrame functions only.

Rows are numbered and dealt evenly to the shards.  Documents with equal texts are
linked; their neighbours are counted per group and shard, so a group of any size is
some rows of counts and no edge is written out.  In every round a linked document that
is not in its group's home (the shards that hold most of the group, as many as it needs
at a shard's capacity) wants to move there.  Shards exchange: what moves from s to t is
limited to what moves from t to s and the unlinked rows that t can send back, so row
counts never change.  Where more want to move than may, those of the largest groups,
with the most neighbours to meet, go first; those of groups of ``STRONG`` and more may
also push out rows of groups of at most ``SMALL``, which lose fewer.  Rounds end when nothing moves or after
``rounds``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.staging import stage

#: A group with more than this share of all rows is joined by broadcast: there are fewer than its inverse of them.
HOT_SHARE = 0.001
#: Group sizes (the first a power of 2): rows of groups this large may push out rows of groups this small.
STRONG, SMALL = 16, 4


def number(df: DataFrame, by: Sequence[str], name: str, first: Sequence[str] = ()) -> DataFrame:
    """Gapless numbers from 0 within ``by``, lower values of ``first`` first, then by ``uid``.

    Rows are numbered inside (``by``, ``first``, part of the input) and shifted by the
    counts of the parts before, so no group is gathered in one task.
    """
    part = (F.shiftright("uid", 33)).alias("_part")
    keyed = df.withColumn("_part", part)
    keys = [*by, *first, "_part"]
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("_m"))
    before = Window.partitionBy(*by, F.lit(0)).orderBy(*first, "_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("_shift", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    inner = Window.partitionBy(*keys).orderBy("uid")
    return (keyed.withColumn("_row", F.row_number().over(inner)).join(shift, keys)
            .withColumn(name, F.col("_shift") + F.col("_row") - 1).drop("_part", "_row", "_shift"))


def _home(counts: DataFrame, capacity: int) -> DataFrame:
    """Groups (``g``) with ``size`` and ``home``: shards in the order of what they hold, as many as the group needs."""
    held = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), F.pmod(F.xxhash64("g", "shard"), F.lit(1 << 20)).alias("tie"), "shard")))
    out = counts.groupBy("g").agg(held.alias("held"), F.sum("m").alias("size"))
    need = F.ceil(F.col("size") / F.lit(max(1, capacity))).cast("int")
    return out.select("g", "size", F.transform(F.slice("held", 1, need), lambda x: x["shard"]).alias("home"))


def propagate(docs: DataFrame, link: Column, shards: int = 16, rounds: int = 8) -> DataFrame:
    """``docs`` with ``uid`` and ``shard``: rows of equal ``link`` (null: not linked) together, row counts at most one apart."""
    rows = stage(docs.withColumn("g", link).withColumn("uid", F.monotonically_increasing_id()), "shard-rows")
    size = rows.groupBy("g").agg(F.count("*").alias("m")).where("g is not null and m > 1")
    linked = stage(rows.select("uid", "g").join(size.select("g"), "g", "left_semi"), "shard-linked")
    total = rows.count()
    capacity = total // shards
    start = number(rows.select("uid"), [], "n").select("uid", F.pmod("n", F.lit(shards)).cast("int").alias("shard"))
    state = stage(start.join(linked, "uid", "left"), "shard-state")
    for _ in range(rounds):
        groups = stage(_home(state.where("g is not null").groupBy("g", "shard").agg(F.count("*").alias("m")), capacity), "shard-homes")
        hot = F.col("size") > max(1, int(total * HOT_SHARE))
        own = state.where("g is not null")
        near = own.join(F.broadcast(groups.where(hot)), "g").unionByName(own.join(groups.where(~hot), "g"))
        home = F.col("home")
        target = F.when(F.array_contains(home, F.col("shard")), F.lit(-1)).otherwise(
            F.get(home, F.pmod(F.xxhash64("uid"), F.size(home).cast("long")).cast("int")))
        less = F.when(F.col("to") >= 0, -F.floor(F.log2(F.col("size")))).otherwise(1).cast("int")
        want = near.withColumn("to", target).withColumn("less", less).select(
            "uid", "g", "shard", F.when((F.col("to") < 0) & (F.col("size") <= SMALL), -2).otherwise(F.col("to")).alias("to"), "less")
        free = state.where("g is null").select("uid", "g", "shard", F.lit(-2).alias("to"), F.lit(0).alias("less"))
        want = stage(want.unionByName(free), "shard-want")

        # Quotas between the shards: at most shards * shards rows.
        flow = want.groupBy("shard", "to").agg(F.count("*").alias("m"), F.count_if(F.col("less") <= 1 - STRONG.bit_length()).alias("strong"),
                                               F.count_if(F.col("less") == 0).alias("free"))
        ids = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
        grid = ids.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> `to`")
        grid = grid.join(flow, ["shard", "to"], "left").select(
            "shard", "to", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("m", "strong")])
        other = max(1, shards - 1)
        spare = flow.where("`to` = -2").select(F.col("shard").alias("to"), F.floor(F.col("free") / other).alias("spare"),
                                               F.floor((F.col("m") - F.col("free")) / other).alias("more"))
        back = grid.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("m").alias("back"))
        quota = (grid.join(back, ["shard", "to"]).join(spare, "to", "left")
                 .withColumn("moves", F.least("m", F.col("back") + F.coalesce("spare", F.lit(0))))
                 .select("shard", "to", (F.col("moves") + F.least(F.greatest(F.col("strong") - F.col("moves"), F.lit(0)),
                                                                  F.coalesce("more", F.lit(0)))).alias("moves")))
        other = quota.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("moves").alias("come"))
        quota = quota.join(other, ["shard", "to"]).select("shard", "to", "moves", F.greatest(
            F.col("come") - F.col("moves"), F.lit(0)).alias("send"))
        quota = stage(quota, "shard-quota")
        if not quota.agg(F.coalesce(F.sum("moves"), F.lit(0))).first()[0]:
            break
        # Unlinked rows of a shard go out in number order, first those for shard 0 and so on.
        upto = Window.partitionBy("shard").orderBy("to")
        sends = quota.withColumn("upto", F.sum("send").over(upto)).groupBy("shard").agg(
            F.array_sort(F.collect_list(F.struct("upto", "to"))).alias("sends"))
        placed = number(want, ["shard", "to"], "n", first=["less"])
        moved = (placed.join(F.broadcast(quota.select("shard", "to", "moves")), ["shard", "to"], "left")
                 .join(F.broadcast(sends), "shard", "left"))
        goes = F.when(F.col("to") >= 0, F.when(F.col("n") < F.col("moves"), F.col("to"))).when(
            F.col("to") == -2, F.get(F.filter("sends", lambda x: x["upto"] > F.col("n")), F.lit(0))["to"])
        state = stage(moved.select("uid", F.coalesce(goes, F.col("shard")).alias("shard"), "g"), "shard-state")
    return rows.drop("g").join(state.select("uid", "shard"), "uid")


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 8) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` of every row; law ``rows``.

    ``size`` is the text's UTF-8 bytes and 1.  A null text has size 1 and the crc of no
    bytes, and is linked with nothing; empty texts are equal texts.  Repeated rows are rows
    of their own.  An empty table gives no rows.  Other columns are ignored.
    """
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                         F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                         F.when(text.isNotNull(), F.xxhash64(text, F.crc32(text.cast("binary")))).alias("same"))
    placed = number(propagate(narrow, F.col("same"), shards, rounds), ["shard"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
