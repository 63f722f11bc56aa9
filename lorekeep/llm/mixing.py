"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, gone through at
most ``epochs`` times.  A copy's virtual finish time is its source's
cumulative tokens divided by the source's target, so that at virtual time 1
every source has delivered its target.  All copies are ordered by finish time
and cut where the total budget is spent.

Running sums are taken in two levels.  A document's place in its source's
shuffle is a 64-bit hash; the hash's leading bits name a slot.  There is a slot
for every SLOT_ROWS rows of the input, so slots stay small.  Sums by
(source, slot) combine before the shuffle and are few, so the running sums
over them are cheap; inside a slot a window adds up single rows.  A source
with a third of all rows is thereby dealt over all slots.  The cut works
alike: copies are range-partitioned by the slot of their finish time, sorted
inside it, and each slot's sum tells where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
#: Slots at least, and rows for each slot.
SLOTS = 1024
SLOT_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def slots_for(rows: int) -> int:
    """A power of two."""
    return max(SLOTS, 1 << max(0, rows // SLOT_ROWS).bit_length())


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` for ``sizes`` (``source, source_size``, one row per source).

    Weights go round the sources by code point, null last.  ``share`` of all
    tokens is split by weight; a target stops at ``most`` times its source's
    tokens and the excess is shared by weight among the others.  Sources
    sorted by the level at which they are full, those below the common level
    are full; the level follows from running sums.  One row per source goes
    through one task here, and nothing else does.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", most * F.col("source_size"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, rest = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tried = named.withColumn("budget", share * F.sum("source_size").over(every)).withColumn(
        "lambda", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    )
    # the first source, in order of fullness, whose cap exceeds its share sets the level
    found = tried.withColumn("level", F.min(F.when(F.col("lambda") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"), F.col("lambda").alias("x")))).over(every))
    return found.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.coalesce(F.col("level.x") * F.col("weight"), F.col("cap")))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, epochs: int = 2, weights: tuple[float, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: one row per input row.

    ``size`` is the number of words (null text: 0), ``taken`` the words that
    the mix takes of the row, over all epochs: whole copies, but for the copy
    at which the budget is spent, whose beginning is taken.  Rows of size 0 take nothing.  Repeated rows
    are neighbours in the shuffle and count one by one.  Sources share a
    budget of ``share`` times all words; an empty input gives no rows.  Copies
    that finish at the same time go by their place in the shuffle.  Long texts
    are counted in whole.  Other columns are left out, so none can clash.
    """
    # "dup" tells repeated rows apart; they are alike, so it does not matter which is which
    n_slots = slots_for(docs.count())
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = slim.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("dups"))
    rows = rows.withColumn("place", F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "source", "size", F.lit(seed)))
    rows = rows.withColumn("slot", F.shiftrightunsigned("place", 64 - (n_slots.bit_length() - 1)))
    slots = rows.groupBy("source", "slot").agg(F.sum(F.col("size") * F.col("dups")).alias("slot_size"))
    up_to = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = slots.withColumn("slot_start", F.sum("slot_size").over(up_to) - F.col("slot_size"))
    goals = targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), share, float(epochs), weights)
    starts = starts.join(goals, starts["source"].eqNullSafe(goals["source"])).select(starts["source"].alias("s_source"), F.col("slot").alias("s_slot"), "slot_start", "source_size", "target")
    within = Window.partitionBy("source", "slot").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = rows.withColumn("in_slot", F.sum(F.col("size") * F.col("dups")).over(within))
    queue = queue.join(starts, queue["source"].eqNullSafe(starts["s_source"]) & (queue["slot"] == starts["s_slot"]))
    queue = queue.select("doc_id", "source", "size", "dups", "place", "source_size", "target", (F.col("slot_start") + F.col("in_slot") - F.col("size") * F.col("dups")).alias("before"))
    copies = queue.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("dups").cast("int"))))
    tokens_then = F.col("turn") * F.col("source_size") + F.col("before") + F.col("copy") * F.col("size")
    copies = copies.withColumn("finish", F.when(F.col("target") > 0, tokens_then / F.col("target")).otherwise(F.shiftrightunsigned("place", 11) / F.lit(2.0**53)))  # nothing to take: anywhere
    taken = cut(copies, share, n_slots)
    per_row = taken.groupBy("doc_id", "source", "size", "copy").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("took").cast("long").alias("taken"))
    return per_row.select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, epochs: int = 2, weights: tuple[float, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """The mix itself: the input's rows, each once for every epoch that takes words of it; all columns stay.

    The copy at which the budget is spent stays whole, so the mix may exceed
    its budget by less than a document.  Rows that agree in id, source and
    size are taken equally often.  Rows that the mix takes nothing of,
    those without words among them, are not in it.
    """
    found = mix(docs, id_col, text_col, source_col, share, epochs, weights, seed).where("taken > 0")
    turns = found.groupBy("doc_id", "source", "size").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("_turns"))
    sized = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"))
    taken = sized.join(turns, sized["_id"].eqNullSafe(turns["doc_id"]) & sized["_source"].eqNullSafe(turns["source"]) & (sized["_size"] == turns["size"]))
    copies = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_turns"))).alias("_turn"))
    return copies.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def cut(copies: DataFrame, share: float, n_slots: int) -> DataFrame:
    """``copies`` with ``took``: the words taken of each in order of ``finish`` until the budget is spent.

    Slots divide the time to 1, when all targets are met, evenly, and what
    comes after by its logarithm, as no more than a few copies of it are
    taken.
    """
    slot = F.when(F.col("finish") <= 1, F.floor(F.col("finish") * n_slots)).otherwise(n_slots + F.floor(F.log2("finish") * n_slots))
    timed = copies.withColumn("time_slot", slot)
    sums = timed.groupBy("time_slot").agg(F.sum("size").alias("slot_size"), F.sum(F.when(F.col("turn") == 0, F.col("size")).otherwise(0)).alias("once"))
    whole = Window.orderBy("time_slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    every = Window.orderBy("time_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row a slot, which becomes its first row: what all slots before it hold, and the budget
    heads = sums.select("time_slot", (F.sum("slot_size").over(every) - F.col("slot_size")).alias("size"), F.floor(share * F.sum("once").over(whole)).cast("long").alias("budget"), F.lit(-1).alias("turn"))
    queue = timed.withColumn("budget", F.lit(None).cast("long")).unionByName(heads, allowMissingColumns=True).repartitionByRange("time_slot")
    slot_rows = Window.partitionBy("time_slot")
    order = slot_rows.orderBy(F.col("turn") >= 0, "finish", "place", "doc_id", "source", "size", "turn", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = queue.withColumns({"up_to": F.sum("size").over(order), "budget": F.max("budget").over(slot_rows)}).where("turn >= 0")
    return placed.withColumn("took", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - (F.col("up_to") - F.col("size")))))
