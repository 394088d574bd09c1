"""Mixing sources to target weights: a time-varying curriculum of whole documents, by DataFrame functions alone.

Each source has a weight that changes over training time t in [0, 1]: its mean weight times a schedule, linear between
knots. The integral of the weight up to t, scaled to the source's target, is the source's cumulative demand in words;
the document that stands at word c of the source's stream is due when the demand reaches c, so the inverse of the
demand gives its position. Sorting by position interleaves the sources as their weights ask at every time.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.operators.graph import written
from caselake.operators.ranks import in_order

#: Knots (time, factor) of each schedule in turn: a source that fades, one that grows, one in the middle of training.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)))
WORD = r"[^\x20\x09-\x0D]+"


def inverse(schedule: tuple[tuple[float, float], ...], u: str) -> str:
    """SQL of the time at which the share ``u`` (SQL, 0 to 1) of the schedule's integral is reached."""
    if any(f < 0 for _, f in schedule) or any(b[0] <= a[0] for a, b in zip(schedule, schedule[1:], strict=False)) or (schedule[0][0], schedule[-1][0]) != (0, 1):
        raise ValueError("a schedule needs factors of 0 or more at rising times from 0 to 1")
    pieces, area = [], 0.0
    for (t, f), (t2, f2) in zip(schedule, schedule[1:], strict=False):
        pieces.append((area, t, f, (f2 - f) / (t2 - t)))
        area += (f + f2) / 2 * (t2 - t)
    if area <= 0:
        raise ValueError("a schedule needs a weight above 0 somewhere")
    out = ""
    for low, t, f, slope in reversed(pieces):
        rest = f"({u} * {area!r}D - {low!r}D)"
        at = f"{t!r}D + coalesce(2 * {rest} / nullif({f!r}D + sqrt(greatest({f * f!r}D + {2 * slope!r}D * {rest}, 0D)), 0D), 0D)"
        out += f" WHEN {u} * {area!r}D >= {low!r}D THEN {at}" if low else f" ELSE {at}"
    return f"CASE{out} END" if " WHEN" in out else out.removeprefix(" ELSE ")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """``sources`` (_none, _source, source_size) with _turn (its place in the order of sources modulo ``weights``) and target.

    Together the targets are ``percent`` of all sizes, shared by weight; none is above ``most`` times its source's size, and what
    is over is shared by weight among the others, until none is above. Sorted by size over weight, the sources
    that stop at their limit come first, so one pass of running sums finds them. Sources of no size get 0.
    """
    step = lcm(*weights)
    ranked = in_order(sources, [F.col("_none"), F.col("_source")])
    turn = (F.col("_rank") % len(weights)).cast("int")
    ranked = ranked.withColumns({"_turn": turn, "_w": F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1)}).withColumnRenamed("_rank", "_place")
    ranked = in_order(ranked.withColumn("_key", F.col("source_size") * F.lit(step) / F.col("_w")), [F.col("_key"), F.col("_place")], {"_size_before": "source_size", "_w_before": "_w"})
    ranked = written(ranked)
    size, weight = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    size, weight = size or 0, weight or 0
    big = lambda c: F.col(c).cast("decimal(38,0)") if isinstance(c, str) else F.lit(c).cast("decimal(38,0)")
    full = big(100 * most) * big("source_size") * (big(weight) - big("_w_before")) <= big("_w") * (big(percent) * big(size) - big(100 * most) * big("_size_before"))
    ranked = ranked.withColumn("_full", full)
    held, free = ranked.agg(F.sum(F.when(F.col("_full"), F.col("source_size"))), F.sum(F.when(~F.col("_full"), F.col("_w")))).first()
    left = float(percent * size - 100 * most * (held or 0))
    target = F.when(F.col("_full"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(F.col("_w") * F.lit(left) / F.lit(100.0 * (free or 1)))
    return ranked.select("_none", "_source", "source_size", "_turn", target.alias("target"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, schedules: tuple = SCHEDULES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken, positions, first_position; range-sorted by first_position.

    Size is the number of words (null: 0). Sources in order of code points, null last, take ``weights`` and ``schedules`` in
    turn. A source's documents stand in a stream, by a digest of the id, then id and size; the mix takes the stream's first
    ``target`` words (to the nearest word), from the start again where the target is above the source's size, and cuts the last
    document it meets. ``taken`` counts a document's words in that stretch, ``positions`` has the time of each
    visit that takes a word. Documents without words, and those the mix doesn't reach, take 0, have no position and stand last.
    Repeated rows each count; null ids are as good as any; other columns of ``docs`` aren't read, and no documents give no rows.

    A source of any share of the rows is cut into the ranges of the sort: sums travel by (range, source), one row each.
    """
    name = docs[source].cast("string")
    sized = docs.select(
        docs[id].alias("doc_id"), F.coalesce(F.regexp_count(docs[text].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        name.isNull().alias("_none"), F.coalesce(name, F.lit("")).alias("_source"), F.substring(F.md5(F.coalesce(docs[id].cast("string"), F.lit("")).cast("binary")), 1, 16).alias("_key"))
    keys = ["_none", "_source"]
    sized = written(sized)
    order = [F.col(c) for c in (*keys, "_key", "doc_id", "size")]
    placed = written(sized.repartitionByRange(*order).sortWithinPartitions(*order).drop("_key").withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    cells = written(placed.groupBy("_part", *keys).agg(F.sum("size").alias("_cell")))
    targets = source_targets(cells.groupBy(*keys).agg(F.sum("_cell").alias("source_size")), weights, percent, most)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_part", *keys, F.coalesce(F.sum("_cell").over(earlier), F.lit(0)).alias("_base")).join(targets, keys)
    inside = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(cells, ["_part", *keys]).withColumn("_before", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("_ask", F.floor(F.col("target") + 0.5))
    visits = F.expr(f"filter(transform(sequence(0, {most - 1}), p -> p * source_size + _before), o -> size > 0 AND o < _ask)")
    taken = F.expr("aggregate(_starts, 0L, (s, o) -> s + least(size, _ask - o))")
    share = "(o / cast(_ask AS DOUBLE))"
    due = "CASE" + "".join(f" WHEN pmod(_turn, {len(schedules)}) = {k} THEN {inverse(s, share)}" for k, s in enumerate(schedules)) + " END"
    out = joined.withColumn("_starts", visits).withColumns({"taken": taken, "positions": F.expr(f"transform(_starts, o -> {due})")})
    out = out.select("doc_id", F.when(~F.col("_none"), F.col("_source")).alias("source"), "size", "source_size", "target", "taken", "positions", F.get("positions", F.lit(0)).alias("first_position"))
    last = [F.col("first_position").asc_nulls_last(), F.col("doc_id"), F.col("size")]
    return out.repartitionByRange(*last).sortWithinPartitions(*last)


def visits(mixed: DataFrame) -> DataFrame:
    """The training order of ``mix``: a row (position, doc_id, visit from 1, words) for each visit, range-sorted by position.

    A document's last visit takes what ``taken`` leaves after whole visits. No documents, or none taken, give no rows.
    """
    at: list[Column] = [F.col("position"), F.col("doc_id"), F.col("visit")]
    each = mixed.select("doc_id", "size", "taken", F.posexplode("positions").alias("_visit", "position"))
    words = F.least(F.col("size"), F.col("taken") - F.col("_visit") * F.col("size"))
    return each.select("position", "doc_id", (F.col("_visit") + 1).cast("int").alias("visit"), words.alias("words")).repartitionByRange(*at).sortWithinPartitions(*at)
