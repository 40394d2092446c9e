"""Interleave sources so that every stretch of the mix follows target weights.

Pfair scheduling: with integer weights ``w`` that add up to a cycle of ``W``
turns, block ``k`` of a source is released at turn ``floor(k * W / w)`` and due
by turn ``ceil((k + 1) * W / w)``. Taking the released block with the earliest
deadline at each turn keeps every source within one block of its target. The
order repeats every ``W`` turns, so one cycle is laid out, and each row finds
its turn from its number within its source. Only DataFrame operations are used.

When a source has no blocks left its turns fall out and the others keep their
ratios; no row is dropped. Defined results: a null source is a source of its
own; a source that the weights do not name gets weight 1; repeated rows are
blocks of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import number_rows, scratch


def tempered_weights(counts: DataFrame, *, turns: int = 240) -> DataFrame:
    """(source, n) -> (source, n, weight): shares of ``turns`` by the square root of the counts, 1 at least."""
    total = counts.agg(F.sum(F.sqrt("n")).alias("_all"))  # one row
    share = F.round(turns * F.sqrt("n") / F.col("_all")).cast("long")
    return counts.join(F.broadcast(total)).select("source", "n", F.greatest(F.lit(1), share).alias("weight"))


#: Turns that are laid out before their picks are put aside, so that a long cycle is not copied turn by turn.
STRETCH = 200
#: Turns of a cycle, and turns times sources, at most; beyond that the weights are too fine for one task.
LONGEST, MOST_STEPS = 4_000_000, 50_000_000

_GCD = """aggregate(s, 0L, (g, x) -> aggregate(sequence(1, 93), named_struct('a', g, 'b', x.weight),
            (p, i) -> if(p.b = 0, p, named_struct('a', p.b, 'b', p.a % p.b)), p -> p.a))"""

_TURN = """(a, t) -> transform(
             array(array_min(transform(s, (x, i) -> if(
               element_at(a.sent, i + 1) < x.weight and element_at(a.sent, i + 1) * cycle < (t + 1) * x.weight,
               named_struct('due', ((element_at(a.sent, i + 1) + 1) * cycle + x.weight - 1) div x.weight, 'i', i, 'block', element_at(a.sent, i + 1)),
               null)))),
             p -> named_struct('sent', transform(a.sent, (c, j) -> c + if(j = p.i, 1L, 0L)),
                               'picks', concat(a.picks, array(named_struct('i', p.i, 'block', p.block)))))[0]"""


def lay_out(weights: DataFrame) -> DataFrame:
    """(source, block, turn, cycle, weight) for the blocks of one cycle, by earliest deadline.

    Weights are divided by their greatest common divisor. The state is one row
    with a count for each source; the cycle's turns follow each other, so one
    task lays it out: turns times sources steps. A cycle over LONGEST turns or
    MOST_STEPS steps is an error, never an approximation.
    """
    one = weights.agg(F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("s"))
    one = one.selectExpr("s", f"{_GCD} as g").selectExpr("transform(s, x -> named_struct('source', x.source, 'weight', x.weight div g)) as s")
    one = one.selectExpr("s", "aggregate(s, 0L, (n, x) -> n + x.weight) as cycle")
    one = one.selectExpr("s", f"if(cycle > {LONGEST} or cycle * size(s) > {MOST_STEPS}, raise_error(concat('weights make a cycle of ', cycle, ' turns')), cycle) as cycle").where("cycle > 0")
    one = scratch(one, "weights")  # else the optimizer repeats these expressions inside the loop
    none = "cast(array() as array<struct<i: int, block: bigint>>)"
    stretch = f"""aggregate(sequence(g * {STRETCH}L, least((g + 1) * {STRETCH}L, cycle) - 1),
                    named_struct('sent', o.sent, 'picks', {none}), {_TURN})"""
    plan = one.selectExpr(
        "s",
        "cycle",
        f"""aggregate(sequence(0L, (cycle - 1) div {STRETCH}),
              named_struct('sent', transform(s, x -> 0L), 'out', cast(array() as array<array<struct<i: int, block: bigint>>>)),
              (o, g) -> transform(array({stretch}), r -> named_struct('sent', r.sent, 'out', concat(o.out, array(r.picks))))[0],
              o -> o.out) as picks""",
    )
    numbered = one.selectExpr("posexplode(s) as (i, x)", "cycle").selectExpr("i", "x.source as source", "x.weight as weight", "cycle")
    turns = plan.selectExpr("posexplode(picks) as (g, part)").selectExpr("g", "posexplode(part) as (k, pick)")
    turns = turns.selectExpr("pick.i as i", "pick.block as block", f"g * {STRETCH}L + k as turn")
    return turns.join(numbered, "i").select("source", "block", "turn", "cycle", "weight")


def mix_positions(docs: DataFrame, weights: DataFrame | None = None, *, key: Sequence[str] = ("doc_id",), turns: int = 240) -> DataFrame:
    """``key`` columns, source, block, release, due, turn and the gapless ``position`` in the mix.

    Within a source the order is that of ``key``. ``weights``: (source, weight
    as a positive integer); left out, they are tempered from the counts.
    """
    rows = scratch(docs.select(*key, F.col("source").alias("_source")).withColumnRenamed("_source", "source"), "rows")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weights = tempered_weights(counts, turns=turns)
    else:
        given = weights.select(F.col("source").alias("_named"), F.col("weight").cast("long").alias("weight"))
        weights = counts.join(given, counts.source.eqNullSafe(given._named), "left").select("source", "n", F.coalesce("weight", F.lit(1).cast("long")).alias("weight"))
    layout = scratch(lay_out(weights), "cycle")
    numbered = number_rows(rows, key, scope=["source"]).drop("_part").withColumnRenamed("_row", "block")
    rates = layout.select(F.col("source").alias("_s"), "cycle", "weight").distinct()
    numbered = numbered.join(rates, numbered.source.eqNullSafe(rates._s)).drop("_s")
    slots = layout.select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("turn").alias("_t"))
    placed = numbered.join(slots, numbered.source.eqNullSafe(slots._s) & (numbered.block % numbered.weight == slots._b))
    placed = placed.selectExpr(
        *key,
        "source",
        "block",
        "(block * cycle) div weight as release",
        "((block + 1) * cycle + weight - 1) div weight as due",
        "(block div weight) * cycle + _t as turn",
    )
    return number_rows(placed, ["turn"]).drop("_part").withColumnRenamed("_row", "position")
