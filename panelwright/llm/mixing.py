"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm._store import pick, stored

MARGINS = ("source", "lang", "topic")
ROUNDS = 12
#: Rounds of raking in one job.
AT_ONCE = 4
#: Tokens that the sample should have, as a share of all.
BUDGET = 0.5
#: Default targets: a value's share of tokens to this power, normalised; 1 keeps the mixture, 0 makes it even.
FLATTEN = 0.5
SEED = 17

WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    """A coarse topic by what a text has, first match first; a null text is ``prose``."""
    has = lambda s: F.contains(text, F.lit(s))
    return F.when(has("icense") | has("opyright"), "legal").when(has("http") | has("@"), "web").when(F.regexp_like(text, F.lit("[0-9]")), "numbers").otherwise("prose")


def uniform(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """A number in [0, 1) from a row's id alone: the same wherever and whenever it is computed."""
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def rake(cells: DataFrame, margins: Sequence[str], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with share: the cell's share of tokens raked so that each margin's shares meet its ``target_<margin>`` column.

    Each round scales, margin by margin, the cells of each value to that value's target. Targets of a margin are taken
    relative to their sum over the values that occur. A cell without tokens keeps share 0.
    """
    total = F.sum("tokens").over(Window.partitionBy())
    now = cells.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
    for turn in range(rounds):
        for m in margins:
            own = F.sum("share").over(Window.partitionBy(m))
            now = now.withColumn("share", F.when(own > 0, F.col("share") * F.col(f"target_{m}") / own).otherwise(0.0))
        if turn % AT_ONCE == AT_ONCE - 1 or turn == rounds - 1:
            now = stored(now, "raked")
    return now


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, margins: Sequence[str] = MARGINS, budget: float = BUDGET, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(doc_id, the margins, n_tokens, weight, p_keep, kept) of each row of ``docs`` (doc_id, text, source, lang).

    Tokens are words between white space. They are summed by cell (a combination of values of the margins); raking fits
    the cells' shares to the targets of every margin: those given by value, or shares flattened by FLATTEN. A value that
    given targets do not name has target 0 and is not sampled. weight is the cell's raked share over its share of
    tokens. p_keep is weight times a factor, at most 1, the factor such that the sample has ``budget`` of all tokens by
    expectation, as far as cells suffice. A row is kept when a number drawn from its id is below p_keep.

    Nulls in a margin are a value of their own (``null`` does not equal the string of that name). A null text has no
    token. A cell of rows without any token cannot be weighed by tokens and keeps all its rows (weight 1). Rows that
    repeat an id share one draw. Other columns are ignored. An empty table gives an empty one.
    """
    rows = pick(docs, "doc_id", "text", *[m for m in margins if m != "topic"])
    if "topic" in margins:
        rows = rows.withColumn("topic", topic(F.col("text")))
    rows = rows.withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).drop("text")
    rows = stored(rows, "mixing-rows")
    cells = rows.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens"))
    for m in margins:
        if targets and m in targets:
            pairs = [F.lit(x) for kv in targets[m].items() for x in kv]
            raw = F.coalesce(F.element_at(F.create_map(*pairs), F.col(m).cast("string")), F.lit(0.0)).cast("double")
        else:
            raw = F.pow(F.sum("tokens").over(Window.partitionBy(m)).cast("double"), F.lit(FLATTEN))
        first = F.row_number().over(Window.partitionBy(m).orderBy(*margins)) == 1
        cells = cells.withColumn("raw", raw).withColumn("once", F.when(first, F.col("raw")).otherwise(0.0))
        every = F.sum("once").over(Window.partitionBy())
        cells = cells.withColumn(f"target_{m}", F.when(every > 0, F.col("raw") / every).otherwise(0.0)).drop("raw", "once")
    cells = rake(stored(cells, "mixing-cells"), margins, rounds)
    total = F.sum("tokens").over(Window.partitionBy()).cast("double")
    cells = cells.withColumn("weight", F.when(F.col("tokens") > 0, F.col("share") * total / F.col("tokens")).otherwise(1.0))
    # the factor: with cells by falling weight, those before the first that does not need its all are taken whole
    order = Window.orderBy(F.desc("weight"), *margins)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rest = budget * total - F.coalesce(F.sum("tokens").over(before), F.lit(0))
    cells = cells.withColumn("factor", F.when(F.sum("share").over(after) > 0, rest / (F.sum("share").over(after) * total)))
    cells = cells.withColumn("factor", F.min(F.when(F.col("factor") * F.col("weight") <= 1, F.struct(-F.col("weight"), F.col("factor")))).over(Window.partitionBy())["factor"])
    p = F.when(F.col("tokens") == 0, 1.0).when(F.col("factor").isNull(), F.when(F.col("share") > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.col("weight") * F.greatest("factor", F.lit(0.0)), F.lit(1.0)))
    cells = stored(cells.select(*[F.col(m).alias(f"cell_{m}") for m in margins], "weight", p.alias("p_keep")), "mixing-weights")
    same = reduce(lambda a, b: a & b, [rows[m].eqNullSafe(cells[f"cell_{m}"]) for m in margins])
    return rows.join(cells, same).select("doc_id", *margins, "n_tokens", "weight", "p_keep", (uniform(seed=seed) < F.col("p_keep")).alias("kept"))
