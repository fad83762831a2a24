"""Operator 2, uniform shuffle into shards of exact size.

The counts of rows that each input partition sends to each shard are drawn
first, from the multivariate hypergeometric law that a uniform permutation of
all rows implies.  Then a partition permutes its rows and deals them out by its
counts, the rows move once, and each shard permutes what it got.

The matrix is drawn by halving: the shards' totals are split between the left
and right half of the partitions, and so on, so every level is one parallel
step and no task sees the whole matrix.  A draw inverts the hypergeometric
distribution function within twelve deviations of its mean.  Only DataFrame and
SQL functions are used; randomness is a hash of the seed and a cell or row, so
a task that runs again decides alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.common import Staging

#: Rows of a piece of a shard that one task permutes, about.
PIECE = 50_000


def hypergeometric(u: str, total: str, good: str, draws: str) -> str:
    """SQL for the number of good items among ``draws`` of ``total``, from a uniform ``u``; arguments are SQL.

    Point weights follow from their ratios, starting at 1 at the lower end, so
    no factorial is needed; one pass sums them, a second finds where the sum
    passes u times that.
    """
    mean = f"(cast({draws} as double) * {good} / greatest({total}, 1))"
    sd = f"sqrt({mean} * (1 - cast({good} as double) / greatest({total}, 1)) * ({total} - {draws}) / greatest({total} - 1, 1))"
    lo = f"greatest(0L, {draws} - ({total} - {good}), cast(floor({mean} - 12 * {sd} - 8) as bigint))"
    hi = f"least({draws}, {good}, cast(ceil({mean} + 12 * {sd} + 8) as bigint))"
    steps = f"case when {hi} > {lo} then sequence({lo}, {hi} - 1) else cast(array() as array<bigint>) end"
    ratio = f"(cast({good} - k as double) * ({draws} - k) / (cast(k + 1 as double) * ({total} - {good} - {draws} + k + 1)))"
    weight = f"aggregate({steps}, struct(1D as w, 1D as s), (z, k) -> struct(z.w * {ratio} as w, z.s + z.w * {ratio} as s), z -> z.s)"
    return f"aggregate({steps}, struct(1D as w, 1D as s, {lo} as x, {u} * {weight} as goal), (y, k) -> if(y.goal < y.s, y, struct(y.w * {ratio} as w, y.s + y.w * {ratio} as s, k + 1 as x, y.goal as goal)), y -> y.x)"


def uniform(*of: str) -> str:
    """SQL for a number in [0, 1) that depends on the arguments only."""
    return f"(cast(shiftrightunsigned(xxhash64({', '.join(of)}), 11) as double) / 9007199254740992D)"


def communication_matrix(counts: DataFrame, sizes: list[int], levels: int, seed: int) -> DataFrame:
    """(pid, deal): how many rows each partition (pid, n) sends to each shard; columns sum to ``sizes``, rows to n."""
    spark, shards = counts.sparkSession, len(sizes)
    nodes = spark.sql(f"select 0L as node, {sum(sizes)}L as n, array({', '.join(f'{s}L' for s in sizes)}) as deal")
    for level in range(1, levels + 1):
        below = counts.groupBy(F.shiftright("pid", levels - level).alias("child")).agg(F.sum("n").alias("child_n"))
        left = below.filter("child % 2 = 0").select(F.shiftright("child", 1).alias("at"), F.col("child_n").alias("left_n"))
        both = nodes.join(left, nodes["node"] == left["at"], "left").selectExpr("node", "n", "deal", "coalesce(left_n, 0L) as left_n")
        draw = hypergeometric(uniform(f"{seed}L", f"{level}L", "node", "j"), "v.rest", "v.good", "v.todo")
        cell = "struct(n - aggregate(slice(deal, 1, j), 0L, (a, x) -> a + x) as rest, deal[j] as good, left_n - aggregate(got, 0L, (a, x) -> a + x) as todo)"
        taken = f"aggregate(sequence(0, {shards - 1}), cast(array() as array<bigint>), (got, j) -> concat(got, transform(array({cell}), v -> {draw})))"
        split = both.select("node", "n", "deal", "left_n", F.expr(taken).alias("got"))
        nodes = split.selectExpr("inline(array(struct(2 * node as node, left_n as n, got as deal), struct(2 * node + 1 as node, n - left_n as n, transform(deal, (x, j) -> x - got[j]) as deal)))").filter("n > 0")
    return nodes.selectExpr("cast(node as int) as pid", "deal")


def shuffle_into_shards(rows: DataFrame, shards: int = 16, seed: int = 11) -> DataFrame:
    """``rows`` with shard (0 to shards - 1) and slot (from 0, no gaps): a uniform permutation cut into shards.

    Sizes differ by one at most; the first shards are the larger ones.  Equal
    rows are dealt one by one, so a hot group spreads over all shards.  An
    empty table gives no rows.  Columns of the input named shard or slot are
    replaced.  The input is written to the shared folder once, so partitions
    stay the same when a task runs again.
    """
    spark, rows = rows.sparkSession, rows.drop("shard", "slot")
    staged = Staging(spark).put(rows.withColumn("_loom_rid", F.monotonically_increasing_id()))
    staged = staged.withColumn("_loom_pid", F.shiftright("_loom_rid", 33).cast("int"))
    counts = staged.groupBy(F.col("_loom_pid").alias("pid")).agg(F.count("*").alias("n"))
    total, last = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("pid"), F.lit(0))).first()
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix(counts, sizes, int(last).bit_length(), seed)
    matrix = matrix.selectExpr("pid as _loom_to", "transform(sequence(1, size(deal)), k -> aggregate(slice(deal, 1, k), 0L, (a, x) -> a + x)) as _loom_upto")

    local = Window.partitionBy("_loom_pid").orderBy(F.xxhash64(F.lit(seed + 1), "_loom_rid"), "_loom_rid")
    dealt = staged.withColumn("_loom_at", F.row_number().over(local) - 1).join(matrix, F.col("_loom_pid") == F.col("_loom_to"))
    dealt = dealt.withColumn("shard", F.expr("size(filter(_loom_upto, x -> x <= _loom_at))")).drop("_loom_at", "_loom_to", "_loom_upto")

    cut = max(1, -(-total // (shards * PIECE)))
    order = F.xxhash64(F.lit(seed + 2), "_loom_rid")
    dealt = dealt.withColumn("_loom_piece", F.pmod(order, F.lit(cut)))
    before = Window.partitionBy("shard").orderBy("_loom_piece")
    held = dealt.groupBy("shard", "_loom_piece").agg(F.count("*").alias("_loom_n"))
    held = held.select("shard", "_loom_piece", (F.sum("_loom_n").over(before) - F.col("_loom_n")).alias("_loom_before"))
    own = Window.partitionBy("shard", "_loom_piece").orderBy(order, "_loom_rid")
    placed = dealt.withColumn("_loom_own", F.row_number().over(own) - 1).join(held, ["shard", "_loom_piece"])
    return placed.withColumn("slot", (F.col("_loom_before") + F.col("_loom_own")).cast("long")).select(*rows.columns, "shard", "slot")
