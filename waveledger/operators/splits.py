"""Recording-disjoint splits, sample weights and derived targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waveledger.functions import ordered
from waveledger.functions.scalars import portable_hash
from waveledger.sources import tables


def _shuffled(groups: DataFrame, key: str, seed: int) -> DataFrame:
    """Add a digest that orders groups at random but the same way on every run."""
    return groups.withColumn("_digest", F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.col(key).cast("string"))))


def _digest_slice():
    """The first digest characters cut the digest order into 4,096 even slices."""
    return F.conv(F.substring("_digest", 1, 3), 16, 10).cast("bigint")


def _salt_columns(rows: DataFrame) -> list[str]:
    """Plain columns whose values tell rows of one group apart."""
    return [c for c, t in rows.dtypes if t in ("string", "int", "bigint", "double", "float")]


def stratified_group_folds(groups: DataFrame, key: str, label: str, k: int,
                           seed: int = 42) -> DataFrame:
    """One fold (0..k-1) per group; each class is dealt out evenly over the folds.

    `groups` has one row per group (`mixed_group_folds` takes groups of several classes).  Classes start dealing at different folds, so small
    classes do not pile up in fold 0.
    """
    ranked = ordered.running_sums(
        _shuffled(groups.select(key, label), key, seed), [label], ["_digest"], _digest_slice(),
        {"_rank": F.lit(1).cast("bigint")})
    start = portable_hash(F.lit(seed), label) % k
    return ranked.select(key, label, ((F.col("_rank") - 1 + start) % k).alias("fold"))


def _leading_bits(x: Column, bits: int) -> Column:
    """A count with all but its leading bits cleared."""
    drop = F.greatest(F.length(F.bin(x)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def deal_counts(vectors: Sequence[tuple[Sequence[int], int]], totals: Sequence[int], k: int) -> list[list[int]]:
    """For each (class counts, groups that have them) the folds of the groups left after full rounds.

    Vectors are dealt in the given order, one group at a time, to the fold where the squared
    class shares grow least; of equal ones to that with the fewest rows, then to the first. A full
    round gives all folds the same and changes no comparison.
    """
    have = [[0] * len(totals) for _ in range(k)]
    out = []
    for counts, n in vectors:
        folds = []
        for _ in range(n % k):
            def growth(f: int) -> tuple[float, int, int]:
                cost = 0.0
                for x, v, t in zip(have[f], counts, totals):
                    cost += (x * v) / (t * t)
                return cost, sum(have[f]), f

            best = min(range(k), key=growth)
            have[best] = [x + v for x, v in zip(have[best], counts)]
            folds.append(best)
        out.append(folds)
    return out


def mixed_group_folds(rows: DataFrame, key: str, label: str, k: int, seed: int = 42, bits: int = 4,
                      most: int = 1_000_000) -> DataFrame:
    """(key, fold): one fold (0..k-1) per group, also where a group has rows of several classes.

    A group is the vector of its rows per class. Groups of equal vectors are dealt round by
    round, in a random but repeatable order; what a full round leaves goes greedily to where the
    class shares spread least, heaviest vectors first. The driver sees each different vector
    once, never a group: counts keep their `bits` leading bits for the dealing, so there are few
    (at most `most`, or an error says so). A null label is a class of its own.
    """
    counts = rows.groupBy(key, label).agg(F.count(F.lit(1)).alias("_n"))
    classes = counts.groupBy(label).agg(F.sum("_n").alias("n")).orderBy(F.col(label).asc_nulls_first()).collect()
    named = [(r[label], i) for i, r in enumerate(classes) if r[label] is not None]
    index = F.create_map(*[F.lit(x) for pair in named for x in pair])[F.col(label)] if named else F.lit(None).cast("int")
    entry = F.struct(F.coalesce(index, F.lit(0)).alias("c"), "_n")
    held = F.map_from_entries(F.collect_list(entry))
    size = len(classes)
    vector = F.transform(F.sequence(F.lit(0), F.lit(max(size - 1, 0))), lambda c: _leading_bits(
        F.coalesce(F.element_at("_held", c), F.lit(0).cast("bigint")), bits))
    groups = counts.groupBy(key).agg(held.alias("_held")).select(key, vector.alias("_v"))
    groups = tables.staged(groups, "class-counts")
    found = groups.groupBy("_v").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} different class counts: take fewer `bits`")
    order = sorted(((list(r["_v"]), r["n"]) for r in found), key=lambda r: (sum(r[0]), r[0]), reverse=True)
    rest = deal_counts(order, [r["n"] for r in classes], k)
    table = rows.sparkSession.createDataFrame(
        [(place, v, n // k * k, folds) for place, ((v, n), folds) in enumerate(zip(order, rest))],
        "_place bigint, _v array<bigint>, _full bigint, _rest array<int>")
    ranked = ordered.running_sums(_shuffled(groups.join(table, "_v"), key, seed), ["_place"], ["_digest"], _digest_slice(),
                                  {"_rank": F.lit(1).cast("bigint")})
    rank = F.col("_rank") - 1
    fold = F.when(rank < F.col("_full"), rank % k).otherwise(F.get("_rest", (rank - F.col("_full")).cast("int")))
    return ranked.select(key, fold.cast("bigint").alias("fold"))


def group_folds(rows: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """(key, fold) of every group of `rows`: dealt per class, or as class counts if a group has several classes."""
    groups = rows.select(key, label).distinct()
    mixed = groups.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    if mixed.isEmpty():
        return stratified_group_folds(groups, key, label, k, seed).select(key, "fold")
    return mixed_group_folds(rows, key, label, k, seed)


def group_shuffle_split(groups: DataFrame, key: str, test_size: float, val_size: float,
                        seed: int = 1337) -> DataFrame:
    """`test` for ceil(test_size) of the groups, `val` for ceil(val_size) of the rest, else `train`."""
    def held_out(df: DataFrame, share: float, seed: int) -> DataFrame:
        ranked = ordered.running_sums(_shuffled(df, key, seed), [], ["_digest"], _digest_slice(),
                                      {"_rank": F.lit(1).cast("bigint")}, totals={"_n": "_rank"})
        return ranked.select(key, (F.col("_rank") <= F.ceil(F.col("_n") * share)).alias("_held"))

    first = held_out(groups.select(key), test_size, seed)
    test = first.where("_held").select(key, F.lit("test").alias("split"))
    second = held_out(first.where(~F.col("_held")).select(key), val_size, seed + 1)
    rest = second.select(key, F.when(F.col("_held"), "val").otherwise("train").alias("split"))
    return test.unionByName(rest)


def fold_membership(rows: DataFrame, folds: DataFrame, key: str, k: int) -> DataFrame:
    """Every row once per fold, as `test` in its own fold and `train` in the k - 1 others."""
    own = folds.select(key, F.col("fold").alias("_own"))
    return (ordered.attach(rows, own, [key], _salt_columns(rows))
            .withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                     F.lit(k - 1).cast("bigint"))))
            .withColumn("role", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train"))
            .drop("_own"))


def leaked_groups(membership: DataFrame, key: str) -> DataFrame:
    """Groups that are both trained on and tested in one fold; must be empty."""
    roles = membership.groupBy("fold", key).agg(F.count_distinct("role").alias("_roles"))
    return roles.where(F.col("_roles") > 1).select("fold", key)


def fold_coverage(membership: DataFrame, key: str) -> DataFrame:
    """Per fold: rows and groups by role, and how many groups leak."""
    per = membership.groupBy("fold", key).agg(
        F.count_if(F.col("role") == "train").alias("tr"),
        F.count_if(F.col("role") == "test").alias("te"))
    return per.groupBy("fold").agg(
        F.sum("tr").alias("train_rows"), F.sum("te").alias("test_rows"),
        F.count_if(F.col("tr") > 0).alias("train_groups"),
        F.count_if(F.col("te") > 0).alias("test_groups"),
        F.count_if((F.col("tr") > 0) & (F.col("te") > 0)).alias("leaked_groups"))


def group_weights(rows: DataFrame, key: str, out: str = "group_weight") -> DataFrame:
    """1 / rows of the group, rescaled so that weights add up to the number of rows.

    The sum of 1/count over all rows is the number of groups, so the rescaling factor is
    rows / groups and needs no second pass over the rows.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    factor = counts.agg((F.sum("_c") / F.count(F.lit(1))).alias("f")).scalar()
    return ordered.attach(rows, counts, [key], _salt_columns(rows)).withColumn(
        out, factor / F.col("_c")).drop("_c")


def class_weights(rows: DataFrame, label: str, out: str = "class_weight") -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    factor = counts.agg((F.sum("_c") / F.count(F.lit(1))).alias("f")).scalar()
    return ordered.attach(rows, counts, [label], _salt_columns(rows)).withColumn(
        out, factor / F.col("_c")).drop("_c")


def min_class_folds(groups: DataFrame, key: str, label: str, most: int = 5) -> DataFrame:
    """Distinct groups, smallest class and the number of folds it allows."""
    per = groups.select(key, label).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    return per.agg(F.count(F.lit(1)).alias("n_classes"), F.sum("_c").alias("n_groups"),
                   F.min("_c").alias("min_class"),
                   F.least(F.lit(most), F.min("_c")).cast("bigint").alias("n_folds"))


def modality_dropout(masks: DataFrame, key: str, modalities: Sequence[str], rate: float,
                     seed: int) -> DataFrame:
    """Hide present modalities at random (by hash), unless that would hide all of them."""
    drop = {m: (portable_hash(F.lit(seed), key, F.lit(m)) / F.lit(float(1 << 32)) < rate)
            for m in modalities}
    kept = {m: F.when(drop[m], 0).otherwise(F.col(f"has_{m}")) for m in modalities}
    left = sum((kept[m] for m in modalities), F.lit(0))
    return masks.withColumns({
        f"kept_{m}": F.when(left == 0, F.col(f"has_{m}")).otherwise(kept[m]) for m in modalities})


def task_targets(rows: DataFrame, binary_operations: Sequence[str]) -> DataFrame:
    """One row per (row, task): condition, operation, reversal, and a two-operation subset."""
    two = F.when(F.col("operation").isin(*binary_operations), F.col("operation"))
    tasks = {"condition": F.col("condition"), "operation": F.col("operation"),
             "reversal": F.col("reversal"), "binary": two}
    pairs = F.array(*[F.struct(F.lit(t).alias("task"), c.alias("target"))
                      for t, c in tasks.items()])
    return (rows.withColumn("_t", F.explode(pairs))
            .withColumns({"task": F.col("_t.task"), "target": F.col("_t.target")})
            .where(F.col("target").isNotNull()).drop("_t"))
