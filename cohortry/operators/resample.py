"""Grouped stratified splits and subject-level resampling, from hashes of ids."""

from __future__ import annotations

from collections.abc import Callable
from json import loads

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.fixed import SEEDS
from cohortry.functions.hashing import hash_uniform, multiplicities, poisson_weight
from cohortry.operators.ordered import enrich, row_numbers
from cohortry.operators.replicates import Quantile, quantile_draws
from cohortry.session import durable


def pick_strata(df: DataFrame, columns, parts: int, *, label: str = "label") -> list[str]:
    """Longest usable prefix of the stratification columns: every stratum needs at least ``parts`` rows."""
    columns = list(columns)
    for candidate in (columns, columns[:2], columns[:1], [label]):
        present = [c for c in candidate if c in df.columns]
        if present:
            smallest = df.groupBy(*present).count().agg(F.min("count")).first()[0]
            if smallest is not None and smallest >= parts:
                return present
    return []


def _stratum(columns) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    return F.concat_ws("|", *parts) if parts else F.lit("all")


def repeated_splits(df: DataFrame, *, seeds=SEEDS, folds: int = 5, val_fraction: float = 0.2,
                    strata=("label", "event"), row_id: str = "row_id", group: str | None = "patient_id",
                    rows_per_range: int | None = None) -> DataFrame:
    """Table (seed, fold, row_id, role): each row is test once per seed, rows of one group stay together.

    Groups are dealt to folds in hash order within their stratum, so fold sizes per stratum differ by at most one
    group.  A group takes the stratum of its first row.
    """
    by = group or row_id
    outer = pick_strata(df, strata, folds)
    inner = pick_strata(df, strata, 2 * folds)
    units = durable(df.groupBy(F.col(by).alias("_unit")).agg(
        F.min_by(_stratum(outer), F.col(row_id)).alias("_outer"), F.min_by(_stratum(inner), F.col(row_id)).alias("_inner"),
        F.count(F.lit(1)).alias("_n")))
    dealt = units.drop("_n").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn(
        "_u", hash_uniform("split", F.col("seed"), F.col("_unit")))
    dealt = row_numbers(dealt, ["seed", "_outer"], ["_u", "_unit"], "_place", rows_per_range=rows_per_range)
    start = F.floor(hash_uniform("start", F.col("seed"), F.col("_outer")) * folds)
    dealt = dealt.withColumn("_test", ((F.col("_place") - 1 + start) % folds).cast("int"))

    parts = max(2, round(1.0 / val_fraction))
    rest = dealt.select("_unit", "_inner", "seed", "_test", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    rest = rest.withColumn("_v", hash_uniform("val", F.col("seed") + F.col("fold"), F.col("_unit")))
    held_out = F.col("_test") == F.col("fold")
    kept = row_numbers(rest.where(~held_out), ["seed", "fold", "_inner"], ["_v", "_unit"], "_place",
                       rows_per_range=rows_per_range)
    role = F.when(F.col("_place") % parts == 1, F.lit("val")).otherwise(F.lit("train"))
    roles = kept.select("_unit", "seed", "fold", role.alias("role")).unionByName(
        rest.where(held_out).select("_unit", "seed", "fold", F.lit("test").alias("role")))
    # one entry per group with its seeds x folds roles: rows are joined once, and a group with very many rows is salted
    packed = durable(roles.groupBy("_unit").agg(F.collect_list(F.struct("seed", "fold", "role")).alias("_roles"))
                     .join(units.select("_unit", "_n"), "_unit"))
    joined = enrich(df.select(row_id, F.col(by).alias("_unit")), packed, "_unit", size_column="_n")
    return joined.select(row_id, F.explode("_roles").alias("_role")).select("_role.seed", "_role.fold", row_id, "_role.role")


#: groups that are dealt last, over all parts, so that they even out what the parts leave
LAST_GROUPS = 20_000


def _deal(counts: np.ndarray, held: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Fold of each group (rows: its numbers per stratum), in the order given, onto what the folds hold: where the strata it counts in are
    least filled, in units of `scale`."""
    fold = np.zeros(len(counts), dtype=int)
    unit = counts / scale**2
    held = held.copy()
    for i in range(len(counts)):
        fold[i] = k = int(np.argmin(np.round(held @ unit[i], 9)))
        held[k] += counts[i]
    return fold


def _settle(counts: np.ndarray, fold: np.ndarray, held: np.ndarray, scale: np.ndarray, tries: int = 4_000) -> np.ndarray:
    """Moves groups and swaps pairs between the fullest and the emptiest fold of the most uneven stratum while the sum of squares falls."""
    fold, held, x = fold.copy(), (held + np.array([counts[fold == k].sum(0) for k in range(len(held))])) / scale, counts / scale
    for _ in range(tries):
        spread = held.max(0) - held.min(0)
        found = None
        for s in np.argsort(-spread, kind="stable"):
            if spread[s] <= 1:
                break
            a, b = int(held[:, s].argmax()), int(held[:, s].argmin())
            mine, theirs = np.flatnonzero(fold == a)[-400:], np.flatnonzero(fold == b)[-400:]
            out, back = np.vstack((x[mine], np.zeros(x.shape[1]))), np.vstack((x[theirs], np.zeros(x.shape[1])))
            # what goes from a to b changes the sum of squares by 2 d (d - gap)
            gap = held[a] - held[b]
            own = (out**2).sum(1)[:, None] + (back**2).sum(1)[None, :] - 2 * out @ back.T
            change = own - (out @ gap)[:, None] + (back @ gap)[None, :]
            i, j = np.unravel_index(int(change.argmin()), change.shape)
            if change[i, j] < -1e-9:
                found = (a, b, mine[i] if i < len(mine) else None, theirs[j] if j < len(theirs) else None, out[i] - back[j])
                break
        if found is None:
            break
        a, b, i, j, d = found
        if i is not None:
            fold[i] = b
        if j is not None:
            fold[j] = a
        held[a] -= d
        held[b] += d
    return fold


def balanced_group_folds(df: DataFrame, *, seeds=SEEDS, folds: int = 5, strata=("label", "event"), group: str = "patient_id", units_per_part: int = 100_000,
                         rows_per_range: int | None = None) -> DataFrame:
    """Table (seed, group, fold): whole groups dealt so that every stratum is spread evenly over the folds.

    A group counts with its rows in every stratum, in units of the largest group there.  Groups with the same counts are interchangeable: in
    hash order they go round the folds, which adds the same to each.  What doesn't fill a round, fewer than ``folds`` groups per kind, goes one by
    one, largest first, to the fold that holds least in its strata; beyond ``units_per_part`` such groups that happens in parts.  The
    smallest groups of all parts, LAST_GROUPS of them, are dealt at the end onto what all parts hold together, and swapped until no stratum
    gets more even.
    """
    cells = df.groupBy(F.col(group).alias("_unit"), _stratum([c for c in strata if c in df.columns]).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    cells = durable(cells)
    largest = {r["s"]: float(r["n"]) for r in cells.groupBy("s").agg(F.max("n").alias("n")).collect()}
    units = durable(cells.groupBy("_unit").agg(F.to_json(F.sort_array(F.collect_list(F.struct("s", "n")))).alias("_kind")))
    sizes = units.groupBy("_kind").agg(F.count(F.lit(1)).alias("_m"))
    dealt = enrich(units, durable(sizes), "_kind", size_column="_m").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    dealt = row_numbers(dealt.withColumn("_u", hash_uniform("balance", F.col("seed"), F.col("_unit"))), ["seed", "_kind"], ["_u", "_unit"], "_place",
                        rows_per_range=rows_per_range)
    start = F.floor(hash_uniform("start", F.col("seed"), F.col("_kind")) * folds)
    dealt = durable(dealt.withColumn("_whole", F.col("_place") <= F.col("_m") - F.col("_m") % folds))
    even = dealt.where("_whole").select("seed", F.col("_unit").alias(group), ((F.col("_place") - 1 + start) % folds).cast("int").alias("fold"))
    rest = dealt.where("not _whole")
    parts = max(1, -(-rest.count() // (units_per_part * len(list(seeds)))))
    kind = dict(units.dtypes)["_unit"]
    names = sorted(largest)
    scale, last = np.array([largest[s] for s in names]), -(-LAST_GROUPS // parts)

    def vectors(kinds) -> np.ndarray:
        at = {s: i for i, s in enumerate(names)}
        counts = np.zeros((len(kinds), len(names)))
        for i, k in enumerate(kinds):
            for c in loads(k):
                counts[i, at[c["s"]]] = c["n"]
        return counts

    def ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        counts = vectors(pdf["_kind"])
        order = np.lexsort((pdf["_u"].to_numpy(), -(counts / scale).sum(1)))
        return pdf.iloc[order].reset_index(drop=True), counts[order]

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, counts = ordered(pdf)
        first = max(0, len(pdf) - last)
        fold = np.full(len(pdf), -1)
        fold[:first] = _deal(counts[:first], np.zeros((folds, len(names))), scale)
        held = [counts[:first][fold[:first] == k].sum(0).tolist() for k in range(folds)]
        out = pd.DataFrame({"seed": pdf["seed"], "_unit": pdf["_unit"], "_kind": pdf["_kind"], "_u": pdf["_u"], "fold": fold, "held": None})
        return pd.concat([out, pd.DataFrame({"seed": pdf["seed"].iloc[:1], "_unit": pdf["_unit"].iloc[:1], "_kind": None, "_u": 0.0, "fold": -2, "held": [sum(held, [])]})])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf["fold"] == -2
        held = np.array(pdf.loc[whole, "held"].tolist()).sum(0).reshape(folds, len(names))
        seed = pdf["seed"].iloc[0]
        pdf, counts = ordered(pdf[~whole])
        fold = _settle(counts, _deal(counts, held, scale), held, scale) if len(pdf) else np.zeros(0, dtype=int)
        return pd.DataFrame({"seed": seed, group: pdf["_unit"].astype(object), "fold": fold})

    shape = f"seed int, _unit {kind}, _kind string, _u double, fold int, held array<double>"
    parted = rest.select("seed", "_unit", "_kind", "_u", F.pmod(F.xxhash64("_unit"), F.lit(parts)).alias("_part"))
    placed = durable(parted.groupBy("seed", "_part").applyInPandas(greedy, shape))
    settled = placed.where("fold < 0").groupBy("seed").applyInPandas(finish, f"seed int, `{group}` {kind}, fold int")
    return even.unionByName(placed.where("fold >= 0").select("seed", F.col("_unit").alias(group), "fold")).unionByName(settled)


def grouped_folds(df: DataFrame, *, seed, folds: int = 5, group: str = "patient_id", name: str = "fold") -> DataFrame:
    """Plain grouped folds by hash of the group: no shuffle at all."""
    return df.withColumn(name, F.floor(hash_uniform("fold", seed, F.col(group)) * folds).cast("int"))


def stratified_folds(df: DataFrame, *, seed, folds: int, stratum: str, row_id: str = "row_id", name: str = "fold",
                     rows_per_range: int | None = None) -> DataFrame:
    """Row-level folds dealt within the strata of one column."""
    keyed = df.withColumn("_u", hash_uniform("deal", seed, F.col(row_id)))
    dealt = row_numbers(keyed, [stratum], ["_u", row_id], "_place", rows_per_range=rows_per_range)
    return dealt.withColumn(name, ((F.col("_place") - 1) % folds).cast("int")).drop("_u", "_place")


def replicate_rows(df: DataFrame, *, unit: str, replicates: int, seed: int = 42) -> DataFrame:
    """Rows crossed with the replicates that drew them, with multiplicity ``w`` (Poisson(1), zeros dropped).

    One md5 serves four replicates.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))).alias("_block")
    digest = F.md5(F.concat_ws("|", F.lit("boot"), F.lit(str(seed)), F.col("_block").cast("string"), F.col(unit).cast("string")))
    words = F.array(*[F.conv(F.substring(F.col("_digest"), 1 + 8 * j, 8), 16, 10).cast("bigint") / F.lit(4294967296.0) for j in range(4)])
    spread = df.select("*", blocks).withColumn("_digest", digest).withColumn("_words", words)
    drawn = spread.select(*df.columns, "_block", F.posexplode("_words").alias("_j", "_u")).select(
        *df.columns, (F.col("_block") * 4 + F.col("_j")).cast("int").alias("rep"), poisson_weight(F.col("_u")).alias("w"))
    return drawn.where((F.col("w") > 0) & (F.col("rep") < replicates))


def replicate_sums(df: DataFrame, sums: dict[str, Column], *, unit: str, keys=(), replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Rows (keys, rep, sums): each sum with every unit counted as often as the replicate drew it; nulls add nothing.

    Rows are summed per unit first.  A task turns its units into one matrix product, multiplicities by sums, and emits
    replicates x keys rows; no row is repeated per replicate.
    """
    keys, names = list(keys), list(sums)
    per = df.groupBy(unit, *keys).agg(*[F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(n) for n, c in sums.items()])
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    lists = per.groupBy(F.col(unit).cast("string").alias("unit")).agg(F.collect_list(F.struct(key.alias("key"), F.array(*names).alias("v"))).alias("cells"))

    def product(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.iloc[low:low + 1000]
                weights = multiplicities(part["unit"].tolist(), replicates, seed).astype(float)
                cells: dict[str, tuple[list[int], list]] = {}
                for i, row in enumerate(part["cells"]):
                    for cell in row:
                        at, values = cells.setdefault(cell["key"], ([], []))
                        at.append(i)
                        values.append(cell["v"])
                for name, (at, values) in cells.items():
                    found = weights[at].T @ np.array(values, dtype=float)
                    totals[name] = totals[name] + found if name in totals else found
        for name, found in totals.items():
            yield pd.DataFrame({"key": name, "rep": np.arange(replicates, dtype=np.int32), "v": list(found)})

    partial = lists.mapInPandas(product, "key string, rep int, v array<double>")
    total_of = [F.sum(F.col("v")[i]).alias(n) for i, n in enumerate(names)]
    summed = partial.groupBy("key", "rep").agg(*total_of)
    if not keys:
        return summed.select("rep", *names)
    kinds = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    return summed.withColumn("_k", F.from_json("key", kinds)).select(*[F.col(f"_k.`{k}`").alias(k) for k in keys], "rep", *names)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def bootstrap_draws(df: DataFrame, value: str, *, unit: str, replicates: int = 1000, seed: int = 42,
                    statistic: Callable[[Column, Column], Column] = weighted_mean) -> DataFrame:
    """One statistic per replicate; ``statistic`` builds an aggregate from the value and multiplicity columns.

    Means and a :class:`Quantile` repeat no row; any other statistic is aggregated over rows repeated per replicate.
    """
    if replicates < 1:
        raise ValueError("replicates must be positive")
    if statistic is weighted_mean:
        sums = replicate_sums(df, {"_s": F.col(value), "_n": F.lit(1)}, unit=unit, replicates=replicates, seed=seed)
        return sums.where("_n > 0").select("rep", (F.col("_s") / F.col("_n")).alias("draw"))
    if isinstance(statistic, Quantile):
        return quantile_draws(df, value, statistic.q, unit=unit, replicates=replicates, seed=seed)
    drawn = replicate_rows(df.select(unit, value), unit=unit, replicates=replicates, seed=seed)
    return drawn.groupBy("rep").agg(statistic(F.col(value), F.col("w")).alias("draw"))


def bootstrap_interval(df: DataFrame, value: str, *, unit: str, replicates: int = 1000, seed: int = 42,
                       confidence: float = 0.95, statistic: Callable[[Column, Column], Column] = weighted_mean) -> DataFrame:
    """Estimate with a percentile interval, as one row.  Needs two rows at least."""
    alpha = (1.0 - confidence) / 2.0
    one = F.lit(1)
    estimate = df.agg(statistic(F.col(value), one).alias("estimate"), F.count(F.lit(1)).alias("n"))
    guard = F.when(F.col("n") < 2, F.raise_error(F.lit("a bootstrap needs at least two rows")).cast("double")).otherwise(F.col("estimate"))
    draws = bootstrap_draws(df, value, unit=unit, replicates=replicates, seed=seed, statistic=statistic)
    limits = draws.agg(F.percentile("draw", F.lit(alpha)).alias("ci_low"), F.percentile("draw", F.lit(1.0 - alpha)).alias("ci_high"),
                       F.count("draw").alias("replicates"))
    return estimate.select(guard.alias("estimate")).crossJoin(limits)
