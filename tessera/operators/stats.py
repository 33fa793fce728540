"""Table statistics that cleaning plans need as literals: exact quantiles,
means and modes, computed for many columns in a few distributed passes.

Exact quantiles without gathering a column anywhere: pass 1 gets the count and
a ``percentile_approx`` bracket around every target rank; pass 2 checks each
bracket by counting rows below it and inside it; pass 3 collects the value
counts inside the brackets, which are bounded by ``max_local`` rows (at most
a few thousand at any scale, because the bracket width follows the sketch's
rank error). When a bracket holds too many rows, or the sketch missed, the
bracket is narrowed by a histogram pass with ``buckets`` bins (bounded driver
memory) until it fits. Results use linear interpolation between the two
closest ranks, as pandas and DuckDB ``quantile_cont`` do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import hex52

ACCURACY = 10000


def _stack(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Long (name, v) form of several numeric expressions, nulls removed."""
    items = [F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in cols.items()]
    return (df.select(F.explode(F.array(*items)).alias("x"))
            .select("x.name", "x.v").where(F.col("v").isNotNull()))


def exact_quantiles(df: DataFrame, cols: dict[str, Column], probs: list[float],
                    max_local: int = 200_000, buckets: int = 4096) -> dict[str, list[float | None]]:
    if not cols:
        return {}
    names = list(cols)
    eps = 2.0 / ACCURACY
    lo_p = [max(0.0, p - eps) for p in probs]
    hi_p = [min(1.0, p + eps) for p in probs]
    aggs = []
    for i, n in enumerate(names):
        c = cols[n].cast("double")
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"mn{i}"), F.max(c).alias(f"mx{i}"),
                 F.percentile_approx(c, lo_p + hi_p, ACCURACY).alias(f"ap{i}")]
    r1 = df.agg(*aggs).first()

    # targets[(name, rank)] -> [lo, hi, below]
    targets: dict[tuple[str, int], list] = {}
    counts: dict[str, int] = {}
    for i, n in enumerate(names):
        cnt = r1[f"n{i}"]
        counts[n] = cnt
        if not cnt:
            continue
        ap = r1[f"ap{i}"]
        for j, p in enumerate(probs):
            h = (cnt - 1) * p
            for rank in {math.floor(h), math.ceil(h)}:
                targets[(n, rank)] = [ap[j], ap[len(probs) + j], None]

    minmax = {n: (r1[f"mn{i}"], r1[f"mx{i}"]) for i, n in enumerate(names)}
    values = _resolve(_stack(df, cols), targets, minmax, max_local, buckets, max(counts.values()))

    out: dict[str, list[float | None]] = {}
    for n in names:
        cnt = counts[n]
        res = []
        for p in probs:
            if not cnt:
                res.append(None)
                continue
            h = (cnt - 1) * p
            a, b = values[(n, math.floor(h))], values[(n, math.ceil(h))]
            res.append(a + (h - math.floor(h)) * (b - a))
        out[n] = res
    return out


def _resolve(stacked: DataFrame, targets: dict, minmax: dict, max_local: int, buckets: int,
             n_max: int | None = None) -> dict:
    """Exact values at the target ranks, given approximate brackets."""
    if not targets:
        return {}
    if n_max is not None and n_max * 4.0 / ACCURACY * len(targets) <= max_local:
        fast = _resolve_one_pass(stacked, targets)
        if fast is not None:
            return fast
    # pass 2: verify brackets (rows below, rows inside) in one aggregation
    keys = list(targets)
    checks = []
    for t, (name, rank) in enumerate(keys):
        lo, hi, _ = targets[(name, rank)]
        is_col = F.col("name") == name
        checks += [F.count_if(is_col & (F.col("v") < lo)).alias(f"b{t}"),
                   F.count_if(is_col & F.col("v").between(lo, hi)).alias(f"i{t}")]
    r2 = stacked.agg(*checks).first()
    for t, key in enumerate(keys):
        below, inside = r2[f"b{t}"], r2[f"i{t}"]
        lo, hi, _ = targets[key]
        if below <= key[1] < below + inside:
            targets[key] = [lo, hi, below]
            if inside <= max_local:
                continue
        else:  # sketch missed: restart from the full range
            targets[key] = [minmax[key[0]][0], minmax[key[0]][1], 0]
        _narrow(stacked, key, targets, max_local, buckets)
    return _collect_ranks(stacked, targets)


def _resolve_one_pass(stacked: DataFrame, targets: dict) -> dict | None:
    """One aggregation, one entry per value: a value inside some bracket is
    kept exactly; any other value only as its segment (how many bracket
    bounds lie below it), which is enough to count the rows below every
    bracket. Used when the brackets are known to be small (sketch rank error
    x n); returns None when a sketch bracket missed its rank so the caller
    takes the checked path."""
    bounds: dict[str, list[float]] = {}
    for (name, _), (lo, hi, _) in targets.items():
        bounds.setdefault(name, set()).update([lo, hi])
    bounds = {n: sorted(b) for n, b in bounds.items()}
    v = F.col("v")
    inside = None
    seg = None
    for name, bs in bounds.items():
        is_col = F.col("name") == name
        cond = None
        for (nm, _), (lo, hi, _) in targets.items():
            if nm == name:
                c = v.between(lo, hi)
                cond = c if cond is None else (cond | c)
        s_expr = sum((F.when(v > b, 1).otherwise(0) for b in bs[1:]), F.when(v > bs[0], 1).otherwise(0))
        inside = F.when(is_col, cond) if inside is None else inside.when(is_col, cond)
        seg = F.when(is_col, s_expr) if seg is None else seg.when(is_col, s_expr)
    exact = F.when(inside, v)
    rows = (stacked.select("name", F.when(exact.isNull(), seg).alias("seg"), exact.alias("x"))
            .groupBy("name", "seg", "x").count().collect())
    per: dict[str, list] = {}
    for r in rows:
        per.setdefault(r["name"], []).append((r["seg"], r["x"], r["count"]))
    values = {}
    for (name, rank), (lo, hi, _) in targets.items():
        idx_lo = bounds[name].index(lo)
        entries = per.get(name, [])
        below = sum(c for sg, x, c in entries if (x is None and sg <= idx_lo) or (x is not None and x < lo))
        acc = below
        found = None
        for x, c in sorted((x, c) for sg, x, c in entries if x is not None and lo <= x <= hi):
            if acc + c > rank:
                found = x
                break
            acc += c
        if found is None or below > rank:
            return None
        values[(name, rank)] = found
    return values


def kth_smallest(df: DataFrame, cols: dict[str, Column], ranks: dict[str, int], n: int,
                 max_local: int = 200_000, buckets: int = 4096) -> dict[str, float | None]:
    """Exact value at 0-based ``ranks[name]`` of each column (``n`` non-null
    rows each), with the same bounded passes as ``exact_quantiles``."""
    if not cols or n <= 0:
        return {c: None for c in cols}
    eps = 2.0 / ACCURACY
    aggs = []
    for i, name in enumerate(cols):
        c = cols[name].cast("double")
        p = ranks[name] / max(n - 1, 1)
        aggs += [F.min(c).alias(f"mn{i}"), F.max(c).alias(f"mx{i}"),
                 F.percentile_approx(c, [max(0.0, p - eps), min(1.0, p + eps)], ACCURACY).alias(f"ap{i}")]
    r1 = df.agg(*aggs).first()
    targets = {(name, ranks[name]): [r1[f"ap{i}"][0], r1[f"ap{i}"][1], None] for i, name in enumerate(cols)}
    minmax = {name: (r1[f"mn{i}"], r1[f"mx{i}"]) for i, name in enumerate(cols)}
    values = _resolve(_stack(df, cols), targets, minmax, max_local, buckets, n)
    return {name: values.get((name, ranks[name])) for name in cols}


#: Standard deviations that the bracket of a uniform order statistic reaches to either side.
UNIFORM_SIGMAS = 8.0


def kth_of_uniform(df: DataFrame, cols: dict[str, Column], ranks: dict[str, int], n: int, top: float = 2.0 ** 52,
                   max_local: int = 2_000_000) -> dict[str, float | None]:
    """``kth_smallest`` for columns of uniform draws in [0, ``top``) without nulls, such as seeded hashes.
    Text columns are hex digits: the first 13 are the draw, and are compared as text.

    Where an order statistic of ``n`` uniform draws lies is known beforehand:
    rank k is near ``top * k / n`` with a deviation of ``sqrt(p (1 - p) / n)``.
    So no sketch is needed: one aggregation over one scan counts, for all
    columns, the rows below a bracket of ``UNIFORM_SIGMAS`` deviations and
    gathers the draws inside it (about ``16 sqrt(n p (1 - p))`` a column).
    Brackets that hold more than ``max_local`` rows together, and columns whose
    draws turn out not to be uniform (a key that repeats, say), take the checked
    passes of ``kth_smallest``. The answer is the exact value in every case."""
    if not cols or n <= 0:
        return {c: None for c in cols}
    brackets, expected = {}, 0.0
    for name in cols:
        p = (ranks[name] + 0.5) / n
        reach = UNIFORM_SIGMAS * math.sqrt(max(p * (1 - p), 1 / n) / n) + 1 / n
        brackets[name] = (max(0.0, p - reach) * top, min(1.0, p + reach) * top)
        expected += 2 * reach * n
    if expected > max_local:
        return kth_smallest(df, {name: hex52(c) if isinstance(df.select(c).schema[0].dataType, T.StringType) else c
                                 for name, c in cols.items()}, ranks, n)
    drawn = df.select(*[c.alias(f"v{i}") for i, c in enumerate(cols.values())])
    texts = [isinstance(f.dataType, T.StringType) for f in drawn.schema.fields]
    aggs = []
    for i, (lo, hi) in enumerate(brackets.values()):
        v = F.col(f"v{i}")
        if texts[i]:
            v = F.substring(v, 1, 13)
            lo, hi = format(math.ceil(lo), "013x"), format(min(math.floor(hi), (1 << 52) - 1), "013x")
        else:
            v = v.cast("double")
        aggs += [F.count_if(v < lo).alias(f"below{i}"), F.collect_list(F.when(v.between(lo, hi), v)).alias(f"in{i}")]
    row = drawn.agg(*aggs).first()
    found = {}
    for i, name in enumerate(cols):
        at = ranks[name] - row[f"below{i}"]
        if 0 <= at < len(row[f"in{i}"]):
            kth = sorted(row[f"in{i}"])[at]
            found[name] = float(int(kth, 16)) if texts[i] else kth
    rest = {name: hex52(c) if texts[i] else c for i, (name, c) in enumerate(cols.items()) if name not in found}
    return {**found, **kth_smallest(df, rest, ranks, n)}


def _bracket_filter(targets: dict) -> Column:
    conds = [(F.col("name") == name) & F.col("v").between(lo, hi) for (name, _), (lo, hi, _) in targets.items()]
    cond = conds[0]
    for c in conds[1:]:
        cond = cond | c
    return cond


def _narrow(stacked: DataFrame, key, targets, max_local: int, buckets: int) -> None:
    """Histogram passes until the bracket of ``key`` holds <= max_local rows."""
    name, rank = key
    while True:
        lo, hi, below = targets[key]
        part = stacked.where((F.col("name") == name) & F.col("v").between(lo, hi))
        inside = part.count()
        if inside <= max_local or lo == hi:
            return
        width = (hi - lo) / buckets
        b = F.least(F.floor((F.col("v") - lo) / width).cast("long"), F.lit(buckets - 1))
        hist = sorted(part.groupBy(b.alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("lo"),
                                                    F.max("v").alias("hi")).collect())
        acc = below
        for row in hist:
            if acc + row["c"] > rank:
                targets[key] = [row["lo"], row["hi"], acc]
                break
            acc += row["c"]


def _collect_ranks(stacked: DataFrame, targets: dict) -> dict:
    """Value counts inside all brackets (bounded), walked to each exact rank."""
    vc = (stacked.where(_bracket_filter(targets)).groupBy("name", "v").count().collect())
    by_name: dict[str, list] = {}
    for r in vc:
        by_name.setdefault(r["name"], []).append((r["v"], r["count"]))
    for lst in by_name.values():
        lst.sort()
    values = {}
    for (name, rank), (lo, hi, below) in targets.items():
        if lo == hi:
            values[(name, rank)] = lo
            continue
        acc = below
        for v, c in by_name.get(name, []):
            if v < lo or v > hi:
                continue
            if acc + c > rank:
                values[(name, rank)] = v
                break
            acc += c
    return values


def means(df: DataFrame, cols: dict[str, Column]) -> dict[str, float | None]:
    if not cols:
        return {}
    row = df.agg(*[F.avg(c.cast("double")).alias(n) for n, c in cols.items()]).first()
    return {n: row[n] for n in cols}


def modes(df: DataFrame, cols: dict[str, Column]) -> dict[str, str | None]:
    """Most frequent non-null value per column; ties go to the smallest value.

    One pass: the columns are stacked to (name, value), counted with map-side
    partial aggregation (a value holding a third of the rows is combined
    before the shuffle), and ``min_by`` over (-count, value) keeps one row per
    column -- no window, no sort of a whole column.
    """
    if not cols:
        return {}
    items = [F.struct(F.lit(n).alias("name"), c.cast("string").alias("v")) for n, c in cols.items()]
    counted = (df.select(F.explode(F.array(*items)).alias("x")).select("x.name", "x.v")
               .where(F.col("v").isNotNull()).groupBy("name", "v").count())
    best = counted.groupBy("name").agg(
        F.min_by("v", F.struct((-F.col("count")).alias("nc"), F.col("v").alias("vv"))).alias("mode")).collect()
    found = {r["name"]: r["mode"] for r in best}
    return {n: found.get(n) for n in cols}
