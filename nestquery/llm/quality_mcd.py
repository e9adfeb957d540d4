"""Operator 5 [native]: quality rules with robust multivariate outlier rejection.

Statistics of each whole text come from array functions within the row (no shuffle).
Each (lang, source) group gets a minimum-covariance-determinant estimate: the mean and
covariance of that share `support` of its rows whose covariance has the least determinant.
Four deterministic starts per group come from robust scatters of the standardised vectors
(median absolute deviations, tanh transforms, spatial signs, quadrant signs); all take
`first` concentration steps, the start of least determinant goes on until its determinant
falls no more.  A step takes the mean and covariance of the rows nearest by the last ones.

A step is one pass over narrow rows: per group, start and bin of the distance it adds up
counts, sums and products, and the bins up to the share's give the moments.  So a step is a
partial aggregation, and a hot group is never gathered.  A row is rejected if its squared
Mahalanobis distance exceeds the chi-squared quantile at 1 - `alpha`.  Variances have
floors, for statistics that most rows share exactly.

Defined cases: null or empty text has no words and fails the base rule; rows that fail it
take no part in the estimate; null lang or source form groups of their own; rows of groups
of fewer than `min_rows` passing rows (ten for each statistic) are judged by the estimate
of all rows of their lang, or, if those are too few as well, of the whole table; repeated
rows are judged each; columns that docs has beside pass through, whatever their names, and
those of the result's names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, durable, let, spread_join, total

MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = r"[#*$%&|<>]"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Standard deviations added to the estimated ones, by statistic of the vector.
FLOORS = [0.5, 0.25, 0.05, 0.15, 0.05]
#: Counts that pull rates of short texts to the usual value.
PRIOR = 50.0
BINS_PER_UNIT, BINS_PER_OCTAVE = 256, 64
#: Groups whose estimates (under 2 KB each) are broadcast; those of more are joined by
#: spread_join.
BROADCAST_GROUPS = 4096


def chi2_cdf(x: float, df: int) -> float:
    """Lower regularised gamma function of df/2 at x/2, by its series."""
    a, x = df / 2, x / 2
    term = s = 1 / a
    k = a
    while term > 1e-17 * s:
        k += 1
        term *= x / k
        s += term
    return s * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid and chi2_cdf(mid, df) < p else (lo, mid) if mid else (mid, hi)
    return hi


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, from the array of word hashes."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])
            return F.filter(F.transform(s, lambda x, k: F.when(same(x, k), x["i"])), lambda i: i.isNotNull())

        def reach(p: Column) -> Column:
            return total(F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW))).cast("long")))

        return let(pairs, lambda s: let(F.sort_array(positions(s)), reach))

    def windows(h: Column) -> Column:
        starts = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    return let(
        let(hashes, windows),
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)),
    )


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with STATS and base_failed added; names that docs has already are replaced."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in {*STATS, "base_failed"}]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cut = docs.select(
        *kept,
        F.filter(F.split(whole, SPACE), lambda w: w != "").alias("\x01words"),
        F.filter(F.split(whole, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("\x01lines"),
        F.when(whole.rlike(SYMBOLS), F.char_length(whole) - F.char_length(F.regexp_replace(whole, SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
    )
    n = F.size("\x01words").cast("long")
    out = cut.select(
        *kept,
        n.alias("n_words"),
        F.char_length(F.array_join("\x01words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("\x01lines") - F.size(F.array_distinct("\x01lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.transform("\x01words", lambda w: F.xxhash64(w))).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def vector(s: DataFrame) -> list[Column]:
    n = F.col("n_words").cast("double")
    return [
        F.log1p(n),
        (F.col("word_chars") + 5 * PRIOR) / (n + PRIOR),
        F.log1p(F.col("n_symbols") / (n + PRIOR)),
        F.col("n_dup_lines") / (F.col("n_dup_lines") + 5.0 + n / 20),
        F.col("n_repeat_words") / (n + PRIOR),
    ]


def _order_statistic(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, m): the lowest bin b up to which lies the share of the rows counted as n."""
    w = Window.partitionBy(*keys)
    ahead = counts.select(*keys, "b", F.sum("n").over(w.orderBy("b")).alias("cum"), F.sum("n").over(w).alias("all"))
    return ahead.where(F.col("cum") >= F.ceil(F.lit(share) * F.col("all"))).groupBy(*keys).agg(F.min("b").alias("m"))


def _swept(m: Column, p: int) -> Column:
    """Inverse of a positive definite p x p matrix (a flat array) and, as one value more, the
    logarithm of its determinant: Gauss-Jordan in place."""

    def step(k: int):
        def swept(a: Column) -> Column:
            pivot = F.get(a, F.lit(k * p + k))

            def cell(i: int, j: int) -> Column:
                row, col = F.get(a, F.lit(k * p + j)), F.get(a, F.lit(i * p + k))
                if i == k and j == k:
                    return 1 / pivot
                if i == k:
                    return row / pivot
                return -col / pivot if j == k else F.get(a, F.lit(i * p + j)) - col * row / pivot

            return F.array(*[cell(i, j) for i in range(p) for j in range(p)], F.get(a, F.lit(p * p)) + F.ln(pivot))

        return swept

    m = F.concat(m, F.array(F.lit(0.0)))
    for k in range(p):
        m = let(m, step(k))
    return m


def _squared(x: list[Column], mean: Column, inverse: Column) -> Column:
    p = len(x)
    d = [c - F.get(mean, F.lit(i)) for i, c in enumerate(x)]
    return sum(
        ((1 if i == j else 2) * F.get(inverse, F.lit(i * p + j)) * d[i] * d[j] for i in range(p) for j in range(i, p)),
        F.lit(0.0),
    )


def _pools(good: DataFrame, gs: list[str], min_rows: int) -> DataFrame:
    """(gs, n, own, used) for each group of n rows: own is the number of leading keys that the
    pool which judges it shares (all, unless it has too few rows), used those of all pools
    that its rows take part in."""
    sizes = good.groupBy(*gs).agg(F.count("*").alias("n"))  # windows over groups, not documents
    levels = list(range(len(gs), -1, -1))
    pool = {k: Window.partitionBy(*gs[:k]) if k else Window.partitionBy(F.lit(0)) for k in levels}
    sizes = sizes.select(*gs, "n", *[F.sum("n").over(pool[k]).alias(f"n{k}") for k in levels])
    own = F.coalesce(*[F.when(F.col(f"n{k}") >= min_rows, k) for k in levels], F.lit(0))
    sizes = sizes.withColumn("own", own)
    used = [F.when(F.max((F.col("own") == k).cast("int")).over(pool[k]) == 1, k) for k in levels]
    return sizes.select(*gs, "n", "own", F.array_compact(F.array(*used)).alias("used"))


def _key(parts: list[Column], level: Column) -> Column:
    """What names a pool: its level, and the keys that its rows share (the others null)."""
    shared = [F.when(level > i, g) for i, g in enumerate(parts)]
    plain = [F.coalesce(g, F.lit("")).alias(f"s{i}") for i, g in enumerate(shared)]
    return F.struct(level.alias("level"), *plain, *[g.isNull().alias(f"no{i}") for i, g in enumerate(shared)])


def _joined(rows: DataFrame, table: DataFrame, key: str, count: str, size: tuple[int, int]) -> DataFrame:
    """rows with the facts of their group; size is the number of rows and that of groups."""
    if size[1] <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(table.drop(count)), key)
    return spread_join(rows, table, [key], count)


def _starts(good: DataFrame, sizes: DataFrame, xs: list[str], size: tuple[int, int]) -> DataFrame:
    """(g, n, centre, starts): for each pool the medians, and inverse scatters to start from."""
    p = len(xs)
    tall = lambda df, cols: df.select("g", F.posexplode(F.array(*cols)).alias("i", "v")).groupBy(
        "g", "i", F.floor(F.col("v") * BINS_PER_UNIT).alias("b")).agg(F.count("*").alias("n"))
    as_array = lambda m, name: m.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s")).select(
        "g", F.transform("s", lambda e: (e["m"] + 0.5) / BINS_PER_UNIT).alias(name))
    centre = as_array(_order_statistic(tall(good, xs), ["g", "i"], 0.5), "centre")
    centre = durable(sizes.join(centre, "g").select("g", "n", "centre"))
    off = _joined(good, centre, "g", "n", size).select("g", *[F.abs(F.col(x) - F.get("centre", F.lit(i))).alias(x) for i, x in enumerate(xs)])
    mad = as_array(_order_statistic(tall(off, xs), ["g", "i"], 0.5), "mad")
    unit = F.array(*[F.lit(1.0) / (1.4826 * F.get("mad", F.lit(i)) + F.lit(f)) for i, f in enumerate(FLOORS)])
    scale = durable(centre.join(mad, "g").select("g", "n", "centre", unit.alias("unit")))
    z = [(F.col(x) - F.get("centre", F.lit(i))) * F.get("unit", F.lit(i)) for i, x in enumerate(xs)]
    z = _joined(good, scale, "g", "n", size).select("g", *[c.alias(x) for c, x in zip(z, xs)])
    norm = F.sqrt(sum((F.col(x) * F.col(x) for x in xs), F.lit(1e-12)))
    kinds = [[F.tanh(x) for x in xs], [F.col(x) / norm for x in xs], [F.signum(x) for x in xs]]
    at = [(i, j) for i in range(p) for j in range(i, p)]
    sums = z.groupBy("g").agg(*[F.avg(k[i] * k[j]).alias(f"m{n}_{i}{j}") for n, k in enumerate(kinds) for i, j in at])
    u = lambda i: F.get("unit", F.lit(i))
    start = [F.array(*[u(i) * u(i) if i == j else F.lit(0.0) for i in range(p) for j in range(p)])]
    for n in range(len(kinds)):  # scatters of standardised vectors, kept away from singular ones
        cell = lambda i, j: F.col(f"m{n}_{min(i, j)}{max(i, j)}") + (0.02 if i == j else 0.0)  # noqa: B023, E731
        inverse = _swept(F.array(*[cell(i, j) for i in range(p) for j in range(p)]), p)
        start.append(let(inverse, lambda a: F.array(*[F.get(a, F.lit(i * p + j)) * u(i) * u(j) for i in range(p) for j in range(p)])))
    return durable(scale.join(sums, "g").select("g", "n", "centre", F.array(*start).alias("starts")))


def _step(good: DataFrame, now: DataFrame, xs: list[str], size: tuple[int, int], support: float) -> DataFrame:
    """(g, n, s, centre, mean, inv, logdet): one concentration step of each start s of now,
    which holds (g, n, centre, at array<struct<s, mean, inv>>)."""
    p = len(xs)
    q = chi2_quantile(support, p)
    factor = support / chi2_cdf(q, p + 2)  # makes the covariance of the nearest share that of all
    near = _joined(good, now, "g", "n", size).select("g", "centre", F.explode("at").alias("at"), *xs)
    d = _squared([F.col(x) for x in xs], F.col("at.mean"), F.col("at.inv"))
    y = [F.col(x) - F.get("centre", F.lit(i)) for i, x in enumerate(xs)]
    near = near.select("g", F.col("at.s").alias("s"), F.floor(BINS_PER_OCTAVE * F.log2(d + 1e-9)).alias("b"), *[c.alias(x) for c, x in zip(y, xs)])
    at = [(i, j) for i in range(p) for j in range(i, p)]
    binned = near.groupBy("g", "s", "b").agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"a{i}") for i, x in enumerate(xs)],
        *[F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"c{i}{j}") for i, j in at],
    )
    w = Window.partitionBy("g", "s")
    binned = binned.withColumn("ahead", F.sum("n").over(w.orderBy("b")) - F.col("n")).withColumn("all", F.sum("n").over(w))
    inner = binned.where(F.col("ahead") < F.ceil(F.lit(support) * F.col("all")))
    m = inner.groupBy("g", "s").agg(F.sum("n").alias("k"), *[F.sum(f"a{i}").alias(f"a{i}") for i in range(p)], *[F.sum(f"c{i}{j}").alias(f"c{i}{j}") for i, j in at])
    mean = lambda i: F.col(f"a{i}") / F.col("k")
    cell = lambda i, j: factor * (F.col(f"c{min(i, j)}{max(i, j)}") / F.col("k") - mean(i) * mean(j)) + (FLOORS[i] ** 2 if i == j else 0.0)
    m = m.select("g", "s", F.array(*[mean(i) for i in range(p)]).alias("off"), _swept(F.array(*[cell(i, j) for i in range(p) for j in range(p)]), p).alias("inv"))
    out = now.select("g", "n", "centre").join(m, "g")
    return out.select(
        "g", "n", "s", "centre", F.zip_with("centre", "off", lambda a, b: a + b).alias("mean"),
        F.slice("inv", 1, p * p).alias("inv"), F.get("inv", F.lit(p * p)).alias("logdet"),
    )


def _gathered(steps: DataFrame) -> DataFrame:
    return steps.groupBy("g").agg(F.first("n").alias("n"), F.first("centre").alias("centre"), F.collect_list(F.struct("s", "mean", "inv")).alias("at"))


def estimates(good: DataFrame, sizes: DataFrame, xs: list[str], support: float = 0.75, first: int = 2, most: int = 50) -> DataFrame:
    """(g, n, mean, inv, logdet) for each pool g of rows (g, xs), sizes being (g, n).

    Steps end when no pool's determinant falls by more than its ten-thousandth part; it never
    rises from what is kept, so `most` only guards against a defect.
    """
    size = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    now = _starts(good, sizes, xs, size)
    at = F.transform("starts", lambda inv, s: F.struct(s.alias("s"), F.col("centre").alias("mean"), inv.alias("inv")))
    now = now.select("g", "n", "centre", at.alias("at"))
    for _ in range(first):
        steps = durable(_step(good, now, xs, size, support))
        now = _gathered(steps)
    best = Window.partitionBy("g").orderBy("logdet", "s")
    open_ = durable(steps.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r"))
    done = open_.limit(0)
    for _ in range(most):
        new = _step(good, _gathered(open_), xs, size, support)
        old = open_.select("g", *[F.col(c).alias(f"{c}0") for c in ("mean", "inv", "logdet")])
        both = durable(new.join(old, "g").withColumn("falls", F.col("logdet") < F.col("logdet0") - 1e-4))
        better = F.col("logdet") < F.col("logdet0")
        kept = [F.when(better, F.col(c)).otherwise(F.col(f"{c}0")).alias(c) for c in ("mean", "inv", "logdet")]
        both = both.select("g", "n", "s", "centre", *kept, "falls")
        done = done.unionByName(both.where(~F.col("falls")).drop("falls"))
        open_ = both.where("falls").drop("falls")
        if open_.isEmpty():
            break
    return durable(done.unionByName(open_).select("g", "n", "mean", "inv", "logdet"))


def judge(
    docs: DataFrame,
    keys: tuple[str, str] = ("lang", "source"),
    text: str = "text",
    support: float = 0.75,
    alpha: float = 1e-3,
    min_rows: int = 50,
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (or its columns `keep`) with STATS, base_failed, distance (null: not judged), kept."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {*STATS, "base_failed", "distance", "kept"}]
    xs = [f"\x01x{i}" for i in range(len(FLOORS))]
    gs = [f"\x01g{i}" for i in range(len(keys))]
    s = statistics(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *keys, text])]), text)
    # The estimate reads the statistics again and again: without the texts.
    own = F.struct(*[F.col(f"`{k}`").cast("string").alias(g) for k, g in zip(keys, gs)]).alias("\x01own")
    row = s.select(*[F.col(f"`{c}`") for c in keep], own, *STATS, "base_failed")
    row = durable(row.select("*", *[x.alias(n) for n, x in zip(xs, vector(row))]))
    group = lambda of, level: _key([F.col(of + g) for g in gs], level)
    good = row.where(~F.col("base_failed")).select("\x01own.*", *xs)
    pools = durable(_pools(good, gs, min_rows))
    size = pools.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    of = pools.select(
        group("", F.lit(len(gs))).alias("\x01group"), "n", F.transform("used", lambda k: group("", k)).alias("in"), group("", F.col("own")).alias("g")
    )
    sizes = of.select("n", F.explode("in").alias("g")).groupBy("g").agg(F.sum("n").alias("n"))
    good = good.select(group("", F.lit(len(gs))).alias("\x01group"), *xs)
    good = _joined(good, of.drop("g"), "\x01group", "n", size).select(F.explode("in").alias("g"), *xs)
    found = estimates(durable(good), durable(sizes), xs, support)
    judged = durable(of.select("\x01group", F.col("n").alias("\x01n"), "g").join(found, "g").select("\x01group", "\x01n", F.struct("mean", "inv").alias("\x01e")))
    cut = chi2_quantile(1 - alpha, len(xs))
    plain = [*[F.col(f"`{c}`") for c in keep], *STATS, "base_failed"]
    passed = row.where(~F.col("base_failed")).withColumn("\x01group", group("\x01own.", F.lit(len(gs))))
    passed = _joined(passed, judged, "\x01group", "\x01n", size)
    passed = passed.select(*plain, _squared([F.col(x) for x in xs], F.col("\x01e.mean"), F.col("\x01e.inv")).alias("distance"))
    failed = row.where("base_failed").select(*plain, F.lit(None).cast("double").alias("distance"))
    return passed.unionByName(failed).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cut, F.lit(False)))


def keep_good(docs: DataFrame, keys: tuple[str, str] = ("lang", "source"), text: str = "text", **params) -> DataFrame:
    """docs without the rows that judge() rejects.

    A verdict depends on text and group alone, so rejected rows are named by the text's
    digest (128 bits) and the group; the anti-join moves texts only if those names are too
    many to broadcast.
    """
    h = F.md5(F.col(text).cast("string"))
    named = docs.select(F.col(text).alias("t"), h.alias("h"), *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    gs = [f"k{i}" for i in range(len(keys))]
    bad = judge(named, tuple(gs), "t", keep=["h", *gs], **params).where(~F.col("kept")).select(
        F.coalesce("h", F.lit("")).alias("\x01h"), *[F.col(g).alias(f"\x01{g}") for g in gs]).distinct()
    on = F.coalesce(h, F.lit("")) == F.col("\x01h")  # null texts are rejected like any other
    for g, k in zip(gs, keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"\x01{g}"))
    return docs.join(bad, on, "left_anti")
