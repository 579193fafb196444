"""Agreement statistics (D): one pass of moments for each group; distributions only on the aggregated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkgauge.functions import beta
from sparkgauge.operators.ordering import average_ranks


def pearson_ci(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """R and its Fisher-z interval."""
    m = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    z = F.when(F.abs("r") < 1, F.atanh("r"))
    half = 1.959963984540054 / F.sqrt(F.col("n") - 3.0)
    return m.withColumns({"lo": F.when(F.col("n") > 3, F.tanh(z - half)), "hi": F.when(F.col("n") > 3, F.tanh(z + half))})


def spearman(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Correlation of average ranks."""
    ranked = average_ranks(average_ranks(df, by, x, "_rx"), by, y, "_ry")
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"))


def ccc(x: str, y: str) -> Column:
    """Lin's concordance, population moments."""
    return 2 * F.covar_pop(x, y) / (F.var_pop(x) + F.var_pop(y) + (F.avg(x) - F.avg(y)) * (F.avg(x) - F.avg(y)))


def bland_altman(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """N, bias, sd, limits, standard error, mean absolute error and share inside the limits of d = y - x."""
    d = df.withColumn("_d", F.col(y) - F.col(x))
    m = d.groupBy(*by).agg(F.count("_d").alias("n"), F.avg("_d").alias("bias"), F.stddev_samp("_d").alias("sd"), F.avg(F.abs("_d")).alias("mae"))
    m = m.withColumns({"loa_lo": F.col("bias") - 1.96 * F.col("sd"), "loa_hi": F.col("bias") + 1.96 * F.col("sd"), "se": F.col("sd") / F.sqrt("n")})
    inside = d.join(m.select(*by, "loa_lo", "loa_hi"), list(by)).groupBy(*by).agg((100.0 * F.count_if(F.col("_d").between(F.col("loa_lo"), F.col("loa_hi"))) / F.count("_d")).alias("inside"))
    return m.join(inside, list(by))


def ols(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Slope, intercept and standard error of the slope."""
    m = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_count(y, x).alias("_n"))
    rest = F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx")
    return m.withColumn("slope_se", F.sqrt(F.greatest(rest, F.lit(0.0)) / (F.col("_n") - 2) / F.col("_sxx"))).drop("_sxx", "_syy", "_n")


def tost(df: DataFrame, by: Sequence[str], margins: Sequence[float], d: Column, alpha: float = 0.05) -> DataFrame:
    """Equivalence of the mean of ``d`` to 0 within each margin: the larger of the two one-sided p values."""
    m = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"))
    m = m.withColumn("margin", F.explode(F.array(*[F.lit(float(x)) for x in margins])))
    free = F.col("n") - 1
    p1 = beta.t_tail((F.col("mean") + F.col("margin")) / F.col("se"), free)
    p2 = beta.t_tail((F.col("margin") - F.col("mean")) / F.col("se"), free)
    return m.withColumn("p", F.greatest(p1, p2)).withColumn("equivalent", F.col("p") < alpha)


def wilcoxon(df: DataFrame, by: Sequence[str], d: str) -> DataFrame:
    """Signed-rank sums of the non-zero differences, and the normal p value with tie correction at every n."""
    rows = df.where(F.col(d) != 0).withColumn("_a", F.abs(d))
    ranked = average_ranks(rows, by, "_a", "_r")
    sums = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(d) < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"))
    ties = rows.groupBy(*by, "_a").agg(F.count(F.lit(1)).cast("double").alias("_t")).groupBy(*by).agg(F.sum(F.col("_t") ** 3 - F.col("_t")).alias("_ties"))
    n = F.col("n").cast("double")
    mean, sd = n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    z = (F.least("w_plus", "w_minus") - mean) / sd
    return sums.join(ties, list(by)).withColumn("z", z).withColumn("p", F.least(F.lit(1.0), 2 * beta.normal_tail(-F.col("z")))).withColumn("rule", F.lit("normal")).drop("_ties")


def set_iou(cells: DataFrame, key: str, cell: str, side: str, left: str, right: str, empty_value: float = 1.0) -> DataFrame:
    """Intersection, union and their ratio for each key of rows (key, cell, side); no cell on either side gives ``empty_value``.

    A key without cells is a row with a null cell.
    """
    per = cells.groupBy(key, cell).agg(F.max(F.col(side) == left).alias("l"), F.max(F.col(side) == right).alias("r"))
    there = F.col(cell).isNotNull()
    out = per.groupBy(key).agg(F.count_if(there & F.col("l") & F.col("r")).alias("inter"), F.count_if(there).alias("union_size"), F.count_if(there & F.col("l")).alias("n_left"), F.count_if(there & F.col("r")).alias("n_right"))
    return out.withColumn("iou", F.when(F.col("union_size") == 0, empty_value).otherwise(F.col("inter") / F.col("union_size")))


def flag_overlaps(df: DataFrame, by: Sequence[str], flags: dict[str, Column], sets: dict[str, Sequence[str]]) -> DataFrame:
    """By..., sets, observed, expected, enrichment of rows that carry all flags of each named set.

    A row is one mask of bits and a key has at most 2**flags of them, so the rows are read once for any number of sets; the count of a
    set is that of the masks above it.  ``expected`` is what independent flags would give; enrichment is null where that is 0.  A null
    flag is not carried.
    """
    names = list(flags)
    bit = {n: 1 << i for i, n in enumerate(names)}
    mask = sum((F.when(c, bit[n]).otherwise(0) for n, c in flags.items()), F.lit(0))
    masks = df.groupBy(*by, mask.alias("_m")).agg(F.count(F.lit(1)).alias("_c"))
    over = lambda m: F.sum(F.when(F.col("_m").bitwiseAND(m) == m, F.col("_c")).otherwise(0))
    single = masks.groupBy(*by).agg(F.sum("_c").alias("_n"), *[over(bit[n]).alias(f"_f_{n}") for n in names], *[over(sum(bit[n] for n in s)).alias(f"_s_{k}") for k, s in sets.items()])

    def chance(s: Sequence[str]) -> Column:
        total = F.col("_n").cast("double")
        out = F.lit(1.0)
        for n in s:
            out = out * F.col(f"_f_{n}")
        for _ in s[1:]:
            out = out / total
        return out

    rows = F.array(*[F.struct(F.lit(k).alias("sets"), F.col(f"_s_{k}").alias("observed"), chance(s).alias("expected")) for k, s in sets.items()])
    out = single.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")
    return out.withColumn("enrichment", F.col("observed") / F.nullif(F.col("expected"), F.lit(0.0)))


def band_matched(df: DataFrame, observer: Column, clean: Column, value: str, method: str) -> DataFrame:
    """The other methods' rows, tagged by sample: all, above_zero and band, with the band's ends lo and hi.

    The band is what the observer's own clean pairs span; it is a scalar subquery, so the rows are filtered by it before anything else
    reads them.  Without clean pairs the band is empty.
    """
    ends = df.where(observer & clean).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    others = df.where(~observer)
    samples = {"all": others, "above_zero": others.where(F.col(value) > 0), "band": others.where(F.col(value).between(lo, hi))}
    out = None
    for name, rows in samples.items():
        tagged = rows.withColumn("sample", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out.withColumns({"lo": lo, "hi": hi})
