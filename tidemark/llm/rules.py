"""Quality rules: base statistics of every text, and robust multivariate outliers.

Six transformed statistics of a text form its vector.  For each language and source,
each language, and all texts the minimum-covariance-determinant estimate of centre and
scatter is sought by concentration steps over all rows, from two starts (medians, and
plain moments), until it settles; the start that ends with the smaller determinant
counts.  A text whose Mahalanobis distance from its estimate is above CUTOFF is rejected.

A concentration step is one aggregation: rows are binned by the logarithm of their
distance, every bin sums its moments, and the bins up to the H share are added up, the
last one in part, so that the subset has its size exactly.  So no group is ever sorted
or gathered, and a source that holds a third of all rows costs no more than the rest.
Sums are of whole numbers, so reruns agree.

Every language and source has an estimate of its own, whatever its size: its moments are
added to PRIOR rows' worth of its language's, and those to as many of all texts'.  Large
groups hardly notice, a group of a few texts is judged mostly by its language.  NOISE is
added to the variances, so a statistic that is zero in nearly all texts does not make
the scatter singular.

Defined results: a null text has no words and fails the base; a null language or
source is a group of its own; an estimate of a few texts rejects few, as
each is near the centre; repeated rows are judged alike.  All of it is native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, discard

#: PRIOR is five rows for each of the 6 dimensions; STEPS is a bound, most estimates settle before; CUTOFF is the 0.9999 quantile of chi-square with 6 degrees of freedom.
PRIOR, H, STEPS, CUTOFF = 30, 0.75, 8, 27.86
#: Fixed scale: statistics are whole multiples of 1 / UNIT in all sums.
UNIT = 1024
#: Standard deviation that each statistic has at least.
NOISE = (0.05, 0.05, 0.20, 0.20, 0.04, 0.06)
D = len(NOISE)
#: Scatter of the H-subset of a normal sample in 6 dimensions is smaller by this factor.
CONSISTENT = 1.36
BROADCAST_CELLS = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
SYMBOLS, BLANKS, CAPITALS, STOPS = "#*$%&|<>", " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?"


def _without(text: Column, members: str) -> Column:
    return F.length(F.translate(text, members, ""))


def base_statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; reserved prefix `_q_`.

    Repeated windows are first sought by hash; only texts that have some sort their
    windows' words themselves, so the count is exact.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_q_t", text).withColumn("_q_w", F.array_remove(F.split("_q_t", SPACE, -1), "")).withColumn("n_words", F.size("_q_w").cast("long"))
    at = F.when(F.col("n_words") >= window, F.sequence(F.lit(1), (F.col("n_words") - window + 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_q_g", F.transform(at, lambda i: F.xxhash64(F.slice("_q_w", i, window))))
    d = d.withColumn("_q_again", F.size(F.array_distinct("_q_g")) < F.size("_q_g"))
    sort = F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice("_q_w", i, window), " ").alias("k"), i.alias("p"))))
    none = F.array().cast("array<struct<k:string,p:int>>")
    d = d.withColumn("_q_s", F.when(F.col("_q_again"), sort).otherwise(none))
    key = lambda j: F.get(F.col("_q_s"), j)["k"]
    twice = F.filter("_q_s", lambda x, j: F.coalesce(key(j - 1) == x["k"], F.lit(False)) | F.coalesce(key(j + 1) == x["k"], F.lit(False)))
    d = d.withColumn("_q_p", F.sort_array(F.transform(twice, lambda x: x["p"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("_q_p", start, lambda a, p: F.struct((p + window).alias("end"), (a["n"] + p + window - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])
    lines = F.filter(F.split("_q_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # never true; a term that isn't deterministic keeps Catalyst from copying the whole expression into a filter below, where it would run once an element
    never = F.when(F.monotonically_increasing_id() < 0, 1).otherwise(0)
    d = d.withColumn("n_repeat_words", (covered + never).cast("long")).withColumn("_q_l", lines)
    d = d.select(
        *[F.col(f"`{c}`") for c in docs.columns], "n_words", "n_repeat_words", _without(F.col("_q_t"), BLANKS).cast("long").alias("word_chars"),
        (F.length("_q_t") - _without(F.col("_q_t"), SYMBOLS)).cast("long").alias("n_symbols"), (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("n_dup_lines"),
        F.size("_q_l").cast("long").alias("_q_lines"), (F.length("_q_t") - _without(F.col("_q_t"), CAPITALS)).alias("_q_caps"), (F.length("_q_t") - _without(F.col("_q_t"), STOPS)).alias("_q_stops"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def vector(n=F.col) -> list[Column]:
    """The transformed statistics as whole multiples of 1 / UNIT; square roots even out the spread of shares, a few extra units damp short texts."""
    words = F.greatest(n("n_words"), F.lit(1))
    x = [
        F.log(F.greatest(n("word_chars"), F.lit(1)) / words),
        F.sqrt(n("n_symbols") / (n("word_chars") + 10)),
        F.sqrt(n("n_dup_lines") / (n("_q_lines") + 5)),
        F.sqrt(n("n_repeat_words") / (words + 20)),
        F.sqrt(n("_q_caps") / (n("word_chars") + 10)),
        F.sqrt(n("_q_stops") / (words + 10)),
    ]
    return [F.round(c * UNIT).cast("long").alias(f"x{i}") for i, c in enumerate(x)]


def _number(x: float) -> str:
    """x as SQL writes a double."""
    return f"{x!r}D"


def _solved(m: DataFrame) -> DataFrame:
    """From keys, n, sums s<i> and products p<i><j>: centre c<i>, w<i><j> (inverse of the Cholesky factor) and logdet."""
    m = m.select("*", *[F.expr(f"s{i} / cast(n AS double) / {UNIT} AS c{i}") for i in range(D)])
    v = lambda i, j: f"(p{i}{j} / cast(n AS double) / {UNIT * UNIT} - c{i} * c{j}) * {_number(CONSISTENT)}"
    cells = [f"greatest({v(i, j)}, 0D) + {_number(NOISE[i] ** 2)}" if i == j else v(i, j) for i in range(D) for j in range(i + 1)]
    return _factored(m.select(*[c for c in m.columns if c[0] not in "sp" or c == "start"], F.expr(f"array({', '.join(cells)}) AS v")))


def _factored(m: DataFrame) -> DataFrame:
    """m with w<i><j> and logdet for its array v, a lower triangle by rows.

    Triangles are arrays that one fold fills, so a plan has three projections for what
    would be a chain of one a row and column: the driver plans this in every step.
    """
    at = lambda i, j: i * (i + 1) // 2 + j
    cells = [(i, j) for i in range(D) for j in range(i + 1)]
    steps = ", ".join(f"named_struct('v', {at(i, j)}, 'n', {j}, 'a', {at(i, 0) + 1}, 'b', {at(j, 0) + 1}, 'd', {at(j, j)}, 'least', {_number(NOISE[j] ** 2 / 4)})" for i, j in cells)
    rest = "v[x.v] - aggregate(zip_with(slice(l, x.a, x.n), slice(l, x.b, x.n), (p, q) -> p * q), 0D, (t, y) -> t + y)"
    m = m.select("*", F.expr(f"aggregate(array({steps}), cast(array() AS array<double>), (l, x) -> concat(l, array(if(x.d = x.v, sqrt(greatest({rest}, x.least)), ({rest}) / get(l, x.d))))) AS l"))
    steps = ", ".join(f"named_struct('d', {at(i, i)}, 'a', {at(i, j) + 1}, 'above', cast(array({', '.join(str(at(k, j)) for k in range(j, i))}) AS array<int>))" for i, j in cells)
    rest = "aggregate(zip_with(slice(l, x.a, size(x.above)), x.above, (p, k) -> p * w[k]), 0D, (t, y) -> t + y)"
    m = m.select("*", F.expr(f"aggregate(array({steps}), cast(array() AS array<double>), (w, x) -> concat(w, array(if(size(x.above) = 0, 1, -{rest}) / l[x.d]))) AS w"))
    logdet = " + ".join(f"2 * ln(l[{at(i, i)}])" for i in range(D))
    return m.select(*[c for c in m.columns if c not in ("v", "l", "w")], *[F.expr(f"w[{at(i, j)}] AS w{i}{j}") for i, j in cells], F.expr(f"{logdet} AS logdet"))


def distance() -> Column:
    """Squared Mahalanobis distance of x<i> from c<i> under w<i><j>."""
    y = ["(" + " + ".join(f"w{i}{j} * (x{j} / {UNIT} - c{j})" for j in range(i + 1)) + ")" for i in range(D)]
    return F.expr(" + ".join(f"{v} * {v}" for v in y))


def _moments() -> list[Column]:
    return [F.expr("count(*) AS n"), *[F.expr(f"sum(x{i}) AS s{i}") for i in range(D)], *[F.expr(f"sum(x{i} * x{j}) AS p{i}{j}") for i in range(D) for j in range(i + 1)]]


MOMENTS = ("n", *[f"s{i}" for i in range(D)], *[f"p{i}{j}" for i in range(D) for j in range(i + 1)])


def _hint(df: DataFrame, cells: int) -> DataFrame:
    """df, one row or two a cell, broadcast where the number of cells is bounded."""
    return F.broadcast(df) if cells <= BROADCAST_CELLS else df


def moments(rows: DataFrame) -> DataFrame:
    """Per cell of rows (cell, x<i>): the moments of the H-subset that the start with the smallest determinant ends with."""
    plain = _solved(rows.groupBy("cell").agg(*_moments())).withColumn("start", F.lit("moments"))
    mid = rows.groupBy("cell").agg(F.count("*").alias("n"), *[F.expr(f"percentile(x{i}, array(0.25, 0.5, 0.75))").alias(f"r{i}") for i in range(D)])
    spread = lambda i: F.pow((F.col(f"r{i}")[2] - F.col(f"r{i}")[0]) / UNIT / 1.349, 2) + NOISE[i] ** 2
    apart = F.array(*[spread(i) if i == j else F.lit(0.0) for i in range(D) for j in range(i + 1)])
    mid = mid.select("cell", "n", *[(F.col(f"r{i}")[1] / UNIT).alias(f"c{i}") for i in range(D)], apart.alias("v"))
    mid = _factored(mid).withColumn("start", F.lit("medians"))
    params = cut(plain.unionByName(mid).withColumnRenamed("n", "n_rows"), "mcd-start")
    cells, settled = params.count(), None
    whole = Window.partitionBy("cell", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(STEPS):
        near = rows.join(_hint(params.drop(*[f"m_{c}" for c in MOMENTS]), cells), "cell")
        bins = near.groupBy("cell", "start", "n_rows", F.floor(8 * F.log2(distance() + 1e-6)).alias("bin")).agg(*_moments())
        room = F.ceil(F.col("n_rows") * H) - F.coalesce(F.sum("n").over(whole), F.lit(0))
        inner = bins.withColumn("room", room).filter("room > 0").withColumn("part", F.least(F.lit(1.0), F.col("room") / F.col("n")))
        kept = inner.groupBy("cell", "start", "n_rows").agg(*[F.expr(f"sum(cast(round({c} * part) AS bigint)) AS {c}") for c in MOMENTS])
        solved = _solved(kept.select("*", *[F.expr(f"{c} AS m_{c}") for c in MOMENTS])).drop("n")
        old, params = params, cut(solved.coalesce(4) if cells <= BROADCAST_CELLS else solved, "mcd-step")
        discard(old)
        state = params.agg(F.sum(F.round("logdet", 6).cast("decimal(38,6)"))).first()[0]
        if state == settled:
            break
        settled = state
    first = F.row_number().over(Window.partitionBy("cell").orderBy(F.round("logdet", 9), "start"))
    return params.withColumn("k_", first).filter("k_ = 1").select("cell", "n_rows", *[F.col(f"m_{c}").alias(c) for c in MOMENTS])


def estimates(rows: DataFrame) -> DataFrame:
    """Per cell of rows: n_rows and the centre c<i> and factor w<i><j> of its own rows alone."""
    return _solved(moments(rows)).drop("n", "logdet")


def shrunk(groups: DataFrame, found: DataFrame, cells: int) -> DataFrame:
    """groups (cell2, cell1, cell0 from the narrowest to all texts) with the moments of their own cell and PRIOR rows' worth of those above."""
    side = lambda k: _hint(found.selectExpr(f"cell AS cell{k}", *[f"cast({c} AS double) AS {c}_{k}" for c in MOMENTS]), cells)
    j = groups
    for k in range(3):
        j = j.join(side(k), f"cell{k}")
    wider = {c: f"({c}_1 + {PRIOR} * {c}_0 / n_0)" for c in MOMENTS}
    return j.selectExpr(*groups.columns, *[f"{c}_2 + {PRIOR} * {v} / {wider['n']} AS {c}" for c, v in wider.items()])


def judged(docs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """docs with the base statistics, distance2 (null without an estimate) and kept; reserved prefix `_q_`, other columns pass through but for those in `without`.

    Texts are read once; docs with their statistics go to the shared folder, and everything after reads that.
    """
    names = {f"x{i}": f"_q_x{i}" for i in range(D)}
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns named like a statistic: {sorted(clash)}")
    slim = [c for c in docs.columns if c not in without]
    wide = cut(base_statistics(docs).select(*[F.col(f"`{c}`") for c in slim], *BASE, *vector()), "quality-statistics")
    cell = lambda *v: F.to_json(F.struct(F.lit(len(v)).alias("level"), *[c.alias(f"k{i}") for i, c in enumerate(v)]))
    levels = [cell(F.col("lang"), F.col("source")), cell(F.col("lang")), cell()]
    stats = wide.filter(~F.col("base_failed")).select("lang", "source", *names)
    keys = stats.select("lang", "source").distinct()
    groups = cut(keys.select(F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"), *[c.alias(f"cell{2 - i}") for i, c in enumerate(levels)]), "mcd-groups")
    cells = groups.count()
    found = cut(moments(stats.select(F.explode(F.array(*levels)).alias("cell"), *names)), "mcd-moments")
    both = cut(shrunk(groups, found, cells), "mcd-shrunk")
    fitted = cut(_solved(both).drop("n", "logdet", "cell0", "cell1", "cell2"), "mcd-fitted")
    discard(found, both, groups)
    hint = lambda df: _hint(df, cells)
    same = F.col("lang").eqNullSafe(F.col("_q_lang")) & F.col("source").eqNullSafe(F.col("_q_source"))
    out = wide.join(hint(fitted), same, "left").withColumn("distance2", F.round(distance(), 6))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= CUTOFF))
    return out.select(*[F.col(f"`{c}`") for c in slim], *BASE, "distance2", "kept")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and distance2 of every row."""
    return judged(docs.select("doc_id", "text", "lang", "source"), without=("text",)).drop("lang", "source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns."""
    names = {c: f"_d_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang", "source")}
    plain = docs.select("doc_id", "text", "lang", "source", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    kept = judged(plain).filter("kept")
    return kept.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
