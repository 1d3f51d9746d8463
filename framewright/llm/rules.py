"""Quality rules: base statistics and robust multivariate outliers.

Statistics of whole texts become a vector of transformed ratios, and for each
language and source a minimum-covariance-determinant estimate says what is
usual: of all halves of the group's rows, the one whose (regularised)
covariance has the least determinant, sought from several starts.

A group of any size is searched in one small task, since its rows are first
summed, by map-side combined aggregation, over the cells of a fine grid: a
cell keeps the count, the sums and the sums of products of its rows, so means
and covariances of cells are those of their rows, and the number of cells has
a bound (:data:`SPAN`) that doesn't depend on the rows. Concentration steps
take whole cells from the nearest on and of the last one just the share that
completes the half, until the determinant stops falling; the least determinant
of all starts wins. Only tables of one row a group are joined back.

Ratios are counts over sizes, mostly zero, and the half of least determinant
has no spread in them at all. Each coordinate therefore has a least deviation:
for counts what one event amounts to in a document of the group's median
length (one symbol, one line, one window of words), though never so much that
the coordinate alone could not reject; for word lengths half the deviation of
all the group's rows.

Defined cases: null text has no words and fails the base rules; null language
or source is a group of its own; a group's estimate is drawn to its language's
the more, the fewer its rows are, and groups of at most ``LEAST`` rows are
judged by their language (all its rows), and where that is too small too, only
by the base rules; repeated rows count as often as they occur, and rows of one
cell go together; very long texts are measured whole; columns may have any
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, exp, gamma, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.shared import WORD, materialize, release

#: Rule values of the base verdict.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
#: Rows below which a group has no estimate of its own, and the tail of the
#: chi-squared distribution beyond which a row is rejected.
LEAST, TAIL = 50, 1e-3
DIM = 4
#: What one event adds to a count: symbols, repeated lines, repeated words;
#: and the largest ratio that the base rules let pass.
EVENT, REACH = (1, 1, WINDOW), (1.0, 1.0, REPEAT_PERCENT / 100)
#: Starts, of which so many are followed to their end, after so many steps.
STARTS, FOLLOWED, FIRST_STEPS, MOST_STEPS = 40, 5, 2, 100
#: Cells: of word lengths a 32nd of the deviation, to 4 deviations either way;
#: of the others a third of the least deviation, 16 and what lies beyond.
FINE, SPAN, COARSE, ABOVE = 32, 128, 3, 16
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
KEYS = ["lang_g", "source_g"]
_DROP = str.maketrans("", "", SYMBOLS)


def repeat_words(ids: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Marks words in a window that occurs twice or more in its document.

    ``ids`` numbers the words of documents laid end to end, ``doc`` says whose
    they are. Windows get exact numbers by doubling: a window of 2n words is
    the pair of the numbers of its halves.
    """
    n = len(ids)
    mark = np.zeros(n, bool)
    if n < window:
        return mark
    code, width = np.unique(doc, return_inverse=True)[1].astype(np.int64) * (int(ids.max()) + 1) + ids, 1
    while width < window:
        code = np.unique(code, return_inverse=True)[1]
        code = code[:-width] * (int(code.max()) + 1) + code[width:]
        width *= 2
    whole = doc[: n - window + 1] == doc[window - 1 :]
    code = code[whole]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(whole)[counts[inverse] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def statistics(texts: list[str | None]) -> pd.DataFrame:
    """The base statistics of whole texts."""
    rows, flat, owner, number = [], [], [], {}
    for k, t in enumerate(texts):
        t = t or ""
        words = WORD.findall(t)
        seen: set[str] = set()
        dup = 0
        if "\n" in t:
            for line in t.split("\n"):
                if line in seen:
                    dup += 1
                elif line and WORD.search(line):
                    seen.add(line)
        rows.append((len(words), sum(map(len, words)), len(t) - len(t.translate(_DROP)) if t else 0, dup))
        if len(words) >= WINDOW:
            flat += [number.setdefault(w, len(number)) for w in words]
            owner.append((k, len(words)))
    out = pd.DataFrame(rows, columns=STATS[:4], dtype="int64")
    doc = np.repeat(np.array([k for k, _ in owner], np.int64), np.array([n for _, n in owner], np.int64))
    marks = repeat_words(np.array(flat, np.int64), doc)
    return out.assign(n_repeat_words=np.bincount(doc[marks], minlength=len(texts)).astype(np.int64))


def measured(text: Column) -> Column:
    """A text column as structs of the base statistics."""

    @F.pandas_udf(", ".join(f"{c} long" for c in STATS))
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            runs, run, n = [], [], 0
            for t in part:
                run.append(t)
                n += len(t or "")
                if n > 1 << 20:
                    runs.append(statistics(run))
                    run, n = [], 0
            yield pd.concat([*runs, statistics(run)], ignore_index=True)

    return measure(text)


def base_failed() -> Column:
    """The base verdict over columns of the statistics."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed ratios: word length (log), symbols, repeated lines, words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def chi_squared(dim: int, tail: float) -> float:
    """Quantile of the chi-squared distribution, from its exact upper tail."""

    def beyond(h: float) -> float:
        a, q = (0.5, erfc(sqrt(h))) if dim % 2 else (1.0, exp(-h))
        while a < dim / 2:
            q += h**a * exp(-h) / gamma(a + 1)
            a += 1
        return q

    lo, hi = 0.0, dim + 10.0
    while beyond(hi) > tail:
        hi *= 2
    while hi - lo > 1e-9 * hi:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beyond(mid) > tail else (lo, mid)
    return 2 * hi


def _distance() -> Column:
    """Squared Mahalanobis distance over x*, m* and the precision p*."""
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1 if i == j else 2) * F.col(f"p{i}{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))
    return total


def _joined(rows: DataFrame, model: DataFrame, how: str = "inner") -> DataFrame:
    right = model.select(F.col("lang_g").alias("lang_r"), F.col("source_g").alias("source_r"), *[c for c in model.columns if c not in ("lang_g", "source_g")])
    return rows.join(right, F.col("lang_g").eqNullSafe(F.col("lang_r")) & F.col("source_g").eqNullSafe(F.col("source_r")), how).drop("lang_r", "source_r")


def scales(rows: DataFrame) -> DataFrame:
    """Of each group that is large enough: n, centre and width of its word
    lengths, and the least deviation f* of each coordinate."""
    passed = ~base_failed()
    median = lambda c: F.percentile_approx(F.when(passed, F.col(c)), 0.5, 10000)
    sums = rows.groupBy(*KEYS).agg(F.count(F.when(passed, 1)).alias("n"), F.avg("x0").alias("centre"), F.stddev_pop("x0").alias("width"), median("n_words").alias("words"), median("word_chars").alias("chars")).where(F.col("n") >= LEAST)
    cut = 0.95 / sqrt(chi_squared(DIM, TAIL))
    ratio = [F.sqrt(F.least(F.lit(r * cut * cut), e / F.greatest(F.col(size), F.lit(1)))) for e, r, size in zip(EVENT, REACH, ("chars", "words", "words"), strict=True)]
    width = F.greatest(F.col("width"), F.lit(1e-3))
    return sums.select(*KEYS, "n", "centre", width.alias("width"), (width / 2).alias("f0"), *[x.alias(f"f{i}") for i, x in enumerate(ratio, 1)])


def cells(rows: DataFrame, scale: DataFrame) -> DataFrame:
    """Sums of the groups' rows over a grid: k*, w, s*, q** and scale."""
    placed = _joined(rows, scale)
    within = lambda x, lo, hi: F.least(F.greatest(F.floor(x), F.lit(lo)), F.lit(hi)).cast("int")
    grid = [within((F.col("x0") - F.col("centre")) * FINE / F.col("width"), -SPAN, SPAN)] + [within(F.col(f"x{i}") * COARSE / F.col(f"f{i}"), 0, ABOVE) for i in range(1, DIM)]
    placed = placed.select(*KEYS, *[g.alias(f"k{i}") for i, g in enumerate(grid)], *[f"x{i}" for i in range(DIM)], *[f"f{i}" for i in range(DIM)])
    return placed.groupBy(*KEYS, *[f"k{i}" for i in range(DIM)]).agg(
        F.count("*").alias("w"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS],
        *[F.max(f"f{i}").alias(f"f{i}") for i in range(DIM)],
    )


class Half:
    """Halves of a group's rows, from the sums of its cells."""

    def __init__(self, w: np.ndarray, s: np.ndarray, q: np.ndarray, floor: np.ndarray) -> None:
        self.w, self.s, self.q, self.floor = w, s, q, np.diag(floor**2)
        self.x = s / w[:, None]
        self.size = (int(w.sum()) + DIM + 1) // 2

    def moments(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of so much of each cell."""
        n = share @ self.w
        mean = share @ self.s / n
        return mean, np.tensordot(share, self.q, 1) / n - np.outer(mean, mean)

    def step(self, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Mean and covariance of the half nearest to an estimate, and the
        squared distance at which it ends."""
        off = self.x - mean
        d = np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov + self.floor), off)
        order = np.argsort(d, kind="stable")
        upto = np.cumsum(self.w[order])
        share = np.zeros(len(d))
        share[order] = np.clip(1 - (upto - self.size) / self.w[order], 0, 1)
        return *self.moments(share), float(d[order[np.searchsorted(upto, self.size)]])

    def volume(self, cov: np.ndarray) -> float:
        """Logarithm of the regularised covariance's determinant."""
        return float(np.linalg.slogdet(cov + self.floor)[1])

    def starts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All rows; coordinate medians; and random cells, a few each."""
        yield self.moments(np.ones(len(self.w)))

        def median(v: np.ndarray) -> float:
            order = np.argsort(v, kind="stable")
            return v[order[np.searchsorted(np.cumsum(self.w[order]), self.w.sum() / 2)]]

        middle = np.array([median(v) for v in self.x.T])
        yield middle, np.diag([(1.4826 * median(np.abs(v - m))) ** 2 for v, m in zip(self.x.T, middle)])
        rng = np.random.default_rng(17)
        for _ in range(STARTS - 2):
            share = np.zeros(len(self.w))
            some = rng.choice(len(self.w), min(DIM + 1, len(self.w)), replace=False, p=self.w / self.w.sum())
            share[some] = 1 / self.w[some]
            yield self.moments(share)

    def best(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Mean, covariance (consistent for normal rows) and its volume."""
        tried = []
        for k, (mean, cov) in enumerate(self.starts()):
            for _ in range(FIRST_STEPS):
                mean, cov, _ = self.step(mean, cov)
            tried.append((self.volume(cov), k, mean, cov))
        found = None
        for volume, _, mean, cov in sorted(tried, key=lambda t: t[:2])[:FOLLOWED]:
            for _ in range(MOST_STEPS):
                new_mean, new_cov, _ = self.step(mean, cov)
                new = self.volume(new_cov)
                if new >= volume - 1e-10:
                    break
                mean, cov, volume = new_mean, new_cov, new
            if found is None or volume < found[2] - 1e-10:
                found = mean, cov, volume
        mean, cov, volume = found
        # The nearest half of normal rows has smaller covariance than all.
        return mean, cov * max(1.0, self.step(mean, cov)[2] / chi_squared(DIM, 0.5)), volume


_ESTIMATE = ["n", *[f"m{i}" for i in range(DIM)], *[f"c{i}{j}" for i, j in PAIRS], "volume"]


def estimates(rows: DataFrame) -> DataFrame:
    """Of each group (lang_g, source_g) of rows that pass the base rules and
    its language (source_g null): n, mean m*, covariance c** with the least
    deviations added, and the volume of the half it comes from.

    ``rows`` have x* and the statistics; failing rows only enter the scales.
    """
    both = rows.withColumn("source_g", F.explode(F.array_distinct(F.array(F.col("source_g"), F.lit(None).cast("string")))))
    scale, scale_path = materialize(scales(both), "scales")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([f"k{i}" for i in range(DIM)])
        q = np.zeros((len(part), DIM, DIM))
        for i, j in PAIRS:
            q[:, i, j] = q[:, j, i] = part[f"q{i}{j}"]
        half = Half(part["w"].to_numpy(float), part[[f"s{i}" for i in range(DIM)]].to_numpy(float), q, part[[f"f{i}" for i in range(DIM)]].to_numpy(float)[0])
        mean, cov, volume = half.best()
        cov = cov + half.floor
        return pd.DataFrame([[part["lang_g"].iloc[0], part["source_g"].iloc[0], int(half.w.sum()), *mean, *[cov[i, j] for i, j in PAIRS], volume]], columns=[*KEYS, *_ESTIMATE])

    schema = "lang_g string, source_g string, n long, " + ", ".join(f"{c} double" for c in _ESTIMATE[1:])
    found, _ = materialize(cells(both.where(~base_failed()), scale).groupBy(*KEYS).applyInPandas(search, schema), "mcd")
    release(rows.sparkSession, scale_path)
    return found


def models(found: DataFrame) -> DataFrame:
    """Mean m* and precision p** of each estimate, a source's drawn to its
    language's: that counts for ``LEAST`` of the source's rows."""
    own = ["n", *[c for c in _ESTIMATE if c[0] in "mc"]]
    wide = found.where("source_g is null").select(F.col("lang_g").alias("lang_w"), *[F.col(c).alias(f"w_{c}") for c in own])
    both = found.select(*KEYS, *own).join(wide, F.col("lang_g").eqNullSafe(F.col("lang_w")))

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            share = np.where(part["source_g"].isna(), 1.0, 1 - LEAST / part["n"].to_numpy(float))
            mine, theirs = (part[[f"{w}m{i}" for i in range(DIM)]].to_numpy(float) for w in ("", "w_"))
            c = np.zeros((2, len(part), DIM, DIM))
            for k, w in enumerate(("", "w_")):
                for i, j in PAIRS:
                    c[k, :, i, j] = c[k, :, j, i] = part[f"{w}c{i}{j}"]
            a, off = share[:, None, None], mine - theirs
            mean = share[:, None] * mine + (1 - share[:, None]) * theirs
            cov = a * c[0] + (1 - a) * c[1] + a * (1 - a) * off[:, :, None] * off[:, None, :]
            p = np.linalg.inv(cov) if len(part) else cov
            yield part[KEYS].assign(**{f"m{i}": mean[:, i] for i in range(DIM)}, **{f"p{i}{j}": p[:, i, j] for i, j in PAIRS})

    return both.mapInPandas(merge, "lang_g string, source_g string, " + ", ".join(f"{c} double" for c in [*[f"m{i}" for i in range(DIM)], *[f"p{i}{j}" for i, j in PAIRS]]))


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with their group: language and source, or the language alone."""
    sizes, _ = materialize(rows.where(~base_failed()).groupBy(*KEYS).count(), "sizes")
    joined = _joined(rows, sizes, "left")
    own = F.coalesce(F.col("count"), F.lit(0)) > LEAST
    # A source of its own is tagged, so that no source can be taken for the language's rows.
    return joined.withColumn("source_g", F.when(own, F.concat(F.lit("="), F.coalesce("source_g", F.lit("\0"))))).drop("count")


def judged(rows: DataFrame, stats: str = "stats", verdict: str = "verdict", lang: str = "lang", source: str = "source", tail: float = TAIL) -> DataFrame:
    """``rows`` and a struct ``verdict``: base_failed, kept, distance.

    ``stats`` names the struct of :func:`measured`; all columns stay. Rows are
    read several times and should be a materialised table. The distance is
    null where no group is large enough.
    """
    columns = rows.columns
    named = rows.select(*[F.col(f"`{c}`").alias(f"c{k}__") for k, c in enumerate(columns)], F.col(lang).cast("string").alias("lang_g"), F.col(source).cast("string").alias("source_g"), *[F.col(f"`{stats}`")[c].alias(c) for c in STATS])
    for i, x in enumerate(vector()):
        named = named.withColumn(f"x{i}", x)
    named = _grouped(named)
    model, _ = materialize(models(estimates(named.select(*KEYS, *STATS, *[f"x{i}" for i in range(DIM)]))), "models")
    failed = base_failed()
    distance = F.when(~failed, _distance())
    kept = ~failed & F.coalesce(distance <= chi_squared(DIM, tail), F.lit(True))
    told = F.struct(failed.alias("base_failed"), kept.alias("kept"), distance.alias("distance"))
    return _joined(named, model, "left").select(*[F.col(f"c{k}__").alias(c) for k, c in enumerate(columns)], told.alias(verdict))
