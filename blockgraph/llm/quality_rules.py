"""Quality rules: robust multivariate outliers among documents of one language and source.

Each document's statistics are turned into a vector. For each group a minimum-covariance-determinant estimate gives
location and scatter: from several deterministic starts, concentration steps move towards the three quarters of the
vectors with the smallest distances; after two steps the start with the least determinant stays, and its steps go on
until the determinants no longer change. Documents at a large Mahalanobis distance are rejected. All of it is
DataFrame functions and SQL: the statistics are computed within a row, the quantiles of a step come from a histogram of
log distances, the inverse is a closed form, so a hot group is pre-aggregated in every step and never gathered.
"""

from __future__ import annotations

import warnings
from math import exp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, materialize, table, unused

MIN_WORDS, MAX_REPEAT = 10, 20
#: Each estimate rests on as many rows more, in the shape of its language's estimate, and a language's of the corpus'.
PRIOR = 50
#: Concentration steps of all starts, and of the best one at most; the change of log determinants that ends them.
FIRST_STEPS, MORE_STEPS, SETTLED = 2, 10, 1e-7
#: Share of normal vectors beyond the cut.
TAIL = 1e-4
#: Median of the chi-square distribution with four degrees of freedom.
CHI_MEDIAN = 3.356694
#: Added, squared, to each variance, in units of the transformed statistics: a statistic that hardly varies, as in a
#: group that is mostly copies of one text, can't reject alone. Lengths that differ by a factor of e are ordinary.
RIDGE = (1.0, 0.15, 0.3, 0.25)
DIM = 4
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
#: Estimates, one row a group and start, that are broadcast at most; more are joined by key.
BROADCAST_ROWS = 50_000


def chi_square_cut(tail: float) -> float:
    """The quantile of the chi-square distribution with four degrees of freedom beyond which that share lies."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (1 + mid / 2) * exp(-mid / 2) > tail else (lo, mid)
    return round(hi, 6)


CUT = chi_square_cut(TAIL)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words added (null text: all zero); columns of
    these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words_col = unused(docs.columns, "__words")
    df = docs.withColumn(words_col, F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n = F.size(words_col)

    def repeated(words: Column) -> Column:
        # windows in order of their words: equal ones are neighbours
        windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.struct(F.array_join(F.slice(words, i + 1, 5), " ").alias("w"), i.alias("at"))))

        def hits(x: Column) -> Column:
            last = F.size(x) - 1
            same = lambda i, j: F.get(x, i)["w"] == F.get(x, j)["w"]
            found = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)))
            return F.sort_array(F.transform(found, lambda i: F.get(x, i)["at"]))

        # covered words: each window adds those past the end of the one before it
        covered = lambda at: F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, p: F.struct((s["n"] + p + 5 - F.greatest(s["end"], p)).alias("n"), (p + 5).alias("end")))["n"]
        return covered(_let(windows, hits))

    hashes = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(F.slice(F.col(words_col), i + 1, 5)))
    # without two windows of one hash no window repeats: most documents end here
    suspect = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    mine = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in mine],
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(words_col, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.when(n < 6, 0).when(suspect, repeated(F.col(words_col))).otherwise(0).cast("long").alias("n_repeat_words"),
    )


# ---------------------------------------------------------------- estimates, as SQL that Spark and DuckDB read alike

#: The transformed statistics.
VECTOR = (
    "ln(1e0 + n_words)",
    "ln(1e0 + 1e0 * word_chars / greatest(n_words, 1))",
    "ln(1e0 + 1e1 * n_symbols / greatest(n_words, 1))",
    "ln(1e0 + 1e1 * (n_repeat_words + n_dup_lines) / greatest(n_words, 1))",
)
X = [f"x{i}" for i in range(DIM)]


def _factor() -> list[tuple[str, str]]:
    """Steps (name, expression) of the Cholesky factor of the scatter, row by row; each uses names before it only."""
    steps = []
    for i in range(DIM):
        for j in range(i + 1):
            s = f"c{j}{i}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            steps.append((f"l{i}{j}", f"sqrt(greatest({s}, 1e-9))" if i == j else f"({s}) / l{j}{j}"))
    return steps


FACTOR = _factor()
RESIDUAL = [(f"y{i}", f"((x{i} - a{i})" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i}") for i in range(DIM)]
#: Bin of a squared distance in the histogram: 64 bins for each factor of e.
DISTANCE = [*RESIDUAL, ("d", " + ".join(f"y{i} * y{i}" for i in range(DIM))), ("bin", "CAST(floor(64e0 * ln(greatest(d, 1e-12))) AS BIGINT)")]
#: Plain averages, which blend; the scatter follows from them.
MEANS = [f"a{i}" for i in range(DIM)] + [f"a{i}{j}" for i, j in _PAIRS]
AVERAGES = ", ".join([f"avg(x{i}) AS a{i}" for i in range(DIM)] + [f"avg(x{i} * x{j}) AS a{i}{j}" for i, j in _PAIRS])
SCATTER = [(f"c{i}{j}", f"a{i}{j} - a{i} * a{j}" + (f" + {RIDGE[i] ** 2:.6e}" if i == j else "")) for i, j in _PAIRS]
DETERMINANT = [("logdet", "2e0 * (" + " + ".join(f"ln(l{i}{i})" for i in range(DIM)) + ")")]


def _chain(source: str, steps: list[tuple[str, str]], keep: str) -> str:
    """Columns added one after the other."""
    for name, e in steps:
        source = f"(SELECT *, {e} AS {name} FROM {source}) q_{name}"
    return f"SELECT {keep} FROM {source}"


def _blend(each: str, names: list[str], keep: str = "") -> str:
    """Each group's values (g, st, n, names), with PRIOR rows of its language's added to its own n.

    A language's values get PRIOR rows of the corpus' in the same way first. up: (g, up1, up2), the language and the
    corpus of a group; a language has the corpus as both, the corpus itself.
    """
    mixed = ", ".join(f"(e.n * e.{c} + {PRIOR} * ((u.n * u.{c} + {PRIOR} * w.{c}) / (u.n + {PRIOR}))) / (e.n + {PRIOR}) AS {c}" for c in names)
    return f"SELECT e.g, e.st{keep}, {mixed} FROM {each} e JOIN {{up}} k ON k.g = e.g JOIN {each} u ON u.g = k.up1 AND u.st = e.st JOIN {each} w ON w.g = k.up2 AND w.st = e.st"


def _estimated(each: str) -> str:
    """(g, st, location a, factor l, logdet) of averages (g, st, n, a)."""
    kept = ", ".join(["g", "st", *MEANS[:DIM], *[n for n, _ in FACTOR], "logdet"])
    return _chain(f"({_blend(each, MEANS)}) q", SCATTER + FACTOR + DETERMINANT, kept)


def _histogram(share: str, name: str) -> str:
    """For each group and start the least bin up to which at least that share of its rows lie, blended."""
    bins = _chain("(SELECT * FROM {fit} JOIN {estimate} USING (g)) q", DISTANCE, "g, st, bin")
    upto = f"SELECT g, st, bin, sum(n) OVER (PARTITION BY g, st ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY g, st) AS whole FROM (SELECT g, st, bin, count(*) AS n FROM ({bins}) q GROUP BY g, st, bin) q"
    return f"SELECT g, st, max(whole) AS n, CAST(min(CASE WHEN {share} THEN bin END) AS DOUBLE) AS {name} FROM ({upto}) q GROUP BY g, st"


#: Sound rows three times: in their group, their language and the corpus.
GROUP = {"s": "concat('s', l_, chr(1), s_)", "l": "concat('l', l_)", "c": "'c'"}
FIT = " UNION ALL ".join(f"SELECT {g} AS g, {', '.join(f'{e} AS x{i}' for i, e in enumerate(VECTOR))} FROM {{st}} WHERE NOT base_failed" for g in GROUP.values())
UP = " UNION ".join(f"SELECT {g} AS g, {u} AS up1, 'c' AS up2 FROM {{st}} WHERE NOT base_failed" for g, u in ((GROUP["s"], GROUP["l"]), (GROUP["l"], "'c'"), ("'c'", "'c'")))
#: Quartiles of each coordinate: (g, p0 ..., s0 ...), a robust place and spread.
_BINS = "SELECT g, i, bin, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT g, {i} AS i, CAST(floor(64e0 * x{i}) AS BIGINT) AS bin FROM {{fit}}" for i in range(DIM)) + ") q GROUP BY g, i, bin"
_UPTO = f"SELECT g, i, bin, sum(n) OVER (PARTITION BY g, i ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY g, i) AS whole FROM ({_BINS}) q"
_QUARTILES = f"SELECT g, i, min(CASE WHEN 4 * upto >= whole THEN bin END) AS q1, min(CASE WHEN 2 * upto >= whole THEN bin END) AS q2, min(CASE WHEN 4 * upto >= 3 * whole THEN bin END) AS q3 FROM ({_UPTO}) q GROUP BY g, i"
PLACE = "SELECT g, " + ", ".join(f"max(CASE WHEN i = {i} THEN (q2 + 0.5e0) / 64e0 END) AS p{i}, max(CASE WHEN i = {i} THEN (q3 - q1 + 1) / 86.336e0 END) + {RIDGE[i]:.6e} AS s{i}" for i in range(DIM)) + f" FROM ({_QUARTILES}) q GROUP BY g"
#: Averages of each start: all rows; damped coordinates; directions; spreads alone.
_Z = [(f"z{i}", f"(x{i} - p{i}) / s{i}") for i in range(DIM)] + [("r", "sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(DIM)) + " + 1e-12)")]
_SUMS = "g, count(*) AS n, " + AVERAGES + ", " + ", ".join(f"avg(z{i} / (1e0 + abs(z{i})) * (z{j} / (1e0 + abs(z{j})))) AS t{i}{j}, avg(z{i} / r * (z{j} / r)) AS u{i}{j}" for i, j in _PAIRS) + ", " + ", ".join(f"max(p{i}) AS p{i}, max(s{i}) AS s{i}" for i in range(DIM))
SUMS = _chain("(SELECT * FROM {fit} JOIN {place} USING (g)) q", _Z, _SUMS) + " GROUP BY g"
_ABOUT = lambda second: ", ".join([f"p{i} AS a{i}" for i in range(DIM)] + [f"{second(i, j)} + p{i} * p{j} AS a{i}{j}" for i, j in _PAIRS])
STARTS = " UNION ALL ".join(
    f"SELECT g, {k} AS st, n, {columns} FROM {{sums}}"
    for k, columns in enumerate([", ".join(MEANS), _ABOUT(lambda i, j: f"s{i} * s{j} * t{i}{j}"), _ABOUT(lambda i, j: f"s{i} * s{j} * u{i}{j}"), _ABOUT(lambda i, j: f"s{i} * s{j}" if i == j else "0e0")])
)
#: One concentration step: the core's bound (shrunk too: otherwise a row that is alone would be its own core), its averages.
BOUND = "SELECT e.*, most FROM {estimate} e JOIN (" + _blend("{quantile}", ["most"]) + ") b ON b.g = e.g AND b.st = e.st"
QUANTILE = _histogram("4 * upto >= 3 * whole", "most")
CORE = _chain("(SELECT * FROM {fit} JOIN {bound} USING (g)) q", DISTANCE, "*")
CORE = f"SELECT g, st, count(*) AS n, {AVERAGES} FROM ({CORE}) q WHERE bin <= most GROUP BY g, st"
#: A small group may have no row in the core: the prior alone stands.
EACH = "SELECT e.g, e.st, coalesce(c.n, 0) AS n, " + ", ".join(f"coalesce(c.{a}, 0e0) AS {a}" for a in MEANS) + " FROM {estimate} e LEFT JOIN {core} c ON c.g = e.g AND c.st = e.st"
ESTIMATE = _estimated("{each}")
BEST = "SELECT " + ", ".join(["g", "0 AS st", *MEANS[:DIM], *[n for n, _ in FACTOR], "logdet"]) + " FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY logdet, st) AS place FROM {estimate}) q WHERE place = 1"
MIDDLE = _histogram("2 * upto >= whole", "middle")
#: Scaled so that the group's median distance is that of the normal distribution, since a core's scatter is too small; a
#: smaller median is the ridge's or the copies' doing and stays.
SCALED = f"SELECT e.*, least(1e0, {CHI_MEDIAN}e0 / exp((middle + 1) / 64e0)) AS scale FROM {{estimate}} e JOIN (" + _blend("{middles}", ["middle"]) + ") b ON b.g = e.g AND b.st = e.st"
STATS = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"
_VECTORS = f"SELECT {STATS}, {GROUP['s']} AS g, " + ", ".join(f"{e} AS x{i}" for i, e in enumerate(VECTOR)) + " FROM {st}"
VERDICT = _chain(f"(SELECT v.*, {', '.join(MEANS[:DIM] + [n for n, _ in FACTOR])}, scale FROM ({_VECTORS}) v LEFT JOIN {{scaled}} e ON e.g = v.g) q", DISTANCE, f"{STATS}, NOT base_failed AND NOT coalesce(scale * d > {CUT}e0, false) AS kept")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, the statistics, base_failed and kept for each document.

    kept is false if the base rules fail, or if the document's vector lies further out than the cut. Null languages
    and sources form groups of their own. A group of any size has its estimate, shrunk towards its language's and that
    towards the corpus' with the weight of PRIOR rows. Estimates that still change after the last step are used
    as they are, with a warning. Repeated rows count each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    named = lambda c: F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(c)))
    base = statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), named(lang_col).alias("l_"), named(source_col).alias("s_")), "__text").drop("__text")
    st = materialize(base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))))
    run = lambda text, **tables: spark.sql(text, **tables)
    up = materialize(run(UP, st=st))
    small = up.count() * 4 <= BROADCAST_ROWS
    near = F.broadcast if small else lambda df: df
    up = near(up)
    fit = materialize(run(FIT, st=st))
    sums = materialize(run(SUMS, fit=fit, place=near(materialize(run(PLACE, fit=fit)))))
    estimate = materialize(run(ESTIMATE, each=near(materialize(run(STARTS, sums=sums))), up=up))
    for step in range(FIRST_STEPS + MORE_STEPS):
        if step == FIRST_STEPS:
            estimate = materialize(run(BEST, estimate=estimate))
        quantile = materialize(run(QUANTILE, fit=fit, estimate=near(estimate)))
        core = run(CORE, fit=fit, bound=near(run(BOUND, estimate=near(estimate), quantile=near(quantile), up=up)))
        each = materialize(run(EACH, estimate=estimate, core=near(core)))
        last, estimate = estimate, materialize(run(ESTIMATE, each=near(each), up=up))
        if step >= FIRST_STEPS:
            change = estimate.join(near(last.select("g", F.col("logdet").alias("was"))), "g").agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
            if change is None or change < SETTLED:
                break
        drop(quantile, each, last)
    else:
        warnings.warn(f"estimates still changed after {FIRST_STEPS + MORE_STEPS} concentration steps: a log determinant by {change:.2e}", stacklevel=2)
    middles = materialize(run(MIDDLE, fit=fit, estimate=near(estimate)))
    scaled = materialize(run(SCALED, estimate=near(estimate), middles=near(middles), up=up))
    drop(fit, sums, middles)
    return run(VERDICT, st=st, scaled=near(scaled))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def _sql() -> str:
    """The statistics in SQL of their own; the estimates with all steps written out, as more steps change nothing."""
    ctes = [
        """docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END AS l_, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS s_ FROM documents)""",
        """ws AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs)""",
        """wi AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM ws, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) q)""",
        """rp AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM wi) q WHERE c > 1)""",
        """rw AS (SELECT r, count(DISTINCT i + k) AS n FROM rp, range(5) z(k) GROUP BY r)""",
        """dl AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM docs) q WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r)""",
        """sa AS (SELECT docs.r, doc_id, l_, s_, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
          coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words FROM docs JOIN ws USING (r) LEFT JOIN dl USING (r) LEFT JOIN rw USING (r))""",
        f"st AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM sa)",
    ]

    def add(name: str, text: str, **tables: str) -> str:
        ctes.append(f"{name} AS MATERIALIZED ({text.format(**tables)})")
        return name

    add("up", UP, st="st")
    add("fit", FIT, st="st")
    add("place", PLACE, fit="fit")
    add("sums", SUMS, fit="fit", place="place")
    add("starts", STARTS, sums="sums")
    estimate = add("es", ESTIMATE, each="starts", up="up")
    for k in range(FIRST_STEPS + MORE_STEPS):
        if k == FIRST_STEPS:
            estimate = add("best", BEST, estimate=estimate)
        quantile = add(f"qu{k}", QUANTILE, fit="fit", estimate=estimate)
        bound = add(f"bo{k}", BOUND, estimate=estimate, quantile=quantile, up="up")
        core = add(f"co{k}", CORE, fit="fit", bound=bound)
        each = add(f"ea{k}", EACH, estimate=estimate, core=core)
        estimate = add(f"es{k}", ESTIMATE, each=each, up="up")
    middles = add("mi", MIDDLE, fit="fit", estimate=estimate)
    add("scaled", SCALED, estimate=estimate, middles=middles, up="up")
    return "WITH " + ",\n".join(ctes) + "\n" + VERDICT.format(st="st", scaled="scaled")


SQL = _sql()
