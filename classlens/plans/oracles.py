"""DuckDB SQL that gives the same result as each registered query, over the same whole tables."""

from __future__ import annotations

import math

from classlens.plans.inputs import ADJUSTMENTS, DIRTY, FEATURES, VECTOR_FEATURES, WIDTH

KEY = (
    "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "CAST(round(l_extendedprice * 100) AS BIGINT)))"
)
LINE = f"""line AS (SELECT {KEY} AS k, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity AS quantity,
  l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem)"""
DIRT = f"""dirt AS (SELECT {KEY} AS k, CAST(l_returnflag = 'R' AS INTEGER) AS y,
  CASE WHEN l_partkey % 97 = 0 THEN -999.0::DOUBLE ELSE l_quantity END AS quantity,
  CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS price,
  l_discount AS discount, l_tax AS tax, CAST(NULL AS DOUBLE) AS void, CAST(1 AS DOUBLE) AS constant
  FROM lineitem)"""
NULLED = """nulled AS (SELECT k, y, nullif(quantity, -999) AS quantity, nullif(price, -999) AS price,
  nullif(discount, -999) AS discount, nullif(tax, -999) AS tax, void, nullif(constant, -999) AS constant
  FROM dirt)"""
EVENTS = """ev AS (SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS y, value,
  value - 20.0::DOUBLE AS shifted, -value AS negated FROM events)"""
VECS = (
    "vecs AS (SELECT vec_id, CAST(label % 2 AS INTEGER) AS y, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS feature_{i}" for i in range(WIDTH))
    + " FROM embeddings)"
)


def names(columns) -> str:
    return ", ".join(columns)


def long(source: str, columns, keep: str = "y", name: str = "long") -> str:
    ids = f"{keep}, " if keep else ""
    return (
        f"{name} AS (SELECT {ids}feature, value FROM (SELECT {ids}{names(columns)} FROM {source}) "
        f"UNPIVOT (value FOR feature IN ({names(columns)})))"
    )


def feature_rows(columns) -> str:
    rows = ", ".join(f"('{c}', {i})" for i, c in enumerate(columns))
    return f"feats AS (SELECT feature, CAST(ordinal AS INTEGER) AS ordinal FROM (VALUES {rows}) t(feature, ordinal))"


def rnd(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def rounded_columns(columns, digits: int = 6) -> str:
    return ", ".join(f"{rnd(c, digits)} AS {c}" for c in columns)


def normal_p(z: str) -> str:
    """Two-sided normal tail, by the all-positive series of erf."""
    x = f"(abs({z}) / sqrt(2.0))"
    term = (
        f"exp(2 * j * ln(2) + (2 * j + 1) * ln({x}) + lgamma(j + 1) - lgamma(2 * j + 2) - {x} * {x})"
    )
    series = f"list_sum(list_transform(range(0, 200), lambda j: {term}))"
    return (
        f"CASE WHEN {z} = 0 THEN 1.0 WHEN abs({z}) > 8.5 THEN 0.0 "
        f"ELSE 1.0 - 2.0 / sqrt(pi()) * {series} END"
    )


def kolmogorov_p(lam: str) -> str:
    direct = f"list_sum(list_transform(range(1, 60), lambda j: 2.0 * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * {lam} * {lam})))"
    dual = f"list_sum(list_transform(range(1, 60), lambda j: exp(-(2 * j - 1) * (2 * j - 1) * pi() * pi() / (8.0 * {lam} * {lam}))))"
    return (
        f"CASE WHEN {lam} < 1e-3 THEN 1.0 WHEN {lam} < 1 THEN 1.0 - sqrt(2.0 * pi()) / {lam} * {dual} "
        f"ELSE least(greatest({direct}, 0.0), 1.0) END"
    )


def student_p(t: str, df: str) -> str:
    """Two-sided Student tail: one minus Simpson's rule over the density."""
    steps = 4000
    density = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi()) - ({df} + 1) / 2 * ln(1 + s * s / {df}))"
    point = f"(abs({t}) * j / {steps}.0)"
    weight = f"(CASE WHEN j = 0 OR j = {steps} THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END)"
    body = density.replace("s * s", f"{point} * {point}")
    total = f"list_sum(list_transform(range(0, {steps} + 1), lambda j: {weight} * {body}))"
    return f"greatest(0.0, 1.0 - 2.0 * {total} * abs({t}) / {steps}.0 / 3.0)"


def rank_stats(source: str = "long") -> str:
    """Class sizes, U, tie term and D per feature, from pooled ranks of distinct values."""
    return f"""vc AS (SELECT feature, value, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n0,
    CAST(count(*) FILTER (y = 1) AS DOUBLE) AS n1 FROM {source} GROUP BY feature, value),
  run AS (SELECT *, sum(n0) OVER w AS c0, sum(n1) OVER w AS c1, sum(n0) OVER f AS t0, sum(n1) OVER f AS t1
    FROM vc WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)),
  st AS (SELECT feature, max(t0) AS n0, max(t1) AS n1, count(*) AS n_distinct,
    sum(n1 * (c0 - n0 + n0 / 2)) AS u1, sum(power(n0 + n1, 3) - (n0 + n1)) AS ties,
    sum((n0 + n1) * (n0 + n1 - 1) / 2) AS tied_pairs, max(abs(c0 / t0 - c1 / t1)) AS ks_d,
    sum(n1 * (c0 - n0 + n0 / 2)) / (max(t0) * max(t1)) AS auc FROM run GROUP BY feature),
  mw AS (SELECT *, CASE WHEN n0 > 0 AND n1 > 0 AND n_distinct > 1 THEN
    (greatest(u1, n0 * n1 - u1) - n0 * n1 / 2 - 0.5)
      / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))) END AS z FROM st),
  mwp AS (SELECT *, CASE WHEN z < 0 THEN 1.0 ELSE {normal_p("z")} END AS p_mw FROM mw),
  ks AS (SELECT *, sqrt(n0 * n1 / (n0 + n1)) * ks_d AS lam FROM st),
  ksp AS (SELECT *, {kolmogorov_p("lam")} AS p_ks FROM ks)"""


def moments(source: str = "long") -> str:
    return f"""mo AS (SELECT feature, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n0, avg(value) FILTER (y = 0) AS m0,
    var_samp(value) FILTER (y = 0) AS v0, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS n1,
    avg(value) FILTER (y = 1) AS m1, var_samp(value) FILTER (y = 1) AS v1, count(DISTINCT value) AS d
    FROM {source} GROUP BY feature),
  tt AS (SELECT *, CASE WHEN d > 1 THEN (m0 - m1) / sqrt(v0 / n0 + v1 / n1) END AS t,
    CASE WHEN d > 1 THEN power(v0 / n0 + v1 / n1, 2)
      / (power(v0 / n0, 2) / (n0 - 1) + power(v1 / n1, 2) / (n1 - 1)) END AS df FROM mo),
  ttp AS (SELECT *, CASE WHEN t IS NOT NULL THEN {student_p("t", "df")} END AS p_t FROM tt)"""


COHEN = "CASE WHEN d > 1 THEN (m0 - m1) / sqrt((v0 + v1) / 2) END"


def split(source: str = "line", seed: int = 42, size: float = 0.2) -> str:
    return f"""cls AS (SELECT y, count(*) AS n FROM {source} GROUP BY y),
  dr AS (SELECT *, sum(n) OVER () AS total, CAST(ceil({size} * CAST(sum(n) OVER () AS DOUBLE)) AS HUGEINT) AS draws FROM cls),
  fl AS (SELECT *, (n * draws) // total AS fl, (n * draws) % total AS rest FROM dr),
  qu AS (SELECT y, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= draws - sum(fl) OVER ()
    THEN 1 ELSE 0 END AS quota FROM fl),
  parted AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.y ORDER BY md5(s.k || '|{seed}'), s.k) <= quota
    THEN 'test' ELSE 'train' END AS split FROM {source} s JOIN qu USING (y))"""


def histogram(source: str, key: str, bins: int = 50, shared: bool = False) -> str:
    """Dense bin counts per key."""
    over = "feature" if shared else key
    return f"""rg AS (SELECT {over}, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
    CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM {source} GROUP BY {over}),
  bc AS (SELECT {key}, greatest(0, least({bins} - 1, CAST(floor((value - lo) / (hi - lo) * {bins}) AS INTEGER))) AS bin,
    count(*) AS n FROM {source} JOIN rg USING ({over}) GROUP BY ALL),
  tot AS (SELECT {key}, count(*) AS total FROM {source} GROUP BY {key}),
  hist AS (SELECT {key}, CAST(b.bin AS INTEGER) AS bin, lo + (hi - lo) / {bins} * b.bin AS lo,
    lo + (hi - lo) / {bins} * (b.bin + 1) AS hi, coalesce(bc.n, 0) AS n,
    coalesce(bc.n, 0) / (total * ((hi - lo) / {bins})) AS density
    FROM (SELECT *, unnest(range({bins})) AS bin FROM tot JOIN rg USING ({over})) b
    LEFT JOIN bc USING ({key}, bin))"""


JSD = """pq AS (SELECT feature, bin, greatest(max(density) FILTER (y = 0), 1e-12) AS p,
    greatest(max(density) FILTER (y = 1), 1e-12) AS q FROM hist GROUP BY feature, bin),
  js AS (SELECT feature, sum(p) OVER f AS sp, sum(q) OVER f AS sq, sum((p + q) / 2) OVER f AS sm, p, q
    FROM pq WINDOW f AS (PARTITION BY feature)),
  jsd AS (SELECT feature, 0.5 * (sum(p / sp * ln((p / sp) / ((p + q) / 2 / sm)))
    + sum(q / sq * ln((q / sq) / ((p + q) / 2 / sm)))) AS js_divergence FROM js GROUP BY feature)"""

STARS = (
    "CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'ns' END"
)


def kde(source: str, key: str) -> str:
    return f"""sh AS (SELECT {key}, count(*) AS n, stddev_samp(value) * power(CAST(count(*) AS DOUBLE), -0.2) AS bw,
    min(value) AS a, max(value) AS b FROM {source} GROUP BY {key}),
  gr AS (SELECT {key}, n, bw, a - 3 * bw AS st, (b + 3 * bw - (a - 3 * bw)) / 199.0 AS step,
    CAST(unnest(range(200)) AS INTEGER) AS point FROM sh),
  wv AS (SELECT {key}, value, count(*) AS c FROM {source} GROUP BY {key}, value),
  kd AS (SELECT {key}, point, any_value(st + step * point) AS x,
    sum(c * exp(-0.5 * power((st + step * point - value) / bw, 2))) / any_value(n * bw * sqrt(2 * pi())) AS density, any_value(step) AS step
    FROM gr JOIN wv USING ({key}) GROUP BY {key}, point)"""


def pairs(columns) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def pearson(source: str, columns, group: str = "", digits: int = 9) -> str:
    """One row per pair; null when a side is constant on the common rows."""
    head = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    rows = []
    for a, b in pairs(columns):
        both = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
        va, vb = f"var_pop({a}) {both}", f"var_pop({b}) {both}"
        r = f"CASE WHEN {va} > 1e-12 AND {vb} > 1e-12 THEN covar_pop({a}, {b}) / sqrt(({va}) * ({vb})) END"
        rows.append(
            f"SELECT {head}'{a}' AS col_a, '{b}' AS col_b, count(*) {both} AS n, "
            f"{rnd(r, digits)} AS r FROM {source} {tail}"
        )
    return " UNION ALL ".join(rows)


def spearman(source: str, columns) -> str:
    rows = []
    for a, b in pairs(columns):
        ranks = ", ".join(
            f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r{i}"
            for i, c in enumerate((a, b))
        )
        rows.append(
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, {rnd('corr(r0, r1)', 9)} AS r FROM "
            f"(SELECT {ranks} FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        )
    return " UNION ALL ".join(rows)


def kendall(source: str, columns) -> str:
    rows = []
    for a, b in pairs(columns):
        rows.append(
            f"""SELECT '{a}' AS col_a, '{b}' AS col_b, (SELECT CAST(sum(c) AS BIGINT) FROM cells) AS n,
  {rnd('''(SELECT sum(p.c * q.c * sign(p.a - q.a) * sign(p.b - q.b)) FROM cells p, cells q WHERE p.a > q.a)
   / sqrt(((SELECT sum(c) * (sum(c) - 1) / 2 FROM cells) - (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(c) AS t FROM cells GROUP BY a)))
   * ((SELECT sum(c) * (sum(c) - 1) / 2 FROM cells) - (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(c) AS t FROM cells GROUP BY b))))''', 9)} AS r
  FROM (SELECT 1)""".replace(
                "cells", f"(SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS c FROM {source} GROUP BY {a}, {b})"
            )
        )
    return " UNION ALL ".join(rows)


def class_pairs(source: str, columns, method: str, group: str = "y") -> str:
    """``(class, col_a, col_b, n, r)`` for every pair inside each class, rows with nulls in a pair left out."""
    rows = []
    for a, b in pairs(columns):
        kept = f"(SELECT {group} AS class, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        head = f"SELECT class, '{a}' AS col_a, '{b}' AS col_b"
        if method == "kendall":
            cells = f"(SELECT class, a, b, CAST(count(*) AS DOUBLE) AS c FROM {kept} GROUP BY ALL)"
            rows.append(
                f"""SELECT p.class, '{a}' AS col_a, '{b}' AS col_b,
  CAST(sqrt(sum(p.c * q.c)) AS BIGINT) AS n,
  CASE WHEN sum(p.c * q.c * abs(sign(p.a - q.a))) > 0 AND sum(p.c * q.c * abs(sign(p.b - q.b))) > 0 THEN
    sum(p.c * q.c * sign(p.a - q.a) * sign(p.b - q.b))
    / (sqrt(sum(p.c * q.c * abs(sign(p.a - q.a)))) * sqrt(sum(p.c * q.c * abs(sign(p.b - q.b))))) END AS r
  FROM {cells} p JOIN {cells} q ON p.class = q.class GROUP BY p.class"""
            )
            continue
        if method == "spearman":
            ranks = ", ".join(
                f"rank() OVER (PARTITION BY class ORDER BY {c}) + (count(*) OVER (PARTITION BY class, {c}) - 1) / 2.0::DOUBLE AS {c}"
                for c in "ab"
            )
            kept = f"(SELECT class, {ranks} FROM {kept})"
        varies = "max(a) > min(a) AND max(b) > min(b)"
        r = f"CASE WHEN {varies} THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END"
        rows.append(f"{head}, count(*) AS n, {r} AS r FROM {kept} GROUP BY class")
    return " UNION ALL ".join(rows)


def by_class(features, method: str, target: str, top_n: int, matrix: bool) -> str:
    """Top correlations with ``target`` inside each class, or the matrix of those features and the target."""
    tops = f"""WITH {LINE}, prs AS ({class_pairs("line", [*features, target], method)}),
  tops AS (SELECT class, col_a AS feature, r FROM prs WHERE col_b = '{target}'
    QUALIFY row_number() OVER (PARTITION BY class ORDER BY abs(r) DESC, col_a) <= {top_n})"""
    if not matrix:
        return f"{tops} SELECT class, feature, {rnd('r', 9)} AS r FROM tops"
    return f"""{tops}, kept AS (SELECT class, feature FROM tops UNION ALL SELECT DISTINCT class, '{target}' FROM prs),
  cells AS (SELECT class, col_a, col_b, r FROM prs UNION ALL SELECT class, col_b, col_a, r FROM prs
    UNION ALL SELECT class, feature, feature, 1.0 FROM kept)
  SELECT c.class, col_a, col_b, {rnd("r", 9)} AS r FROM cells c
  JOIN kept a ON a.class = c.class AND a.feature = col_a JOIN kept b ON b.class = c.class AND b.feature = col_b"""


def fitted(source: str, columns, where: str = "", robust: bool = False) -> str:
    """Parameter row per feature: name, centre, scale, mean, std, kept."""
    rows = []
    for i, c in enumerate(columns):
        if robust:
            center, scale = f"median({c})", f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"
        else:
            center, scale = f"avg({c})", f"stddev_pop({c})"
        flat = f"coalesce(max({c}) = min({c}), true)"
        rows.append(
            f"SELECT '{c}' AS feature, {i} AS ordinal, {center} AS center, "
            f"CASE WHEN {flat} OR {scale} = 0 THEN 1.0 ELSE {scale} END AS scale, avg({c}) AS mean, "
            f"CASE WHEN {flat} THEN 0.0 ELSE stddev_pop({c}) END AS std, "
            f"(NOT {flat} AND var_pop({c}) > 1e-6) AS kept FROM {source} {where}"
        )
    return "fit AS (" + " UNION ALL ".join(rows) + ")"


def scaled(columns, digits: int = 6) -> str:
    return ", ".join(
        rnd(
            f"(s.{c} - (SELECT center FROM fit WHERE feature = '{c}')) / (SELECT scale FROM fit WHERE feature = '{c}')",
            digits,
        )
        + f" AS {c}"
        for c in columns
    )


def outlier(columns, threshold: float = 4.0) -> str:
    tests = " OR ".join(
        f"abs((s.{c} - (SELECT mean FROM fit WHERE feature = '{c}')) / (SELECT std FROM fit WHERE feature = '{c}')) > {threshold}"
        for c in columns
    )
    return f"CAST({tests} AS INTEGER)"


def imputed(columns, source: str = "nulled", keep: str = "k, y", name: str = "imputed") -> str:
    """Column medians with the fallback for empty columns."""
    medians = ", ".join(f"median({c}) AS {c}" for c in columns)
    listed = ", ".join(f"(SELECT {c} FROM med)" for c in columns)
    fills = ", ".join(
        f"coalesce({c}, (SELECT {c} FROM med), (SELECT m FROM fallback), 0.0) AS {c}" for c in columns
    )
    return f"""med AS (SELECT {medians} FROM {source}),
  fallback AS (SELECT median(v) AS m FROM (SELECT unnest([{listed}]) AS v)),
  {name} AS (SELECT {keep}, {fills} FROM {source})"""


def profile(source: str, columns) -> str:
    return f"""{long(source, columns, keep="")},
  ag AS (SELECT feature, count(*) AS n, min(value) AS mn, max(value) AS mx,
    CASE WHEN count(*) < 3 THEN NULL ELSE coalesce(skewness(value), 0.0) END AS sk,
    count(*) FILTER (value > 0) AS np, count(*) FILTER (value < 0) AS nn,
    min(value) FILTER (value > 0) AS minp, max(value) FILTER (value > 0) AS maxp,
    min(value) FILTER (value < 0) AS minn, max(value) FILTER (value < 0) AS maxn,
    min(abs(value)) FILTER (value <> 0) AS mag FROM long GROUP BY feature),
  dyn AS (SELECT *, coalesce(greatest(abs(mn), abs(mx)) / mag, 1.0) AS dr FROM ag),
  prof AS (SELECT feature, ordinal, CASE WHEN n < 2 THEN 'linear'
    WHEN np > 0 AND nn = 0 THEN CASE WHEN np > 1 AND (maxp / minp > 1000 OR abs(sk) > 3) THEN 'log' ELSE 'linear' END
    WHEN np > 0 AND nn > 0 THEN CASE WHEN dr > 1e6 THEN 'symlog' WHEN dr > 1e4 THEN 'asinh' ELSE 'linear' END
    WHEN nn > 0 THEN CASE WHEN nn > 1 AND (abs(minn / maxn) > 1000 OR abs(sk) > 3) THEN 'symlog' ELSE 'linear' END
    ELSE 'linear' END AS recommended_scale, n, {rnd("mn")} AS min, {rnd("mx")} AS max, {rnd("dr", 3)} AS dynamic_range,
    {rnd("sk")} AS skewness, nn > 0 AS has_negatives, np > 0 AS has_positives, (mn <= 0 AND mx >= 0) AS span_zero
    FROM dyn JOIN feats USING (feature))"""


def cell(c: str) -> str:
    return f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N')"


def digest(columns, source: str) -> str:
    cells = ", ".join(cell(c) for c in columns)
    return f"""dg AS (SELECT ('0x' || substr(md5(concat_ws('|', {cells})), 1, 15))::BIGINT AS d FROM {source}),
  sums AS (SELECT count(*) AS n_rows, CAST(sum(d) AS VARCHAR) AS digest_sum, CAST(bit_xor(d) AS VARCHAR) AS digest_xor FROM dg)
  SELECT *, md5(concat_ws('|', n_rows, digest_sum, digest_xor)) AS fingerprint FROM sums"""


def poisson_case(u: str, mean: float) -> str:
    """The Poisson weight of a uniform integer below the prime, for a small mean."""
    prime, cdf, parts = 2**31 - 1, 0.0, []
    for k in range(40):
        cdf += math.exp(-mean) * mean**k / math.factorial(k)
        limit = int(min(cdf, 1.0) * prime)
        parts.append(f"WHEN {u} < {limit} THEN {k}")
        if limit >= prime:
            break
    return f"CASE {' '.join(parts)} END"


def bootstrap_mean() -> str:
    """Weights of the rows that share a value: a Poisson draw for every power of two in their number."""
    p = 2**31 - 1
    h = ", ".join(
        f"('0x' || substr(md5(feature || '|' || before || '|42'), {1 + 8 * i}, 8))::BIGINT % {p} AS h{i}" for i in range(4)
    )
    return f"""WITH {LINE}, {long("line", FEATURES, keep="")},
  vc AS (SELECT feature, value, count(*) AS c FROM long GROUP BY ALL),
  ps AS (SELECT *, CAST(sum(c) OVER (PARTITION BY feature ORDER BY value) - c AS BIGINT) AS before FROM vc),
  hs AS (SELECT feature, value, c, {h} FROM ps),
  bt AS (SELECT hs.*, bit FROM hs, (SELECT unnest(range(17)) AS bit) WHERE (c >> bit) & 1 = 1),
  dr AS (SELECT feature, value, bit, b,
    (((((h0 * (b + 1000 * bit) + h1) % {p}) * (b + 1000 * bit) + h2) % {p}) * (b + 1000 * bit) + h3) % {p} AS u
    FROM bt, (SELECT unnest(range(1000)) AS b)),
  me AS (SELECT bit, pow(2.0, bit) AS l, unnest(range(CAST(greatest(0, floor(pow(2.0, bit) - 12 * sqrt(pow(2.0, bit)) - 30)) AS BIGINT),
    CAST(ceil(pow(2.0, bit) + 12 * sqrt(pow(2.0, bit)) + 30) AS BIGINT) + 1)) AS w FROM (SELECT unnest(range(2, 17)) AS bit)),
  li AS (SELECT bit, max(w) + 1 AS w, lim FROM (SELECT bit, w, CAST(floor(least(sum(exp(w * ln(l) - l - lgamma(w + 1)))
    OVER (PARTITION BY bit ORDER BY w), 1.0) * {p}) AS BIGINT) AS lim FROM me) GROUP BY bit, lim),
  wt AS (SELECT feature, value, b, CASE WHEN bit = 0 THEN {poisson_case("u", 1.0)} ELSE {poisson_case("u", 2.0)} END AS w
    FROM dr WHERE bit < 2
    UNION ALL SELECT feature, value, b, coalesce(w, 0) FROM (SELECT * FROM dr WHERE bit > 1) d
      ASOF LEFT JOIN li ON d.bit = li.bit AND d.u >= li.lim),
  mn AS (SELECT feature, b, sum(w * value) / sum(w) AS value FROM wt GROUP BY feature, b)
  SELECT feature, {rnd("quantile_cont(value, 0.025)")} AS lower, {rnd("quantile_cont(value, 0.975)")} AS upper
  FROM mn GROUP BY feature"""


def bootstrap_median() -> str:
    """Ranks from the binomial law of the number of draws at or below a rank, summed term by term."""
    tail = """list_sum(list_transform(range(CAST(k AS BIGINT), least(n, CAST(k + 12 * sqrt(n) + 40 AS BIGINT)) + 1),
      lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(j / n) + (n - i) * ln(1 - j / n))))"""
    return f"""WITH {LINE}, {long("line", FEATURES, keep="")},
  sz AS (SELECT feature, count(*) AS n FROM long GROUP BY feature),
  ord AS (SELECT DISTINCT n, unnest([(n + 1) // 2, n // 2 + 1]) AS k FROM sz),
  cand AS (SELECT n, k, unnest(range(greatest(1, CAST(n / 2 - 6 * sqrt(n) AS BIGINT)),
    least(n - 1, CAST(n / 2 + 6 * sqrt(n) AS BIGINT)) + 1)) AS j FROM ord),
  pr AS (SELECT n, k, j, {tail} AS p FROM cand),
  rk AS (SELECT n, k, min(j) FILTER (p >= 0.025) AS lo, min(j) FILTER (p >= 0.975) AS hi FROM pr GROUP BY n, k),
  pos AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS j FROM long),
  lo AS (SELECT feature, avg(value) AS lower FROM pos JOIN sz USING (feature) JOIN rk ON sz.n = rk.n AND j = lo
    GROUP BY feature),
  hi AS (SELECT feature, avg(value) AS upper FROM pos JOIN sz USING (feature) JOIN rk ON sz.n = rk.n AND j = hi
    GROUP BY feature)
  SELECT feature, {rnd("lower")} AS lower, {rnd("upper")} AS upper FROM lo JOIN hi USING (feature)"""


def adjusted(method: str) -> str:
    """Textbook definitions on the sorted p-values; running extremes over ranks."""
    up = "OVER (ORDER BY p)"
    down = "OVER (ORDER BY p DESC)"
    sidak = "CASE WHEN p >= 1 THEN 1.0 ELSE 1 - power(1 - p, {e}) END"
    harmonic = "(SELECT sum(1.0 / g) FROM (SELECT unnest(range(1, m + 1)) AS g))"
    bh = f"least(min(p * m / i) {down}, 1.0)"
    extra, value = "", None
    if method == "bonferroni":
        value = "p * m"
    elif method == "sidak":
        value = sidak.format(e="m")
    elif method == "holm":
        value = f"max(p * (m - i + 1)) {up}"
    elif method == "holm-sidak":
        value = f"max({sidak.format(e='m - i + 1')}) {up}"
    elif method == "simes-hochberg":
        value = f"min(p * (m - i + 1)) {down}"
    elif method == "fdr_bh":
        value = bh
    elif method == "fdr_by":
        value = f"min(p * m / i * hm) {down}"
        extra = ", har AS (SELECT sum(1.0 / g) AS hm FROM (SELECT unnest(range(1, (SELECT count(*) FROM pv) + 1)) AS g))"
    elif method == "fdr_gbs":
        value = f"max(CASE WHEN p < 1 THEN (m - i + 1) / i * p / (1 - p) ELSE 1e9 END) {up}"
    elif method in ("fdr_tsbh", "fdr_tsbky"):
        factor = 1.05 if method == "fdr_tsbky" else 1.0
        extra = f""", one AS (SELECT *, {bh} AS q FROM rk),
  two AS (SELECT count(*) FILTER (q <= 0.05 / {factor}) AS r FROM one)"""
        value = f"q * (CASE WHEN r = 0 OR r = m THEN m ELSE m - r END) / m * {factor}"
    elif method == "hommel":
        extra = """, cj AS (SELECT j, min(j * p / (i - m + j)) AS c FROM rk, (SELECT unnest(range(1, (SELECT count(*) FROM pv) + 1)) AS j)
    WHERE i > m - j GROUP BY j)"""
        value = "greatest(p, (SELECT max(CASE WHEN rk.i > rk.m - cj.j THEN cj.c ELSE least(cj.j * rk.p, cj.c) END) FROM cj))"
    source = {"fdr_by": "rk, har", "fdr_tsbh": "one, two", "fdr_tsbky": "one, two"}.get(method, "rk")
    return f"""WITH {VECS}, {long("vecs", VECTOR_FEATURES)}, {moments()},
  pv AS MATERIALIZED (SELECT feature, p_t AS p FROM ttp),
  rk AS (SELECT feature, p, CAST(row_number() OVER (ORDER BY p) AS DOUBLE) AS i, CAST(count(*) OVER () AS DOUBLE) AS m FROM pv){extra}
  SELECT feature, {rnd("p", 7)} AS p_value, {rnd(f"least({value}, 1.0)", 7)} AS p_adjusted FROM {source}"""


def process(robust: bool = False, train: bool = False, flag: bool = True) -> str:
    kept = FEATURES
    unique = """uniq AS (SELECT min(k) AS k, y, quantity, price, discount, tax, void, constant
    FROM dirt GROUP BY ALL)"""
    nulled = NULLED.replace("FROM dirt", "FROM uniq")
    where = "WHERE split = 'train'" if train else ""
    flagged = f", {outlier(kept)} AS is_outlier" if flag else ""
    return f"""WITH {DIRT}, {unique}, {nulled}, {imputed(DIRTY)}, {split("imputed")},
  {fitted("parted", DIRTY, where, robust)}
  SELECT k, split, y, {scaled([c for c in DIRTY if c in kept])}{flagged} FROM parted s"""


def vector_text(columns) -> str:
    parts = ", ".join(
        f"CAST(round(((s.{c} - (SELECT center FROM fit WHERE feature = '{c}')) / (SELECT scale FROM fit WHERE feature = '{c}')) * 1e6) AS BIGINT)"
        for c in columns
    )
    return f"concat_ws(',', {parts})"


def top(where: str = "", method: str = "pearson") -> str:
    if method == "pearson":
        found = "SELECT feature, corr(value, y) AS r FROM long GROUP BY feature"
    else:
        found = """SELECT feature, corr(rv, ry) AS r FROM (SELECT feature,
      rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rv,
      rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry
      FROM long) GROUP BY feature"""
    return f"""WITH {VECS}, {long("vecs", VECTOR_FEATURES)}, found AS ({found})
  SELECT feature, {rnd("r", 9)} AS r FROM found WHERE r IS NOT NULL {where} ORDER BY abs(r) DESC, feature LIMIT 10"""


def submatrix() -> str:
    return f"""WITH {VECS}, {long("vecs", VECTOR_FEATURES)},
  tops AS (SELECT feature FROM long GROUP BY feature ORDER BY abs(corr(value, y)) DESC, feature LIMIT 10),
  {long("vecs", VECTOR_FEATURES + ["yy"], keep="vec_id", name="wide").replace("FROM vecs", "FROM (SELECT *, CAST(y AS DOUBLE) AS yy FROM vecs)")},
  chosen AS (SELECT vec_id, CASE WHEN feature = 'yy' THEN 'y' ELSE feature END AS feature, value FROM wide
    WHERE feature = 'yy' OR feature IN (SELECT feature FROM tops))
  SELECT a.feature AS col_a, b.feature AS col_b,
    {rnd("CASE WHEN a.feature = b.feature THEN 1.0 ELSE corr(a.value, b.value) END", 9)} AS r
  FROM chosen a JOIN chosen b USING (vec_id) GROUP BY a.feature, b.feature"""


def oracles() -> dict[str, str]:
    sql: dict[str, str] = {}
    feats, dirty_feats = feature_rows(FEATURES), feature_rows(DIRTY)
    lines, dirty = long("line", FEATURES), long("dirt", DIRTY)

    sql["scan_features"] = f"WITH {LINE} SELECT * FROM line"
    sql["rename_features"] = (
        "SELECT l_quantity AS feature_0, l_extendedprice AS feature_1, l_discount AS feature_2, "
        "l_tax AS feature_3 FROM lineitem"
    )
    sql["expand_vector"] = f"WITH {VECS} SELECT * FROM vecs"
    sql["label_first_n"] = """WITH r AS (SELECT row_number() OVER () - 1 AS row_number, l_orderkey, l_partkey FROM lineitem)
  SELECT row_number, l_orderkey, l_partkey, CAST(row_number < 2500 AS INTEGER) AS signal FROM r"""
    sql["label_first_n_by_file"] = """SELECT l_orderkey, l_partkey, l_extendedprice,
  CAST(row_number() OVER () <= 2500 AS INTEGER) AS signal FROM lineitem"""
    sql["label_first_n_csv"] = """WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_number FROM orders)
  SELECT CAST(o_orderkey AS DOUBLE) AS feature_0, o_totalprice AS feature_1, row_number,
  CAST(row_number < 500 AS INTEGER) AS signal FROM r"""
    sql["class_count_check"] = f"""WITH {LINE}, c AS (SELECT 1 AS label, count(*) FILTER (y = 1) AS n, CAST(20000 AS BIGINT) AS expected FROM line
  UNION ALL SELECT 0, count(*) FILTER (y = 0), 40000 FROM line)
  SELECT CAST(label AS INTEGER) AS label, n, expected, n = expected AS matches FROM c"""
    sql["splits_csv_roundtrip"] = f"WITH {LINE}, {split()} SELECT * FROM parted"
    sql["cache_roundtrip"] = f"""WITH {LINE}, {split()}, {fitted("parted", FEATURES, robust=True)}
  SELECT k, split, y, {scaled(FEATURES)}, {outlier(FEATURES)} AS is_outlier FROM parted s"""
    sql["params_roundtrip"] = f"""WITH {LINE}, {fitted("line", FEATURES)}
  SELECT feature, CAST(ordinal AS INTEGER) AS ordinal, {rnd("center", 7)} AS center, {rnd("scale", 7)} AS scale, kept FROM fit"""

    sql["dedupe_rows"] = f"WITH {LINE} SELECT DISTINCT quantity, discount, tax, y FROM line"
    sql["dedupe_keyed"] = (
        f"WITH {LINE} SELECT min(k) AS k, quantity, discount, tax, y FROM line GROUP BY ALL"
    )
    sql["sentinel_to_null"] = f"WITH {DIRT}, {NULLED} SELECT k, {names(DIRTY)} FROM nulled"
    sql["sentinel_counts"] = f"WITH {DIRT} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} = -999) AS n_sentinel FROM dirt"
        for c in ["y", *DIRTY]
    )
    sql["missing_summary"] = f"WITH {DIRT}, {NULLED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing FROM nulled"
        for c in ["k", "y", *DIRTY]
    )
    sql["median_impute"] = f"""WITH {DIRT}, {NULLED}, {imputed(["quantity", "price"])}
  SELECT k, {rounded_columns(["quantity", "price"])} FROM imputed"""
    sql["impute_all_null"] = f"""WITH {DIRT}, {NULLED}, {imputed(DIRTY)}
  SELECT k, {rounded_columns(["void", "constant"])} FROM imputed"""
    columns = ["quantity", "discount", "tax", "void", "constant"]
    sql["clean_full"] = f"""WITH {DIRT}, uniq AS (SELECT DISTINCT y, {names(columns)} FROM dirt),
  nulled AS (SELECT y, {", ".join(f"nullif({c}, -999) AS {c}" for c in columns)} FROM uniq),
  {imputed(columns, keep="y")} SELECT y, {rounded_columns(columns)} FROM imputed"""
    five = [*FEATURES, "balance"]
    sql["profile_features"] = f"""WITH {LINE}, bal AS (SELECT *, price - 50000.0::DOUBLE AS balance FROM line),
  {feature_rows(five)}, {profile("bal", five)} SELECT * FROM prof"""
    three = ["value", "shifted", "negated"]
    # the column to unpivot is called value itself, so it goes under another name first
    ev = EVENTS.replace(" value,", " value AS value_,", 1)
    three_ = ["value_", "shifted", "negated"]
    events_profile = (
        f"WITH {ev}, {feature_rows(three)}, "
        + profile("ev", three_).replace(
            "FROM dyn JOIN feats USING (feature)",
            "FROM (SELECT * REPLACE (rtrim(feature, '_') AS feature) FROM dyn) JOIN feats USING (feature)",
        )
    )
    sql["profile_events"] = f"{events_profile} SELECT * FROM prof"
    sql["scaling_recommendation"] = f"{events_profile} SELECT feature, recommended_scale FROM prof"
    sql["scaling_summary"] = f"""{events_profile} SELECT recommended_scale, count(*) AS n_features,
  array_to_string(list(feature ORDER BY ordinal)[1:3], ',') AS examples FROM prof GROUP BY recommended_scale"""
    cells = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in ["y", *DIRTY])
    sql["data_summary"] = f"""WITH {DIRT}, {NULLED} SELECT count(*) AS total_samples, count(*) FILTER (y = 1) AS signal_count,
  count(*) FILTER (y = 0) AS background_count, {rnd("count(*) FILTER (y = 1) / count(*)")} AS signal_ratio,
  CAST({len(DIRTY)} AS INTEGER) AS feature_count, CAST(sum({cells}) AS BIGINT) AS missing_values FROM nulled"""
    sql["class_distribution"] = (
        "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag ORDER BY n DESC, l_returnflag"
    )
    sql["feature_basic_stats"] = f"WITH {DIRT} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS n, {rnd(f'avg({c})', 7)} AS mean, {rnd(f'stddev_samp({c})', 7)} AS std FROM dirt"
        for c in DIRTY
    )
    sql["dataset_fingerprint"] = "WITH " + digest(
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"], "lineitem"
    )
    sql["lineage"] = f"""SELECT fingerprint AS data_hash, n_rows, 'False' AS clean
  FROM (WITH {digest(["l_orderkey", "l_partkey", "l_suppkey"], "lineitem")})"""
    sql["dataset_fingerprint_ordered"] = (
        "WITH num AS (SELECT *, row_number() OVER () - 1 AS rn FROM lineitem), "
        + digest(["l_orderkey", "l_returnflag", "rn"], "num")
    )
    whole = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    whole += ["l_returnflag", "l_linestatus", "l_shipdate"]
    sql["dataset_fingerprint_all"] = "WITH " + digest(whole, "lineitem")
    sql["lineage_all"] = f"""SELECT fingerprint AS data_hash, n_rows, 'False' AS clean
  FROM (WITH {digest(whole, "lineitem")})"""
    sql["dataset_fingerprint_ordered_all"] = (
        "WITH num AS (SELECT *, row_number() OVER () - 1 AS rn FROM lineitem), " + digest([*whole, "rn"], "num")
    )
    sql["dedupe_rows_all"] = f"WITH {LINE} SELECT DISTINCT {names(FEATURES)}, y FROM line"
    sql["dedupe_keyed_all"] = f"WITH {LINE} SELECT min(k) AS k, {names(FEATURES)}, y FROM line GROUP BY ALL"
    sql["clean_full_all"] = f"""WITH {DIRT}, uniq AS (SELECT DISTINCT y, {names(DIRTY)} FROM dirt),
  nulled AS (SELECT y, {", ".join(f"nullif({c}, -999) AS {c}" for c in DIRTY)} FROM uniq),
  {imputed(DIRTY, keep="y")} SELECT y, {rounded_columns(DIRTY)} FROM imputed"""

    sql["prepare_features"] = sql["scan_features"]
    sql["variance_filter"] = f"WITH {DIRT}, {fitted('dirt', DIRTY)} SELECT feature, kept FROM fit"
    for name, robust in (("scale_standard", False), ("scale_robust", True)):
        sql[name] = (
            f"WITH {LINE}, {fitted('line', FEATURES, robust=robust)} SELECT k, {scaled(FEATURES)} FROM line s"
        )
    sql["fit_apply"] = f"WITH {VECS}, {fitted('vecs', VECTOR_FEATURES)} SELECT vec_id, y, {scaled(VECTOR_FEATURES)} FROM vecs s"
    sql["transform_holdout"] = f"""WITH {LINE}, {split()}, {fitted("parted", FEATURES, "WHERE split = 'train'")}
  SELECT k, y, {scaled(FEATURES)} FROM parted s WHERE split = 'test'"""
    sql["transform_stream"] = f"""WITH {EVENTS}, {fitted("ev", ["value"])}
  SELECT event_id, {scaled(["value"])}, {outlier(["value"])} AS is_outlier FROM ev s"""
    sql["outlier_flag"] = f"""WITH {EVENTS}, {fitted("ev", ["value", "shifted"])}
  SELECT event_id, {outlier(["value", "shifted"])} AS is_outlier FROM ev s"""
    sql["stratified_split"] = f"WITH {LINE}, {split()} SELECT k, y, split FROM parted"
    sql["split_shapes"] = f"""WITH {LINE}, {split(seed=7, size=0.3)}
  SELECT split, count(*) AS n_rows, CAST({len(FEATURES)} AS INTEGER) AS n_features FROM parted GROUP BY split"""
    sql["process_full"] = process()
    sql["process_fit_on_train"] = process(robust=True, train=True, flag=False)
    sql["test_split_vector"] = f"""WITH {LINE}, {split()}, {fitted("parted", FEATURES)}
  SELECT k, y, {vector_text(FEATURES)} AS features FROM parted s WHERE split = 'test'"""
    sql["preprocess_vector"] = (
        f"WITH {LINE}, {fitted('line', FEATURES)} SELECT k, {vector_text(FEATURES)} AS features FROM line s"
    )

    sql["bootstrap_error"] = f"""WITH c AS (SELECT l_returnflag AS label, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY ALL),
  t AS (SELECT *, sum(c) OVER () AS n FROM c)
  SELECT label, CAST(c AS BIGINT) AS n, {rnd("sqrt(n * (c / n) * (1 - c / n))")} AS error, 'count' AS stat FROM t
  UNION ALL SELECT label, CAST(c AS BIGINT), {rnd("sqrt((c / n) * (1 - c / n) / n)")}, 'percent' FROM t"""
    sql["bootstrap_ci_mean"] = bootstrap_mean()
    sql["bootstrap_ci_median"] = bootstrap_median()
    sql["cohen_d"] = f"WITH {LINE}, {lines}, {moments()} SELECT feature, {rnd(COHEN, 9)} AS effect_size FROM mo"
    sql["cliffs_delta"] = (
        f"WITH {LINE}, {lines}, {rank_stats()} SELECT feature, {rnd('1 - 2 * auc', 9)} AS effect_size FROM st"
    )
    sql["mannwhitney"] = f"""WITH {LINE}, {lines}, {rank_stats()}
  SELECT feature, {rnd("n0 * n1 - u1", 8)} AS u_background, {rnd("z", 8)} AS z, {rnd("p_mw", 8)} AS p_mannwhitney FROM mwp"""
    sql["ks_two_sample"] = f"""WITH {LINE}, {lines}, {rank_stats()}
  SELECT feature, {rnd("ks_d", 8)} AS ks_d, {rnd("p_ks", 8)} AS p_ks FROM ksp"""
    sql["ttest_welch"] = f"""WITH {LINE}, {lines}, {moments()}
  SELECT feature, {rnd("t", 8)} AS t, {rnd("df", 4)} AS df, {rnd("p_t", 8)} AS p_ttest FROM ttp"""
    sql["ttest_pooled"] = f"""WITH {LINE}, {lines}, {moments()},
  po AS (SELECT feature, n0 + n1 - 2 AS df, (m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)) AS t FROM mo)
  SELECT feature, {rnd("t", 8)} AS t, {rnd("df", 8)} AS df, {rnd(student_p("t", "df"), 8)} AS p_ttest FROM po"""
    sql["ttest_documents"] = f"""WITH docs AS (SELECT CAST(n_chars AS DOUBLE) AS n_chars, quality AS y FROM documents JOIN labels USING (doc_id)),
  {long("docs", ["n_chars"])}, {moments()}
  SELECT feature, {rnd("t", 8)} AS t, {rnd("df", 4)} AS df, {rnd("p_t", 8)} AS p_ttest FROM ttp"""
    for name, method, source, p in (
        ("feature_separation_mw", "mannwhitney", "mwp", "p_mw"),
        ("feature_separation_ks", "ks", "ksp", "p_ks"),
        ("feature_separation_t", "ttest", "ttp", "p_t"),
    ):
        stats = moments() if method == "ttest" else rank_stats()
        sql[name] = f"""WITH {DIRT}, {dirty}, {dirty_feats}, {stats}
  SELECT feature, {rnd(p, 8)} AS p_value, '{method}' AS method FROM feats LEFT JOIN {source} USING (feature)"""
    for name, strict in (("feature_auc", False), ("feature_auc_strict", True)):
        auc = "CASE WHEN nn = 0 THEN auc END" if strict else "auc"
        sql[name] = f"""WITH {DIRT}, {dirty}, {dirty_feats}, {rank_stats()},
  f AS (SELECT feature, auc, (SELECT count(*) FROM dirt) - CAST(coalesce(n0 + n1, 0) AS BIGINT) AS nn FROM feats LEFT JOIN st USING (feature))
  SELECT feature, {rnd(auc, 9)} AS auc, nn AS n_null FROM f"""
    for name, shared in (("js_divergence", False), ("js_divergence_shared", True)):
        sql[name] = f"""WITH {LINE}, {lines}, {histogram("long", "feature, y", shared=shared)}, {JSD}
  SELECT feature, {rnd("js_divergence", 9)} AS js_divergence FROM jsd"""
    marked = [*FEATURES, "marked_up"]
    sql["redundant_pairs"] = f"""WITH {LINE}, mk AS (SELECT *, price * 1.01::DOUBLE AS marked_up FROM line), pr AS ({pearson("mk", marked)})
  SELECT col_b AS later, col_a AS earlier, {rnd("r")} AS r FROM pr WHERE abs(r) > 0.9"""
    for name, method in ADJUSTMENTS.items():
        sql[name] = adjusted(method)

    sql["separation_summary"] = f"""WITH {LINE}, {lines}, {rank_stats()}, {moments()}, {histogram("long", "feature, y")}, {JSD}
  SELECT feature, {rnd("auc", 8)} AS auc, {rnd(COHEN, 8)} AS effect_size, {rnd("p_mw", 8)} AS p_value,
  {STARS.format(p="p_mw")} AS stars, {rnd("js_divergence", 8)} AS js_divergence
  FROM mwp JOIN mo USING (feature) JOIN jsd USING (feature) WHERE n_distinct > 1"""
    vec_long = long("vecs", VECTOR_FEATURES)
    sql["separation_vectors"] = f"""WITH {VECS}, {vec_long}, {rank_stats()}, {moments()}, {histogram("long", "feature, y")}, {JSD}
  SELECT feature, {rnd("auc", 8)} AS auc, {rnd(COHEN, 8)} AS effect_size, {rnd("p_mw", 8)} AS p_value,
  {STARS.format(p="p_mw")} AS stars, {rnd("js_divergence", 8)} AS js_divergence
  FROM mwp JOIN mo USING (feature) JOIN jsd USING (feature) WHERE n_distinct > 1"""
    sql["separation_summary_ttest"] = f"""WITH {DIRT}, {dirty}, {rank_stats()}, {moments()}, {histogram("long", "feature, y", shared=True)}, {JSD}
  SELECT feature, {rnd("auc", 8)} AS auc, {rnd(COHEN, 8)} AS effect_size, {rnd("p_t", 8)} AS p_value,
  {STARS.format(p="p_t")} AS stars, {rnd("js_divergence", 8)} AS js_divergence
  FROM st JOIN ttp USING (feature) JOIN jsd USING (feature) WHERE n_distinct > 1"""
    sql["trim_percentiles"] = f"""WITH {LINE}, {lines} SELECT feature, {rnd("quantile_cont(value, 0.01)")} AS lower,
  {rnd("quantile_cont(value, 0.99)")} AS upper FROM long GROUP BY feature"""
    hist_columns = f"bin, {rnd('lo')} AS lo, {rnd('hi')} AS hi, n, {rnd('density', 10)} AS density"
    sql["class_histogram"] = f"""WITH {LINE}, {lines}, {histogram("long", "feature, y")}
  SELECT feature, y AS label, {hist_columns} FROM hist"""
    values = "long AS (SELECT 'value' AS feature, value FROM events)"
    sql["distribution_histogram"] = f"WITH {values}, {histogram('long', 'feature')} SELECT feature, {hist_columns} FROM hist"
    kde_columns = f"point, {rnd('x')} AS x, {rnd('density * step', 10)} AS mass"
    sql["class_kde"] = f"WITH {LINE}, {lines}, {kde('long', 'feature, y')} SELECT feature, y AS label, {kde_columns} FROM kd"
    sql["class_kde_binned"] = f"""WITH {LINE}, {lines}, {kde('long', 'feature, y')}
  SELECT feature, y AS label, point, {rnd("density * step", 7)} AS mass FROM kd"""
    sql["distribution_kde"] = f"WITH {values}, {kde('long', 'feature')} SELECT feature, {kde_columns} FROM kd"
    sql["class_kde_vectors"] = f"WITH {VECS}, {vec_long}, {kde('long', 'feature, y')} SELECT feature, y AS label, {kde_columns} FROM kd"
    sql["class_location"] = f"""WITH {LINE}, {lines} SELECT feature, y AS label, {rnd("avg(value)", 7)} AS mean,
  {rnd("median(value)", 7)} AS median FROM long GROUP BY feature, y"""
    sql["significance_stars"] = f"""WITH {VECS}, {long("vecs", VECTOR_FEATURES)}, {rank_stats()}
  SELECT feature, {rnd("p_mw", 8)} AS p_value, {STARS.format(p="p_mw")} AS stars FROM mwp"""
    sql["feature_separation_ks_exact"] = f"""WITH RECURSIVE x AS (
    SELECT n_chars AS v, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
  z AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM x),
  cum AS (SELECT sum(count(*) FILTER (y = 0)) OVER (ORDER BY v) AS s0, sum(count(*) FILTER (y = 1)) OVER (ORDER BY v) AS s1
    FROM x GROUP BY v),
  far AS (SELECT n0, n1, max(abs(s0 * n1 - s1 * n0)) AS h FROM cum, z GROUP BY n0, n1),
  path AS (SELECT 0 AS k, list_transform(range(0, n0 + 1), lambda i: 0.0::DOUBLE) AS q FROM z UNION ALL
    SELECT k + 1, list_transform(range(0, n0 + 1), lambda i: CASE WHEN i > k + 1 OR k + 1 - i > n1 THEN 0.0::DOUBLE
      WHEN abs(i * n1 - (k + 1 - i) * n0) >= h THEN 1.0::DOUBLE
      ELSE (CASE WHEN i > 0 THEN q[i] ELSE 0 END) * i / (k + 1) + q[i + 1] * (k + 1 - i) / (k + 1) END)
    FROM path, far WHERE k < n0 + n1)
  SELECT 'n_chars' AS feature, {rnd("least(q[n0 + 1], 1.0)", 9)} AS p_value, 'ks' AS method FROM path, z WHERE k = n0 + n1"""
    sql["feature_separation_mannwhitney_exact"] = f"""WITH RECURSIVE x AS (
    SELECT s_acctbal AS v, s_nationkey = 3 AS y, rank() OVER (ORDER BY s_acctbal) AS r FROM supplier),
  z AS (SELECT count(*) FILTER (NOT y) AS n, count(*) FILTER (y) AS m,
    CAST(sum(r) FILTER (y) AS BIGINT) - m * (m + 1) // 2 AS u FROM x),
  ways AS (SELECT 0 AS i, list_transform(range(0, n * m + 1), lambda x: CASE WHEN x = 0 THEN 1::HUGEINT ELSE 0 END) AS a FROM z
    UNION ALL SELECT i + 1, list_transform(range(0, n * m + 1), lambda x: CAST(list_sum(list_transform(range(0, x // (i + 1) + 1),
      lambda t: a[x - t * (i + 1) + 1] - (CASE WHEN x - t * (i + 1) >= n + i + 1 THEN a[x - t * (i + 1) - n - i] ELSE 0 END))) AS HUGEINT))
    FROM ways, z WHERE i < m)
  SELECT 's_acctbal' AS feature, {rnd("CASE WHEN m > 0 THEN least(1.0::DOUBLE, 2 * list_sum(a[1:n * m - greatest(u, n * m - u) + 1])::DOUBLE / list_sum(a)::DOUBLE) END", 9)} AS p_value,
    'mannwhitney' AS method FROM ways, z WHERE i = m"""
    sql["corr_pearson"] = f"WITH {LINE} {pearson('line', [*FEATURES, 'y'])}"
    sql["corr_pearson_nulls"] = f"WITH {DIRT}, {NULLED} {pearson('nulled', DIRTY)}"
    sql["corr_spearman"] = f"WITH {LINE} {spearman('line', [*FEATURES, 'y'])}"
    sql["corr_spearman_nulls"] = f"WITH {DIRT}, {NULLED} {spearman('nulled', ['quantity', 'price', 'discount'])}"
    sql["corr_spearman_target"] = f"""WITH {LINE} SELECT col_a AS feature, r FROM ({spearman("line", [*FEATURES, "y"])}) WHERE col_b = 'y'"""
    sql["corr_kendall"] = f"WITH {LINE} {kendall('line', ['quantity', 'discount', 'tax'])}"
    sql["corr_kendall_all"] = f"WITH {LINE} {kendall('line', FEATURES)}"
    sql["corr_kendall_target"] = f"""WITH {LINE}, {lines}, {rank_stats()} SELECT feature,
  {rnd("(2 * auc - 1) * n0 * n1 / sqrt(((n0 + n1) * (n0 + n1 - 1) / 2 - tied_pairs) * n0 * n1)", 9)} AS r FROM st"""
    sql["corr_per_class"] = f"""WITH {LINE}, two AS (SELECT *, y AS grp FROM line), pr AS ({pearson("two", [*FEATURES, "y"], "grp")})
  SELECT CASE WHEN grp = 1 THEN 'Signal' ELSE 'Background' END AS label, col_a, col_b, n, r FROM pr"""
    sql["top_correlations"] = top()
    sql["top_correlations_positive"] = top("AND r > 0")
    sql["top_correlations_negative"] = top("AND r < 0")
    sql["top_correlations_spearman"] = top(method="spearman")
    tau = "(2 * auc - 1) * n0 * n1 / sqrt(((n0 + n1) * (n0 + n1 - 1) / 2 - tied_pairs) * n0 * n1)"
    def middle(x: str) -> str:
        return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE"

    by_rank = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, corr(a, b) AS r FROM (SELECT {middle(f)} AS a, {middle('tax')} AS b FROM line)"
        for f in ("quantity", "price", "discount")
    )
    sql["top_correlations_spearman_numeric_target"] = f"WITH {LINE} SELECT feature, {rnd('r', 9)} AS r FROM ({by_rank})"
    by_cells = " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, sum(p.n * q.n * sign(p.x - q.x) * sign(p.y - q.y))
          / sqrt(CAST(sum(p.n * q.n * abs(sign(p.x - q.x))) AS DOUBLE) * sum(p.n * q.n * abs(sign(p.y - q.y)))) AS r
        FROM cells p JOIN cells q ON p.f = '{f}' AND q.f = '{f}'"""
        for f in ("quantity", "discount")
    )
    tax_cells = " UNION ALL ".join(
        f"SELECT '{f}' AS f, {f} AS x, tax AS y, count(*)::DOUBLE AS n FROM line GROUP BY {f}, tax" for f in ("quantity", "discount")
    )
    sql["top_correlations_kendall_numeric_target"] = (
        f"WITH {LINE}, cells AS ({tax_cells}) SELECT feature, {rnd('r', 9)} AS r FROM ({by_cells})"
    )
    tied = ["quantity", "discount", "tax"]
    for method, columns in (("spearman", FEATURES), ("kendall", tied)):
        sql[f"corr_{method}_per_class"] = f"""WITH {LINE} SELECT class AS y, col_a, col_b, n, {rnd("r", 9)} AS r
  FROM ({class_pairs("line", columns, method)})"""
    sql["corr_kendall_nulls"] = f"""WITH {DIRT}, {NULLED} SELECT col_a, col_b, n, {rnd("r", 9)} AS r
  FROM ({class_pairs("nulled", tied, "kendall", "1")})"""
    holed = ", ".join(
        f"CASE WHEN vec_id % {7 + i % 6} <> 0 THEN {f} END AS {f}" if i % 6 < 5 else f for i, f in enumerate(VECTOR_FEATURES)
    )
    sql["corr_spearman_vectors_nulls"] = f"""WITH {VECS}, holed AS (SELECT vec_id, {holed} FROM vecs),
  {long("holed", VECTOR_FEATURES, keep="vec_id")},
  named AS (SELECT vec_id, feature, CAST(split_part(feature, '_', 2) AS INTEGER) AS i, value FROM long),
  joint AS (SELECT a.feature AS col_a, b.feature AS col_b, a.value AS va, b.value AS vb
    FROM named a JOIN named b ON a.vec_id = b.vec_id AND a.i < b.i),
  ranked AS (SELECT col_a, col_b,
    rank() OVER (PARTITION BY col_a, col_b ORDER BY va) + (count(*) OVER (PARTITION BY col_a, col_b, va) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (PARTITION BY col_a, col_b ORDER BY vb) + (count(*) OVER (PARTITION BY col_a, col_b, vb) - 1) / 2.0::DOUBLE AS rb
    FROM joint)
  SELECT col_a, col_b, count(*) AS n, {rnd("corr(ra, rb)", 9)} AS r FROM ranked GROUP BY col_a, col_b"""
    firsts = ", ".join(f"'{f}'" for f in VECTOR_FEATURES[:5])
    sql["top_correlations_per_class"] = f"""SELECT class, unnest([{firsts}]) AS feature, CAST(NULL AS DOUBLE) AS r
  FROM (SELECT DISTINCT CAST(label % 2 AS INTEGER) AS class FROM embeddings)"""
    for method in ("pearson", "spearman", "kendall"):
        features = ["quantity", "discount"] if method == "kendall" else ["quantity", "price", "discount"]
        for name, matrix in (("top_correlations", False), ("correlation_submatrix", True)):
            sql[f"{name}_by_class_{method}"] = by_class(features, method, "tax", 2, matrix)
        columns = tied[:2] if method == "kendall" else FEATURES[:3]
        itself = ", ".join(f"('{c}', 1.0)" for c in columns) + f", ('y', {'1.0' if method == 'kendall' else 'NULL'})"
        empty = " UNION ALL ".join(f"SELECT class, '{c}' AS col_a, 'y' AS col_b, NULL AS r FROM classes" for c in columns)
        sql[f"correlation_submatrix_per_class_{method}"] = f"""WITH {LINE}, classes AS (SELECT DISTINCT y AS class FROM line),
  prs AS (SELECT class, col_a, col_b, r FROM ({class_pairs("line", columns, method)}) UNION ALL {empty})
  SELECT class, col_a, col_b, {rnd("CAST(r AS DOUBLE)", 9)} AS r FROM (SELECT * FROM prs UNION ALL SELECT class, col_b, col_a, r FROM prs
    UNION ALL SELECT class, c, c, v FROM classes, (VALUES {itself}) t(c, v))"""
    sql["feature_auc_three_class"] = """SELECT feature, CAST(NULL AS DOUBLE) AS auc
  FROM (SELECT unnest(['tax', 'discount']) AS feature, count(DISTINCT l_returnflag) AS n FROM lineitem) WHERE n = 3"""
    sql["effect_size_dirty"] = f"""WITH {DIRT}, {dirty}, {dirty_feats}, m AS (
    SELECT feature, avg(value) FILTER (y = 0) AS m0, avg(value) FILTER (y = 1) AS m1,
      var_samp(value) FILTER (y = 0) AS v0, var_samp(value) FILTER (y = 1) AS v1 FROM long GROUP BY feature)
  SELECT feature, {rnd("CASE WHEN v0 + v1 > 0 THEN (m0 - m1) / sqrt((v0 + v1) / 2) END", 9)} AS effect_size
  FROM feats LEFT JOIN m USING (feature)"""
    sql["top_correlations_kendall"] = f"""WITH {VECS}, {vec_long}, {rank_stats()}, found AS (SELECT feature, {tau} AS r FROM st)
  SELECT feature, {rnd("r", 9)} AS r FROM found ORDER BY abs(r) DESC, feature LIMIT 10"""
    sql["correlation_submatrix"] = submatrix()
    sql["target_distribution"] = f"""WITH {LINE}, c AS (SELECT y AS value, CAST(count(*) AS DOUBLE) AS c FROM line GROUP BY y),
  t AS (SELECT *, sum(c) OVER () AS n FROM c)
  SELECT CASE WHEN value = 0 THEN 'Background' ELSE 'Signal' END AS label, value, CAST(c AS BIGINT) AS n,
  {rnd("c / n")} AS share, {rnd("sqrt(n * (c / n) * (1 - c / n))")} AS error FROM t"""
    sql["target_distribution_percent"] = f"""WITH {LINE}, c AS (SELECT y AS value, CAST(count(*) AS DOUBLE) AS c FROM line GROUP BY y),
  t AS (SELECT *, sum(c) OVER () AS n FROM c)
  SELECT CASE WHEN value = 0 THEN 'Background' ELSE 'Signal' END AS label, value, CAST(c AS BIGINT) AS n,
  {rnd("c / n", 9)} AS share, {rnd("sqrt((c / n) * (1 - c / n) / n)", 9)} AS error FROM t"""
    ev_long = long("ev", ["value_", "shifted"]).replace("SELECT y, feature, value FROM", "SELECT y, rtrim(feature, '_') AS feature, value FROM")
    sql["summary_csv_roundtrip"] = f"""WITH {ev}, {ev_long}, {rank_stats()}, {moments()}, {histogram("long", "feature, y")}, {JSD}
  SELECT feature, {rnd("auc", 8)} AS auc, {rnd(COHEN, 8)} AS effect_size, {rnd("p_ks", 8)} AS p_value,
  {STARS.format(p="p_ks")} AS stars, {rnd("js_divergence", 8)} AS js_divergence
  FROM ksp JOIN mo USING (feature) JOIN jsd USING (feature)"""
    # eigenvalues of a symmetric 3 x 3 matrix with unit diagonal, by the trigonometric formula
    sql["pca_explained_variance_items"] = f"""WITH {LINE},
  c AS (SELECT corr(quantity, price) AS a, corr(quantity, discount) AS b, corr(price, discount) AS d FROM line),
  p AS (SELECT *, sqrt((a * a + b * b + d * d) / 3) AS p FROM c),
  f AS (SELECT p, acos(least(greatest(a * b * d / (p * p * p), -1.0), 1.0)) / 3 AS phi FROM p),
  e AS (SELECT unnest([1, 2, 3]) AS component,
    unnest([1 + 2 * p * cos(phi), 1 + 2 * p * cos(phi - 2 * pi() / 3), 1 + 2 * p * cos(phi + 2 * pi() / 3)]) / 3 AS ratio FROM f)
  SELECT CAST(component AS INTEGER) AS component, {rnd("ratio")} AS ratio,
  {rnd("sum(ratio) OVER (ORDER BY component)")} AS cumulative FROM e"""
    sql["knn_graph"] = f"""WITH {VECS}, {fitted("vecs", VECTOR_FEATURES)},
  zs AS MATERIALIZED (SELECT vec_id, [{", ".join(f"(s.{c} - (SELECT center FROM fit WHERE feature = '{c}')) / (SELECT scale FROM fit WHERE feature = '{c}')" for c in VECTOR_FEATURES)}] AS v FROM vecs s),
  ds AS (SELECT a.vec_id, b.vec_id AS nbr, list_distance(a.v, b.v) AS dist FROM zs a JOIN zs b ON a.vec_id <> b.vec_id),
  rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY dist, nbr) AS INTEGER) AS rank FROM ds)
  SELECT vec_id, nbr, {rnd("dist")} AS dist, rank FROM rk WHERE rank <= 15"""
    return sql
