"""Building blocks of the same queries in DuckDB's SQL."""

from __future__ import annotations

BARS = """
t AS (
  SELECT l_returnflag AS instrument, CAST(l_shipdate AS DATE) AS date, CAST(round(l_discount * 100) AS INTEGER) - 5 AS shock, l_orderkey, l_quantity,
         sum(CAST(round(l_discount * 100) AS INTEGER) - 5) OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE)
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING) AS run
  FROM lineitem
), d AS (
  SELECT instrument, date, count(*) AS n, CAST(sum(shock) AS BIGINT) AS s, least(0, min(run)) AS lo, greatest(0, max(run)) AS hi,
         sum(l_quantity) AS volume, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS open_interest FROM t GROUP BY instrument, date
), e AS (
  SELECT *, coalesce(sum(CAST(0.01 AS DOUBLE) * s / sqrt(CAST(n AS DOUBLE))) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS base FROM d
), bars AS (
  SELECT date, instrument, round(100 * exp(base), 4) AS open,
         round(100 * exp(base + CAST(0.01 AS DOUBLE) * hi / sqrt(CAST(n AS DOUBLE))), 4) AS high,
         round(100 * exp(base + CAST(0.01 AS DOUBLE) * lo / sqrt(CAST(n AS DOUBLE))), 4) AS low,
         round(100 * exp(base + CAST(0.01 AS DOUBLE) * s / sqrt(CAST(n AS DOUBLE))), 4) AS close, volume, open_interest FROM e
)"""

W = "PARTITION BY instrument ORDER BY date"


def frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def agg(f: str, x: str, n: int, least: int | None = None) -> str:
    """An aggregate over n rows, null until ``least`` (else n) of them are not null."""
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {least or n} THEN {f}({x}) OVER {frame(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({W})"


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def zscore(x: str, n: int) -> str:
    return div(f"{x} - {agg('avg', x, n)}", agg("stddev_samp", x, n))


#: Bars with the helper columns of the technical features.
PREPARED = (
    BARS
    + f""", p0 AS (
  SELECT *, {lag("close")} AS prev, (high + low + close) / 3 AS tp FROM bars
), p AS (
  SELECT *, ln(close / nullif(prev, 0)) AS lr, CASE WHEN prev IS NOT NULL THEN greatest(close - prev, 0.0) END AS gain,
         CASE WHEN prev IS NOT NULL THEN greatest(prev - close, 0.0) END AS loss, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
         CASE WHEN tp > {lag("tp")} THEN tp * volume ELSE 0.0 END AS pos, CASE WHEN tp < {lag("tp")} THEN tp * volume ELSE 0.0 END AS neg,
         close - least(low, prev) AS bp, greatest(high, prev) - least(low, prev) AS utr, pow(ln(high / low), 2) AS hl2,
         0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS gk,
         row_number() OVER ({W}) AS rn FROM p0
)"""
)


def ewm_means(source: str, name: str, cols: dict[str, tuple[str, float, int]]) -> str:
    """A recursive CTE ``name`` (instrument, rn, columns): means that aren't adjusted. cols: output -> (input, alpha, least count).

    Inputs may begin with nulls; the first value seeds the recursion.
    """
    first = ", ".join(f"CAST({x} AS DOUBLE) AS {o}, CASE WHEN {x} IS NULL THEN 0 ELSE 1 END AS k_{o}" for o, (x, _, _) in cols.items())
    step = ", ".join(f"CASE WHEN r.{o} IS NULL THEN s.{x} ELSE {1 - a!r} * r.{o} + {a!r} * s.{x} END, r.k_{o} + CASE WHEN s.{x} IS NULL THEN 0 ELSE 1 END" for o, (x, a, _) in cols.items())
    out = ", ".join(f"CASE WHEN k_{o} >= {least} THEN {o} END AS {o}" for o, (_, _, least) in cols.items())
    return f"""{name}_r AS (
  SELECT instrument, rn, {first} FROM {source} WHERE rn = 1
  UNION ALL
  SELECT s.instrument, s.rn, {step} FROM {name}_r r JOIN {source} s ON s.instrument = r.instrument AND s.rn = r.rn + 1
), {name} AS (SELECT instrument, rn, {out} FROM {name}_r)"""


def ewm_stds(source: str, name: str, x: str, cols: dict[str, tuple[float, int, bool]]) -> str:
    """A recursive CTE of unbiased deviations of ``x``. cols: output -> (alpha, least count, adjusted)."""
    first, step, out = [], [], []
    for o, (a, least, adjust) in cols.items():
        f, new = 1 - a, 1.0 if adjust else a
        first.append(f"CAST({x} AS DOUBLE) AS m_{o}, 0.0::DOUBLE AS c_{o}, 1.0::DOUBLE AS w_{o}, 1.0::DOUBLE AS v_{o}, 1.0::DOUBLE AS o_{o}, CASE WHEN {x} IS NULL THEN 0 ELSE 1 END AS k_{o}")
        # o: weight of what came before; w, v: sums of weights and of their squares
        ow = f"(r.o_{o} * {f!r})"
        mean = f"(({ow} * r.m_{o} + {new!r} * s.{x}) / ({ow} + {new!r}))"
        cov = f"(({ow} * (r.c_{o} + pow(r.m_{o} - {mean}, 2)) + {new!r} * pow(s.{x} - {mean}, 2)) / ({ow} + {new!r}))"
        scale = "1.0" if adjust else f"({ow} + {new!r})"
        none = f"r.m_{o} IS NULL"
        step.append(
            f"CASE WHEN {none} THEN s.{x} ELSE {mean} END, CASE WHEN {none} THEN 0.0 ELSE {cov} END, CASE WHEN {none} THEN 1.0 ELSE (r.w_{o} * {f!r} + {new!r}) / {scale} END, "
            f"CASE WHEN {none} THEN 1.0 ELSE (r.v_{o} * {f * f!r} + {new * new!r}) / ({scale} * {scale}) END, CASE WHEN {none} THEN 1.0 ELSE {f'{ow} + {new!r}' if adjust else '1.0'} END, "
            f"r.k_{o} + CASE WHEN s.{x} IS NULL THEN 0 ELSE 1 END"
        )
        out.append(f"CASE WHEN k_{o} >= {max(least, 2)} THEN sqrt(c_{o} * w_{o} * w_{o} / nullif(w_{o} * w_{o} - v_{o}, 0)) END AS {o}")
    return f"""{name}_r AS (
  SELECT instrument, rn, {", ".join(first)} FROM {source} WHERE rn = 1
  UNION ALL
  SELECT s.instrument, s.rn, {", ".join(step)} FROM {name}_r r JOIN {source} s ON s.instrument = r.instrument AND s.rn = r.rn + 1
), {name} AS (SELECT instrument, rn, {", ".join(out)} FROM {name}_r)"""


def rounded(cols, digits: int = 6) -> str:
    return ", ".join(f"round({x}, {digits}) AS {x}" for x in cols)


def select(cte: str, source: str, cols: dict[str, str], keys: str = "date, instrument", digits: int = 6) -> str:
    """WITH cte SELECT keys and rounded columns."""
    return f"WITH RECURSIVE {cte} SELECT {keys}, " + ", ".join(f"round(CAST({v} AS DOUBLE), {digits}) + 0.0 AS {k}" for k, v in cols.items()) + f" FROM {source}"
