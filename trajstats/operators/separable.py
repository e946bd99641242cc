"""Least squares for models that are linear in some parameters once the others are held fixed, for many groups at once.

A grid lists values of the nonlinear parameters. For each group and grid point one aggregation sums the normal equations of the
linear ones, which are solved in closed form; the best point starts a finer grid. Gauss-Newton steps over all parameters follow,
each again one aggregation, so that the answer doesn't depend on the grid. Built-in expressions only: a group may have any
number of rows, and no group passes through one Python call.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from trajstats.session import cut_lineage, group_side


@dataclass(frozen=True)
class Model:
    """y = sum of linear * basis. Texts are SQL over x, parameters and ``steps``, which name intermediate values."""

    linear: tuple[str, ...]
    nonlinear: tuple[str, ...]
    basis: tuple[str, ...]
    slopes: tuple[str, ...]  # by each nonlinear parameter
    steps: tuple[tuple[str, str], ...]
    log_scale: tuple[bool, ...]
    points: int
    levels: int

    @property
    def names(self) -> tuple[str, ...]:
        return self.linear + self.nonlinear


# Rational form of the error function, fractional error of the complement below 1.2e-7 (fixed values).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _erfc_exponent(t: str) -> str:
    out = f"({_ERFC[-1]!r}E0)"
    for c in reversed(_ERFC[:-1]):
        out = f"(({c!r}E0) + {t} * {out})"
    return out


#: B - A erf((x - R) / (sqrt(2) W)).
INTERFACE = Model(
    ("b", "a"), ("r_fit", "w_fit"), ("1.0E0", "-_f"),
    ("a * 1.1283791670955126E0 * _g / (1.4142135623730951E0 * w_fit)", "a * 1.1283791670955126E0 * _g * _u / w_fit"),
    (("_u", "(x - r_fit) / (1.4142135623730951E0 * w_fit)"), ("_t", "1.0E0 / (1.0E0 + 0.5E0 * abs(_u))"), ("_g", "exp(-_u * _u)"), ("_f", f"sign(_u) * (1.0E0 - _t * exp(-_u * _u + {_erfc_exponent('_t')}))")),
    (False, True), 21, 4,
)

#: L2 (1 - exp(-x / tau)).
CONFINED = Model(("l2",), ("tau",), ("1.0E0 - _e",), ("-l2 * x / (tau * tau) * _e",), (("_e", "exp(-x / tau)"),), (True,), 65, 3)


def grid_values(model: Model) -> list[str]:
    """Texts of the nonlinear parameters at grid point ``_g0`` (numbered over all of them)."""
    out, stride = [], 1
    for name, log in zip(model.nonlinear, model.log_scale):
        at = f"_lo_{name} + _step_{name} * (floor(_g0 / {stride}.0E0) % {model.points})"
        out.append(f"exp({at})" if log else at)
        stride *= model.points
    return out


def linear_solution(model: Model) -> list[list[tuple[str, str]]]:
    """Stages of named texts: the linear parameters from sums m11.. and v1.., none below 0 where ``_positive``, and the squared error."""
    if len(model.linear) == 1:
        name = model.linear[0]
        top = "CASE WHEN _positive THEN greatest(v1 / nullif(m11, 0), 0.0E0) ELSE v1 / nullif(m11, 0) END"
        return [[(name, top)], [("sse", f"greatest(yy - 2 * {name} * v1 + {name} * {name} * m11, 0.0E0)")]]
    p, q = model.linear
    det = "nullif(m11 * m22 - m12 * m12, 0)"
    return [
        [("_p", f"(v1 * m22 - m12 * v2) / {det}"), ("_q", f"(m11 * v2 - m12 * v1) / {det}")],
        [(p, "CASE WHEN NOT _positive OR (_p >= 0 AND _q >= 0) THEN _p WHEN _q < 0 THEN greatest(v1 / nullif(m11, 0), 0.0E0) ELSE 0.0E0 END"), (q, "CASE WHEN NOT _positive OR (_p >= 0 AND _q >= 0) THEN _q WHEN _q < 0 THEN 0.0E0 ELSE greatest(v2 / nullif(m22, 0), 0.0E0) END")],
        [("sse", f"greatest(yy - 2 * ({p} * v1 + {q} * v2) + {p} * {p} * m11 + 2 * {p} * {q} * m12 + {q} * {q} * m22, 0.0E0)")],
    ]


def linear_sums(model: Model) -> list[tuple[str, str]]:
    b = model.basis
    out = [(f"m{i + 1}{j + 1}", f"sum(w * ({b[i]}) * ({b[j]}))") for i in range(len(b)) for j in range(i, len(b))]
    return out + [(f"v{i + 1}", f"sum(w * y * ({b[i]}))") for i in range(len(b))] + [("yy", "sum(w * y * y)")]


def normal_sums(model: Model) -> list[tuple[str, str]]:
    """Sums of the Gauss-Newton equations over all parameters, and the squared error."""
    g = [f"({c})" for c in (*model.basis, *model.slopes)]
    r = "(y - (" + " + ".join(f"{n} * ({b})" for n, b in zip(model.linear, model.basis)) + "))"
    out = [(f"h{i}{j}", f"sum(w * {g[i]} * {g[j]})") for i in range(len(g)) for j in range(i, len(g))]
    return out + [(f"z{i}", f"sum(w * {r} * {g[i]})") for i in range(len(g))] + [("sse", f"sum(w * {r} * {r})"), ("plain", f"sum({r} * {r})"), ("n", "count(*)")]


def normal_solution(size: int) -> list[list[tuple[str, str]]]:
    """Stages that factor h = L D L', solve it for z (``s0``..), and invert it (``c00``.. of the upper triangle)."""
    h = lambda i, j: f"h{min(i, j)}{max(i, j)}"
    stages: list[list[tuple[str, str]]] = []
    for j in range(size):
        inner = "".join(f" - l{j}_{k} * l{j}_{k} * d{k}" for k in range(j))
        stages.append([(f"d{j}", f"nullif(greatest({h(j, j)}{inner}, 1.0E-13 * {h(j, j)}), 0)")])
        low = [(f"l{i}_{j}", f"({h(i, j)}{''.join(f' - l{i}_{k} * l{j}_{k} * d{k}' for k in range(j))}) / d{j}") for i in range(j + 1, size)]
        stages += [low] if low else []
    # Columns of the inverse of L, then the inverse of h and its product with z.
    for i in range(size):
        stages.append([(f"i{i}_{j}", "1.0E0" if i == j else "-(" + " + ".join(f"l{i}_{k} * i{k}_{j}" for k in range(j, i)) + ")") for j in range(i + 1)])
    stages.append([(f"c{i}{j}", " + ".join(f"i{k}_{i} * i{k}_{j} / d{k}" for k in range(j, size))) for i in range(size) for j in range(i, size)])
    stages.append([(f"s{i}", " + ".join(f"c{min(i, j)}{max(i, j)} * z{j}" for j in range(size))) for i in range(size)])
    return stages


def _staged(df: DataFrame, stages: Sequence[Sequence[tuple[str, str]]]) -> DataFrame:
    for stage in stages:
        df = df.withColumns({name: F.expr(text) for name, text in stage})
    return df


def _aggregated(df: DataFrame, keys: Sequence[str], sums: Sequence[tuple[str, str]]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(text).alias(name) for name, text in sums])


def separable_fit(rows: DataFrame, keys: Sequence[str], model: Model, domain: DataFrame, *, rounds: int = 6) -> DataFrame:
    """(keys, parameters, sse, plain, n, c00.. of the inverse normal matrix over linear, then nonlinear parameters).

    ``rows``: keys, x, y, w. ``domain``: keys, ``_positive`` (linear parameters not below 0) and for each nonlinear parameter
    ``_lo_`` and ``_hi_`` (of its logarithm where the model says so). ``plain`` is the squared error without weights.
    """
    keys, names = list(keys), model.names
    points = model.points ** len(model.nonlinear)
    rows = cut_lineage(rows.select(*keys, "x", "y", "w"))
    area = domain.select(*keys, "_positive", *[c for n in model.nonlinear for c in (f"_lo_{n}", f"_hi_{n}")])
    area = cut_lineage(area.withColumns({f"_step_{n}": (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) / (model.points - 1) for n in model.nonlinear} | {f"_{e}0_{n}": F.col(f"_{e}_{n}") for e in ("lo", "hi") for n in model.nonlinear}))
    best = None
    for level in range(model.levels):
        grid = rows.join(group_side(area), keys).withColumn("_g0", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        grid = grid.withColumns({n: F.expr(text) for n, text in zip(model.nonlinear, grid_values(model))})
        grid = _staged(grid, [[s] for s in model.steps])
        found = _aggregated(grid, [*keys, "_g0", "_positive", *model.nonlinear], linear_sums(model))
        found = _staged(found, linear_solution(model)).filter("sse IS NOT NULL")
        best = found.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("sse", "_g0")).alias("f")).select(*keys, *[F.col(f"f.{n}").alias(n) for n in names])
        if level < model.levels - 1:
            centre = {n: F.log(n) if log else F.col(n) for n, log in zip(model.nonlinear, model.log_scale)}
            moved = {}
            for n in model.nonlinear:
                moved[f"_lo_{n}"] = F.greatest(centre[n] - F.col(f"_step_{n}"), F.col(f"_lo0_{n}"))
                moved[f"_hi_{n}"] = F.least(centre[n] + F.col(f"_step_{n}"), F.col(f"_hi0_{n}"))
            best = cut_lineage(best)
            area = area.drop(*moved).join(group_side(best), keys).withColumns(moved).drop(*names)
            area = cut_lineage(area.withColumns({f"_step_{n}": (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) / (model.points - 1) for n in model.nonlinear}))
    bounds = [f"_{e}0_{n}" for n in model.nonlinear for e in ("lo", "hi")]
    at = cut_lineage(best.join(group_side(area.select(*keys, "_positive", *bounds)), keys))
    size, kept = len(names), None
    inverse = [f"c{i}{j}" for i in range(size) for j in range(i, size)]
    for _ in range(rounds):
        here = _aggregated(_staged(rows.join(group_side(at), keys), [[s] for s in model.steps]), [*keys, "_positive", *bounds, *names], normal_sums(model))
        here = cut_lineage(_staged(here, normal_solution(size)).select(*keys, "_positive", *bounds, *names, "sse", "plain", "n", *inverse, *[f"s{i}" for i in range(size)]))
        kept = here if kept is None else kept.unionByName(here)
        at = here.select(*keys, "_positive", *bounds, *[F.expr(f"CASE WHEN {_stays(model)} THEN {text} ELSE {n} END").alias(n) for n, text in _moved(model).items()])
    last = F.min_by(F.struct(*names, "sse", "plain", "n", *inverse), "sse").alias("f")
    return kept.groupBy(*keys).agg(last).select(*keys, "f.*")


def _moved(model: Model) -> dict[str, str]:
    return {n: f"({n} + coalesce(s{i}, 0.0E0))" for i, n in enumerate(model.names)}


def _stays(model: Model) -> str:
    """A step that leaves the grid's area is not taken."""
    to = _moved(model)
    inside = [f"({to[n]} > 0 AND ln(greatest({to[n]}, 1.0E-300)) BETWEEN _lo0_{n} AND _hi0_{n})" if log else f"({to[n]} BETWEEN _lo0_{n} AND _hi0_{n})" for n, log in zip(model.nonlinear, model.log_scale)]
    return " AND ".join([*inside, *[f"(NOT _positive OR {to[n]} >= 0)" for n in model.linear]])


def separable_sql(rows: str, domain: str, keys: str, model: Model, tag: str, rounds: int = 6) -> str:
    """The same as CTEs over the CTEs ``rows`` and ``domain``; the result is ``{tag}fit``."""
    names, k = ", ".join(model.names), keys
    stage = lambda src, texts: f"(SELECT *, {', '.join(f'{t} AS {n}' for n, t in texts)} FROM {src})"
    same = lambda a, b: " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in k.split(","))
    steps = ", ".join(f"(_hi_{n} - _lo_{n}) / {model.points - 1} AS _step_{n}" for n in model.nonlinear)
    ends = ", ".join(f"_lo_{n} AS _lo0_{n}, _hi_{n} AS _hi0_{n}" for n in model.nonlinear)
    out = [f"{tag}a0 AS MATERIALIZED (SELECT *, {steps}, {ends} FROM {domain})"]
    for level in range(model.levels):
        src = f"(SELECT r.*, a.* EXCLUDE ({k}), g._g0 FROM {rows} r JOIN {tag}a{level} a ON {same('r', 'a')}, range({model.points ** len(model.nonlinear)}) g(_g0))"
        src = stage(src, list(zip(model.nonlinear, grid_values(model))))
        for s in model.steps:
            src = stage(src, [s])
        src = f"(SELECT {k}, _g0, _positive, {', '.join(model.nonlinear)}, {', '.join(f'{t} AS {n}' for n, t in linear_sums(model))} FROM {src} GROUP BY ALL)"
        for s in linear_solution(model):
            src = stage(src, s)
        out.append(f"{tag}b{level} AS MATERIALIZED (SELECT {k}, {names} FROM {src} WHERE sse IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY sse, _g0) = 1)")
        if level < model.levels - 1:
            centre = {n: f"ln({n})" if log else n for n, log in zip(model.nonlinear, model.log_scale)}
            moved = ", ".join(f"greatest({centre[n]} - _step_{n}, _lo0_{n}) AS _lo_{n}, least({centre[n]} + _step_{n}, _hi0_{n}) AS _hi_{n}" for n in model.nonlinear)
            fixed = ", ".join(f"_lo0_{n}, _hi0_{n}" for n in model.nonlinear)
            out.append(f"{tag}a{level + 1} AS MATERIALIZED (SELECT *, {steps} FROM (SELECT {', '.join('a.' + c.strip() for c in k.split(','))}, _positive, {fixed}, {moved} FROM {tag}a{level} a JOIN {tag}b{level} b ON {same('a', 'b')}))")
    size = len(model.names)
    inverse = ", ".join(f"c{i}{j}" for i in range(size) for j in range(i, size))
    bounds = ", ".join(f"_lo0_{n}, _hi0_{n}" for n in model.nonlinear)
    at = f"(SELECT b.*, _positive, {bounds} FROM {tag}b{model.levels - 1} b JOIN {tag}a0 a ON {same('a', 'b')})"
    for step in range(rounds):
        src = f"(SELECT r.*, p.* EXCLUDE ({k}) FROM {rows} r JOIN {at} p ON {same('r', 'p')})"
        for s in model.steps:
            src = stage(src, [s])
        src = f"(SELECT {k}, _positive, {bounds}, {names}, {', '.join(f'{t} AS {n}' for n, t in normal_sums(model))} FROM {src} GROUP BY ALL)"
        for s in normal_solution(size):
            src = stage(src, s)
        out.append(f"{tag}n{step} AS MATERIALIZED (SELECT {k}, _positive, {bounds}, {names}, sse, plain, n, {inverse}, {', '.join(f's{i}' for i in range(size))} FROM {src})")
        at = f"(SELECT {k}, _positive, {bounds}, {', '.join(f'CASE WHEN {_stays(model)} THEN {t} ELSE {n} END AS {n}' for n, t in _moved(model).items())} FROM {tag}n{step})"
    every = " UNION ALL ".join(f"SELECT * FROM {tag}n{i}" for i in range(rounds))
    out.append(f"{tag}fit AS (SELECT * FROM ({every}) QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY sse) = 1)")
    return ",\n".join(out)
