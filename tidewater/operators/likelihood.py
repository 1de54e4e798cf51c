"""Seasonal ARIMA models by exact maximum likelihood (T6-T8), for any number of series of any length.

The likelihood comes from the Kalman filter of the state-space form. Its gains
follow from the parameters alone, and its state is linear in the state before.
So a block of a series is summed up, without knowing what comes before it, by
the map from the state at its start to the state at its end and by the scaled
cross products of the prediction errors as functions of that state. Blocks are
composed in order, up to 256 by one task and over several levels, which gives the
likelihood of the whole series: no task holds a long series, and nothing is
approximated.

All models (series x order) move together. A pass evaluates each model at a
stencil of points around its centre, which gives gradient and Hessian by central
differences; a damped Newton step follows, and models leave once the step
promises no gain. A first pass chooses the start from a fixed grid. The mean
(models without differencing have one) and the variance are solved for in closed form.
Partial autocorrelations are ``EDGE`` times a sine, which keeps models stationary and
invertible and makes a maximum at the edge an ordinary one. Standard errors come from the
Hessian by the delta method; parts at the edge have none. States are written and read
again after each pass (a checkpoint would keep size estimates that grow with every pass).

Input carries ``_pos``. Null and non-finite values are left out before differencing, and
the values around them become neighbours. Ties of ``_pos`` are ordered arbitrarily.
A series with fewer values than parameters + 2, or without variance, gets its model row with
a status and nulls and has neither coefficients nor forecasts; one without a value after
differencing has no row. An empty table gives empty results.
Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.arima import difference, difference_polynomial
from tidewater.plans.ordered import POS, add_positions
from tidewater.session import staged

EDGE = 0.999      # largest partial autocorrelation
BLOCK = 16_384    # values in a row of the block table
FAN = 256         # block sums composed by one task
STEP = 1e-3       # distance of the stencil's points
MAX_PASSES = 40
Z95 = 1.959963984540054
ORDER_COLS = [("p", "p"), ("d", "d"), ("q", "q"), ("P", "seasonal_p"), ("D", "seasonal_d"), ("Q", "seasonal_q"), ("s", "period")]


@dataclass(frozen=True)
class Order:
    """ARIMA(p, d, q)(P, D, Q) with period s."""

    p: int = 1
    d: int = 0
    q: int = 0
    P: int = 0
    D: int = 0
    Q: int = 0
    s: int = 0

    @property
    def parts(self) -> tuple[int, int, int, int]:
        return self.p, self.q, self.P, self.Q

    @property
    def n_coef(self) -> int:
        return sum(self.parts)

    @property
    def states(self) -> int:
        return max(self.p + self.s * self.P, self.q + self.s * self.Q + 1)

    @property
    def has_mean(self) -> bool:
        return self.d + self.D == 0

    @property
    def n_params(self) -> int:
        return self.n_coef + 1 + self.has_mean

    @property
    def terms(self) -> list[str]:
        return [*[f"ar.L{i + 1}" for i in range(self.p)], *[f"ma.L{i + 1}" for i in range(self.q)],
                *[f"ar.S.L{self.s * (i + 1)}" for i in range(self.P)], *[f"ma.S.L{self.s * (i + 1)}" for i in range(self.Q)]]


# --- parameters ---------------------------------------------------------------------

def _from_partial(u: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression, by the Levinson recursion over partial autocorrelations."""
    coef = np.zeros(0)
    for r in EDGE * np.sin(u):
        coef = np.append(coef - r * coef[::-1], r)
    return coef


def coefficients(u: np.ndarray, order: Order) -> np.ndarray:
    """AR, MA, seasonal AR and seasonal MA coefficients of a point of the free space."""
    ar, ma, sar, sma = np.split(u, np.cumsum(order.parts)[:-1])
    return np.concatenate([_from_partial(ar), -_from_partial(ma), _from_partial(sar), -_from_partial(sma)])


def _polynomials(u: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """Lag coefficients of the multiplied AR and MA polynomials, padded to the number of states."""
    ar, ma, sar, sma = np.split(coefficients(u, order), np.cumsum(order.parts)[:-1])

    def whole(plain: np.ndarray, seasonal: np.ndarray, sign: float) -> np.ndarray:
        season = np.zeros(order.s * len(seasonal) + 1)
        season[0] = 1.0
        if len(seasonal):
            season[order.s::order.s] = sign * seasonal
        full = sign * np.convolve(np.concatenate([[1.0], sign * plain]), season)[1:]
        return np.pad(full, (0, order.states - len(full)))
    return whole(ar, sar, -1.0), whole(ma, sma, 1.0)


def _system(u: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """Transition matrix and the loading of the innovation."""
    ar, ma = _polynomials(u, order)
    move = np.eye(order.states, k=1)
    move[:, 0] += ar
    return move, np.concatenate([[1.0], ma[:order.states - 1]])


def _gains(points: np.ndarray, order: Order, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gains (t, point, state) and error variances (t, point) until they stand still or ``length``
    is reached, the transition matrices, and the last state covariances. The variance of innovations is 1."""
    systems = [_system(u, order) for u in points]
    move = np.stack([m for m, _ in systems])
    load = np.stack([v for _, v in systems])
    noise = load[:, :, None] * load[:, None, :]
    cov, power = noise, move
    for _ in range(40):  # stationary covariance by doubling
        cov = cov + power @ cov @ power.transpose(0, 2, 1)
        power = power @ power
        if np.abs(power).max() < 1e-18:
            break
    gains, variances = [], []
    for _ in range(max(length, 1)):
        var = cov[:, 0, 0]
        gain = (move @ cov[:, :, :1])[:, :, 0] / var[:, None]
        gains.append(gain)
        variances.append(var)
        after = move @ cov @ move.transpose(0, 2, 1) - gain[:, :, None] * gain[:, None, :] * var[:, None, None] + noise
        still = np.abs(after - cov).max() <= 1e-14 * np.abs(cov).max()
        cov = after
        if still:
            break
    return np.stack(gains), np.stack(variances), move, cov


# --- block sums ---------------------------------------------------------------------

@dataclass
class Sums:
    """What a run of values adds: end state = ``shift`` + ``carry`` x start state, cross products of
    the errors' coefficients (of the value, of the mean, of the start state), log variances and the count.
    All have one entry for each point."""

    carry: np.ndarray
    shift: np.ndarray
    cross: np.ndarray
    logs: np.ndarray
    count: int

    def then(self, later: Sums) -> Sums:
        n_points, r, c = self.shift.shape
        seen = np.zeros((n_points, c + r, c + r))
        seen[:, :c, :c] = np.eye(c)
        seen[:, c:, :c] = self.shift
        seen[:, c:, c:] = self.carry
        return Sums(later.carry @ self.carry, later.shift + later.carry @ self.shift,
                    self.cross + seen.transpose(0, 2, 1) @ later.cross @ seen,
                    self.logs + later.logs, self.count + later.count)

    def pack(self) -> np.ndarray:
        return np.concatenate([self.carry.ravel(), self.shift.ravel(), self.cross.ravel(), self.logs, [self.count]])

    @classmethod
    def unpack(cls, flat: np.ndarray, order: Order) -> Sums:
        r, c = order.states, 1 + order.has_mean
        n_points = (len(flat) - 1) // (r * r + r * c + (c + r) ** 2 + 1)
        cuts = np.cumsum([n_points * r * r, n_points * r * c, n_points * (c + r) ** 2, n_points])
        carry, shift, cross, logs, count = np.split(flat, cuts)
        return cls(carry.reshape(n_points, r, r), shift.reshape(n_points, r, c),
                   cross.reshape(n_points, c + r, c + r), logs, int(count[0]))


def _runs(values: np.ndarray, starts: np.ndarray, gains: np.ndarray, variances: np.ndarray, ar: np.ndarray,
          order: Order) -> list[Sums]:
    """Sums of runs of equal length (run, t), which start at ``starts``; all runs and points go side by side."""
    n_runs, length = values.shape
    r, c, n_points = order.states, 1 + order.has_mean, ar.shape[0]
    state = np.zeros((n_runs, n_points, r, c + r))
    state[..., c:] = np.eye(r)
    cross = np.zeros((n_runs, n_points, c + r, c + r))
    logs = np.zeros((n_runs, n_points))
    for t in range(length):
        at = np.minimum(starts + t, len(gains) - 1)
        error = -state[:, :, 0, :]
        error[..., 0] += values[:, t, None]
        if order.has_mean:
            error[..., 1] += 1.0
        var = variances[at]
        cross += error[..., :, None] * (error / var[..., None])[..., None, :]
        logs += np.log(var)
        after = ar[None, :, :, None] * state[:, :, :1, :]
        after[:, :, :-1] += state[:, :, 1:]
        after += gains[at][..., None] * error[:, :, None, :]
        state = after
    return [Sums(state[i, :, :, c:], state[i, :, :, :c], cross[i], logs[i], length) for i in range(n_runs)]


def block_sums(values: np.ndarray, start: int, points: np.ndarray, order: Order) -> Sums:
    """Sums of one block of a series whose first value has position ``start``."""
    gains, variances, move, _ = _gains(points, order, start + len(values))
    ar = move[:, :, 0]
    length = max(16, math.isqrt(len(values)))
    n_runs = len(values) // length
    parts: list[Sums] = []
    if n_runs:
        parts += _runs(values[:n_runs * length].reshape(n_runs, length), start + length * np.arange(n_runs),
                       gains, variances, ar, order)
    if len(values) > n_runs * length:
        parts += _runs(values[None, n_runs * length:], np.array([start + n_runs * length]), gains, variances, ar, order)
    return _chain(parts)


def _chain(parts: Sequence[Sums]) -> Sums:
    total = parts[0]
    for part in parts[1:]:
        total = total.then(part)
    return total


def log_likelihoods(total: Sums, order: Order) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log-likelihood of each point, and [variance, mean, weight of the mean, end state...] of each."""
    n, found, details = total.count, [], []
    for cross, shift, logs in zip(total.cross, total.shift, total.logs):
        mean = cross[0, 1] / cross[1, 1] if order.has_mean else 0.0
        weight = cross[1, 1] if order.has_mean else 0.0
        rest = cross[0, 0] - mean * mean * weight
        var = max(rest, 0.0) / n
        end = shift[:, 0] - mean * shift[:, 1] if order.has_mean else shift[:, 0]
        found.append(-0.5 * (n * (math.log(2 * math.pi * var) + 1.0) + logs) if var > 0 else math.inf)
        details.append(np.concatenate([[var, mean, weight], end]))
    return np.array(found), details


# --- one step of one model ------------------------------------------------------------

def start_points(order: Order) -> np.ndarray:
    """A grid over the first coefficient of each part; the others start at 0."""
    used = [i for i, n in zip(np.cumsum([0, *order.parts[:-1]]), order.parts) if n]
    levels = (-0.7, -0.3, 0.1, 0.5, 0.85) if len(used) < 3 else (-0.5, 0.1, 0.6)
    points = np.zeros((len(levels) ** len(used), order.n_coef))
    for row, choice in zip(points, product(levels, repeat=len(used))):
        for i, r in zip(used, choice):
            row[i] = math.asin(r)
    return points


def stencil(u: np.ndarray) -> np.ndarray:
    """The centre, both neighbours along each axis, and both along each pair's diagonal."""
    unit = STEP * np.eye(len(u))
    moves = [e for i in range(len(u)) for e in (unit[i], -unit[i])]
    moves += [e for i, j in combinations(range(len(u)), 2) for e in (unit[i] + unit[j], -unit[i] - unit[j])]
    return np.array([u, *[u + e for e in moves]])


def _slopes(f: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian from the values at ``stencil``."""
    up, down = f[1:1 + 2 * k:2], f[2:2 + 2 * k:2]
    hess = np.diag((up + down - 2 * f[0]) / STEP ** 2)
    for n, (i, j) in enumerate(combinations(range(k), 2)):
        both = f[1 + 2 * k + 2 * n] + f[2 + 2 * k + 2 * n]
        hess[i, j] = hess[j, i] = (both - up[i] - down[i] - up[j] - down[j] + 2 * f[0]) / (2 * STEP ** 2)
    return (up - down) / (2 * STEP), hess


def advance(row: dict, total: Sums, order: Order) -> dict:
    """The model after a pass: next points to evaluate, or its result."""
    k = order.n_coef
    points = np.asarray(row["points"], float).reshape(-1, k) if k else np.zeros((1, 0))
    found, details = log_likelihoods(total, order)
    out = {**row, "passes": row["passes"] + 1, "nobs": total.count}
    scale = total.cross[0, 0, 0]
    if total.count < order.n_params + 2:
        return {**out, "status": "too few values"}
    if not np.isfinite(found).all() or min(d[0] for d in details) * total.count <= 1e-12 * max(scale, 1e-300):
        return {**out, "status": "no variance"}
    if row["status"] == "start" and k:
        best = points[int(np.argmax(found))]
        return {**out, "status": "moving", "points": stencil(best).ravel()}
    if found[0] < row["loglik"] - 1e-12 * abs(row["loglik"]):  # a step too long
        step = 0.25 * np.asarray(row["step"], float)
        centre = np.asarray(row["centre"], float)
        status = "moving" if np.abs(step).max() > 1e-6 else "fitted"
        return {**out, "status": status, "step": step, "points": stencil(centre + step).ravel()}
    grad, hess = _slopes(found, k)
    out |= {"loglik": float(found[0]), "centre": points[0], "hessian": hess.ravel(), "details": details[0]}
    if not k or found[0] - row["loglik"] < 1e-9:
        return {**out, "status": "fitted"}
    size, axes = np.linalg.eigh(-hess)
    step = axes @ ((axes.T @ grad) / np.maximum(np.abs(size), 1e-6 * total.count))
    step *= min(1.0, 0.8 / max(float(np.linalg.norm(step)), 1e-300))
    if float(grad @ step) < 1e-9:
        return {**out, "status": "fitted"}
    return {**out, "status": "moving", "step": step, "points": stencil(points[0] + step).ravel()}


# --- Spark ----------------------------------------------------------------------------

STATE = ("_series string, job int, _d int, status string, passes int, nobs long, loglik double, points array<double>, "
         "centre array<double>, step array<double>, hessian array<double>, details array<double>, "
         "offset double, tail array<double>")
_STATE_COLS = [c.split()[0] for c in STATE.split(", ")]
SUMS = "_series string, job int, blk long, sums array<double>"


def _series_id(keys: Sequence[str]):
    if not keys:
        return F.lit("{}")
    return F.to_json(F.struct(*keys), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


@dataclass
class Fits:
    """Fitted models. ``states`` has a row for each series and order."""

    states: DataFrame
    series: DataFrame
    keys: list[str]
    orders: list[Order]

    def _named(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        return df.join(self.series, "_series").select(*self.keys, *cols)

    def _rows(self, fn, schema: str) -> DataFrame:
        orders = self.orders

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ["_series", *[c.split()[0] for c in schema.split(", ")]]
            for pdf in batches:
                rows = [(r["_series"], *x) for r in pdf.to_dict("records") for x in fn(r, orders[r["job"]])]
                yield pd.DataFrame(rows, columns=names)
        done = self.states.where("status in ('fitted', 'not converged')")
        return self._named(done.mapInPandas(run, "_series string, " + schema), [c.split()[0] for c in schema.split(", ")])

    def models(self) -> DataFrame:
        """keys, p, d, q, seasonal_p, seasonal_d, seasonal_q, period, nobs, loglik, aic, bic, status, passes. AIC and BIC count the variance as a
        parameter; models of different d rest on different numbers of values, as is usual in order searches."""
        table = F.array(*[F.struct(*[F.lit(getattr(o, f)).alias(n) for f, n in ORDER_COLS],
                                   F.lit(float(o.n_params)).alias("n_params")) for o in self.orders])
        found = F.col("status").isin("fitted", "not converged")
        out = (self.states.withColumn("_o", table[F.col("job")])
               .withColumn("loglik", F.when(found, F.col("loglik")))
               .withColumn("aic", -2 * F.col("loglik") + 2 * F.col("_o.n_params"))
               .withColumn("bic", -2 * F.col("loglik") + F.col("_o.n_params") * F.log("nobs")))
        return self._named(out, [*[F.col(f"_o.{n}") for _, n in ORDER_COLS], "nobs", "loglik", "aic", "bic", "status", "passes"])

    def coefficients(self) -> DataFrame:
        """keys, term, estimate, std_err, z, p_value, lower, upper."""
        return self._rows(_coefficient_rows, "term string, estimate double, std_err double, z double, "
                                             "p_value double, lower double, upper double")

    def forecasts(self, steps: int = 10) -> DataFrame:
        """keys, step, forecast, std_err, lower, upper (95 %)."""
        return self._rows(lambda r, o: _forecast_rows(r, o, steps),
                          "step int, forecast double, std_err double, lower double, upper double")

    def best(self) -> Fits:
        """The model of least AIC of each series; the first order among equals."""
        pen = F.array(*[F.lit(float(o.n_params)) for o in self.orders])[F.col("job")]
        ok = self.states.where("status in ('fitted', 'not converged')")
        pick = ok.groupBy("_series").agg(F.min(F.struct((2 * pen - 2 * F.col("loglik")).alias("aic"), "job")).alias("b"))
        won = ok.join(pick.select("_series", F.col("b.job").alias("job")), ["_series", "job"]).select(*_STATE_COLS)
        return Fits(won, self.series, self.keys, self.orders)


def fit(df: DataFrame, keys: Sequence[str], value: str, orders: Sequence[Order]) -> Fits:
    """Fit every order to every series of ``df`` (see the module's text). All orders share D and s."""
    keys, orders = list(keys), list(orders)
    if len({(o.D, o.s) for o in orders}) > 1:
        raise ValueError("all orders must share seasonal differencing and period")
    D, s = orders[0].D, orders[0].s
    y = F.col(value).cast("double")
    base = (df.select(_series_id(keys).alias("_series"), F.col(POS).alias("_at"), y.alias("y"))
            .where(F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < F.lit(math.inf))))
    base = staged(add_positions(base, ["_series"], ["_at"], F.floor(F.col("_at") / 65_536)).drop("_at"), "series")
    series = df.select(_series_id(keys).alias("_series"), *keys).distinct()
    ds = sorted({o.d for o in orders})
    parts = []
    for d in ds:
        lost = d + D * s
        w = difference(base, ["_series"], "y", d, "w", s, D).where(F.col(POS) >= lost)
        parts.append(w.select("_series", F.lit(d).alias("_d"), (F.col(POS) - lost).alias("at"), "w"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    means = rows.groupBy("_series", "_d").agg(F.avg("w").alias("offset"))
    blocks = rows.groupBy("_series", "_d", F.floor(F.col("at") / BLOCK).cast("long").alias("blk")).agg(
        F.sort_array(F.collect_list(F.struct("at", "w")))["w"].alias("w"))
    blocks = staged(blocks, "blocks")
    last = base.groupBy("_series").agg(F.max(POS).alias("_last"))
    keep = max(ds) + D * s
    tails = base.join(last, "_series").where(F.col(POS) > F.col("_last") - keep).groupBy("_series").agg(
        F.sort_array(F.collect_list(F.struct(POS, "y")))["y"].alias("tail"))
    states = _fit_states(blocks, means, tails, orders)
    return Fits(states, series, keys, orders)


def _fit_states(blocks: DataFrame, means: DataFrame, tails: DataFrame, orders: list[Order]) -> DataFrame:
    spark = blocks.sparkSession
    jobs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("job"), F.lit(o.d).alias("_d"),
                 F.array(*[F.lit(float(x)) for x in start_points(o).ravel()]).cast("array<double>").alias("points"))
        for i, o in enumerate(orders)]))
    # one row for each order: safe to broadcast
    jobs = spark.range(1).select(jobs.alias("j")).select("j.*")
    none = F.array().cast("array<double>")
    states = (means.join(F.broadcast(jobs), "_d").join(tails, "_series", "left")
              .withColumns({"status": F.lit("start"), "passes": F.lit(0), "nobs": F.lit(0).cast("long"),
                            "loglik": F.lit(-math.inf), "centre": none, "step": none, "hessian": none, "details": none,
                            "tail": F.coalesce("tail", none)})
              .select(*_STATE_COLS))
    states = staged(states, "states")
    most = blocks.agg(F.max("blk")).first()[0]
    finished = spark.createDataFrame([], STATE)
    if most is None:
        return finished
    for _ in range(MAX_PASSES):
        states = staged(_one_pass(blocks, states, orders, most + 1), "states")
        finished = finished.unionByName(states.where("status not in ('start', 'moving')"))
        states = states.where("status in ('start', 'moving')")
        if states.isEmpty():
            break
    return finished.unionByName(states.withColumn("status", F.lit("not converged")))


def _one_pass(blocks: DataFrame, states: DataFrame, orders: list[Order], n_blocks: int) -> DataFrame:
    todo = blocks.join(states.select("_series", "_d", "job", "points", "offset"), ["_series", "_d"])
    sums = todo.select("_series", "job", "blk", "w", "points", "offset").mapInPandas(_summer(orders), SUMS)
    fold = _folder(orders)
    while n_blocks > FAN:
        sums = (sums.withColumn("up", F.floor(F.col("blk") / FAN).cast("long"))
                .groupBy("_series", "job", "up").applyInPandas(fold, SUMS))
        n_blocks = -(-n_blocks // FAN)
    both = sums.groupBy("_series", "job").cogroup(states.groupBy("_series", "job"))
    return both.applyInPandas(_stepper(orders), STATE)


def _summer(orders: list[Order]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                order = orders[r["job"]]
                k = order.n_coef
                points = np.asarray(r["points"], float).reshape(-1, k) if k else np.zeros((1, 0))
                # a model without a mean takes differences as they are
                values = np.asarray(r["w"], float) - (r["offset"] if order.has_mean else 0.0)
                out.append((r["_series"], r["job"], r["blk"], block_sums(values, r["blk"] * BLOCK, points, order).pack()))
            yield pd.DataFrame(out, columns=["_series", "job", "blk", "sums"])
    return run


def _total(pdf: pd.DataFrame, order: Order) -> Sums:
    return _chain([Sums.unpack(np.asarray(x, float), order) for x in pdf.sort_values("blk")["sums"]])


def _folder(orders: list[Order]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        job = int(pdf["job"].iloc[0])
        return pd.DataFrame([(pdf["_series"].iloc[0], job, int(pdf["up"].iloc[0]), _total(pdf, orders[job]).pack())],
                            columns=["_series", "job", "blk", "sums"])
    return run


def _stepper(orders: list[Order]):
    def run(sums: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        row = state.to_dict("records")[0]
        order = orders[row["job"]]
        return pd.DataFrame([advance(row, _total(sums, order), order)], columns=_STATE_COLS)
    return run


# --- results of one model -------------------------------------------------------------

def _coefficient_rows(row: dict, order: Order) -> list[tuple]:
    k = order.n_coef
    u = np.asarray(row["centre"], float)
    var, mean, weight = np.asarray(row["details"], float)[:3]
    estimates, errors, terms = coefficients(u, order), np.full(k, math.nan), order.terms
    if k:
        unit = 1e-6 * np.eye(k)
        slope = np.stack([(coefficients(u + e, order) - coefficients(u - e, order)) / 2e-6 for e in unit], axis=1)
        size, axes = np.linalg.eigh(-np.asarray(row["hessian"], float).reshape(k, k))
        if size.min() > 1e-9 * size.max():  # otherwise the likelihood is flat and no error is known
            half = slope @ axes / np.sqrt(size)
            errors = np.sqrt((half ** 2).sum(axis=1))
        part = np.repeat(np.arange(4), order.parts)
        errors[np.isin(part, part[np.abs(np.cos(u)) < 1e-2])] = math.nan
    found = list(zip(terms, estimates, errors))
    if order.has_mean:
        found.insert(0, ("mean", mean + row["offset"], math.sqrt(var / weight)))
    found.append(("sigma2", var, var * math.sqrt(2.0 / row["nobs"])))
    out = []
    for term, est, err in found:
        known = err == err and err > 0
        z = est / err if known else None
        out.append((term, float(est), float(err) if known else None, z,
                    math.erfc(abs(z) / math.sqrt(2.0)) if known else None,
                    est - Z95 * err if known else None, est + Z95 * err if known else None))
    return out


def _forecast_rows(row: dict, order: Order, steps: int) -> list[tuple]:
    u, details = np.asarray(row["centre"], float), np.asarray(row["details"], float)
    var, mean, state = details[0], details[1], details[3:]
    move, load = _system(u, order)
    cov = _gains(u[None, :], order, int(row["nobs"]))[3][0]
    noise = np.outer(load, load)
    ahead, covs = [], []
    for _ in range(steps):
        ahead.append(state[0])
        covs.append(cov)
        state, cov = move @ state, move @ cov @ move.T + noise
    spread = np.zeros((steps, steps))  # covariances of the differenced values to come
    for i, c in enumerate(covs):
        for j in range(i, steps):
            spread[i, j] = spread[j, i] = c[0, 0]
            c = move @ c
    w = np.array(ahead) + mean + (row["offset"] if order.has_mean else 0.0)
    poly = difference_polynomial(order.d, order.s, order.D)
    lost = len(poly) - 1
    past = [float(x) for x in row["tail"]][-lost:] if lost else []
    for x in w:
        past.append(x - sum(poly[j] * past[-j] for j in range(1, lost + 1)))
    undo = np.zeros((steps, steps))
    for i in range(steps):
        undo[i, i] = 1.0
        for j in range(1, min(lost, i) + 1):
            undo[i] -= poly[j] * undo[i - j]
    err = np.sqrt(np.maximum(var * np.einsum("ij,jk,ik->i", undo, spread, undo), 0.0))
    return [(i + 1, float(f), float(e), float(f - Z95 * e), float(f + Z95 * e))
            for i, (f, e) in enumerate(zip(past[-steps:] if steps else [], err))]


# --- operators --------------------------------------------------------------------------

def search_orders(max_p: int = 3, max_d: int = 2, max_q: int = 3) -> list[Order]:
    """All orders up to the limits, in ascending order."""
    return [Order(p, d, q) for p in range(max_p + 1) for d in range(max_d + 1) for q in range(max_q + 1)]


def arima_ml(df: DataFrame, keys: Sequence[str], value: str = "y", order: tuple[int, int, int] = (1, 1, 1),
             seasonal: tuple[int, int, int, int] = (0, 0, 0, 0)) -> Fits:
    """ARIMA ``order`` = (p, d, q), ``seasonal`` = (P, D, Q, s), by exact maximum likelihood."""
    return fit(df, keys, value, [Order(*order, *seasonal)])


def auto_arima_ml(df: DataFrame, keys: Sequence[str], value: str = "y", max_p: int = 3, max_d: int = 2, max_q: int = 3) -> Fits:
    """The order of least AIC of each series, every order fitted by exact maximum likelihood."""
    return fit(df, keys, value, search_orders(max_p, max_d, max_q)).best()
