"""L1-penalised logistic regression of many fits at once, by proximal Newton steps.

A step is one pass over the narrow cached rows for all fits that are still open,
whatever their fold and penalty: the tasks return loss, gradient and weighted
Gram matrix at each fit's coefficients, as sums whose size depends on the number
of features only. The driver solves each penalised quadratic model exactly, by a
search over the signs of its coefficients. Fits that agree on their rows and
coefficients share their sums, so the first pass, where all coefficients are
zero, forms one Gram matrix a fold.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

FEATURES = 1000  # columns whose Gram matrix may reach the driver
TOL = 1e-8  # largest residual of the optimality conditions, of the mean loss
PASSES = 60
RIDGE = 1e-12  # of the mean diagonal, so that dependent features have one solution
STEPS = 50  # of the search over signs, for each coefficient
GROUPS = 16  # tasks' sums are added in so many groups a fit before the driver adds these


@dataclass(frozen=True)
class Task:
    """A fit: the fold it leaves out (None: none) and the penalty on the mean loss."""

    without: int | None
    penalty: float


@dataclass
class Fit:
    """Intercept first, then a weight a feature, and how well the fit meets its conditions."""

    beta: np.ndarray
    residual: float
    rows: float
    loss: float

    @property
    def intercept(self) -> float:
        return float(self.beta[0])

    @property
    def weights(self) -> np.ndarray:
        return self.beta[1:]


@dataclass
class _State:
    """Sums over the rows of a fit, divided by their number."""

    n: float
    loss: float
    gradient: np.ndarray
    gram: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, p: int) -> _State:
        upper = np.triu_indices(p)
        gram = np.zeros((p, p))
        gram[upper] = flat[2 + p :]
        gram = gram + np.triu(gram, 1).T
        n = float(flat[0])
        return cls(n, float(flat[1]) / n, flat[2 : 2 + p] / n, gram / n)


def residual(beta: np.ndarray, gradient: np.ndarray, penalty: float) -> float:
    """How far coefficients are from the optimality conditions of their penalised mean loss."""
    w, g = beta[1:], gradient[1:]
    off = np.where(w != 0, np.abs(g + penalty * np.sign(w)), np.maximum(np.abs(g) - penalty, 0.0))
    return float(max(abs(gradient[0]), off.max(initial=0.0)))


def _sums(states: list[tuple[int | None, np.ndarray]], x_col: str, y_col: str, fold_col: str):
    """Per state: rows, loss, gradient and the upper half of the Gram matrix."""
    betas = np.stack([b for _, b in states], axis=1)
    without = np.array([-1 if f is None else f for f, _ in states])
    p = len(betas)
    upper = np.triu_indices(p)

    def run(batches: Iterable[pa.RecordBatch]):
        total = np.zeros((len(states), 2 + p + len(upper[0])))
        grams = np.zeros((len(states), p, p))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.ones((n, p))
            x[:, 1:] = batch.column(x_col).flatten().to_numpy(zero_copy_only=False).reshape(n, p - 1)
            y = batch.column(y_col).to_numpy(zero_copy_only=False).astype(float)
            fold = batch.column(fold_col).to_numpy(zero_copy_only=False)
            eta = x @ betas
            kept = (fold[:, None] != without[None, :]).astype(float)
            mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
            total[:, 0] += kept.sum(axis=0)
            total[:, 1] += ((np.logaddexp(0.0, eta) - y[:, None] * eta) * kept).sum(axis=0)
            total[:, 2 : 2 + p] += ((mu - y[:, None]) * kept).T @ x
            weight = mu * (1.0 - mu) * kept
            for k in range(len(states)):
                grams[k] += (x * weight[:, k : k + 1]).T @ x
        for k in range(len(states)):
            total[k, 2 + p :] = grams[k][upper]
        group = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(states), dtype=np.int32)), pa.array(np.full(len(states), group, np.int32)),
                pa.array(list(total), pa.list_(pa.float64())),
            ],
            ["state", "part", "v"],
        )

    return run


def _added(table: pa.Table) -> pa.Table:
    v = np.sum(np.stack(table.column("v").to_numpy()), axis=0)
    return pa.table({"state": table.column("state")[:1], "v": pa.array([v], pa.list_(pa.float64()))})


def _pass(rows: DataFrame, states: list, x_col: str, y_col: str, fold_col: str) -> list[np.ndarray]:
    parts = rows.select(x_col, y_col, fold_col).mapInArrow(
        _sums(states, x_col, y_col, fold_col), "state int, part int, v array<double>"
    )
    added = parts.groupBy("state", "part").applyInArrow(_added, "state int, v array<double>").toArrow()
    p = len(states[0][1])
    out = [np.zeros(2 + p + p * (p + 1) // 2) for _ in states]
    for state, v in zip(added.column("state").to_pylist(), added.column("v")):
        out[state] = out[state] + np.asarray(v.values)
    return out


def _quadratic(gram: np.ndarray, target: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """Minimise b'Gb/2 - t'b + penalty |b_1..| exactly, from a start, by search over signs.

    The coefficients in use are solved for with their signs held. On the way from
    the old values to the solved ones the best point among those where a sign
    would turn is taken, and what is zero there leaves. When no coefficient in
    use wants to move, the zero one that violates its condition most comes in.
    The value falls at every step, so no set of signs comes twice.
    """
    p = len(target)
    gram = gram + np.eye(p) * (RIDGE * np.trace(gram) / p)  # features may be sums of others
    free = np.arange(p) == 0
    b = start.copy()
    signs = np.where(free, 0.0, np.sign(b))
    slack = 1e-11

    def value(x: np.ndarray) -> float:
        return float(x @ gram @ x / 2 - target @ x + penalty * np.abs(x[1:]).sum())

    for _ in range(STEPS * p):
        slope = gram @ b - target
        used = free | (signs != 0)
        if np.abs((slope + penalty * signs)[used]).max() <= slack:
            beyond = np.where(used, 0.0, np.abs(slope) - penalty)
            j = int(beyond.argmax())
            if beyond[j] <= slack:
                break
            signs[j] = -np.sign(slope[j])
            used[j] = True
        solved = np.zeros(p)
        solved[used] = np.linalg.solve(gram[np.ix_(used, used)], (target - penalty * signs)[used])
        move = solved - b
        # where a sign turns on the way
        turning = np.flatnonzero(~free & (b != 0) & (np.sign(solved) != np.sign(b)))
        shares = sorted({*(-b[turning] / move[turning]).tolist(), 1.0})
        points = []
        for share in shares:
            x = b + share * move
            x[turning[np.isclose(-b[turning] / move[turning], share, rtol=1e-12, atol=0)]] = 0.0
            points.append(x)
        new = min(points, key=value)
        settled = np.abs(new - b).max() <= 1e-14 * max(1.0, np.abs(b).max())
        b = new
        signs = np.where(free, 0.0, np.sign(b))
        if settled:
            break
    return b


def fit_all(
    rows: DataFrame, tasks: Mapping[Hashable, Task], features: int, x_col: str = "x", y_col: str = "y",
    fold_col: str = "fold", start: Mapping[Hashable, np.ndarray] | None = None, tol: float = TOL, passes: int = PASSES,
) -> tuple[dict[Hashable, Fit], int]:
    """All fits, and the number of passes over the rows.

    ``x_col`` holds an array of ``features`` doubles, best near mean 0 and
    deviation 1; the intercept bears no penalty. A step that does not lower the
    penalised loss is halved, which is the next pass. A fit that has not settled
    after ``passes`` is an error.
    """
    if features > FEATURES:
        raise ValueError(f"{features} features; at most {FEATURES} are brought together")
    p = features + 1
    trial = {k: (start or {}).get(k, np.zeros(p)).copy() for k in tasks}
    best: dict[Hashable, tuple[np.ndarray, _State, float]] = {}
    done: dict[Hashable, Fit] = {}
    for number in range(1, passes + 1):
        states, at = [], {}
        for k, beta in trial.items():
            mark = (tasks[k].without, beta.tobytes())
            if mark not in at:
                at[mark] = len(states)
                states.append((tasks[k].without, beta))
        found = _pass(rows, states, x_col, y_col, fold_col)
        moving = []
        for k in list(trial):
            beta, task = trial[k], tasks[k]
            flat = found[at[task.without, beta.tobytes()]]
            if not flat[0]:
                raise ValueError(f"the fit {k} has no rows")
            state = _State.of(flat, p)
            value = state.loss + task.penalty * np.abs(beta[1:]).sum()
            if k in best and not value <= best[k][2] + 1e-12:
                trial[k] = (best[k][0] + beta) / 2
                continue
            best[k] = beta, state, value
            off = residual(beta, state.gradient, task.penalty)
            if off <= tol:
                done[k] = Fit(beta, off, state.n, state.loss)
                del trial[k]
            else:
                moving.append(k)
        if not trial:
            return done, number
        for k in moving:
            beta, state, _ = best[k]
            trial[k] = _quadratic(state.gram, state.gram @ beta - state.gradient, tasks[k].penalty, beta)
    raise ArithmeticError(f"{len(trial)} of {len(tasks)} fits have not settled after {passes} passes")
