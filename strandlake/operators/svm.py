"""Support vector machines for a task's rows: one solver for all forms, which holds a bounded number of kernel columns.

All forms are the same problem: least half a'Qa + p'a with 0 <= a <= cost and one or two sums of a held fixed, Q the kernel with the signs of its
two rows. Each step moves two variables of one sum: the one that violates the optimality conditions most, and the one with which the
objective falls furthest. Variables at a bound that can't be chosen soon are left out for a time (shrinking); before the end all are looked at again.

Machines are fitted side by side in tasks, on bounded samples (see ``ml``), or one on all rows of a table (see ``machines``); rows are scored wherever they are.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np

#: Bytes of kernel columns that a solver holds.
CACHE_BYTES = 100 << 20
#: Steps between two looks at what may be left out.
SHRINK_EVERY = 1000
#: Kernel values that a decision holds at once; few enough for a core's cache.
PIECE = 1 << 17


class Svm:
    """A machine: decision(x) = sum of coefficient * kernel(support vector, x) - rho. With two classes, above 0 is the first label.

    With the kernel ``precomputed`` a row holds its kernel values with all training rows, and a support vector the place of its row among them.
    """

    def __init__(self, vectors: np.ndarray, coefficients: np.ndarray, rho: float, labels: tuple[float, float] = (1.0, -1.0), gamma: float = 0.5, name: str = "rbf", coef0: float = 0.0, degree: int = 3, form: str = "c_svc") -> None:
        self.vectors, self.coefficients, self.rho, self.labels = np.asarray(vectors, dtype=np.float64), np.asarray(coefficients, dtype=np.float64), rho, labels
        self.gamma, self.name, self.coef0, self.degree, self.form = gamma, name, coef0, degree, form

    def gram(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.name == "precomputed":
            return x[:, y[:, 0].astype(np.int64)]
        d = x @ y.T
        if self.name == "rbf":
            d *= -2
            d += (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
            np.maximum(0, d, out=d)
            d *= -self.gamma
            return np.exp(d, out=d)
        return {"linear": lambda: d, "polynomial": lambda: (self.gamma * d + self.coef0) ** self.degree, "sigmoid": lambda: np.tanh(self.gamma * d + self.coef0)}[self.name]()

    def decide(self, x: np.ndarray) -> np.ndarray:
        """By pieces of ``x``, so that at most some ``PIECE`` kernel values are held, whatever the number of rows."""
        step = max(1, PIECE // max(1, len(self.vectors)))
        return np.concatenate([self.gram(x[i : i + step], self.vectors) @ self.coefficients - self.rho for i in range(0, max(1, len(x)), step)])

    def to_text(self) -> str:
        """The usual model file."""
        classes = self.form in ("c_svc", "nu_svc")
        n = [(self.coefficients > 0).sum(), (self.coefficients <= 0).sum()]
        head = [f"svm_type {self.form}", f"kernel_type {self.name}", *[f"degree {self.degree}"] * (self.name == "polynomial"), *[f"gamma {self.gamma!r}"] * (self.name not in ("linear", "precomputed")), *[f"coef0 {self.coef0!r}"] * (self.name in ("polynomial", "sigmoid"))]
        head += ["nr_class 2", f"total_sv {len(self.vectors)}", f"rho {self.rho!r}", *["label " + " ".join(f"{v:g}" for v in self.labels), f"nr_sv {n[0]} {n[1]}"] * classes, "SV"]
        first = 0 if self.name == "precomputed" else 1
        rows = [" ".join([repr(float(c)), *(f"{i + first}:{float(v + 1 - first)!r}" for i, v in enumerate(x) if v or not first)]) for c, x in zip(self.coefficients, self.vectors, strict=True)]
        return "\n".join(head + rows) + "\n"

    @staticmethod
    def from_text(text: str, dims: int | None = None) -> Svm:
        head, _, body = text.partition("\nSV\n")
        known = dict(line.split(" ", 1) for line in head.split("\n"))
        first = 0 if known["kernel_type"] == "precomputed" else 1
        rows = [line.split() for line in body.split("\n") if line.strip()]
        pairs = [[(int(i), float(v)) for i, v in (p.split(":") for p in r[1:])] for r in rows]
        x = np.zeros((len(rows), dims or max((i for p in pairs for i, _ in p), default=0) + 1 - first))
        for k, p in enumerate(pairs):
            for i, v in p:
                x[k, i - first] = v - 1 + first
        labels = tuple(float(v) for v in known.get("label", "1 -1").split())
        return Svm(x, np.array([float(r[0]) for r in rows]), float(known["rho"]), labels, float(known.get("gamma", 0)), known["kernel_type"], float(known.get("coef0", 0)), int(known.get("degree", 3)), known["svm_type"])


class Columns:
    """Kernel columns, the ones last used held up to a number of bytes. Rows may be taken several times (``of`` maps variables to rows)."""

    def __init__(self, m: Svm, x: np.ndarray, of: np.ndarray, most: int | None = None) -> None:
        self.m, self.x, self.of = m, x, of
        self.room = max(2, (CACHE_BYTES if most is None else most) // max(1, 8 * len(x)))
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()
        self.squares = (x * x).sum(axis=1) if m.name == "rbf" else None
        at = np.arange(len(x))
        self.diagonal = x[at, at] if m.name == "precomputed" else np.concatenate([np.zeros(0), *(np.einsum("ii->i", m.gram(x[i : i + 256], x[i : i + 256])) for i in range(0, len(x), 256))])

    def rows(self, some: np.ndarray) -> np.ndarray:
        """Support vectors of some rows."""
        return some[:, None].astype(np.float64) if self.m.name == "precomputed" else self.x[some]

    def one(self, i: int) -> np.ndarray:
        """The kernel of all rows with the row of variable i."""
        r = int(self.of[i])
        if r in self.held:
            self.held.move_to_end(r)
        else:
            if len(self.held) >= self.room:
                self.held.popitem(last=False)
            if self.squares is None:
                self.held[r] = self.m.gram(self.x, self.rows(np.array([r])))[:, 0]
            else:
                self.held[r] = np.exp(-self.m.gamma * np.maximum(0, self.squares + self.squares[r] - 2 * (self.x @ self.x[r])))
        return self.held[r]

    def sums(self, variables: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For some variables, the kernel with all rows times a weight by row; a bounded block at a time."""
        some = np.flatnonzero(weight)
        out = np.zeros(len(variables))
        step = max(1, (1 << 22) // max(1, len(some)))
        for lo in range(0, len(variables), step):
            part = variables[lo : lo + step]
            out[lo : lo + step] = self.m.gram(self.x[self.of[part]], self.rows(some)) @ weight[some]
        return out


def solve(columns: Columns, p: np.ndarray, y: np.ndarray, cost: np.ndarray, alpha: np.ndarray, group: np.ndarray, eps: float = 1e-3, most: int | None = None, shrinking: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Variables within ``eps`` of the optimality conditions, and the gradient there. ``alpha`` is where to begin; its sums by ``group`` (with signs y) stay."""
    n, of = len(y), columns.of
    weight = lambda: np.bincount(of, alpha * y, minlength=len(columns.x))
    gradient = p + y * columns.sums(np.arange(n), weight())
    active, complete, left = np.arange(n), True, SHRINK_EVERY
    groups = np.unique(group)
    for _ in range(most or max(1_000_000, 100 * n)):
        a, s, g = alpha[active], y[active], group[active]
        value = -s * gradient[active]
        up, low = np.where(s > 0, a < cost[active], a > 0), np.where(s > 0, a > 0, a < cost[active])
        best = (-np.inf, 0, 0, 0.0)
        for k in groups:
            top, bottom = np.where(up & (g == k), value, -np.inf), np.where(low & (g == k), value, np.inf)
            i = int(top.argmax()) if len(active) else 0
            if len(active) and top[i] - bottom.min() > best[0]:
                best = (top[i] - bottom.min(), i, k, bottom.min())
        if best[0] < eps:
            if complete:
                return alpha, gradient
            out = np.setdiff1d(np.arange(n), active, assume_unique=True)
            gradient[out] = p[out] + y[out] * columns.sums(out, weight())
            active, complete, left = np.arange(n), True, SHRINK_EVERY
            continue
        _, at, k, _ = best
        i = int(active[at])
        own = columns.one(i)
        rise = value[at] - value
        curve = np.maximum(columns.diagonal[of[i]] + columns.diagonal[of[active]] - 2 * own[of[active]], 1e-12)
        gain = np.where(low & (g == k) & (rise > 0), rise * rise / curve, -np.inf)
        to = int(gain.argmax())
        j = int(active[to])
        step = min(rise[to] / curve[to], cost[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cost[j] - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        for v in (i, j):  # what lies at a bound lies there exactly
            alpha[v] = 0.0 if alpha[v] < 1e-14 * cost[v] else cost[v] if alpha[v] > cost[v] * (1 - 1e-14) else alpha[v]
        other = columns.one(j)
        gradient[active] += step * s * (own[of[active]] - other[of[active]])
        left -= 1
        if shrinking and not left:
            left, keep = SHRINK_EVERY, np.ones(len(active), dtype=bool)
            for k in groups:
                mine = g == k
                most_up, least_low = np.where(up & mine, value, -np.inf).max(), np.where(low & mine, value, np.inf).min()
                keep &= ~(mine & (~up & (value > most_up) | ~low & (value < least_low)))
            keep[[at, to]] = True
            active, complete = active[keep], complete and bool(keep.all())
    raise ArithmeticError("the machine has not converged")


def _level(alpha: np.ndarray, y: np.ndarray, cost: np.ndarray, gradient: np.ndarray) -> float:
    """What y times the gradient is at variables within their bounds; between what the bounds allow if there is none."""
    value, free = y * gradient, (alpha > 0) & (alpha < cost)
    if free.any():
        return float(value[free].mean())
    up, low = np.where(y > 0, alpha < cost, alpha > 0), np.where(y > 0, alpha > 0, alpha < cost)
    ends = [value[up].min()] * bool(up.any()) + [value[low].max()] * bool(low.any())
    return float(np.mean(ends)) if ends else 0.0


def _first(total: float, n: int, most: float) -> np.ndarray:
    """n values of at most ``most`` each, the first ones as large as they can be, of a given sum."""
    return np.clip(total - most * np.arange(n), 0, most)


def train(x: np.ndarray, z: np.ndarray, form: str = "c_svc", cost: float = 1.0, nu: float = 0.5, tube: float = 0.1, gamma: float = 0.5, name: str = "rbf", coef0: float = 0.0, degree: int = 3, eps: float = 1e-3, most: int | None = None, shrinking: bool = True, cache_bytes: int | None = None) -> Svm:
    """A machine of one of five forms: ``c_svc`` and ``nu_svc`` (``z`` is 1 or -1), ``one_class`` (``z`` plays no part), ``epsilon_svr`` and ``nu_svr`` (``z`` is a value).

    One that isn't within ``eps`` of the optimum after ``most`` steps, by default 100 a row and 1,000,000 at least, is an error, as is a
    ``nu`` that the classes' sizes don't allow.
    """
    x, z, n = np.asarray(x, dtype=np.float64), np.asarray(z, dtype=np.float64), len(x)
    m = Svm(np.zeros((0, x.shape[1])), np.zeros(0), 0.0, gamma=gamma, name=name, coef0=coef0, degree=degree, form=form)
    of, y = np.arange(n), np.where(z > 0, 1.0, -1.0)
    if form == "c_svc":
        p, limit, alpha, group = -np.ones(n), cost, np.zeros(n), np.zeros(n)
    elif form == "nu_svc":
        if nu * n / 2 > min((y > 0).sum(), (y < 0).sum()):
            raise ValueError(f"nu is too large for the classes: {nu}")
        p, limit, alpha, group = np.zeros(n), 1.0, np.zeros(n), y
        for k in (1, -1):
            alpha[y == k] = _first(nu * n / 2, int((y == k).sum()), 1.0)
    elif form == "one_class":
        p, limit, alpha, group, y = np.zeros(n), 1.0, _first(nu * n, n, 1.0), np.zeros(n), np.ones(n)
    elif form in ("epsilon_svr", "nu_svr"):
        of, y, limit = np.tile(np.arange(n), 2), np.repeat([1.0, -1.0], n), cost
        tubes = tube if form == "epsilon_svr" else 0.0
        p = np.concatenate([tubes - z, tubes + z])
        alpha = np.zeros(2 * n) if form == "epsilon_svr" else np.tile(_first(cost * nu * n / 2, n, cost), 2)
        group = np.zeros(2 * n) if form == "epsilon_svr" else y
    else:
        raise ValueError(f"no form {form}")
    limits = np.full(len(y), float(limit))
    columns = Columns(m, x, of, cache_bytes)
    alpha, gradient = solve(columns, p, y, limits, alpha, group, eps, most, shrinking)
    scale = 1.0
    if len(np.unique(group)) > 1:
        plus, minus = (_level(alpha[y == k], y[y == k], limits[y == k], gradient[y == k]) for k in (1, -1))
        m.rho = (plus + minus) / 2
        scale = (plus - minus) / 2 if form == "nu_svc" else 1.0
    else:
        m.rho = _level(alpha, y, limits, gradient)
    coefficient = np.bincount(of, alpha * y, minlength=n) / scale
    m.rho /= scale
    keep = np.flatnonzero(coefficient)
    m.vectors, m.coefficients = columns.rows(keep), coefficient[keep]
    return m


def coupled(pairs: np.ndarray) -> np.ndarray:
    """Class probabilities from those of each pair of classes: ``pairs`` [row, i, j] is the chance of i given that it is i or j.

    They make the sum over pairs of (pairs[j, i] p_i - pairs[i, j] p_j)^2 least, which is one linear system a row.
    """
    n, k = pairs.shape[:2]
    r = np.clip(pairs, 1e-7, 1 - 1e-7)
    r[:, np.arange(k), np.arange(k)] = 0
    q = -r * r.transpose(0, 2, 1)
    q[:, np.arange(k), np.arange(k)] = (r * r).sum(axis=1)
    system = np.zeros((n, k + 1, k + 1))
    system[:, :k, :k], system[:, k, :k], system[:, :k, k] = q, 1, 1
    right = np.zeros((n, k + 1, 1))
    right[:, k] = 1
    p = np.maximum(0, np.linalg.solve(system, right)[:, :k, 0])
    return p / p.sum(axis=1, keepdims=True)


def sigmoid_of(decision: np.ndarray, yes: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a d + b)) of largest likelihood, with targets drawn in from 0 and 1 by the class counts; Newton steps with halving."""
    n1, n0 = yes.sum(), (~yes).sum()
    t = np.where(yes, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, x = np.array([0.0, np.log((n0 + 1) / (n1 + 1))]), np.stack([decision, np.ones(len(decision))])
    loss = lambda v: float((t * (v @ x) + np.logaddexp(0, -(v @ x))).sum())
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(w @ x, -500, 500)))
        slope = x @ (t - p)
        if np.abs(slope).max() < 1e-6:
            break
        way = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-12 * np.eye(2), -slope)
        far = 1.0
        while far > 1e-10 and loss(w + far * way) > now + 1e-4 * far * float(slope @ way):
            far /= 2
        w = w + far * way
        now = loss(w)
    return float(w[0]), float(w[1])
