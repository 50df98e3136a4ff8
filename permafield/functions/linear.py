"""General linear models for many elements at once, refitted under permutations without permuting the data."""

from __future__ import annotations

import copy
import math

import numpy as np

#: Machine constant in the standard error, and the share of the largest residual variance added for shrinkage.
EPS, SHRINK = 2.2e-16, 1e-3
#: Statistics nearer than this share of the observed one are equal: groupings of the same sum differ by rounding alone.
TIE = 1e-10


def reaches(v: np.ndarray, v0: np.ndarray) -> np.ndarray:
    """Where draws ``v`` are as large as the observed ``v0`` in its direction; equal ones are, whatever their last bits."""
    s = np.sign(v0)
    return s * v >= s * v0 - TIE * np.abs(v0)


def contrast_matrix(c, columns: int) -> np.ndarray:
    """A contrast as (columns, q); a vector is one column. Longer sides must fit the design."""
    c = np.asarray(c, float)
    c = c[:, None] if c.ndim == 1 else c
    if c.shape[0] != columns:
        raise ValueError(f"the contrast has {c.shape[0]} rows, the design {columns} columns")
    return c


def contrast_basis(c: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the contrast's column space: as many columns as its rank."""
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    return u[:, s > (s.max(initial=0) * max(c.shape) * np.finfo(float).eps)]


def partition(x, c) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the design that the contrast loads, and the others."""
    x = np.asarray(x, float)
    used = np.abs(contrast_matrix(c, x.shape[1])).sum(1) > 0
    return np.flatnonzero(used), np.flatnonzero(~used)


class PermutedGLM:
    """t or F of every row of ``y`` (elements by observations) for the design ``x`` and the contrast ``c``.

    The pseudo-inverse is factorised once. A permutation of the observations moves its columns by the inverse permutation, a
    sign flip multiplies them; residual sums come from the norms, so no permuted data and no residuals are made.
    """

    def __init__(self, y, x, c, shrink: float = 0.0, eps_inside: bool = True, norms: np.ndarray | None = None):
        self.y, self.x = np.atleast_2d(np.asarray(y, float)), np.asarray(x, float)
        if self.x.ndim != 2 or self.y.shape[1] != self.x.shape[0]:
            raise ValueError("the data need a column for each row of the design")
        self.c = contrast_matrix(c, self.x.shape[1])
        self.is_t = self.c.shape[1] == 1
        self.shrink, self.eps_inside = shrink, eps_inside
        self.inverse = np.linalg.pinv(self.x)
        self.xtx = self.x.T @ self.x
        self.rank = int(np.linalg.matrix_rank(self.x))
        self.df = self.x.shape[0] - self.rank
        if self.df <= 0:
            raise ValueError("the design leaves no degrees of freedom")
        self.norms = (self.y * self.y).sum(1) if norms is None else norms
        cov = self.inverse @ self.inverse.T
        if self.is_t:
            self.variance = float(self.c[:, 0] @ cov @ self.c[:, 0])
        else:
            self.basis = contrast_basis(self.c)
            self.between = np.linalg.pinv(self.basis.T @ cov @ self.basis)

    def on(self, y: np.ndarray, norms: np.ndarray | None = None) -> PermutedGLM:
        """The same factorised design for other data."""
        other = copy.copy(self)
        other.y, other.norms = y, (y * y).sum(1) if norms is None else norms
        return other

    def mean_squares(self, beta: np.ndarray) -> np.ndarray:
        return np.maximum(self.norms - ((beta @ self.xtx) * beta).sum(1), 0) / self.df

    def largest(self, inverse: np.ndarray) -> float:
        """The largest finite residual variance, which shrinkage adds a share of."""
        ms = self.mean_squares(self.y @ inverse.T)
        return float(ms[np.isfinite(ms)].max(initial=0.0))

    def statistic(self, inverse: np.ndarray, largest: float | None = None) -> np.ndarray:
        """t or F for a pseudo-inverse whose columns were exchanged; ``largest``: that of all elements, if ``y`` is a part of them."""
        beta = self.y @ inverse.T
        ms = self.mean_squares(beta)
        if self.shrink:
            ms = ms + self.shrink * (ms[np.isfinite(ms)].max(initial=0.0) if largest is None else largest)
        if self.is_t:
            up = beta @ self.c[:, 0]
            return up / np.sqrt(ms * self.variance + EPS) if self.eps_inside else up / (EPS + np.sqrt(ms * self.variance))
        part = beta @ self.basis
        with np.errstate(divide="ignore", invalid="ignore"):
            return ((part @ self.between) * part).sum(1) / self.basis.shape[1] / ms

    def fit(self, perm=None) -> np.ndarray:
        """Statistic of ``y[:, perm]``; of ``y`` itself without ``perm``."""
        return self.statistic(self.inverse if perm is None else self.inverse[:, np.argsort(perm)])

    def fit_signs(self, signs) -> np.ndarray:
        """Statistic of ``y * signs``."""
        return self.statistic(self.inverse * np.asarray(signs, float))


def residual_maker(z: np.ndarray) -> np.ndarray:
    return np.eye(z.shape[0]) - z @ np.linalg.pinv(z) if z.shape[1] else np.eye(z.shape[0])


def permuted_design(x, c, perm, method: str, interaction: bool = False) -> np.ndarray:
    """The design under a permutation of its tested columns: ``ds`` permutes them, ``smith`` their part that the other columns
    do not explain. ``interaction``: a contrast over several blocks of one covariate keeps every block's rows to itself."""
    x = np.asarray(x, float).copy()
    tested, rest = partition(x, c)
    moved = x[:, tested] if method == "ds" else residual_maker(x[:, rest]) @ x[:, tested]
    moved = moved[np.asarray(perm)]
    if interaction:
        home = x[:, tested] != 0
        together = moved.sum(1)
        moved = np.where(home, together[:, None], 0.0)
    x[:, tested] = moved
    return x


def fast_form_holds(x, rz, exchanges) -> bool:
    """Whether residual sums may be taken from the norms of the data under exchanges that take nuisance out with ``rz``.

    The residual projector of the design must swallow ``rz`` (R Rz = R, to a tolerance), which fails where ``rz`` was made from columns
    that the fitted design does not span, as with whitening; and each exchange must be a pure permutation, or only signs, so that norms
    do not change.
    """
    x, exchanges = np.asarray(x, float), np.asarray(exchanges)
    r = residual_maker(x)
    if np.abs(r @ rz - r).max(initial=0) > 1e-5 * max(1.0, np.abs(r).max(initial=0)):
        return False
    if exchanges.shape[1] != len(x):
        return False
    return bool((np.sort(exchanges, 1) == np.arange(len(x))).all() or (np.abs(exchanges) == 1).all())


class Exchanged:
    """The statistic of any block of elements under one exchange; what does not depend on the data is made once.

    ``raw`` and ``freedman_lane`` exchange the data under the full design, which moves the columns of its pseudo-inverse. With ``rz`` (the residual
    maker of nuisance columns that the design need not span) Freedman-Lane takes nuisance out of the exchanged data explicitly, unless
    :func:`fast_form_holds`. ``ds`` and ``smith`` exchange the tested columns of the design; ``freedman_lane_exact`` exchanges the residuals of
    the nuisance model. With ``columns`` a covariate of each element's own replaces these columns, and is exchanged if it is tested,
    else the data are.
    """

    def __init__(self, x, c, exchange, signs: bool = False, method: str = "raw", interaction: bool = False, rz=None, columns=None, base: PermutedGLM | None = None, **options):
        self.x, self.c, self.exchange, self.signs, self.method, self.rz, self.columns, self.options = np.asarray(x, float), c, exchange, signs, method, rz, columns, options
        if method not in ("raw", "freedman_lane", "freedman_lane_exact", "ds", "smith"):
            raise ValueError(f"unknown nuisance method {method!r}")
        if columns is not None:
            return
        empty = np.zeros((0, len(self.x)))
        self.glm = base or PermutedGLM(empty, self.x, c, **options)
        self.inverse = self.glm.inverse
        if exchange is None:
            return
        if signs:
            self.inverse = self.glm.inverse * np.asarray(exchange, float)
        elif method in ("ds", "smith"):
            self.glm = PermutedGLM(empty, permuted_design(self.x, c, exchange, method, interaction), c, **options)
            self.inverse = self.glm.inverse
        elif method == "freedman_lane_exact":
            self.nuisance = residual_maker(self.x[:, partition(self.x, c)[1]])
        elif rz is None:
            self.inverse = self.glm.inverse[:, np.argsort(exchange)]

    def _data(self, y: np.ndarray, norms: np.ndarray | None) -> PermutedGLM:
        if self.exchange is not None and not self.signs:
            if self.method == "freedman_lane_exact":
                return self.glm.on((y @ self.nuisance)[:, self.exchange] + y @ (np.eye(len(self.x)) - self.nuisance))
            if self.rz is not None and self.method in ("raw", "freedman_lane"):
                return self.glm.on(y[:, self.exchange] @ self.rz)
        return self.glm.on(y, norms)

    def largest(self, y: np.ndarray, norms: np.ndarray | None = None, cov: np.ndarray | None = None) -> float:
        if self.columns is not None:
            raise ValueError("shrinkage with a covariate of each element is not supported")
        return self._data(y, norms).largest(self.inverse)

    def statistic(self, y: np.ndarray, norms: np.ndarray | None = None, largest: float | None = None, cov: np.ndarray | None = None) -> np.ndarray:
        if self.columns is not None:
            if self.signs and self.exchange is not None:
                y = y * np.asarray(self.exchange, float)
            return voxel_covariate_glm(y, cov, self.x, self.columns, self.c, None if self.signs else self.exchange)
        return self._data(y, norms).statistic(self.inverse, largest)


def prepared(x, c, exchanges, **options) -> list[Exchanged]:
    """:class:`Exchanged` of each of ``exchanges`` (None: the data as they are); the design is factorised once for all that leave it alone."""
    own = {k: v for k, v in options.items() if k in ("shrink", "eps_inside")}
    base = None if options.get("columns") is not None else PermutedGLM(np.zeros((0, len(x))), x, c, **own)
    return [Exchanged(x, c, e, base=base, **options) for e in exchanges]


def fit_nuisance(y, x, c, perm, method: str, **options) -> np.ndarray:
    """Statistic under a permutation with nuisance columns handled by ``raw`` (permute the data under the full design), ``ds``
    (Draper-Stoneman), ``smith``, ``freedman_lane`` (permute, then take the nuisance out: the same as raw) or
    ``freedman_lane_exact`` (permute the residuals of the nuisance model and add its fit)."""
    y, x = np.atleast_2d(np.asarray(y, float)), np.asarray(x, float)
    perm = np.asarray(perm)
    if method in ("raw", "freedman_lane"):
        return PermutedGLM(y, x, c, **options).fit(perm)
    if method == "freedman_lane_exact":
        z = x[:, partition(x, c)[1]]
        r = residual_maker(z)
        return PermutedGLM((y @ r)[:, perm] + y @ (np.eye(len(r)) - r), x, c, **options).fit()
    if method in ("ds", "smith"):
        return PermutedGLM(y, permuted_design(x, c, perm, method), c, **options).fit()
    raise ValueError(f"unknown nuisance method {method!r}")


def explicit_glm(y, x, c, shrink: float = SHRINK) -> np.ndarray:
    """The statistic by explicit residuals: the slow form that the fast one is checked against."""
    y, x = np.atleast_2d(np.asarray(y, float)), np.asarray(x, float)
    inverse = np.linalg.pinv(x)
    beta = y @ inverse.T
    ms = residual_squares(y, beta, x) / (x.shape[0] - np.linalg.matrix_rank(x))
    glm = PermutedGLM(y[:1], x, c)
    ms = ms + shrink * ms.max()
    if glm.is_t:
        return (beta @ glm.c[:, 0]) / (EPS + np.sqrt(ms * glm.variance))
    part = beta @ glm.basis
    return ((part @ glm.between) * part).sum(1) / glm.basis.shape[1] / ms


def residual_squares(y: np.ndarray, beta: np.ndarray, x: np.ndarray, block: int = 4096) -> np.ndarray:
    """Sums of squared residuals in double precision, a block of elements at a time."""
    out = np.empty(len(y))
    for k in range(0, len(y), block):
        r = y[k : k + block].astype(float) - beta[k : k + block] @ x.T
        out[k : k + block] = (r * r).sum(1)
    return out


def whiten(y, w) -> np.ndarray:
    """Data times the whitening matrix (observations by observations)."""
    return np.atleast_2d(np.asarray(y, float)) @ np.asarray(w, float)


def voxel_covariate_glm(y, cov, x, columns, c, perm=None, shrink: float = 0.0) -> np.ndarray:
    """Statistic with a covariate of each element's own: it replaces ``columns`` of the design in rows where they are above 0.

    Normal equations of all elements are solved together; elements whose system is singular are solved by pseudo-inverse. If the
    contrast loads one of the columns the covariate is permuted, else the data are.
    """
    y, cov, x = np.atleast_2d(np.asarray(y, float)), np.atleast_2d(np.asarray(cov, float)), np.asarray(x, float)
    if y.shape != cov.shape or y.shape[1] != x.shape[0]:
        raise ValueError("data, covariate and design differ in their observations")
    c = contrast_matrix(c, x.shape[1])
    columns = list(columns)
    if perm is not None:
        if np.abs(c[columns]).sum() > 0:
            cov = cov[:, np.asarray(perm)]
        else:
            y = y[:, np.asarray(perm)]
    n, r = x.shape
    out = np.zeros(len(y))
    basis = contrast_basis(c)
    ms_all, up = np.empty(len(y)), np.empty((len(y), basis.shape[1]))
    gains = np.empty((len(y), basis.shape[1], basis.shape[1]))
    for k in range(0, len(y), 2048):
        yy, cc = y[k : k + 2048], cov[k : k + 2048]
        xi = np.broadcast_to(x, (len(yy), n, r)).copy()
        for j in columns:
            rows = x[:, j] > 0
            xi[:, rows, j] = cc[:, rows]
        xtx = np.einsum("enr,ens->ers", xi, xi)
        xty = np.einsum("enr,en->er", xi, yy)
        values = np.linalg.eigvalsh(xtx)
        singular = ~(values[:, 0] > 1e-10 * values[:, -1])
        safe = np.where(singular[:, None, None], np.eye(r), xtx)
        beta = np.linalg.solve(safe, xty[..., None])[..., 0]
        inv = np.linalg.inv(safe)
        rank = np.full(len(yy), r)
        for i in np.flatnonzero(singular):
            p = np.linalg.pinv(xi[i])
            beta[i], inv[i], rank[i] = p @ yy[i], p @ p.T, np.linalg.matrix_rank(xi[i])
        residual = yy - np.einsum("enr,er->en", xi, beta)
        df = n - rank
        ms_all[k : k + 2048] = (residual**2).sum(1) / np.maximum(df, 1)
        up[k : k + 2048] = beta @ (c if c.shape[1] == 1 else basis)
        gains[k : k + 2048] = np.einsum("rq,ers,sp->eqp", c if c.shape[1] == 1 else basis, inv, c if c.shape[1] == 1 else basis)
    if shrink:
        ms_all = ms_all + shrink * ms_all[np.isfinite(ms_all)].max(initial=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        if c.shape[1] == 1:
            out = up[:, 0] / np.sqrt(ms_all * gains[:, 0, 0] + EPS)
        else:
            out = np.einsum("eq,eqp,ep->e", up, np.linalg.pinv(gains), up) / basis.shape[1] / ms_all
    return np.where(np.isfinite(out), out, 0.0)


def slot_patterns(slots: int) -> list[tuple[int, ...]]:
    """All partitions of ``slots`` places: the block of each place, blocks numbered as they first appear."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(slots):
        out = [s + (b,) for s in out for b in range(max(s, default=-1) + 2)]
    return out


def _without_means(m: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Means of the diagonal and of the rest, and the matrix without them."""
    n = len(m)
    diagonal = float(np.trace(m)) / n
    rest = (float(m.sum()) - n * diagonal) / (n * (n - 1)) if n > 1 else 0.0
    return diagonal, rest, m - rest - np.eye(n) * (diagonal - rest)


def trace_moments(a, w) -> tuple[float, float, float]:
    """Mean, variance and third central moment of trace(A W_P) over all simultaneous permutations of rows and columns of W, exactly.

    Diagonals are permuted among themselves, so taking the means of the diagonal and of the rest out of both matrices moves the trace by its
    mean and leaves central moments. A product of entries is then known by which of its indices are equal: a permutation maps
    distinct indices evenly to distinct ones, so a moment is a sum over those patterns, and sums over distinct indices are free sums with
    inclusion and exclusion of coarser patterns.
    """
    a, w = np.asarray(a, float), np.asarray(w, float)
    n = len(a)
    da, ra, a = _without_means(a)
    dw, rw, w = _without_means(w)

    def central(order: int) -> float:
        patterns = slot_patterns(2 * order)
        free = {}
        for s in patterns:
            letters = "".join(chr(97 + b) for b in s)
            spec = ",".join(letters[k : k + 2] for k in range(0, len(s), 2)) + "->"
            free[s] = np.array([np.einsum(spec, *[m] * order, optimize=order > 2) for m in (a, w.T)])
        total = 0.0
        for s in patterns:
            blocks = max(s) + 1
            if blocks > n:
                continue
            distinct = np.zeros(2)
            for merged in slot_patterns(blocks):
                sign = math.prod((-1) ** (merged.count(b) - 1) * math.factorial(merged.count(b) - 1) for b in set(merged))
                distinct += sign * free[tuple(merged[b] for b in s)]
            total += distinct.prod() / math.perm(n, blocks)
        return float(total)

    return n * da * dw + n * (n - 1) * ra * rw, central(2), central(3)
