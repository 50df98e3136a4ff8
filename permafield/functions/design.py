"""Recognition of an experiment from its design matrix, and permutation schemes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from permafield.functions.linear import contrast_basis, contrast_matrix


@dataclass
class Design:
    """A design with the roles of its columns: conditions, covariates, blocks (subjects) and nuisance."""

    x: np.ndarray
    conditions: list[int] = field(default_factory=list)
    covariates: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    nuisance: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.x = np.asarray(self.x, float)
        named = [*self.conditions, *self.covariates, *self.blocks, *self.nuisance]
        if len(set(named)) != len(named) or any(not 0 <= k < self.x.shape[1] for k in named):
            raise ValueError("column roles overlap or name a column that is not there")


@dataclass
class Scheme:
    """How observations are exchanged: ``kind`` regression, sign_flip or groups; ``labels`` and ``blocks`` per used observation."""

    kind: str
    n_cond: int
    used: np.ndarray
    labels: np.ndarray
    blocks: np.ndarray | None
    method: str
    interaction: bool = False
    half: bool = False
    effects_of_interest: bool = False


def split_factors(x, columns: list[int]) -> list[list[int]]:
    """Condition columns by factor: a factor ends where its columns sum to a constant over all observations. Over two: an error."""
    found: list[list[int]] = []
    own: list[int] = []
    for c in columns:
        own.append(c)
        total = np.asarray(x)[:, own].sum(1)
        if np.ptp(total) == 0 and total[0] != 0:
            found.append(own)
            own = []
    if own:
        found.append(own)
    if len(found) > 2:
        raise ValueError("designs of more than two factors are not supported")
    return found


def block_labels(x, columns: list[int]) -> np.ndarray:
    """Block of each observation, from columns of which exactly one is set in each row; blocks of one observation are refused."""
    part = np.asarray(x)[:, columns] != 0
    if (part.sum(1) != 1).any():
        raise ValueError("every observation must lie in exactly one block")
    return check_blocks(part.argmax(1) + 1)


def check_blocks(values) -> np.ndarray:
    """Exchangeability labels renumbered from 1: finite whole numbers, and some block of two or more observations."""
    v = np.asarray(values, float)
    if v.ndim != 1 or not np.isfinite(v).all() or (v != np.round(v)).any():
        raise ValueError("block labels must be finite whole numbers, one for each observation")
    _, label, count = np.unique(v, return_inverse=True, return_counts=True)
    if (count < 2).all():
        raise ValueError("every block has a single observation: nothing can be exchanged")
    return label + 1


def recognise(design: Design, c, supplied_blocks=None, method: str = "smith") -> Scheme:
    """The scheme for a contrast: what is exchanged, within which blocks, and how nuisance is handled."""
    x = design.x
    c = contrast_matrix(c, x.shape[1])
    rank = contrast_basis(c).shape[1]
    view = c[:, 0] if rank == 1 else None
    used_columns = np.flatnonzero(np.abs(c).sum(1) > 0)
    if set(used_columns.tolist()) & set(design.blocks):
        raise ValueError("contrasts on block columns are refused")
    if not len(used_columns):
        raise ValueError("the contrast is zero")
    conditions = [k for k in used_columns.tolist() if k in design.conditions]
    effects = rank > 1 and c.shape[1] == len(used_columns) and np.array_equal(c[used_columns], np.eye(len(used_columns)))
    if len(used_columns) == 1:
        n_cond = 1 if conditions else 0
    elif rank > 1:
        n_cond = len(conditions) if effects or len(conditions) > 1 else 0
    else:
        values = view[used_columns]
        n_cond = max((sum(1 for k in conditions if view[k] == v) > 0) * len({view[k] for k in conditions}) for v in values)
    if n_cond == 1 and len(used_columns) > 1:
        n_cond = 0 if not conditions else n_cond
    used = np.flatnonzero((x[:, used_columns] != 0).any(1)) if n_cond != 0 else np.arange(len(x))
    blocks = block_labels(x, design.blocks) if design.blocks else None
    repeated = blocks is not None
    if supplied_blocks is not None and n_cond != 1:
        blocks = check_blocks(supplied_blocks)
    elif n_cond == 1:
        blocks = None
    if n_cond == 0:
        labels = np.arange(1, len(used) + 1)
    elif n_cond == 1:
        labels = np.ones(len(used), int)
    else:
        groups = (x[np.ix_(used, conditions)] != 0).argmax(1) + 1
        if view is not None:
            _, groups = np.unique(view[np.asarray(conditions)][groups - 1], return_inverse=True)
            groups = groups + 1
        labels = groups
    hit = [k for k in range(x.shape[1]) if k not in used_columns and k not in design.blocks]
    z = x[:, hit]
    interaction = n_cond == 0 and len(used_columns) > 1 and bool(((x[:, used_columns] != 0).sum(1) == 1).all())
    none = not design.covariates or not z.size or not z.any() or bool((z == z[0]).all()) or (interaction and len(design.covariates) == len(used_columns))
    anova = repeated and n_cond > 1
    half = n_cond == 2 and rank == 1 and not repeated and supplied_blocks is None and len(set(np.bincount(labels)[1:].tolist())) == 1
    kind = "sign_flip" if n_cond == 1 else "regression" if n_cond == 0 else "groups"
    return Scheme(kind, n_cond, used, labels, None if blocks is None else blocks[used], "ds" if none or anova else method, interaction, half, effects)


def possible(scheme: Scheme) -> int:
    """The number of different exchanges, exactly."""
    n = len(scheme.used)
    if scheme.kind == "sign_flip":
        return 2**n
    if scheme.blocks is not None and scheme.n_cond != 0:
        return math.prod(math.factorial(int(k)) for k in np.bincount(scheme.blocks)[1:])
    if scheme.kind == "regression":
        return math.prod(math.factorial(int(k)) for k in np.bincount(scheme.blocks)[1:]) if scheme.blocks is not None else math.factorial(n)
    return math.factorial(n) // math.prod(math.factorial(int(k)) for k in np.bincount(scheme.labels)[1:])


def draw(scheme: Scheme, n_perm: int, seed: int = 0, include_identity: bool = True, half: bool = False, tries: int = 100_000) -> np.ndarray:
    """Different exchanges, a row each: signs for a one-sample scheme, else the observation that each place takes.

    Observations move within their blocks only; within each group of equal labels they stay in order, so equal relabellings
    coincide and are drawn once (with ``half``, mirrored ones too). Fewer rows are returned when ``tries`` draws in a row bring
    nothing new.
    """
    rng = np.random.Generator(np.random.Philox(seed))
    n = len(scheme.used)
    want = min(n_perm, possible(scheme))
    rows: list[np.ndarray] = []
    seen: set[bytes] = set()

    def offer(row: np.ndarray) -> bool:
        keys = [row.tobytes()]
        if half and scheme.kind == "groups":
            order = np.argsort(scheme.labels, kind="stable")
            a, b = np.split(row[order], 2)
            mirror = np.empty_like(row)
            mirror[order] = np.concatenate([b, a])
            keys.append(mirror.tobytes())
        if any(k in seen for k in keys):
            return False
        seen.add(keys[0])
        rows.append(row)
        return True

    identity = np.ones(n, np.int64) if scheme.kind == "sign_flip" else np.arange(n)
    if include_identity:
        offer(identity)
    else:
        seen.add(identity.tobytes())
    failed = 0
    while len(rows) < want and failed < tries:
        if scheme.kind == "sign_flip":
            row = rng.choice(np.array([-1, 1]), n)
        else:
            row = np.arange(n)
            for b in np.unique(scheme.blocks) if scheme.blocks is not None else [None]:
                at = np.arange(n) if b is None else np.flatnonzero(scheme.blocks == b)
                row[at] = at[rng.permutation(len(at))]
            cells = scheme.labels if scheme.blocks is None else scheme.labels * (int(scheme.blocks.max()) + 1) + scheme.blocks
            for g in np.unique(cells):
                at = np.flatnonzero(cells == g)
                row[at] = np.sort(row[at])
        failed = 0 if offer(row) else failed + 1
    return np.array(rows)


def verify(rows, blocks=None, signs: bool = False) -> None:
    """Raise unless every row is ±1 only, or a permutation that keeps every observation in its block."""
    for k, row in enumerate(np.asarray(rows)):
        if signs:
            if not np.isin(row, (-1, 1)).all():
                raise ValueError(f"row {k} holds something other than a sign")
        elif not np.array_equal(np.sort(row), np.arange(len(row))):
            raise ValueError(f"row {k} is no permutation")
        elif blocks is not None and (np.asarray(blocks)[row] != np.asarray(blocks)).any():
            raise ValueError(f"row {k} leaves its blocks")


def exchange_matrix(row, used, n: int, signs: bool = False) -> np.ndarray:
    """The exchange as an n by n matrix; rows of observations outside the contrast are zero."""
    p = np.zeros((n, n))
    used = np.asarray(used)
    p[used, used if signs else used[np.asarray(row)]] = np.asarray(row) if signs else 1
    return p


def default_exponents(kind: str) -> tuple[float, float]:
    """E and H for volumes (0.5, 2), and for meshes and skeletons (1, 2)."""
    if kind not in ("volume", "mesh", "skeleton"):
        raise ValueError(f"unknown kind of map {kind!r}")
    return (0.5, 2.0) if kind == "volume" else (1.0, 2.0)


def connectivity_of(structure) -> int:
    """6, 18 or 26 from a 3 by 3 by 3 structuring element."""
    s = np.asarray(structure, bool)
    if s.shape != (3, 3, 3) or not s[1, 1, 1]:
        raise ValueError("a structuring element is 3 x 3 x 3 with its centre set")
    n = int(s.sum()) - 1
    if n not in (6, 18, 26):
        raise ValueError(f"a structuring element has 6, 18 or 26 neighbours, not {n}")
    return n
