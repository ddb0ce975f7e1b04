"""Seating of a hierarchical Pitman-Yor model over bytes; array code without Spark.

Restaurants are contexts of up to DEPTH bytes; dropping the oldest byte leads to the
parent, so contexts with a common ending share their parents. Keys hold a context and
the byte after it: depth d uses the low d + 1 bytes.
"""

from __future__ import annotations

import math

import numpy as np

DEPTH = 5
DISCOUNT, STRENGTH = 0.75, 0.5
#: Turns of the sampler through all levels before the samples that are averaged, and sweeps of a level in a turn.
BURN, SAMPLES, SWEEPS = 3, 4, 3
#: Customers up to which a dish's number of tables is drawn from a list of all; proposed tables from which it is normal.
LISTED, MANY = 64, 12
#: Steps on the log scale that a sweep tries for the gamma variable of a restaurant of more than WIDE customers.
STEPS, WIDE = (0.5, 0.12), 24


def _stirling() -> np.ndarray:
    """[c, t]: log of the weight of all seatings of c customers at t tables, a table of n weighing (1 - DISCOUNT)(2 - DISCOUNT)...(n - 1 - DISCOUNT)."""
    out = np.full((LISTED + 1, LISTED + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, LISTED + 1)
    for c in range(LISTED):
        with np.errstate(divide="ignore"):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.log(np.maximum(0, c - DISCOUNT * t)) + out[c, 1:])
    return out


_WAYS = _stirling()


def _listed(customers: np.ndarray, theta: np.ndarray, rng) -> np.ndarray:
    """Tables of dishes of few customers, drawn in proportion to theta^tables times the ways to fill them."""
    out = np.ones(len(customers), np.int64)
    low = 1
    for width in (4, 16, LISTED):
        rows = np.flatnonzero((customers > low) & (customers <= width))
        for some in np.array_split(rows, len(rows) * width // (1 << 21) + 1):
            log = _WAYS[customers[some], 1 : width + 1] + np.log(theta[some])[:, None] * np.arange(1, width + 1)
            sums = np.cumsum(np.exp(log - log.max(axis=1, initial=-np.inf)[:, None]), axis=1)
            out[some] = 1 + (sums <= (rng.random(len(some)) * sums[:, -1])[:, None]).sum(axis=1)
        low = width
    return out


def _stable() -> tuple[np.ndarray, np.ndarray]:
    """log z and the log density at z of the positive stable law of index DISCOUNT: Zolotarev's integral, and the series where that is sharp."""
    d = DISCOUNT
    angle = (np.arange(4000) + 0.5) * np.pi / 4000
    log_a = (d * np.log(np.sin(d * angle)) + (1 - d) * np.log(np.sin((1 - d) * angle)) - np.log(np.sin(angle))) / (1 - d)
    near, far = np.linspace(-2.5, 3, 300), np.linspace(3.02, 12, 300)
    inner = log_a - np.exp(log_a - (d / (1 - d)) * near[:, None])
    top = inner.max(axis=1)
    close = np.log(d / (1 - d)) - near / (1 - d) + top + np.log(np.exp(inner - top[:, None]).mean(axis=1))
    tail = sum((-1) ** (k + 1) * math.gamma(k * d + 1) / math.factorial(k) * math.sin(math.pi * k * d) * np.exp(-(k * d + 1) * far) for k in range(1, 13))
    return np.concatenate((near, far)), np.concatenate((close, np.log(tail / np.pi)))


_STABLE = _stable()
_NODES, _SHARES = np.polynomial.hermite_e.hermegauss(5)


def _log_ways(customers: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """log of the sum over t of theta^t times the ways to seat that many customers at t tables, but for terms of the customers alone.

    Few customers: the list. More: G(theta) = exp(theta / d) E[(b s)^c exp(-b s)], s positive
    stable of index d and b = (theta / d)^(1 / d), where b s keeps near c: five nodes; or,
    where many customers sit alone, the saddle point of the generating function.
    """
    d, log_theta = DISCOUNT, np.log(theta)
    out = log_theta.copy()
    low = 1
    for width in (4, 16, LISTED):
        rows = np.flatnonzero((customers > low) & (customers <= width))
        for some in np.array_split(rows, len(rows) * width // (1 << 21) + 1):
            log = _WAYS[customers[some].astype(np.int64), 1 : width + 1] + log_theta[some][:, None] * np.arange(1, width + 1)
            top = log.max(axis=1, initial=-np.inf)
            out[some] = top + np.log(np.exp(log - top[:, None]).sum(axis=1))
        low = width
    rows = np.flatnonzero(customers > LISTED)
    c, th, log_th = customers[rows].astype(float), theta[rows], log_theta[rows]
    y = _tilt(c, th)
    alone = c * y > 8
    n, t, z = c[alone], th[alone], y[alone]
    x = -np.expm1(np.log(z))
    out[rows[alone]] = t * (1 - z**d) / d - n * np.log(x) - 0.5 * np.log(2 * np.pi * (n + t * (1 - d) * x * x * z ** (d - 2)))
    n, t = c[~alone], th[~alone]
    log_b = (log_th[~alone] - np.log(d)) / d
    log_z, log_f = _STABLE
    at = np.log(n + 0.5)[:, None] + _NODES / np.sqrt(n)[:, None] - log_b[:, None]
    inner = np.interp(at, log_z, log_f) - (1 + d) * np.maximum(0, at - log_z[-1])
    top = inner.max(axis=1, initial=-np.inf)
    out[rows[~alone]] = t / d - log_b + top + np.log((np.exp(inner - top[:, None]) * _SHARES).sum(axis=1) / _SHARES.sum())
    return out


def _log_size(n: np.ndarray) -> np.ndarray:
    """log of Gamma(n - DISCOUNT) / Gamma(n), n at least 1."""
    shift = sum(np.log((n + k) / (n + k - DISCOUNT)) for k in range(8))
    a, b = n + 8 - DISCOUNT, n + 8
    half = lambda z: (z - 0.5) * np.log(z) - z + 1 / (12 * z) - 1 / (360 * z**3)
    return shift + half(a) - half(b)


def _tilt(customers: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """y of (1 - y) * y^(DISCOUNT - 1) = customers / theta: with it, that many customers are expected."""
    goal = np.log(customers / theta)
    w = np.maximum(goal / (1 - DISCOUNT), np.exp(np.minimum(goal, 0) - (1 - DISCOUNT)))
    for _ in range(9):  # Newton on -log y, from below a concave function's root
        w -= (np.log(-np.expm1(-w)) + (1 - DISCOUNT) * w - goal) / (1 / np.expm1(w) + 1 - DISCOUNT)
    return np.exp(-w)


def _drawn(n: np.ndarray, theta: np.ndarray, tables: np.ndarray, last: np.ndarray, rng) -> None:
    """Redraws, in place, the tables of dishes of many customers, and the customers of one of the tables.

    All tables but one are proposed at once, as a Poisson number of Sibuya sizes tilted by
    x; the last one takes the rest, and its weight in proportion to its size decides (an
    independence move). Where MANY or more would be proposed, few would fit, and the number
    is normal, its mean and variance the derivatives of the log weight of all seatings.
    """
    y = _tilt(n, theta)
    many = theta >= DISCOUNT * MANY
    step = 0.02
    less, here, more = (_log_ways(n, theta * np.exp(k * step)) for k in (-1, 0, 1))
    mean, spread = (more - less) / (2 * step), (more - 2 * here + less) / step**2
    normal = np.rint(mean + np.sqrt(np.maximum(spread, 0)) * rng.standard_normal(len(n)))
    # also for dishes without a state of the move yet, until a proposal of theirs fits
    free = many | (last == 0)
    tables[free] = np.clip(normal, 1, n)[free].astype(np.int64)
    last[many] = 0
    rows = np.flatnonzero(~many)
    for some in np.array_split(rows, int(theta[rows].sum() / DISCOUNT) // (1 << 20) + 1):
        proposed = rng.poisson(theta[some] / DISCOUNT)
        of = np.repeat(np.arange(len(some)), proposed)
        p = rng.beta(DISCOUNT, 1 - DISCOUNT, len(of))
        with np.errstate(divide="ignore"):
            size = np.maximum(1, np.ceil(np.log1p(-rng.random(len(of))) / np.log1p(-p)))
        log_x = np.log1p(-y[some])
        kept = np.log1p(-rng.random(len(of))) < size * log_x[of]
        rest = n[some] - np.bincount(of, weights=np.where(kept, size, 0), minlength=len(some))
        weight = lambda r, log_x=log_x: _log_size(np.maximum(r, 1)) + r * log_x
        ahead = np.where(last[some] > 0, weight(rest) - weight(last[some]), 0.0)
        go = (rest >= 1) & (np.log1p(-rng.random(len(some))) < ahead)
        tables[some[go]] = 1 + np.bincount(of[kept], minlength=len(some))[go]
        last[some[go]] = rest[go]


def _start(rest: np.ndarray, customers: np.ndarray, parent: np.ndarray, number: int) -> np.ndarray:
    """Tables of all restaurants to start from: one a dish, or, above WIDE customers, the total that its own gamma's mean gives back.

    From one table a dish the sweeps would gain but a few tables each, and never reach the
    thousands that large restaurants have.
    """
    ones = np.bincount(rest, minlength=number).astype(float)
    total = np.bincount(rest, weights=customers, minlength=number)
    big = np.flatnonzero(total > WIDE)
    own = np.flatnonzero((total > WIDE)[rest])
    of, n, base = np.searchsorted(big, rest[own]), customers[own].astype(float), np.maximum(parent[own], 1e-12)
    low, high = np.log(ones[big]), np.log(total[big])
    for _ in range(12):
        middle = (low + high) / 2
        theta = DISCOUNT * (STRENGTH / DISCOUNT + np.exp(middle))[of] * base
        mean = np.minimum(n, 1 + theta * (1 - _tilt(n, theta) ** DISCOUNT) / DISCOUNT)
        more = np.bincount(of, weights=mean, minlength=len(big)) > np.exp(middle)
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    ones[big] = np.exp((low + high) / 2)
    return ones


def gibbs(rest: np.ndarray, customers: np.ndarray, parent: np.ndarray, rng, state: dict | None = None, sweeps: int = SWEEPS) -> tuple[np.ndarray, dict]:
    """A sample of each dish's number of tables, and the state to go on from.

    rest: restaurant of each dish (0, 1, ...); customers: of each dish; parent: the
    parent's probability of the dish. A sweep seats every customer again: given a gamma
    variable of the restaurant, of shape STRENGTH / DISCOUNT + tables, its dishes are
    independent, and t tables of a dish have the weight theta^t times the ways to fill
    them, theta = DISCOUNT * gamma * parent. In a restaurant of more than WIDE customers
    the tables would hold the gamma variable back, so there it moves with the tables summed out.
    """
    number = int(rest[-1]) + 1 if len(rest) else 0
    rows = np.flatnonzero((customers > 1) & (customers <= LISTED))  # one customer alone always sits at one table
    large = np.flatnonzero(customers > LISTED)
    wide = np.bincount(rest, weights=customers, minlength=number) > WIDE
    own = np.flatnonzero(wide[rest])
    of = (np.cumsum(wide) - 1)[rest[own]]
    if state is None:
        state = {"whole": _start(rest, customers, parent, number), "last": np.zeros(len(rest)), "tables": np.ones(len(rest), np.int64)}
        state["log"] = np.log(STRENGTH / DISCOUNT + state["whole"])
    tables = np.minimum(state["tables"], customers)
    # a table that is larger than its dish has become is no state to go on from
    n, last = customers[large].astype(float), state["last"][large]
    last[last > n - tables[large] + 1] = 0
    some, whole, log_g = tables[large], state["whole"], state["log"]
    tables[customers == 1] = 1

    def level(x):
        ways = _log_ways(customers[own], np.maximum(DISCOUNT * np.exp(x)[of] * parent[own], 1e-12))
        return STRENGTH / DISCOUNT * x - np.exp(x) + np.bincount(of, weights=ways, minlength=len(x))

    x = log_g[wide]
    now = level(x)
    for _ in range(sweeps):
        for step in STEPS if len(x) else ():
            tried = x + step * rng.standard_normal(len(x))
            then = level(tried)
            go = np.log1p(-rng.random(len(x))) < then - now
            x, now = np.where(go, tried, x), np.where(go, then, now)
        g = rng.gamma(STRENGTH / DISCOUNT + whole)
        g[wide] = np.exp(x)
        theta = np.maximum(DISCOUNT * g[rest] * parent, 1e-12)
        tables[rows] = _listed(customers[rows], theta[rows], rng)
        _drawn(n, theta[large], some, last, rng)
        tables[large] = some
        whole = np.bincount(rest, weights=tables, minlength=number)
    kept = np.zeros(len(rest))
    kept[large] = last
    return tables, {"whole": whole, "last": kept, "tables": tables.copy(), "log": np.log(np.maximum(g, 1e-300))}


def predictive(rest: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each dish the discounted mass, of each restaurant the weight of its parent."""
    n = int(rest[-1]) + 1 if len(rest) else 0
    c, t = np.bincount(rest, weights=customers, minlength=n), np.bincount(rest, weights=tables, minlength=n)
    return (customers - DISCOUNT * tables) / (STRENGTH + c[rest]), (STRENGTH + DISCOUNT * t) / (STRENGTH + c)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    del order
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def mask(depth: int) -> int:
    return (1 << 8 * (depth + 1)) - 1


def levels(keys: np.ndarray, counts: np.ndarray, lowest: int) -> dict:
    """Dishes (keys, direct counts, restaurant numbers) of depths DEPTH to lowest.

    Every context is a restaurant; only those of DEPTH have direct customers.
    """
    out = {}
    k, c = keys, counts
    for depth in range(DEPTH, lowest - 1, -1):
        if depth < DEPTH:
            k, _ = summed(k & mask(depth), c)
            c = np.zeros(len(k), np.int64)
        out[depth] = (k, c, np.cumsum(np.diff(k >> 8, prepend=-1) != 0) - 1)
    return out


def seat(found: dict, lowest: int, top, seed: int) -> tuple[dict, np.ndarray]:
    """By depth, discounted masses of the dishes and parents' weights of the restaurants, and the lowest depth's tables: a column a sample.

    top(keys): the probabilities that the level above the lowest depth gives. A turn seats
    the levels from the longest contexts up, each table sending a customer to the parent,
    then gives every level its parents' probabilities in that same seating.
    """
    rng = np.random.default_rng(seed)
    depths = range(lowest, DEPTH + 1)
    at = {d: np.searchsorted(found[d - 1][0], found[d][0] & mask(d - 1)) for d in depths if d > lowest}
    up = {lowest: top(found[lowest][0])}
    for depth in depths:  # before any seating: every dish at one table
        keys, own, rest = found[depth]
        c = np.maximum(1, own)
        total = np.bincount(rest, weights=c)[rest] if len(rest) else c
        n = np.bincount(rest)[rest] if len(rest) else c
        if depth < DEPTH:
            up[depth + 1] = ((c - DISCOUNT) / (STRENGTH + total) + (STRENGTH + DISCOUNT * n) / (STRENGTH + total) * up[depth])[at[depth + 1]]
    state: dict = {}
    samples, sent = [], []
    for turn in range(BURN + SAMPLES):
        now: dict = {}
        for depth in reversed(depths):
            keys, own, rest = found[depth]
            customers = own if depth == DEPTH else np.bincount(at[depth + 1], weights=tables, minlength=len(keys)).astype(np.int64)
            tables, state[depth] = gibbs(rest, customers, up[depth], rng, state.get(depth))
            now[depth] = predictive(rest, customers, tables)
        for depth in range(lowest, DEPTH):
            a, b = now[depth]
            up[depth + 1] = (a + b[found[depth][2]] * up[depth])[at[depth + 1]]
        if turn >= BURN:
            samples.append(now)
            sent.append(tables)
    best = {d: tuple(np.stack([x[d][k] for x in samples], axis=1) for k in (0, 1)) for d in depths}
    return best, np.stack(sent, axis=1)


def hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """A read-only hash table from 64-bit keys to floats or rows of floats: bits, slots' keys (-1: free), slots' values.

    Plain arrays, so a broadcast of it needs no class on the executors.
    """
    bits = max(4, (len(keys) * 4 // 3).bit_length())
    slots, held = np.full(1 << bits, -1, np.int64), np.zeros((1 << bits, *values.shape[1:]), np.float32)
    at, todo = _slot(keys, bits), np.arange(len(keys))
    while len(todo):
        spot = at[todo]
        free = np.flatnonzero(slots[spot] == -1)
        # of several keys for one slot the last one written has it
        slots[spot[free]] = keys[todo[free]]
        won = slots[at[todo]] == keys[todo]
        held[at[todo[won]]] = values[todo[won]]
        todo = todo[~won]
        at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
    return bits, slots, held


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def get(table: tuple[int, np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The values; NaN where a key is missing."""
    bits, slots, held = table
    at = _slot(keys, bits)
    out = np.full((len(keys), *held.shape[1:]), np.nan, np.float32)
    there = slots[at]
    hit = there == keys
    out[hit] = held[at[hit]]
    todo = np.flatnonzero(~hit & (there != -1))
    at = at[todo]
    while len(todo):
        at = (at + 1) & ((1 << bits) - 1)
        there = slots[at]
        hit = there == keys[todo]
        out[todo[hit]] = held[at[hit]]
        go = ~hit & (there != -1)
        todo, at = todo[go], at[go]
    return out
