"""Plain numpy versions used to check the Spark operators."""

from __future__ import annotations

import numpy as np


def km(time, event):
    out, s = [], 1.0
    for t in np.unique(time):
        n, d = (time >= t).sum(), ((time == t) & event).sum()
        s *= 1 - d / n
        out.append((int(t), int(n), int(d), s))
    return out


def logrank(time, event, high):
    o = e = v = 0.0
    for t in np.unique(time[event]):
        n, n1 = (time >= t).sum(), ((time >= t) & high).sum()
        d = ((time == t) & event).sum()
        o += ((time == t) & event & high).sum()
        e += d * n1 / n
        if n > 1:
            v += d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)
    return o, e, v


def efron(beta, x, time, event):
    """Partial log-likelihood with Efron ties."""
    eta = x @ beta
    r = np.exp(eta)
    ll = 0.0
    for t in np.unique(time[event]):
        dead = (time == t) & event
        d, s, sd = dead.sum(), r[time >= t].sum(), r[dead].sum()
        ll += eta[dead].sum() - sum(np.log(s - k / d * sd) for k in range(d))
    return ll


def maximize(f, p, steps=60):
    """Newton steps with numeric derivatives."""
    beta, h = np.zeros(p), 1e-4
    eye = np.eye(p) * h
    for _ in range(steps):
        g = np.array([(f(beta + a) - f(beta - a)) / (2 * h) for a in eye])
        hess = np.array([[(f(beta + a + b) - f(beta + a - b) - f(beta - a + b) + f(beta - a - b))
                          / (4 * h * h) for b in eye] for a in eye])
        move = np.linalg.solve(hess, -g)
        beta = beta + move
        if np.abs(move).max() < 1e-8:
            break
    return beta, np.linalg.inv(-hess)


def concordance(time, event, risk):
    comparable = concordant = tied = 0
    for i in range(len(time)):
        if not event[i]:
            continue
        later = (time > time[i]) | ((time == time[i]) & ~event)
        comparable += later.sum()
        concordant += (later & (risk < risk[i])).sum()
        tied += (later & (risk == risk[i])).sum()
    return int(comparable), int(concordant), int(tied)


def q_values(p):
    p = np.asarray(p, dtype=float)
    order = np.argsort(p, kind="stable")
    q = p[order] * len(p) / np.arange(1, len(p) + 1)
    q = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1.0)
    out = np.empty(len(p))
    out[order] = q
    return out
