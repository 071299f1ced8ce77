"""Brute-force numpy twins of the operators, written from their description."""

import math

import numpy as np


def gauss(x, sigma):
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    padded = np.pad(np.asarray(x, float), r, mode="symmetric")
    return np.array([padded[i:i + 2 * r + 1] @ w for i in range(len(x))])


def median_filter(x, k):
    p = np.pad(np.asarray(x, float), k // 2)
    return np.array([np.median(p[i:i + k]) for i in range(len(x))])


def run_list(mask):
    out, start = [], None
    for i, m in enumerate(list(mask) + [False]):
        if m and start is None:
            start = i
        if not m and start is not None:
            out.append((start, i))
            start = None
    return out


def greedy(frames, k):
    kept = []
    for f in sorted(frames):
        if not kept or f - kept[-1] >= k:
            kept.append(f)
    return kept


def minima(v):
    """Middle of every plateau lower than both sides."""
    out, i = [], 0
    while i < len(v):
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if i > 0 and j < len(v) - 1 and v[i - 1] > v[i] and v[j + 1] > v[i]:
            out.append((i + j) // 2)
        i = j + 1
    return out


def prune(pos, v, dist):
    kept = []
    for p in sorted(pos, key=lambda p: (v[p], -p)):
        if all(abs(p - q) >= dist for q in kept):
            kept.append(p)
    return sorted(kept)


def closed_ranges(g):
    n = len(g)
    if g.max() == g.min():
        return [], []
    sm = median_filter(g, max(3, min(15, n if n % 2 else n - 1)))
    mid = (np.percentile(sm, 5) + np.percentile(sm, 95)) / 2
    c = sm > mid
    if c.sum() > 0.6 * n:
        c = sm < mid
    raw = run_list(c)
    merged = []
    for a, b in (r for r in raw if r[1] - r[0] >= 20):
        if merged and a - merged[-1][1] < 30:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return raw, merged


def phases(act, state):
    """[(name, cycle, start, end)], number of cycles."""
    n, z = len(act), state[:, 2]
    _, ranges = closed_ranges(act[:, -1])
    out = []
    if not ranges:
        v = np.linalg.norm(np.diff(act[:, :3], axis=0), axis=1)
        v = gauss(v, 3) if len(v) > 3 else v
        cand = [p for p in minima(v) if v[p] <= np.percentile(v, 20)]
        cuts = [0] + prune(cand, v, max(10, n // 20)) + [n]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b - a >= 3:
                out.append((f"Motion{i + 1}" if i % 2 == 0 else f"Pause{i // 2 + 1}", 0, a, b))
        return out, 0
    prev = 0
    for c, (a, b) in enumerate(ranges):
        g = min(a + 3, b)
        peak, fall = g, b
        if b - g > 3:
            peak = g + int(np.argmax(z[g:b]))
            low = z[peak:b].min()
            fall = peak
            if z[peak] - low > 1e-4:
                fall = peak + int(np.argmax(z[peak:b] < z[peak] - 0.3 * (z[peak] - low)))
        r = min(b + 3, n)
        out += [("Approach", c, prev, a), ("Grasp", c, a, g), ("Lift", c, g, peak), ("Transit", c, peak, fall), ("Place", c, fall, b), ("Release", c, b, r)]
        prev = r
    out.append(("Return", len(ranges) - 1, prev, n))
    return [p for p in out if p[3] > p[2]], len(ranges)


def resample(x, n):
    return np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(x)), x)


def envelope_flags(eps):
    """{(episode, phase, cycle, channel): peak z} of flagged phases."""
    sig, dur = {}, {}
    for e, (a, s) in eps.items():
        ph, nc = phases(a, s)
        mags = {"position": np.linalg.norm(a[:, :3], axis=1), "rotation": np.linalg.norm(a[:, 3:6], axis=1)}
        for name, c, x, y in ph:
            if name in ("Grasp", "Release"):
                continue
            dur.setdefault((name, c, nc), []).append(y - x)
            if y - x >= 2:
                for ch, m in mags.items():
                    sig.setdefault((name, c, nc, ch), {})[e] = gauss(resample(m[x:y], 50), 2)
    out = {}
    for (name, c, nc, ch), per in sig.items():
        if len(per) < 6 or int(np.median(dur[(name, c, nc)])) < 15:
            continue
        x = np.stack(list(per.values()))
        for e, v in per.items():
            z = np.abs(v - x.mean(0)) / np.maximum(x.std(0), 1e-6)
            if max([b - a for a, b in run_list(z > 3)], default=0) >= 20:
                out[(e, name, c, ch)] = z[z > 3].max()
    return out


def features(act, state):
    n = len(act)
    raw, merged = closed_ranges(act[:, -1])
    d = np.diff(state[:, :3], axis=0)
    v = np.linalg.norm(d, axis=1)
    vs = gauss(v, 3) if len(v) > 3 else v
    sg = np.where(d < 0, -1, 1)
    p = state[:, :3]
    arc = v.sum()
    return [round(arc, 4), round(np.linalg.norm(np.diff(act[:, 3:6], axis=0), axis=1).sum(), 4), 2 * len(raw),
            sum(b - a >= 10 for a, b in run_list(vs < np.percentile(vs, 25))), round(np.ptp(p[:, 2]), 4), round(np.ptp(p[:, 0]) * np.ptp(p[:, 1]), 4),
            round(np.linalg.norm(p[-1] - p[0]) / arc, 4), round(sum(b - a for a, b in merged) / n, 4), int((np.diff(sg, axis=0) != 0).sum()), n]


def mahalanobis(x):
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)
    inv = np.linalg.pinv(np.cov(z, rowvar=False))
    return np.einsum("ij,jk,ik->i", z, inv, z)


def ward(z, k):
    """Members of k clusters by plain Ward linkage, one merge at a time, and their summed squared distances."""
    groups = [[i] for i in range(len(z))]
    while len(groups) > k:
        c, n = np.array([z[g].mean(0) for g in groups]), np.array([len(g) for g in groups])
        gap = n[:, None] * n[None] / (n[:, None] + n[None]) * ((c[:, None] - c[None]) ** 2).sum(-1)
        gap[np.tril_indices(len(groups))] = np.inf
        a, b = divmod(int(gap.argmin()), len(groups))
        groups[a] = groups[a] + groups.pop(b)
    return sorted(map(sorted, groups)), sum(((z[g] - z[g].mean(0)) ** 2).sum() for g in groups)


def smoothness(a):
    if len(a) < 4:
        return 0.5
    sd = a.std(0)
    v = np.diff(a / np.where(sd < 1e-8, 1, sd), axis=0)
    acc = np.diff(v, axis=0)
    jerk = np.linalg.norm(np.diff(acc, axis=0), axis=1).mean()
    flips = 1 - (np.diff(np.sign(acc), axis=0) != 0).mean() if len(acc) > 1 else 0.5
    p = np.abs(np.fft.rfft(v, axis=0)) ** 2
    low = p[:len(p) // 2].sum() / p.sum() if p.sum() > 1e-10 else 0.5
    return float(np.clip(0.4 * np.clip(1 - jerk / 0.5, 0, 1) + 0.3 * flips + 0.3 * low, 0, 1))


def events(a):
    """Merged quality events: [(frame, type, severity)]."""
    n = len(a)
    if n < 5:
        return []
    found = []
    g, m = a[:, -1], a[:, :-1]
    v = np.diff(m, axis=0)
    sp = np.linalg.norm(v, axis=1)
    found += [(f, "gripper", 3, 1.0, 1) for f in range(1, n) if g[f - 1] * g[f] < 0]
    if sp.mean() >= 1e-6:
        for s, e in run_list(sp < np.percentile(sp, 20) * 0.5):
            if e - s >= 2 and e < len(sp):
                found.append((s + 1, "pause", 1 if e - s < 5 else 3, float(np.clip(1 - sp[s:e].mean() / sp.mean(), 0, 1)), 2))
    if n >= 4:
        vs = np.stack([np.convolve(v[:, d], [0.25, 0.5, 0.25], mode="same") for d in range(v.shape[1])], axis=1) if len(v) > 3 else v
        for t in range(1, len(vs) - 1):
            p, q = np.linalg.norm(vs[t - 1]), np.linalg.norm(vs[t])
            if p > 0.01 and q > 0.01:
                c = vs[t - 1] @ vs[t] / (p * q + 1e-8)
                if c < math.cos(math.radians(60)):
                    deg = math.degrees(math.acos(np.clip(c, -1, 1)))
                    found.append((t + 1, "direction_change", 3 if deg > 120 else 2 if deg > 90 else 1, deg / 180, 3))
    acc = np.diff(v, axis=0)
    if n >= 6:
        j = np.linalg.norm(np.diff(acc, axis=0), axis=1)
        if j.mean() >= 1e-8:
            for t in greedy([t for t in range(len(j)) if j[t] > np.percentile(j, 95)], 3):
                found.append((t + 3, "high_jerk", 2 if j[t] / j.mean() > 3 else 1, min(1, j[t] / j.mean() / 5), 4))
    if n >= 10:
        ac = np.linalg.norm(acc, axis=1)
        th = np.percentile(ac, 90)
        if ac.mean() >= 1e-8:
            for t in greedy([t for t in range(len(ac) - 5) if ac[t] > th and ac[t + 1:t + 5].mean() < 0.3 * th], 5):
                found.append((t + 2, "recovery", 3 if ac[t] / ac.mean() > 3 else 2, min(1, ac[t] / ac.mean() / 5), 5))
        for t in greedy([i for i in range(2, n - 3) if (g[i] - g[i - 2]) * (g[i + 2] - g[i]) < -0.1], 5):
            found.append((t, "near_miss", 2, 0.8, 6))
    found.sort(key=lambda e: (e[0], e[4]))
    out = []
    while found:
        head = [e for e in found if e[0] - found[0][0] <= 2]
        found = found[len(head):]
        b = min(head, key=lambda e: (-e[2], -e[3]))
        out.append((b[0], b[1], {3: "significant", 2: "warning", 1: "info"}[b[2]]))
    return out


def divergence(eps):
    """{episode: score} against the task median over 100 bins."""
    x = {e: np.stack([resample(a[:, d], 100) for d in range(a.shape[1])], axis=1) for e, (a, _) in eps.items() if len(a) >= 5}
    t = np.stack(list(x.values()))
    med, sd = np.median(t, 0), np.maximum(t.std(0), 1e-6)
    return {e: min(1.0, float(np.sqrt((((v - med) / sd) ** 2).mean(1)).mean() / 2)) for e, v in x.items()}
