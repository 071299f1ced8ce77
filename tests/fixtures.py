"""Planted trajectories with a fixed seed."""

import numpy as np

FRAME_SCHEMA = "dataset_id string, task_index long, episode_index long, frame_index long, ts double, action array<double>, state array<double>"


def cycle_episode(rng, close=30, hold=40, tail=30, approach=30, noise=0.01, cycles=1, place_stretch=1):
    """Approach, grasp, lift, transit, place, return: (actions T x 7, states T x 8)."""
    acts, pos, grip = [], [], []
    z, x = 0.2, 0.0
    for _ in range(cycles):
        lift, transit, place = hold // 4, hold // 2, hold // 4 * place_stretch
        for part, n in (("approach", approach), ("lift", lift), ("transit", transit), ("place", place), ("rest", tail)):
            for i in range(n):
                if part == "approach":
                    z = 0.2 - 0.1 * i / n
                if part == "lift":
                    z = 0.1 + 0.4 * i / n
                if part == "transit":
                    z, x = 0.5, x + 0.01
                if part == "place":
                    z = 0.5 - 0.4 * i / n
                pos.append((x, 0.3 * x, z))
                grip.append(1.0 if part in ("lift", "transit", "place") else -1.0)
    p = np.array(pos)
    t = len(p)
    state = np.zeros((t, 8))
    state[:, :3] = p + rng.normal(0, noise * 0.05, (t, 3))
    act = np.zeros((t, 7))
    act[:, :3] = np.vstack([np.zeros(3), np.diff(state[:, :3], axis=0)]) * 10 + rng.normal(0, noise, (t, 3))
    act[:, 3:6] = 0.1 * np.sin(np.arange(t)[:, None] / 7.0 + np.arange(3)) + rng.normal(0, noise, (t, 3))
    act[:, 6] = grip
    return act, state


def cohort(n=40, seed=0, rest=30, **kw):
    rng = np.random.default_rng(seed)
    return {i: cycle_episode(rng, approach=rest + int(rng.integers(-2, 3)), tail=rest + int(rng.integers(-2, 3)), **kw) for i in range(n)}


def rows_of(episodes, dataset="d", task=0, dt=0.1):
    return [(dataset, task, int(e), f, f * dt, [float(x) for x in a[f]], [float(x) for x in s[f]]) for e, (a, s) in episodes.items() for f in range(len(a))]


def frames_of(spark, episodes, **kw):
    return spark.createDataFrame(rows_of(episodes, **kw), FRAME_SCHEMA)


def random_episodes(lengths, seed=1, dims=7, scale=0.3, state_dims=8):
    rng = np.random.default_rng(seed)
    out = {}
    for e, n in enumerate(lengths):
        a = np.cumsum(rng.normal(0, scale, (n, dims)), axis=0) * 0.2 + rng.normal(0, scale, (n, dims))
        a[:, -1] = np.where(rng.random(n) < 0.5, 1.0, -1.0) if e % 2 else np.sign(np.sin(np.arange(n) / 9.0 + 0.1))
        out[e] = (a, np.cumsum(rng.normal(0, 0.05, (n, state_dims)), axis=0))
    return out
