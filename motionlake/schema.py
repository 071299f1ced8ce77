"""Canonical column sets.

frames   : dataset_id, task_index, episode_index, frame_index, ts, action, state
episodes : dataset_id, task_index, episode_index, n_frames, ...

``frame_index`` is dense from 0 inside an episode. ``task_index`` depends on the episode, so
it travels inside the episode key instead of being joined back.
"""

TASK = ["dataset_id", "task_index"]
EP = ["dataset_id", "task_index", "episode_index"]

# One chunk of consecutive frames is the unit of partitioning for every ordered operator, so
# a single episode of any length spreads over many tasks.
CHUNK = 4096
# Neighbour frames copied across a chunk border; covers the widest bounded window in use
# (Gaussian radius 12 on a first difference, autocorrelation lag 9 on a first difference).
HALO = 16
# Copies of a per-task row when it is joined to many episode rows of one task.
SALTS = 32
