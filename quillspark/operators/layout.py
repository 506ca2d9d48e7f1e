"""Node positions of small networks (E14), on the driver: what is drawn is a few dozen nodes."""

from __future__ import annotations

import numpy as np


def spring_layout(nodes: list[str], edges: list[tuple[str, str]], seed: int = 42, rounds: int = 50) -> dict[str, tuple[float, float]]:
    """Positions in [-1, 1]: all nodes repel, linked ones attract, and steps shrink to nothing. Reruns agree; edges of
    unknown nodes are ignored."""
    if not nodes:
        return {}
    index = {n: i for i, n in enumerate(nodes)}
    linked = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        if a in index and b in index and a != b:
            linked[index[a], index[b]] = linked[index[b], index[a]] = 1
    at = np.random.default_rng(seed).uniform(-1, 1, (len(nodes), 2))
    ideal = np.sqrt(4 / len(nodes))
    for turn in range(rounds):
        away = at[:, None] - at[None, :]
        distance = np.maximum(np.sqrt((away**2).sum(axis=2)), 0.01)
        force = (away * (ideal**2 / distance**2 - linked * distance / ideal)[:, :, None]).sum(axis=1)
        size = np.maximum(np.sqrt((force**2).sum(axis=1, keepdims=True)), 1e-9)
        at = at + force / size * np.minimum(size, 0.2 * (1 - turn / rounds))
    at = at - at.mean(axis=0)
    at = at / max(1e-9, np.abs(at).max())
    return {n: (float(x), float(y)) for n, (x, y) in zip(nodes, at, strict=True)}
