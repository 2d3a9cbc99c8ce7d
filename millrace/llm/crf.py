"""Linear-chain conditional random fields over batches of sequences, in NumPy.

Batches are laid out as ``(step, sequence, label)`` with sequences sorted by falling length,
so that a step works on the sequences that still go on and on nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BATCH_CELLS = 1 << 20  # steps x sequences x labels held at a time, unless one sequence alone has more


def batches(lengths: np.ndarray, labels: int, cells: int = BATCH_CELLS) -> Iterator[np.ndarray]:
    """Places of sequences of similar length, longest first within a batch; empty ones are left out."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        width = max(int(cells // (lengths[order[at]] * labels)), 1)
        yield order[at:at + width]
        at += width


def lay_out(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences sorted by falling length as one padded ``(step, sequence, ...)`` array, and how many go on at each step."""
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((lengths[0], len(sequences), *sequences[0].shape[1:]), sequences[0].dtype)
    for k, s in enumerate(sequences):
        out[:len(s), k] = s
    return out, (lengths[None, :] > np.arange(lengths[0])[:, None]).sum(axis=1)


def forward_backward(scores: np.ndarray, going: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Label probabilities of each place, expected label pairs, and the log of each sequence's total."""
    top = scores.max(axis=2, keepdims=True)
    local, step = np.exp(scores - top), np.exp(transitions)
    alpha, scale = np.zeros_like(local), np.ones(scores.shape[:2])
    for t, n in enumerate(going.tolist()):
        now = local[t, :n] * (np.exp(start) if t == 0 else alpha[t - 1, :n] @ step)
        scale[t, :n] = total = now.sum(axis=1)
        alpha[t, :n] = now / total[:, None]
    beta = np.ones_like(local)
    back = step.T.copy()
    for t in range(len(going) - 2, -1, -1):
        n = int(going[t + 1])
        beta[t, :n] = ((local[t + 1, :n] * beta[t + 1, :n]) @ back) / scale[t + 1, :n, None]
    place = alpha * beta
    place /= np.maximum(place.sum(axis=2, keepdims=True), 1e-300)
    valid = np.arange(scores.shape[1])[None, :] < going[:, None]
    ahead = local[1:] * beta[1:] / scale[1:, :, None] * valid[1:, :, None]
    pairs = step * np.einsum("tbi,tbj->ij", alpha[:-1], ahead)
    total = ((np.log(scale) + top[:, :, 0]) * valid).sum(axis=0)
    return place * valid[:, :, None], pairs, total


def viterbi(scores: np.ndarray, going: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best label of each place; of equal paths, that with the smaller label at the last place they differ."""
    best = np.zeros_like(scores)
    came = np.zeros(scores.shape, np.int16)
    for t, n in enumerate(going.tolist()):
        if t == 0:
            best[0, :n] = start + scores[0, :n]
            continue
        ways = best[t - 1, :n, :, None] + transitions
        came[t, :n] = ways.argmax(axis=1)
        best[t, :n] = ways.max(axis=1) + scores[t, :n]
    labels = np.zeros(scores.shape[:2], np.int64)
    for t in range(len(going) - 1, -1, -1):
        n = int(going[t])
        on = int(going[t + 1]) if t + 1 < len(going) else 0
        labels[t, on:n] = best[t, on:n].argmax(axis=1)
        if on:
            labels[t, :on] = came[t + 1, np.arange(on), labels[t + 1, :on]]
    return labels


class Adam:
    """Gradient ascent with adaptive steps on a dict of arrays.

    The ``shared`` arrays, large tables of which a step touches a few entries, have one step size each,
    so that what many sequences share moves far and what one of them has alone hardly moves.
    """

    def __init__(self, parameters: dict[str, np.ndarray], rate: float, shared: dict[str, float] | None = None):
        self.parameters, self.rate, self.steps, self.shared = parameters, rate, 0, shared or {}
        self.mean = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.square = {k: 0.0 if k in self.shared else np.zeros_like(v) for k, v in parameters.items()}

    def ascend(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, g in gradients.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            if k in self.shared:
                self.square[k] += 0.02 * ((g * g).sum() / max(np.count_nonzero(g), 1) - self.square[k])
                square = self.square[k] / (1 - 0.98**self.steps)
            else:
                self.square[k] += 0.001 * (g * g - self.square[k])
                square = self.square[k] / (1 - 0.999**self.steps)
            step = self.rate * self.shared.get(k, 1.0) / (1 - 0.9**self.steps)
            self.parameters[k] += step * self.mean[k] / (np.sqrt(square) + 1e-8)
