"""A bidirectional gated recurrent network over bytes in numpy, trained by backpropagation through time."""

from __future__ import annotations

import numpy as np

#: Bytes of one sequence.
LONGEST = 24


def pad(sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as rows of bytes, and which places hold one."""
    size = np.array([len(s) for s in sequences], np.int64)
    width = int(size.max()) if len(size) else 0
    there = np.arange(width) < size[:, None]
    table = np.zeros((len(sequences), width), np.int64)
    table[there] = np.frombuffer(b"".join(sequences), np.uint8)
    return table, there


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two gated recurrent layers, left to right and right to left, and a softmax over labels at every byte.

    What a byte adds to the gates is a row of a table, that is an embedding already multiplied with its weights.
    """

    def __init__(self, labels: int, hidden: int = 16, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        draw = lambda *shape, by: (random.standard_normal(shape) * by).astype(np.float32)
        self.hidden = hidden
        self.weights = {
            "table_f": draw(256, 3 * hidden, by=0.3), "table_b": draw(256, 3 * hidden, by=0.3),
            "state_f": draw(hidden, 3 * hidden, by=hidden**-0.5), "state_b": draw(hidden, 3 * hidden, by=hidden**-0.5),
            "out": draw(2 * hidden, labels, by=0.3), "bias": np.zeros(labels, np.float32),
        }

    def _run(self, side: str, table: np.ndarray, there: np.ndarray, keep: list | None) -> np.ndarray:
        """States at all places; `keep` gets what the way back needs."""
        h, rows = self.hidden, len(table)
        gates, state_weights = self.weights[f"table_{side}"], self.weights[f"state_{side}"]
        state, states = np.zeros((rows, h), np.float32), np.zeros((*table.shape, h), np.float32)
        steps = range(table.shape[1]) if side == "f" else range(table.shape[1] - 1, -1, -1)
        for t in steps:
            given, moved = gates[table[:, t]], state @ state_weights
            both = _sigmoid(given[:, : 2 * h] + moved[:, : 2 * h])
            update, reset = both[:, :h], both[:, h:]
            new = np.tanh(given[:, 2 * h :] + reset * moved[:, 2 * h :])
            on = there[:, t, None]
            after = np.where(on, new + update * (state - new), state)
            if keep is not None:
                keep.append((t, state, update, reset, new, moved[:, 2 * h :]))
            state = after
            states[:, t] = state
        return states

    def probabilities(self, table: np.ndarray, there: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Label probabilities at every place, zero where there is no byte."""
        sides = [self._run(s, table, there, None if keep is None else keep.setdefault(s, [])) for s in "fb"]
        states = np.concatenate(sides, 2)
        scores = states @ self.weights["out"] + self.weights["bias"]
        scores -= scores.max(2, keepdims=True)
        found = np.exp(scores)
        found /= found.sum(2, keepdims=True)
        if keep is not None:
            keep["states"] = states
        return found * there[:, :, None]

    def _back(self, side: str, table: np.ndarray, there: np.ndarray, kept: list, above: np.ndarray, grads: dict) -> None:
        h, state_weights = self.hidden, self.weights[f"state_{side}"]
        down = np.zeros((len(table), h), np.float32)
        for t, before, update, reset, new, moved in reversed(kept):
            down = down + above[:, t]
            own = np.where(there[:, t, None], down, 0)
            d_new = own * (1 - update) * (1 - new * new)
            d_update = own * (before - new) * update * (1 - update)
            d_reset = d_new * moved * reset * (1 - reset)
            to_gates = np.concatenate((d_update, d_reset, d_new), 1)
            to_state = np.concatenate((d_update, d_reset, d_new * reset), 1)
            np.add.at(grads[f"table_{side}"], table[:, t], to_gates)
            grads[f"state_{side}"] += before.T @ to_state
            down = np.where(there[:, t, None], own * update + to_state @ state_weights.T, down)

    def gradients(self, table: np.ndarray, there: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over all bytes, each of which should have its sequence's label."""
        keep: dict = {}
        error = self.probabilities(table, there, keep)
        error[np.arange(len(table)), :, label] -= there
        error /= max(1, there.sum())
        grads = {k: np.zeros_like(w) for k, w in self.weights.items()}
        flat = error.reshape(-1, error.shape[2])
        grads["out"] += keep["states"].reshape(len(flat), -1).T @ flat
        grads["bias"] += flat.sum(0)
        above = error @ self.weights["out"].T
        for side, part in (("f", above[:, :, : self.hidden]), ("b", above[:, :, self.hidden :])):
            self._back(side, table, there, keep[side], part, grads)
        return grads

    def train(self, sequences: list[bytes], label: np.ndarray, epochs: int, batch: int = 256, rate: float = 0.01) -> None:
        """Adam over batches of sequences of similar length."""
        random = np.random.default_rng(11)
        size = np.array([len(s) for s in sequences])
        mean = {k: np.zeros_like(w) for k, w in self.weights.items()}
        square = {k: np.zeros_like(w) for k, w in self.weights.items()}
        step, total = 0, max(1, epochs * -(-len(sequences) // batch))
        for _ in range(epochs):
            mixed = random.permutation(len(sequences))
            order = mixed[np.argsort(size[mixed], kind="stable")]
            blocks = [order[i : i + batch] for i in range(0, len(order), batch)]
            for at in random.permutation(len(blocks)):
                rows = blocks[at]
                grads = self.gradients(*pad([sequences[i] for i in rows]), label[rows])
                step += 1
                now = rate * (1 - step / total) + rate / 50
                for k, g in grads.items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    change = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] -= (now * change).astype(np.float32)
