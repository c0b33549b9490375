"""A character tagger in numpy: embeddings, one LSTM in each direction, and a linear-chain CRF over the tags.

Windows are matrices (rows, length) of character classes; a mask says which places hold text. Training is by gradients of the CRF's log likelihood
through both directions, with Adam steps. Parameters are a dict of arrays, so they travel to tasks as plain data.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def start_params(classes: int, tags: int, embed: int = 16, hidden: int = 24, seed: int = 0) -> Params:
    """Random weights; the forget gates start open."""
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)

    out = {"embed": (rng.normal(0, 0.3, (classes, embed))).astype(np.float32), "emit": normal(2 * hidden, tags), "emit_bias": np.zeros(tags, np.float32)}
    for side in ("ahead", "back"):
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden : 2 * hidden] = 1
        out |= {f"{side}_in": normal(embed, 4 * hidden), f"{side}_own": normal(hidden, 4 * hidden), f"{side}_bias": bias}
    return out | {"first": np.zeros(tags, np.float32), "last": np.zeros(tags, np.float32), "move": np.zeros((tags, tags), np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _lstm(params: Params, side: str, ids: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (length, rows, hidden) along the given order; places without text hand the state on."""
    own = params[f"{side}_own"]
    hidden = own.shape[0]
    # what a class adds to the gates is the same wherever it stands
    table = params["embed"] @ params[f"{side}_in"] + params[f"{side}_bias"]
    h = c = np.zeros((ids.shape[1], hidden), np.float32)
    out = np.empty((*ids.shape, hidden), np.float32)
    for t in range(len(ids)):
        gates = table[ids[t]] + h @ own
        gate = _sigmoid(gates[:, : 3 * hidden])
        i, f, o, g = gate[:, :hidden], gate[:, hidden : 2 * hidden], gate[:, 2 * hidden :], np.tanh(gates[:, 3 * hidden :])
        there = mask[t][:, None]
        cell = np.where(there, f * c + i * g, c)
        flat = np.tanh(cell)
        state = np.where(there, o * flat, h)
        if keep is not None:
            keep.append((i, f, o, g, c, h, flat, there))
        h, c = state, cell
        out[t] = h
    return out


def _lstm_back(params: Params, side: str, ids: np.ndarray, keep: list, given: np.ndarray, grads: Params) -> None:
    """Adds the gradients of one direction; ``given``: gradient of each hidden state."""
    own, into = params[f"{side}_own"], params[f"{side}_in"]
    hidden = own.shape[0]
    each = np.empty((*ids.shape, 4 * hidden), np.float32)
    dh = np.zeros_like(given[0])
    dc = np.zeros_like(given[0])
    for t in range(len(ids) - 1, -1, -1):
        i, f, o, g, c, h, flat, there = keep[t]
        dh = dh + given[t]
        passed_h, passed_c = np.where(there, 0, dh), np.where(there, 0, dc)
        dh, dc = np.where(there, dh, 0), np.where(there, dc, 0)
        dc = dc + dh * o * (1 - flat * flat)
        gates = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * flat * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        each[t] = gates
        grads[f"{side}_own"] += h.T @ gates
        dh, dc = gates @ own.T + passed_h, dc * f + passed_c
    one_hot = (ids.reshape(-1, 1) == np.arange(len(params["embed"]))).astype(np.float32)
    table = one_hot.T @ each.reshape(-1, 4 * hidden)
    grads[f"{side}_bias"] += table.sum(axis=0)
    grads[f"{side}_in"] += params["embed"].T @ table
    grads["embed"] += table @ into.T


def emissions(params: Params, ids: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Scores (length, rows, tags) of windows (rows, length)."""
    lists = (None, None) if keep is None else ([], [])
    ahead = _lstm(params, "ahead", ids.T, mask.T, lists[0])
    back = _lstm(params, "back", ids.T[::-1], mask.T[::-1], lists[1])[::-1]
    both = np.concatenate([ahead, back], axis=2)
    if keep is not None:
        keep += [*lists, both]
    return both @ params["emit"] + params["emit_bias"]


class Reader:
    """Scores of many windows as ``emissions`` gives them, without gradients.

    Both directions take a step at once, each from the place where its text begins, so that padding comes last and no step needs a mask. All gates
    are sigmoids (tanh x is 2 sigmoid(2 x) - 1), and the product that moves the states on gives the last step's scores too."""

    def __init__(self, params: Params) -> None:
        self.params, self.hidden, self.tags = params, len(params["ahead_own"]), len(params["first"])
        # minus what stands in the exponent; cells and states are kept halved
        scale = np.repeat(np.float32([-1, -2]), [3 * self.hidden, self.hidden])
        into = [(params["embed"] @ params[f"{s}_in"] + params[f"{s}_bias"]) * scale for s in ("ahead", "back")]
        own = [np.concatenate([params[f"{s}_own"] * scale, part], axis=1) for s, part in zip(("ahead", "back"), np.split(params["emit"], 2), strict=True)]
        self.into, self.own = np.concatenate(into).astype(np.float32), np.stack(own).astype(np.float32) * 2
        # the most that a tag other than 0 can add to a path by what leads to it and away from it
        move, first, last = params["move"] - params["move"][0, 0], params["first"] - params["first"][0], params["last"] - params["last"][0]
        self.most = np.maximum(move.max(axis=0), first) + np.maximum(0, np.maximum(move[:, 0], last))

    def scores(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores (length, rows, tags) of windows (rows, length) with so many characters; what stands behind them has no meaning."""
        rows, length = ids.shape
        hidden, gated, full = self.hidden, 4 * self.hidden, bool((sizes == length).all())
        there = None if full else np.maximum(sizes[:, None] - 1 - np.arange(length), 0)
        both = np.stack([ids, ids[:, ::-1] if full else np.take_along_axis(ids, there, axis=1)]).astype(np.intp)
        both[1] += len(self.params["embed"])
        steps = np.ascontiguousarray(both.transpose(2, 0, 1))
        state, cell, flat = (np.zeros((2, rows, hidden), np.float32) for _ in range(3))
        sums, gates = np.empty((2, rows, gated + self.tags), np.float32), np.empty((2, rows, gated), np.float32)
        found = np.empty((length, 2, rows, self.tags), np.float32)
        i, f, o, g = (gates[:, :, k * hidden : (k + 1) * hidden] for k in range(4))
        for t in range(length):
            np.take(self.into, steps[t], axis=0, out=gates, mode="clip")
            if t:
                np.matmul(state, self.own, out=sums)
                found[t - 1] = sums[:, :, gated:]
                gates += sums[:, :, :gated]
            with np.errstate(over="ignore"):
                np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            g -= 0.5
            i *= g
            cell *= f
            cell += i
            np.multiply(cell, -4, out=flat)
            with np.errstate(over="ignore"):
                np.exp(flat, out=flat)
            flat += 1
            np.reciprocal(flat, out=flat)
            flat -= 0.5
            np.multiply(o, flat, out=state)
        np.matmul(state, self.own[:, :, gated:], out=found[-1])
        ahead, back = found[:, 0], found[:, 1]
        return ahead + (back[::-1] if full else np.take_along_axis(back, there.T[:, :, None], axis=0)) + self.params["emit_bias"]

    def plain(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which windows' best paths are surely 0 everywhere: where no place's other tags could win back what they cost there, whatever stands beside them."""
        over = (scores[:, :, 1:] + self.most[1:]).max(axis=2) - scores[:, :, 0]
        return (over < -0.001).all(axis=0) if (sizes == len(scores)).all() else ((over < -0.001) | (np.arange(len(scores))[:, None] >= sizes)).all(axis=0)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def log_partition(params: Params, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the sum over all tag paths of each row, forward scores). Text fills a window from its start."""
    now = params["first"] + scores[0]
    all_now = [now]
    for t in range(1, len(scores)):
        step = _log_sum(now[:, :, None] + params["move"], 1) + scores[t]
        now = np.where(mask[:, t][:, None], step, now)
        all_now.append(now)
    return _log_sum(now + params["last"], 1), np.stack(all_now)


def loss_and_gradients(params: Params, ids: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, Params]:
    """Mean negative log likelihood of the tags, and its gradients."""
    rows, length = ids.shape
    keep: list = []
    scores = emissions(params, ids, mask, keep)
    total, ahead = log_partition(params, scores, mask)
    at = np.arange(rows)
    end = mask.sum(axis=1) - 1
    d_scores, grads = np.zeros_like(scores), {k: np.zeros_like(v) for k, v in params.items()}
    # sums from the end: what may follow each tag
    after = np.broadcast_to(params["last"], (rows, len(params["last"]))).astype(np.float32)
    path = params["first"][tags[:, 0]] + params["last"][tags[at, end]]
    np.add.at(grads["last"], tags[at, end], -1)
    np.add.at(grads["first"], tags[:, 0], -1)
    grads["last"] += np.exp(ahead[-1] + params["last"] - total[:, None]).sum(axis=0)
    for t in range(length - 1, -1, -1):
        there = mask[:, t]
        d_scores[t] = np.exp(ahead[t] + after - total[:, None]) * there[:, None]
        d_scores[t][at[there], tags[there, t]] -= 1
        path = path + np.where(there, scores[t][at, tags[:, t]], 0)
        if t:
            pair = ahead[t - 1][:, :, None] + params["move"] + (scores[t] + after)[:, None, :] - total[:, None, None]
            grads["move"] += np.exp(pair[there]).sum(axis=0)
            np.add.at(grads["move"], (tags[there, t - 1], tags[there, t]), -1)
            path = path + np.where(there, params["move"][tags[:, t - 1], tags[:, t]], 0)
            before = _log_sum(params["move"] + (scores[t] + after)[:, None, :], 2)
            after = np.where(there[:, None], before, after)
    grads["first"] += np.exp(ahead[0] + after - total[:, None]).sum(axis=0)
    both = keep[2]
    grads["emit"] += np.tensordot(both, d_scores, axes=([0, 1], [0, 1]))
    grads["emit_bias"] += d_scores.sum(axis=(0, 1))
    d_both = d_scores @ params["emit"].T
    hidden = both.shape[2] // 2
    _lstm_back(params, "ahead", ids.T, keep[0], d_both[:, :, :hidden], grads)
    _lstm_back(params, "back", ids.T[::-1], keep[1], d_both[::-1, :, hidden:], grads)
    return float((total - path).mean()), {k: g / rows for k, g in grads.items()}


def train(params: Params, ids: np.ndarray, mask: np.ndarray, tags: np.ndarray, steps: int, rows: int = 48, rate: float = 0.02, seed: int = 0) -> Params:
    """Adam steps on batches drawn in turn, of windows of about one length; the rate falls to a tenth. The same input gives the same weights."""
    rng = np.random.default_rng(seed)
    params = {k: v.copy() for k, v in params.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    length = mask.sum(axis=1)
    batches: list[np.ndarray] = []
    for n in range(1, steps + 1):
        if not batches:
            order = rng.permutation(len(ids))
            order = order[np.argsort(length[order] // 8, kind="stable")]
            batches = [order[k : k + rows] for k in range(0, len(order), rows)]
            rng.shuffle(batches)
        batch = batches.pop()
        width = int(mask[batch].sum(axis=1).max())
        _, grads = loss_and_gradients(params, ids[batch, :width], mask[batch, :width], tags[batch, :width])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * (1 - 0.9 * n / steps)
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / max(size, 1e-9))
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            params[k] -= (now * mean[k] / (1 - 0.9**n) / (np.sqrt(square[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
    return params


def best_paths(params: Params, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The most probable tags (rows, length) of windows; 0 where no text is."""
    now = params["first"] + scores[0]
    rows = np.arange(now.shape[0])
    came = []
    for t in range(1, len(scores)):
        step = now[:, :, None] + params["move"]
        best = step.argmax(axis=1)
        there = mask[:, t][:, None]
        came.append(np.where(there, best, np.arange(best.shape[1])))
        now = np.where(there, step.max(axis=1) + scores[t], now)
    tag = (now + params["last"]).argmax(axis=1)
    out = np.zeros(mask.shape, dtype=np.int64)
    for t in range(len(scores) - 1, -1, -1):
        out[:, t] = tag
        if t:
            tag = came[t - 1][rows, tag]
    return np.where(mask, out, 0)
