"""A skip-chain conditional random field over token labels, in numpy.

A chain joins neighbouring tokens; skip edges join distant tokens of one document that are equal or alike. Weights of
the chain are fitted by stochastic gradient on the conditional likelihood, with exact forward and backward passes; the
skip potential is fitted piecewise, from how often labels meet on skip edges of the training texts compared with
chance. Labelling runs loopy message passing: exact passes along the chain alternate with messages over skip edges.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FORBIDDEN = -1e4


@dataclass
class Model:
    """weights: (features + 1, labels); the last row is 0 and stands for a feature that counts for nothing."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    begin: np.ndarray
    skip: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """(tokens, labels) summed weights of each token's features, given as (tokens, columns) row numbers."""
        out = np.zeros((len(features), len(self.labels)))
        for column in features.T:
            out += self.weights[column]
        return out


def allowed(labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Transition and start scores: 0, or FORBIDDEN where an inside label doesn't follow its own kind."""
    n = len(labels)
    step, begin = np.zeros((n, n)), np.zeros(n)
    for j, label in enumerate(labels):
        if label.startswith("I-"):
            begin[j] = FORBIDDEN
            for i, before in enumerate(labels):
                if before[2:] != label[2:] or before == "O":
                    step[i, j] = FORBIDDEN
    return step, begin


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def pad(scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, longest, labels) from concatenated scores, and the flat positions of the real tokens."""
    longest = int(lengths.max())
    out = np.zeros((len(lengths), longest, scores.shape[1]))
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = scores
    return out, row * longest + at


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward messages and log partition of padded texts."""
    n, longest, _ = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = begin + scores[:, 0]
    for t in range(1, longest):
        new = _logsum(forward[:, t - 1, :, None] + transitions, 1) + scores[:, t]
        forward[:, t] = np.where((t < lengths)[:, None], new, forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        new = _logsum(transitions + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where((t + 1 < lengths)[:, None], new, 0)
    return forward, backward, _logsum(forward[:, -1], 1)


def best_path(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(texts, longest) labels of the best path of each padded text."""
    n, longest, _ = scores.shape
    value, back = begin + scores[:, 0], np.zeros(scores.shape, np.int16)
    for t in range(1, longest):
        through = value[:, :, None] + transitions
        back[:, t] = through.argmax(axis=1)
        value = np.where((t < lengths)[:, None], through.max(axis=1) + scores[:, t], value)
    out = np.zeros((n, longest), np.int16)
    at = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        inside = t < lengths
        out[:, t] = np.where(inside, at, 0)
        at = np.where(inside & (t > 0), back[np.arange(n), t, at], at)
    return out


def _steps(forward: np.ndarray, ahead: np.ndarray, z: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """(labels, labels) how often each label is expected to follow each; `ahead`: scores and backward messages."""
    k = len(transitions)
    a, b = forward[:, :-1], ahead[:, 1:]
    top_a, top_b = a.max(axis=2, keepdims=True), b.max(axis=2, keepdims=True)
    inside = (np.arange(1, forward.shape[1]) < lengths[:, None])[:, :, None]
    weight = np.exp(np.where(inside, np.minimum(top_a + top_b - z[:, None, None], 600.0), -np.inf))
    return np.exp(transitions) * ((np.exp(a - top_a) * weight).reshape(-1, k).T @ np.exp(b - top_b).reshape(-1, k))


def pack(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What was learnt: the rows that have weights and these, the transitions, the skip potential."""
    rows = np.flatnonzero(model.weights.any(axis=1))
    return rows, model.weights[rows], model.transitions, model.skip


def mean_of(packed: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], labels: list[str], size: int) -> Model:
    """The model of mean scores: what one fit made of a word by chance, the others outvote."""
    n, weights = len(packed), np.zeros((size + 1, len(labels)), np.float32)
    for rows, values, _, _ in packed:
        weights[rows] += values / n
    return Model(labels, weights, sum(p[2] for p in packed) / n, allowed(labels)[1], sum(p[3] for p in packed) / n)


def _chunk(texts: list[np.ndarray], golds: list[np.ndarray], rare: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """What a step of the fit needs of some texts: their features; of each use of a feature its token, in the order of
    features, with where each feature begins; and its feature, in the order of tokens, with where each token begins."""
    features, truth = np.concatenate(texts), np.concatenate(golds)
    lengths, nothing = np.array([len(t) for t in texts]), len(rare) - 1
    features = np.where(rare[features], nothing, features)
    told = features != nothing
    told[:, 0] |= ~told.any(axis=1)  # no token goes without
    touched, feature = np.unique(features[told], return_inverse=True)
    feature, token = feature.ravel().astype(np.int32), np.nonzero(told)[0].astype(np.int32)
    of_token = np.searchsorted(token, np.arange(len(features)))
    order = np.argsort(feature, kind="stable")
    of_feature = np.searchsorted(feature[order], np.arange(len(touched)))
    met = np.zeros((k, k))
    inside = np.repeat(np.arange(len(lengths)), lengths)
    same = inside[1:] == inside[:-1]
    np.add.at(met, (truth[:-1][same], truth[1:][same]), 1)
    return touched, token[order], of_token, feature, of_feature, lengths, truth, met


def fit(
    texts: list[np.ndarray], golds: list[np.ndarray], labels: list[str], size: int, epochs: int = 6, rate: float = 0.2, decay: float = 1e-6, least: int = 2, seed: int = 7, batch: int = 64,
) -> Model:
    """Chain weights by AdaGrad. `texts`: of each text the (tokens, columns) feature numbers below `size`.

    The result is the mean over the last two epochs. Features seen fewer than `least` times are not learnt.
    """
    fixed, begin = allowed(labels)
    k = len(labels)
    seen = np.zeros(size + 1, np.int64)
    for text in texts:
        np.add.at(seen, text.ravel(), 1)
    rare = seen < least
    model = Model(labels, np.zeros((size + 1, k), np.float32), fixed.copy(), begin.copy(), np.zeros((k, k)))
    past, past_step = np.full((size + 1, k), 1e-6, np.float32), np.full((k, k), 1e-6)
    rng = np.random.default_rng(seed)
    free = fixed == 0
    by_length = np.argsort([len(t) for t in texts], kind="stable")
    chunks = [_chunk([texts[i] for i in own], [golds[i] for i in own], rare, k) for own in (by_length[i:i + batch] for i in range(0, len(texts), batch))]
    mean, mean_step, averaged = np.zeros_like(model.weights), np.zeros((k, k)), 0
    for epoch in range(epochs):
        for c in rng.permutation(len(chunks)):
            touched, token, of_token, feature, of_feature, lengths, truth, met = chunks[c]
            scores = np.add.reduceat(model.weights[touched][feature], of_token, axis=0)
            padded, flat = pad(scores, lengths)
            forward, backward, z = forward_backward(padded, lengths, model.transitions, model.begin)
            node = np.exp(forward + backward - z[:, None, None]).reshape(-1, k)[flat]
            node[np.arange(len(truth)), truth] -= 1
            grad = np.add.reduceat(node[token], of_feature, axis=0)
            grad += decay * len(texts) / batch * model.weights[touched]
            past[touched] += grad * grad
            model.weights[touched] -= rate * grad / np.sqrt(past[touched])
            model.weights[size] = 0
            step = _steps(forward, padded + backward, z, lengths, model.transitions)
            step -= met
            step *= free
            past_step += step * step
            model.transitions -= rate * step / np.sqrt(past_step)
            if epoch >= epochs - 2:
                mean += model.weights
                mean_step += model.transitions
                averaged += 1
    if averaged:
        model.weights, model.transitions = mean / averaged, mean_step / averaged
    return model


def fit_skip(model: Model, edges: list[list[tuple[int, int]]], golds: list[np.ndarray], most: float = 1.5) -> None:
    """The skip potential: log of how much more often two labels meet on skip edges than they would by chance."""
    met = np.full((len(model.labels),) * 2, 0.5)
    for pairs, gold in zip(edges, golds):
        for i, j in pairs:
            met[gold[i], gold[j]] += 1
            met[gold[j], gold[i]] += 1
    p = met / met.sum()
    chance = p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)
    model.skip = np.clip(np.log(p / chance), -most, most)


def label(model: Model, scores: np.ndarray, lengths: np.ndarray, edges: list[list[tuple[int, int]]], rounds: int = 3) -> np.ndarray:
    """A label number for each of the concatenated tokens of several texts with scores (tokens, labels).

    Texts with skip edges get `rounds` rounds of messages, each edge sending in both directions what the chain and the
    other edges say about its end.
    """
    padded, flat = pad(scores, lengths)
    longest, k = padded.shape[1], len(model.labels)
    rows = np.array([i for i, e in enumerate(edges) if e], np.int64)
    if len(rows):
        own = {int(r): n for n, r in enumerate(rows)}
        a = np.array([own[r] * longest + i for r in own for i, _ in edges[r]])
        b = np.array([own[r] * longest + j for r in own for _, j in edges[r]])
        src, dst = np.concatenate((a, b)), np.concatenate((b, a))
        back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
        base = padded[rows].reshape(-1, k)
        message = np.zeros((len(src), k))
        for _ in range(rounds):
            sums = np.zeros_like(base)
            np.add.at(sums, dst, message)
            now = (base + sums).reshape(len(rows), longest, k)
            forward, backward, z = forward_backward(now, lengths[rows], model.transitions, model.begin)
            belief = (forward + backward - z[:, None, None]).reshape(-1, k)
            out = _logsum((belief[src] - message[back])[:, :, None] + model.skip, 1)
            message = 0.5 * message + 0.5 * (out - out.mean(axis=1, keepdims=True))
        sums = np.zeros_like(base)
        np.add.at(sums, dst, message)
        padded[rows] = (base + sums).reshape(len(rows), longest, k)
    return best_path(padded, lengths, model.transitions, model.begin).reshape(-1)[flat]
