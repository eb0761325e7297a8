"""A character-level bidirectional LSTM with a CRF over its tags, trained and run in numpy.

The cells use softsign for both squashings. Each direction has one table with a row per character, which is its embedding
already multiplied by the input weights. Tags are ``O`` and, per kind, ``B`` and ``I``; transitions into an ``I`` of another kind are impossible.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ["email", "ip", "card", "phone"]
TAGS = 1 + 2 * len(KINDS)
OTHER, PAD = 128, 129  # characters beyond ASCII, and places behind a text
HIDDEN = 8
NEVER = np.float32(-1e4)
#: Windows decoded at once.
BATCH = 1024


def begin(kind: int) -> int:
    return 1 + 2 * kind


def _allowed() -> np.ndarray:
    """Whether tag ``j`` may follow tag ``i``."""
    ok = np.ones((TAGS, TAGS), bool)
    for kind in range(len(KINDS)):
        ok[:, begin(kind) + 1] = False
        ok[[begin(kind), begin(kind) + 1], begin(kind) + 1] = True
    return ok


def char_codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), OTHER).astype(np.uint8)


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """The derivative of ``_squash`` where it has the value ``y``."""
    return (1 - np.abs(y)) ** 2


@dataclass
class Tagger:
    table: np.ndarray  # gate, direction, character, HIDDEN: gates in, forget, out, and the new content
    recur: np.ndarray  # gate, direction, HIDDEN, HIDDEN
    out: np.ndarray  # 2 * HIDDEN, TAGS
    bias: np.ndarray  # TAGS
    follow: np.ndarray  # TAGS, TAGS
    least: float = 0.0  # log-odds that a span needs

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.recur, self.out, self.bias, self.follow]

    def _run(self, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states ``direction, time, window, HIDDEN`` of ``window, time`` codes; the second direction reads backwards."""
        n, length = codes.shape
        both = np.ascontiguousarray(np.stack([codes, codes[:, ::-1]]).transpose(0, 2, 1))
        states, kept = np.empty((2, length, n, HIDDEN), np.float32), []
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        z, size = np.empty((4, 2, n, HIDDEN), np.float32), np.empty((4, 2, n, HIDDEN), np.float32)
        for t in range(length):
            np.matmul(h, self.recur, out=z)
            for gate in range(4):
                for d in (0, 1):
                    self.table[gate, d].take(both[d, t], axis=0, out=size[gate, d], mode="clip")
            z += size
            np.abs(z, out=size)
            size += 1
            z /= size
            gates = z[:3] * np.float32(0.5)
            gates += np.float32(0.5)
            before = c
            c = gates[1] * c
            c += gates[0] * z[3]
            seen = _squash(c)
            h = gates[2] * seen
            states[:, t] = h
            if keep:
                kept.append((both[:, t], z.copy(), gates, before, seen))
        return states, kept

    def _scores(self, states: np.ndarray) -> np.ndarray:
        """Scores ``time, tag, window`` from both directions."""
        ahead, behind = states[0].transpose(0, 2, 1), states[1, ::-1].transpose(0, 2, 1)
        found = np.matmul(self.out[:HIDDEN].T, ahead)
        found += np.matmul(self.out[HIDDEN:].T, behind)
        found += self.bias[:, None]
        return found

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return self._scores(self._run(codes, False)[0])

    def tags(self, scores: np.ndarray) -> np.ndarray:
        """The best tags ``window, time`` for scores ``time, tag, window``."""
        length, _, n = scores.shape
        totals, into = np.empty_like(scores), np.ascontiguousarray(self.follow.T)
        totals[0] = scores[0]
        for t in range(1, length):
            (totals[t - 1] + into[:, :, None]).max(axis=1, out=totals[t])
            totals[t] += scores[t]
        best = np.empty((n, length), np.int8)
        tag = totals[-1].argmax(axis=0)
        best[:, -1] = tag
        for t in range(length - 2, -1, -1):
            tag = (totals[t] + into[tag].T).argmax(axis=0)
            best[:, t] = tag
        return best

    def margin(self, scores: np.ndarray, tags: np.ndarray, start: int, end: int) -> float:
        """Log-odds of the tags of a span in a window against no span there; ``scores`` are ``time, tag``."""
        own, at = tags[start:end], np.arange(start, end)
        gain = float((scores[at, own] - scores[at, 0]).sum() + self.follow[own[:-1], own[1:]].sum() - (len(own) - 1) * self.follow[0, 0])
        if start:
            gain += float(self.follow[tags[start - 1], own[0]] - self.follow[tags[start - 1], 0])
        if end < len(tags):
            gain += float(self.follow[own[-1], tags[end]] - self.follow[0, tags[end]])
        return gain

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of the tags ``window, time`` and its gradient by the weights."""
        n, length = codes.shape
        states, kept = self._run(codes, True)
        scores = np.ascontiguousarray(self._scores(states).transpose(0, 2, 1), np.float64)
        follow = self.follow.astype(np.float64)
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0]
        for t in range(1, length):
            ahead[t] = _log_sum(ahead[t - 1][:, :, None] + follow) + scores[t]
        for t in range(length - 2, -1, -1):
            behind[t] = _log_sum((follow + (scores[t + 1] + behind[t + 1])[:, None, :]).transpose(0, 2, 1))
        whole = _log_sum(ahead[-1][:, :, None])
        gold = tags.T
        windows = np.arange(n)
        spent = np.take_along_axis(scores, gold[..., None], 2).sum() + follow[gold[:-1], gold[1:]].sum()
        d_scores = np.exp(ahead + behind - whole)
        np.subtract.at(d_scores, (np.arange(length)[:, None], windows[None], gold), 1)
        d_follow = np.zeros_like(follow)
        for t in range(1, length):
            d_follow += np.exp(ahead[t - 1][:, :, None] + follow + (scores[t] + behind[t])[:, None, :] - whole[:, :, None]).sum(axis=0)
        np.subtract.at(d_follow, (gold[:-1], gold[1:]), 1)
        d_follow[follow <= NEVER / 2] = 0
        d_scores = (d_scores / n).astype(np.float32)
        joined = np.concatenate([states[0], states[1, ::-1]], axis=2).reshape(-1, 2 * HIDDEN)
        d_out = joined.T @ d_scores.reshape(-1, TAGS)
        d_states = np.stack([d_scores @ self.out[:HIDDEN].T, (d_scores @ self.out[HIDDEN:].T)[::-1]])
        d_table, d_recur = np.zeros_like(self.table), np.zeros_like(self.recur)
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        for t in range(length - 1, -1, -1):
            chars, z, gates, before, seen = kept[t]
            dh = dh + d_states[:, t]
            dc = dc + dh * gates[2] * _slope(seen)
            dz = np.stack([dc * z[3], dc * before, dh * seen, dc * gates[0]])
            dz[:3] *= 0.5
            dz *= _slope(z)
            earlier = states[:, t - 1] if t else np.zeros_like(dh)
            d_recur += earlier.transpose(0, 2, 1) @ dz
            for d in (0, 1):
                np.add.at(d_table[:, d], (slice(None), chars[d]), dz[:, d])
            dh = (dz @ self.recur.transpose(0, 1, 3, 2)).sum(axis=0)
            dc = dc * gates[1]
        return float((whole.sum() - spent) / n), [d_table, d_recur, d_out, d_scores.sum(axis=(0, 1)), (d_follow / n).astype(np.float32)]


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Log of summed exponentials over the axis before the last."""
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))


def fresh(seed: int = 0) -> Tagger:
    rng = np.random.default_rng(seed)

    def spread(*shape: int, by: float) -> np.ndarray:
        return (rng.standard_normal(shape) * by).astype(np.float32)

    tagger = Tagger(spread(4, 2, PAD + 1, HIDDEN, by=0.5), spread(4, 2, HIDDEN, HIDDEN, by=0.3), spread(2 * HIDDEN, TAGS, by=0.3),
                    np.zeros(TAGS, np.float32), np.where(_allowed(), np.float32(0), NEVER))
    tagger.table[1] += 1  # cells remember at first
    return tagger


def train(codes: np.ndarray, tags: np.ndarray, epochs: int = 12, size: int = 128, rate: float = 0.02, seed: int = 0) -> Tagger:
    """A tagger fitted to labelled windows by Adam; the same windows in the same order give the same weights."""
    tagger, rng = fresh(seed), np.random.default_rng(seed + 1)
    first = [np.zeros_like(w) for w in tagger.weights()]
    second = [np.zeros_like(w) for w in tagger.weights()]
    steps, total = 0, epochs * -(-len(codes) // size)
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for at in range(0, len(codes), size):
            own = order[at:at + size]
            _, slopes = tagger.gradient(codes[own], tags[own])
            steps += 1
            norm = float(np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in slopes)))
            now = rate * (1 - steps / (total + 1))
            for w, g, m, v in zip(tagger.weights(), slopes, first, second):
                g = g * np.float32(min(1.0, 5.0 / (norm + 1e-9)))
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.01) * (g * g - v)
                w -= np.float32(now) * (m / np.float32(1 - 0.9**steps)) / (np.sqrt(v / np.float32(1 - 0.99**steps)) + np.float32(1e-6))
    return tagger
