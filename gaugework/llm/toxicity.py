"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins what its characters say (hashed n-grams with word borders, a learned character embedding)
and what the word itself says (a hashed word signal, a learned word embedding).  The signals are signed roots of
likelihood ratios of document counts on the training rows, cut below the level that chance reaches.  Two gated
recurrent passes run over each window of words, attention pools their states, and a linear unit gives a logit.
A text's score is the calibrated largest logit of all its overlapping windows, which together cover every word.

Null and empty texts have one window without words and get the score of the bias alone.  Without labelled rows
of both kinds every score is the smoothed share of label 1.  Rows are independent: very long texts, ties, repeated
rows and extra columns need no special care.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.shared import kept_by_worker

SAMPLE_ROWS = 4000
WINDOW, STEP = 64, 48
HIDDEN, POOL, EMBED = 6, 8, 4
BUCKETS = 1 << 18
FOLDS = 4
WORD_ROWS, CHAR_ROWS = 1 << 12, 64
KEPT_WORDS = 200_000
GRAMS = (3, 4, 5, 6)
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¿¡«»„“”…–—"


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Spelling:
    """Hashed pieces of words over flat arrays: n-gram buckets, word buckets and character rows."""

    def __init__(self, words: list[str]):
        words = [w.strip(EDGES) for w in words]
        points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32)
        self.words = len(words)
        self.length = np.array([len(w) + 2 for w in words], np.int64)
        start = np.cumsum(self.length) - self.length
        owner = np.repeat(np.arange(len(words), dtype=np.int32), self.length)
        code = _scramble(points)
        # Per n: the buckets of all n-grams, word after word, and their number in each word.
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        rolling = code
        for n in range(2, max(GRAMS) + 1):
            if len(code) < n:
                break
            rolling = _scramble(rolling[:-1] ^ (code[n - 1 :] >> np.uint64(n)))
            if n in GRAMS:
                inside = owner[: len(rolling)] == owner[n - 1 :]
                buckets = (rolling[inside] % np.uint64(BUCKETS)).astype(np.int32)
                self.grams.append((buckets, np.maximum(self.length - n + 1, 0)))
        whole = np.zeros(len(words), np.uint64)
        if len(code):
            place = (np.arange(len(code)) - start[owner] + 1).astype(np.uint64)
            whole = np.add.reduceat(_scramble(code ^ (place << np.uint64(40))), start)
        self.word = (_scramble(whole) % np.uint64(BUCKETS)).astype(np.int32)
        self.char = (code % np.uint64(CHAR_ROWS)).astype(np.uint8)

    def signals(self, gram_signal: np.ndarray, word_signal: np.ndarray) -> np.ndarray:
        """Word signal and the largest, smallest and mean signal of its n-grams."""
        out = np.zeros((self.words, 4), np.float32)
        out[:, 0] = word_signal[self.word]
        total, count = np.zeros(self.words), np.zeros(self.words)
        for buckets, times in self.grams:
            owner, value = np.repeat(np.arange(self.words, dtype=np.int32), times), gram_signal[buckets]
            np.maximum.at(out[:, 1], owner, value)
            np.minimum.at(out[:, 2], owner, value)
            total += np.bincount(owner, value, minlength=self.words)
            count += times
        out[:, 3] = total / np.maximum(count, 1)
        return out


def _slices(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of several slices of a flat array, one slice after the other."""
    begin = np.cumsum(count) - count
    return np.repeat(start - begin, count) + np.arange(int(count.sum()))


class Characters:
    """Share of each character row in words, made when asked for."""

    def __init__(self, parts: list[Spelling]):
        empty = [np.zeros(0, np.uint8)]
        self.char = np.concatenate(empty + [p.char for p in parts])
        self.length = np.concatenate([np.zeros(1, np.int64)] + [p.length for p in parts])  # word 0: the empty place
        self.start = np.cumsum(self.length) - self.length

    def rows(self, words: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(words, return_inverse=True)
        length = self.length[distinct]
        owner = np.repeat(np.arange(len(distinct)), length)
        row = self.char[_slices(self.start[distinct], length)]
        flat = np.bincount(owner * CHAR_ROWS + row, minlength=len(distinct) * CHAR_ROWS)
        share = flat.reshape(-1, CHAR_ROWS) / np.maximum(length, 1)[:, None]
        return share.astype(np.float32)[place]


class Numbers(dict):
    """Numbers words in the order of their first appearance."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self) + 1  # 0 is the empty place
        self.new.append(word)
        return place


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and word count of all windows; a text without words has one empty window."""
    count = np.maximum(1, -(-(lengths - WINDOW) // STEP) + 1)
    text = np.repeat(np.arange(len(lengths)), count)
    order = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = order * STEP
    return text, first, np.minimum(lengths[text] - first, WINDOW)


def _grid(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all windows (0 beyond a text's end) and the text of each window."""
    text, first, held = _windows(lengths)
    begin = (np.cumsum(lengths) - lengths)[text] + first
    at = begin[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < held[:, None]
    grid = np.zeros(at.shape, np.int64)
    grid[inside] = flat[at[inside]]
    return grid, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Network:
    """Two gated recurrent passes, attention pooling and a linear unit; ``params`` are float32 arrays."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        inputs, h = 4 + 2 * EMBED, HIDDEN

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.params = {
            "words": normal(WORD_ROWS, EMBED, scale=0.05), "chars": normal(CHAR_ROWS, EMBED, scale=0.3),
            "attend": normal(2 * h, POOL, scale=0.5), "query": normal(POOL, scale=0.5),
            "out": normal(2 * h, scale=0.5), "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            self.params["in_" + side] = normal(inputs, 3 * h, scale=0.5)
            self.params["base_" + side] = np.zeros(3 * h, np.float32)
            self.params["rec_" + side] = normal(h, 3 * h, scale=0.4)

    def inputs(self, signal: np.ndarray, word_row: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return np.hstack([signal, self.params["words"][word_row], chars @ self.params["chars"]])

    def _pass(self, side: str, projected: np.ndarray, live: np.ndarray, steps, kept: list | None) -> np.ndarray:
        """States (time, window, hidden) of one direction; empty places carry the state on."""
        h, rec = HIDDEN, self.params["rec_" + side]
        state = np.zeros((projected.shape[1], h), np.float32)
        states = np.empty((projected.shape[0], projected.shape[1], h), np.float32)
        full = live.all(axis=1)
        for t in steps:
            hidden = state @ rec
            gates = _sigmoid(projected[t, :, : 2 * h] + hidden[:, : 2 * h])
            reset, keep = gates[:, :h], gates[:, h:]
            new = np.tanh(projected[t, :, 2 * h :] + reset * hidden[:, 2 * h :])
            after = new + keep * (state - new)
            if not full[t]:
                after = np.where(live[t][:, None], after, state)
            if kept is not None:
                kept.append((t, state, reset, keep, new, hidden[:, 2 * h :]))
            states[t] = state = after
        return states

    def forward(self, forth: np.ndarray, back: np.ndarray, live: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Logits of windows from projected inputs (time, window, 3 * hidden) of both directions."""
        p, steps = self.params, range(forth.shape[0])
        notes = ([], []) if kept is not None else (None, None)
        states = np.concatenate(
            [self._pass("f", forth, live, steps, notes[0]), self._pass("b", back, live, steps[::-1], notes[1])], axis=2
        )
        seen = np.tanh(states @ p["attend"])
        weight = np.where(live, np.exp(np.clip(seen @ p["query"], -30, 30)), np.float32(0))
        weight = weight / np.maximum(weight.sum(axis=0), np.float32(1e-20))
        pooled = (weight[:, :, None] * states).sum(axis=0)
        if kept is not None:
            kept.update(states=states, seen=seen, weight=weight, pooled=pooled, notes=notes)
        return pooled @ p["out"] + p["bias"][0]

    def backward(self, error: np.ndarray, kept: dict, live: np.ndarray) -> tuple[dict, dict]:
        """Gradients of the parameters above the inputs, and of the projected inputs per direction."""
        p, grads = self.params, {}
        grads["out"], grads["bias"] = kept["pooled"].T @ error, error.sum(keepdims=True)
        d_pooled = error[:, None] * p["out"]
        states, weight, seen = kept["states"], kept["weight"], kept["seen"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = (states * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grads["query"] = np.einsum("tb,tbk->k", d_score, seen)
        d_seen = d_score[:, :, None] * p["query"] * (1 - seen**2)
        grads["attend"] = np.einsum("tbh,tbk->hk", states, d_seen)
        d_states = d_states + d_seen @ p["attend"].T
        projected = {}
        h = HIDDEN
        for side, notes, part in (("f", kept["notes"][0], d_states[:, :, :h]), ("b", kept["notes"][1], d_states[:, :, h:])):
            rec = p["rec_" + side]
            d_rec, d_in = np.zeros_like(rec), np.zeros((*part.shape[:2], 3 * h), np.float32)
            flow = np.zeros(part.shape[1:], np.float32)
            for t, state, reset, keep, new, hidden_new in reversed(notes):
                d_after = part[t] + flow
                on = live[t][:, None]
                through = np.where(on, np.float32(0), d_after)
                d_after = np.where(on, d_after, np.float32(0))
                d_new = d_after * (1 - keep) * (1 - new**2)
                d_keep = d_after * (state - new) * keep * (1 - keep)
                d_reset = d_new * hidden_new * reset * (1 - reset)
                d_hidden = np.concatenate([d_reset, d_keep, d_new * reset], axis=1)
                d_in[t] = np.concatenate([d_reset, d_keep, d_new], axis=1)
                d_rec += state.T @ d_hidden
                flow = through + d_after * keep + d_hidden @ rec.T
            grads["rec_" + side] = d_rec
            projected[side] = d_in
        return grads, projected


class Scorer:
    """Scores texts with a trained network; projected word inputs stay until ``KEPT_WORDS`` are held."""

    def __init__(self, network: Network, gram_signal: np.ndarray, word_signal: np.ndarray):
        self.network, self.gram_signal, self.word_signal = network, gram_signal, word_signal
        self.slope, self.shift, self.constant = np.float64(1), np.float64(0), None
        self._forget()

    def _forget(self) -> None:
        self.number = Numbers()
        self.forth = [np.zeros((1, 3 * HIDDEN), np.float32)]
        self.back = [np.zeros((1, 3 * HIDDEN), np.float32)]

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 50_000):
            spelled = Spelling(words[k : k + 50_000])
            chars = Characters([spelled]).rows(np.arange(1, spelled.words + 1))
            x = self.network.inputs(spelled.signals(self.gram_signal, self.word_signal), spelled.word % WORD_ROWS, chars)
            p = self.network.params
            self.forth.append((x @ p["in_f"] + p["base_f"]).astype(np.float32))
            self.back.append((x @ p["in_b"] + p["base_b"]).astype(np.float32))

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.forth) > 1:
            self.forth, self.back = [np.concatenate(self.forth)], [np.concatenate(self.back)]
        return self.forth[0], self.back[0]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text."""
        out = []
        for group in _grouped(texts):
            if len(self.number) > KEPT_WORDS:
                self._forget()
            number = self.number.__getitem__
            rows = [list(map(number, t.lower().split())) for t in group]
            if self.number.new:
                self._learn(self.number.new)
                self.number.new = []
            forth, back = self._tables()
            lengths = np.array([len(r) for r in rows], np.int64)
            grid, text = _grid(np.array([i for r in rows for i in r], np.int64), lengths)
            logit = np.empty(len(grid), np.float32)
            for k in range(0, len(grid), 2048):
                part = grid[k : k + 2048].T
                logit[k : k + 2048] = self.network.forward(forth[part], back[part], part > 0)
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            out.append(np.maximum.reduceat(logit, first))
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts).astype(np.float64) + self.shift, -700, 700)))


def _grouped(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    group: list[str] = []
    held = 0
    for text in texts:
        group.append(text or "")
        held += len(group[-1])
        if held >= chars:
            yield group
            group, held = [], 0
    if group:
        yield group


def _signal(presence: list[np.ndarray], label: np.ndarray, least: float = 4.0) -> np.ndarray:
    """Signed root of the likelihood ratio of each bucket's document counts, less what chance reaches."""
    counts = np.zeros((2, BUCKETS))
    for buckets, y in zip(presence, label.tolist()):
        counts[int(y), buckets] += 1
    docs = np.array([(label == 0).sum(), (label == 1).sum()], float)[:, None]
    seen = counts.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = seen * docs / docs.sum()
        missed, expected_missed = docs - counts, docs - expected
        ratio = np.where(counts > 0, counts * np.log(counts / expected), 0).sum(axis=0)
        ratio += np.where(missed > 0, missed * np.log(missed / expected_missed), 0).sum(axis=0)
    sign = np.sign(counts[1] - expected[1])
    root = np.sqrt(np.maximum(2 * ratio, 0))
    return (sign * np.maximum(root - least, 0) / 4).clip(-3, 3).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = 8, seed: int = 3) -> Scorer:
    """A scorer learnt from texts (in a fixed order) and their labels."""
    label = np.array(labels, float)
    network = Network(seed)
    empty = np.zeros(BUCKETS, np.float32)
    scorer = Scorer(network, empty, empty)
    if len(set(labels)) < 2:
        scorer.constant = float((label.sum() + 1) / (len(label) + 2))
        return scorer
    number = Numbers()
    rows = [np.array(list(map(number.__getitem__, t.lower().split())), np.int64) for t in texts]
    parts = [Spelling(number.new[k : k + 50_000]) for k in range(0, len(number.new), 50_000)]
    del number
    word_bucket = np.concatenate([np.zeros(1, np.int32)] + [p.word for p in parts])
    words_in = [np.unique(word_bucket[r]) for r in rows]
    grams_in = _grams_of(rows, parts)
    # The network learns from signals that a text's own label had no part in.
    fold = np.arange(len(rows)) % FOLDS
    signal = []
    scorer.gram_signal, scorer.word_signal = empty.copy(), empty.copy()
    for k in range(FOLDS):
        others = np.flatnonzero(fold != k)
        tables = [_signal([held[i] for i in others], label[others]) for held in (grams_in, words_in)]
        scorer.gram_signal += tables[0] / FOLDS
        scorer.word_signal += tables[1] / FOLDS
        signal.append(np.vstack([np.zeros((1, 4), np.float32), *[p.signals(*tables) for p in parts]]))
    del grams_in, words_in
    chars = Characters(parts)
    word_row = word_bucket % WORD_ROWS
    word_row[0] = 0
    grid, target, of_fold = _training_windows(rows, label, signal, fold, seed)

    def inputs(words: np.ndarray, fold: np.ndarray) -> np.ndarray:
        flat = words.ravel()
        told = np.concatenate([signal[k][words[:, fold == k].ravel()] for k in range(FOLDS)])
        place = np.concatenate([np.flatnonzero(np.broadcast_to(fold == k, words.shape).ravel()) for k in range(FOLDS)])
        ordered = np.empty_like(told)
        ordered[place] = told
        return network.inputs(ordered, word_row[flat], chars.rows(flat))

    _descend(network, grid, target, of_fold, inputs, word_row, chars, epochs, seed)
    _calibrate(scorer, rows, fold, label, inputs)
    return scorer


def _grams_of(rows: list[np.ndarray], parts: list[Spelling]) -> list[np.ndarray]:
    """The distinct n-gram buckets of each text."""
    found: list[list[np.ndarray]] = [[] for _ in rows]
    distinct = [np.unique(r) for r in rows]
    first = 1
    for part in parts:
        for buckets, times in part.grams:
            start = np.cumsum(times) - times
            for k, words in enumerate(distinct):
                own = words[np.searchsorted(words, first) : np.searchsorted(words, first + part.words)] - first
                if len(own):
                    found[k].append(np.unique(buckets[_slices(start[own], times[own])]))
        first += part.words
    return [np.unique(np.concatenate(f)) if f else np.zeros(0, np.int32) for f in found]


def _training_windows(rows, label, signal, fold, seed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's most telling window; of texts with label 0 the two most telling ones and a random one."""
    rng = np.random.default_rng(seed)
    strength = [s[:, :2].sum(axis=1) for s in signal]
    grids, targets, folds = [], [], []
    for words, y, own in zip(rows, label.tolist(), fold.tolist()):
        grid, _ = _grid(words, np.array([len(words)]))
        told = np.sort(strength[own][grid], axis=1)[:, -3:].sum(axis=1)
        chosen = {int(told.argmax())} if y == 0 or told.max() > 0 else set()
        if y == 0:
            chosen |= {*np.argsort(told)[-2:].tolist(), int(rng.integers(0, len(grid)))}
        for k in sorted(chosen):
            grids.append(grid[k])
            targets.append(y)
            folds.append(own)
    # Windows without words are not toxic.
    blank = max(1, len(grids) // 100)
    grids += [np.zeros(WINDOW, np.int64)] * blank
    return np.array(grids), np.array(targets + [0] * blank, np.float32), np.array(folds + [0] * blank)


def _descend(network, grid, target, fold, inputs, word_row, chars, epochs, seed, batch: int = 256, rate: float = 0.01) -> None:
    rng = np.random.default_rng(seed)
    p = network.params
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    rare = np.sqrt((1 - target.mean()) / max(target.mean(), 1e-6))
    weight = np.where(target == 1, rare, 1).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(grid))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            part = grid[chosen].T
            live = part > 0
            x = inputs(part, fold[chosen])
            shape = (*part.shape, 3 * HIDDEN)
            kept: dict = {}
            logit = network.forward(
                (x @ p["in_f"] + p["base_f"]).reshape(shape), (x @ p["in_b"] + p["base_b"]).reshape(shape), live, kept
            )
            error = ((_sigmoid(logit) - target[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            grads, projected = network.backward(error, kept, live)
            d_x = 0
            for side, d in projected.items():
                flat = d.reshape(-1, 3 * HIDDEN)
                grads["in_" + side], grads["base_" + side] = x.T @ flat, flat.sum(axis=0)
                d_x = d_x + flat @ p["in_" + side].T
            grads["words"] = np.zeros_like(p["words"])
            np.add.at(grads["words"], word_row[part.ravel()], d_x[:, 4 : 4 + EMBED])
            grads["chars"] = chars.rows(part.ravel()).T @ d_x[:, 4 + EMBED :]
            step += 1
            for name, g in grads.items():
                first, second = moments[name]
                g = g + np.float32(1e-4) * p[name]
                first += 0.1 * (g - first)
                second += 0.01 * (g * g - second)
                p[name] -= (rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def _calibrate(scorer: Scorer, rows: list[np.ndarray], fold: np.ndarray, label: np.ndarray, inputs) -> None:
    """Slope and shift of a one-dimensional logistic fit of the texts' logits."""
    p, found = scorer.network.params, []
    for words, own in zip(rows, fold):
        part = _grid(words, np.array([len(words)]))[0].T
        x = inputs(part, np.full(part.shape[1], own))
        shape = (*part.shape, 3 * HIDDEN)
        forth, back = ((x @ p["in_" + s] + p["base_" + s]).reshape(shape) for s in "fb")
        found.append(float(scorer.network.forward(forth, back, part > 0).max()))
    logit = np.array(found)
    centre, spread = logit.mean(), logit.std() + 1e-9
    x = (logit - centre) / spread
    a, b = 1.0, float(np.log(label.mean() / (1 - label.mean())))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([(x * (p - label)).sum() + 0.5 * a, (p - label).sum()])
        m = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.linalg.solve(m, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    a = max(a, 1e-3)
    scorer.slope, scorer.shift = a / spread, b - a * centre / spread


def fit(sample: DataFrame) -> Scorer:
    """A scorer from ``(doc_id, text, label)`` rows; the caller bounds their number.

    Training runs in one task, so that texts and arrays never burden the driver; the
    learnt arrays come back, a few MB whatever the sample.
    """

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if frames:
            rows = pd.concat(frames).sort_values(["doc_id", "text"], kind="stable")
            scorer = train(rows["text"].tolist(), rows["label"].tolist())
            yield pd.DataFrame({"learnt": [pickle.dumps(_learnt(scorer))]})

    found = sample.repartition(1).mapInPandas(learn, "learnt binary").collect()
    if not found:
        return train([], [])
    return _rebuilt(pickle.loads(bytes(found[0]["learnt"])))


def _learnt(scorer: Scorer) -> dict:
    """What training has found, as plain arrays and numbers."""
    names = ("gram_signal", "word_signal", "slope", "shift", "constant")
    return {"params": scorer.network.params} | {n: getattr(scorer, n) for n in names}


def _rebuilt(learnt: dict) -> Scorer:
    network = Network()
    network.params = learnt["params"]
    scorer = Scorer(network, learnt["gram_signal"], learnt["word_signal"])
    scorer.slope, scorer.shift, scorer.constant = learnt["slope"], learnt["shift"], learnt["constant"]
    return scorer


def score(text: Column, scorer: Scorer) -> Column:
    """Probability that a whole text is toxic; a worker keeps the scorer and what it knows of words from task to task."""
    learnt = _learnt(scorer)
    name = hashlib.sha256(pickle.dumps(learnt)).hexdigest()

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = kept_by_worker(("toxicity", name), lambda: _rebuilt(learnt))
        for batch in batches:
            yield pd.Series(own.scores(batch.tolist()), dtype="float64")

    return scores(text)
