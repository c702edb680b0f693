"""Benchmark passages in documents by latent semantic retrieval and alignment checks.

Benchmark texts are cut into passages of at most ``PASSAGE`` words.  Document frequencies of their words are
counted over all documents, whose words are numbered once and kept in a written table.  A randomised singular value decomposition of TF-IDF passages (all benchmark
passages and those of all documents) gives a latent space, whose rank grows with the passages; its
power steps run over a written table of passages, and each task adds up its part of the product.  Every document is
then searched by overlapping windows of several lengths, each for passages that are at least as long: windows whose
latent cosine to a benchmark passage is high are candidates, and so is every place that shares ``LEAST_WORDS``
words in a row with a passage, so a passage that stands there word for word is never lost.  A candidate
counts when the longest common subsequence of the passage and the words around the window covers enough of the
passage, or somewhat less of it together with its answer: most of the answer's words in order, or, of an answer of
fewer than ``LEAST_WORDS`` words, all of them in a row, where they are rare enough together (``RARE``) not to stand
there by chance.

The answer of a benchmark item is its ``answer`` column if there is one, else the last sentence of its text.
Characters of scripts that set no blanks between words (Han, Kana, Thai, Lao, Khmer, Burmese) count as words.
Benchmarks are worked through in blocks of ``BLOCK`` items, so what is sent to the tasks has a fixed bound.

Null and empty texts match nothing, nor do benchmark items of fewer than ``LEAST_WORDS`` words, which ordinary
text contains by chance.  Repeated benchmark rows count once.  Rows with null ids are searched like others.
Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.shared import kept_by_worker, written

# Blocks of scripts without blanks between words.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED_LETTER = re.compile(f"[{UNSPACED}]")
WORD = re.compile(f"[^\\W_{UNSPACED}]+|[{UNSPACED}]")
PASSAGE = 64
HALVES = {4: 0.45, 8: 0.5, 16: 0.55}  # words of half a window, and the least cosine of its candidates
LEAST_WORDS = 6
BLOCK = 2048
AT_ONCE = 1 << 17  # words that are searched at once
COMMON = 256  # words whose columns are multiplied as a dense matrix
RANK, MOST_RANK, EXTRA = 64, 256, 16
BITS = 2048  # of a set of words; words may share a bit
PER_DIRECTION = 4  # passages that share a direction of the latent space, within the bounds of its rank
SURE, LIKELY, ANSWER = 0.6, 0.45, 0.8
RARE = 8.0  # least sum of inverse document frequencies (natural logarithms) of a short answer's words
FOUND = "doc_id bigint, item_id bigint, cosine double, covered double, answered double, first_word bigint, n_words bigint"


ASCII_WORDS = {c: chr(c).lower() if chr(c).isalnum() else " " for c in range(128)}


def words_of(text: str | None) -> list[str]:
    text = text or ""
    if text.isascii():
        return text.translate(ASCII_WORDS).split()
    text = text.lower()
    if UNSPACED_LETTER.search(text):
        return WORD.findall(text)
    for letter in set(text):
        if not letter.isalnum():
            text = text.replace(letter, " ")
    return text.split()


@dataclass
class Passage:
    item: int
    words: list[str]
    answer: list[str]


def passages_of(items: list[tuple[int, str | None, str | None]]) -> list[Passage]:
    """Passages of benchmark items ``(id, text, answer)``; the parts of a long item are about equally long."""
    found = []
    for item, text, answer in items:
        words = words_of(text)
        if len(words) < LEAST_WORDS:
            continue
        if answer is None:
            answer = re.split(r"(?<=[.!?])\s+", (text or "").strip())[-1]
        parts = -(-len(words) // PASSAGE)
        size = -(-len(words) // parts)
        for k in range(0, len(words), size):
            found.append(Passage(item, words[k : k + size], words_of(answer)))
    return found


class Aligner:
    """Length of the longest common subsequence with a fixed list of word numbers, one bit per word."""

    def __init__(self, words: list[int]):
        self.words, self.size = words, len(words)
        self.masks: dict[int, int] = {}
        for k, word in enumerate(words):
            self.masks[word] = self.masks.get(word, 0) | 1 << k
        self.times = {word: mask.bit_count() for word, mask in self.masks.items()}

    def at_most(self, words: set[int]) -> int:
        """No text of these words has more in common."""
        return sum(map(self.times.__getitem__, self.times.keys() & words))

    def common(self, words: list[int]) -> int:
        full = (1 << self.size) - 1
        open_ = full
        masks = self.masks
        for word in words:
            if word in masks:
                used = open_ & masks[word]
                open_ = ((open_ + used) | (open_ - used)) & full
        return self.size - open_.bit_count()

    def within(self, words: list[int]) -> bool:
        """Whether all words stand in a row."""
        return any(words[k : k + self.size] == self.words for k in range(len(words) - self.size + 1) if words[k] == self.words[0])


class Detector:
    """Finds the passages of one benchmark block in texts."""

    def __init__(self, passages: list[Passage], number: dict[str, int], latent: np.ndarray, idf: np.ndarray | None = None):
        """``idf``: inverse document frequencies by word number; without them short answers never count."""
        self.passages, self.number = passages, number
        self.latent = np.vstack([latent, np.zeros((1, latent.shape[1]))]).astype(np.float32)
        rows = np.stack([self.latent[[number[w] for w in p.words]].sum(axis=0) for p in passages])
        self.sought = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).T.astype(np.float32)
        self.sizes = np.array([len(p.words) for p in passages])
        halves = np.array(list(HALVES))
        own = halves[np.maximum(np.searchsorted(2 * halves, self.sizes, side="right") - 1, 0)]
        self.by_half = {int(h): np.flatnonzero(own == h) for h in np.unique(own)}
        self.runs: dict[int, list[tuple[int, int]]] = {}
        for k, p in enumerate(passages):
            for at, run in enumerate(_runs(np.array([number[w] for w in p.words], np.int64)).tolist()):
                self.runs.setdefault(run, []).append((k, at))
        self.known = np.zeros(1 << 22, bool)
        self.known[np.array(list(self.runs), np.int64) & (len(self.known) - 1)] = True
        self.aligners = [Aligner([number[w] for w in p.words]) for p in passages]
        # With the words that are not the first of their bit, no text has fewer bits than words in common.
        held = [sorted({number[w] % BITS for w in p.words}) for p in passages]
        self.masks = np.zeros((len(passages), BITS + 1), bool)
        for k, places in enumerate(held):
            self.masks[k, places] = True
        self.masks = _packed(self.masks[:, :BITS])
        self.repeated = self.sizes - np.array([len(places) for places in held])
        # Words of an answer that no passage has stand nowhere (-1).
        self.answers = [Aligner([number.get(w, -1) for w in p.answer]) for p in passages]
        self.telling = [
            idf is not None and -1 not in a.masks and sum(idf[w] for w in a.masks) >= RARE for a in self.answers
        ]

    def matches(self, texts: list[str | None]) -> Iterator[list[tuple[int, float, float, float, int, int]]]:
        """Per text its matches ``(item, cosine, covered, answered, first word, words)``, one per item."""
        for group in _grouped(texts):
            yield from self._group(*_numbers(group, self.number))

    def matches_of_numbers(self, flat: np.ndarray, sizes: np.ndarray) -> Iterator[list[tuple]]:
        """``matches`` of texts whose words are numbered already, one text after the other."""
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            begin = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, begin + AT_ONCE, side="right")))
            yield from self._group(flat[begin : ends[to - 1]], sizes[at:to])
            at = to

    def _group(self, flat: np.ndarray, sizes: np.ndarray) -> Iterator[list]:
        unknown = len(self.number)
        widest, half = max(HALVES), min(self.by_half)
        blocks = -(-sizes // widest)
        ids = np.full(int(blocks.sum()) * widest, unknown, np.int64)
        shift = (np.cumsum(blocks) - blocks) * widest - (np.cumsum(sizes) - sizes)
        ids[np.arange(len(flat)) + np.repeat(shift, sizes)] = flat
        sums = np.zeros((len(ids) // half, self.latent.shape[1]), np.float32)
        for place in ids.reshape(-1, half).T:
            sums += self.latent[place]  # the row of unknown words is zero
        found: list[tuple[np.ndarray, ...]] = []
        while True:
            if half in self.by_half:
                found += self._near(sums, blocks * (widest // half), half)
            if half == widest:
                break
            sums, half = sums[::2] + sums[1::2], 2 * half
        found += self._shared(ids, blocks * widest)
        first = np.cumsum(blocks) - blocks
        best: list[dict[int, tuple]] = [{} for _ in sizes]
        if found:
            candidates = [np.concatenate(c) for c in zip(*found)]
            bits = _bits(np.where(ids == unknown, BITS, ids % BITS).reshape(-1, widest))
            alike = self._alike(bits, blocks, first, *candidates[:4])
            self._confirm(ids, first * widest, sizes, [c[alike].tolist() for c in candidates], best)
        for matches in best:
            yield [matches[k] for k in sorted(matches)]

    def _near(self, sums: np.ndarray, blocks: np.ndarray, half: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Text, passage, first word, words and cosine of windows near passages."""
        passages = self.by_half[half]
        sought = self.sought[:, passages]
        owner = np.repeat(np.arange(len(blocks)), blocks)
        last = np.r_[owner[1:] != owner[:-1], True][: len(owner)]
        # The last block of a longer text is part of the window before it.
        held = np.flatnonzero(~last | np.repeat(blocks == 1, blocks))
        starts = np.cumsum(blocks) - blocks
        for k in range(0, len(held), 8192):
            place = held[k : k + 8192]
            window = sums[place]
            more = np.flatnonzero(~last[place])
            window[more] += sums[place[more] + 1]
            norm = np.sqrt(np.einsum("ij,ij->i", window, window))
            known = np.flatnonzero(norm > 1e-9)
            place = place[known]
            cosine = (window[known] / norm[known, None]) @ sought
            i, p = np.divmod(np.flatnonzero(cosine >= HALVES[half]), len(passages))
            if len(i):
                text = owner[place]
                first = (place - starts[text]) * half
                yield text[i], passages[p], first[i], np.full(len(i), 2 * half), cosine[i, p].astype(float)

    def _shared(self, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """The places where a text shares a run of words with a passage, as ``_near`` has them."""
        runs = _runs(ids)
        starts = np.cumsum(sizes) - sizes
        found: set[tuple[int, int, int]] = set()
        for at in np.flatnonzero(self.known[runs & (len(self.known) - 1)]).tolist():
            for p, offset in self.runs.get(int(runs[at]), ()):
                t = int(np.searchsorted(starts, at, side="right")) - 1
                found.add((t, p, max(0, at - int(starts[t]) - offset)))
        rows = []
        for t, p, first in sorted(found):
            size, place = self.aligners[p].size, int(starts[t]) + first
            row = self.latent[ids[place : min(place + size, int(starts[t] + sizes[t]))]].sum(axis=0)
            cosine = float(row @ self.sought[:, p]) / max(float(np.linalg.norm(row)), 1e-12)
            rows.append((t, p, first, size, cosine))
        return [tuple(np.array(c) for c in zip(*rows))] if rows else []

    def _alike(self, bits, blocks, starts, text, passage, first, width) -> np.ndarray:
        """Candidates whose surroundings hold enough bits of the passage's words."""
        widest = max(HALVES)
        low = starts[text] + np.maximum(0, first - PASSAGE) // widest
        high = np.minimum(starts[text] + blocks[text], starts[text] + (first + width + PASSAGE) // widest + 1)
        kept, span = np.zeros(len(text), bool), len(bits) + 1
        regions, place = np.unique(low * span + high, return_inverse=True)
        regions = np.stack([regions // span, regions % span])
        order = np.argsort(place)
        place = place[order]
        for k in range(0, len(order), 8192):
            part = order[k : k + 8192]
            from_, to = int(place[k]), int(place[min(k + 8192, len(order)) - 1]) + 1
            held = np.bitwise_or.reduceat(bits, regions[:, from_:to].T.ravel(), axis=0)[::2]
            p = passage[part]
            shared = np.bitwise_count(held[place[k : k + 8192] - from_] & self.masks[p]).sum(axis=1)
            kept[part] = shared + self.repeated[p] >= LIKELY * self.sizes[p]
        return np.flatnonzero(kept)

    def _confirm(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, candidates: list[list], best: list[dict]) -> None:
        """Adds the matches among candidates to the best ones of their texts."""
        starts, sizes = starts.tolist(), sizes.tolist()
        for t, p, start, width, cosine in zip(*candidates):
            passage, aligner = self.passages[p], self.aligners[p]
            size = aligner.size
            first = max(0, start - size)
            region = ids[starts[t] + first : starts[t] + min(sizes[t], start + width + size)].tolist()
            if aligner.at_most(set(region)) < LIKELY * size:
                continue
            covered = aligner.common(region) / size
            if covered < LIKELY:
                continue
            answer = self.answers[p]
            answered = answer.common(region) / answer.size if answer.size else 0.0
            if answer.size < LEAST_WORDS:
                told = self.telling[p] and answered == 1 and answer.within(region)
            else:
                told = answered >= ANSWER
            if covered >= SURE or told:
                found = (passage.item, cosine, covered, answered, first, len(region))
                known = best[t].get(passage.item)
                if known is None or (found[2], found[1]) > (known[2], known[1]):
                    best[t][passage.item] = found


def _packed(held: np.ndarray) -> np.ndarray:
    return np.packbits(held, axis=1, bitorder="little").view(np.uint64)


def _bits(places: np.ndarray) -> np.ndarray:
    """A row of ``BITS`` bits for each row of places, and one without; the place ``BITS`` stands for none."""
    found = np.zeros((len(places) + 1, BITS // 64), np.uint64)
    for k in range(0, len(places), 4096):
        part = places[k : k + 4096]
        held = np.zeros((len(part), BITS + 1), bool)
        held[np.arange(len(part))[:, None], part] = True
        found[k : k + len(part)] = _packed(held[:, :BITS])
    return found


def _runs(ids: np.ndarray) -> np.ndarray:
    """A hash of the ``LEAST_WORDS`` words that begin at each place."""
    size = max(0, len(ids) - LEAST_WORDS + 1)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(size, np.uint64)
    for k in range(LEAST_WORDS):
        total = (total ^ mixed[k : k + size]) * np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
    return (total >> np.uint64(1)).astype(np.int64)


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


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Distinct benchmark items in blocks of about ``BLOCK``."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")
    ).where("text IS NOT NULL").distinct()
    count = items.count()
    blocks = -(-count // BLOCK)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield sorted(((r[0], r[1], r[2]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _numbers(texts: list[str | None], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of texts, one text after the other (unknown words: one more than the last), and their counts."""
    flat: list[int] = []
    sizes = []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        flat += map(number.get, words, repeat(len(number)))
    return np.array(flat, np.int32), np.array(sizes, np.int64)


def _begin(step: str) -> None:
    """A worker that comes from other operators or steps drops and gives back what it has of them."""
    kept_by_worker(("decontaminate", step), lambda: None)


def _numbered(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """Ids of documents and numbers of all their words, so that texts are cut into words once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin("numbers")
        for batch in batches:
            flat, sizes = _numbers(batch.column(1).to_pylist(), number)
            ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["doc_id", "words"])

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(plain.mapInArrow(cut, "doc_id bigint, words array<int>"), "numbers")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of lists, one list after the other, and their counts."""
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy()).astype(np.int64)


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and how often each occurs."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    return codes[first], np.diff(np.r_[first, len(codes)])


def _frequencies(numbered: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Number of documents with each word, and of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin("frequencies")
        docs, held = 0, np.zeros(size + 1, np.int64)
        for batch in batches:
            docs += batch.num_rows
            flat, sizes = _lists(batch.column(0))
            codes, _ = _counted(np.repeat(np.arange(len(sizes)), sizes) * (size + 1) + flat)
            held += np.bincount(codes % (size + 1), minlength=size + 1)
        ids = np.flatnonzero(held[:size])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, ids], pa.int32()), pa.array(np.r_[docs, held[ids]], pa.int64())], names=["word", "docs"]
        )

    found = numbered.select("words").mapInArrow(count, "word int, docs bigint").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    frequency = np.zeros(size)
    total = 0
    for word, docs in found:
        if word < 0:
            total = docs
        else:
            frequency[word] = docs
    return frequency, total


def _all_passages(docs: DataFrame, number: dict[str, int], passages: list[Passage]) -> DataFrame:
    """Known words of passages: all of the benchmark and of all documents, whose words may be numbered already."""
    size = len(number)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _lists(batch.column(0))
            parts = -(-sizes // PASSAGE)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            part = np.repeat(np.cumsum(parts) - parts, sizes) + place // PASSAGE
            known = np.flatnonzero(flat < size)
            _, held = _counted(part[known])
            words = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held)].astype(np.int32)), pa.array(flat[known]))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.zeros(len(held), bool))], names=["words", "sought"])

    numbered = docs if "words" in docs.columns else _numbered(docs, number)
    # As an Arrow table, which needs no Python workers of its own kind beside those of the other steps.
    rows = pa.table({
        "words": pa.array([[number[w] for w in p.words] for p in passages], pa.list_(pa.int32())),
        "sought": pa.array([True] * len(passages), pa.bool_()),
    })
    own = docs.sparkSession.createDataFrame(rows, "words array<int>, sought boolean")
    return written(numbered.select("words").mapInArrow(cut, "words array<int>, sought boolean").union(own), "passages")


class Rows:
    """Products with the matrix A of unit TF-IDF rows, benchmark rows weighted, for some rows at a time.

    Columns of the ``common`` words, which hold most entries, are multiplied as a dense matrix, the others entry by entry,
    in single precision (as the latent vectors are); sums over rows are double.
    """

    def __init__(self, idf: np.ndarray, weight: float, basis: np.ndarray, common: np.ndarray):
        self.idf, self.weight, self.basis, self.common = idf, weight, basis.astype(np.float32), common
        self.place = np.full(len(idf), -1)
        self.place[common] = np.arange(len(common))

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """For some rows: dense columns, row, word and value of other entries, and A times the basis."""
        flat, sizes = _lists(batch.column(0))
        weights = np.where(np.array(batch.column(1).to_pylist(), bool), self.weight, 1.0)
        ends = np.cumsum(sizes)
        for k in range(0, len(sizes), 1024):
            held, size = sizes[k : k + 1024], len(self.idf)
            words = flat[ends[k] - sizes[k] : ends[k + len(held) - 1]]
            codes, times = _counted(np.repeat(np.arange(len(held)), held) * size + words)
            row, word = np.divmod(codes, size)
            value = times * self.idf[word]
            norm = np.sqrt(np.bincount(row, value * value, minlength=len(held)))
            value *= (weights[k : k + 1024] / np.maximum(norm, 1e-300))[row]
            place = self.place[word]
            value = value.astype(np.float32)
            dense = np.zeros((len(held), len(self.common)), np.float32)
            often, seldom = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
            dense[row[often], place[often]] = value[often]
            row, word, value = row[seldom], word[seldom], value[seldom]
            found = dense @ self.basis[self.common]
            _add(found, row, value[:, None] * self.basis[word])
            yield dense, row, word, value, found

    def back(self, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """A'A times the basis."""
        total, often = np.zeros(self.basis.shape), np.zeros((len(self.common), self.basis.shape[1]))
        for batch in batches:
            for dense, row, word, value, found in self.parts(batch):
                often += dense.T @ found
                order = np.argsort(word, kind="stable")
                _add(total, word[order], value[order, None] * found[row[order]])
        total[self.common] += often
        return total

    def square(self, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """The basis' own product with A'A times the basis, which needs no way back to the words."""
        total = np.zeros((self.basis.shape[1],) * 2)
        for batch in batches:
            for *_, found in self.parts(batch):
                total += found.T @ found
        return total


def _add(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to those of ``total`` at ascending places."""
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        total[at[first]] += np.add.reduceat(rows, first, axis=0)


def _summed(passages: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of what each task makes of its passages."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin("products")
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), pa.array([work(batches).tobytes()], pa.binary())], names=["part", "total"]
        )

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in parts["total"])
        return pd.DataFrame({"part": [0], "total": [total.tobytes()]})

    parts = passages.select("words", "sought").mapInArrow(make, "part int, total binary")
    # A few parts at a time: each has the fixed size of the basis.
    step = parts.withColumn("part", F.spark_partition_id() % 8).groupBy("part").applyInPandas(add, "part int, total binary")
    return sum((np.frombuffer(r["total"]) for r in step.collect()), np.zeros(shape[0] * shape[1])).reshape(shape)


def latent_words(
    docs: DataFrame, passages: list[Passage], number: dict[str, int], steps: int = 2
) -> tuple[np.ndarray, np.ndarray]:
    """A latent vector for every word, its idf times its row of the leading right singular vectors, and the idf."""
    size = len(number)
    numbered = docs if "words" in docs.columns else _numbered(docs, number)
    frequency, total = _frequencies(numbered, size)
    idf = np.log((total + 1) / (frequency + 1)) + 1e-3
    common = np.argsort(-frequency, kind="stable")[:COMMON]
    table = _all_passages(numbered, number, passages)
    counts = {r["sought"]: r["count"] for r in table.groupBy("sought").count().collect()}
    weight = math.sqrt(max(1.0, counts.get(False, 0) / max(1, counts.get(True, 1))))
    wanted = min(MOST_RANK, max(RANK, len(passages) // PER_DIRECTION))
    rank = min(wanted + EXTRA, size)
    basis = np.linalg.qr(np.random.default_rng(17).standard_normal((size, rank)))[0]
    for _ in range(steps):
        basis = np.linalg.qr(_summed(table, Rows(idf, weight, basis, common).back, basis.shape))[0]
    values, vectors = np.linalg.eigh(_summed(table, Rows(idf, weight, basis, common).square, (rank, rank)))
    leading = basis @ vectors[:, np.argsort(values)[::-1][:wanted]]
    return leading * idf[:, None], idf


def _detectors(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Detector, DataFrame]]:
    """A detector for each block of the benchmark, and the documents in the numbers of its words."""
    for items in _blocks(benchmark):
        passages = passages_of(items)
        number = {w: k for k, w in enumerate(sorted({w for p in passages for w in chain(p.words, p.answer)}))}
        if passages:
            numbered = _numbered(docs, number)
            yield Detector(passages, number, *latent_words(numbered, passages, number)), numbered


def detectors(docs: DataFrame, benchmark: DataFrame) -> Iterator[Detector]:
    """A detector for each block of the benchmark."""
    for detector, _ in _detectors(docs, benchmark):
        yield detector


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it."""
    out = docs.sparkSession.createDataFrame([], FOUND)
    for detector, numbered in _detectors(docs, benchmark):
        out = out.unionByName(numbered.mapInArrow(_finder(detector), FOUND))
    return out


def _finder(detector: Detector):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin("search")
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        names = [c.split(" ")[0] for c in FOUND.split(", ")]
        for batch in batches:
            rows = [
                (doc, *match)
                for doc, matches in zip(batch.column(0).to_pylist(), detector.matches_of_numbers(*_lists(batch.column(1))))
                for match in matches
            ]
            columns = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return find


def contaminated(text: Column, detector: Detector) -> Column:
    """Whether a text holds a passage of the detector's block."""

    @F.pandas_udf("boolean")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _begin("search")
        for batch in batches:
            yield pd.Series([bool(m) for m in detector.matches(batch.tolist())], dtype=bool)

    return held(text)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark passage."""
    for detector in detectors(docs, benchmark):
        docs = docs.where(~contaminated(F.col("text"), detector))
    return docs
