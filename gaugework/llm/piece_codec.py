"""SentencePiece encoding and decoding by vectorised merge rounds.

A text falls into units that no piece can cross (a run of spaces with the characters after it; a line
break).  All units of a batch that were not met before are merged together: one flat array of symbols, the
smallest pair rank of every unit by a segmented minimum, the leftmost occurrences of that pair merged at once,
finished units taken out, until no pair is left.  Unit results are kept per worker up to a fixed count.

Results per text: null and empty texts give the end id alone and decode to the empty text; very long texts,
ties and repeated rows need no special care, since rows are independent.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugework.llm.shared import kept_by_worker

SPACE = "▁"
NO_RANK = np.int32(2**31 - 1)
KEPT_UNITS = 600_000
ROUND_TRIP = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, unchanged boolean"


class PairTable:
    """An open-addressing hash table from symbol pairs to (rank, merged symbol)."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(4, (max(1, len(pairs)) * 5).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NO_RANK, np.int32)
        self.merged = np.zeros(size, np.int32)
        left = np.array([p[0] for p in pairs], np.int64)
        right = np.array([p[1] for p in pairs], np.int64)
        for key, at, value in zip((left << 32 | right).tolist(), self._home(left, right).tolist(), pairs.values()):
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at] = key
            self.ranks[at], self.merged[at] = value

    def _home(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        mixed = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._home(left, right)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            stored = self.keys[at[open_]]
            open_ = open_[(stored != key[open_]) & (stored >= 0)]
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NO_RANK), self.merged[at]


class PieceModel:
    """Pieces of a byte-fallback BPE model file without text normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        kind = [
            "byte" if model.is_byte(i) else "control" if model.is_control(i)
            else "unknown" if model.is_unknown(i) else "piece" for i in range(size)
        ]
        if kind.count("byte") != 256 or any(model.is_unused(i) for i in range(size)):
            raise ValueError("the model needs byte fallback and no unused pieces")
        if model.normalize(" a  ﬁ ") != SPACE * 2 + "a" + SPACE * 2 + "ﬁ" + SPACE:
            raise ValueError("the model normalises texts")
        self.size, self.eos = size, model.eos_id()
        self.bytes_to_id = np.zeros(256, np.int64)
        for i in range(size):
            if kind[i] == "byte":
                self.bytes_to_id[int(names[i][3:5], 16)] = i
        pieces = {names[i]: i for i in range(size) if kind[i] == "piece"}
        self._number_symbols(pieces, {n: model.get_score(i) for n, i in pieces.items()})
        self._tables_for_decoding(names, kind)
        self._units(pieces)

    def _number_symbols(self, pieces: dict[str, int], score: dict[str, float]) -> None:
        symbols = dict(pieces)
        for char in sorted({c for p in pieces for c in p}):
            symbols.setdefault(char, self.size + ord(char))
        self.char_symbol = {ord(s): i for s, i in symbols.items() if len(s) == 1}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {p: order[s] for p, s in score.items()}
        self.table = PairTable({
            (symbols[p[:k]], symbols[p[k:]]): (rank[p], i)
            for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols
        })
        # Pieces after whose making a pair of the same or a better rank may appear beside them.
        best: dict[str, int] = {}
        for p, r in rank.items():
            for k in range(1, len(p)):
                for part in (p[:k], p[k:]):
                    best[part] = min(best.get(part, r), r)
        self.unsafe = np.zeros(self.size, bool)
        for p, i in pieces.items():
            self.unsafe[i] = best.get(p, NO_RANK) <= rank[p]

    def _tables_for_decoding(self, names: list[str], kind: list[str]) -> None:
        shown = []
        for name, what in zip(names, kind):
            if what == "byte":
                shown.append(bytes([int(name[3:5], 16)]))
            elif what == "piece":
                shown.append(name.replace(SPACE, " ").encode())
            else:
                shown.append(b"" if what == "control" else " ⁇ ".encode())
        self.is_byte = np.array([k == "byte" for k in kind])
        self.opens = np.array([k == "piece" and n[0] == SPACE for n, k in zip(names, kind)])
        self.shown_len = np.array([len(b) for b in shown], np.int64)
        self.shown_start = np.concatenate([[0], np.cumsum(self.shown_len)[:-1]])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_bytes = shown

    def _units(self, pieces: dict[str, int]) -> None:
        inner = [p for p in pieces if any(c != SPACE and d == SPACE for c, d in zip(p, p[1:]))]
        if inner:
            raise ValueError("a piece spans words")
        self.names = list(map(str, range(self.size)))
        line = r" *[^ ]+| +" if any("\n" in p for p in pieces) else r" *[^ \n]+|\n| +"
        self.unit = re.compile(self._space_block(pieces) + line)

    def _space_block(self, pieces: dict[str, int]) -> str:
        """A pattern that cuts long runs of spaces into the pieces that they begin with anyway."""
        most = max((len(p) for p in pieces if set(p) == {SPACE}), default=1)
        if any(SPACE * 2 in p and set(p) != {SPACE} for p in pieces):
            return ""

        def run(spaces: int) -> list[int]:
            return self.merge([" " * spaces])[0].tolist()

        first = run(4 * most)[0]
        block = int(self.shown_len[first])
        steady = all(run(n) == [first, *run(n - block)] for n in range(3 * most, 5 * most))
        return f" {{{block}}}(?= {{{2 * most}}} )|" if steady else ""

    def merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in one flat array and the number of ids of each unit."""
        points = np.frombuffer("".join(units).replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        known, place = np.unique(points, return_inverse=True)
        codes = np.array([self.char_symbol.get(p, self.size + p) for p in known.tolist()], np.int64)
        sym = codes[place] if len(points) else points
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        done_sym, done_unit = [], []
        rank, merged = self._pairs(sym, unit, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            length = np.diff(np.r_[first, len(sym)])
            least = np.repeat(np.minimum.reduceat(rank, first), length)
            over = least == NO_RANK
            if over.any():
                done_sym.append(sym[over])
                done_unit.append(unit[over])
                live = ~over
                sym, unit, rank, merged, least = sym[live], unit[live], rank[live], merged[live], least[live]
                if not len(sym):
                    break
            at = self._leftmost(np.flatnonzero(rank == least), sym, unit, rank, merged)
            sym[at] = merged[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            sym, unit, rank, merged = sym[stay], unit[stay], rank[stay], merged[stay]
            touched = moved[at]
            touched = np.unique(np.r_[touched, touched[touched > 0] - 1])
            rank[touched], merged[touched] = self._pairs(sym, unit, touched)
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        unit = np.concatenate(done_unit) if done_unit else np.zeros(0, np.int64)
        order = np.argsort(unit, kind="stable")
        return self._fall_back(sym[order], unit[order], len(units))

    def _pairs(self, sym: np.ndarray, unit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin at the given places."""
        rank, merged = np.full(len(at), NO_RANK, np.int32), np.zeros(len(at), np.int32)
        inside = np.flatnonzero(at + 1 < len(sym))
        inside = inside[unit[at[inside]] == unit[at[inside] + 1]]
        rank[inside], merged[inside] = self.table.find(sym[at[inside]], sym[at[inside] + 1])
        return rank, merged

    def _leftmost(self, at, sym, unit, rank, merged) -> np.ndarray:
        """Of the best pairs of each unit, those that a strict left-to-right order merges next."""
        run = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (unit[at[1:]] != unit[at[:-1]])])
        offset = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        at = at[offset % 2 == 0]
        made = merged[at]
        if not self.unsafe[made].any():
            return at
        # A merge that opens an equal or better pair is the last one of its unit in this round.
        stop = np.zeros(len(at), bool)
        after = np.minimum(at + 2, len(sym) - 1)
        right = (at + 2 < len(sym)) & (unit[after] == unit[at])
        stop |= right & (self.table.find(made, sym[after])[0] <= rank[at])
        before = np.maximum(at - 1, 0)
        left_sym = sym[before]
        joined = np.flatnonzero(np.r_[False, at[1:] == at[:-1] + 2])
        left_sym[joined] = made[joined - 1]
        left = (at > 0) & (unit[before] == unit[at])
        stop |= left & (self.table.find(left_sym, made)[0] <= rank[at])
        stops = np.cumsum(stop) - stop
        first = np.flatnonzero(np.r_[True, unit[at[1:]] != unit[at[:-1]]])
        return at[stops == np.repeat(stops[first], np.diff(np.r_[first, len(at)]))]

    def _fall_back(self, sym: np.ndarray, unit: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            spelled = [self.bytes_to_id[list(chr(c).encode())] for c in (sym[odd] - self.size).tolist()]
            count = np.ones(len(sym), np.int64)
            count[odd] = [len(s) for s in spelled]
            start = np.cumsum(count) - count
            sym, unit = np.repeat(sym, count), np.repeat(unit, count)
            places = np.concatenate([start[o] + np.arange(len(s)) for o, s in zip(odd.tolist(), spelled)])
            sym[places] = np.concatenate(spelled)
        return sym, np.bincount(unit, minlength=units)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids, the first space dropped if the text begins with a piece."""
        ids = ids[self.shown_len[ids] > 0]
        if not len(ids):
            return ""
        length = self.shown_len[ids]
        begin = np.cumsum(length) - length
        raw = self.shown[np.repeat(self.shown_start[ids] - begin, length) + np.arange(begin[-1] + length[-1])].tobytes()
        if self.opens[ids[0]]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: np.ndarray) -> str:
        """Runs of byte ids that are not UTF-8: each stray byte becomes a replacement character."""
        out, run = [], b""

        def flush(run: bytes) -> str:
            text, k = [], 0
            while k < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        text.append(run[k : k + n].decode())
                        k += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text.append("�")
                    k += 1
            return "".join(text)

        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.shown_bytes[i]
            else:
                out.append(flush(run) + self.shown_bytes[i].decode())
                run = b""
        text = "".join(out) + flush(run)
        return text[1:] if self.opens[ids[0]] else text


class Places(dict):
    """Numbers units in the order of their first appearance; ``new`` holds those not yet merged."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = place = len(self)
        self.new.append(unit)
        return place


class Codec:
    """Encodes and decodes texts; unit results stay until ``KEPT_UNITS`` of them are held."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self._forget()

    def _forget(self) -> None:
        self.place = Places()
        self.spelled: list[str] = []
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def _learn(self, units: list[str]) -> None:
        flat, count = self.model.merge(units)
        spelled = [self.model.names[i] for i in flat.tolist()]
        start = np.cumsum(count) - count
        self.spelled += [" ".join(spelled[a : a + n]) for a, n in zip(start.tolist(), count.tolist())]
        self.start = np.r_[self.start, start + len(self.ids)]
        self.count = np.r_[self.count, count]
        self.ids = np.r_[self.ids, flat.astype(np.int32)]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """Per text its ids with the end id, and the same ids as decimal text."""
        split = self.model.unit.findall
        for group in _grouped(texts):
            if len(self.place) > KEPT_UNITS:
                self._forget()
            # The model sets one space before every text that is not empty.
            number = self.place.__getitem__
            places = [list(map(number, split(" " + t.replace(SPACE, " ")))) if t else [] for t in group]
            if self.place.new:
                self._learn(self.place.new)
                self.place.new = []
            for place in places:
                at = np.array(place, np.int64)
                count = self.count[at]
                begin = np.cumsum(count) - count
                total = int(count.sum())
                ids = np.empty(total + 1, np.int32)
                ids[:total] = self.ids[np.repeat(self.start[at] - begin, count) + np.arange(total)]
                ids[total] = self.model.eos
                yield ids, " ".join([*[self.spelled[p] for p in place], str(self.model.eos)])

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(np.asarray(ids))


def _grouped(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in order, in groups of about ``chars`` characters, so that memory does not follow the batch."""
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


def codec(path: str) -> Codec:
    """This worker's codec of a model file."""
    return kept_by_worker(("piece codec", path), lambda: Codec(path))


def encode(text: Column, path: str) -> Column:
    """Ids of each text, the end id last."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for batch in batches:
            yield pd.Series([i for i, _ in own.encode(batch.tolist())], dtype=object)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Text of each id sequence (null: empty)."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for batch in batches:
            yield pd.Series([own.decode(i if i is not None else np.zeros(0, np.int64)) for i in batch], dtype=object)

    return text(ids)


def round_trip(text: Column, path: str) -> Column:
    """Token count and digests of the ids and of the decoded text, without moving the ids."""

    @F.pandas_udf(ROUND_TRIP)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            texts = batch.tolist()
            rows = []
            for text, (ids, spelled) in zip(texts, own.encode(texts)):
                decoded = own.decode(ids)
                rows.append((
                    len(ids), hashlib.sha256(spelled.encode()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(), decoded == (text or ""),
                ))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "unchanged"])

    return digests(text)
