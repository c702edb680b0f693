"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

The count of a word is its number of initial symbols less the number of merges: the adjacent pair with the
lowest rank is popped again and again, its two list nodes become one, and the pairs beside it are pushed.
Counts of blank-separated chunks are kept per worker up to a fixed number of them.

Null and empty texts have no bytes and no tokens.  Long texts, ties and repeated rows need no special care.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from string import punctuation

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugework.llm.shared import kept_by_worker

KEPT_CHUNKS = 700_000
SPLIT = {"type": "Split", "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def simple_words(chunk: str) -> list[str] | None:
    """The lower-case word and the punctuation after it, if a chunk is no more than that."""
    word = chunk.rstrip(punctuation)
    if word.isalpha() and (word.isascii() or "Σ" not in word and unicodedata.is_normalized("NFC", word)):
        low = word.lower()
        if low.isalpha():
            return [low] if len(word) == len(chunk) else [low, chunk[len(word) :]]
    return None


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(shown)))
    return [letters[b] for b in range(256)]


class WordSplitter:
    """Words of a text as a word-end BPE file defines them: NFC, blanks joined, lower case, split."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.spec = spec = json.load(file)
        steps = spec["normalizer"]["normalizers"]
        split, to_bytes = spec["pre_tokenizer"]["pretokenizers"]
        if (
            [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]
            or steps[1]["pattern"] != {"Regex": "\\s+"} or steps[1]["content"] != " "
            or {k: split[k] for k in SPLIT} != SPLIT or to_bytes != BYTES
            or any(spec["model"][k] for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
        ):
            raise ValueError("the file asks for steps that are not built here")
        # The file's \s means Unicode white space.
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        added = [t for t in spec["added_tokens"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens with options are not built here")
        self.added = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in added) + ")") if added else None
        self.added_ids = {t["content"]: t["id"] for t in added}

    def plain_words(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        text = unicodedata.normalize("NFC", text)
        # Character by character: the library knows no final sigma.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return self.words.findall(text)

    def lowered(self, text: str) -> str:
        """The text in lower case where that changes no result: fewer distinct chunks."""
        return text if "Σ" in text or self.added and "<" in text else text.lower()

    def parts(self, text: str) -> list[str]:
        """Texts without added tokens at even places, added tokens at odd places."""
        return self.added.split(text) if self.added and "<" in text else [text]


class WordBpe(WordSplitter):
    """Counts tokens by merging the bytes of each word."""

    def __init__(self, path: str):
        super().__init__(path)
        spec = self.spec
        self.letters = byte_letters()
        self.end = spec["model"]["end_of_word_suffix"] or ""
        vocab = spec["model"]["vocab"]
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if left + right in vocab:
                self.ranks[left, right] = rank
        if any(b + e not in vocab for b in self.letters for e in {"", self.end}):
            raise ValueError("the vocabulary lacks single bytes")
        self.chunks: dict[str, int] = {}
        self.counts: dict[str, int] = {}
        del self.spec

    def merged(self, word: str) -> int:
        """Tokens left of one word: symbols less merges."""
        symbols: list = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.end
        count = len(symbols)
        after = [*range(1, count), -1]
        before = [*range(-1, count - 1)]
        rank = self.ranks.get
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(count - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = left + right, None
            count -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return count

    def word(self, word: str) -> int:
        found = self.counts.get(word)
        if found is None:
            found = self.counts[word] = self.merged(word)
        return found

    def chunk(self, chunk: str) -> int:
        simple = simple_words(chunk)
        if simple:
            return sum(map(self.word, simple))
        parts = self.parts(chunk)
        # Odd places hold the added tokens themselves.
        return len(parts) // 2 + sum(self.word(w) for p in parts[::2] if p for w in self.plain_words(p))

    def count(self, text: str | None) -> int:
        """Blanks and line breaks end words in any case, so chunks between them can be counted alone."""
        if not text:
            return 0
        chunks = self.lowered(text).replace("\n", " ").split(" ")
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks = {}
            self.counts = {}
        known = self.chunks
        total = 0
        for chunk in chunks:
            try:
                total += known[chunk]
            except KeyError:
                known[chunk] = found = self.chunk(chunk)
                total += found
        return total


def counter(path: str) -> WordBpe:
    return kept_by_worker(("word bpe", path), lambda: WordBpe(path))


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of each whole text."""

    @F.pandas_udf("bigint")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for batch in batches:
            yield pd.Series([own.count(t) for t in batch], dtype="int64")

    return counts(text)
