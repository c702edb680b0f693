"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct word shingles.  Its sketch has ``bands * rows`` coordinates: in round i each
element falls into a hashed bin with a value in [i, i + 1) and bins keep the least value, until every bin is
filled; after as many rounds as there are bins, round i serves bin i alone, which guarantees filling.  Two
sketches agree in a coordinate with the probability of the sets' resemblance, with concentration bounds.

Documents with the same set form a class with one representative.  Representatives that agree in a whole band
share a bucket.  Within a bucket, members are first compared with a few pivots, the best connected one first;
what these links join is one component and needs no more comparisons.  Members outside their bucket's main
component are left.  For these an exact filter takes over: under any common order of the shingles, two sets that
resemble each other at least by t share a shingle among the first n - ceil(t * n) + 1 of each, n being its size,
and from the first shared shingle on both must hold as many as the intersection needs, t / (1 + t) of both sizes.
Shingles are put in ascending order of their frequency in a bounded sample, so that the texts of a large group
meet by what few of them have; the order changes the work, never the result.  So every pair of a bucket is
joined, compared or excluded, and no group is expanded into all its pairs.  Every link is confirmed on the full
sets (64-bit hashes of the shingles).

With 64 bands of 7 rows a pair at resemblance 0.8 is missed with probability 2.8e-7, one at 0.3 shares a bucket
with probability 0.014.

Texts null, empty or without words have an empty set and link with nothing.  Rows that share an id count as one
document.  Rows with a null id link with nothing, have no component and are kept.  Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.components import components
from gaugework.llm.shared import kept_by_worker, written

CHUNK_BYTES, CHUNK_TEXTS = 1 << 20, 1000
ORDER_DOCS, ORDER_BITS = 5000, 18  # sample and table size for the order of shingles
FEW_IDS = 1_000_000  # ids that are broadcast, 16 MB at most
CROWD = 20_000  # documents with the same set from which their class is broadcast
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hasher:
    """Shingle sets and band keys of texts, computed over flat arrays."""

    def __init__(self, words: int, bands: int, rows: int):
        self.words, self.bands, self.rows = words, bands, rows
        self.letter = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        base = 0x2545F4914F6CDD1D
        inverse = pow(base, -1, 1 << 64)
        self.power, self.inverse = (self._series(b, n) for b in (base, inverse))

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        out = np.ones(n, U)
        filled = 1
        while filled < n:
            step = U(pow(base, filled, 1 << 64))
            more = min(filled, n - filled)
            out[filled : filled + more] = out[:more] * step
            filled += more
        return out

    def word_hashes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A hash of every word and the number of its text."""
        data = [(t or "").encode().lower() for t in texts]  # of bytes: only A-Z change
        flat = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
        if len(flat) > len(self.power):
            self._powers(len(flat) * 2)
        blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
        edge = np.diff(np.r_[True, blank].astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.r_[U(0), np.cumsum(self.letter[flat] * self.power[: len(flat)], dtype=U)]
        hashes = mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(U))
        ends = np.cumsum([len(d) + 1 for d in data])
        return hashes, np.searchsorted(ends, start, side="right")

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes, ascending within each text, and the number of the text."""
        word, text = self.word_hashes(texts)
        k = self.words
        count = np.bincount(text, minlength=len(texts))
        first = np.cumsum(count) - count
        whole = np.flatnonzero(text[: max(0, len(text) - k + 1)] == text[k - 1 :]) if len(text) >= k else np.zeros(0, np.int64)
        joined = word[whole]
        for j in range(1, k):
            joined = mix(joined * U(0xD6E8FEB86659FD93) + word[whole + j])
        owner = text[whole]
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            single = []
            for t in short.tolist():
                h = U(count[t])
                for w in word[first[t] : first[t] + count[t]]:
                    h = mix(np.array([h ^ w], U))[0]
                single.append(h)
            joined, owner = np.r_[joined, np.array(single, U)], np.r_[owner, short]
        order = np.lexsort((joined, owner))
        joined, owner = joined[order], owner[order]
        new = np.r_[True, (joined[1:] != joined[:-1]) | (owner[1:] != owner[:-1])][: len(joined)]
        return joined[new], owner[new]

    def sketches(self, elements: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """One row of ``bands * rows`` coordinates per text (texts without elements: undefined rows)."""
        t = self.bands * self.rows
        empty = U(0xFFFFFFFFFFFFFFFF)
        bins = np.full(texts * t, empty, U)
        left, left_owner = elements, owner
        for i in range(2 * t):
            value = mix(left + U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            if i < t:
                bin_ = ((value & U(0xFFFFFFFF)) * U(t) >> U(32)).astype(np.int64)
            else:
                bin_ = i - t
            # The round stands above the hash, so later rounds never replace a filled bin.
            np.minimum.at(bins, left_owner * t + bin_, (mix(value) >> U(12)) | (U(i) << U(52)))
            open_ = (bins.reshape(texts, t) == empty).any(axis=1)
            stay = open_[left_owner]
            left, left_owner = left[stay], left_owner[stay]
            if not len(left):
                break
        return bins.reshape(texts, t)

    def band_keys(self, sketches: np.ndarray) -> np.ndarray:
        parts = sketches.reshape(len(sketches), self.bands, self.rows)
        key = np.broadcast_to(mix(np.arange(1, self.bands + 1, dtype=U)), parts.shape[:2]).copy()
        for j in range(self.rows):
            key = mix(key * U(0xD6E8FEB86659FD93) + parts[:, :, j])
        return key


def _hasher(words: int, bands: int, rows: int) -> Hasher:
    return kept_by_worker(("fast sketch", words, bands, rows), lambda: Hasher(words, bands, rows))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Row ranges of bounded bytes and rows; one row may be larger."""
    texts, start, held = batch.column(1).to_pylist(), 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= CHUNK_BYTES or i + 1 - start >= CHUNK_TEXTS or i + 1 == len(texts):
            yield batch.column(0).slice(start, i + 1 - start), texts[start : i + 1]
            start, held = i + 1, 0


def _fingerprints(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands``: the set's digest and band keys, null for empty sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _hasher(words, bands, rows)
        for batch in batches:
            for ids, texts in _chunks(batch):
                elements, owner = own.sets(texts)
                count = np.bincount(owner, minlength=len(texts))
                ends = np.cumsum(count)
                digests = [
                    hashlib.blake2b(elements[e - c : e].tobytes(), digest_size=16).digest() if c else None
                    for c, e in zip(count.tolist(), ends.tolist())
                ]
                keys = own.band_keys(own.sketches(elements, owner, len(texts)))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(count), pa.array(digests, pa.binary()), lists],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )

    return _plain(docs).mapInArrow(sketch, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, elements``: the sorted 64-bit shingle hashes of the wanted documents."""
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
    wanted = _plain(docs).join(ids, F.col("doc_id") == F.col("id"), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _hasher(words, 1, 1)
        for batch in batches:
            for ids, texts in _chunks(batch):
                elements, owner = own.sets(texts)
                ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
                blobs = [elements[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(blobs, pa.binary())], names=["id", "elements"])

    return written(wanted.mapInArrow(sets, "id bigint, elements binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets resemble each other enough."""
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("of_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(linked, pa.bool_())
            )

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "of_a", "of_b")
    return written(joined.mapInArrow(compare, "a bigint, b bigint"), "links")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _alike_sizes(n: Column, m: Column, percent: int) -> Column:
    """Sets of sizes n and m cannot resemble each other more than the ratio of the sizes."""
    return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))


def _labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket rows with the component that their document belongs to so far."""
    known = labels.select(F.col("a").alias("id"), F.col("b").alias("_root"))
    return shared.join(known, "id", "left").withColumn("part", F.coalesce("_root", "id")).drop("_root")


def _pivot_pairs(rows: DataFrame, pivots: int, percent: int) -> DataFrame:
    """Each member of a mixed bucket with the bucket's pivots from other components.

    The first pivot is the member that meets most others; the other pivots are drawn by hashes of the ids, so
    that all buckets of a group draw alike.
    """
    member = [F.col(c) for c in ("id", "n", "part")]
    orders = [F.min(F.struct((-F.col("meets")).alias("h"), *member))]
    orders += [F.min(F.struct(F.xxhash64("id", F.lit(k)).cast("double").alias("h"), *member)) for k in range(1, pivots)]
    chosen = (
        rows.groupBy("bucket")
        .agg(F.array(*orders).alias("p"), F.min("part").alias("_l"), F.max("part").alias("_h"))
        .where("_l <> _h")
        .select("bucket", F.explode("p").alias("p"))
    )
    return (
        rows.join(chosen, "bucket")
        .where((F.col("part") != F.col("p.part")) & _alike_sizes(F.col("n"), F.col("p.n"), percent))
        .select(*_pair(F.col("id"), F.col("p.id")))
        .distinct()
    )


def _unsettled(rows: DataFrame) -> DataFrame:
    """``id, n, part, outside``: members of mixed buckets, and whether they stand outside a main component."""
    sizes = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("_c"))
    main = (
        sizes.groupBy("bucket")
        .agg(F.max(F.struct("_c", "part")).alias("_main"), F.count(F.lit(1)).alias("_parts"))
        .where("_parts > 1")
        .select("bucket", F.col("_main.part").alias("main"))
    )
    return rows.join(main, "bucket").groupBy("id").agg(
        F.max("n").alias("n"), F.max("part").alias("part"), F.max(F.col("part") != F.col("main")).alias("outside")
    )


def _frequencies(sets: DataFrame, ids: DataFrame) -> np.ndarray:
    """How many sampled sets hold a shingle of each bucket of hashes."""
    chosen = ids.select("id").orderBy(F.xxhash64("id"), "id").limit(ORDER_DOCS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                buckets = np.frombuffer(blob.as_buffer(), U) >> U(64 - ORDER_BITS)
                total += np.bincount(buckets.astype(np.int64), minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["b", "c"])

    parts = sets.join(F.broadcast(chosen), "id").select("elements").mapInArrow(count, "b bigint, c bigint")
    found = parts.groupBy("b").agg(F.sum("c").alias("c")).toArrow()  # at most 2 ** ORDER_BITS rows
    table = np.zeros(1 << ORDER_BITS, np.int64)
    table[found["b"].to_numpy()] = found["c"].to_numpy()
    return table


def _remaining_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs across components that may still be links, made from members outside their main component."""
    members = written(_unsettled(rows), "unsettled")
    order = _frequencies(sets, members)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, lengths = [], []
            for blob in batch.column(4):
                elements = np.frombuffer(blob.as_buffer(), U)
                n = len(elements)
                ranked = np.lexsort((elements, order[(elements >> U(64 - ORDER_BITS)).astype(np.int64)]))
                lists.append(elements[ranked[: n - -(-percent * n // 100) + 1]].view(np.int64))
                lengths.append(len(lists[-1]))
            if not lists:
                continue
            row = pa.array(np.repeat(np.arange(len(lists)), lengths))
            columns = [batch.column(k).take(row) for k in range(4)]
            rest = pa.array(np.concatenate([n - np.arange(k) for n, k in zip(batch.column(1).to_pylist(), lengths)]))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.concatenate(lists)), rest],
                names=["id", "n", "part", "outside", "shingle", "rest"],
            )

    # ``rest``: shingles from this one to the last.
    shape = "id bigint, n bigint, part bigint, outside boolean, shingle bigint, rest bigint"
    joined = members.join(sets, "id").select("id", "n", "part", "outside", "elements")
    prefixes = written(joined.mapInArrow(first, shape), "prefixes")
    outside = prefixes.where("outside").select(
        "shingle", F.col("id").alias("o"), F.col("n").alias("o_n"), F.col("part").alias("o_part"),
        F.col("rest").alias("o_rest"),
    )
    enough = F.least("rest", "o_rest") * (100 + percent) >= (F.col("n") + F.col("o_n")) * percent
    return (
        prefixes.join(outside, "shingle")
        .where(
            (F.col("part") != F.col("o_part"))
            & (~F.col("outside") | (F.col("id") < F.col("o")))
            & enough
        )
        .select(*_pair(F.col("id"), F.col("o")))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 64, rows: int = 7, pivots: tuple[int, ...] = (1, 6)
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: the smallest id reachable over links, and whether it is one's own."""
    base = written(_fingerprints(docs, words, bands, rows), "sketches")
    usable = base.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = written(usable.groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("documents")
    ), "classes")
    first_rows = usable.join(classes.select("set_key", F.col("id").alias("doc_id")), ["set_key", "doc_id"])
    spread = first_rows.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    crowded = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    buckets = written(spread.join(crowded, "bucket"), "buckets")
    meets = buckets.groupBy("id").agg(F.sum(F.col("_c").cast("double")).alias("meets"))
    shared = written(buckets.drop("_c").join(meets, "id"), "buckets")
    sets = _full_sets(docs, shared.select("id").distinct(), words)
    # Nodes of the graph are classes of equal sets, by their smallest document; a document with several sets links them.
    several = written(_several(base, classes), "several")
    links = several.where("a <> b").select("a", "b").distinct()
    labels = components(links)
    tried = None
    for count in (*pivots, 0):
        held = _labelled(shared, labels)
        found = _pivot_pairs(held, count, percent) if count else _remaining_pairs(held, sets, percent)
        pairs = written(found if tried is None else found.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = labels.union(_confirmed(pairs, sets, percent))
        labels = components(links)
        tried = pairs if tried is None else tried.union(pairs)
    return _per_document(base, classes, several, labels)


def _several(base: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id, a, b``: for documents with more than one set, each class and the least class of the document."""
    marked = base.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("set_key", F.lit(b"")).alias("set_key"))
    more = marked.groupBy("doc_id").agg(F.min("set_key").alias("_l"), F.max("set_key").alias("_h")).where("_l <> _h").select("doc_id")
    own = marked.distinct().join(more, "doc_id", "left_semi").join(classes.select("set_key", "id"), "set_key").select("doc_id", "id")
    least = own.groupBy("doc_id").agg(F.min("id").alias("b"))
    return own.join(least, "doc_id").select("doc_id", F.col("id").alias("a"), "b")


def _per_document(base: DataFrame, classes: DataFrame, several: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with the component of its class.

    Classes of many documents are broadcast; there is at most one per ``CROWD`` documents.  The others meet their
    documents on the set, where no key has more rows than that.
    """
    rooted = classes.join(labels.select(F.col("a").alias("id"), F.col("b").alias("_root")), "id", "left").select(
        "set_key", F.coalesce("_root", "id").alias("root"), "documents"
    )
    crowd = rooted.where(F.col("documents") >= CROWD).select(F.col("set_key").alias("_crowd"), F.col("root").alias("_crowd_root"))
    rest = rooted.where(F.col("documents") < CROWD).select(F.col("set_key").alias("_key"), F.col("root").alias("_rest_root"))
    alone = F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string")).cast("binary")  # no set has such a key
    found = base.join(F.broadcast(crowd), F.col("set_key") == F.col("_crowd"), "left").withColumn(
        "_own", F.when(F.col("_crowd").isNull() & F.col("set_key").isNotNull(), F.col("set_key")).otherwise(alone)
    ).join(rest, F.col("_own") == F.col("_key"), "left")
    # Documents with several sets have one component, whichever row of theirs it is.
    shared_root = several.join(labels.select(F.col("a").alias("_a"), F.col("b").alias("_root")), F.col("b") == F.col("_a"), "left").groupBy("doc_id").agg(
        F.min(F.coalesce("_root", "b")).alias("_several_root")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_several_root", "_crowd_root", "_rest_root", "doc_id"))
    return found.join(shared_root, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
