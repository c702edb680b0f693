"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and read as the bytes of each word and a blank,
then one end byte.  A byte is eight binary choices; the choices made so far within it name a node.  For each node
there is a tree over the bytes before, up to ``depth`` of them.  Every place of it counts the zeros and ones of the
training texts, estimates them as Krichevsky and Trofimov do (``(ones + 1/2) / (all + 1)``), and is weighted half
and half with the product of the places one byte deeper, so the estimate is the mixture over all prunings of the
tree.  The model is what training leaves; scored texts do not change it.  A byte's probability depends on the
``depth`` bytes before it and itself, its gram, so grams are what is counted, weighted and looked up.

Words and grams are counted over all texts, with what a task counts combined before it moves.  Grams that share the
last ``SHARED`` bytes before their own make subtrees that need nothing from elsewhere: each task weights whole
subtrees in arrays, the places above are few and are added up level by level, and mixtures are passed down the same
way.  Texts never move: tasks score them with the most frequent words and grams, of which a bounded number is
broadcast, and write what is left, word by word and gram by gram, to be joined with the whole tables and summed.

Null and empty texts are the end byte alone.  Rows with a null id train the model and are not held out; repeated
rows count and are scored as often as they occur.  Training texts may be absent: then all choices are even.  Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.shared import scratch, written

DEPTH = 5
SHARED = 3
PART_GRAMS = 100_000  # grams whose subtrees a task weights at once, on average
COMMON_WORDS = 1 << 18
COMMON_GRAMS = 1 << 20
PIECE_BYTES = 1 << 18  # bytes whose grams are made at once
KEPT = 1 << 18  # distinct words, and twice as many grams, that a task holds before it hands them on
END = b"\n"
ROWS = 1 << 16  # rows of an Arrow batch


def held_out(doc_id: Column) -> Column:
    """Rows whose texts the model does not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def rolled(letters: np.ndarray, depth: int) -> np.ndarray:
    """The gram that ends at each byte from the ``depth``-th on."""
    count = max(0, len(letters) - depth)
    grams, width = np.zeros(count, np.int64), 0
    power, size = letters.astype(np.int64), 1  # the numbers of ``size`` bytes that begin at each place
    while count:
        if (depth + 1) & size:
            grams <<= 8 * size
            grams |= power[width : width + count]
            width += size
        if 2 * size > depth + 1:
            break
        power = power[:-size] << 8 * size | power[size:]
        size *= 2
    return grams


def body_of(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" \n" if words else END


def grams_of(bodies: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of texts and the text each belongs to, a piece at a time; a long text is cut."""
    opening = END * depth  # what is read before a text
    held, owner, size = [], [], 0

    def made() -> tuple[np.ndarray, np.ndarray]:
        letters = np.frombuffer(b"".join(held), np.uint8)
        length = np.array([len(x) for x in held])
        own = np.ones(len(letters), bool)
        own[((np.cumsum(length) - length)[:, None] + np.arange(depth)).ravel()] = False
        return rolled(letters, depth)[own[depth:]], np.repeat(np.array(owner), length - depth)

    for k, body in enumerate(bodies):
        for start in range(0, len(body), PIECE_BYTES):
            before = (opening + body[max(0, start - depth) : start])[-depth:]
            held.append(before + body[start : start + PIECE_BYTES])
            owner.append(k)
            size += len(held[-1])
            if size >= PIECE_BYTES:
                yield made()
                held, owner, size = [], [], 0
    if held:
        yield made()


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


COUNTED = "word binary, gram bigint, times bigint"


def _counts(words: list[bytes] | None, grams: np.ndarray | None, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(times), ROWS):
        part = slice(k, k + ROWS)
        count = len(times[part])
        yield pa.RecordBatch.from_arrays(
            [pa.array(words[part], pa.binary()) if words is not None else pa.nulls(count, pa.binary()),
             pa.array(grams[part]) if grams is not None else pa.nulls(count, pa.int64()), pa.array(times[part])],
            names=["word", "gram", "times"],
        )


def _counter(depth: int):
    """Words of training texts and grams of all texts with their counts in training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, held = Counter(), [], 0
        for batch in batches:
            bodies: dict[bool, list[bytes]] = {True: [], False: []}
            for text, out in zip(batch.column(1), batch.column(2).to_pylist()):
                found = (text.as_py() or b"").lower().split()  # bytes fold A-Z alone and split at exactly the six characters
                bodies[not out].append(body_of(found))
                if not out:
                    words.update(found)
                    words[END] += 1
                    if len(words) > KEPT:
                        yield from _counts(list(words), None, np.fromiter(words.values(), np.int64))
                        words = Counter()
            for trains, own in bodies.items():
                for piece, _ in grams_of(own, depth):
                    distinct, times = np.unique(piece, return_counts=True)
                    grams.append((distinct, times if trains else np.zeros_like(times)))
                    held += len(distinct)
                    if held > 4 * KEPT:
                        grams = [summed(*(np.concatenate(x) for x in zip(*grams)))]
                        held = len(grams[0][0])
                        if held > 2 * KEPT:
                            yield from _counts(None, *grams[0])
                            grams, held = [], 0
        yield from _counts(list(words), None, np.fromiter(words.values(), np.int64, len(words)))
        if grams:
            yield from _counts(None, *summed(*(np.concatenate(x) for x in zip(*grams))))

    return count


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: Stirling's series at eight more, to about 12 digits."""
    below = np.ones_like(x)
    for k in range(8):
        below *= x + k
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    # Products of large numbers leave the range of doubles only where the series needs no shift.
    large = x > 1e15
    shifted = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(np.where(large, 1.0, below))
    return np.where(large, (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi), shifted)


def weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weights of places, and the share of the mixture that each place's own estimate has.

    ``below``: the sums of log weights one byte deeper; None at full depth.
    """
    half = log_gamma(np.array([0.5]))[0]
    zeros, ones = zeros.astype(float), ones.astype(float)
    own = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - 2 * half - log_gamma(zeros + ones + 1)
    if below is None:
        return own, np.ones_like(own)
    weight = np.logaddexp(own, below) - np.log(2)
    return weight, np.exp(own - np.log(2) - weight)


def up(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, depth: int, top: int) -> list[tuple[np.ndarray, ...]]:
    """Places of ``depth`` and of every level above it down to ``top``: ``key, zeros, ones, weight, share``.

    A key is the bytes before, then the node in its last byte; without its first byte it is the key of the parent.
    """
    keys, zeros, ones = summed(keys, zeros, ones)
    levels = [(keys, zeros, ones, *weighted(zeros, ones, None))]
    for d in range(depth - 1, top - 1, -1):
        keys, zeros, ones, weight, _ = levels[-1]
        keys, zeros, ones, below = summed(keys & ((1 << 8 * (d + 1)) - 1), zeros, ones, weight)
        levels.append((keys, zeros, ones, *weighted(zeros, ones, below)))
    return levels


def choices(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and bits of the eight choices that lead to the last byte of each gram, one row per choice."""
    last, steps = grams & 255, np.arange(8)[:, None]
    return (grams >> 8 << 8) | (1 << steps) | (last >> (8 - steps)), (last >> (7 - steps)) & 1


def _part(gram: str, parts: int, shared: int) -> Column:
    before = F.shiftright(F.col(gram), 8).bitwiseAND((1 << 8 * shared) - 1)
    return F.pmod(F.xxhash64(before), F.lit(parts)).cast("int").alias("part")


PLACES = "key bigint, zeros bigint, ones bigint, weight double, share double"


def _subtrees(depth: int, shared: int):
    def weigh(grams: pa.Table) -> pa.Table:
        keys, bits = choices(grams["gram"].to_numpy())
        times = np.broadcast_to(grams["times"].to_numpy(), keys.shape).ravel()
        top = up(keys.ravel(), times * (1 - bits.ravel()), times * bits.ravel(), depth, shared)[-1]
        return pa.table(dict(zip(["key", "zeros", "ones", "weight", "share"], top)))

    return weigh


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        zeros, ones, below = (batch.column(k).to_numpy() for k in (1, 2, 3))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *map(pa.array, weighted(zeros, ones, below))], names=["key", "zeros", "ones", "weight", "share"]
        )


def _descend(depth: int, shared: int):
    """Chances of grams from the mixtures above their subtrees: ``key, above, left`` at the shared bytes."""

    def chance(grams: pa.Table, path: pa.Table) -> pa.Table:
        found = grams["gram"].to_numpy()
        keys, bits = choices(found)
        times = np.broadcast_to(grams["times"].to_numpy(), keys.shape).ravel()
        flat = bits.ravel()
        levels = up(keys.ravel(), times * (1 - flat), times * flat, depth, shared)
        above = path["key"].to_numpy()
        order = np.argsort(above)
        above, one, left = (path[c].to_numpy()[order] for c in ("key", "above", "left"))
        for d in range(shared, depth + 1):
            key, zeros, ones, _, share = levels.pop()
            at = np.searchsorted(above, key & ((1 << 8 * (max(shared, d - 1) + 1)) - 1))
            one, left = one[at] + left[at] * share * (ones + 0.5) / (zeros + ones + 1.0), left[at] * (1 - share)
            above = key
        even = one[np.searchsorted(above, keys.ravel())]
        even = np.log10(np.maximum(np.where(flat == 1, even, 1 - even), 1e-300)).reshape(keys.shape).sum(axis=0)
        return pa.table({"gram": found, "times": grams["times"], "chance": even})

    return chance


def chances(grams: DataFrame, depth: int) -> DataFrame:
    """``gram, times, chance``: log10 of the probability of each gram's last byte after the others.

    ``grams``: distinct ``gram`` with ``times`` in training texts; grams seen in no training text have 0 and get
    what the mixture leaves them.
    """
    shared = min(SHARED, depth)
    parts = -(-max(1, grams.count()) // PART_GRAMS)
    dealt = grams.withColumn("part", _part("gram", parts, shared))
    levels = [written(dealt.groupBy("part").applyInArrow(_subtrees(depth, shared), PLACES), "places")]
    for d in range(shared - 1, -1, -1):
        parents = levels[-1].groupBy(F.col("key").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("key")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weight").alias("below")
        )
        levels.append(written(parents.mapInArrow(_weigh, PLACES), "places"))
    estimate = F.expr("share * (ones + 0.5D) / (zeros + ones + 1D)")
    path = levels.pop().select(
        "key", F.lit(0.0).alias("above"), F.lit(1.0).alias("left"), estimate.alias("own"), "share"
    )
    for d in range(1, shared + 1):
        upper = path.select(
            F.col("key").alias("parent"), (F.col("above") + F.col("left") * F.col("own")).alias("above"),
            (F.col("left") * (1 - F.col("share"))).alias("left"),
        )
        path = (
            levels.pop().withColumn("parent", F.col("key").bitwiseAND((1 << 8 * d) - 1)).join(upper, "parent")
            .select("key", "above", "left", estimate.alias("own"), "share")
        )
    below = path.select("key", "above", "left", _part("key", parts, shared))
    return dealt.groupBy("part").cogroup(below.groupBy("part")).applyInArrow(
        _descend(depth, shared), "gram bigint, times bigint, chance double"
    )


def commonest(table: DataFrame, bound: int) -> DataFrame:
    """Rows of the largest ``times``, ``bound`` at most, by a threshold on a logarithmic scale."""
    scale = F.floor(F.log2("times") * 16).cast("int").alias("scale")
    steps = table.where("times > 0").groupBy(scale).count().orderBy(F.desc("scale")).collect()  # at most 1024 rows
    least, held = 1 << 20, 0
    for step in steps:
        held += step["count"]
        if held > bound:
            break
        least = step["scale"]
    return table.where((F.col("times") > 0) & (F.floor(F.log2("times") * 16) >= least))


SCORED = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, "
    "n_bytes bigint, word binary, gram bigint, times bigint, kind string"
)
_SHAPE = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("word", pa.binary()), ("gram", pa.int64()),
    ("times", pa.int64()), ("kind", pa.string()),
])


def _rows(kind: str, count: int, **columns) -> pa.RecordBatch:
    columns["kind"] = [kind] * count
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in _SHAPE], schema=_SHAPE
    )


class GramTable:
    """Chances by gram: an open hash table whose rows are a gram and its chance, side by side."""

    def __init__(self, grams: np.ndarray, chance: np.ndarray):
        """Earlier grams are found in fewer steps."""
        bits = max(4, (2 * len(grams) - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.rows = np.full((1 << bits, 2), -1, np.int64)
        self.values = self.rows.view(np.float64)
        home, todo, step = self._home(grams), np.arange(len(grams)), 0
        while len(todo):
            slot = (home[todo] + step) & self.last
            free = np.flatnonzero(self.rows[slot, 0] < 0)
            slot, first = np.unique(slot[free], return_index=True)
            placed = todo[free[first]]
            self.rows[slot, 0], self.values[slot, 1] = grams[placed], chance[placed]
            left = np.ones(len(todo), bool)
            left[free[first]] = False
            todo, step = todo[left], step + 1

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances, zero where absent, and which are held."""
        slot = self._home(grams)
        held = self.rows[slot, 0]
        chance = np.where(held == grams, self.values[slot, 1], 0.0)
        found = held == grams
        todo = np.flatnonzero(~found & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.last
            held = self.rows[slot[todo], 0]
            hit = todo[held == grams[todo]]
            chance[hit], found[hit] = self.values[slot[hit], 1], True
            todo = todo[(held >= 0) & (held != grams[todo])]
        return chance, found


class Scorer:
    """Scores texts by common words and grams, and names what it does not hold."""

    def __init__(self, words: list[bytes], terms: np.ndarray, grams: np.ndarray, chance: np.ndarray, depth: int):
        """``terms``: what a word adds to the base score; ``grams``: the commonest first."""
        self.place = dict(zip(words, range(len(words))))
        self.terms, self.depth = np.append(terms, 0.0), depth  # the last stands for words that are not held
        self.table = GramTable(grams, chance)

    def texts(self, texts: list[bytes]) -> tuple[dict[str, np.ndarray], Counter, list[tuple[np.ndarray, ...]]]:
        """Columns of the texts, ``(text, word)`` that are left with their counts, and such ``text, gram, times``."""
        count = len(texts)
        found = {"n_tokens": np.zeros(count, np.int64), "n_known": np.zeros(count, np.int64), "base_score": np.zeros(count),
                 "score": np.zeros(count), "n_bytes": np.zeros(count, np.int64)}
        bodies, words_left, grams_left = [], Counter(), []
        for k, text in enumerate(texts):
            words = text.lower().split()
            bodies.append(body_of(words))
            words.append(END)
            places = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
            found["n_tokens"][k], found["n_bytes"][k] = len(words), len(bodies[-1])
            found["n_known"][k] = (places >= 0).sum()
            found["base_score"][k] = self.terms[places].sum()
            words_left.update((k, words[j]) for j in np.flatnonzero(places < 0).tolist())
        for grams, owner in grams_of(bodies, self.depth):
            chance, held = self.table.get(grams)
            found["score"] += np.bincount(owner, chance, count)
            if not held.all():
                left = np.stack([owner[~held], grams[~held]])
                distinct, times = np.unique(left, axis=1, return_counts=True)
                grams_left.append((distinct[0], distinct[1], times))
        return found, words_left, grams_left


def _scorer(words, grams, n: int, distinct: int, depth: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = words.value, grams.value
        scorer = Scorer(
            table["word"].to_pylist(), base_terms(table["times"].to_numpy(), n, distinct),
            model["gram"].to_numpy(), model["chance"].to_numpy(), depth,
        )
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = [text.as_py() or b"" for text in part.column(1)]
                found, words_left, grams_left = scorer.texts(texts)
                yield _rows("d", len(texts), row=np.arange(row, row + len(texts)), doc_id=part.column(0), held_out=part.column(2), **found)
                if words_left:
                    pairs = list(words_left)
                    yield _rows("w", len(pairs), row=[row + k for k, _ in pairs], word=[w for _, w in pairs], times=list(words_left.values()))
                for owner, own, times in grams_left:
                    yield _rows("g", len(own), row=row + owner, gram=own, times=times)
                row += len(texts)

    return score


def base_terms(times: np.ndarray, n: int, distinct: int) -> np.ndarray:
    return np.log10((times + 0.1) / (n + 0.1 * (distinct + 1)))


def score(
    docs: DataFrame, depth: int = DEPTH, common_words: int = COMMON_WORDS, common_grams: int = COMMON_GRAMS
) -> DataFrame:
    """One row per document: token counts, the word baseline ``base_score`` and the log10 probability ``score``.

    ``depth``: bytes before a byte that the tree may look at, 1 to 6.  ``common_words`` and ``common_grams`` bound
    what is broadcast; results do not depend on them.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6")
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"),
        held_out(F.col("doc_id")).alias("held_out"),
    )
    counts = written(
        texts.mapInArrow(_counter(depth), COUNTED).groupBy("word", "gram").agg(F.sum("times").alias("times")), "counts"
    )
    words = counts.where("gram IS NULL").select("word", "times")
    total = words.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, distinct = total["n"], total["v"]
    model = written(chances(counts.where("gram IS NOT NULL").select("gram", "times"), depth), "chances")
    context = spark.sparkContext
    held_words = context.broadcast(commonest(words, common_words).toArrow())
    held_grams = context.broadcast(commonest(model, common_grams).orderBy(F.desc("times"), "gram").select("gram", "chance").toArrow())
    path = scratch(spark, "scored")
    texts.mapInArrow(_scorer(held_words, held_grams, n, distinct, depth), SCORED).write.partitionBy("kind").parquet(path)

    def scored(kind: str) -> DataFrame:
        return spark.read.schema(SCORED).parquet(path).where(F.col("kind") == kind)

    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_bytes", "bigint"))]
    seen = F.coalesce("seen", F.lit(0))
    rare_words = scored("w").select("row", "word", "times").join(words.withColumnRenamed("times", "seen"), "word", "left").select(
        "row", *none, (F.when(seen > 0, F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("times") * F.log10((seen + 0.1) / (n + 0.1 * (distinct + 1)))).alias("base_score"), F.lit(0.0).alias("score"),
    )
    rare_grams = scored("g").select("row", "gram", "times").join(model.select("gram", "chance"), "gram").select(
        "row", *none, F.lit(0).cast("bigint").alias("n_known"), F.lit(0.0).alias("base_score"), (F.col("times") * F.col("chance")).alias("score")
    )
    whole = scored("d").select("row", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base_score", "score")
    sums = whole.unionByName(rare_words).unionByName(rare_grams).groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_bytes")],
        *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")],
    )
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
