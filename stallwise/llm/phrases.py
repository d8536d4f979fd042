"""Phrase mining with an FM-index per shard.

Texts are cut into shards of at most ``SHARD_WORDS`` word positions per language. A shard is kept as the
Burrows-Wheeler transforms, over word ids, of its words and of their reversal, with a separator between pieces;
suffixes are ordered by their first ``DEPTH`` words, which is all that patterns of that length need. The two
transforms form a bidirectional index: extending a phrase by a word on one side narrows its interval on that
side by two rank queries and shifts the interval on the other side by the number of smaller neighbours.

Phrases are enumerated length by length, all intervals of a shard at once, and their counts are summed across
shards: words first; then left extensions of frequent words, right extensions of frequent pairs and left
extensions of frequent triples. A phrase seen ``least`` times has only parts seen as often, so extension leaves out
what the summed counts of the length before rule out. Workers test that on bitmaps of hashes, one per length, sized
by the counted phrases up to ``FILTER_BITS`` (32 MB); a bit set by another phrase costs work and changes no count.

Most pairs and triples are rare, so these are first summed by a 32-bit hash alone, a few bytes each instead of a row
with its text. Sums below ``least`` rule out every phrase of that hash; the last pass spells what is left and counts
it exactly, all lengths at once.

Scale: nothing but the bitmaps is broadcast, rows are shuffled as counts per task and phrase or hash, and the best
phrases of a language are chosen before they meet. Shards are written once and read by every level. A piece
longer than a shard is cut with ``DEPTH - 1`` words of overlap; what lies wholly in an overlap is counted in a
shard of its own with the sign -1.

Edge cases: null texts have no words; a null language is ``und``; rows repeated count again; blank texts and
empty tables give no phrases; ties follow the score, the count and the bytes of the phrase; other columns are
ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialise, new_path
from .base import _BITS_PER_ROW, small_batches, text_of

DEPTH = 4
LEAST = 30
TOP = 2_000
SHARD_WORDS = 1 << 19
# shards are rows of some 5 MB; a scan holds the rows of one file
SHARDS_PER_FILE = 4
SHARDS_PER_TASK = 16
FILTER_BITS = 1 << 28
# counts by hash meet in groups of some million hashes; a task merges its shards' counts from so many on
SHARDS_PER_GROUP = 4
MERGED = 1 << 21
_SLICE = 1 << 22
_ROWS = 1 << 16
_SEED = 42  # of Spark's xxhash64
_SIGN_SHARD = "shard string, lang string, sign int, positions long, words binary, forward binary, backward binary"

# A-Z in lower case, tabs as blanks, every separator as one of them
_CLEAN = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAK = re.compile(rb"[ .]")


class _Ids(dict):
    """Numbers of the words of a shard; the separator is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """Words and separators of a text, some megabytes at a time."""
    text = text.translate(_CLEAN)
    at = 0
    while at < len(text):
        stop = _BREAK.search(text, at + _SLICE)
        end = stop.start() if stop else len(text)
        yield text[at:end].replace(b".", b" . ").split()
        at = end


def transform(text: np.ndarray) -> np.ndarray:
    """The word before each suffix, suffixes in the order of their first four words; ``text`` ends with a separator."""
    number = int(text.max(initial=0)) + 1
    pairs = text.astype(np.int64) * number + np.append(text[1:], 0)
    rank = np.unique(pairs, return_inverse=True)[1]
    order = np.argsort(rank * (len(text) + 1) + np.append(rank[2:], [0, 0])[: len(text)], kind="stable")
    return text[order - 1]


class Index:
    """Rank queries on a transform: its symbols with their places, in one sorted array."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        self.size = len(symbols)
        order = np.argsort(symbols, kind="stable")
        self.places = symbols[order].astype(np.int64) * self.size + order
        self.counts = np.bincount(symbols)

    def preceded(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """For intervals: (interval, symbol before, its count, count of smaller ones), separators left out."""
        length = high - low
        which = np.repeat(np.arange(len(low)), length)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(low, length)
        number = len(self.counts)
        code, count = np.unique(which * number + self.symbols[rows], return_counts=True)
        which, symbol = np.divmod(code, number)
        before = np.cumsum(count) - count
        first = np.searchsorted(which, which)
        real = symbol > 0
        return which[real], symbol[real], count[real], (before - before[first])[real]

    def narrowed(self, symbol: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Start of the interval of the symbol followed by what starts at ``low``."""
        return np.searchsorted(self.places, symbol * self.size + low)


@dataclass
class Phrases:
    """Phrases of one length as rows of word ids, with their intervals in both indexes."""

    ids: np.ndarray
    low: np.ndarray
    back: np.ndarray
    count: np.ndarray

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.ids[keep], self.low[keep], self.back[keep], self.count[keep])


def words_of_index(index: Index) -> Phrases:
    ids = np.flatnonzero(index.counts)
    ids = ids[ids > 0]
    low = (np.cumsum(index.counts) - index.counts)[ids]
    return Phrases(ids[:, None], low, low, index.counts[ids])


def extended(found: Phrases, forward: Index, backward: Index, left: bool) -> Phrases:
    """All extensions by one word, to the left or to the right."""
    index = forward if left else backward
    near, far = (found.low, found.back) if left else (found.back, found.low)
    which, symbol, count, smaller = index.preceded(near, near + found.count)
    new_near, new_far = index.narrowed(symbol, near[which]), far[which] + smaller
    ids = found.ids[which]
    ids = np.column_stack([symbol, ids] if left else [ids, symbol])
    return Phrases(ids, *((new_near, new_far) if left else (new_far, new_near)), count)


class _Shards:
    """Collects coded texts per language and gives them out as index rows."""

    def __init__(self, size: int):
        self.size = size
        self.open: dict[tuple[str, int], tuple[_Ids, list[np.ndarray]]] = {}
        self.held: dict[tuple[str, int], int] = {}

    def _put(self, key: tuple[str, int], words: list[bytes]) -> Iterator[dict]:
        ids, parts = self.open.setdefault(key, (_Ids(), []))
        part = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
        parts.append(np.append(part, np.int32(0)))
        self.held[key] = self.held.get(key, 0) + len(words)
        if self.held[key] >= self.size:
            yield self._row(key)
        elif sum(self.held.values()) >= 2 * self.size:
            yield self._row(max(self.held, key=self.held.get))

    def add(self, lang: str, text: bytes) -> Iterator[dict]:
        rest: list[bytes] = []
        for words in _slices(text):
            rest += words
            while len(rest) > self.size:
                yield from self._put((lang, 1), rest[: self.size + DEPTH - 1])
                # those words come again at the start of the rest
                yield from self._put((lang, -1), rest[self.size : self.size + DEPTH - 1])
                rest = rest[self.size :]
        if rest:
            yield from self._put((lang, 1), rest)

    def _row(self, key: tuple[str, int]) -> dict:
        ids, parts = self.open.pop(key)
        del self.held[key]
        text = np.concatenate(parts)
        return {
            "shard": uuid.uuid4().hex,
            "lang": key[0],
            "sign": key[1],
            "positions": int(np.count_nonzero(text)),
            "words": b" ".join(ids),
            "forward": transform(text).tobytes(),
            "backward": transform(np.append(text[-2::-1], np.int32(0))).tobytes(),
        }

    def rest(self) -> Iterator[dict]:
        for key in list(self.open):
            yield self._row(key)


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SHARD_WORDS) -> DataFrame:
    """The written table of shards."""
    spark = docs.sparkSession
    small_batches(spark)
    kinds = {"shard": pa.string(), "lang": pa.string(), "sign": pa.int32(), "positions": pa.int64()}
    schema = pa.schema(list(kinds.items()) + [(c, pa.binary()) for c in ("words", "forward", "backward")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        building = _Shards(size)

        def rows() -> Iterator[dict]:
            for batch in batches:
                for lang, text in zip(batch["_lang"].to_pylist(), batch["_text"].to_pylist(), strict=True):
                    yield from building.add(lang, text)
            yield from building.rest()

        for row in rows():
            yield pa.RecordBatch.from_pylist([row], schema)

    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), text_of(text_col).cast("binary").alias("_text")
    )
    path = new_path(spark, "phrase_shards")
    texts.mapInArrow(build, _SIGN_SHARD).write.option("maxRecordsPerFile", SHARDS_PER_FILE).parquet(path)
    return spark.read.schema(_SIGN_SHARD).parquet(path)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """Spark's xxhash64 over (language, word)."""
    seed = xxhash.xxh64_intdigest(lang.encode(), _SEED)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _hashes(word_hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """32-bit hashes of phrases, from those of their words; a word keeps the low bits of its own."""
    code = word_hashes[ids[:, 0]]
    for column in ids.T[1:]:
        code = (code ^ code >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + word_hashes[column]
        code ^= code >> np.uint64(29)
    return code.astype(np.uint32)


@dataclass(frozen=True)
class Filter:
    """Bits of the hashes of phrases; a phrase whose bit is unset is not among them."""

    bits: Broadcast
    size: int

    def keeps(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & np.uint32(self.size - 1)
        table = np.frombuffer(self.bits.value, np.uint8)
        return (table[slot >> np.uint32(3)] >> (slot & np.uint32(7)).astype(np.uint8) & 1).astype(bool)


def filter_of(frequent: DataFrame) -> Filter:
    """Of the written table (hash): 16 bits a hash, up to ``FILTER_BITS`` in all."""
    size = 1 << 20
    while size < min(16 * frequent.count(), FILTER_BITS):
        size *= 2
    slot = F.pmod("hash", F.lit(size)).alias("_slot")
    slots = frequent.select(slot).select(
        F.expr(f"cast(_slot div {_BITS_PER_ROW} as int)").alias("bucket"), F.expr(f"cast(_slot % {_BITS_PER_ROW} as int)").alias("place")
    )
    rows = slots.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")).toArrow()
    table = np.zeros((size // _BITS_PER_ROW, _BITS_PER_ROW // 8), np.uint8)
    for bucket, bits in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        table[bucket] = np.frombuffer(bits, np.uint8)
    return Filter(frequent.sparkSession.sparkContext.broadcast(table.tobytes()), size)


def _spelled(words: list[bytes], ids: np.ndarray) -> list[bytes]:
    columns = [[words[i] for i in column] for column in ids.T.tolist()]
    return columns[0] if len(columns) == 1 else list(map(b" ".join, zip(*columns, strict=True)))


def _among(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted numbers are in the sorted ones."""
    if not len(known):
        return np.zeros(len(wanted), bool)
    return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted


def _enumerated(row: dict, word_hashes: np.ndarray, length: int, filters: list[Filter]) -> Iterator[Phrases]:
    """Phrases of two words up to the length; of each shorter length only those that ``filters`` keep."""
    forward = Index(np.frombuffer(row["forward"], np.int32))
    backward = Index(np.frombuffer(row["backward"], np.int32))
    number = len(word_hashes)
    # per length, the frequent phrases of the shard: each as the rank of its start and its last word
    known: list[np.ndarray] = [np.flatnonzero(filters[0].keeps(word_hashes.astype(np.uint32)))]

    def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the phrases and whether all their starts are known."""
        code, sure = ids[:, 0], _among(known[0], ids[:, 0])
        for level, more in enumerate(ids.T[1:]):
            code = np.searchsorted(known[level], code) * number + more
            if level + 1 < ids.shape[1] - 1:
                sure &= _among(known[level + 1], code)
        return code, sure

    found = words_of_index(forward)
    found = found.where(_among(known[0], found.ids[:, 0]))
    for size in range(2, length + 1):
        left = size % 2 == 0
        found = extended(found, forward, backward, left)
        # what the new word makes with all others but the last one behind it must be frequent too
        code, sure = ranked(found.ids[:, : size - 1] if left else found.ids[:, 1:])
        found = found.where(sure & _among(known[-1], code))
        if size < len(filters) + 1:
            found = found.where(filters[size - 1].keeps(_hashes(word_hashes, found.ids)))
            known.append(np.sort(ranked(found.ids)[0]))
        yield found


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _planes(numbers: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: those of small numbers are zeros, which compress."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4")[:, 0]


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit hashes and the sums of their 32-bit counts."""
    both = hashes.astype(np.uint64) << np.uint64(32) | counts.astype(np.uint32)
    both.sort()
    hashes, counts = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32).view(np.int32)
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[first], np.add.reduceat(counts, first, dtype=np.int64)


def frequent_hashes(shard_rows: DataFrame, groups: int, length: int, filters: list[Filter], least: int) -> DataFrame:
    """The hashes whose phrases of the length occur ``least`` times together; ``groups`` is a power of two.

    Counts go as sorted hashes per group, each as its distance from the one before.
    """
    shift = 32 - (groups.bit_length() - 1)
    schema = pa.schema([("group", pa.int32()), ("steps", pa.binary()), ("counts", pa.binary())])

    def sent(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ends = np.searchsorted(hashes, np.arange(1, groups + 1, dtype=np.uint64) << np.uint64(shift))
        rows, start = [], 0
        for group, end in enumerate(ends.tolist()):
            if end > start:
                inside = hashes[start:end].astype(np.int64) - (group << shift)
                # counts of a task stay far below 2**31, those of a shard below its size
                rows.append((group, _planes(np.diff(inside, prepend=0)), _planes(counts[start:end])))
            start = end
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def enumerate_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = 0, []
        for row in _rows_of(batches):
            word_hashes = _word_hashes(row["lang"], row["words"].split(b" "))
            *_, found = _enumerated(row, word_hashes, length, filters)
            if len(found.count):
                parts.append((_hashes(word_hashes, found.ids), (found.count * row["sign"]).astype(np.int32)))
                held += len(found.count)
            if held >= MERGED:
                yield sent(*_summed(*map(np.concatenate, zip(*parts, strict=True))))
                held, parts = 0, []
        if parts:
            yield sent(*_summed(*map(np.concatenate, zip(*parts, strict=True))))

    def add_up(table: pa.Table) -> pa.Table:
        base = table["group"][0].as_py() << shift
        hashes = [base + np.cumsum(_of_planes(steps), dtype=np.int64) for steps in table["steps"].to_pylist()]
        counts = [_of_planes(c) for c in table["counts"].to_pylist()]
        hashes, counts = _summed(np.concatenate(hashes), np.concatenate(counts))
        return pa.table({"hash": hashes[counts >= least].astype(np.int64)})

    rows = shard_rows.select("lang", "sign", "words", "forward", "backward")
    sent_counts = rows.mapInArrow(enumerate_all, "group int, steps binary, counts binary")
    return sent_counts.groupBy("group").applyInArrow(add_up, "hash long")


_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("count", pa.int64())])


def _counted(shard_rows: DataFrame, counts_of: Callable[[dict], Iterator[tuple[list[bytes], np.ndarray]]]) -> DataFrame:
    """Counts (lang, phrase, count) that the function gives for a shard, summed across shards.

    A task takes several shards, whose counts meet before they are shuffled.
    """

    def enumerate_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            for phrases, counts in counts_of(row):
                for at in range(0, len(phrases), _ROWS):
                    part = phrases[at : at + _ROWS]
                    signed = pa.array(counts[at : at + _ROWS] * row["sign"], pa.int64())
                    columns = [pa.array([row["lang"]] * len(part)), pa.array(part, pa.binary()), signed]
                    yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)

    found = shard_rows.mapInArrow(enumerate_all, "lang string, phrase binary, count long")
    summed = found.groupBy("lang", "phrase").agg(F.sum("count").alias("count"))
    return summed.select("lang", F.col("phrase").cast("string").alias("phrase"), "count")


def counted_words(shard_rows: DataFrame) -> DataFrame:
    def counts_of(row: dict) -> Iterator[tuple[list[bytes], np.ndarray]]:
        counts = np.bincount(np.frombuffer(row["forward"], np.int32))
        yield row["words"].split(b" ")[1:], counts[1:]

    return _counted(shard_rows.select("lang", "sign", "words", "forward"), counts_of)


def counted_phrases(shard_rows: DataFrame, filters: list[Filter]) -> DataFrame:
    """Counts of the phrases of two to four words whose parts, and up to three words also themselves, the filters keep."""

    def counts_of(row: dict) -> Iterator[tuple[list[bytes], np.ndarray]]:
        words = row["words"].split(b" ")
        for found in _enumerated(row, _word_hashes(row["lang"], words), DEPTH, filters):
            for at in range(0, len(found.count), _ROWS):
                yield _spelled(words, found.ids[at : at + _ROWS]), found.count[at : at + _ROWS]

    return _counted(shard_rows.select("lang", "sign", "words", "forward", "backward"), counts_of)


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, size: int = SHARD_WORDS
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, count) of all phrases of up to four words seen ``least`` times, and words per language (lang, n)."""
    indexed = shards(docs, text_col, lang_col, size)
    number = indexed.count()
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-number // SHARDS_PER_TASK))
    groups = 16
    while groups < min(number / SHARDS_PER_GROUP, 1 << 16):
        groups *= 2
    together = indexed.coalesce(tasks)
    words = materialise(counted_words(together).filter(F.col("count") >= least), "phrase_counts")
    filters = [filter_of(words.select(F.xxhash64("lang", "phrase").alias("hash")))]
    for length in range(2, DEPTH):
        filters.append(filter_of(materialise(frequent_hashes(together, groups, length, filters, least), "phrase_hashes")))
    longer = materialise(counted_phrases(together, filters).filter(F.col("count") >= least), "phrase_counts")
    number_of_words = (F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1).alias("words")
    found = words.unionByName(longer).select("lang", "phrase", number_of_words, "count")
    totals = indexed.groupBy("lang").agg(F.sum(F.col("sign") * F.col("positions")).alias("n"))
    return found, totals


def _wide(number: Column) -> Column:
    return number.cast("decimal(20,0)")


def collocations(phrases: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The best phrases per language: lang, rank, phrase, a, l, r, n, score.

    The score is that of the weakest cut in two parts. A phrase that mostly occurs inside a longer one is left out.
    """
    candidates = phrases.filter("words > 1").select("lang", "phrase", "words", F.split("phrase", " ").alias("_w"), F.col("count").alias("a"))

    def part(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("_w", start, length), " ")

    cut = F.col("cut")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), cut).alias("_head"), part(cut + 1, F.col("words") - cut).alias("_tail"))
    for side, name in (("_head", "l"), ("_tail", "r")):
        known = phrases.select("lang", F.col("phrase").alias(side), F.col("count").alias(name))
        cuts = cuts.join(known, ["lang", side])
    score = F.expr("(cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("_weakest")
    scored = cuts.groupBy("lang", "phrase", "a").agg(weakest)

    # the largest count of a longer phrase around each phrase
    length, start = F.col("_length"), F.col("_start")
    inner = candidates.filter("words > 2").select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("_length"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - length + 1)).alias("_start"))
    around = inner.select("lang", part(start, length).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    kept = scored.join(around, ["lang", "phrase"], "left")
    kept = kept.filter(F.col("_around").isNull() | (100 * _wide(F.col("_around")) < 80 * _wide(F.col("a"))))

    best = Window.partitionBy("lang").orderBy(F.col("_weakest.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.select("*", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        "a",
        F.col("_weakest.l").alias("l"),
        F.col("_weakest.r").alias("r"),
        "n",
        F.col("_weakest.score").alias("score"),
    )
