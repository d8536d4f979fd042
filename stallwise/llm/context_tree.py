"""Language-model scores by context-tree weighting over bytes.

A text is its lower-case words and one end. A word is coded as its bytes and a blank, the end as a line feed; each
byte as eight binary choices down a binary tree of byte values. The context of a byte is the ``DEPTH`` bytes coded
before it in its text, across words; before the text only blanks are seen. (``across=False`` cuts the context at the
start of the word.) Every node of the context tree keeps, per binary choice, how often 0 and 1 followed in the
training texts, and its Krichevsky-Trofimov estimate. Weighting mixes the node's estimate half and half with the
product of its children's weighted probabilities, for all depths at once; the weights that the training texts leave
at the nodes then give the probability of every byte of any text.

As Spark jobs: texts become shards of word numbers in order, with their own small dictionaries. Each shard counts its
distinct (context, byte) and words; the counts travel as packed blobs, dealt over parts by a remainder, and a part
sums them for all shards. Contexts that end alike lie in one subtree: subtrees are folded in tasks that hold a bounded
number of them at once, at the shallowest level at which no subtree has more than ``SUBTREE`` rows (at full depth it
has 256 at most). Above, the tree is folded up level by level by grouping on the shortened context, and unfolded down
by joining each level with its parents, of which each has at most 256 children. Scores go back to the shards the way
the counts came, text scores are sums. Everything grows with the corpus as tables; the driver sees a few numbers.
Shards and parts are bounded, so is what a task holds at once; a text longer than a shard spans several, each of which
knows the bytes before it, and its parts are summed.

Edge cases: null and empty texts are one end; null ids count as empty text in the hash and come back null;
repeated rows count and are scored each; without training texts every choice has probability one half; words and
contexts never seen in training are spelled out by the tree; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import log_gamma
from ..workspace import MAX_BUCKETS, bucket_count, materialise, materialise_on
from .base import small_batches, text_of

# bytes of context; with the byte itself they fit a 64-bit number
DEPTH = 6
SHARD_TOKENS = 1 << 22
SHARD_BYTES = 1 << 24
# coded bytes per part of the summed counts, whose number grows with the corpus
PART_BYTES, LEAST_PARTS = 1 << 23, 64
_PRIME = 1_000_003
SUBTREE = 1 << 18
END = b"\n"
BLANK = b" " * DEPTH
_SLICE = 1 << 22
_PIECE, _TOGETHER = 1 << 20, 6
_ROWS = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LN_HALF, _LN_PI, _LN_TAU = math.log(0.5), math.log(math.pi), math.log(2 * math.pi)


class _Numbers(dict):
    """Numbers of the words of a shard; the end is 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some megabytes at a time."""
    text = text.lower()
    at = 0
    while at < len(text):
        stop = _SPACE.search(text, at + _SLICE)
        end = stop.start() if stop else len(text)
        yield text[at:end].split()
        at = end


def packed(numbers: np.ndarray) -> bytes:
    """Integers as compressed differences, byte by byte."""
    steps = np.diff(numbers, prepend=numbers.dtype.type(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, size: int, kind: type = np.int32) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.decompress(blob, width * size, "zstd", asbytes=True)
    steps = np.frombuffer(planes, np.uint8).reshape(width, size).T.copy().view(kind).ravel()
    return np.cumsum(steps, dtype=kind)


class _Shard:
    """Texts as the numbers of their words, in one dictionary."""

    def __init__(self):
        self.numbers = _Numbers()
        self.codes: list[np.ndarray] = []
        self.texts: list[dict] = []
        self.size = self.bytes = 0

    def put(self, words: list[bytes], text: dict, before: bytes) -> bytes:
        """Takes words of a text that come after the bytes ``before``; the bytes before the next ones."""
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        # a blank follows every word, nothing the end
        letters = sum(map(len, words)) + len(words) - (words[-1] == END)
        self.texts.append(text | {"tokens": len(words), "bytes": letters, "before": None if before == BLANK else before})
        self.size += len(words)
        self.bytes += letters
        return (before + b" ".join(words[-DEPTH:]) + b" ")[-DEPTH:]

    def row(self, shard: int) -> dict:
        codes = np.concatenate(self.codes)
        trained = np.repeat([t["train"] for t in self.texts], [t["tokens"] for t in self.texts])
        counts = np.bincount(codes[trained], minlength=len(self.numbers)).astype(np.int32)
        # numbers in text order do not rise, so their differences would only be longer
        codes = pa.compress(codes.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)
        return {"shard": shard, "words": b" ".join(self.numbers), "counts": packed(counts), "codes": codes, "texts": self.texts}


def _codes(blob: bytes, size: int) -> np.ndarray:
    planes = pa.decompress(blob, 4 * size, "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, size).T.copy().view(np.int32).ravel()


def coded(docs: DataFrame, train: Column, id_col: str, text_col: str, size: int = SHARD_TOKENS) -> DataFrame:
    """The written table of shards: words, their training counts, word numbers of all texts in order, and the texts' ids."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(
        F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("_text"), F.coalesce(train, F.lit(False)).alias("_train")
    )
    kind = texts.schema["_id"].dataType.simpleString()
    text_layout = f"struct<row:long,id:{kind},train:boolean,tokens:long,bytes:long,before:binary>"
    layout = f"shard long, words binary, counts binary, codes binary, texts array<{text_layout}>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        first, first_row = task << 16, task << 33
        schema = None
        shard, shards, rows = _Shard(), 0, 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([shard.row(first + shards)], schema)

        for batch in batches:
            if schema is None:
                sizes = [("tokens", pa.int64()), ("bytes", pa.int64()), ("before", pa.binary())]
                text = pa.struct([("row", pa.int64()), ("id", batch.schema.field("_id").type), ("train", pa.bool_()), *sizes])
                blobs = [(c, pa.binary()) for c in ("words", "counts", "codes")]
                schema = pa.schema([("shard", pa.int64()), *blobs, ("texts", pa.list_(text))])
            for key, text, trained in zip(*(batch[c].to_pylist() for c in ("_id", "_text", "_train")), strict=True):
                label = {"row": first_row + rows, "id": key, "train": trained}
                rows += 1
                before, waiting = BLANK, []
                for words in chain(_slices(text), [None]):
                    # the end goes with the last words
                    whole = waiting if words is not None else [*waiting, END]
                    while whole:
                        room = size - shard.size
                        before, whole = shard.put(whole[:room], label, before), whole[room:]
                        if shard.size >= size or shard.bytes >= SHARD_BYTES:
                            yield flushed()
                            shard, shards = _Shard(), shards + 1
                    waiting = words
        if shard.size:
            yield flushed()

    # bucketed by shard, so that only what goes back to the shards is shuffled
    return materialise_on(texts.mapInArrow(build, layout), "tree_shards", "shard", bucket_count(spark, 0))


def grams_of(words: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each coded byte with its context as one number, word after word, and the coded bytes per word."""
    padded = [BLANK + w + (b"" if w == END else b" ") for w in words]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded)) - DEPTH
    return _grams(np.frombuffer(b"".join(padded), np.uint8), sizes, depth, True), sizes


def _grams(text: np.ndarray, sizes: np.ndarray, depth: int, across: bool) -> np.ndarray:
    """Each coded byte with its context as one number; of every stretch of ``text`` the first ``DEPTH`` bytes are not
    coded, only seen before the others, whose ``sizes`` are given."""
    grams = np.zeros(len(text), np.int64)
    if not across:
        here, word = np.arange(len(text)), np.zeros(len(text), np.int64)
        word[1:] = np.where(text[:-1] == BLANK[0], here[1:], 0)
        inside = here - np.maximum.accumulate(word)
    for back in range(depth, -1, -1):
        grams <<= 8
        before = np.concatenate([np.zeros(back, np.uint8), text[: len(text) - back]])
        grams |= before if across else np.where(inside >= back, before, BLANK[0])
    whole = sizes + DEPTH
    is_coded = np.ones(len(text), bool)
    is_coded[((np.cumsum(whole) - whole)[:, None] + np.arange(DEPTH)).ravel()] = False
    return grams[is_coded]


def _pieces(row: dict, depth: int, across: bool) -> Iterator[tuple[slice, np.ndarray]]:
    """Of a shard's texts, some megabytes at a time: which texts, and the grams of their coded bytes."""
    texts = row["texts"]
    tokens, sizes = (texts.field(c).to_numpy() for c in ("tokens", "bytes"))
    # the words as coded, then what is seen before the texts: blanks or, if a text goes on, its last bytes
    spelled = [w + b" " for w in row["words"].split(b" ")]
    spelled[0], first_before = END, len(spelled)
    befores = texts.field("before").drop_null().to_pylist()
    goes_on = texts.field("before").is_valid().to_numpy(zero_copy_only=False)
    ahead = np.where(goes_on, first_before + np.cumsum(goes_on), first_before).astype(np.int32)
    spelled += [BLANK, *befores]
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
    starts, letters = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(spelled), np.uint8)
    codes = _codes(row["codes"], int(tokens.sum()))
    ends, token_ends = np.cumsum(sizes), np.cumsum(tokens)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + _PIECE)))
        which, start = slice(first, last), token_ends[first] - tokens[first]
        code = np.insert(codes[start : token_ends[last - 1]], token_ends[which] - tokens[which] - start, ahead[which])
        length = lengths[code]
        place = np.repeat(starts[code] - np.cumsum(length) + length, length)
        place += np.arange(len(place))
        yield which, _grams(letters[place], sizes[which], depth, across)
        first = last


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams, ascending, and how often each occurs; sorts ``grams`` in place."""
    grams.sort()
    first = np.flatnonzero(grams[1:] != grams[:-1]) + 1 if len(grams) else np.zeros(0, np.int64)
    first = np.append(0, first)[: len(grams)]
    return grams[first], np.diff(first, append=len(grams))


def _merged(grams: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams, ascending, with their summed counts."""
    gram, at = np.unique(np.concatenate(grams), return_inverse=True)
    return gram, np.bincount(at, np.concatenate(n), minlength=len(gram)).astype(np.int64)


def _dealt(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by part, and where each part begins and the last ends."""
    return np.argsort(part, kind="stable"), np.append(0, np.cumsum(np.bincount(part, minlength=parts)))


def _gram_parts(gram: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    return _dealt(gram % _PRIME % parts, parts)


def _word_parts(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    return _dealt(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts, parts)


def _listed(words: bytes) -> list[bytes]:
    return zlib.decompress(words).split(b" ") if words else []


def dealt_counts(shards: DataFrame, parts: int, depth: int, across: bool) -> DataFrame:
    """(part, shard, size, grams, n, words, word_n): each shard's distinct grams and words with their training counts,
    packed; written."""
    blobs = ("grams", "n", "words", "word_n")
    schema = pa.schema([(c, pa.int64()) for c in ("part", "shard", "size")] + [(c, pa.binary()) for c in blobs])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, joined, blob, codes, texts in zip(*(batch[c] for c in ("shard", "words", "counts", "codes", "texts")), strict=True):
                row = {"words": joined.as_py(), "codes": codes.as_py(), "texts": texts.values}
                sizes = texts.values.field("bytes").to_numpy()
                trained = texts.values.field("train").to_numpy(zero_copy_only=False)
                distinct = []
                # some pieces together: sorted fast, and little of a shard at once
                for pieces in batched(_pieces(row, depth, across), _TOGETHER):
                    learnt = [np.repeat(trained[which], sizes[which]) for which, _ in pieces]
                    for times, chosen in ((1, learnt), (0, [~some for some in learnt])):
                        gram, n = _distinct(np.concatenate([gram[some] for (_, gram), some in zip(pieces, chosen, strict=True)]))
                        distinct.append((gram, n * times))
                gram, n = _merged(*map(list, zip(*distinct, strict=True)))
                order, ends = _gram_parts(gram, parts)
                gram, n = gram[order], n[order].astype(np.int32)
                words = row["words"].split(b" ")
                times = unpacked(blob.as_py(), len(words))
                order, word_ends = _word_parts(words, parts)
                rows = []
                for part in range(parts):
                    here, mine = slice(ends[part], ends[part + 1]), order[word_ends[part] : word_ends[part + 1]]
                    spelled = zlib.compress(b" ".join([words[k] for k in mine.tolist()]), 1) if len(mine) else b""
                    if len(gram[here]) or spelled:
                        numbers = [packed(gram[here]), packed(n[here]), spelled, packed(times[mine])]
                        rows.append({"part": part, "shard": shard.as_py(), "size": len(gram[here])} | dict(zip(blobs, numbers, strict=True)))
                yield pa.RecordBatch.from_pylist(rows, schema)

    layout = ", ".join([f"{c} long" for c in ("part", "shard", "size")] + [f"{c} binary" for c in blobs])
    found = shards.select("shard", "words", "counts", "codes", "texts").mapInArrow(counted, layout)
    # bucketed by part, as it is read once for the sums and once to return them
    return materialise_on(found.repartition(parts, "part"), "tree_dealt", "part", parts)


def _vocabulary(table: pa.Table) -> dict[bytes, int]:
    """The words of a part with their summed counts."""
    total: dict[bytes, int] = {}
    for blob, numbers in zip(table["words"], table["word_n"], strict=True):
        words = _listed(blob.as_py())
        for word, n in zip(words, unpacked(numbers.as_py(), len(words)).tolist(), strict=True):
            total[word] = total.get(word, 0) + n
    return total


def summed_counts(dealt: DataFrame) -> DataFrame:
    """The written counts (gram, n) and, with a null gram, per part the tokens and types (tokens, types) in training."""

    def summed(table: pa.Table) -> pa.Table:
        sizes, blobs, numbers = (table[c].to_pylist() for c in ("size", "grams", "n"))
        grams = [unpacked(b, size, np.int64) for b, size in zip(blobs, sizes, strict=True)]
        gram, n = _merged(grams, [unpacked(b, size) for b, size in zip(numbers, sizes, strict=True)])
        counts = list(_vocabulary(table).values())
        columns = {"gram": [*gram.tolist(), None], "n": [*n.tolist(), None]}
        empty = [None] * len(gram)
        columns |= {"tokens": [*empty, sum(counts)], "types": [*empty, sum(k > 0 for k in counts)]}
        return pa.table({name: pa.array(values, pa.int64()) for name, values in columns.items()})

    rows = dealt.drop("shard").groupBy("part").applyInArrow(summed, "gram long, n long, tokens long, types long")
    return materialise(rows, "tree_counts")


def _log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 0.5: shifted by eight, then Stirling's series."""
    product = x
    for step in range(1, 8):
        product = product * (x + step)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * _LN_TAU + series - F.log(product)


def _log_kt(zeros: Column, ones: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - _LN_PI


class _Level:
    """Counts (context and byte, n) of one level, ascending, with the runs of rows that share a node per choice."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.n = key, n
        self.byte = key & 255
        self.runs, self.zeros, self.ones, self.kt = [], [], [], []
        for choice in range(8):
            node = key >> (8 - choice)
            run = np.cumsum(np.append(0, node[1:] != node[:-1])) if len(key) else np.zeros(0, np.int64)
            one = (self.byte >> (7 - choice)) & 1
            number = int(run[-1]) + 1 if len(run) else 0
            zeros, ones = (np.bincount(run, n * (one == bit), minlength=number) for bit in (0, 1))
            self.runs.append(run)
            self.zeros.append(zeros)
            self.ones.append(ones)
            self.kt.append(log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - _LN_PI)

    def chosen(self, choice: int) -> np.ndarray:
        """Estimate of the choice that leads to each row's byte."""
        run, one = self.runs[choice], (self.byte >> (7 - choice)) & 1
        right = np.where(one == 1, self.ones[choice][run], self.zeros[choice][run])
        return (right + 0.5) / (self.zeros[choice][run] + self.ones[choice][run] + 1.0)


def fold(gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Weighted probabilities of whole subtrees from level ``top`` down, for ascending grams.

    Returns, per gram and choice, the subtree's probability of that choice, and the nodes at the top as
    (key, zeros, ones, ln of the weighted probability).
    """
    levels, up = [_Level(gram, n)], []
    for level in range(depth - 1, top - 1, -1):
        key, parent = np.unique(levels[-1].key & ((1 << 8 * (level + 1)) - 1), return_inverse=True)
        up.append(parent)
        levels.append(_Level(key, np.bincount(parent, levels[-1].n, minlength=len(key))))
    likely = np.empty((len(gram), 8))
    nodes = []
    for choice in range(8):
        weighted, own = levels[0].kt[choice], [np.ones(len(levels[0].kt[choice]))]
        for below, here, parent in zip(levels, levels[1:], up, strict=False):
            # a node's parent is that of its first row
            first = np.flatnonzero(np.append(1, np.diff(below.runs[choice])))
            children = np.bincount(here.runs[choice][parent[first]], weighted, minlength=len(here.kt[choice]))
            weighted = _LN_HALF + np.logaddexp(here.kt[choice], children)
            own.append(np.exp(_LN_HALF + here.kt[choice] - weighted))
        # rows of each level to which the grams belong, from the deepest up
        rows = [np.arange(len(gram))]
        for parent in up:
            rows.append(parent[rows[-1]])
        mixed, left = np.zeros(len(gram)), np.ones(len(gram))
        for level, share, row in zip(reversed(levels), reversed(own), reversed(rows), strict=True):
            share = share[level.runs[choice]][row]
            mixed += left * share * level.chosen(choice)[row]
            left *= 1 - share
        likely[:, choice] = mixed
        last = levels[-1]
        first = np.flatnonzero(np.append(1, np.diff(last.runs[choice]))) if len(last.key) else np.zeros(0, np.int64)
        key = (last.key[first] >> 8 << 8) | (1 << choice) | (last.byte[first] >> (8 - choice))
        nodes.append((key, last.zeros[choice], last.ones[choice], weighted))
    return likely, tuple(np.concatenate(parts) for parts in zip(*nodes, strict=True))


def _context(level: int) -> Column:
    """The nearest bytes of a gram's context."""
    return F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * level) - 1))


def _folded(grams: DataFrame, depth: int, top: int) -> DataFrame:
    """Rows of two kinds: (gram, likely) and, with a null gram, the nodes (key, zeros, ones, weighted) at the top."""
    kinds = [("gram", pa.int64()), ("likely", pa.list_(pa.float64())), ("key", pa.int64())]
    schema = pa.schema(kinds + [(c, pa.float64()) for c in ("zeros", "ones", "weighted")])

    def done(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(gram)
        gram, n = gram[order], n[order].astype(np.float64)
        likely, nodes = fold(gram, n, depth, top)
        for at in range(0, len(gram), _ROWS):
            part = likely[at : at + _ROWS]
            lists = pa.ListArray.from_arrays(np.arange(0, 8 * len(part) + 1, 8, dtype=np.int32), part.ravel())
            empty = [pa.nulls(len(part), t) for t in schema.types[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(gram[at : at + _ROWS]), lists, *empty], schema=schema)
        for at in range(0, len(nodes[0]), _ROWS):
            columns = [pa.array(c[at : at + _ROWS]) for c in nodes]
            empty = [pa.nulls(len(columns[0]), t) for t in schema.types[:2]]
            yield pa.RecordBatch.from_arrays([*empty, *columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch[c].to_numpy() for c in ("stem", "gram", "n")]))
            if sum(h.shape[1] for h in held) >= SUBTREE:
                stem, gram, n = np.concatenate(held, axis=1)
                # the last subtree may go on in the next batch
                cut = int(np.searchsorted(stem, stem[-1]))
                if cut:
                    yield from done(gram[:cut], n[:cut])
                held = [np.stack([stem[cut:], gram[cut:], n[cut:]])]
        if held:
            _, gram, n = np.concatenate(held, axis=1)
            yield from done(gram, n)

    placed = grams.select(_context(top).alias("stem"), "gram", "n").repartition("stem").sortWithinPartitions("stem")
    return placed.mapInArrow(run, "gram long, likely array<double>, key long, zeros double, ones double, weighted double")


def _top_level(grams: DataFrame, depth: int) -> int:
    """The shallowest level from 2 on at which no subtree has more than ``SUBTREE`` rows."""
    for level in range(min(2, depth), depth):
        largest = grams.groupBy(_context(level)).agg(F.count("*").alias("rows")).agg(F.max("rows")).first()[0] or 0
        if largest <= SUBTREE:
            return level
    return depth


def byte_scores(grams: DataFrame, depth: int = DEPTH, top: int | None = None) -> DataFrame:
    """(gram, score): log10 probability of each byte in its context, from the written counts (gram, n).

    A node's key is its context followed by the choices of the byte made so far, as a number from 1 to 255.
    """
    top = _top_level(grams, depth) if top is None else top
    folded = materialise(_folded(grams, depth, top), "tree_folded")
    zeros, ones = F.col("zeros"), F.col("ones")

    # up: each level from its children
    nodes = materialise(folded.filter("gram IS NULL").select("key", "zeros", "ones", "weighted"), "tree_level")
    levels = []
    for level in range(top - 1, -1, -1):
        shorter = F.col("key").bitwiseAND(F.lit((1 << 8 * (level + 1)) - 1))
        nodes = nodes.groupBy(shorter.alias("key")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("_children")
        )
        nodes = nodes.select("*", _log_kt(zeros, ones).alias("_kt"))
        higher = F.greatest("_kt", "_children")
        nodes = nodes.select("*", (_LN_HALF + higher + F.log1p(F.exp(-F.abs(F.col("_kt") - F.col("_children"))))).alias("weighted"))
        # the share that the node's own estimate has in the mixture
        nodes = nodes.select("key", "zeros", "ones", "weighted", F.exp(_LN_HALF + F.col("_kt") - F.col("weighted")).alias("own"))
        nodes = materialise(nodes, "tree_level")
        levels.append(nodes)

    # down: the mixture from the root to each node, and what is left for the deeper ones
    total = zeros + ones + 1.0
    mixed = None
    for level, nodes in enumerate(reversed(levels)):
        here = nodes.select("key", "own", ((zeros + 0.5) / total).alias("_zero"), ((ones + 0.5) / total).alias("_one"))
        if mixed is None:
            known = here.select("*", F.lit(0.0).alias("zero"), F.lit(0.0).alias("one"), F.lit(1.0).alias("left"))
        else:
            shorter = F.col("key").bitwiseAND(F.lit((1 << 8 * level) - 1))
            parents = mixed.withColumnRenamed("key", "_parent")
            known = here.withColumn("_parent", shorter).join(parents, "_parent")
        share = F.col("left") * F.col("own")
        mixed = known.select(
            "key",
            (F.col("zero") + share * F.col("_zero")).alias("zero"),
            (F.col("one") + share * F.col("_one")).alias("one"),
            (F.col("left") * (1 - F.col("own"))).alias("left"),
        )
    # per shortened context and byte, the eight choices that lead to it
    leaf = F.shiftleft(_context(top - 1), 8).bitwiseOR(F.col("gram").bitwiseAND(F.lit(255))).alias("leaf")
    scored = folded.filter("gram IS NOT NULL").select("gram", "likely", leaf)
    steps = scored.select("leaf").distinct().select("leaf", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_choice"))
    made = F.expr("leaf >> 8 << 8 | 1 << _choice | (leaf & 255) >> (8 - _choice)")
    steps = steps.select("leaf", "_choice", made.alias("key"), F.expr("leaf >> (7 - _choice) & 1").alias("_bit"))
    above = F.when(F.col("_bit") == 0, F.col("zero")).otherwise(F.col("one")).alias("above")
    steps = steps.join(mixed, "key").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("_choice", above, "left"))).alias("steps"))
    # written, so that its size is known and a small one is broadcast instead of moving the grams
    steps = materialise(steps, "tree_steps")
    choices = [F.log10(F.col("steps")[c]["above"] + F.col("steps")[c]["left"] * F.col("likely")[c]) for c in range(8)]
    return scored.join(steps, "leaf").select("gram", sum(choices[1:], choices[0]).alias("score"))


def returned_scores(dealt: DataFrame, scored: DataFrame, parts: int) -> DataFrame:
    """(shard, part, scores, seen): per shard, in the order of the written ``dealt``, the scores (gram, score) of its
    grams and the training counts of its words, packed."""

    def returned(table: pa.Table, known: pa.Table) -> pa.Table:
        gram, score = known["gram"].to_numpy(), known["score"].to_numpy()
        order = np.argsort(gram)
        # the last 20 bits of a score are some 1e-10 of it and would be most of what is sent
        gram, score = gram[order], score[order].view(np.int64) & -(1 << 20)
        total = _vocabulary(table)
        scores, seen = [], []
        for blob, size, words in zip(*(table[c].to_pylist() for c in ("grams", "size", "words")), strict=True):
            scores.append(packed(score[np.searchsorted(gram, unpacked(blob, size, np.int64))]))
            seen.append(packed(np.array([total[w] for w in _listed(words)], np.int64)))
        blobs = {"scores": pa.array(scores, pa.binary()), "seen": pa.array(seen, pa.binary())}
        return pa.table({"shard": table["shard"], "part": table["part"]} | blobs)

    scored = scored.withColumn("part", F.col("gram") % _PRIME % parts)
    pairs = dealt.drop("n").groupBy("part").cogroup(scored.groupBy("part"))
    return pairs.applyInArrow(returned, "shard long, part long, scores binary, seen binary")


def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, size: int = SHARD_TOKENS,
    across: bool = False,
) -> DataFrame:
    """One row per input row: ``id_col``, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``base_score`` is the add-one unigram score, ``score`` the model's log10 probability; both learn from the rows
    for which ``train`` holds. With ``across`` contexts go on across words, else they begin with the word.
    """
    shards = coded(docs, train, id_col, text_col, size)
    coded_bytes = shards.select(F.expr("aggregate(texts.bytes, 0L, (x, y) -> x + y)").alias("bytes"))
    parts = max(LEAST_PARTS, math.ceil((coded_bytes.agg(F.sum("bytes")).first()[0] or 0) / PART_BYTES))
    parts = min(parts, MAX_BUCKETS)
    dealt = dealt_counts(shards, parts, depth, across)
    counts = summed_counts(dealt)
    seen = counts.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = seen["tokens"] or 0, seen["types"] or 0
    known = returned_scores(dealt, byte_scores(counts.filter("gram IS NOT NULL").select("gram", "n"), depth), parts)
    kind = shards.schema["texts"].dataType.elementType["id"].dataType.simpleString()

    def summed(table: pa.Table, known: pa.Table) -> pa.Table:
        texts = table["texts"].combine_chunks().flatten()
        size, letters = (texts.field(c).to_numpy() for c in ("tokens", "bytes"))
        row = {"words": table["words"][0].as_py(), "codes": table["codes"][0].as_py(), "texts": texts}
        pieces = []
        for which, gram in _pieces(row, depth, across):
            own, at = np.unique(gram, return_inverse=True)
            pieces.append((which, own, at.astype(np.int32)))
        gram, _ = _distinct(np.concatenate([own for _, own, _ in pieces]))
        words = row["words"].split(b" ")
        order, ends = _gram_parts(gram, parts)
        word_order, word_ends = _word_parts(words, parts)
        score, n = np.empty(len(gram)), np.empty(len(words), np.int64)
        for part, scores, counts in zip(*(known[c].to_pylist() for c in ("part", "scores", "seen")), strict=True):
            here, mine = order[ends[part] : ends[part + 1]], word_order[word_ends[part] : word_ends[part + 1]]
            score[here] = unpacked(scores, len(here), np.int64).view(np.float64)
            n[mine] = unpacked(counts, len(mine), np.int64)
        per_word = {"n_known": (n > 0).astype(np.int64), "base_score": np.log10((n + 1) / (tokens + types + 1))}
        codes, starts = _codes(row["codes"], int(size.sum())), np.cumsum(size) - size
        sums = {name: np.add.reduceat(values[codes], starts) for name, values in per_word.items()}
        spelled = [
            np.add.reduceat(score[np.searchsorted(gram, own)][at], np.cumsum(letters[which]) - letters[which])
            for which, own, at in pieces
        ]
        sums["score"] = np.concatenate(spelled)
        labels = {c: texts.field(c) for c in ("row", "id", "train", "tokens", "bytes")}
        return pa.table({**labels, **sums})

    layout = f"row long, id {kind}, train boolean, tokens long, bytes long, n_known long, base_score double, score double"
    narrow = shards.select("shard", "words", "codes", "texts")
    parts = narrow.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(summed, layout)
    sums = [F.sum(c).alias(c) for c in ("tokens", "bytes", "n_known", "base_score", "score")]
    whole = parts.groupBy("row", "id", "train").agg(*sums)
    return whole.select(
        F.col("id").alias(id_col),
        "train",
        F.col("tokens").alias("n_tokens"),
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        (-F.col("score") * math.log2(10) / F.col("bytes")).alias("bits_per_byte"),
    )
