"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The vocabulary file of a public tokenizer is a parameter. Spark counts the words of all rows, in each task first
in a table of bounded size; at most ``lexicon_words`` of the most frequent ones are compiled on the driver into a minimal acyclic automaton with shared prefixes and suffixes, whose
edges carry how many words come before, so that a path yields the word's number and with it its ids. The
automaton is one flat file: it goes to the shared folder, Spark ships it to the executors, and every Python
worker maps it into memory. Words outside it are merged exactly, pair by pair in rank order: the new words of
a few texts side by side as rows of a matrix, long ones with a heap. So the lexicon changes the
speed and never the ids. A table per worker keeps what was looked up; it is emptied after the texts that fill it.

Edge cases: a null text is empty; an empty text has no ids and decodes to the empty text; strings of added
tokens inside a text become their ids, as the vocabulary's library does by default; repeated rows give equal
rows; an empty table gives an empty result (and an empty lexicon); only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import materialise, new_path
from .base import small_batches, text_of

LEXICON_WORDS = 50_000
# a task counts so many units before it hands them on
COUNTED_UNITS = 1 << 18
CACHED_UNITS = 1 << 19
# texts are encoded together up to so many characters
_TOGETHER = 1 << 20
# words up to the last of these lengths are merged side by side, so many at once
_WIDTHS = (4, 6, 8, 12, 16, 24, 48)
_ROWS_AT_ONCE = 1 << 14
_SHORT = _WIDTHS[-1]
_NEVER = (1 << 31) - 1
_SINGLE = [bytes([b]) for b in range(256)]

# fixed value: the public split pattern of this kind of vocabulary, with white space by its Unicode property
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_TWO_SPACES = re.compile(r"\s\s")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file: printable Latin-1 bytes stand
    for themselves, the others get the characters from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class Vocabulary:
    """Pair ranks, token bytes and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        added = spec["added_tokens"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens with context are not supported")
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        ids = model["vocab"]
        self.first = [ids[letters[b]] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in added}
        tokens = {i: bytes(back[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        # the same as arrays: pairs as one number each, sorted
        self._first, self._made = np.array(self.first, np.int32), np.array(self.made, np.int32)
        keys = np.array([a * len(self.tokens) + b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.fromiter(self.ranks.values(), np.int32, len(keys))[order]

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word: always the pair of lowest rank, the leftmost of several."""
        ids = [self.first[b] for b in word]
        if len(ids) > _SHORT:
            return self._merged_long(ids)
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(pair, _NEVER) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), _NEVER)
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), _NEVER)
        return ids

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], np.int32(_NEVER))

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words as little-endian 32-bit integers, as ``merged`` gives them."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = -1
        for width in _WIDTHS if len(self._keys) else ():
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            for begin in range(0, len(chosen), _ROWS_AT_ONCE):
                self._merge_rows(words, chosen[begin : begin + _ROWS_AT_ONCE], width, out)
            low = width
        for n in np.flatnonzero(sizes > low).tolist():
            out[n] = array("I", self.merged(words[n])).tobytes()
        return out

    def _merge_rows(self, words: list[bytes], who: np.ndarray, width: int, out: list[bytes]) -> None:
        """Words of at most ``width`` bytes as rows of a matrix: in every round each row merges its pair of lowest
        rank, the leftmost of several, until none is left."""
        raw = np.frombuffer(b"".join([words[n].ljust(width, b"\0") for n in who.tolist()]), np.uint8)
        ids = self._first[raw.reshape(-1, width)]
        sizes = np.array([len(words[n]) for n in who.tolist()])
        columns = np.arange(width)
        ranks = np.full(ids.shape, _NEVER, np.int32)  # of the pair that begins at a column
        ranks[:, :-1] = np.where(columns[1:] < sizes[:, None], self._rank(ids[:, :-1], ids[:, 1:]), _NEVER)
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            done = best == _NEVER
            if done.any():
                for n, size, row in zip(who[done].tolist(), sizes[done].tolist(), ids[done].astype("<u4"), strict=True):
                    out[n] = row[:size].tobytes()
                left = ~done
                who, ids, ranks, sizes, at, best = who[left], ids[left], ranks[left], sizes[left], at[left], best[left]
                if not len(who):
                    return
            rows = np.arange(len(at))
            ids[rows, at] = self._made[best]
            moved = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, moved, 1)
            ranks = np.take_along_axis(ranks, moved, 1)
            sizes = sizes - 1
            after = np.minimum(at + 1, width - 1)
            ranks[rows, at] = np.where(at + 1 < sizes, self._rank(ids[rows, at], ids[rows, after]), _NEVER)
            inner = rows[at > 0]
            before = at[inner] - 1
            ranks[inner, before] = self._rank(ids[inner, before], ids[inner, before + 1])

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, in n log n."""
        rank_of, n = self.ranks.get, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank, k) for k in range(n - 1) if (rank := rank_of((ids[k], ids[k + 1]), _NEVER)) < _NEVER]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right < 0:
                continue
            if rank_of((ids[k], ids[right])) != rank:
                continue
            ids[k], ids[right] = self.made[rank], -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0:
                    near = rank_of((ids[left], ids[after[left]]), _NEVER)
                    if near < _NEVER:
                        heapq.heappush(heap, (near, left))
        return [i for i in ids if i >= 0]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of the words as one flat file.

    Words are added in order; a state that can get no further edge is replaced by an equal one if there is
    (same finality, same edges), which shares suffixes. Layout: five section lengths, then the edge labels,
    the finality of states, and as 32-bit integers the first edge of each state, edge targets, edge counts,
    the first id of each word and the ids.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []

    def settle(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(states)
            states.append((state[0], list(state[1])))
        return register[key]

    path: list[list] = [[False, []]]  # open states of the last word: finality, settled edges
    last = b""
    words = sorted(entries)
    for word in words:
        same = 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        while len(path) - 1 > same:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(done)))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(done)))
    root = settle(path[0])

    below = [0] * len(states)
    for n, (final, edges) in enumerate(states):  # targets are settled first
        below[n] = final + sum(below[t] for _, t in edges)
    order = [root, *[n for n in range(len(states)) if n != root]]
    place = {n: k for k, n in enumerate(order)}
    labels, final, first, targets, counts = bytearray(), bytearray(), array("i", [0]), array("i"), array("i")
    for n in order:
        passed = int(states[n][0])
        final.append(passed)
        for label, target in states[n][1]:
            labels.append(label)
            targets.append(place[target])
            counts.append(passed)
            passed += below[target]
        first.append(len(labels))
    id_first, ids = array("i", [0]), array("I")
    for word in words:
        ids.extend(entries[word])
        id_first.append(len(ids))
    for part in (labels, final):
        part += b"\0" * (-len(part) % 4)
    parts = [bytes(labels), bytes(final), *[a.tobytes() for a in (first, targets, counts, id_first, ids)]]
    return struct.pack("<7q", *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        lengths = struct.unpack_from("<7q", self.map)
        places = [56]
        for length in lengths:
            places.append(places[-1] + length)
        view = memoryview(self.map)
        self.labels_at = places[0]
        self.final = view[places[1] : places[2]]
        self.first, self.targets, self.counts, self.id_first = (
            view[places[k] : places[k + 1]].cast("i") for k in range(2, 6)
        )
        self.ids = view[places[6] : places[7]]

    def get(self, word: bytes) -> bytes | None:
        """The ids of a word as little-endian 32-bit integers."""
        find, first, counts, targets = self.map.find, self.first, self.counts, self.targets
        at, state, number = self.labels_at, 0, 0
        for byte in word:
            edge = find(_SINGLE[byte], at + first[state], at + first[state + 1]) - at
            if edge < 0:
                return None
            number += counts[edge]
            state = targets[edge]
        if not self.final[state]:
            return None
        return bytes(self.ids[4 * self.id_first[number] : 4 * self.id_first[number + 1]])


class Encoder(dict):
    """Ids (as bytes) per unit of text, a word or what stands between two blanks; forgets all when full."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        super().__init__()
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.split = regex.compile(PATTERN).findall
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def _learn(self, units: Iterable[str]) -> set[str]:
        """Add the ids of units that are not known yet; the words in them."""
        split, added = self.split, self.vocabulary.added
        several: dict[str, list[str]] = {}
        words: set[str] = set()
        for unit in units:
            if unit in added:
                self[unit] = struct.pack("<I", added[unit])
            elif unit.isalpha() or unit[1:].isalpha() and unit[0] == " ":
                words.add(unit)  # letters only: one word
            else:
                several[unit] = split(unit)
                words.update(several[unit])
        rest: dict[str, bytes] = {}
        for word in filterfalse(self.__contains__, words):
            raw = word.encode()
            ids = self.lexicon.get(raw) if self.lexicon else None
            if ids is None:
                rest[word] = raw
            else:
                self[word] = ids
        self.update(zip(rest, self.vocabulary.merged_all(list(rest.values())), strict=True))
        for unit, parts in several.items():
            self[unit] = b"".join([self[word] for word in parts])
        return words

    def _plain(self, text: str) -> list[str]:
        if _TWO_SPACES.search(text):
            return self.split(text)
        # without neighbouring spaces, a line feed is a word of its own and a blank begins one
        out = []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append("\n")
            head, *rest = line.split(" ")
            if head:
                out.append(head)
            out += [" " + unit for unit in rest]
        return out

    def _units(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        out = []
        for n, part in enumerate(self.added.split(text)):
            out += [part] if n % 2 else self._plain(part)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers."""
        lists = [self._units(text) for text in texts]
        lacking: set[str] = set()
        for units in lists:
            lacking.update(filterfalse(self.__contains__, units))
        words = self._learn(lacking)
        out = [b"".join(map(self.__getitem__, units)) for units in lists]
        if len(self) >= CACHED_UNITS:
            self.clear()
        for unit in lacking | words:
            if len(unit) > 64:  # long ones are not worth their room
                self.pop(unit, None)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        numbers = memoryview(ids).cast("I")
        return b"".join(map(self.vocabulary.tokens.__getitem__, numbers)).decode("utf-8", "replace")


def together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of a bounded number of characters; a longer text is a list of its own."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > _TOGETHER:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _unit_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(unit, n) of the blank-separated units of all rows, summed within tasks."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["unit", "n"])

        for batch in batches:
            for text in batch["_text"].to_pylist():
                counts.update(text.replace("\n", " ").split(" "))
                if len(counts) >= COUNTED_UNITS:
                    yield flushed()
                    counts.clear()
        if counts:
            yield flushed()

    return docs.select(text_of(text_col).alias("_text")).mapInArrow(count, "unit string, n long").filter("unit != ''")


def frequent_units(docs: DataFrame, text_col: str, top: int) -> list[str]:
    """At most ``top`` of the most frequent blank-separated units of all rows: those that occur at least as often
    as the first frequency that has no more than ``top`` units at or above it, twice at least."""
    units = _unit_counts(docs, text_col).groupBy("unit").agg(F.sum("n").alias("n"))
    counted = materialise(units.filter("n > 1"), "bpe_units")
    # n units in all have at most sqrt(2 n) different frequencies
    per_n = sorted(((r["n"], r["units"]) for r in counted.groupBy("n").agg(F.count("*").alias("units")).collect()), reverse=True)
    least, taken = None, 0
    for n, number in per_n:
        taken += number
        if taken > top:
            break
        least = n
    return [] if least is None else [r["unit"] for r in counted.filter(F.col("n") >= least).select("unit").collect()]


def build_lexicon(vocabulary: Vocabulary, units: list[str]) -> bytes:
    split = regex.compile(PATTERN).findall
    words = {w.encode() for unit in units for form in (unit, " " + unit) for w in split(form)}
    listed = list(words)
    return compile_lexicon({w: np.frombuffer(ids, "<u4").tolist() for w, ids in zip(listed, vocabulary.merged_all(listed), strict=True)})


def ship(spark: SparkSession, content: bytes) -> str:
    """Store bytes in the shared folder and have Spark send the file to all executors; its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{new_path(spark, 'bpe')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(content)
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary, name: str) -> Encoder:
    """One encoder per worker process and lexicon."""
    if name not in _encoders:
        _encoders[name] = Encoder(vocabulary.value, Lexicon(SparkFiles.get(name)))
    return _encoders[name]


def tokenised(
    docs: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lexicon_words: int = LEXICON_WORDS,
    keep: tuple[str, ...] = ("ids", "decoded"),
) -> DataFrame:
    """One row per input row: ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, if in ``keep``, ``ids``
    (binary, little-endian unsigned 32-bit integers) and ``decoded``."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = Vocabulary(vocabulary_path)
    name = ship(spark, build_lexicon(vocabulary, frequent_units(docs, text_col, lexicon_words)))
    shared = spark.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file
    extra = [c for c in ("ids", "decoded") if c in keep]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared, name)
        for batch in batches:
            ids = [i for texts in together(batch["_text"].tolist()) for i in encoder.encode_all(texts)]
            decoded = [encoder.decode(i) for i in ids]
            out = pd.DataFrame(
                {
                    "_id": batch["_id"],
                    "n_tokens": [len(i) // 4 for i in ids],
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
                }
            )
            if "ids" in extra:
                out["ids"] = ids
            if "decoded" in extra:
                out["decoded"] = decoded
            yield out

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = {"ids": ", ids binary", "decoded": ", decoded string"}
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(kinds[c] for c in extra)
    return rows.mapInPandas(encode, schema).withColumnRenamed("_id", id_col)
