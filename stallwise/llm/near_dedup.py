"""Near-duplicate classes by DartMinHash signatures of word shingles.

A text is the multiset of its runs of five lower-case words, each weighted by its occurrences; texts are
linked when the weighted Jaccard similarity is 0.8 or more, and a class is a connected component of links.

Signature: every unit of weight is a region into which hashed darts fall as a Poisson process in rank order.
All darts of a text up to a rank limit are thrown (a few per coordinate, whatever its length), each is hashed
to a coordinate, and a coordinate keeps its earliest dart. If one stays empty the limit doubles. Two texts
agree in a coordinate with the probability of their similarity. The coordinates form 32 bands of five; texts
that share a band are candidates. A pair at similarity 0.8 shares none with probability 3e-6.

Linking without all pairs of a bucket: texts that are equal word for word are one node from the start. Every
bucket then compares its members to one center, the member that shares most buckets with most others: where
copies drifted from one text, that is the text itself or the copy nearest to it, so nearly all of them link.
Pairs whose signatures agree too little to reach 0.8 (by 4.5 standard deviations) are dropped, the rest is
checked exactly on the texts, and the links found merge classes. Further rounds draw centers by a hash in finer
buckets, of two bands each and other pairs of bands every round, for the members of buckets that still hold two
classes, until less than one tested pair in ten is a link.

What is left - pairs of different classes - is first compared member by member in buckets of two bands each with
at most ``FEW`` members outside their largest class. Then every bucket that still holds two classes is compared
whole, whatever its size: its members outside the largest class with all members of other classes. Such a bucket is
dealt into blocks of ``BLOCK_BYTES`` of texts; a task holds the signatures and texts of two blocks, drops the pairs
whose signatures agree too little, checks the rest exactly on the texts, and returns links only. So every pair that
shares a band is in one class, or too far apart by its signatures, or tested; none depends on the size of a bucket.
The pairs looked at grow with the square of the texts that are near one another without being linked, as they must,
but none of them is ever a row: rows grow with the buckets' members, times the blocks of the other side.

Buckets are key-value rows, looked at through windows on one exchange. Texts are fetched once, for texts in shared
buckets: a bitmap of fixed size marks them while the table is read.

Edge cases: null and empty texts are equal to one another, a text of one to four words is one shingle of all
its words; repeated rows are copies; the smallest id of a class names it, null ids last (null if all are); an
empty table gives an empty result; other columns are ignored and pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialise
from .base import SPACE, SPACES, bitmap_of, small_batches, text_of, with_bit

SHINGLE = 5
BANDS = 32
ROWS = 5
COORDINATES = BANDS * ROWS
# darts per text: with k*ln(k) + 4k, two texts in a hundred need a second throw
DARTS = COORDINATES * (np.log(COORDINATES) + 4)
# similarity 0.8 as a fraction, compared in integers
LEAST = (4, 5)
# agreeing coordinates: 0.8 less 4.5 standard deviations
LEAST_AGREEING = int(COORDINATES * 0.8 - 4.5 * (COORDINATES * 0.16) ** 0.5)
# star rounds go on while one tested pair in so many is a link
WORTHWHILE = 10
# a bucket with more members than this outside its largest class is compared in blocks
FEW = 2
BLOCK_BYTES = 1 << 23
CACHED_WORDS = 1 << 19
_AT_ONCE = 1 << 14

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        self[word] = found
        return found


def shingles(texts: list[str], known: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of all texts and how many each text has."""
    lists = [text.lower().encode("utf-8", "replace").split() for text in texts]
    sizes = np.array([len(words) for words in lists], np.int64)
    hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.uint64, int(sizes.sum()))
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, 1)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(counts.sum()), np.uint64)
    ends = np.cumsum(counts)
    if len(hashes) >= SHINGLE:
        rolled = np.zeros(len(hashes) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            rolled = _mix(rolled * _GOLD + hashes[k : k + len(rolled)])
    for n, size in enumerate(sizes.tolist()):
        a, b, at = int(ends[n] - counts[n]), int(ends[n]), int(starts[n])
        if size >= SHINGLE:
            out[a:b] = rolled[at : at + size - SHINGLE + 1]
        else:
            short = np.zeros(1, np.uint64) + np.uint64(size + 1)
            for k in range(size):
                short = _mix(short * _GOLD + hashes[at + k : at + k + 1])
            out[a] = short[0]
    return out, counts


def _regions(hashed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit weight regions: (hash of shingle and occurrence, index of the text)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    place = np.arange(len(hashed))
    occurrence = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return _mix(hashed + occurrence.astype(np.uint64) * _GOLD), owner


def signatures(hashed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16 bits of the earliest dart per text and coordinate."""
    k = COORDINATES
    regions, owner = _regions(hashed, counts)
    earliest = np.full(len(counts) * k, np.inf)
    limit = DARTS / counts
    open_ = np.ones(len(counts), bool)
    while open_.any():
        mine = open_[owner]
        region, text = regions[mine], owner[mine]
        rank = np.zeros(len(region))
        dart = 0
        while len(region):
            # the next darts of every region that is still below its text's limit; several if few regions are left
            width = min(64, max(1, _AT_ONCE // len(region)))
            numbers = np.arange(dart + 1, dart + width + 1, dtype=np.uint64) * _M2
            bits = _mix(region[:, None] + numbers)
            gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            gaps[:, 0] += rank
            ranks = np.cumsum(gaps, axis=1)
            inside = ranks <= limit[text][:, None]
            place = (text * k)[:, None] + (_mix(bits + _GOLD) % np.uint64(k)).astype(np.int64)
            np.minimum.at(earliest, place[inside], ranks[inside])
            more = inside[:, -1]
            region, text, rank, dart = region[more], text[more], ranks[more, -1], dart + width
        open_ = np.isinf(earliest.reshape(-1, k)).any(axis=1)
        limit = np.where(open_, limit * 2, limit)
    # single precision: the last bit of a logarithm does not show
    code = _mix(earliest.astype(np.float32).view(np.uint32).astype(np.uint64))
    return (code >> np.uint64(48)).astype(np.uint16).reshape(-1, k)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    parts = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key * _GOLD + parts[:, :, r])
    return key.view(np.int64)


def similar(a: str, b: str, known: _WordHashes | None = None) -> tuple[int, int]:
    """Weighted Jaccard similarity of two texts as (shared, joint) weight."""
    return _overlap(_counted(a, known), _counted(b, known))


def _counted(text: str, known: _WordHashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    hashed, _ = shingles([text], _WordHashes() if known is None else known)
    return np.unique(hashed, return_counts=True)


def _overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][at], b[1][bt]).sum())
    return shared, int(a[1].sum() + b[1].sum()) - shared


def _content(text: Column) -> Column:
    """128-bit key of the lower-case words."""
    return F.unhex(F.md5(F.lower(F.btrim(F.regexp_replace(text, SPACE, " "), F.lit(SPACES))).cast("binary")))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row's id and content key, numbered; written."""
    text = text_of(text_col)
    return materialise(
        docs.select(F.col(id_col).alias("_id"), _content(text).alias("_content"), F.monotonically_increasing_id().alias("_row")),
        "near_rows",
    )


def _nodes(rows: DataFrame) -> DataFrame:
    """One node per content: number, rows, and the row that would stay (smallest id, null ids last)."""
    first = F.min(F.struct(F.col("_id").isNull().alias("last"), F.col("_id"), F.col("_row"))).alias("_first")
    nodes = rows.groupBy("_content").agg(F.min("_row").alias("node"), F.count("*").alias("_n"), first)
    return materialise(nodes, "near_nodes")


def _signed(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """(node, signature, bands) per node; written."""
    small_batches(docs.sparkSession)
    text = text_of(text_col)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for batch in batches:
            if len(batch):
                signature = signatures(*shingles(batch["_text"].tolist(), known))
                yield pd.DataFrame(
                    {
                        "_content": batch["_content"],
                        "signature": [row.tobytes() for row in signature],
                        "bands": list(bands(signature)),
                    }
                )

    texts = docs.select(_content(text).alias("_content"), text.alias("_text"))
    signed = texts.mapInPandas(sign, "_content binary, signature binary, bands array<long>")
    # copies have equal signatures: one of them is enough
    one = signed.groupBy("_content").agg(F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands"))
    return materialise(one.join(nodes.select("_content", "node"), "_content").select("node", "signature", "bands"), "near_signed")


def _bucket(*columns: str) -> Window:
    """The rows of a bucket; columns beside the key divide it."""
    return Window.partitionBy("key", *columns)


def _members(signed: DataFrame) -> DataFrame:
    """(key, node, n) of the buckets with two nodes or more, n of them; written."""
    rows = signed.select("node", F.explode("bands").alias("key"))
    return materialise(rows.withColumn("n", F.count("*").over(_bucket())).filter("n > 1"), "near_members")


def _mixed(rows: DataFrame) -> DataFrame:
    """The (key, node, class) rows of buckets that hold two classes or more."""
    ends = {"low": F.min("class").over(_bucket()), "high": F.max("class").over(_bucket())}
    return rows.withColumns(ends).filter("low != high").drop("low", "high")


def _stars(rows: DataFrame, order: Column) -> DataFrame:
    """Pairs (a, b) of a center and the members of other classes, per bucket; the member lowest in ``order`` is the
    center."""
    center = F.min_by(F.struct("node", "class"), order).over(_bucket())
    marked = rows.select("key", "node", "class", center.alias("center")).filter("class != center.class")
    return _pairs(marked, F.col("center.node"), F.col("node"))


def _coupled(signed: DataFrame, nodes: DataFrame, shift: int) -> DataFrame:
    """(key, node, class) with one key per band, made of it and the band ``shift`` places on: finer buckets."""
    rotated = F.expr(f"concat(slice(bands, {shift + 1}, {BANDS}), slice(bands, 1, {shift}))")
    keys = F.zip_with("bands", rotated, lambda x, y: F.xxhash64(x, y))
    return signed.join(nodes, "node").select("node", "class", F.explode(keys).alias("key"))


# both bands of a pair must be buckets of two classes or more
_TWO_BANDS = f"""
    transform(filter(sequence(0, {BANDS} * {BANDS} - 1), p -> p div {BANDS} < p % {BANDS}
          and array_contains(held, bands[cast(p div {BANDS} as int)]) and array_contains(held, bands[p % {BANDS}])),
      p -> xxhash64(bands[cast(p div {BANDS} as int)], bands[p % {BANDS}]))"""


def _outside(rows: DataFrame) -> DataFrame:
    """``rows`` (key, node, class) of buckets with two classes or more, with each bucket's ``largest`` class and how
    many members lie ``outside`` it."""
    # one exchange for both windows
    sized = rows.repartition("key").withColumn("_n", F.count("*").over(_bucket("class")))
    largest = F.max(F.struct("_n", "class")).over(_bucket())
    marked = sized.withColumns({"_largest": largest, "_all": F.count("*").over(_bucket())})
    outside = F.col("_all") - F.col("_largest._n")
    return marked.select(*rows.columns, F.col("_largest.class").alias("largest"), outside.alias("outside")).filter("outside > 0")


def _rest(mixed: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes that share small buckets of two mixed bands."""
    held = mixed.groupBy("node", "class").agg(F.collect_list("key").alias("held"))
    rows = held.join(signed.select("node", "bands"), "node").select("node", "class", F.explode(F.expr(_TWO_BANDS)).alias("key"))
    small = materialise(_outside(rows).filter(F.col("outside") <= FEW), "near_small")
    # members of a bucket's largest class are not matched with one another
    few = small.filter("class != largest")
    right = small.select("key", F.col("node").alias("other"), F.col("class").alias("other_class"))
    pairs = few.join(right, "key").filter("class != other_class and (other_class = largest or class < other_class)")
    return materialise(_pairs(pairs, F.col("node"), F.col("other")), "near_rest")


def _block_links(left: list[tuple], right: list[tuple], key: int, largest: int, known: _WordHashes) -> Iterator[tuple[int, int]]:
    """Links between members (node, class, signature, text) of a bucket: ``left`` outside its largest class."""
    nodes, classes = (np.array([m[k] for m in right], np.int64) for k in (0, 1))
    signs, mine = (np.frombuffer(b"".join(m[2] for m in side), np.uint16).reshape(-1, COORDINATES) for side in (right, left))
    keys, my_keys = bands(signs), bands(mine)
    band = int(np.flatnonzero(keys[0] == key)[0])
    regions = None
    for n, (node, own, _, text) in enumerate(left):
        # members outside the largest class meet twice
        fit = (classes != own) & ((classes == largest) | (classes > own))
        at = np.flatnonzero(fit)
        at = at[(signs[at] == mine[n]).sum(axis=1) >= LEAST_AGREEING]
        # a pair is tested in the first bucket that it shares
        at = at[(keys[at] == my_keys[n]).argmax(axis=1) == band]
        if not len(at):
            continue
        if regions is None:
            hashed, sizes = shingles([m[3] for m in right], known)
            regions, _ = _regions(hashed, sizes)
            starts = np.cumsum(sizes) - sizes
        here = np.sort(_regions(*shingles([text], known))[0])
        size = sizes[at]
        rows = np.repeat(starts[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        found = here[np.minimum(np.searchsorted(here, regions[rows]), len(here) - 1)] == regions[rows]
        shared = np.add.reduceat(found, np.cumsum(size) - size, dtype=np.int64)
        for k in at[shared * LEAST[1] >= (size + len(here) - shared) * LEAST[0]].tolist():
            yield node, int(nodes[k])


def _blocks(mixed: DataFrame, signed: DataFrame, fetched: DataFrame) -> DataFrame:
    """Links (a, b) between different classes in the written buckets ``mixed``, every pair compared; written."""
    small_batches(mixed.sparkSession)
    members = signed.select("node", "signature").join(fetched, "node")
    sizes = fetched.select("node", (F.octet_length("_text") + 2 * COORDINATES + 100).cast("long").alias("_bytes"))
    rows = _outside(mixed.join(sizes, "node"))
    few = F.col("class") != F.col("largest")
    whole = {"_all": F.sum("_bytes").over(_bucket()), "_few": F.sum(F.when(few, F.col("_bytes"))).over(_bucket())}
    blocks = {name: F.ceil(F.col(name) / BLOCK_BYTES) for name in whole}
    rows = materialise(rows.withColumns(whole).withColumns(blocks).drop("_bytes", "outside"), "near_dealt")

    def dealt(which: DataFrame, side: int) -> DataFrame:
        """Every member lies in one block of its side and meets all blocks of the other."""
        own, other = ("i", "j") if side == 0 else ("j", "i")
        count, others = ("_few", "_all") if side == 0 else ("_all", "_few")
        block = F.pmod(F.xxhash64("node"), F.col(count)).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias(other)
        return which.select("key", "node", "class", "largest", F.lit(side).alias("side"), block, every)

    both = dealt(rows.filter(few), 0).unionByName(dealt(rows, 1)).join(members, "node")
    place = ["key", "i", "j"]
    both = both.repartition(*place).sortWithinPartitions(*place, "side")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, largest, sides = _WordHashes(), None, None, ([], [])

        def done() -> pa.RecordBatch:
            found = list(_block_links(*sides, now[0], largest, known)) if sides[0] and sides[1] else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["key"], row["i"], row["j"])
                if here != now:
                    if now is not None:
                        yield done()
                    now, largest, sides = here, row["largest"], ([], [])
                sides[row["side"]].append((row["node"], row["class"], row["signature"], row["_text"]))
        if now is not None:
            yield done()

    found = both.select(*place, "largest", "side", "node", "class", "signature", "_text").mapInArrow(compare, "a long, b long")
    return materialise(found, "near_links")


def _pairs(joined: DataFrame, a: Column, b: Column) -> DataFrame:
    return joined.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _promising(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs whose signatures agree enough to reach the threshold."""

    @F.pandas_udf("int")
    def agreeing(left: pd.Series, right: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(map(bytes, s)), np.uint16).reshape(-1, COORDINATES) for s in (left, right))
        return pd.Series((x == y).sum(axis=1).astype(np.int32))

    left = signed.select(F.col("node").alias("a"), F.col("signature").alias("_x"))
    right = signed.select(F.col("node").alias("b"), F.col("signature").alias("_y"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(agreeing("_x", "_y") >= LEAST_AGREEING).select("a", "b")


def _texts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, _text) of the wanted (node, _content) rows; a bitmap marks them while the table is read. Written."""
    text = text_of(text_col)
    bitmap = materialise(bitmap_of(wanted, F.xxhash64("_content")), "near_bitmap")
    texts = docs.select(_content(text).alias("_content"), text.alias("_text"))
    marked = with_bit(texts, bitmap, F.xxhash64("_content"), "_wanted").filter("_wanted").drop("_wanted")
    one = marked.groupBy("_content").agg(F.any_value("_text").alias("_text"))
    return materialise(one.join(wanted, "_content").select("node", "_text"), "near_texts")


def _links(pairs: DataFrame, fetched: DataFrame) -> DataFrame:
    """The pairs whose texts are similar enough."""

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        known, counted, out = _WordHashes(), {}, []
        for a, b in zip(left, right, strict=True):
            for text in (a, b):
                if text not in counted:
                    if len(counted) >= 64:
                        counted = {a: counted[a]} if a in counted else {}
                    counted[text] = _counted(text, known)
            shared, joint = _overlap(counted[a], counted[b])
            out.append(shared * LEAST[1] >= joint * LEAST[0])
        return pd.Series(out, dtype=bool)

    left = fetched.select(F.col("node").alias("b"), F.col("_text").alias("_y"))
    right = fetched.select(F.col("node").alias("a"), F.col("_text").alias("_x"))
    return pairs.join(left, "b").join(right, "a").filter(linked("_x", "_y")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, class) for the nodes of written edges (a, b): the smallest node of each connected component.

    Labels fall to the smallest among the neighbours and then to the label of the label, until nothing moves.
    """
    both = materialise(edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "near_edges")
    labels = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("class"))
    labels = materialise(labels, "near_labels")
    while True:
        after = labels.select(F.col("node").alias("class"), F.col("class").alias("next"))
        jumped = labels.join(after, "class").select("node", F.col("class").alias("was"), F.col("next").alias("class"))
        near = both.join(jumped.select(F.col("node").alias("other"), "class"), "other")
        near = near.groupBy("node").agg(F.min("class").alias("low"))
        lower = jumped.join(near, "node").select("node", "was", F.least("class", "low").alias("class"))
        lower = materialise(lower, "near_labels")
        moved = lower.filter("was != class").limit(1).count()
        labels = lower.select("node", "class")
        if not moved:
            return labels


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (node, class) after the links (a, b) between nodes; written."""
    a = classes.select(F.col("node").alias("a"), F.col("class").alias("x"))
    b = classes.select(F.col("node").alias("b"), F.col("class").alias("y"))
    joint = links.join(a, "a").join(b, "b").select("x", "y").filter("x != y").distinct().toDF("a", "b")
    moved = components(materialise(joint, "near_joint")).toDF("class", "merged")
    return materialise(
        classes.join(moved, "class", "left").select("node", F.coalesce("merged", "class").alias("class")), "near_classes"
    )


def _classes(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """(node, class) for every node that shares a bucket."""
    signed = _signed(docs, text_col, nodes)
    members = _members(signed)
    company = materialise(members.groupBy("node").agg(F.sum("n").alias("company")), "near_company")
    classes = company.select("node", F.col("node").alias("class"))
    fetched = _texts(docs, text_col, materialise(nodes.select("node", "_content").join(classes.select("node"), "node"), "near_wanted"))
    tested = None

    def step(candidates: DataFrame) -> bool:
        """Test candidate pairs that were not tested yet; whether links were common enough for another round."""
        nonlocal classes, tested
        fresh = candidates if tested is None else candidates.join(tested, ["a", "b"], "left_anti")
        fresh = materialise(_promising(fresh, signed), "near_promising")
        links = materialise(_links(fresh, fetched), "near_links")
        tested = fresh if tested is None else tested.unionByName(fresh)
        found = links.count()
        if found:
            classes = _merged(classes, links)
        return 0 < fresh.count() <= found * WORTHWHILE

    # stars while they merge much, in finer buckets after the first round; what they leave is paired in small buckets
    # and then, in blocks, in all that still hold two classes
    first = members.join(company, "node").select("key", "node", F.col("node").alias("class"), "company")
    step(_stars(first, F.struct(-F.col("company"), F.col("node"))))
    members = members.select("key", "node")
    mixed = materialise(_mixed(members.join(classes, "node")), "near_mixed_rows")
    for shift in range(1, BANDS // 2):
        active = mixed.select("node", "class").distinct()
        again = step(_stars(_coupled(signed, active, shift), F.xxhash64("node", F.lit(shift))))
        mixed = materialise(_mixed(mixed.select("key", "node").join(classes, "node")), "near_mixed_rows")
        if not again:
            break
    step(_rest(mixed, signed))
    mixed = materialise(_mixed(mixed.select("key", "node").join(classes, "node")), "near_mixed_rows")
    links = _blocks(mixed, signed, fetched)
    return classes if links.isEmpty() else _merged(classes, links)


def _decided(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Per content: class, size, and the id and number of the row that stays; written."""
    nodes = _nodes(rows)
    labelled = nodes.join(_classes(docs, text_col, nodes), "node", "left")
    labelled = materialise(labelled.select("_content", "_n", "_first", F.coalesce("class", "node").alias("class")), "near_labelled")
    groups = labelled.groupBy("class").agg(F.sum("_n").alias("class_size"), F.min("_first").alias("_stays"))
    groups = materialise(groups, "near_groups")
    return materialise(
        labelled.join(groups, "class").select(
            "_content", "class_size", F.col("_stays._id").alias("_class_id"), F.col("_stays._row").alias("_class_row")
        ),
        "near_decided",
    )


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, class_id (smallest id of the class), class_size, kept."""
    rows = _rows(docs, id_col, text_col)
    return rows.join(_decided(rows, docs, text_col), "_content").select(
        F.col("_id").alias(id_col), F.col("_class_id").alias("class_id"), "class_size", (F.col("_row") == F.col("_class_row")).alias("kept")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row per class, that of the smallest id.

    Rows of classes of one pass straight through; the others are written out, numbered, and joined by number.
    """
    rows = _rows(docs, id_col, text_col)
    decided = _decided(rows, docs, text_col).filter("class_size > 1")
    bitmap = materialise(bitmap_of(decided, F.xxhash64("_content")), "near_class_bitmap")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    keyed = docs.select(row, F.col(id_col).alias("_id"), _content(text_of(text_col)).alias("_content"))
    marked = with_bit(keyed, bitmap, F.xxhash64("_content"), "_shared")
    suspects = materialise(marked.filter("_shared").select("*", F.monotonically_increasing_id().alias("_place")), "near_suspects")
    # the number of the written table decides among rows with equal id and content
    placed = suspects.select("_id", "_content", "_place").join(decided, "_content")
    placed = materialise(placed.select("_id", "_place", "_class_row"), "near_placed")
    first = F.min(F.struct(F.col("_id").isNull().alias("last"), F.col("_id"), F.col("_place"))).alias("_first")
    winners = materialise(
        placed.groupBy("_class_row").agg(first).select("_class_row", F.col("_first._place").alias("_winner")), "near_winners"
    )
    losers = placed.join(winners, "_class_row").filter("_place != _winner").select("_place")
    kept = suspects.join(losers, "_place", "left_anti").select("_doc.*")
    return marked.filter("not _shared").select("_doc.*").unionByName(kept)
