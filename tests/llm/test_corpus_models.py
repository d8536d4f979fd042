"""Phrases, context tree and spelling variants against brute force; SQL statements of the subpackage against DuckDB."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.llm import context_tree, phrases, queries, variants

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n long, phrase string, word string, shard string"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    expected = [tuple(row[columns.index(c)] for c in order) for row in result.fetchall()]
    assert sorted(str(tuple(r)) for r in df.select(*order).collect()) == sorted(map(str, expected))


@pytest.fixture(scope="module")
def texts():
    """Nulls, blanks, repeated rows, a text without separators longer than a shard, ties, upper case, other scripts."""
    rng = random.Random(7)
    words = ["the", "of", "and", "Brücke", "ÉCOLE", "x1", "ба"]
    rows = [(1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, "a, b; c!", "en"), (None, "the of the of the", "en")]
    rows += [(5, "The Of the", None)] * 2
    rows += [(10 + i, "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "\r\n", " "]) for _ in range(40)), rng.choice(["en", "de", None])) for i in range(30)]
    rows += [(100, " ".join(rng.choices(words, k=700)), "de"), (101, "the " * 300, "en")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, lang, "s", 1, "p", "w", "h") for i, t, lang in texts], DOCS).repartition(3).cache()


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted_phrases(texts) -> tuple[Counter, Counter]:
    counts, totals = Counter(), Counter()
    for _, text, lang in texts:
        lang = "und" if lang is None else lang
        text = ascii_lower(text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    return counts, totals


@pytest.mark.parametrize("size", [16, 100, 1 << 19])
def test_phrases_match_brute_force(docs, texts, size):
    """Small shards cut the long pieces many times; the counts stay."""
    counts, totals = counted_phrases(texts)
    frequent = {k: v for k, v in counts.items() if v >= 5}
    found, sums = phrases.frequent_phrases(docs, least=5, size=size)
    assert {(r.lang, tuple(r.phrase.split(" "))): r["count"] for r in found.collect()} == frequent
    assert {r.lang: r.n for r in sums.collect()} == totals
    rows = []
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        cuts = [(2_000_000 * a // (frequent[lang, words[:k]] + frequent[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = any(
            100 * c >= 80 * a and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
            for (other, longer), c in frequent.items()
            if other == lang and len(longer) > len(words)
        )
        if not inside:
            rows.append((lang, -score, -a, " ".join(words).encode(), frequent[lang, words[:k]], frequent[lang, words[k:]]))
    expected = []
    for lang in totals:
        ranked = sorted(r for r in rows if r[0] == lang)[:40]
        expected += [(lang, k + 1, r[3].decode(), -r[2], r[4], r[5], totals[lang], -r[1]) for k, r in enumerate(ranked)]
    assert sorted(map(tuple, phrases.collocations(found, sums, top=40).collect())) == sorted(expected)


def test_rare_pairs_are_ruled_out_by_their_hashes(spark):
    """Every frequent pair passes the sums by hash, few of the others are spelled and shuffled."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=500)) + " . " + "to be or not " * 9, "en") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counts = Counter({k[1]: v for k, v in counted_phrases(rows)[0].items()})
    indexed = phrases.shards(docs, size=700)
    words = phrases.counted_words(indexed).filter("count >= 5")
    filters = [phrases.filter_of(words.selectExpr("xxhash64(lang, phrase) as hash"))]
    for length in (2, 3):
        hashes = phrases.frequent_hashes(indexed, 16, length, filters, 5)
        frequent = sum(len(k) == length and v >= 5 for k, v in counts.items())
        assert frequent > 0 and hashes.filter("hash < 0 or hash >= 4294967296").count() == 0
        assert hashes.count() <= frequent  # fewer if two phrases share a hash
        filters.append(phrases.filter_of(hashes))
    found = {tuple(r.phrase.split(" ")): r["count"] for r in phrases.counted_phrases(indexed, filters).collect()}
    assert all(counts[k] == v for k, v in found.items())
    assert {k for k, v in counts.items() if v >= 5 and len(k) > 1} <= found.keys()
    assert sum(len(k) == 2 for k in found) < sum(len(k) == 2 for k in counts) / 4


def test_score_arithmetic_is_wide(spark):
    big = 10**14
    rows = [("en", "a b", 2, big), ("en", "a", 1, 3 * big), ("en", "b", 1, big + 1)]
    found = spark.createDataFrame(rows, "lang string, phrase string, words int, count long")
    row = phrases.collocations(found, spark.createDataFrame([("en", 9 * big)], "lang string, n long")).first()
    assert (row.score, row.l, row.r) == (2_000_000 * big // (4 * big + 1), 3 * big, big + 1)


def test_intervals_extend_both_ways():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(0, 5, 400), 0).astype(np.int32)
    forward, backward = phrases.Index(phrases.transform(text)), phrases.Index(phrases.transform(np.append(text[-2::-1], 0).astype(np.int32)))
    for sides in ([True, False, True], [False, False, True], [False, True, False], [True, True, True]):
        found = phrases.words_of_index(forward)
        for left in sides:
            found = phrases.extended(found, forward, backward, left)
            size = found.ids.shape[1]
            expected = Counter(tuple(text[i : i + size].tolist()) for i in range(len(text) - size + 1))
            expected = {k: v for k, v in expected.items() if 0 not in k}
            assert dict(zip(map(tuple, found.ids.tolist()), found.count.tolist(), strict=True)) == expected


class Tree:
    """Context-tree weighting, node by node."""

    def __init__(self, words: dict[bytes, int], depth: int):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for word, n in words.items():
            for context, byte in self.coded(word):
                for level in range(depth + 1):
                    for choice in range(8):
                        self.counts[self.node(context, byte, level, choice)][byte >> (7 - choice) & 1] += n
        self.children = defaultdict(set)
        for context, made in list(self.counts):
            if context:
                self.children[context[1:], made].add((context, made))
        self.weights: dict = {}

    def coded(self, word: bytes):
        text = b" " * self.depth + word + (b"" if word == b"\n" else b" ")
        return [(text[i - self.depth : i], text[i]) for i in range(self.depth, len(text))]

    def node(self, context: bytes, byte: int, level: int, choice: int):
        return context[self.depth - level :], 1 << choice | byte >> (8 - choice)

    def kt(self, node) -> float:
        a, b = self.counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node) -> float:
        if node not in self.weights:
            if len(node[0]) == self.depth:
                self.weights[node] = self.kt(node)
            else:
                mixed = [self.kt(node), sum(self.weighted(c) for c in self.children[node])]
                self.weights[node] = math.log(0.5) + max(mixed) + math.log1p(math.exp(min(mixed) - max(mixed)))
        return self.weights[node]

    def score(self, word: bytes) -> float:
        total = 0.0
        for context, byte in self.coded(word):
            for choice in range(8):
                bit, likely, left = byte >> (7 - choice) & 1, 0.0, 1.0
                for level in range(self.depth + 1):
                    node = self.node(context, byte, level, choice)
                    counts = self.counts.get(node, (0, 0))
                    own = 1.0 if level == self.depth else math.exp(math.log(0.5) + self.kt(node) - self.weighted(node))
                    likely += left * own * (counts[bit] + 0.5) / (sum(counts) + 1)
                    left *= 1 - own
                total += math.log10(likely)
        return total


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), b"\n"]


@pytest.mark.parametrize("depth, size", [(3, 1 << 21), (2, 64)])
def test_context_tree_matches_brute_force(docs, texts, depth, size):
    """Small shards cut the long texts; the sums stay."""
    trained = lambda key: key is not None and key % 3 != 1
    counts = Counter(w for key, text, _ in texts if trained(key) for w in tokens_of(text))
    tokens, tree = sum(counts.values()), Tree(counts, depth)
    expected = []
    for key, text, _ in texts:
        words = tokens_of(text)
        base = sum(math.log10((counts[w] + 1) / (tokens + len(counts) + 1)) for w in words)
        score = sum(tree.score(w) for w in words)
        expected.append((str(key), trained(key), len(words), sum(counts[w] > 0 for w in words), tokens, base, score))
    found = context_tree.score(docs, F.col("doc_id") % 3 != 1, depth=depth, size=size).collect()
    got = [(str(r.doc_id), r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found]
    assert len(got) == len(expected)
    for mine, theirs in zip(sorted(got), sorted(expected), strict=True):
        assert mine[:5] == theirs[:5] and mine[5:] == pytest.approx(theirs[5:], rel=1e-9)


class TextTree(Tree):
    """The same over whole texts, each with its end."""

    def coded(self, word: bytes):
        text = b" " * self.depth + word
        return [(text[i - self.depth : i], text[i]) for i in range(self.depth, len(text))]


@pytest.mark.parametrize("depth, size", [(3, 1 << 21), (context_tree.DEPTH, 64)])
def test_contexts_go_on_across_words(docs, texts, depth, size):
    """Also where shards cut a text."""
    trained = lambda key: key is not None and key % 3 != 1
    spelled = [b" ".join(tokens_of(text)) for _, text, _ in texts]
    tree = TextTree(Counter(t for t, (key, _, _) in zip(spelled, texts, strict=True) if trained(key)), depth)
    expected = sorted((str(key), len(t), tree.score(t)) for t, (key, _, _) in zip(spelled, texts, strict=True))
    found = context_tree.score(docs, F.col("doc_id") % 3 != 1, depth=depth, size=size, across=True).collect()
    got = sorted((str(r.doc_id), round(-r.score * math.log2(10) / r.bits_per_byte), r.score) for r in found)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected], rel=1e-9)


def test_order_of_words_matters_to_op12(spark, tmp_path):
    """The same words in the order of the training texts are likelier than in another."""
    rows = [(i, "red fish blue bird " * 5) for i in range(40)] + [(100, "red fish blue bird"), (101, "fish red bird blue")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    scores = {r.doc_id: r.score for r in queries.QUERIES["op12_context_tree"](spark, str(tmp_path)).collect()}
    assert scores[100] > scores[101] + 1


def test_subtrees_agree_at_every_level(spark):
    rng = random.Random(5)
    vocabulary = [bytes(rng.choices(b"abc", k=rng.randint(1, 9))) for _ in range(200)]
    grams = Counter()
    for word in set(vocabulary):
        for gram in context_tree.grams_of([word])[0].tolist():
            grams[gram] += rng.randint(0, 3)
    table = spark.createDataFrame(list(grams.items()), "gram long, n long").cache()
    results = [
        {r.gram: r.score for r in context_tree.byte_scores(table, top=top).collect()} for top in (1, 3, context_tree.DEPTH)
    ]
    assert set(results[0]) == set(grams)
    for other in results[1:]:
        assert all(other[g] == pytest.approx(results[0][g], rel=1e-9) for g in grams)


def test_numbers_survive_packing():
    numbers = np.array([0, 5, 2**31 - 1, 3, 3, 0], np.int32)
    assert (context_tree.unpacked(context_tree.packed(numbers), len(numbers)) == numbers).all()
    assert len(context_tree.unpacked(context_tree.packed(numbers[:0]), 0)) == 0


def grouped(counts: dict[str, int]) -> dict[str, tuple]:
    near = defaultdict(set)
    by_gap = defaultdict(set)
    for word in counts:
        for i in range(len(word)):
            by_gap[word[:i], word[i + 1 :]].add(word)
    for word in counts:
        for i in range(len(word)):
            near[word] |= by_gap[word[:i], word[i + 1 :]]
            shorter = word[:i] + word[i + 1 :]
            if shorter in counts:
                near[word].add(shorter)
                near[shorter].add(word)
        near[word].discard(word)
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= 10 * n else None
    rows = {}
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        rows[word] = (form[word], root, n, len(near[word]), counts[form[word]] if form[word] is not None else None)
    return rows


def test_variants_match_brute_force(spark):
    """Runs of equal letters, chains of forms, ties, other scripts, and words beyond the shallow and the long nodes."""
    rng = random.Random(11)
    words = {"".join(rng.choices("ab", k=rng.randint(1, 7))) for _ in range(150)}
    words |= {"".join(rng.choices("abé", k=12)) + "stem" for _ in range(60)} | {"λόγος", "λόγoς", "λόγο", "日本語", "日本"}
    long = "".join(rng.choices("xy", k=90))
    words |= {long, long[:50] + long[51:], long[:70] + "z" + long[71:], "", "z"}
    counts = {w: rng.choice([1, 2, 9, 20, 300, 4000, 50_000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n int").repartition(3)
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(df).collect()}
    assert found == grouped(counts)
    assert any(v[0] != v[1] for v in found.values() if v[0])  # a chain is among them


def test_words_of_texts(spark):
    texts = [(1, "Überfluss straßen ABCDEFGH abcdefgh short"), (2, None), (None, "abcdefgh, abcdefg1abcdefgh"), (2, "x" * 5000)] + [
        (i, "Spelling×VARIANTS spelling×variants") for i in range(40)
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    expected = Counter()
    for key, text in texts:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += ascii_lower(c)
                continue
            code = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if run and code % 31 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            if len(run) >= 7:
                expected[run] += 1
            run = ""
    found = {r.word: r.n for r in variants.counted_words(df, misspell=True).collect()}
    assert found == {w: n for w, n in expected.items() if n >= 2}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert phrases.collocations(*phrases.frequent_phrases(empty)).count() == 0
    assert context_tree.score(empty, F.lit(True)).count() == 0
    assert variants.variants(variants.counted_words(empty)).count() == 0
    untrained = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = context_tree.score(untrained, F.lit(None).cast("boolean")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert row.score == pytest.approx(-40 * math.log10(2))
