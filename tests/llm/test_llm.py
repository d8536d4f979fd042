"""Training-data operators on small tables: brute force, round trips and edge cases."""

from __future__ import annotations

import array
import gzip
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stallwise.llm import (
    bpe,
    chat_format,
    exact_dedup,
    near_dedup,
    packing,
    pii,
    quality,
    queries,
    secret_scan,
    toxicity,
    warc,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, node long, _id string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed: int, words: int = 80) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and blank texts, copies, repeated rows, a long text, clashing column names."""
    near = prose(1).split()
    near[40] = "changed"
    texts = [
        (1, prose(1)),
        (2, prose(1).replace(" ", "\t\n", 1)),
        (2, prose(1).replace(" ", "\t\n", 1)),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \n "),
        (None, prose(2)),
        (7, prose(2)),
        (8, "word " * 30_000),
        (9, "tiny text"),
        (10, prose(3)),
    ]
    rows = [(i, t, "en" if n % 2 else None, None if n == 3 else "s", len(t or ""), "x", 5, "y") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).coalesce(2)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_exact_groups(docs, empty):
    rows = exact_dedup.exact_groups(docs, digests=True).collect()
    assert len(rows) == 12 and exact_dedup.exact_groups(empty).count() == 0
    by_hash = {}
    for r in rows:
        by_hash.setdefault(r.text_sha256, []).append(r)
    assert len(by_hash[sha(prose(1))]) == 3 and {r.keep_id for r in by_hash[sha(prose(1))]} == {1}
    assert all(sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {len(group)} for group in by_hash.values())
    assert {r.keep_id for r in by_hash[sha(prose(2))]} == {7}  # a null id comes last
    assert len(by_hash[sha("")]) == 2 and len(by_hash[sha(" ")]) == 1


def test_keep_first(docs, empty):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and exact_dedup.keep_first(empty).count() == 0
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7, 8, 9, 10]
    twice = docs.filter("doc_id = 2")
    assert exact_dedup.keep_first(twice).count() == 1  # repeated rows: one stays


def test_chat_round_trip(spark):
    hard = r"\### Assistant: </turn> ok \\b \h ####" + "\n</turn></turn>\n#"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 1, "assistant", hard), (2, 0, "a: b", None), (None, None, None, "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    texts = chat_format.formatted(chat_format.turns(table))
    back = {r.conv_id: r for r in chat_format.parsed(texts).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", hard)] + [("assistant", hard)] * 2
    assert back[1].trained == ["", hard, hard] and back[2].turns[0].role == "a: b" and back[None].turns[0].text == ""
    masks = {r.conv_id: sum(m.skip + m.take + m.rest for m in r.loss_mask) - len(r.formatted) for r in texts.collect()}
    assert set(masks.values()) == {0}
    assert chat_format.parsed(chat_format.formatted(chat_format.turns(table.limit(0)))).count() == 0


def test_chat_layouts(spark):
    table = spark.sql("SELECT 1L conv_id, 'q' AS instruction, '' AS input, 'a' AS output, 7 AS messages")
    assert [(r.pos, r.role, r.text) for r in chat_format.turns(table).orderBy("pos").collect()] == [
        (0, "user", "q"),
        (1, "assistant", "a"),
    ]
    speakers = spark.sql("SELECT 1L conv_id, array(named_struct('from', 'human', 'value', 'q')) AS conversations")
    assert chat_format.turns(speakers).first().role == "user"
    with pytest.raises(ValueError, match="no layout"):
        chat_format.turns(spark.range(1).toDF("conv_id"))
    records = spark.createDataFrame(
        [(1, '{"prompt": "p", "response": "r"}'), (2, '{"messages": [{"role": "user", "content": "c"}]}'), (3, "{}"), (4, None)],
        "i long, j string",
    )
    found = {r.i: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat_format.json_turns(records, "i", "j").collect()}
    assert found[1] == ("prompt_response", [("user", "p"), ("assistant", "r")])
    assert found[2] == ("messages", [("user", "c")]) and found[3] == found[4] == (None, [])


def test_chat_layout_is_chosen_per_row(spark):
    fields = "conv_id long, messages array<struct<role:string,content:string>>, prompt string, response string"
    rows = [(1, [("user", "q"), ("assistant", "a")], None, None), (2, None, "p", "r"), (3, [], "p", None), (4, None, None, None)]
    table = spark.createDataFrame(rows, fields)
    found = [tuple(r) for r in chat_format.turns(table).orderBy("conv_id", "pos").collect()]
    assert found[:6] == [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "p"), (2, 1, "assistant", "r")] + [
        (3, 0, "user", "p"),
        (3, 1, "assistant", ""),
    ]
    both = spark.createDataFrame([(1, [("user", "q")], "p", "r")], fields)
    with pytest.raises(Exception, match="no layout reads all"):
        chat_format.turns(both).collect()
    asked = spark.createDataFrame([(1, "i", "o", "s"), (2, "i", "o", None)], "conv_id long, instruction string, output string, system string")
    assert [r.text for r in chat_format.turns(asked).orderBy("conv_id", "pos").collect()] == ["s", "i", "o", "i", "o"]
    stored = spark.createDataFrame([(1, 4, "user", "t", None, None), (2, None, None, None, "p", "c")], "conv_id long, turn long, role string, text string, prompt string, completion string")
    assert [tuple(r) for r in chat_format.turns(stored).orderBy("conv_id", "pos").collect()] == [
        (1, 4, "user", "t"),
        (2, 0, "user", "p"),
        (2, 1, "assistant", "c"),
    ]


def test_chat_json_with_unknown_and_null_fields(spark):
    texts = [
        '{"prompt": "p", "response": "r", "id": 7, "messages": null}',
        '{"instruction": "i", "input": null, "output": "o"}',
        '{"instruction": "i", "output": "o", "system": "s"}',
        '{"id": "x", "conversations": [{"from": "human", "value": "q", "weight": 1}, {"from": "gpt", "value": null}]}',
        '{"prompt": "p", "response": "r", "messages": [{"role": "user", "content": "lost"}]}',
        '{"messages": [{"role": "user", "content": [{"type": "text"}]}]}',
        '{"messages": [{"from": "human", "value": "q"}]}',
        '{"prompt": "p", "response": "r", "completion": "c"}',
        "not json",
    ]
    records = spark.createDataFrame(list(enumerate(texts)), "i long, j string")
    found = {r.i: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat_format.json_turns(records, "i", "j").collect()}
    assert found[0] == ("prompt_response", [("user", "p"), ("assistant", "r")])
    assert found[1] == ("instruction", [("user", "i"), ("assistant", "o")])
    assert found[2] == ("instruction_system", [("system", "s"), ("user", "i"), ("assistant", "o")])
    assert found[3] == ("speakers", [("user", "q"), ("assistant", "")])
    assert all(found[n] == (None, []) for n in range(4, 9))


def test_best_fit_takes_the_tightest_compatible_bin():
    placed = packing.best_fit([9, 7, 6, 3, 1], ["a", "b", "c", "b", "b"], [1, 2, 3, 4, 2], 10)
    # 3 would fit the bin of 7 best, but that holds its source; 1 shares source and cluster with 7 and source with 3
    assert [b for b, _ in placed] == [0, 1, 2, 2, 0]
    assert packing.best_fit([5, 5], ["a", "a"], [1, 1], 10, by_source=False) == [(0, 0), (1, 0)]


def test_packing(docs, empty):
    rows = packing.pack(docs, capacity=100, shard_rows=50).collect()
    assert packing.pack(empty).count() == 0
    used = {}
    for r in rows:
        used.setdefault(r.bin_id, []).append((r.bin_offset, r.n_words))
    for parts in used.values():
        parts.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] <= 100
    words = {}
    for r in rows:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
    assert words == {1: 80, 2: 160, 3: 80, 4: 0, 5: 0, 6: 0, None: 80, 7: 80, 8: 30_000, 9: 2, 10: 80}


@pytest.mark.parametrize("given", [True, False])
def test_packed_bins_hold_no_conflict(spark, given):
    rng = random.Random(8)
    rows = []
    for n in range(300):
        text = prose(rng.randrange(40), 20)
        near = rng.randrange(60)
        rows.append((n, text + (f" end{n}" if given else ""), f"s{rng.randrange(30)}", near if n % 9 else None))
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, near long")
    packed = packing.pack(table, capacity=100, shard_rows=100, cluster_col="near" if given else None).collect()
    assert len(packed) == 300
    of = {n: (source, near if given and near is not None else text) for n, text, source, near in rows}
    for a in packed:
        for b in packed:
            if a.doc_id < b.doc_id and a.bin_id == b.bin_id:
                assert of[a.doc_id][0] != of[b.doc_id][0] and of[a.doc_id][1] != of[b.doc_id][1]


def test_best_fit_against_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        capacity = rng.choice([5, 20, 60])
        n = rng.randrange(40)
        lengths = sorted((rng.randint(0, capacity) for _ in range(n)), reverse=True)
        sources = [rng.choice("abcdef") for _ in range(n)]
        clusters = [rng.randrange(25) for _ in range(n)]
        by_source = rng.random() < 0.7
        bins: list[list[int]] = []
        expected = []
        for k, length in enumerate(lengths):

            def fits(held: list[int], k: int = k) -> bool:
                clash = [j for j in held if lengths[j] and (by_source and sources[j] == sources[k] or clusters[j] == clusters[k])]
                return sum(lengths[j] for j in held) + lengths[k] <= capacity and not (lengths[k] and clash)

            free = [(capacity - sum(lengths[j] for j in held), b) for b, held in enumerate(bins) if fits(held)]
            at = min(free)[1] if free else len(bins)
            if not free:
                bins.append([])
            expected.append((at, sum(lengths[j] for j in bins[at])))
            bins[at].append(k)
        assert packing.best_fit(lengths, sources, clusters, capacity, by_source) == expected
    assert packing.best_fit([0] * 6, list("abcdef"), [1] * 6, 10) == [(0, 0)] * 6


def test_near_classes(docs, empty):
    found = near_dedup.near_classes(docs).collect()
    assert near_dedup.near_classes(empty).count() == 0
    classes = {}
    for r in found:
        classes.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(classes[1]) == [1, 2, 2, 3] and sorted(classes[4]) == [4, 5, 6] and len(classes[7]) == 2
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 7, 8, 9, 10] and near_dedup.keep_one(empty).count() == 0


def brute_classes(rows: list[tuple[int, str]]) -> dict[int, int]:
    """Smallest id of each text's component, all pairs compared."""
    counted = {i: near_dedup._counted(text) for i, text in rows}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, _ in rows:
        for j, _ in rows:
            if i < j:
                shared, joint = near_dedup._overlap(counted[i], counted[j])
                if 5 * shared >= 4 * joint:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in rows}


def test_near_components_match_brute_force(spark):
    """A chain of drifting copies: the ends are not similar, the class holds all."""
    rng = random.Random(5)
    words, chain = prose(9, 120).split(), []
    for n in range(60):
        chain.append((n, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(120)] = f"w{n}{rng.random():.6f}"
    rows = chain + [(100 + n, prose(50 + n)) for n in range(40)]
    found = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == brute_classes(rows)


def drifted(count: int, least: int, most: int, seed: int) -> list[tuple[int, str]]:
    """Copies of one text of 150 words, each with ``least`` to ``most`` of its words changed."""
    rng = random.Random(seed)
    base, rows = prose(21, 150).split(), []
    for n in range(count):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(least, most)):
            words[at] = f"w{n}x{at}"
        rows.append((n, " ".join(words)))
    return rows


def test_near_copies_of_a_missing_text_match_brute_force(spark):
    """The text that all were copied from is not there; many copies are linked, many are not."""
    rows = drifted(300, 0, 9, 4)[1:]
    found = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    expected = brute_classes(rows)
    assert 20 < len(set(expected.values())) < 280
    assert {r.doc_id: r.class_id for r in found} == expected


def test_links_inside_large_buckets_are_all_found(spark, monkeypatch):
    """What stars leave is compared in blocks of any number, whatever the size of a bucket."""
    blocks, found = near_dedup._blocks, []

    def counted(*tables):
        links = blocks(*tables)
        found.append(links.count())
        return links

    monkeypatch.setattr(near_dedup, "_blocks", counted)
    monkeypatch.setattr(near_dedup, "_rest", lambda mixed, signed: mixed.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    monkeypatch.setattr(near_dedup, "WORTHWHILE", 0)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 20_000)
    rows = drifted(300, 1, 9, 4)
    classes = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.class_id for r in classes} == brute_classes(rows) and found[0] > 0


def test_pairs_of_unlinked_copies_grow_with_the_texts(spark, monkeypatch):
    """Copies that are near one another but below the threshold: twice the texts, not four times the pairs."""
    rest, made = near_dedup._rest, []

    def counted(mixed, signed):
        pairs = rest(mixed, signed)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dedup, "_rest", counted)
    for count in (400, 800):
        rows = drifted(count, 8, 10, 6)
        found = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert found.select("class_id").distinct().count() == count
    assert made[1] < 3 * made[0] and made[1] < 800 * 799 / 2 / 10, made


def test_signatures_estimate_similarity():
    base = prose(3, 400).split()
    other = base[:360] + prose(4, 40).split()
    a, b = " ".join(base), " ".join(other)
    signed = near_dedup.signatures(*near_dedup.shingles([a, b, a, "", "one"], near_dedup._WordHashes()))
    alone = near_dedup.signatures(*near_dedup.shingles([a], near_dedup._WordHashes()))
    shared, joint = near_dedup.similar(a, b)
    assert (signed[0] == signed[2]).all() and (signed[0] == alone[0]).all()
    assert abs((signed[0] == signed[1]).mean() - shared / joint) < 0.12


def brute_pii(text: str) -> list[tuple]:
    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        odd = sum(d * 2 - 9 * (d > 4) for d in digits[-2::-2])
        if 14 <= len(digits) <= 19 and (odd + sum(digits[::-2])) % 10 == 0:
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return sorted(found)


def test_base_identifiers_match_the_patterns():
    rng = random.Random(2)
    pieces = list("a1.@+- ()") + ["4111 1111 1111 1111", "x@y.z", "1.2.3.4", "+1 (234) 567-8901", "256", "é", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        found = [(s.start, pii.KINDS.index(s.kind), s.end, s.kind) for s in pii.base_spans(text)]
        assert found == brute_pii(text), text


@pytest.mark.parametrize(
    ("text", "part", "kind"),
    [
        ("mail jo [at] host [dot] org now", "jo [at] host [dot] org", "email"),
        ("mail jo at host dot org now", "jo at host dot org", "email"),
        ("mail jо@host.org now", "jо@host.org", "email"),
        ("call plus one two three four five six seven eight nine zero one please", "plus one two three four five six seven eight nine zero one", "phone"),
        ("ip １９２.168.0.1 up", "１９２.168.0.1", "ip"),
        ("card 4111 1111​ 1111 1111 ok", "4111 1111​ 1111 1111", "card"),
        ("ip 192 dot 168 dot 0 dot 1 up", "192 dot 168 dot 0 dot 1", "ip"),
        ("ip one nine two dot one six eight dot zero dot one up", "one nine two dot one six eight dot zero dot one", "ip"),
        ("ip 192 dot 168 [dot] zero dot １ up", "192 dot 168 [dot] zero dot １", "ip"),
        ("call plus one (five five five) one two three four five six seven now", "plus one (five five five) one two three four five six seven", "phone"),
        ("call +1 555 one two three 4567 now", "+1 555 one two three 4567", "phone"),
        ("call plus 44 20 7946 0958 now", "plus 44 20 7946 0958", "phone"),
        ("call plus 44 oh two oh 7946 0958 now", "plus 44 oh two oh 7946 0958", "phone"),
        ("mail jo at hоst dot com now", "jo at hоst dot com", "email"),
        ("mail jo аt host dоt cоm now", "jo аt host dоt cоm", "email"),
        ("mail jo a​t host dot com now", "jo a​t host dot com", "email"),
        ("call рlus оne twо three four five six seven eight nine zero now", "рlus оne twо three four five six seven eight nine zero", "phone"),
        ("card 4111 1111​ 1111 1111 one of two", "4111 1111​ 1111 1111", "card"),
        ("card 4111 1111 1111 one one one one ok", "4111 1111 1111 one one one one", "card"),
    ],
)
def test_disguises_map_back_to_the_source(text, part, kind):
    spans = pii.all_spans(text)[1]
    assert (kind, part) in [(s.kind, text[s.start : s.end]) for s in spans]
    assert part not in pii.masked(text)


def test_pii_edges(spark, docs, empty):
    assert pii.all_spans("the cat sat at the dot of noon, one two") == ([], [])
    assert pii.all_spans("one dot two plus three is 4 plus five, seven at one dot, oh no") == ([], [])
    assert len(pii.base_spans("a" * 200_000 + "@")) == 0 and pii.masked("1" * 100_000) == "1" * 100_000
    rows = pii.find(docs).collect()
    assert len(rows) == 12 and pii.find(empty).count() == 0 and all(r.spans == "" for r in rows)
    table = spark.createDataFrame([(1, "to a@b.co x", 3), (2, None, 9)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(table).orderBy("doc_id").collect()] == [(1, "to <EMAIL> x", 12), (2, None, 9)]


def brute_quality(text: str) -> tuple:
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = ["", " ", "a", "a b", "a b a", "a a a a a a"]
    texts += ["".join(rng.choices(["a", "b", "é#", " ", " ", "\n", "\t", "<c>"], k=rng.randint(1, 60))) for _ in range(300)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = quality.with_counts(table, "text", F.col("doc_id")).collect()
    for r in counted:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id])


def test_quality_rejects_the_outliers(spark, docs, empty):
    good = [(n, prose(n, 120), "en", "s") for n in range(300)]
    bad = [(1000 + n, prose(n, 120).replace(" ", "### "), "en", "s") for n in range(20)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.judged(table).filter("kept").collect()}
    assert kept == set(range(300))
    assert {r.doc_id for r in quality.keep_good(table).collect()} == kept
    rows = {(r.doc_id, r.n_words): r for r in quality.judged(docs).collect()}
    assert rows[(8, 30_000)].base_failed and rows[(4, 0)].base_failed and quality.judged(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_verdicts_do_not_jump_with_the_size_of_a_group(spark):
    """A source of its own style beside 600 other texts: one text more changes at most one other verdict."""
    rows = [(n, prose(n, 120), "en", "s") for n in range(600)]
    own = [(1000 + n, prose(700 + n, 120).replace(" the ", " THE; ").upper(), "en", "t") for n in range(101)]
    kept = []
    for size in (99, 100, 101):
        table = spark.createDataFrame(rows + own[:size], "doc_id long, text string, lang string, source string")
        kept.append({r.doc_id for r in quality.judged(table).filter("kept and doc_id < 1099").collect()})
    assert len(kept[0] ^ kept[1]) <= 2 and len(kept[1] ^ kept[2]) <= 2  # the text that came, and one other


def brute_mcd(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of one group, as ``quality._estimates`` documents them."""
    tolerance = np.diag([t * t for _, t in quality.STATISTICS])

    def rank(v, share):
        return np.sort(v, axis=0)[max(int(np.ceil(share * len(v))) - 1, 0)]

    def moments(v, factor):
        return v.mean(axis=0), factor * np.cov(v.T, bias=True) + tolerance

    spread = (rank(x, 0.75) - rank(x, 0.25)) / 1.349
    best = None
    for m, c in ((rank(x, 0.5), np.diag(spread**2) + tolerance), moments(x, 1.0)):
        for _ in range(quality.STEPS):
            distance = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
            m, c = moments(x[distance <= rank(distance, quality.CORE) + 1e-9], quality.consistency(quality.CORE))
        if best is None or np.linalg.det(c) < np.linalg.det(best[1]):
            best = m, c
    return best


def test_quality_distances_match_brute_force(spark):
    rng = random.Random(12)

    def noisy(n):
        words = prose(n, 100 + n % 37).split()
        for at in rng.sample(range(100), rng.randint(0, 12)):
            words[at] = rng.choice(["#", "A&B", "YES!", "x,y;z", "(word)", "of"])
        return " ".join(words)

    rows = [(n, noisy(n), "en", "stu"[0 if n < 150 else 1 if n < 200 else 2]) for n in range(207)]
    counts = quality.with_counts(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"),
        "text",
        *[quality.F.col("doc_id"), *quality._group_columns("lang", "source")],
    )
    given = quality._transformed(counts).orderBy("doc_id").collect()
    x = np.array([[r[name] for name in quality.X] for r in given])
    group = np.array([r._source for r in given])
    assert not any(r.base_failed for r in given)
    m_all, c_all = brute_mcd(x)
    expected = np.zeros(len(x))
    for name in "stu":
        mine = x[group == name]
        m, c = brute_mcd(mine)
        w = len(mine) / (len(mine) + quality.PRIOR)
        apart = np.outer(m - m_all, m - m_all)
        middle, scatter = w * m + (1 - w) * m_all, w * c + (1 - w) * c_all + w * (1 - w) * apart
        expected[group == name] = np.einsum("ni,ij,nj->n", mine - middle, np.linalg.inv(scatter), mine - middle)
    found = [r.distance for r in quality.outliers(counts).orderBy("doc_id").collect()]
    assert np.allclose(found, expected, rtol=1e-6, atol=1e-9)


def test_bpe_equals_the_library(spark, docs, empty):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    encoder = bpe.Encoder(bpe.Vocabulary(path))
    rng = random.Random(3)
    pieces = [*" \n\t\r\x0b\x1c\x85\xa0aszé漢١½²!?.'", "<|endoftext|>", "'s", " the", "  ", "🙂", "hello" * 12]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 20)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == array.array("I", ids).tobytes(), text
        assert encoder.decode(encoder.encode(text)) == library.decode(ids, skip_special_tokens=False)
    rows = bpe.tokenised(docs, path, lexicon_words=20).collect()
    assert len(rows) == 12 and bpe.tokenised(empty, path).count() == 0
    for r in rows:
        assert r.n_tokens * 4 == len(r.ids) and r.decoded_sha256 == sha(r.decoded)


def test_words_merged_side_by_side_and_bounded_table(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    vocabulary = bpe.Vocabulary(public.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    words = ["".join(rng.choices("aaabeinorst é漢", k=rng.choice([0, 1, 2, 5, 9, 20, 48, 49, 300]))).encode() for _ in range(2000)]
    monkeypatch.setattr(bpe, "_ROWS_AT_ONCE", 100)
    assert vocabulary.merged_all([]) == []
    assert vocabulary.merged_all(words) == [array.array("I", vocabulary.merged(w)).tobytes() for w in words]

    monkeypatch.setattr(bpe, "CACHED_UNITS", 500)
    encoder = bpe.Encoder(vocabulary)
    for n in range(300):
        encoder.encode("漢" * 70 + chr(0x4E00 + n) + f", w{n} x{n}")
        assert len(encoder) < 510 and max(map(len, encoder), default=0) <= 64
    assert list(bpe.together(["a" * (1 << 20), "b", "", "c" * (1 << 21)])) == [["a" * (1 << 20)], ["b", ""], ["c" * (1 << 21)]]

    few = spark.createDataFrame([(n, "a a b\nb c d d" + " e" * (n % 2)) for n in range(6)], "doc_id long, text string")
    assert sorted(bpe.frequent_units(few, "text", 3)) == ["a", "b", "d"]
    assert bpe.frequent_units(few, "text", 2) == [] and bpe.frequent_units(few.limit(0), "text", 2) == []


def test_lexicon_counts_every_row(spark, monkeypatch):
    """More rows than any sample took; a word of the last rows alone is as frequent as it is."""
    monkeypatch.setattr(bpe, "COUNTED_UNITS", 3)
    n = F.col("id")
    text = F.when(n < 70_000, F.concat(F.lit("u"), n)).otherwise(F.concat(F.lit("v"), (n / 2).cast("int"), F.lit(" \nx")))
    docs = spark.range(70_004).select(n.alias("doc_id"), text.alias("text"))
    assert sorted(bpe.frequent_units(docs, "text", 3)) == ["v35000", "v35001", "x"]


def test_lexicon_holds_exactly_its_words(tmp_path):
    words = {w.encode(): [n, n + 1] for n, w in enumerate(["a", "ab", "abc", "xbc", "ybc", "é", " the"])}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(path))
    assert all(lexicon.get(w) == array.array("I", ids).tobytes() for w, ids in words.items())
    assert all(lexicon.get(w) is None for w in (b"", b"b", b"abcd", b"xb", b"th"))
    path.write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(path)).get(b"a") is None


def test_secrets(spark, docs, empty):
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    rng = random.Random(6)
    pieces = ["token", "API_KEY", "=", ": ", '"', "abcdefgh", "0f" * 17, "AKIA", "ABCDEF123456", " ", "é", "\n", "x9Kq2LmZ7vT4pWc8RjYd"]
    texts = ["", "AKIA", "f" * 31, "f" * 32, "password=short", "é token = abcdefgh1"]
    texts += ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(400)]
    table = spark.createDataFrame([(n, t) for n, t in enumerate(texts)] + [(9999, None)], "doc_id long, text string")
    scanned = secret_scan.scan(table).select("doc_id", secret_scan.listed("base").alias("b"), secret_scan.listed("spans").alias("s"))
    for r in scanned.filter("doc_id < 9999").collect():
        text = texts[r.doc_id]
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 8]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        assert r.b == ",".join(x for _, _, x in sorted(found)), text
        assert set(r.b.split(",")) - {""} <= set(r.s.split(","))
    assert secret_scan.scan(empty).count() == 0 and secret_scan.scan(docs).count() == 12


def test_entropy_windows(spark):
    import math

    secret, path = "x9Kq2LmZ7vT4pWc8RjYdAA", "some/long/path/to/words/12"
    texts = [f"key {secret} end", f"see {path} end", "1" * 30 + "a", "exampleX9Kq2LmZ7vT4pWc8RjYd"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.s for r in secret_scan.scan(table).select("doc_id", secret_scan.listed("spans").alias("s")).collect()}
    assert found == {0: f"entropy:4:{4 + len(secret)}", 1: "", 2: "", 3: ""}
    peak = spark.createDataFrame([(secret,)], "c string").select(secret_scan._peak_bits(F.col("c"))).first()[0]
    width = secret_scan.WINDOW
    windows = [secret[k : k + width] for k in range(len(secret) - width + 1)]
    bits = [-sum(w.count(c) / width * math.log2(w.count(c) / width) for c in set(w)) for w in windows]
    assert abs(peak - max(bits)) < 1e-9


def test_entropy_threshold_and_allow_list_are_per_window(spark):
    key, other = "4F3A91C7D20B8E65F13C7A9042DE", "x9Kq2LmZ7vT4pWc8RjYdAA"
    secrets = [f"{front}{key}" for front in ("", "k_", "id=", "sig=", "path/", "sample/", "EXAMPLE_")]
    secrets += [f"example={other}", f"{other}/sample", f"a-{'0' * 9}-{other}"]
    harmless = ["n=73019482650917384625", f"sample{key}", "exampleX9Kq2LmZ7vT4pWc8RjYd", f"{key[:12]}_{'0' * 20}", f"id={'A1' * 15}"]
    table = spark.createDataFrame(list(enumerate(secrets + harmless)), "doc_id long, text string")
    scanned = secret_scan.scan(table).select("doc_id", secret_scan.listed("spans").alias("s"))
    found = {r.doc_id: r.s for r in scanned.collect()}
    assert [found[n] for n in range(len(found))] == [f"entropy:0:{len(s)}" for s in secrets] + [""] * len(harmless)
    rng = random.Random(3)
    keys = ["k_" + "".join(rng.choices("0123456789ABCDEF", k=28)) for _ in range(200)]
    table = spark.createDataFrame([(n, k) for n, k in enumerate(keys)], "doc_id long, text string")
    assert secret_scan.scan(table).filter(F.size("spans") > 0).count() > 180


def test_maximal_segments():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(300):
        scores = rng.integers(-4, 4, rng.integers(0, 25)).astype(float)
        found = toxicity.maximal_segments(scores)
        best = max([scores[a:b].sum() for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)], default=0)
        assert max([s for *_, s in found], default=0) == max(best, 0)
        assert all(a < b <= c for (a, b, _), (c, _, _) in zip(found, found[1:]))
        assert all(abs(scores[a:b].sum() - s) < 1e-9 for a, b, s in found)


def test_toxicity(spark, empty):
    rows, labels = [], []
    for n in range(600):
        words = prose(n).split()
        if n % 6 == 0:
            words[10:12] = [f"vile{n % 7}", f"nasty{n % 5}"]
        rows.append((n, " ".join(words)))
        labels.append((n, int(n % 6 == 0) if n % 50 else None))
    table = spark.createDataFrame(rows + [(9000, None), (9001, "")], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1), (6, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, known, F.col("doc_id") < 400)
    scored = {r.doc_id: r for r in toxicity.score(table, model, passages=True).collect()}
    unseen = [n for n in range(400, 600)]
    assert all((scored[n].score >= 0.3) == (n % 6 == 0) for n in unseen)
    assert scored[402].passages[0].start == 10 and 0 <= scored[9000].score == scored[9001].score < 0.3
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(table, known.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(table, none).collect()} == {0.0}


def test_warc_round_trip(spark):
    long = "<p>é WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * 200
    rows = [(3, "http://a/ b", long), (1, None, long), (2, "u", "short"), (5, "u", "short"), (4, "u", None), (1, None, long), (None, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("reason", F.lit("x"))
    found = [tuple(r) for r in warc.round_trip(pages).collect()]
    size, digest = len(long.encode()), sha(long)
    expected = [(3, size, digest, "revisit", 1), (1, size, digest, "response", None), (1, size, digest, "response", None)]
    expected += [(2, 5, sha("short"), "response", None), (5, 5, sha("short"), "response", None)]
    expected += [(4, 0, sha(""), "response", None), (None, size, digest, "revisit", 1)]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def record(n: int, more: bytes = b"") -> bytes:
    payload = b"payload %d" % n * 5 + more
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\n"
    return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    parts = [gzip.compress(record(n), mtime=0) if packed else record(n) for n in range(5)]
    damaged = bytearray(parts[1])
    damaged[len(damaged) // 2] ^= 0xFF
    data = parts[0] + bytes(damaged) + parts[2] + b"garbage" + parts[3] + parts[4][:-20]
    found = list(warc.salvage(data))
    good = [r.record_id for _, _, r in found if not isinstance(r, str)]
    assert good == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    gaps = [(at, n) for at, n, r in found if isinstance(r, str)]
    first = len(parts[0]) + len(parts[1]) + len(parts[2])
    assert gaps[0] == (len(parts[0]), len(parts[1])) and gaps[1] == (first, 7)
    assert sum(n for _, n, _ in found) == len(data)


def found_in(data: bytes) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(warc.salvage(bytes(data)))
    good = [r.record_id[10:-1] for _, _, r in found if not isinstance(r, str)]
    return good, [(at, n) for at, n, r in found if isinstance(r, str)]


@pytest.mark.parametrize("flip", [0, 1, 2])
def test_salvage_looks_for_members_and_version_lines(flip):
    packed = [gzip.compress(record(n), mtime=0) for n in range(4)]
    damaged = bytearray(b"".join(packed))
    damaged[flip] ^= 0xFF
    assert found_in(damaged) == (["1", "2", "3"], [(0, len(packed[0]))])
    # plain records after a gap among members, and the other way round
    mixed = packed[0] + b"lost" + record(1) + packed[2] + record(3)
    assert found_in(mixed) == (["0", "1", "2", "3"], [(len(packed[0]), 4)])
    plain = bytearray(record(0) + record(1))
    plain[flip] ^= 0xFF
    assert found_in(bytes(plain) + packed[2]) == (["1", "2"], [(0, len(record(0)))])


def test_salvage_reads_a_damaged_member_up_to_its_error():
    rng = random.Random(1)
    noise = [b"".join(b"%d " % rng.randrange(10**9) for _ in range(200)) for _ in range(6)]
    whole = gzip.compress(b"".join(record(n, noise[n]) for n in range(6)), mtime=0)
    after = gzip.compress(record(9), mtime=0)
    for cut in (1, 5, 300):  # the length, the checksum, the last record
        damaged = bytearray(whole)
        damaged[-cut] ^= 0xFF
        good, gaps = found_in(bytes(damaged) + after)
        assert good[:5] == ["0", "1", "2", "3", "4"] and good[-1] == "9" and good.count("5") == (cut < 9)
        assert sum(gaps[-1]) == len(whole)
    good, gaps = found_in(whole[:-300] + after)
    assert good == ["0", "1", "2", "3", "4", "9"] and sum(gaps[-1]) == len(whole) - 300
    # stored blocks hold version lines as they are: no record comes twice
    stored = bytearray(gzip.compress(b"".join(record(n) for n in range(4)), 0, mtime=0))
    stored[-5] ^= 0xFF
    assert found_in(stored)[0] == ["0", "1", "2", "3"]


def test_salvage_of_many_version_lines_is_linear():
    # 200 kB of version lines in a damaged record, on lines of their own, inside headers and before whole headers
    for line in (b"WARC/1.1\r\n", b"a: WARC/1.1\r\n", b"WARC/1.1\r\na: b\r\n", b"WARC/1.1\r\ncontent-length: 9\r\n\r\n"):
        damaged = bytearray(record(0, line * (200_000 // len(line))))
        damaged[-8] ^= 0xFF
        begin = time.process_time()
        good, gaps = found_in(bytes(damaged) + record(1) + gzip.compress(record(2), mtime=0))
        assert time.process_time() - begin < 2 and good == ["1", "2"] and gaps == [(0, len(damaged))]


def test_salvage_after_broken_headers():
    cut = record(0)[:40]
    member = gzip.compress(record(2), mtime=0)
    # a header cut off before a member, before a plain record, and a length that says too much
    assert found_in(cut + member) == (["2"], [(0, 40)])
    assert found_in(cut + b"\r\n" + record(1) + member)[0] == ["1", "2"]
    wrong = re.sub(rb"(?i)(content-length: )([0-9]+)", rb"\g<1>9\g<2>", record(0), count=1)
    assert found_in(wrong + record(1) + member) == (["1", "2"], [(0, len(wrong))])
    # a member of more than 16 MB has a separator of its own
    assert found_in(gzip.compress(record(3, bytes(17 << 20)), 1, mtime=0) + b"\0" + member)[0] == ["3", "2"]


def test_pipeline(spark):
    packed = corpus_pipeline.run(spark, SF)
    rows = packed.collect()
    kept = {r.doc_id for r in rows}
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in queries.op6_quality_rules(spark, SF).filter("kept").collect()}
    left = documents.filter(F.col("doc_id").isin(list(good)))
    first = {r.doc_id for r in near_dedup.near_classes(left).filter("kept").collect()}
    assert kept == first


def test_pipeline_stages_keep_the_columns(spark, docs, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, empty, SF).count() == 0
