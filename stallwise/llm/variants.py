"""Spelling variants by a dictionary of trie-node pairs.

The nodes of the trie of all words and of the trie of all reversed words are numbered. A word of L letters is
listed under the pairs (prefix node, suffix node) that leave out one letter (L pairs, "skips") and that leave
out none (L + 1 pairs, "splits"). Two words that skip to one pair differ in that letter; a word that skips to a
pair at which another word splits becomes that word by a deletion. So all words at edit distance one, and no
others, meet under a pair, and each two of them under exactly one: a deletion inside a run of equal letters
counts at the run's first letter only.

Scale: a pair gathers at most one split and one skip per letter of the alphabet, so its members are bounded by
the alphabet and the work is linear in the listed pairs; neighbours are counted and the best one is kept, no
list of all near words is built. Nodes of up to seven Latin-1 letters are numbered by their letters; deeper
ones, which are many and shared by few words, from a written table that holds only nodes of two words or more,
as a node of one word pairs with nothing. Words travel as ranks in code-point order, so ties need no strings.

Edge cases: a null text has no words; a null id counts as empty; repeated rows count again; words of any
length are taken (nodes deeper than ``LONG`` letters go by the SHA-256 of the letters); an empty table gives an
empty result; only the id and the text are read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import with_running
from ..workspace import materialise
from .base import text_of

# fixed values: letters of a word, least letters and occurrences, and how much commoner a form must be
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_SEEN, COMMONER = 7, 2, 10
# nodes of this many one-byte letters fit a 64-bit number together with their depth
SHALLOW = 7
LONG = 64


def counted_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    letters: int = LEAST_LETTERS,
    seen: int = LEAST_SEEN,
    misspell: bool = False,
) -> DataFrame:
    """Words of at least ``letters`` letters with their occurrences ``n``, ``seen`` at least; A-Z in lower case.

    With ``misspell`` every run whose hash with the id is divisible by 31 loses one letter first.
    """
    # shorter runs can neither be words nor become such
    runs = F.regexp_extract_all(text_of(text_col), F.lit(f"([{LETTERS}]{{{letters},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    rows = rows.select("_id", F.translate("_run", ascii_uppercase, ascii_lowercase).alias("word"))
    if misspell:
        rows = rows.select("word", F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary")).alias("_hash"))
        place = F.col("_hash") % F.char_length("word")
        lost = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.char_length("word")))
        rows = rows.select(F.when(F.col("_hash") % 31 == 0, lost).otherwise(F.col("word")).alias("word"))
        rows = rows.filter(F.char_length("word") >= letters)
    return rows.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= seen)


def _packed(letters: Column) -> Column:
    """Number of a shallow node: its one-byte letters and, above them, its depth."""
    number = F.conv(F.hex(F.encode(letters, "ISO-8859-1")), 16, 10).cast("long")
    return number + F.shiftleft(F.char_length(letters).cast("long"), 56)


def _with_deep_nodes(words: DataFrame) -> DataFrame:
    """Words (rank, n, word, size, latin) with ``deep``: numbers of their deeper nodes that other words share.

    Keys of the map: twice the position, plus one for the node of the letters from there to the end.
    """
    place, size = F.col("_at"), F.col("size")
    ends = words.select("rank", "word", "size", "latin", F.explode(F.sequence(F.lit(0), size)).alias("_at"))
    sides = F.array(
        F.struct((2 * place).alias("key"), place.alias("depth"), F.substring("word", F.lit(1), place).alias("part")),
        F.struct((2 * place + 1).alias("key"), (size - place).alias("depth"), F.substring("word", place + 1, size).alias("part")),
    )
    deep = ends.select("rank", "latin", F.explode(sides).alias("_side")).select("rank", "latin", "_side.*")
    deep = deep.filter((F.col("depth") > 0) & ~(F.col("latin") & (F.col("depth") <= SHALLOW)))
    name = F.when(F.col("depth") > LONG, F.sha2(F.col("part").cast("binary"), 256)).otherwise(F.col("part"))
    deep = deep.select("rank", "key", (F.col("key") % 2).alias("_side"), "depth", name.alias("_name"))
    nodes = deep.groupBy("_side", "depth", "_name").agg(F.count("*").alias("_words")).filter("_words > 1")
    number = F.lit(1 << 62) + F.monotonically_increasing_id()
    nodes = materialise(nodes.select("_side", "depth", "_name", number.alias("node")), "variant_nodes")
    listed = deep.join(nodes, ["_side", "depth", "_name"]).groupBy("rank").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "node"))).alias("deep")
    )
    return words.join(listed, "rank", "left")


def _pairs(words: DataFrame) -> DataFrame:
    """Rows (prefix, suffix, neg, rank, split, first): one per skip and split of a word."""

    def node(latin: Column, depth: Column, letters: Column, key: Column) -> Column:
        shallow = F.when(latin & (depth <= SHALLOW), _packed(letters))
        return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.coalesce(shallow, F.try_element_at("deep", key)))

    def before(at: Column) -> Column:
        return node(F.col("latin"), at, F.substring("word", F.lit(1), at), 2 * at)

    def behind(at: Column) -> Column:
        return node(F.col("latin"), F.col("size") - at, F.substring("word", at + 1, F.col("size")), 2 * at + 1)

    at, split = F.col("_at"), F.col("_split")
    both = F.array(F.lit(False), F.lit(True))
    rows = words.select("*", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("_at"))
    rows = rows.select("*", F.explode(both).alias("_split")).filter(split | (at < F.col("size")))
    letter, previous = F.substring("word", at + 1, F.lit(1)), F.substring("word", at, F.lit(1))
    listed = rows.select(
        before(at).alias("prefix"),
        F.when(split, behind(at)).otherwise(behind(at + 1)).alias("suffix"),
        (-F.col("n")).alias("neg"),
        "rank",
        split.alias("split"),
        (split | (at == 0) | (letter != previous)).alias("first"),
    )
    return listed.filter("prefix IS NOT NULL AND suffix IS NOT NULL")


def _near(words: DataFrame) -> DataFrame:
    """Per word with near words: ``rank``, ``n_near`` and ``best`` (neg, rank), the commonest of them."""
    member = F.struct("neg", "rank", "split", "first")
    groups = _pairs(words).groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list(member)).alias("_all"))
    groups = groups.filter(F.size("_all") > 1)

    def ranked(members: Column) -> Column:
        return F.transform(members, lambda m: F.struct(m["neg"].alias("neg"), m["rank"].alias("rank")))

    groups = groups.select(
        "_all",
        ranked(F.filter("_all", lambda m: ~m["split"])).alias("_skips"),
        ranked(F.filter("_all", lambda m: ~m["split"] & m["first"])).alias("_firsts"),
        F.try_element_at(ranked(F.filter("_all", lambda m: m["split"])), F.lit(1)).alias("_word"),
    )
    rows = groups.select("*", F.explode("_all").alias("_m")).drop("_all")
    m = F.col("_m")
    whole = m["first"] & F.col("_word").isNotNull()
    top = F.try_element_at("_skips", F.lit(1))
    other = F.when(top["rank"] == m["rank"], F.try_element_at("_skips", F.lit(2))).otherwise(top)
    near = F.when(m["split"], F.size("_firsts")).otherwise(F.size("_skips") - 1 + whole.cast("int"))
    best = F.when(m["split"], F.try_element_at("_firsts", F.lit(1))).otherwise(F.least(other, F.when(whole, F.col("_word"))))
    return (
        rows.select(m["rank"].alias("rank"), near.alias("_near"), best.alias("_best"))
        .filter("_near > 0")
        .groupBy("rank")
        .agg(F.sum("_near").alias("n_near"), F.min("_best").alias("best"))
    )


def _roots(links: DataFrame) -> DataFrame:
    """(rank, root) from (rank, form): each round doubles the steps; counts grow tenfold a step, so rounds are few."""
    hops = materialise(links.select("rank", F.col("form").alias("root")), "variant_roots")
    while True:
        further = hops.select(F.col("rank").alias("root"), F.col("root").alias("_next"))
        joined = hops.join(further, "root", "left")
        hops = materialise(
            joined.select("rank", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")),
            "variant_roots",
        )
        if hops.filter("_moved").isEmpty():
            return hops.select("rank", "root")
        hops = hops.select("rank", "root")


def variants(counted: DataFrame, commoner: int = COMMONER) -> DataFrame:
    """One row per word of ``counted`` (word, n): word, form, root, n, n_near, form_n.

    ``form`` is the commonest word at distance one if it occurs at least ``commoner`` times as often.
    """
    ranked = with_running(counted.select("word", "n"), [F.col("word").asc()], rank="rank")
    words = materialise(
        ranked.select(
            F.col("rank").cast("long").alias("rank"),
            "word",
            F.col("n").cast("long").alias("n"),
            F.char_length("word").alias("size"),
            F.col("word").rlike(r"^[\u0000-ÿ]*$").alias("latin"),
        ),
        "variant_words",
    )
    near = materialise(_near(_with_deep_nodes(words)), "variant_near")
    known = words.select("rank", "word", "n").join(near, "rank", "left")
    chosen = -F.col("best.neg") >= commoner * F.col("n")
    known = materialise(
        known.select(
            "rank",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("best.rank")).alias("form"),
            F.when(chosen, -F.col("best.neg")).alias("form_n"),
        ),
        "variant_known",
    )
    roots = _roots(known.filter("form IS NOT NULL").select("rank", "form"))
    spelled = known.select(F.col("rank").alias("_rank"), F.col("word").alias("_spelled"))
    result = known.join(roots, "rank", "left")
    for name in ("form", "root"):
        result = result.join(spelled, F.col(name) == F.col("_rank"), "left").withColumn(name, F.col("_spelled")).drop("_rank", "_spelled")
    return result.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
