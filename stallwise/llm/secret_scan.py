"""Secret scan: base patterns, and windows of high Shannon entropy within candidate strings.

Everything is a native expression within one row. The places of matches come from splitting the text at the
same pattern: match k starts after the first k pieces and k - 1 matches.

Entropy: a candidate is a run of 20 or more characters of ``[A-Za-z0-9+/_=-]`` with a digit and a letter.
A window slides over the candidate; the counts per character are updated by the character that enters and the
one that leaves, and with them the sum of c*log2(c), from which the entropy follows. The characters inside the
window set its threshold: hex (with a letter; plain numbers are none) or base64. Parts between ``=``, ``/``,
``_`` and ``-`` that hold a public example are blanked, and windows that touch them do not count; paths of words
and UUIDs are allowed as whole candidates. The candidate is a secret, as a whole, if any window reaches its
threshold. Base spans are never suppressed.

Edge cases: a null or empty text has no spans; repeated rows give equal rows; an empty table gives an empty
result; candidates shorter than the window are not scanned; other columns are ignored. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import text_of

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "entropy")

# a candidate holds a digit and a letter; plain words and numbers never start the scan
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
PARTS = r"[^=/_-]+|[=/_-]+"
WINDOW = 20
HEX_BITS = 3.0
BASE64_BITS = 3.7
# strings of public examples and placeholders, anywhere in a part
EXAMPLES = (
    r"(?i)example|sample|dummy|placeholder|changeme|lorem",
    r"(?<same>.)\k<same>{7,}",
    r"(?i)0123456789|abcdefghij",
)
# whole candidates: paths of plain words, UUIDs
ALLOWED = (
    r"^[A-Za-z+/_=-]*[0-9]{0,4}[/_=-]*$",
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
)
BLANK = " "
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-" + BLANK


def _matches(pattern: str, present: Column) -> Column:
    """Array of (start, end, match) of a pattern that never matches the empty string."""
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    pieces = F.transform(F.split("_text", pattern), lambda x: F.char_length(x))
    matches = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    placed = F.aggregate(
        F.arrays_zip(pieces.alias("gap"), matches.alias("match")),
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(F.char_length(x["match"]), F.lit(0))).alias("at"),
            F.when(x["match"].isNull(), acc["found"])
            .otherwise(
                F.concat(
                    acc["found"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            (acc["at"] + x["gap"] + F.char_length(x["match"])).alias("end"),
                            x["match"].alias("match"),
                        )
                    ),
                )
            )
            .alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.when(present, placed).otherwise(empty)


def _clog(count: Column) -> Column:
    """c * log2(c), zero for none or one."""
    return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))


def _any(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _blanked(candidate: Column) -> Column:
    """The candidate, as long as before, with blanks for the parts that hold a public example."""

    def part(p: Column) -> Column:
        return F.when(p.rlike(_any(EXAMPLES)), F.repeat(F.lit(BLANK), F.char_length(p))).otherwise(p)

    parts = F.transform(F.regexp_extract_all(candidate, F.lit(PARTS), F.lit(0)), part)
    return F.when(candidate.rlike(_any(EXAMPLES)), F.array_join(parts, "")).otherwise(candidate)


def _windows(candidate: Column) -> Column:
    """(peak, secret): the highest Shannon entropy of a window of the candidate and whether any window reaches
    the threshold of its class, by counts updated one character at a time."""
    width = F.lit(WINDOW)
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0.0).alias("peak"),
        # places of the last blank, the last character that is not hex and the last hex letter
        F.lit(0).alias("blank"),
        F.lit(0).alias("other"),
        F.lit(0).alias("letter"),
        F.lit(False).alias("secret"),
    )

    def over(letters: Column) -> Column:
        def slide(acc: Column, i: Column) -> Column:
            enters = F.element_at(letters, i)
            # while the window fills nothing leaves: 0 is no letter
            leaves = F.when(i > width, F.element_at(letters, F.greatest(i - width, F.lit(1)))).otherwise(F.lit(0))
            counts, total = acc["counts"], acc["sum"]
            out = F.when(leaves > 0, F.element_at(counts, F.greatest(leaves, F.lit(1)))).otherwise(F.lit(0))
            total = total - _clog(out) + _clog(out - 1)
            # the count that the entering character meets after the other one left
            met = F.element_at(counts, enters) - F.when(enters == leaves, 1).otherwise(0)
            total = total - _clog(met) + _clog(met + 1)
            moved = F.transform(
                counts,
                lambda c, k: c + F.when(k + 1 == enters, 1).otherwise(0) - F.when(k + 1 == leaves, 1).otherwise(0),
            )
            bits = F.when(i >= width, F.log2(width) - total / width).otherwise(F.lit(0.0))
            sign = F.substr(F.lit(ALPHABET), enters, F.lit(1))
            blank = F.when(sign == BLANK, i).otherwise(acc["blank"])
            other = F.when(sign.rlike("[^0-9A-Fa-f]"), i).otherwise(acc["other"])
            letter = F.when(sign.rlike("[A-Fa-f]"), i).otherwise(acc["letter"])
            is_hex = (other <= i - width) & (letter > i - width)
            reached = (blank <= i - width) & (bits >= F.when(is_hex, F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS)))
            return F.struct(
                moved.alias("counts"),
                total.alias("sum"),
                F.greatest(acc["peak"], bits).alias("peak"),
                blank.alias("blank"),
                other.alias("other"),
                letter.alias("letter"),
                (acc["secret"] | reached).alias("secret"),
            )

        return F.aggregate(
            F.sequence(F.lit(1), F.size(letters)),
            start,
            slide,
            lambda acc: F.struct(acc["peak"].alias("peak"), acc["secret"].alias("secret")),
        )

    letters = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    # a one-element array binds the letters once per candidate
    return F.element_at(F.transform(F.array(letters), over), 1)


def _peak_bits(candidate: Column) -> Column:
    return _windows(candidate)["peak"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_assign, n_access, n_hex (base counts), base, spans.

    ``base`` and ``spans`` are arrays of (start, rank, end), the rank giving the kind in ``KINDS``, sorted.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    text = F.col("_text")
    found = rows.select(
        "_id",
        _matches(ASSIGN, text.rlike(r"(?i)pass|secret|token|api") & text.rlike(ASSIGN)).alias("_assign"),
        _matches(ACCESS, text.contains("AKIA")).alias("_access"),
        _matches(HEX, text.rlike(HEX)).alias("_hex"),
        _matches(CANDIDATE, text.rlike(CANDIDATE)).alias("_candidate"),
    )
    assign = F.filter("_assign", lambda x: F.char_length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 8)
    access = F.filter("_access", lambda x: F.char_length(x["match"]) >= 16)

    def secret(x: Column) -> Column:
        return ~x["match"].rlike(_any(ALLOWED)) & _windows(_blanked(x["match"]))["secret"]

    found = found.select(
        "_id", assign.alias("_assign"), access.alias("_access"), "_hex", F.filter("_candidate", secret).alias("_entropy")
    )

    def ranked(name: str, rank: int) -> Column:
        return F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))

    base = F.sort_array(F.concat(ranked("_assign", 0), ranked("_access", 1), ranked("_hex", 2)))
    return found.select(
        F.col("_id").alias(id_col),
        F.size("_assign").cast("long").alias("n_assign"),
        F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"),
        base.alias("base"),
        F.sort_array(F.concat(base, ranked("_entropy", 3))).alias("spans"),
    )


def listed(spans: str) -> Column:
    """``kind:start:end``, comma-joined, of an array of (start, rank, end)."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"], x["end"])), ","
    )
