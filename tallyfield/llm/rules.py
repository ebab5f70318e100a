"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; a policy is a named, versioned set of rules. Applying a policy, changing it, or asking
what a rule alone costs is then bit arithmetic on the ledger and never reads a text again.

All of it is column expressions on one row: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.text import WORD, whole, words

WINDOW = 8  # words of a repeated passage
MEASURES = ("n_words", "word_chars", "n_symbols", "n_letters", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A named test over the measurements; ``fails`` is SQL, true for a bad document."""

    name: str
    bit: int
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of what is rejected: the document goes if any of these rules failed."""

    name: str
    version: int
    rules: tuple[str, ...]


# Bits never change their meaning; a changed rule gets a new bit.
RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_passages", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "2 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("word_length", 4, "2 * word_chars < 3 * n_words or word_chars > 60 * n_words"),
    Rule("few_letters", 5, "2 * n_letters < word_chars"),
)
BASE = Policy("base", 1, ("few_words", "repeated_passages"))
WEB = Policy("web", 1, tuple(r.name for r in RULES))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measurements) of every row.

    Null and empty texts measure 0 everywhere. Rows that repeat stay repeated; other columns of
    ``docs``, whatever their names, are not looked at.

    Repeated passages: texts without one, nearly all, end at the comparison of two sizes. For the
    others the windows are sorted by hash, those with an equal neighbour give their places, and
    each place covers the words up to the next one: linear memory, n log n time.
    """
    d = docs.select(F.col(key).alias("_key"), whole(text).alias("_text"))
    d = d.select("*", words("_text").alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    d = d.select(
        "_key",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_starts"),
    )
    # hashes of 1, 2, 4, then 8 words from each place on
    for step in (1, 2, 4):
        d = d.withColumn("_starts", F.transform("_starts", lambda h, i: F.xxhash64(h, F.get("_starts", i + step))))
    whole_windows = F.greatest(F.size("_starts") - (WINDOW - 1), F.lit(0))
    d = d.withColumn("_starts", F.slice("_starts", 1, whole_windows))
    d = d.select(
        *[c for c in d.columns if c not in ("_lines", "_starts")],
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # null where no window repeats
        F.when(F.size(F.array_distinct("_starts")) < F.size("_starts"), F.col("_starts")).alias("_starts"),
    )
    # each step below reads the array of the step before, so that none is worked out twice
    d = d.withColumn(
        "_at",
        F.sort_array(F.transform("_starts", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    d = d.withColumn(
        "_twice",
        F.sort_array(
            F.transform(
                F.filter(
                    F.transform(
                        "_at",
                        lambda e, i: F.struct(
                            e["i"].alias("i"),
                            (
                                F.coalesce(F.get("_at", i - 1)["h"] == e["h"], F.lit(False))
                                | F.coalesce(F.get("_at", i + 1)["h"] == e["h"], F.lit(False))
                            ).alias("twice"),
                        ),
                    ),
                    lambda e: e["twice"],
                ),
                lambda e: e["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(
            "_twice",
            lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_twice", i + 1) - p, F.lit(WINDOW))),
        ),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    d = d.withColumn("_covered", F.coalesce(covered, F.lit(0).cast("long")))
    # A filter on a measurement would be moved below all steps, with each step written out wherever
    # it is read: too large to plan. It can't pass a row number that it needs.
    d = d.withColumn("_row", F.monotonically_increasing_id())
    d = d.withColumn("n_repeat_words", F.when(F.col("_row") >= 0, F.col("_covered")))
    first = F.when(F.col("_row") >= 0, F.col("n_words")).alias("n_words")
    return d.select(F.col("_key").alias(key), first, *MEASURES[1:])


def ledger(measures: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The measurements and ``failed_bits``: bit b is set if the rule of bit b failed."""
    if len({r.bit for r in rules}) < len(rules) or not all(0 <= r.bit < 63 for r in rules):
        raise ValueError("rules need different bits from 0 to 62")
    bits = F.lit(0).cast("long")
    for r in rules:
        failed = F.coalesce(F.expr(r.fails), F.lit(False))
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measures.select("*", bits.alias("failed_bits"))


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    """The bits a policy rejects."""
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in policy.rules)


def rejects(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """True where the ledger has a bit that the policy rejects."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) != 0


def ablations(led: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of a policy: documents it rejects, and those that only it rejects.

    The second number is what comes back if the rule is taken out. Documents are first counted
    by their bits, at most 2 to the number of rules; ``bit_or`` of them is kept as ``seen_bits``.
    """
    hit = F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long"))
    counts = led.groupBy(hit.alias("hit")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("failed_bits").alias("seen_bits")
    )
    chosen = [r for r in rules if r.name in policy.rules]
    each = F.explode(
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("one")) for r in chosen])
    )
    x = counts.select("*", each.alias("r")).select("n", "hit", "seen_bits", "r.rule", "r.one")
    has = F.col("hit").bitwiseAND(F.col("one")) != 0
    zero = F.lit(0).cast("long")
    return x.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(zero)).alias("rejected"),
        F.sum(F.when(F.col("hit") == F.col("one"), F.col("n")).otherwise(zero)).alias("rejected_alone"),
        F.bit_or("seen_bits").alias("seen_bits"),
    )


def judged(
    docs: DataFrame, policy: Policy = WEB, rules: Sequence[Rule] = RULES, key: str = "doc_id"
) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``, false where base or the policy rejects.

    The key may be any column, also a struct of a whole row.
    """
    led = ledger(measured(docs, key), rules)
    base = rejects(BASE, rules)
    return led.select("*", base.alias("base_failed"), (~base & ~rejects(policy, rules)).alias("kept"))
