"""Quality rules with a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once; its failure is one bit of ``failed`` and its measurement is
kept beside it.  Policies are versioned masks over these bits, so a new policy, or the
ablation of a rule, is bit arithmetic over the ledger and never reads a text again.

Defined cases: null text measures like the empty text (no words; fails the length rule);
repeated rows are measured each; long texts are measured whole; all other columns are kept
under their names, and ledger columns of the same name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycat.llm.common import WORD, fresh, let

#: Rules by bit: name and failure condition over the measurements.
RULES: dict[str, str] = {
    "too_short": "n_words < 50",
    "repeats_itself": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > n_words",
    "duplicate_lines": "3 * n_dup_lines > n_lines",
    "shouting": "2 * n_upper > word_chars",
    "long_words": "word_chars > 14 * n_words",
    "few_letters": "10 * n_letters < 6 * word_chars",
    "word_runs": "20 * n_runs > n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules: a document is kept if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)

    def keeps(self, failed: Column | str = "failed") -> Column:
        failed = F.col(failed) if isinstance(failed, str) else failed
        return failed.bitwiseAND(F.lit(self.mask)) == 0


#: Version 2 of strict, for a corpus whose short documents are wanted too: being short alone is no fault.
CLEAN = Policy("clean", 2, tuple(r for r in RULES if r != "too_short"))
BASE = Policy("base", 1, ("too_short", "repeats_itself"))
STRICT = Policy("strict", 1, tuple(RULES))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the same list."""
    windows = F.zip_with(F.slice(words, 1, F.size(words) - 2), F.zip_with(F.slice(words, 2, F.size(words) - 2), F.slice(words, 3, F.size(words) - 2), lambda b, c: F.concat(b, F.lit(" "), c)), lambda a, bc: F.concat(a, F.lit(" "), bc))

    def covered(found: Column) -> Column:
        def spread(at: Column) -> Column:
            # each position covers up to the next one, three words at most
            gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

        def places(s: Column) -> Column:
            after = F.slice(s, 2, F.size(s))
            lead = F.zip_with(s, after, lambda x, y: F.when(x["w"] == y["w"], F.array(x["i"], y["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(lead, lambda p: p.isNotNull()))))

        indexed = F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return let(indexed, lambda s: F.when(F.size(s) < 2, F.lit(0)).otherwise(let(places(s), lambda at: F.when(F.size(at) == 0, F.lit(0)).otherwise(spread(at)))))

    some = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(some).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds all measurements (long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    hits = lambda pattern: (F.size(F.split(body, pattern, -1)) - 1).cast("long")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1))
    word_figures = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words"),
        F.when(F.size(w) < 2, F.lit(0)).otherwise(F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: a == b), lambda same: same))).cast("long").alias("n_runs"),
    )
    line_figures = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    w, l = fresh(docs, "rules_words", "rules_lines")  # noqa: E741
    out = docs.withColumns({w: let(words, word_figures), l: let(lines, line_figures), "n_symbols": hits(r"[#*$%&|<>]"), "n_upper": F.char_length(F.regexp_replace(body, r"\P{Lu}+", "")).cast("long"), "n_letters": F.char_length(F.regexp_replace(body, r"\P{L}+", "")).cast("long")})
    return out.withColumns({c: F.col(f"{w}.{c}") for c in ("n_words", "word_chars", "n_repeat_words", "n_runs")} | {c: F.col(f"{l}.{c}") for c in ("n_lines", "n_dup_lines")}).drop(w, l)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and the ``failed`` bits of every rule."""
    measured = measure(docs, text)
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return measured.withColumn("failed", bits.cast("long"))


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that pass without it.

    One aggregation over distinct bit patterns; the patterns are at most 2^rules rows.
    """
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules)))
    rows = patterns.select("failed", "n", rules.alias("r")).select("failed", "n", "r.rule", "r.bit")
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(count(hit).alias("failing"), count(F.col("failed") == F.col("bit")).alias("failing_alone"), count(F.col("failed").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"))
