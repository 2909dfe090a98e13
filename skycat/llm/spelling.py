"""Spelling variants by permuterm rotations.

A word is closed by a terminator, and all rotations of the closed word are sorted.  A
rotation that begins right behind a letter ends with that letter: what comes before it, the
prefix, is the word without the letter and says where the letter stood.  Words with another
letter there share the prefix, and the word without it is the prefix itself.  So one scan
over the sorted prefixes meets every pair of words that differ by one replaced, inserted or
deleted code point.  A group holds at most one word for each letter and one without, so it is
as small as the alphabet, whatever the corpus.  For each word of a group the scan emits how
many neighbours it has there and the best of them, never the pairs.

A pair that differs by one of several equal letters in a row stands in several groups; it
counts in the one of the first of these letters.

Defined cases: null, empty and letter-free texts have no words; a null doc_id counts as the
empty string; very long texts count whole; repeated rows count each; extra columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycat.llm.common import written

#: Fixed value: runs of letters.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Fixed value: one run in so many loses a letter.
SLIP = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: No letter, and before all letters in code-point order.
END = "$"
#: Distinct words that a task counts before it hands them on.
HELD = 500_000


def word_counts(docs: DataFrame, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): every word with its occurrences; a run whose hash with its document is divisible by ``slip`` loses a letter."""

    def run(batches):
        import re
        from collections import Counter

        # the text is in ASCII lower case by then
        runs = re.compile(LETTERS).findall
        total: Counter[str] = Counter()
        flush = lambda: pd.DataFrame({"word": list(total), "n": list(total.values())})
        for pdf in batches:
            for doc_id, text in zip(pdf.doc_id, pdf.text):
                if not text:
                    continue
                own = f"{doc_id}:"
                for word, n in Counter(runs(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32((own + word).encode())
                    if h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > HELD:
                    yield flush()
                    total.clear()
        if total:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("doc_id"), "text").mapInPandas(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, letter, repeated, word, n): the rotations of closed words.

    ``letter`` is the one behind the prefix, empty where the prefix is a whole rotation, and
    ``repeated`` says that the same letter stands before it in the word.
    """
    w, i = F.col("word"), F.col("i")
    behind, before = F.substr(w, i + 1), F.substr(w, F.lit(1), i)
    whole = F.concat(behind, F.lit(END), before)
    placed = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("i"))
    turned = placed.select("word", "n", "i", whole.alias("turn"))
    last = F.substr("turn", F.char_length("turn"), F.lit(1))
    edited = turned.where("i > 0").select(F.substr("turn", F.lit(1), F.char_length("turn") - 1).alias("prefix"), last.alias("letter"), (F.substr(w, i - 1, F.lit(1)) == last).alias("repeated"), "word", "n")
    edited = edited.withColumn("repeated", F.col("repeated") & ~F.col("prefix").endswith(END))
    return edited.unionByName(turned.select(F.col("turn").alias("prefix"), F.lit("").alias("letter"), F.lit(False).alias("repeated"), "word", "n"))


def scan_groups(turned: DataFrame) -> DataFrame:
    """(word, near, best_n, best): for each word of a group of one prefix its neighbours there and the best of them.

    The rotations are sorted over ranges of the prefix, so a group lies in one task, one row
    behind the other; a group that a batch cuts off waits for the next one.
    """

    def summary(group):
        """Rows (letter, repeated, word, n) of one prefix."""
        if len(group) < 2:
            return []
        top = sorted(group, key=lambda g: (-g[3], g[2]))[:2]
        edits = [g for g in group if g[0]]
        bare = len(group) > len(edits)
        once = sum(not g[1] for g in edits)
        out = []
        for letter, repeated, word, _ in group:
            near = len(edits) - 1 + (bare and not repeated) if letter else once
            best = top[1] if top[0][2] == word else top[0]
            out.append((word, near, best[3], best[2]))
        return out

    def run(batches):
        prefix, group = None, []
        for pdf in batches:
            out = []
            for p, *row in pdf.itertuples(index=False, name=None):
                if p != prefix:
                    out += summary(group)
                    prefix, group = p, []
                group.append(row)
            if out:
                yield pd.DataFrame(out, columns=["word", "near", "best_n", "best"])
        if out := summary(group):
            yield pd.DataFrame(out, columns=["word", "near", "best_n", "best"])

    parts = int(turned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turned.select("prefix", "letter", "repeated", "word", "n").repartitionByRange(parts, "prefix").sortWithinPartitions("prefix", "letter")
    return ordered.mapInPandas(run, "word string, near long, best_n long, best string")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest count, if that is ``ratio`` times the word's own."""
    found = scan_groups(rotations(words)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("rest"), "best")).alias("top"))
    joined = words.join(found, "word", "left")
    taken = -F.col("top.rest") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("top.best")).alias("form"), F.when(taken, -F.col("top.rest")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """Adds ``root`` to written rows: the end of the chain of forms.

    Counts at least double along a chain, so it has no circle and is short; every round
    doubles the steps that a word has gone.
    """
    now = written(formed.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = written(now.join(on, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "spelling-roots")
        now = then.drop("moved")
        if then.where("moved").isEmpty():
            return formed.join(now, "word")


def variants(docs: DataFrame, slip: int = SLIP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the corpus."""
    words = written(word_counts(docs, slip), "words")
    formed = written(forms(words), "spelling-forms")
    return roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
