"""SimHash near-duplicates with a Gray-order hierarchical Hamming index.

Equal fingerprints collapse first.  Two codes within ``distance`` bits agree on one of
``distance`` + 1 blocks of bits.  So the index is built over as many rotations of the code,
each of which brings one block to the front, and allows no difference there: a code stands in
``distance`` + 1 trees, whatever the size of the corpus.  In a rotation the codes of a task
are sorted by Gray rank, and a tree is built over them: an upper node holds the bits (mask
and pattern) that all codes below it share, a lower node only what is left, so that
differences add up on the way down and whole groups are dropped once the sum exceeds
``distance`` or a bit of the front block differs.  Codes of one front block share a task;
blocks with very many codes are cut into slices, and each pair of slices is a task.  A task
reports a spanning forest of what it has linked, never all pairs, and components are found
over these edges.

Defined cases: null, empty and word-free texts have fingerprint zero and link like any
other; fewer than three words make one shingle; repeated rows fall into one class; null
doc_ids count last for the component; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycat.llm.common import written
from skycat.operators.components import connected_components

#: Children of a tree node; codes of a slice of one front block; codes of a task.
FAN = 8
SLICE, TASK = 1 << 18, 1 << 20


def majority(h):
    """The 64-bit code whose bits are set in over half of the hashes ("<u8" array, repeats count)."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): 64-bit majority fingerprint of word shingles as a signed long."""

    def run(batches):
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest
        for pdf in batches:
            out = np.zeros(len(pdf), np.uint64)
            for row, text in enumerate(pdf.text):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                if not words:
                    continue
                if len(words) < width:
                    hashes = [digest(b" ".join(words), seed)]
                else:
                    hashes = [digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))]
                out[row] = majority(np.array(hashes, "<u8"))
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "fp": out.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def gray_rank(fp):
    """Position of each code in Gray order: prefix parity of its bits."""
    import numpy as np

    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Tree over codes in Gray order.

    A code may be partial: ``masks`` has a one for each bit that is settled.  An upper node
    takes over the bits that all codes below it share, and a node keeps only what is not
    already settled above it, so that differences add up on the way down and a whole group
    is dropped as soon as the sum exceeds the distance.
    """

    def __init__(self, codes, masks=None, fan: int = FAN):
        import numpy as np

        mask = np.full(len(codes), ~np.uint64(0)) if masks is None else masks
        self.order = np.argsort(gray_rank(codes), kind="stable")
        pattern, mask = (codes & mask)[self.order], mask[self.order]
        self.levels, self.fan = [(pattern, mask)], fan
        while len(pattern) > fan:
            starts = np.arange(0, len(pattern), fan)
            ones, zeros = np.bitwise_and.reduceat(pattern, starts), np.bitwise_and.reduceat(~pattern & mask, starts)
            own = np.arange(len(pattern)) // fan
            shared = ones | zeros
            self.levels[-1] = (pattern & ~shared[own], mask & ~shared[own])
            pattern, mask = ones, shared
            self.levels.append((pattern, mask))

    def search(self, queries, distance: int, budget: int = 400_000, front: int = 0):
        """Arrays (i, j): query i lies within ``distance`` bits of code j of the given order and differs in no bit of ``front``, in bounded batches."""
        import numpy as np

        top, steps = len(self.levels) - 1, np.arange(self.fan)
        roots = len(self.levels[top][0])
        step = max(1, budget // max(1, roots))
        for at in range(0, len(queries), step):
            q = np.arange(at, min(at + step, len(queries)))
            stack = [(top, np.repeat(q, roots), np.tile(np.arange(roots), len(q)), np.zeros(len(q) * roots, np.uint8))]
            while stack:
                level, i, j, apart = stack.pop()
                pattern, mask = self.levels[level]
                differ = (queries[i] ^ pattern[j]) & mask[j]
                apart = apart + np.bitwise_count(differ)
                near = apart <= distance
                if front:
                    near &= differ & np.uint64(front) == 0
                i, j, apart = i[near], j[near], apart[near]
                if not level:
                    if len(i):
                        yield i, self.order[j]
                    continue
                below, width = len(self.levels[level - 1][0]), max(1, budget // self.fan)
                for cut in range(0, len(i), width):
                    child = (j[cut : cut + width, None] * self.fan + steps).ravel()
                    real = child < below
                    stack.append((level - 1, np.repeat(i[cut : cut + width], self.fan)[real], child[real], np.repeat(apart[cut : cut + width], self.fan)[real]))


def spanning_forest(n: int, pairs):
    """Edges of a spanning forest over positions 0..n-1; union by smaller root."""
    import numpy as np

    root = np.arange(n)

    def settle():
        while True:
            up = root[root]
            if (up == root).all():
                return
            root[:] = up

    for i, j in pairs:
        while True:
            settle()
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
    settle()
    return root


def rotations(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(fp, turn, code, front): the code of each fingerprint with every block of bits at the front once."""
    blocks = distance + 1
    width = 64 // blocks

    def turned(k):
        code = F.shiftleft("fp", k * width).bitwiseOR(F.shiftrightunsigned("fp", 64 - k * width)) if k else F.col("fp")
        return F.struct(F.lit(k).alias("turn"), code.alias("code"), F.shiftrightunsigned(code, 64 - width).alias("front"))

    return distinct.select("fp", F.explode(F.array(*map(turned, range(blocks)))).alias("t")).select("fp", "t.*")


def link_edges(distinct: DataFrame, distance: int = 3, n: int | None = None) -> DataFrame:
    """(u, v): spanning edges between distinct fingerprints (column ``fp``) within ``distance`` bits."""
    import numpy as np

    spark = distinct.sparkSession
    n = distinct.count() if n is None else n
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (distance + 1) * n // TASK)
    fixed = ((1 << 64 // (distance + 1)) - 1) << (64 - 64 // (distance + 1))
    codes = rotations(distinct, distance)
    # at most one row for each value of a front block, and for SLICE codes
    crowded = codes.groupBy("turn", "front").agg(F.count("*").alias("k")).where(F.col("k") > SLICE)
    sliced = codes.join(F.broadcast(crowded), ["turn", "front"], "left").withColumn("slices", F.coalesce(F.ceil(F.col("k") / SLICE), F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), "slices")
    dealt = sliced.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    dealt = dealt.select("fp", "turn", "code", "front", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).repartition(parts, "turn", "front", "i", "j")

    def link(batches):
        held = [b.to_numpy(np.int64) for b in (pdf[["fp", "code", "turn", "i", "j"]] for pdf in batches) if len(b)]
        if not held:
            return
        rows = np.concatenate(held)
        # codes of one front block stand side by side, those of a pair of slices apart
        cell, which = np.unique(rows[:, 2:], axis=0, return_inverse=True)
        for k in range(len(cell)):
            some = rows[which.ravel() == k]
            code = some[:, 1].view(np.uint64).copy()
            root = spanning_forest(len(code), GrayIndex(code).search(code, distance, front=fixed))
            moved = np.flatnonzero(root != np.arange(len(code)))
            yield pd.DataFrame({"u": some[moved, 0], "v": some[root[moved], 0]})

    return dealt.mapInPandas(link, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    marked = written(fingerprints(docs), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    parts = connected_components(link_edges(classes.select("fp"), distance))
    labelled = classes.join(parts, classes.fp == parts.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labelled = labelled.join(least, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(labelled, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
