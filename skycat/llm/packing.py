"""Shortest-pack-first packing over the length histogram.

Documents are cut into pieces of at most ``limit`` tokens; only the histogram of piece
lengths (at most ``limit`` entries) reaches the driver.  Lengths are placed longest first,
each into the shortest pack so far; patterns are counted, never listed one sequence at a
time.  The plan joins back to the pieces by their
rank within a length.

Defined cases: null text packs as the end id alone; repeated ids stay separate rows; no
rows give no sequences; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

LIMIT = 2048
END_ID = 1
SUBGROUP = 250


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, limit: int = LIMIT, ids: bool = True, keep: bool = True) -> DataFrame:
    """(row, doc_id, start, length, doc_tokens, ids_crc32[, ids]) for every piece of every document.

    ``row`` tells rows apart that share a doc_id; write the pieces down before they are used
    twice, so that it stays the same.  With ``keep`` a worker's encoder keeps its cache for
    the next task; without it the memory is free for what runs beside or after this stage.
    """
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "doc_id", "start", "length", "doc_tokens", "ids_crc32")])
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batches):
        import numpy as np

        from skycat.llm.word_tokens import word_tokens

        words = word_tokens(tokenizer)
        for pdf in batches:
            rows = []
            for row, doc_id, text in zip(pdf.row, pdf.doc_id, pdf.text):
                all_ids = np.append(np.frombuffer(words.ids(text), f"<u{words.width}").astype("<u4"), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(all_ids), limit):
                    part = all_ids[start : start + limit]
                    rows.append((row, doc_id, start, len(part), len(all_ids), zlib.crc32(part.tobytes()), *([part.astype("int32")] if ids else [])))
            words.trim()
            out = pd.DataFrame(rows, columns=schema.names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out
        if not keep:
            words.forget()

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def shortest_pack_first(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, tuple[int, ...]]]:
    """[(count, lengths)] of packing patterns: lengths longest first, each into the shortest pack, the one with the most room.

    A length opens new packs only when not even the shortest pack holds it.  All packs of one
    room are alike, so whole counts of a pattern move at once; a pack that has received a
    length has less room and stands behind the others until its turn comes again.
    """
    open_patterns: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # room left -> pattern -> count
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, choices in open_patterns.items() if choices), default=0)
            if room < length:
                # a new pack is the only one with room: it takes the length until it is full
                full, rest = divmod(left, limit // length)
                for count, times in ((full, limit // length), (1, rest)):
                    if count and times:
                        new = open_patterns[limit - length * times]
                        new[(length,) * times] = new.get((length,) * times, 0) + count
                break
            pattern, count = open_patterns[room].popitem()
            used = min(left, count)
            if used < count:
                open_patterns[room][pattern] = count - used
            target = open_patterns[room - length]
            target[pattern + (length,)] = target.get(pattern + (length,), 0) + used
            left -= used
    return [(count, pattern) for room in sorted(open_patterns) for pattern, count in sorted(open_patterns[room].items())]


def plan_slots(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) for every slot of every pattern."""
    slots, used, sequence = [], defaultdict(int), 0
    for count, pattern in shortest_pack_first(histogram, limit):
        offset = 0
        for length in pattern:
            slots.append((length, used[length], used[length] + count, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return slots


def rank_in_length(pieces: DataFrame) -> DataFrame:
    """Rank of each piece within its length, without bringing a length into one task.

    Each length is dealt over sub-groups of about ``SUBGROUP`` pieces by a hash of the
    piece's row key, so that repeated rows and null ids are spread too; only the counts of
    the sub-groups meet to give each its first rank.  Lengths that hold few pieces share
    their tasks.
    """
    counts = pieces.groupBy("length").agg(F.count("*").alias("n_length"))
    parts = F.greatest(F.lit(1), F.floor(F.col("n_length") / SUBGROUP))
    salted = pieces.join(F.broadcast(counts), "length").withColumn("part", F.pmod(F.xxhash64("row", "start"), parts).cast("long")).drop("n_length")
    firsts = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    firsts = firsts.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("row", "start")) - 1
    ranked = salted.withColumn("within", within)
    return ranked.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("within")).drop("first", "within", "part")


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to written pieces (they are read three times)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    slots = plan_slots(histogram, limit)
    plan = spark.createDataFrame(slots, "length long, lo long, hi long, first_sequence long, offset long")
    ranked = rank_in_length(pieces).alias("p")
    # the plan grows with the number of lengths (at most `limit`), never with the documents
    joined = ranked.join(F.broadcast(plan).alias("s"), (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return joined.select(*(f"p.{c}" for c in pieces.columns if c != "row"), (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ids in offset order, bounded by the limit."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
