"""Target-distribution importance resampling by bit-sliced sums.

A feature is a run of 1 to ``width`` words, and falls into one of ``buckets`` buckets.  The
corpus and the target give each bucket a gain, a whole number that goes to every task as
signed bitplanes: a plane holds one bit for each bucket, and says whether that power of two
is part of the gain's size.  A document's bucket counts become bitplanes of the same kind.
The sum of gains over its features is then exact: AND a count plane with a gain plane, count
the ones, and multiply by the two powers of two and the sign.

Only the bucket totals (at most ``buckets`` rows, whatever the corpus) reach the driver.
Ranks come from ranges of the score: rows are numbered inside a range and only the sizes of
the ranges meet.

Defined cases: null, empty and word-free texts have no features and weight 0; long texts
count whole; a null doc_id draws as the empty string and comes last among ties; repeated
rows are ranked each; an empty target or corpus counts as zeros; extra columns are ignored;
no rows give no rows.
"""

from __future__ import annotations

import math
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skycat.llm.common import written

BUCKETS, WIDTH, SEED = 10_000, 1, 2024
#: Words that a document needs to take part, and the share of these documents that is drawn.
LEAST_WORDS, PERCENT = 20, 10
#: Documents whose planes are held at once.
BLOCK = 256

#: Bytes of words: digits, ASCII letters (as lower case) and every byte of a character beyond ASCII.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_features, slots, counts): the buckets a document uses and how often, as "<u4" bytes."""

    def run(batches):
        import numpy as np

        for pdf in batches:
            rows = []
            for text in pdf.text:
                w = words(text)
                runs = [w, *(list(map(b" ".join, zip(*(w[i:] for i in range(k))))) for k in range(2, width + 1))]
                n = sum(map(len, runs))
                hashes = np.fromiter((h for r in runs for h in map(zlib.crc32, r)), np.uint32, n)
                slots, counts = np.unique(hashes % np.uint32(buckets), return_counts=True)
                rows.append((len(w), n, slots.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
            out = pd.DataFrame(rows, columns=["n_words", "n_features", "slots", "counts"])
            out.insert(0, "doc_id", pdf.doc_id.astype("Int64"))
            yield out

    text_only = docs.select(F.col("doc_id").cast("long").alias("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id"), "text")
    return text_only.mapInPandas(run, "doc_id long, n_words long, n_features long, slots binary, counts binary")


def totals(counted: DataFrame, buckets: int = BUCKETS):
    """Features of all documents by bucket: each task adds up its own documents first."""
    import numpy as np

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for slots, counts in zip(pdf.slots, pdf.counts):
                total[np.frombuffer(slots, "<u4")] += np.frombuffer(counts, "<u4")
        used = np.flatnonzero(total)
        yield pd.DataFrame({"slot": used, "n": total[used]})

    rows = counted.select("slots", "counts").mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # at most `buckets` rows
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["slot"]] = r["n"]
    return out


def gains(corpus, target) -> list[int]:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket, in doubles."""
    buckets, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return [math.floor(1000 * math.log(float((int(t) + 1) * (all_s + buckets)) / float((int(s) + 1) * (all_t + buckets)))) for s, t in zip(corpus, target)]


def bitplanes(values):
    """(powers of two, planes) of whole numbers from 0 on: bit i of plane k is bit k of value i, packed to 64-bit words."""
    import numpy as np

    values = np.asarray(values, np.int64)
    powers = range(int(values.max(initial=0)).bit_length())
    padded = np.zeros((len(powers), -(-len(values) // 64) * 64), np.uint8)
    for k in powers:
        padded[k, : len(values)] = (values >> k) & 1
    return [1 << k for k in powers], np.packbits(padded, axis=1, bitorder="little").view("<u8")


def signed_planes(gain):
    """(factors, planes): the planes of the gains above zero, then those below it with negative factors."""
    import numpy as np

    gain = np.asarray(gain, np.int64)
    up, above = bitplanes(np.maximum(gain, 0))
    down, below = bitplanes(np.maximum(-gain, 0))
    return np.array(up + [-f for f in down], np.int64), np.concatenate([above, below])


def weights(counted: DataFrame, gain: list[int]) -> DataFrame:
    """Adds ``weight``, the exact sum of gains over a document's features."""
    import numpy as np

    factors, planes = signed_planes(gain)
    width = planes.shape[1] * 64

    def block(slots, counts):
        sizes = [len(s) // 4 for s in slots]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        slot, count = (np.frombuffer(b"".join(part), "<u4") for part in (slots, counts))
        out = np.zeros(len(sizes), np.int64)
        for k in range(int(count.max(initial=0)).bit_length()):
            there = (count >> np.uint32(k)) & np.uint32(1) == 1
            rows, row = np.unique(owner[there], return_inverse=True)
            bits = np.zeros((len(rows), width), np.uint8)
            bits[row, slot[there]] = 1
            plane = np.packbits(bits, axis=1, bitorder="little").view("<u8")
            for factor, g in zip(factors, planes):
                out[rows] += np.bitwise_count(plane & g).sum(1, dtype=np.int64) * (int(factor) << k)
        return out

    def run(batches):
        for pdf in batches:
            slots, counts = list(pdf.slots), list(pdf.counts)
            parts = [block(slots[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(slots), BLOCK)]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "n_words": pdf.n_words, "n_features": pdf.n_features, "weight": np.concatenate([*parts, np.zeros(0, np.int64)])})

    return counted.mapInPandas(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED):
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))) for the first 32 bits h of sha256 of "seed:doc_id"."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank`` to written rows: 1, 2, 3... for the drawn share by falling score, null for the others."""
    spark = scored.sparkSession
    able = scored.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "weight", "n_features"]
    want = percent * able.count() // 100
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(able.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "score-ranges")
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect()}  # one row a range
    firsts, before = [], 0
    for i in sorted(sizes):
        firsts.append((i, before))
        before += sizes[i]
    first = F.broadcast(spark.createDataFrame(firsts, "range int, before long"))  # one row a range
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    placed = ranged.join(first, "range").withColumn("rank", place.cast("long")).drop("range", "before")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= want, F.col("rank")))
    return placed.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, width: int = WIDTH, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every document; rank is null where it is not drawn."""
    counted = written(bucket_counts(docs, buckets, width), "bucket-counts")
    gain = gains(totals(counted, buckets), totals(bucket_counts(target, buckets, width), buckets))
    scored = written(weights(counted, gain).withColumn("score", F.col("weight") + noise(seed)), "scored")
    return ranked(scored, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
