"""Exact n-gram Jaccard join over a token-family matrix.

Tokens are hashes of word shingles.  Documents of equal token sets are one class.  Every set
has a prefix, its rarest tokens by a frequency sketch, so long that two sets that are similar
enough share a certain number of tokens of it.  A class that shares fewer with all others
together has no partner.  The others are partitioned into groups of similar sets (by the token
of their prefix that most sets hold, which near copies nearly always have in common; large
groups are cut to bounded size), and a group links its own members first.  The matrix then
holds the tokens of the prefixes of whole families; a query looks its own prefix up there, and
their overlap says which families can hold a partner.  The query moves to their groups,
where its overlap with the union of all tokens of the group bounds the overlap with each
member: a group is opened only if the bound reaches what the query needs.

Sets that are linked already are not compared again, and of two labels only the smaller one
asks: a matrix row or a group is met only by queries whose label it exceeds.  Before the queries ask all their
groups, in ``HUBS`` rounds every set asks only the group of one holder of each of its tokens,
so that a large family of near copies grows together at a cost in proportion to its size.
Groups report spanning forests, never pairs, and components follow.

The sketch has ``SLOTS`` one-byte counters and the filter of classes with partners
``FILTER`` bits, whatever the corpus; a full filter costs moves, never links.

Defined cases: texts without words have no tokens and link with nothing; fewer words than a
shingle make one token; null doc_ids come last for the component; repeated rows are in one
class; long texts count whole, and blocks are cut by tokens too; extra columns are ignored;
no rows give no rows.  ``docs`` is read three times, so write it down first if it is costly.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycat.llm.common import bucketed, written
from skycat.llm.simhash import spanning_forest
from skycat.operators.components import connected_components

WIDTH, PERCENT = 4, 85
#: Counters of the sketch, bits of the filter, and slots that one row of either holds.
SLOTS, FILTER, ROW = 1 << 22, 1 << 24, 1 << 12
#: A task reports counters by so many above their mean and two deviations, and remembers so many sets that it has passed on.
OFTEN, KNOWN = 2, 200_000
#: Bytes that are hashed at once.
CHUNK = 1 << 16
#: A prefix is longer by one of so many tokens than a first shared token asks for, so that more tokens than one must be shared.
LONGER = 10
#: Members, queries and tokens of a block.
MEMBERS, QUERIES, TOKENS = 256, 512, 1 << 17
#: Tokens that one part of the token range holds.
PART_TOKENS = 1 << 22
#: Rounds that drop classes with too few shared tokens, and tokens of one class only.
THINNED = 1
#: Rounds in which every set asks the group of one holder of each token.
HUBS = 1


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of the word shingles of many texts, a chunk of texts at a time.

    A byte has a random 64-bit value (the same for both cases of an ASCII letter), a word the
    sum of its bytes' values times powers of an odd number, taken from running sums and
    brought to the word's start; shingles mix the words in order.
    """

    def __init__(self, width: int = WIDTH):
        import numpy as np

        draw = np.random.default_rng(4)
        value = draw.integers(1, 2**63, 256, np.uint64)
        value[65:91] = value[97:123]
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        value[self.space] = 0
        self.value, self.width, self.odd = value, width, 0x9E3779B97F4A7C15
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n):
        import numpy as np

        if len(self.powers) < n:
            n = max(n, CHUNK + 1)
            each = np.full(n, self.odd, np.uint64)
            back = np.full(n, pow(self.odd, -1, 1 << 64), np.uint64)
            each[0] = back[0] = 1
            self.powers, self.inverse = np.cumprod(each), np.cumprod(back)

    def of(self, texts):
        """One array for each text, in order."""
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) < CHUNK:
                size += len(texts[end]) + 1
                end += 1
            yield from self._chunk(texts[at:end])
            at = end

    def _chunk(self, texts):
        import numpy as np

        raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        self._grow(len(raw))
        blank = self.space[raw]
        sums = np.cumsum(self.value[raw] * self.powers[: len(raw)])
        turns = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = turns[0::2] + 1, turns[1::2]
        words = _mix((sums[ends] - sums[starts - 1]) * self.inverse[starts])
        # the words of text i are words[first[i] : first[i + 1]]
        first = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
        k = self.width
        n = max(0, len(words) - k + 1)
        every = _mix(words[:n])
        for j in range(1, k):
            every = _mix(every + words[j : j + n])
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                h = np.sort(every[a : b - k + 1])
                yield h[np.append(True, h[1:] != h[:-1])]
            elif b > a:  # fewer words than a shingle: the whole sequence, seeded by its length
                h = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    h = _mix(h + w)
                yield h
            else:
                yield words[:0]


def needed(n, percent: int = PERCENT):
    """Tokens that a set of n tokens shares with every partner, at least."""
    return F.floor((percent * n + 99) / 100) if isinstance(n, Column) else (percent * n + 99) // 100


def met(n, percent: int = PERCENT):
    """Tokens of its prefix that a set of n tokens shares with the prefix of every partner, at least.

    The prefix leaves out needed(n) - 1 - n // LONGER tokens, the last ones in the common
    order.  So of the needed(n) shared tokens 1 + n // LONGER at least are in the shorter of
    two prefixes, and a partner has needed(n) tokens itself.
    """
    return 1 + (F.floor(needed(n, percent) / LONGER) if isinstance(n, Column) else needed(n, percent) // LONGER)


def described(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(digest, doc_id, n) of every document, and (slot, seen) of the task's frequent counters, in one pass."""

    def run(batches):
        import numpy as np
        import xxhash

        count, total = np.zeros(SLOTS, np.uint32), 0
        shingles = Shingles(width)
        for pdf in batches:
            rows = []
            for t in shingles.of(pdf.text):
                rows.append((xxhash.xxh128_digest(t.tobytes()), len(t)))
                np.add.at(count, (t % np.uint64(SLOTS)).astype(np.int64), np.uint32(1))
                total += len(t)
            out = pd.DataFrame(rows, columns=["digest", "n"])
            out.insert(1, "doc_id", pdf.doc_id.astype("Int64").mask(pdf.missing))
            yield out.assign(slot=pd.array([pd.NA] * len(out), "Int32"), seen=pd.array([pd.NA] * len(out), "Int64"))
        mean = total / SLOTS
        often = np.flatnonzero(count > OFTEN + mean + 2 * mean**0.5)
        for at in range(0, len(often), 100_000):
            part = often[at : at + 100_000]
            yield pd.DataFrame({"digest": None, "doc_id": pd.array([pd.NA] * len(part), "Int64"), "n": pd.array([pd.NA] * len(part), "Int64"), "slot": part, "seen": count[part]})

    # pandas makes doubles of a column of numbers with nulls, and these do not hold every id
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("missing"), "text").mapInPandas(run, "digest binary, doc_id long, n long, slot int, seen long")


def _table(rows: DataFrame, slots: int, pack):
    """``pack`` of the values (slot, seen) of each row of ``ROW`` slots, side by side: one array of fixed size."""
    import numpy as np

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(ROW, np.int64)
        held[pdf.slot.to_numpy() % ROW] = pdf.seen.to_numpy()
        return pd.DataFrame({"part": [int(pdf.slot.iat[0]) // ROW], "held": [pack(held).tobytes()]})

    size = len(pack(np.zeros(ROW, np.int64)))
    out = np.zeros((slots // ROW, size), np.uint8)
    summed = rows.groupBy("slot").agg(F.sum("seen").alias("seen"))
    # at most slots / ROW rows, whatever the corpus
    for r in summed.groupBy(F.floor(F.col("slot") / ROW)).applyInPandas(fold, "part long, held binary").collect():
        out[r["part"]] = np.frombuffer(r["held"], np.uint8)
    return out.ravel()


def sketch(rows: DataFrame):
    """Eight steps to a doubling of the count, one byte for each counter."""
    import numpy as np

    return _table(rows, SLOTS, lambda v: np.minimum(255, 8 * np.log2(1.0 + v)).astype(np.uint8))


def filter_bits(digests: DataFrame):
    """One bit for each value of the first three bytes of a digest."""
    import numpy as np

    return _table(digests.select(F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int").alias("slot"), F.lit(1).alias("seen")), FILTER, lambda v: np.packbits(v > 0, bitorder="little"))


def prefixes(docs: DataFrame, rarity, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(digest, prefix): the rarest tokens of each set, once for each task that holds it."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)  # SLOTS bytes

    def run(batches):
        import numpy as np
        import xxhash

        known, rare, shingles = set(), shared.value, Shingles(width)
        for pdf in batches:
            rows = []
            for t in shingles.of(pdf.text):
                digest = xxhash.xxh128_digest(t.tobytes())
                if not len(t) or digest in known:
                    continue
                known.add(digest)
                keep = len(t) - needed(len(t), percent) + 1 + len(t) // LONGER
                # rare first, then by hash: one order for all sets
                order = (rare[t % np.uint64(SLOTS)].astype(np.uint64) << np.uint64(56)) | (t >> np.uint64(8))
                rows.append((digest, keep, t[np.argsort(order, kind="stable")[:keep]].tobytes()))
            if len(known) > KNOWN:
                known.clear()
            yield pd.DataFrame(rows, columns=["digest", "keep", "prefix"])

    return docs.select("text").mapInPandas(run, "digest binary, keep long, prefix binary")


def _runs(pdf):
    """Tokens of a batch in order, the rows that hold them, and for each whether the batch holds it more than once and whether it is the first."""
    import numpy as np

    prefixes = [_place(b) for b in pdf.prefix]
    t = np.concatenate([*prefixes, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(len(prefixes)), [len(x) for x in prefixes])
    order = np.argsort(t, kind="stable")
    t, row = t[order], row[order]
    again = np.append(False, t[1:] == t[:-1]) if len(t) else np.zeros(0, bool)
    return t, row, again | np.append(again[1:], False)[: len(t)], ~again


def shared_tokens(held: DataFrame) -> DataFrame:
    """(token, uid): all rows that hold a token which more than one row holds.

    Tokens that a batch holds more than once are shared, and the batch says so by itself.  Of
    every token one holder a batch goes on, in blocks of eight bytes a token and two or four
    a row, to a part of the token range, where the tokens of several batches come to light.
    So a token that very many rows hold moves once a batch, not once a row.
    """
    spark = held.sparkSession
    total = held.agg(F.sum("keep")).first()[0] or 0
    bits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_TOKENS).bit_length()

    def alone(batches):
        for pdf in batches:
            t, row, several, _ = _runs(pdf)
            yield pd.DataFrame({"token": t[several].view("int64"), "uid": pdf.uid.to_numpy()[row[several]]})

    def blocks(batches):
        import numpy as np

        for pdf in batches:
            t, row, several, first = _runs(pdf)
            t, row, several = t[first], row[first], several[first]
            uid, part = pdf.uid.to_numpy()[row], (t >> np.uint64(64 - bits)).astype(np.int64)
            # a batch may hold rows of several files, and their uids lie further apart than four bytes reach
            base = uid >> 32 << 32
            order = np.lexsort((base, part))
            t, uid, part, base, several = t[order], uid[order], part[order], base[order], several[order]
            offset = (uid - base).astype("<u4")
            cuts = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (base[1:] != base[:-1]))) if len(t) else np.zeros(0, np.int64)
            ends = np.append(cuts[1:], len(t))
            yield pd.DataFrame({"part": part[cuts], "base": base[cuts], "tokens": [t[a:b].tobytes() for a, b in zip(cuts, ends)], "offsets": [offset[a:b].tobytes() for a, b in zip(cuts, ends)], "several": [np.packbits(several[a:b]).tobytes() for a, b in zip(cuts, ends)]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        each = [_place(b) for b in pdf.tokens]
        t = np.concatenate(each)
        uid = np.concatenate([np.frombuffer(o, "<u4").astype(np.int64) + b for o, b in zip(pdf.offsets, pdf.base)])
        told = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(x)) for s, x in zip(pdf.several, each)]).astype(bool)
        order = np.argsort(t, kind="stable")
        t, uid, told = t[order], uid[order], told[order]
        again = np.append(False, t[1:] == t[:-1])
        new = (again | np.append(again[1:], False)) & ~told
        return pd.DataFrame({"token": t[new].view("int64"), "uid": uid[new]})

    rows = held.select("uid", "prefix")
    met = rows.mapInPandas(blocks, "part long, base long, tokens binary, offsets binary, several binary").groupBy("part").applyInPandas(meet, "token long, uid long")
    return rows.mapInPandas(alone, "token long, uid long").union(met)


def sets_of(docs: DataFrame, bits, width: int = WIDTH) -> DataFrame:
    """(digest, tokens) of the sets that the filter lets through, once for each task that holds them."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # FILTER / 8 bytes

    def run(batches):
        import xxhash

        known, held, shingles = set(), shared.value, Shingles(width)
        for pdf in batches:
            rows = []
            for t in map(bytes, shingles.of(pdf.text)):
                digest = xxhash.xxh128_digest(t)
                at = int.from_bytes(digest[:3], "big")
                if t and (held[at >> 3] >> (at & 7)) & 1 and digest not in known:
                    known.add(digest)
                    rows.append((digest, t))
            if len(known) > KNOWN:
                known.clear()
            yield pd.DataFrame(rows, columns=["digest", "tokens"])

    return docs.select("text").mapInPandas(run, "digest binary, tokens binary")


def _place(token_bytes):
    import numpy as np

    return np.frombuffer(token_bytes, np.uint64)


class Union:
    """The union of the token sets of a group, and which member holds which of its tokens."""

    def __init__(self, sets):
        import numpy as np

        self.sizes = np.array([len(s) for s in sets])
        self.tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
        self.has = np.zeros((len(self.tokens), len(sets)), np.uint8)
        self.has[place, np.repeat(np.arange(len(sets)), self.sizes)] = 1

    def partners(self, query, percent: int):
        """Members similar enough to the query, or none without a look at them if the bound forbids it."""
        import numpy as np

        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        if len(at) < needed(len(query), percent):
            return at[:0]
        both = self.has[at].sum(0, dtype=np.int64)
        return np.flatnonzero(100 * both >= percent * (len(query) + self.sizes - both))


def _forest(labels, pairs):
    """(u, v) that join the labels as the pairs of positions do."""
    import numpy as np

    names, number = np.unique(labels, return_inverse=True)
    root = spanning_forest(len(names), [(number[i], number[j]) for i, j in pairs])
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"u": names[moved], "v": names[root[moved]]})


def inside_links(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v): a spanning forest of the links inside each group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        sets = [_place(b) for b in pdf.tokens]
        union = Union(sets)
        found = [union.partners(s, percent) for s in sets]
        return _forest(pdf.cid.to_numpy(np.int64), [(np.full(len(f), i), f) for i, f in enumerate(found)])

    return members.where("several").groupBy("grp").applyInPandas(run, "u long, v long")


def matrix(postings: DataFrame) -> DataFrame:
    """(token, family, top, least, most): the rows of the token-family matrix with the greatest label and the sizes of the family's holders."""
    return postings.groupBy("token", "family").agg(F.max(F.struct("size", "label")).alias("top"), F.min("n").alias("least"), F.max("n").alias("most"))


def fits(a: str, b: str, percent: int = PERCENT) -> str:
    """Whether sets of these sizes can be similar enough."""
    return f"100 * {a} >= {percent} * {b} and 100 * {b} >= {percent} * {a}"


def hub_queries(postings: DataFrame, attempt: int, percent: int = PERCENT) -> DataFrame:
    """(q, q_grp, grp, q_n): every set with the groups of one holder of each of its tokens, drawn by a hash."""
    hub = F.min_by(F.struct("label", "grp", "n"), F.xxhash64("cid", F.lit(attempt)))
    hubs = postings.groupBy("token").agg(hub.alias("hub")).select("token", F.col("hub.label").alias("h_label"), F.col("hub.grp").alias("h_grp"), F.col("hub.n").alias("h_n"))
    asked = postings.join(hubs, "token").where(f"label <> h_label and grp <> h_grp and {fits('n', 'h_n', percent)}")
    return asked.groupBy(F.col("cid").alias("q"), F.col("h_grp").alias("grp")).agg(F.first("grp").alias("q_grp"), F.first("n").alias("q_n"))


def qualifying(postings: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(q, q_grp, grp, q_n): queries with the groups of other labels that can hold a partner.

    Labels are ordered by their number of classes, and a class asks only where a greater label
    is: so one side asks for each pair of labels, and the largest family of linked sets asks
    nobody.  A query meets the matrix once for each token and family, however many groups the
    family is cut into, and goes on to those of its groups that have a greater label.
    """
    queries = postings.select("token", F.col("cid").alias("q"), F.col("grp").alias("q_grp"), "size", "label", F.col("n").alias("q_n"))
    near = F.expr(f"top > struct(size, label) and 100 * q_n >= {percent} * least and 100 * most >= {percent} * q_n")
    found = queries.join(matrix(postings), "token").where(near)
    # the tokens shared with the family's prefixes bound those shared with one of its members
    counted = found.groupBy("q", "family").agg(*(F.first(c).alias(c) for c in ("q_grp", "q_n", "size", "label")), F.count("*").alias("tokens"))
    counted = counted.where(F.col("tokens") >= met(F.col("q_n"), percent)).drop("tokens")
    held = members.groupBy("family", "grp").agg(F.max(F.struct("size", "label")).alias("top"), F.min("n").alias("least"), F.max("n").alias("most"))
    return counted.join(held, "family").where(near).where("grp <> q_grp").select("q", "q_grp", "grp", "q_n")


def opened_links(pairs: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v): a spanning forest of the links between queries and groups.

    Queries meet a group in blocks of bounded tokens, each with the group's sets.  ``members``
    lies in buckets of the group, so that only groups that ask or are asked move.
    """

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(asked) or not len(held):
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        union = Union([_place(b) for b in held.tokens])
        found = [union.partners(_place(b), percent) for b in asked.q_tokens]
        both = np.concatenate([held.cid.to_numpy(np.int64), asked.q.to_numpy(np.int64)])
        return _forest(both, [(np.full(len(f), len(held) + i), f) for i, f in enumerate(found)])

    load = pairs.groupBy("grp").agg(F.count("*").alias("queries"), F.sum("q_n").alias("q_tokens"))
    load = load.select("grp", F.greatest(F.ceil(F.col("queries") / QUERIES), F.ceil(F.col("q_tokens") / TOKENS)).alias("blocks"))
    asking = members.join(pairs.select(F.col("q_grp").alias("grp")).distinct().hint("merge"), "grp", "left_semi").select(F.col("cid").alias("q"), F.col("tokens").alias("q_tokens"))
    asked = pairs.join(load, "grp").select("q", "grp", F.pmod(F.xxhash64("q"), "blocks").alias("block"))
    asked = asked.join(asking, "q").select(F.col("grp").alias("q_grp"), F.col("block").alias("q_block"), "q", "q_tokens")
    held = members.join(load.hint("merge"), "grp").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return asked.groupBy("q_grp", "q_block").cogroup(held.select("grp", "block", "cid", "tokens").groupBy("grp", "block")).applyInPandas(run, "u long, v long")


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(cid, label) with the labels that the edges between classes join."""
    of = lambda c: labels.select(F.col("cid").alias(c), F.col("label").alias(f"{c}_label"))
    joined = edges.join(of("u"), "u").join(of("v"), "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
    parts = connected_components(joined)
    return written(labels.join(parts, labels.label == parts.node, "left").select("cid", F.coalesce("component", "label").alias("label")), "jaccard-labels")


def sized(labels: DataFrame) -> DataFrame:
    """Adds ``size``, the number of classes of each label."""
    return labels.join(labels.groupBy("label").agg(F.count("*").alias("size")), "label")


def groups(partnered: DataFrame) -> DataFrame:
    """Adds ``grp`` and ``several``: families of similar sets, cut by classes and tokens into groups of bounded size, and whether the family has more than one set."""
    size = partnered.groupBy("family").agg(F.count("*").alias("k"), F.sum("n").alias("k_tokens"))
    size = size.select("family", (F.col("k") > 1).alias("several"), F.greatest(F.ceil(F.col("k") / MEMBERS), F.ceil(F.col("k_tokens") / TOKENS)).alias("cuts"))
    return partnered.join(size, "family").withColumn("grp", F.xxhash64("family", F.pmod(F.xxhash64("cid"), "cuts"))).drop("cuts")


def hinted(hints: DataFrame, partnered: DataFrame) -> DataFrame:
    """(q, q_grp, grp, q_n): pairs (u, v) of classes as queries, where both have a partner and lie in different groups."""
    of = lambda c: partnered.select(F.col("cid").alias(c), F.col("grp").alias(f"{c}_grp"), F.col("n").alias(f"{c}_n"))
    both = hints.join(of("u"), "u").join(of("v"), "v").where("u_grp <> v_grp")
    return both.select(F.col("u").alias("q"), F.col("u_grp").alias("q_grp"), F.col("v_grp").alias("grp"), F.col("u_n").alias("q_n")).distinct()


def class_labels(docs: DataFrame, classes: DataFrame, seen: DataFrame, width: int = WIDTH, percent: int = PERCENT, hints: DataFrame | None = None) -> DataFrame:
    """(cid, label) of the written classes (digest, cid, n) that have a partner by their prefixes.

    ``hints`` are pairs (u, v) of classes that are worth a look first; they are verified like
    all others, and whatever they lack is found without them.
    """
    held = written(prefixes(docs, sketch(seen), width, percent).withColumn("uid", F.monotonically_increasing_id()), "prefixes")
    rows = written(shared_tokens(held), "shared-tokens")
    # one of the rows of each class: copies of a set hold the same tokens
    chosen = held.groupBy("digest").agg(F.min("uid").alias("uid"))
    uids = chosen.join(classes.select("digest", "cid"), "digest").select("uid", "cid")
    found = written(rows.join(uids, "uid").select("token", "cid"), "token-classes")
    for _ in range(THINNED):
        # copies of one set in several tasks share their tokens with themselves only
        common = found.groupBy("token").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("holders")).where("lo < hi").select("token", "holders")
        shared = found.select("token", "cid").join(common, "token")
        # the tokens that a class shares with all others bound those that it shares with one
        able = shared.groupBy("cid").agg(F.count("*").alias("tokens")).join(classes, "cid").where(F.col("tokens") >= met(F.col("n"), percent)).select("cid")
        found = written(shared.join(able, "cid", "left_semi"), "shared-tokens")
    family = found.groupBy("cid").agg(F.max(F.struct("holders", "token"))["token"].alias("family"))
    partnered = written(groups(classes.join(family, "cid")), "jaccard-groups")
    sets = sets_of(docs, filter_bits(partnered.select("digest")), width).join(partnered, "digest").dropDuplicates(["digest"])
    members = bucketed(sets.select("cid", "grp", "several", "tokens"), "grp", "group-sets")
    placed = written(found.select("token", "cid").join(partnered.select("cid", "family", "grp", "n"), "cid"), "postings")
    labels = relabelled(partnered.select("cid", F.col("cid").alias("label")), written(inside_links(members, percent), "jaccard-links"))
    if hints is not None:
        pairs = written(hinted(hints, partnered), "jaccard-queries")
        labels = relabelled(labels, written(opened_links(pairs, members, percent), "jaccard-links"))
    for attempt in range(HUBS + 1):
        known = written(sized(labels), "jaccard-sizes")
        now = placed.join(known, "cid")
        # a token whose holders are linked already leads to nothing new, now or later
        open_tokens = now.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
        postings = written(now.join(open_tokens, "token"), "open-postings")
        asking = hub_queries(postings, attempt, percent) if attempt < HUBS else qualifying(postings, partnered.join(known, "cid"), percent)
        pairs = written(asking, "jaccard-queries")
        labels = relabelled(labels, written(opened_links(pairs, members, percent), "jaccard-links"))
        placed = postings.drop("label", "size")
    return labels


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    every = written(described(docs, width), "described")
    rows, seen = every.where("slot is null").select("digest", "doc_id", "n"), every.where("slot is not null").select("slot", "seen")
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    labels = class_labels(docs, classes.select("digest", "cid", "n"), seen, width, percent)
    labelled = classes.join(labels, "cid", "left").select("digest", "first_id", F.coalesce("label", "cid").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = labelled.join(least, "label").select("digest", "component_id")
    linked = rows.where("n > 0").join(of, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(rows.where("n = 0").select("doc_id", "n", "doc_id"))
