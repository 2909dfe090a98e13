"""Importance resampling, spelling variants and the Jaccard join against brute force and their SQL."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from conftest import DATA
from test_oracles import rows

from skycat.llm import importance, jaccard, packing, queries, spelling


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t[:-8]} as select * from '{DATA}/{t}'")
    return con


@pytest.mark.parametrize("name", ["op11_importance", "op12_spelling", "op13_jaccard"])
def test_whole_tables(spark, duck, name):
    ours, theirs = queries.queries()[name](spark, DATA).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert set(ours.columns) == set(theirs.columns) and len(ours)
    assert rows(ours) == rows(theirs)


def docs(spark, texts, ids=None):
    """Extra columns carry names that the operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in zip(ids, texts)], "doc_id long, text string, word string, score int, slot int, label int")


# --- importance ------------------------------------------------------------------------
def test_bit_planes_give_exact_sums(spark):
    draw = random.Random(3)
    texts = [None, "", "...", "Ab c-d AB é ÉÀ", *(" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.randint(0, 400))) for _ in range(300)), "w " * 70_000]
    gain = [draw.randint(-9000, 9000) for _ in range(64)]
    counted = importance.bucket_counts(docs(spark, texts), 64)
    got = {r.doc_id: (r.n_features, r.weight) for r in importance.weights(counted, gain).collect()}
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        assert got[i] == (len(w), sum(gain[zlib.crc32(x.encode()) % 64] for x in w))


def test_runs_of_two_words(spark):
    (row,) = importance.bucket_counts(docs(spark, ["a b a b"]), 1000, 2).collect()
    want = Counter(zlib.crc32(x) % 1000 for x in (b"a", b"b", b"a", b"b", b"a b", b"b a", b"a b"))
    slots, counts = (list(memoryview(x).cast("I")) for x in (row.slots, row.counts))
    assert dict(zip(slots, counts)) == want and row.n_features == 7 and row.n_words == 4


def test_draws_with_ties_nulls_and_repeats(spark):
    words = " ".join(f"w{i}" for i in range(25))
    table = docs(spark, [words] * 30 + [None, "", "short one"], [7] * 10 + [None] * 5 + list(range(100, 115)) + [200, 201, 202])
    out = importance.resample(table, docs(spark, ["w1 w2"]), percent=50).toPandas()
    assert len(out) == 33 and sorted(out["rank"].dropna()) == list(range(1, 16))
    drawn = out[out["rank"].notna()].sort_values("rank")
    assert list(drawn.score) == sorted(drawn.score, reverse=True)
    assert drawn.score.min() >= out[(out.n_features >= 20) & out["rank"].isna()].score.max()
    h = int(hashlib.sha256(b"2024:100").hexdigest()[:8], 16)
    one = out[out.doc_id == 100].iloc[0]
    assert one.score - one.weight == math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))


def test_importance_of_empty_tables(spark):
    none = docs(spark, ["x"]).limit(0)
    assert importance.resample(none, docs(spark, ["a"])).count() == 0
    assert [r.weight for r in importance.resample(docs(spark, [None]), none).collect()] == [0]


# --- spelling --------------------------------------------------------------------------
def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_neighbours_by_brute_force(spark):
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("aabé") for _ in range(draw.randint(4, 7))) for _ in range(300)} | {"aaaa", "aaaaa", "aaaaaa"})
    count = {w: draw.choice([1, 1, 2, 3, 5, 9, 20, 50]) for w in words}
    formed = spelling.forms(spark.createDataFrame(list(count.items()), "word string, n long"))
    got = {r.word: r for r in spelling.roots(formed).collect()}
    forms = {}
    for w in words:
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-count[v], v), default=None)
        forms[w] = best if best and count[best] >= 2 * count[w] else None
        assert (got[w].n_near, got[w].form, got[w].form_n) == (len(close), forms[w], count.get(forms[w]))
    for w in words:
        end = w
        while forms[end]:
            end = forms[end]
        assert got[w].root == end


def test_words_of_texts(spark):
    texts = [None, "", "123 --", "Naïve naïve NAÏVE ×÷abc", "hello " * 50_000, "hello", "hello"]
    table = docs(spark, texts, [None, 1, 2, 3, 4, None, None])
    want = Counter()
    for i, t in zip([None, 1, 2, 3, 4, None, None], texts):
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += len(w) >= 5
    got = {r.word: r.n for r in spelling.word_counts(table, least_count=1).collect()}
    assert got == {w: n for w, n in want.items() if n}
    assert spelling.variants(table.limit(0)).count() == 0


# --- jaccard ---------------------------------------------------------------------------
def components(texts, ids):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(set(zip(*(w[i:] for i in range(4)))) if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(ids[i])
    return sorted((str(ids[i]), len(sets[i]), str(min((x for x in groups[find(i)] if x is not None), default=None))) for i in range(len(texts)))


def family(draw, base, edits):
    words = base.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("members, tokens", [(128, 1 << 18), (3, 400)])
def test_components_by_brute_force(spark, monkeypatch, members, tokens):
    """Families of near copies, chains, shared passages and short texts, with groups and blocks of both usual and very small size."""
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    monkeypatch.setattr(jaccard, "QUERIES", members)
    monkeypatch.setattr(jaccard, "TOKENS", tokens)
    draw = random.Random(11)
    bases = [" ".join(f"v{draw.randrange(3000)}" for _ in range(draw.randint(30, 150))) for _ in range(12)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [family(draw, draw.choice(bases), draw.randint(0, 5)) for _ in range(150)]
    texts += [f"{family(draw, bases[0], 25)} {passage} {i}" for i in range(15)] + [f"{passage} tail {i % 3}" for i in range(9)]
    texts += [" ".join(f"c{k + i}" for k in range(100)) for i in range(0, 60, 3)]  # a chain: only neighbours link
    texts += [None, "", " \n", "one", "One", "a b", "a b c", "a b c d", "x " * 30_000]
    ids = list(range(1000, 1000 + len(texts)))
    ids[5] = ids[-1] = None
    texts += texts[:4]
    ids += ids[:4]
    got = jaccard.jaccard_components(docs(spark, texts, ids)).collect()
    show = lambda v: str(None if v is None else int(v))
    assert sorted((show(r.doc_id), r.n_shingles, show(r.component_id)) for r in got) == components(texts, ids)


def test_jaccard_over_many_tasks_with_large_and_null_ids(spark):
    """Prefixes that several tasks wrote meet in one batch, and ids that no double holds stand beside null ones."""
    draw = random.Random(5)
    bases = [" ".join(f"v{draw.randrange(3000)}" for _ in range(60)) for _ in range(40)]
    texts = [family(draw, base, edits) for base in bases for edits in (0, 1, 1)]
    ids = [None if i % 11 == 3 else 2**62 + i for i in range(len(texts))]
    got = jaccard.jaccard_components(docs(spark, texts, ids).repartition(24)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(texts, ids)


def test_jaccard_asks_a_family_once_a_token(spark, monkeypatch):
    """Linked sets do not ask the few others of their family, and a query meets a token once a family, not once a group."""
    from pyspark.sql import Row

    size = {7: 40, **{k: 1 for k in range(100, 120)}}
    held = [(cid, 7 if cid < 40 else cid + 60) for cid in range(60)]
    rows = [Row(token=t, cid=cid, grp=cid % 10, family=1, label=label, size=size[label], n=10) for cid, label in held for t in (1, 2, 3)]
    seen = []
    monkeypatch.setattr(jaccard, "matrix", lambda p, f=jaccard.matrix: seen.append(f(p)) or seen[-1])
    postings = spark.createDataFrame(rows)
    got = jaccard.qualifying(postings, postings.where("token = 1").drop("token")).collect()
    assert seen[0].count() == 3
    assert {r.q for r in got} == set(range(40, 60)) and len(got) == 20 * 9


def test_jaccard_of_empty_table(spark):
    assert jaccard.jaccard_components(docs(spark, ["x"]).limit(0)).count() == 0


# --- packing rule ----------------------------------------------------------------------
def one_by_one(histogram, limit):
    """Loads of packs when every length, longest first, goes into the shortest pack that exists, or a new one if that has no room."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            shortest = min(range(len(packs)), key=packs.__getitem__, default=None)
            if shortest is None or packs[shortest] + length > limit:
                packs.append(length)
            else:
                packs[shortest] += length
    return sorted(packs)


def test_shortest_pack_takes_the_length():
    assert packing.shortest_pack_first({1500: 1, 1000: 1, 300: 1}) == [(1, (1000, 300)), (1, (1500,))][::-1]
    assert packing.shortest_pack_first({}) == []
    for seed in range(100):
        draw = random.Random(seed)
        histogram = {draw.randint(1, 2048 if seed % 2 else 300): draw.randint(1, 30) for _ in range(draw.randint(1, 30))}
        patterns = packing.shortest_pack_first(histogram)
        assert sorted(sum(p) for n, p in patterns for _ in range(n)) == one_by_one(histogram, 2048)
        placed = Counter()
        for n, p in patterns:
            placed.update({length: n * times for length, times in Counter(p).items()})
        assert placed == histogram
