"""The ten operators and the pipeline: brute force, round trips, held-out accuracy, edge rows."""

import base64
import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from skycat.llm import byte_bpe, html_text, licences, media, packing, pii, quality_classifier, quality_rules, queries, simhash, token_files
from skycat.llm.word_tokens import word_tokens
from skycat.operators.components import connected_components

WORD_FILE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "a b c a b c"), (6, "a b c a b c"), (7, "It's ΣΑΣ 日本 😀\x1c\x85 end.\r\n\n x"),
    (8, "word " * 3000), (None, "no id"), (9, "CC BY cc by, All rights reserved. General Public License"), (10, "mail a.b@mail1.example.com or +1 (017) 555-7713, 4785380592391139 at 152.143.123.131 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "length": F.lit(-1), "failed": F.lit("x")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_word_tokens_equal_the_library():
    w, rng = word_tokens(WORD_FILE), random.Random(5)
    some = ["", "ΣΑΣ ςΣ'S it's", "<|endoftext|> x", "日本語 123 ４５", "é x̣́y", "İstanbul ǅ", "a\r\nb\n\nc", "😀 don't!!!", "ß ﬁ ½", "a ́b", "x" * 3000]
    some += ["".join(rng.choice("ab \n\té日1'sT.!\x1c\x85　😀À") for _ in range(rng.randint(0, 30))) for _ in range(1000)]
    for s in some:
        assert np.frombuffer(w.ids(s), "<u2").tolist() == w.tokenizer.encode(s, add_special_tokens=False).ids


def test_packing(spark, docs, edge, empty, texts):
    rng, h = random.Random(1), defaultdict(int)
    for _ in range(5000):
        h[min(2048, int(rng.lognormvariate(6, 1)) + 1)] += 1
    placed = Counter()
    for n, lengths in packing.shortest_pack_first(dict(h)):
        assert sum(lengths) <= 2048
        for x in lengths:
            placed[x] += n
    assert placed == h
    for df in (docs, edge):
        pieces = packing.token_pieces(df, WORD_FILE).cache()
        got = packing.pack(pieces).toPandas()
        assert len(got) == pieces.count()
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
        assert got.length.sum() == got[got.start == 0].doc_tokens.sum()
        assert packing.sequences(packing.pack(pieces)).count() == got.sequence_id.nunique()
    whole, pieces = {i: np.array(word_tokens(WORD_FILE).tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}, defaultdict(list)
    for r in queries.op1_packing(spark, DATA).collect():
        ids = whole[r.doc_id]
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids[r.start : r.start + r.length].tobytes()))
        pieces[r.doc_id].append((r.start, r.length))
    for i, cut in pieces.items():
        assert [s for s, _ in sorted(cut)] == [sum(n for _, n in sorted(cut)[:k]) for k in range(len(cut))] and sum(n for _, n in cut) == len(whole[i])
    assert set(pieces) == set(whole)
    alike = spark.createDataFrame([(None, "same row")] * 3000, "doc_id long, text string")
    got = packing.pack(queries.written(packing.token_pieces(alike, WORD_FILE), "pieces"))
    assert got.count() == 3000 and got.select("sequence_id", "offset").distinct().count() == 3000
    assert packing.pack(packing.token_pieces(empty, WORD_FILE)).count() == 0


def test_byte_bpe_equals_tiktoken(spark, texts, edge, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib, own, rng = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.byte_bpe(RANKS, P.PATTERN), random.Random(2)
    for s in ["".join(rng.choice("ab \n\té日1'sT.!\x1c\x85　😀À\x00") for _ in range(rng.randint(0, 30))) for _ in range(1500)]:
        ids = np.frombuffer(own.encode(s), "<u4").tolist()
        assert ids == lib.encode_ordinary(s) and own.decode(ids) == s.encode()
    for r in queries.op2_byte_bpe(spark, DATA).collect():
        a = np.array(lib.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(a), hashlib.sha256(a.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    back = byte_bpe.decode(byte_bpe.encode(edge, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back) == Counter((i, (t or "").encode()) for i, t in EDGE)
    assert byte_bpe.encode(empty, RANKS, P.PATTERN).count() == 0


def test_classifier_on_held_out_rows(spark, docs, edge, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = queries.op3_quality_classifier(spark, DATA).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0)).all()
    assert (held.predicted == held.quality).mean() > 0.85
    scored = quality_classifier.classify(edge, labels).toPandas()
    assert len(scored) == len(EDGE) and scored.score.between(0, 1).all()
    assert quality_classifier.classify(empty, labels).count() == 0
    assert (quality_classifier.classify(edge, labels.limit(0)).toPandas().score == 0.5).all()


def test_classifier_against_brute_force(spark, texts):
    """Densities by determinant and inverse of plain covariances, over every document."""
    stats = {i: np.array(quality_classifier.document_statistics(t)) for i, t in texts.items()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    x = {y: np.array([stats[i] for i, q in labels if q == y and i in stats]) for y in (0, 1)}
    cov = {y: np.cov(v.T, bias=True) for y, v in x.items()}
    n = {y: len(v) for y, v in x.items()}
    common = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    scale = np.diag(np.diag(common)) + 1e-6 * np.eye(len(common))
    shrunk = {y: 0.99 * (0.95 * cov[y] + 0.05 * common) + 0.01 * scale for y in (0, 1)}

    def density(v, y):
        d = v - x[y].mean(0)
        return np.log(n[y]) - 0.5 * np.linalg.slogdet(shrunk[y])[1] - 0.5 * d @ np.linalg.inv(shrunk[y]) @ d

    for r in queries.op3_quality_classifier(spark, DATA).collect():
        margin = np.clip(density(stats[r.doc_id], 1) - density(stats[r.doc_id], 0), -30, 30)
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-6 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    lower = np.tril(np.random.default_rng(1).normal(size=(6, 6))) + 3 * np.eye(6)
    right = np.random.default_rng(2).normal(size=(6, 4))
    assert np.allclose(lower @ quality_classifier.forward(lower, right), right)


def test_token_files(spark, texts, edge, empty):
    got, start = queries.op4_token_files(spark, DATA).orderBy("doc_id").collect(), 0
    tok = word_tokens(WORD_FILE).tokenizer
    for r in got:
        ids = np.array(tok.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    manifest = token_files.write_tokens(edge, WORD_FILE)
    assert token_files.read_tokens(manifest).count() == len(EDGE)
    assert [r.doc_id for r in token_files.read_tokens(manifest, [6]).collect()] == [6, 6]
    assert token_files.read_tokens(token_files.write_tokens(empty, WORD_FILE)).count() == 0
    one = spark.createDataFrame([(None, f"text {i}") for i in range(400)], "doc_id long, text string")
    assert token_files.write_tokens(one, WORD_FILE, files=4).count() > 1 and token_files.read_tokens(token_files.write_tokens(one, WORD_FILE, files=4)).count() == 400
    data = bytearray(token_files.pack_file([1, 2], [b"abc" * 9, b"xyz" * 9]))
    assert token_files.TokenFile(io.BytesIO(bytes(data))).payload(1) == b"xyz" * 9
    import zstandard

    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(bytes(data)).startswith(b"abc")
    at = data.index(struct.pack("<I", token_files.SEEKABLE_MAGIC)) - 5 - 24 - 4
    data[at] ^= 1
    with pytest.raises(ValueError):
        [token_files.TokenFile(io.BytesIO(bytes(data))).payload(i) for i in (0, 1)]


def test_media(spark, texts, edge, empty):
    for r in queries.op5_media(spark, DATA).collect():
        raw = texts[r.doc_id].encode()
        full = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert media.media_features(media.text_media(edge)).count() == len(EDGE)
    assert media.media_features(media.text_media(empty)).count() == 0
    image = np.arange(24, dtype=np.uint8).reshape(4, 6)
    assert (media.decode_image(b"P5 # note\n6 4\n255\n" + image.tobytes()) == image).all()
    assert (media.decode_image(b"P2\n6 4\n255\n" + b" ".join(b"%d" % v for v in image.ravel())) == image).all()
    rows = np.zeros((4, 20), np.uint8)
    rows[:, :18] = np.repeat(image, 3, 1)[::-1]
    bmp = b"BM" + struct.pack("<IHHI", 54 + 80, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 6, 4, 1, 24, 0, 80, 0, 0, 0, 0) + rows.tobytes()
    assert (media.decode_image(bmp)[:, :, 0] == image).all()
    assert np.allclose(media.area_resize(image, 2, 3), image.reshape(2, 2, 3, 2).mean((1, 3)))
    assert np.load(io.BytesIO(media.npy_tile(image, 4))).shape == (4, 4)
    broken = spark.createDataFrame([(1, 3, b"P5 x"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r.feature is None for r in media.media_features(broken).collect())


def mean_cells(image, height, width):
    """Each target cell's mean by summing covered area pixel by pixel."""
    gray = image.astype(float) if image.ndim == 2 else image.astype(float).mean(2)
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            y0, y1, x0, x1 = i * gray.shape[0] / height, (i + 1) * gray.shape[0] / height, j * gray.shape[1] / width, (j + 1) * gray.shape[1] / width
            area = [(max(0, min(y + 1, y1) - max(y, y0)) * max(0, min(x + 1, x1) - max(x, x0)), gray[y, x]) for y in range(gray.shape[0]) for x in range(gray.shape[1])]
            out[i, j] = sum(a * v for a, v in area) / sum(a for a, _ in area)
    return out


def test_media_features_directly(spark, texts):
    rows = {r.doc_id: r for r in queries.op5_media(spark, DATA).collect()}
    for i in sorted(texts, key=lambda i: len(texts[i]))[:: max(1, len(texts) // 12)][:10]:
        raw = texts[i].encode()
        image = np.frombuffer(raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw)), np.uint8).reshape(-1, 64)
        small = np.round(mean_cells(image, 8, 9), 6)
        bits = "".join(str(int(a < b)) for line in small for a, b in zip(line, line[1:]))
        assert rows[i].feature == f"{int(bits, 2):016x}"
        buffer = io.BytesIO()
        np.save(buffer, np.clip(np.rint(np.round(mean_cells(image, 16, 16), 9)), 0, 255).astype(np.uint8))
        assert rows[i].tile_sha256 == hashlib.sha256(buffer.getvalue()).hexdigest()


def test_media_formats(spark):
    bits = np.array([[1, 0, 1, 1, 0, 0, 0, 1, 1, 0], [0, 1, 0, 0, 1, 1, 1, 0, 0, 1]], np.uint8)
    want = (1 - bits) * 255
    assert (media.decode_image(b"P1 # two lines\n10 2\n" + b"\n".join(" ".join(map(str, r)).encode() for r in bits)) == want).all()
    assert (media.decode_image(b"P1 10 2 " + b"".join(b"%d" % v for v in bits.ravel())) == want).all()
    assert (media.decode_image(b"P4\n10 2\n" + np.packbits(bits, axis=1).tobytes()) == want).all()
    deep = np.array([[0, 300], [65535, 257]], np.uint16)
    assert (media.decode_image(b"P5 2 2 65535\n" + deep.astype(">u2").tobytes()) == deep).all()
    assert (media.decode_image(b"P2 2 2 65535 0 300 65535 257") == deep).all()
    color = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert (media.decode_image(b"P6 2 2 255\n" + color.tobytes()) == color).all() and (media.decode_image(b"P3 2 2 255 " + b" ".join(b"%d" % v for v in color.ravel())) == color).all()
    palette = b"BM" + struct.pack("<IHHI", 0, 0, 0, 14 + 40 + 8) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 8, 0, 4, 0, 0, 2, 0) + bytes([9, 9, 9, 0, 200, 200, 200, 0]) + bytes([1, 0, 0, 0])
    assert media.decode_image(palette).tolist() == [[200, 9]]
    bad = [b"P2 2 1 255 1 300", b"P2 2 1 255 1", b"P5 0 4 255\n", b"P5 4 0 255\n", b"P5 2 2 70000\n1234", b"P5 2 2 255\n1", b"P7 x", b"", b"BM", palette[:-4] + bytes([7, 0, 0, 0]), palette[:18] + struct.pack("<ii", 0, 1) + palette[26:]]
    stored = spark.createDataFrame([(i, len(m), bytearray(m)) for i, m in enumerate(bad)] + [(99, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r.feature is None and r.payload_bytes is None for r in media.media_features(stored).collect())


def brute_components(rows):
    import xxhash

    fps = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    group = list(range(len(fps)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for k, (i, _) in enumerate(fps):
        least[top(k)].append(i)
    return Counter((i, f"{fp:016x}", min((x for x in least[top(k)] if x is not None), default=None)) for k, (i, fp) in enumerate(fps))


def test_simhash(spark, texts, edge, empty, monkeypatch):
    rows = sorted(texts.items())
    assert Counter(map(tuple, queries.op6_simhash(spark, DATA).collect())) == brute_components(rows)
    assert Counter(map(tuple, simhash.near_duplicates(edge).collect())) == brute_components(EDGE)
    assert simhash.near_duplicates(empty).count() == 0
    monkeypatch.setattr(simhash, "SLICE", 40)  # front blocks cut into slices give the same links
    rng = random.Random(3)
    ball = sorted({rng.choice([0, 2**40 - 1]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(120)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in ball]
    got = {r.node: r.component for r in connected_components(simhash.link_edges(spark.createDataFrame(signed, "fp long"))).collect()}
    group = {f[0]: f[0] for f in signed}
    for _ in range(len(ball)):
        for a, (x,) in zip(ball, signed):
            for b, (y,) in zip(ball, signed):
                if (a ^ b).bit_count() <= 3:
                    group[x] = group[y] = min(group[x], group[y])
    assert {x: got.get(x, x) for x in group} == group


def test_pii(spark, docs, texts, edge, empty):
    got = {r.doc_id: r for r in queries.op7_pii(spark, DATA).collect()}
    old = {v for t in texts.values() for v in re.findall(r"\d{16}|\S+@[\w.]+\.com|(?:\d{1,3}\.){3}\d{1,3}", t)}
    luhn = lambda v: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(v[::-1])) % 10 == 0
    numbers = {v for v in old if re.fullmatch(r"\d{16}", v) and not luhn(v)}  # no card numbers, so they stay
    assert old - numbers and not any(v in r.text for r in got.values() for v in old - numbers)
    assert all((v in texts[i]) == (v in r.text) for i, r in got.items() for v in numbers)
    assert all(r.text == texts[i] for i, r in got.items() if not r.n_replaced)
    pairs = pii.surrogate_table(pii.entities(docs), "k").collect()
    assert len({r.surrogate for r in pairs}) == len(pairs) and not {r.surrogate for r in pairs} & {r.value for r in pairs}
    out = pii.replace_personal_data(edge).collect()
    assert len(out) == len(EDGE) and set(out[0].asDict()) == set(edge.columns)
    changed = next(r.text for r in out if r.doc_id == 10)
    assert re.fullmatch(r'mail \S+@\S+\.invalid or \+1 \(\d{3}\) \d{3}-\d{4}, \d{16} at 10\.\d+\.\d+\.\d+ token = "[0-9a-f]{40}"', changed)
    names = spark.createDataFrame([(1, "Frau Anna Muster met Mr. John Doe. Frau Anna Muster left.")], "doc_id long, text string")
    text = pii.replace_personal_data(names).first().text
    first = re.findall(r"Frau (\w+ \w+)", text)
    assert len(first) == 2 and first[0] == first[1] and first[0].split()[0].endswith(tuple(pii.NAMES["Latin"][2]["f"])) and "John" not in text
    few = spark.createDataFrame([(i, f"555-12-{i:04d}") for i in range(300)] + [(999, None)], "doc_id long, text string")
    new = [r.text for r in pii.replace_personal_data(few).collect()]
    assert len({t for t in new if t}) == 300 and None in new
    assert pii.replace_personal_data(empty).count() == 0


def brute_rules(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i, k in enumerate(zip(w, w[1:], w[2:])):
        if c[k] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, texts, edge, empty):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in queries.op8_quality_rules(spark, DATA).collect():
        assert tuple(r[n] for n in names) == brute_rules(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    got = quality_rules.ledger(edge)
    assert Counter((r.doc_id, tuple(r[n] for n in names)) for r in got.collect()) == Counter((i, brute_rules(t)) for i, t in EDGE)
    report = {r.rule: r for r in quality_rules.ablation(got, quality_rules.STRICT).collect()}
    fails = [r.failed for r in got.collect()]
    assert report["too_short"].failing == sum(f & 1 for f in fails) and report["too_short"].kept_without == sum(not f & ~1 for f in fails)
    assert quality_rules.ledger(empty).count() == 0
    clash = edge.withColumns({"_w": F.lit(1), "_l": F.lit(2), "rules_words": F.lit(3), "Rules_Lines": F.lit(4)})
    assert set(clash.columns) <= set(quality_rules.ledger(clash).columns) and quality_rules.ledger(clash).first().rules_words == 3


def test_quality_rules_keep_clean_documents(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    r = queries.op8_quality_rules(spark, DATA).join(labels, "doc_id").where("not base_failed").toPandas()
    assert (r.kept == (r.quality == 1)).mean() > 0.98


def test_html(spark, empty):
    page = "<html><head><title>t</title><style>x</style></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a>News</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>A &amp; B</h1><p>First   para<b>graph</b> of the text.<br>More words here.<p>Second paragraph of this text.</article><div class='comments'><p>Nice post!</p></div><footer>&copy; x</footer><script>var a='<p>';</script></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect())
    want = "A & B First paragraph of the text. More words here. Second paragraph of this text."
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
    rng, model, right, total = random.Random(77), html_text.trained(), 0, 0
    for _ in range(120):
        html, labels = html_text.training_page(rng)
        marks = model.label([html_text.vectors(html_text.leaf_blocks(html))])[0]
        right, total = right + sum(a == b for a, b in zip(marks, labels)), total + len(labels)
    assert right / total > 0.98
    assert html_text.extract(df.limit(0)).count() == 0


PARAGRAPHS = [f"This is the {w} paragraph of a text that goes on for a while, with a comma and an end." for w in ("first", "second", "third", "fourth", "fifth")]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = '<div class="x1"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact us</a></li></ul></div>'
LAYOUTS = {
    "bare body": BODY, "neutral class": f'<div class="c12">{BODY}</div>', "columns": f'<div class="row"><div class="col"><article class="news-item">{BODY}</article></div></div>',
    "table": f"<table><tr><td>{MENU}</td><td>{BODY}</td></tr></table>", "open svg": f'<svg><path d="x"><article>{BODY}</article>', "open iframe": f'<iframe src="x"><article>{BODY}</article>',
    "open object": f'<div><object data="x">{BODY}</div>', "plain divs": f"<div><div><div>{BODY}</div></div></div>", "menu and notice": MENU + BODY + "<div>&copy; 2021 Example Ltd</div>",
    "section": f'<section id="s3">{BODY}</section>', "div text": '<div class="q">' + "".join(f"<div>{p}</div>" for p in PARAGRAPHS) + "</div>", "main": f"<main>{BODY}</main>", "line breaks": '<div class="z9">' + "<br>".join(PARAGRAPHS) + "</div>",
}


def test_html_layouts(spark):
    rows = [(i, k, f"<html><head><title>t</title></head><body>{x}</body></html>") for i, (k, x) in enumerate(LAYOUTS.items())]
    got = {r.url: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: t == " ".join(PARAGRAPHS) for k, t in got.items()} == dict.fromkeys(LAYOUTS, True)


def plain_article(page):
    """The article of a page of the given tables, by text replacement alone."""
    import html

    inner = re.search(r"<article[^>]*>(.*?)(?:</article>|$)", page, re.S).group(1)
    for tag in ("script", "style", "form", "nav", "aside", "footer"):
        inner = re.sub(rf"<{tag}\b.*?</{tag}>", " ", inner, flags=re.S)
    inner = re.sub(r'<div class="(?:ad|ads|comments?|share|related|notice|cookie)[^"]*">.*?</div>|<!--.*?-->', " ", inner, flags=re.S)
    inner = re.sub(r"<(?!/?(?:b|i|em|strong|a|span|u)\b)[^>]*>", " ", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())


def test_html_on_whole_table(spark):
    data = DATA.replace("0.001", "0.01")
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op9_html_text(spark, data).collect()}
    assert set(got) == set(pages) and all(r.n_chars == len(r.text) for r in got.values())
    wrong = [i for i, r in got.items() if r.text != plain_article(pages[i])]
    assert len(wrong) <= 0.01 * len(pages) and all(got[i].text for i in got if "<p>" in pages[i])


def brute_spans(w, words, keys):
    """Best (anchor, covered) of each cluster of anchors: aligned places of one template, straight from the words."""
    places, first = defaultdict(list), {}
    for j in range(len(words) - 1):
        places[words[j], words[j + 1]].append(j)
        first.setdefault(f"{words[j]} {words[j + 1]}", j)
    found = defaultdict(list)
    for i in range(len(w) - 1):
        for j in places.get((w[i], w[i + 1]), ()):
            found[i - j].append((i, j))
    covered = {}
    for anchor in {d - b for d in found for b in range(licences.BAND + 1)}:
        at = place = -1
        seen, taken = set(), set()
        for i, j in sorted(h for b in range(licences.BAND + 1) for h in found.get(anchor + b, ())):
            if i > at and j > place:
                at, place, seen, taken = i, j, seen | {j, j + 1}, taken | {j}
        if len(seen) >= -(-len(words) * 8 // 10) and all(first[k] in taken for k in keys):
            covered[anchor] = len(seen)
    return {(a, n) for a, n in covered.items() if all((n, -a) >= (m, -b) for b, m in covered.items() if abs(a - b) <= licences.BAND)}


def brute_licences(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w, places, labels = re.findall(licences.WORDS, low), [], set()
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places, labels = places + at, labels | ({label} if at else set())
    more = {name: brute_spans(w, t.split(), licences.KEYS.get(name, [])) for name, t in licences.TEMPLATES.items()}
    score = max([float(bool(labels)), *(n / len(licences.TEMPLATES[k].split()) for k, v in more.items() for _, n in v)])
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {k for k, v in more.items() if v})), round(score, 12)


def licence_cases():
    rng, cases = random.Random(9), ["under the " * 30, "mit license " * 4, "of the " * 40, "licensed under the the apache license version 2 0", "version 2 0 apache license the under licensed"]
    for name, text in licences.TEMPLATES.items():
        words = text.split()
        for kind in range(6):
            out = list(words)
            for _ in range(kind * max(1, len(words) // 12)):
                at = rng.randrange(len(out))
                if kind % 3 == 0:
                    out[at] = "x"  # other words
                elif kind % 3 == 1:
                    out.insert(at, rng.choice(words))  # drift one way
                else:
                    del out[at]  # and the other
            cases.append(f"Before {name}. " + " ".join(out).upper() + " after " + " ".join(words[: len(words) // 2]) + " again " + " ".join(words))
        cases.append(" ".join(rng.sample(words, len(words))))
        cases.append(" ".join(words[len(words) // 2 :] + words[: len(words) // 2]))
    return cases


def test_licences(spark, texts, edge, empty):
    key = lambda r: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 12))
    for r in queries.op10_licences(spark, DATA).collect():
        assert key(r) == brute_licences(texts[r.doc_id])
    assert Counter((r.doc_id, key(r)) for r in licences.scan(edge).collect()) == Counter((i, brute_licences(t)) for i, t in EDGE)
    cases = dict(enumerate(licence_cases()))
    got = {r.doc_id: key(r) for r in licences.scan(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert got == {i: brute_licences(t) for i, t in cases.items()}
    assert {"mit", "mit-text", "gpl-3-header"} <= {x for g in got.values() for x in g[5].split(",")} and not any(got[i][5] for i in (0, 1, 2, 4)) and got[3][5] == "apache-2.0"
    text = "x y Permission is hereby granted, free of charge, to any person obtaining a copy of THE software and associated documentation files z"
    assert licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == "mit-grant"
    found = licences.hits(spark.createDataFrame([(1, cases[5]), (2, cases[5])], "doc_id long, text string")).where("place is not null")
    for r in licences.spans(found).collect():
        assert 0 <= r.first < r.last and r.covered <= r.size
    assert licences.scan(empty).count() == 0


def test_licence_hits_of_texts_without_keys(spark):
    """Every 2-gram of every text meets the templates, also where no key of any template stands."""
    cases = {1: "Without warranty of any kind, the software is provided as is and the author disclaims all warranties", 2: "A general public license of the authors of the software", 3: "no such words", 4: "word", 5: "", 6: None}
    templates = [(f"base:{v}", k) for k, v in licences.PHRASES.items()] + list(licences.TEMPLATES.items())
    want = Counter()
    for i, text in cases.items():
        grams = licences._pairs(" ".join(re.findall(licences.WORDS, (text or "").lower())))
        want.update((i, at, name, place) for at, gram in enumerate(grams) for name, words in templates for place, other in enumerate(licences._pairs(words)) if gram == other)
        assert not any(gram in keys for keys in licences.KEYS.values() for gram in grams)
    docs = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    found = licences.hits(docs).where("place is not null").collect()
    assert Counter((r.doc_id, r.doc_place, r.template, r.place) for r in found) == want and len({i for i, *_ in want}) == 2
    assert {r.doc_id: r.labels for r in licences.scan(docs).collect()} == {1: "", 2: "gpl", 3: "", 4: "", 5: "", 6: ""}


@pytest.mark.parametrize("text, labels", [
    ("This work is licensed under the GNU General Public License version 2.", "gpl,gpl-2"),
    ("This work is licensed under the GNU General Public License, version 3 or later", "gpl,gpl-3"),
    ("This work is licensed under the GNU Lesser General Public License version 3.", "gpl,lgpl-3"),
    ("This work is licensed under the GNU Lesser General Public License version 2.1", "gpl,lgpl-2.1"),
    ("This work is licensed under the GNU Affero General Public License version 3", "agpl-3,gpl"),
    ("This work is licensed under the GNU General Public License version 1", "gpl"),
    ("licensed under CC BY 4.0", "cc-by,cc-by-4.0"), ("licensed under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"), ("licensed under CC BY-ND 4.0", "cc-by,cc-by-nd-4.0"),
    ("licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"), ("licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"), ("licensed under CC BY-NC 3.0", "cc-by"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"), ("Licensed under the Apache License, Version 2.1", ""), ("Licensed under the Apache License, Version 1.1", ""),
    ("Released under the BSD license", ""), ("Released under the MIT license", "mit"),
])
def test_near_licences(spark, text, labels):
    assert licences.scan(spark.createDataFrame([(1, f"Some words first. {text} and some after")], "doc_id long, text string")).first().labels == labels


def test_pipeline(spark, docs, texts):
    import corpus_pipeline as cp

    kept, seen = docs, set(texts)
    for name, stage in cp.STAGES[:-1]:
        kept = cp.written(stage(spark, kept, DATA), name)
        assert kept.columns == docs.columns
        now = {r.doc_id for r in kept.select("doc_id").collect()}
        assert now <= seen
        seen = now
    passed = {r.doc_id for r in quality_rules.ledger(docs).where(quality_rules.CLEAN.keeps()).select("doc_id").collect()}
    assert seen <= passed
    clean = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    assert len(clean & passed) > 0.99 * len(clean)
    packed = cp.STAGES[-1][1](spark, kept, DATA).toPandas()
    assert set(packed.doc_id) == seen and packed.length.sum() == packed[packed.start == 0].doc_tokens.sum()


def test_pii_search_needs_no_signs_it_does_not_test(spark):
    rows = ["", "plain words", "x@y.example.com", "ab+c.d@e.org f-g@h.com", "+1 555 123 4567abc@x.com", 'Token = "abcdefghij"', "AKIA" + "B" * 12, "sk-" + "a" * 20, "ghp_" + "c" * 20,
            "Mr Ada Holm met Frau Berg, Mrs. Dora and Señora Flora", "call 555-123-4567 or 10.1.2.3", "a" * 5000 + "@", "4111 1111 1111 1111", None]
    old = pii.PATTERNS["email"].replace(r"(?:\G|(?<![\p{L}\p{N}_%+\-]))", "")
    whole = pii.ANY.replace(pii.PATTERNS["email"], old)
    docs = spark.createDataFrame([(r,) for r in rows], "text string")
    both = docs.select(pii.detected(F.col("text")).alias("new"), F.coalesce(F.regexp_extract_all("text", F.lit(f"({whole})"), F.lit(1)), F.array()).alias("old")).collect()
    assert [r.new for r in both] == [r.old for r in both] and sum(len(r.new) for r in both) >= 13
