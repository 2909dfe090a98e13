"""Licence scan by diagonal voting, in DataFrame functions only.

The hashes of all rolling word k-grams of every document join the positions of the same
k-grams in a fixed set of templates, and a hit compares its words too.  Each hit votes for a
diagonal (document place minus template place).  An anchor takes the hits of its own diagonal
and the next ``BAND`` ones, so a span never drifts further than that.  The hits of an anchor
with enough votes are aligned: walked in document order, a hit counts only if it lies behind
the last one in both texts.  A span counts when the aligned hits cover ``SHARE`` of the
template's words and all of its ``KEYS``, the 2-grams that tell it from its relatives (the
version, "gnu general" without a word between, "by nc"); of overlapping anchors the one that
covers most stays.  Base phrases must match whole on one diagonal.

Defined cases: null and word-free texts have no places (null first and last word, empty
labels, score 0); repeated rows are scanned each; documents are identified by a row key,
so doc_id may repeat or be null; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skycat.llm.common import let, written

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 2


def _pairs(words: str) -> list[str]:
    w = words.split()
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Licence notices and texts that the method recognises on top.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-3-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}
#: Notices of families that differ in a word or two, by the words that differ.
_GNU = "this work is licensed under the gnu {kind}general public license version {version}"
_GNU_HEADER = "this program is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation either version {version} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {kind}general public license for more details"
GNU = {"gpl-2": ("", "2"), "gpl-3": ("", "3"), "lgpl-2.1": ("lesser ", "2 1"), "lgpl-3": ("lesser ", "3"), "agpl-3": ("affero ", "3")}
COMMONS = {"cc-by-4.0": "", "cc-by-nc-4.0": "nc ", "cc-by-nc-nd-4.0": "nc nd ", "cc-by-nc-sa-4.0": "nc sa ", "cc-by-nd-4.0": "nd ", "cc-by-sa-4.0": "sa "}
TEMPLATES |= {name: _GNU.format(kind=kind, version=version) for name, (kind, version) in GNU.items()}
TEMPLATES |= {f"{name}-header": _GNU_HEADER.format(kind=kind, version=version) for name, (kind, version) in GNU.items()}
TEMPLATES |= {name: f"licensed under cc by {parts}4 0" for name, parts in COMMONS.items()}
#: 2-grams that a span must hold where the template has them first.
KEYS = {
    "apache-2.0": ["apache license", "version 2", "2 0"],
    "apache-2.0-header": ["apache license", "version 2", "2 0"],
    "mit": ["mit license"],
    "bsd": ["binary forms"],
    "bsd-3-text": ["binary forms"],
    "isc-text": ["hereby granted"],
    "mit-grant": ["hereby granted", "associated documentation"],
    "mit-text": ["hereby granted", "associated documentation"],
    "unlicense": ["unencumbered software"],
    "mpl-2.0": ["mozilla public"],
}
KEYS |= {f"{name}{end}": [*_pairs(f"gnu {kind}general"), *_pairs(f"version {version}")] for name, (kind, version) in GNU.items() for end in ("", "-header")}
KEYS |= {name: _pairs(f"cc by {parts}4 0") for name, parts in COMMONS.items()}
#: Diagonals that one span may take beside its first, and the share of the template's words that it needs.
BAND, SHARE = 2, 0.8


def _words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(f"({WORDS})"), F.lit(1))


def template_grams(spark, k: int = GRAM) -> DataFrame:
    """(gram_hash, gram, template, place, size, bit, mask): one row per template place.

    ``size`` counts words; ``bit`` is set where a key of the template stands first, and
    ``mask`` holds the bits of all its keys.
    """
    rows = []
    for name, phrase in [*((f"base:{v}", p) for p, v in PHRASES.items()), *TEMPLATES.items()]:
        words, keys = phrase.split(), KEYS.get(name, [])
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        bits = {grams.index(key): 1 << n for n, key in enumerate(keys)}
        rows += [(gram, name, i, len(words), bits.get(i, 0), (1 << len(keys)) - 1) for i, gram in enumerate(grams)]
    return spark.createDataFrame(rows, "gram string, template string, place int, size int, bit int, mask int").withColumn("gram_hash", F.xxhash64("gram"))


def hits(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, doc_place, template, place, size, bit, mask): one row per document (place null), and one per hit.

    Both come from one pass, written down, so that the row key means the same to both.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), _words(F.col("text")).alias("w"))
    rows = keyed.select("row", "doc_id", F.explode(_rows(F.col("w"))).alias("p")).select("row", "doc_id", "p.n_words", "p.doc_place", F.col("p.gram").alias("word_gram"), F.xxhash64("p.gram").alias("word_hash"))
    # some hundred template rows, whatever the corpus
    grams = F.broadcast(template_grams(docs.sparkSession))
    joined = rows.join(grams, (F.col("word_hash") == F.col("gram_hash")) & (F.col("word_gram") == F.col("gram")), "left")
    return written(joined.where("doc_place is null or place is not null").select("row", "doc_id", "n_words", "doc_place", "template", "place", "size", "bit", "mask"), "licence-hits")


def _rows(w: Column) -> Column:
    """One struct for the document and one for every 2-gram of its words."""
    one = lambda n, at, gram: F.struct(n.cast("int").alias("n_words"), at.cast("int").alias("doc_place"), gram.cast("string").alias("gram"))
    none = F.lit(None)
    pairs = lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return let(w, lambda x: F.concat(F.array(one(F.size(x), none, none)), F.transform(pairs(x), lambda g, i: one(none, i, g))))


def spans(found: DataFrame, band: int = BAND, share: float = SHARE) -> DataFrame:
    """(row, template, first, last, covered, size): verified spans over document words first..last-1.

    Hits move once, to the others of their document and template; all that follows stays there.
    """
    found = found.select("row", "template", "size", "doc_place", "place", "bit", "mask")
    is_base = F.col("template").startswith("base:")
    diagonal = F.col("doc_place") - F.col("place")
    votes = found.where(is_base).repartition("row", "template").groupBy("row", "template", "size", diagonal.alias("first")).agg(F.count("*").alias("votes"))
    whole = votes.where(F.col("votes") == F.col("size") - 1).select("row", "template", "first", (F.col("first") + F.col("size")).alias("last"), F.col("size").alias("covered"), "size")

    need = F.ceil(F.col("size") * F.lit(share))
    along = Window.partitionBy("row", "template").orderBy("anchor")
    # each hit may be reached from an anchor up to ``band`` diagonals before it; a hit covers two words at most
    placed = found.where(~is_base).repartition("row", "template").withColumn("anchor", F.explode(F.sequence(diagonal - band, diagonal)))
    voted = placed.withColumn("votes", F.count("*").over(Window.partitionBy("row", "template", "anchor"))).where(2 * F.col("votes") >= need)
    lists = voted.groupBy("row", "template", "size", "mask", "anchor").agg(F.sort_array(F.collect_list(F.struct("doc_place", "place", "bit"))).alias("hits"))
    aligned = lists.withColumn("a", _aligned(F.col("hits"))).where((F.col("a.covered") >= need) & (F.col("a.keys") == F.col("mask")))
    best = F.max(F.struct("a.covered", (-F.col("anchor")).alias("early"))).over(along.rangeBetween(-band, band))
    texts = aligned.withColumn("best", best).where((F.col("best.covered") == F.col("a.covered")) & (F.col("best.early") == -F.col("anchor")))
    return whole.union(texts.select("row", "template", "a.first", (F.col("a.at") + 2).alias("last"), "a.covered", "size"))


def _aligned(found: Column) -> Column:
    """Walk through (doc_place, place, bit) in order; each step must lead on in both texts."""
    start = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("place"), F.lit(0).alias("covered"), F.lit(-1).alias("first"), F.lit(0).alias("keys"))

    def step(s: Column, h: Column) -> Column:
        # two words, or one if the step before has covered the first of them
        fresh = F.when((s["covered"] > 0) & (h["place"] == s["place"] + 1), 1).otherwise(2)
        on = F.struct(h["doc_place"].alias("at"), h["place"].alias("place"), (s["covered"] + fresh).alias("covered"), F.when(s["covered"] > 0, s["first"]).otherwise(h["doc_place"]).alias("first"), s["keys"].bitwiseOR(h["bit"]).alias("keys"))
        return F.when((h["doc_place"] > s["at"]) & (h["place"] > s["place"]), on).otherwise(s)

    return F.aggregate(found, start, step)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per document."""
    both = hits(docs)
    base, found = both.where("doc_place is null").select(F.col("row").alias("scan_row"), "doc_id", F.col("n_words").cast("long").alias("n_words")), both.where("place is not null")
    verified = spans(found)
    is_base = F.col("template").startswith("base:")
    label = F.regexp_replace("template", "^base:", "")
    per_row = verified.groupBy("row").agg(
        F.sum(is_base.cast("long")).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_base, label))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"),
        F.max(F.col("covered") / F.col("size")).alias("score"),
    )
    out = base.join(per_row, base.scan_row == per_row.row, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
