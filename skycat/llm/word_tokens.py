"""Exact, cached encoding with a ``tokenizers`` word-level BPE file.

Texts are cut at single spaces and line feeds, where no pre-token of this kind of
tokenizer can reach across; each distinct chunk is encoded once and kept as little-endian
uint16 (or uint32) bytes.  Plain Latin chunks go straight to the library's BPE model;
every other chunk, and every text that may hold an added token, goes through the
library's whole pipeline.
"""

from __future__ import annotations

from array import array

#: Distinct chunks kept by one Python worker before its cache starts anew.
CACHE_ENTRIES = 400_000
#: Marks that are a pre-token of their own after a word.
PLAIN_MARKS = frozenset(".,;:!?")

#: The split pattern of the tokenizer file (its pre_tokenizer section).
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokens:
    """Encoder for one worker: ``ids(text)`` gives the raw little-endian id bytes."""

    def __init__(self, path: str):
        import json
        import os

        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        split = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if split != WORD_SPLIT:
            raise ValueError("this tokenizer file splits words by another pattern")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = 2 if self.code == "H" else 4
        self.latin = regex.compile(r"[\x00-\x1b\x20-\x7e\xa1-ɏ]*").fullmatch
        self.split = regex.compile(WORD_SPLIT).findall
        self.to_char = byte_characters()
        self.chunks = _Cache(self._chunk)
        self.words = _Cache(self._word)

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.to_char)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            low = chunk.lower()
        elif self.latin(chunk):
            low = self.tokenizer.normalizer.normalize_str(chunk)
        else:
            return self._whole(chunk)
        if low.isalpha():
            return self._word(low)
        words = self.words
        if low[-1:] in PLAIN_MARKS and low[:-1].isalpha():
            return words[low[:-1]] + words[low[-1]]
        return b"".join([words[w] for w in self.split(low)])

    def ids(self, text: str | None) -> bytes:
        """All ids of a whole text; null counts as empty."""
        if not text:
            return b""
        if any(t in text for t in self.added):
            return self._whole(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def trim(self) -> None:
        """Call between batches: holds both caches to their bound."""
        for cache in (self.chunks, self.words):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()

    def forget(self) -> None:
        """Empty both caches: a worker lives on after its task, beside those of later stages."""
        self.chunks.clear()
        self.words.clear()


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


_OPEN: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's encoder for a file, loaded once per process."""
    if path not in _OPEN:
        _OPEN[path] = WordTokens(path)
    return _OPEN[path]
