"""Token ids of whole texts with a pretrained tokenizer file.

Texts are cut at spaces and line breaks, and the ids of a cut are remembered
in a bounded per-process cache. The cut is safe for word-BPE files whose
normaliser acts on characters and whose pre-tokenizer never crosses white
space; for any other file whole texts are encoded.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Sequence

#: Fixed value: ASCII signs that end a word and are tokens of their own.
WORD_ENDS = "!#$%&*+,-./:;=?@[]^_`{|}~\"()"
LONGEST_CACHED = 48
_BREAKS = re.compile(r"[\n\r\t]")
_LOADED: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """A dict that computes missing entries and is emptied when full."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key: str) -> bytes:
        value = self.compute(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_entries: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_word = self._cuts_at_space()
        self._letters = _byte_letters()
        self._words = _Cache(self._word, cache_entries)
        self._cores = _Cache(self._core, cache_entries)

    def _cuts_at_space(self) -> bool:
        spec = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        before = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in before]
        return (normal == ["NFC", "Replace", "Lowercase"] and kinds == ["Split", "ByteLevel"]
                and before[0]["invert"] and before[0]["behavior"] == "Removed"
                and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in before[0]["pattern"].get("Regex", "")
                and not before[1]["add_prefix_space"] and spec["model"]["type"] == "BPE"
                and all(not re.search(r"\s", x["content"]) for x in spec["added_tokens"]))

    def _full(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _core(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join(map(self._letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _word(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        core = chunk.rstrip(WORD_ENDS)
        if core.isalpha() and "Σ" not in core:
            low = core.lower()
            if low.isascii() or low.isalpha() and unicodedata.is_normalized("NFC", low):
                head = self._cores[low]
                return head if len(core) == len(chunk) else head + self._words[chunk[len(core):]]
        return self._full(chunk)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._full(text)
        return b"".join(map(self._words.__getitem__, _BREAKS.sub(" ", text).split(" ")))

    def forget(self) -> None:
        """Empty the caches, at the end of a task: its worker is kept for later
        stages, which need the memory."""
        self._words.clear()
        self._cores.clear()

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]


def encoder(path: str) -> Encoder:
    """The process's encoder for ``path``: loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
