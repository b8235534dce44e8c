"""Token ids of whole texts with a public tokenizer file, as little-endian unsigned 32-bit values.

Most time in a BPE encoder goes into words it has met before. ``Encoder`` therefore keeps the ids of white-space-separated pieces (a
bounded number of them) and asks the tokenizer only for new ones, by their letters and their signs. Its ids equal those of
encoding the whole text: the tokenizer's rules never look across white space, which they drop, and a text with a string that may
be a special token, or a tokenizer of another make, goes to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from pathlib import Path

import numpy as np

from quillspark.llm.common import LONG_WORD, use

VOCABULARY = "word_bpe_49k.json"
#: Pieces that an encoder remembers, about 200 bytes each, and as many words.
PIECES = 400_000
#: A run of small letters without marks to combine, then ASCII signs other than the apostrophe (which begins contractions).
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_SMALL = {c: c + 32 for c in range(0xC0, 0xDF) if c != 0xD7}
_SIMPLE = re.compile(r"([a-zß-öø-ÿ]+)?([!-&(-/:-@\[-`{-~]+)?")


def vocabulary_path(name: str) -> str:
    """A path as it is; else the file of that name among the public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Cores(dict):
    """Letters, or signs -> ids as bytes; bounded."""

    def __init__(self, learn: Callable[[str], bytes], most: int):
        super().__init__()
        self.learn, self.most = learn, most

    def __missing__(self, core: str) -> bytes:
        ids = self.learn(core)
        if len(core) <= LONG_WORD:
            if len(self) >= self.most:
                self.clear()
            self[core] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: str = VOCABULARY, pieces: int = PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        path = vocabulary_path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(Path(path).read_text())
        before = rules["pre_tokenizer"].get("pretokenizers", [{}])[0] if rules.get("pre_tokenizer") else {}
        self.by_piece = rules["model"].get("end_of_word_suffix") == "</w>" and before.get("behavior") == "Removed" and before.get("invert") is True
        self.special = sorted({t["content"][:2] for t in rules.get("added_tokens", [])})
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: "".join(part for part, _ in level.pre_tokenize_str(chr(c))) for c in range(0xDF, 0x100)}
        self.most, self.pieces = pieces, {}
        self.words, self.signs = _Cores(self._word, pieces), _Cores(self.whole, pieces)

    def clear(self) -> None:
        for cache in (self.pieces, self.words, self.signs):
            cache.clear()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A run of small letters is one word to the tokenizer, so its model alone has to see it, as bytes."""
        return array("I", [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.bytes))]).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        word = piece.rstrip(_SIGNS)
        if word.isalpha():
            signs = piece[len(word) :]
            ids = self.words[word.decode()]
            return ids + self.signs[signs.decode()] if signs else ids
        text = piece.decode("utf-8", "surrogatepass")
        m = None if text.isascii() else _SIMPLE.fullmatch(text.translate(_SMALL))
        if not m:
            return self.whole(text)
        word, signs = m.groups()
        return (self.words[word] if word else b"") + (self.signs[signs] if signs else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        use(self)
        out, split = [b""] * len(texts), []
        for k, text in enumerate(texts):
            if not self.by_piece or any(s in text for s in self.special):
                out[k] = self.whole(text)
            else:
                split.append((k, text.encode("utf-8", "surrogatepass").lower().split()))
        needed = set().union(*[p for _, p in split])
        if len(self.pieces) + len(needed) > self.most:
            self.pieces.clear()
        self.pieces.update((p, self._piece(p)) for p in needed.difference(self.pieces))
        for k, pieces in split:
            out[k] = b"".join(map(self.pieces.__getitem__, pieces))
        for p in [p for p in needed if len(p) > LONG_WORD]:
            del self.pieces[p]
        if len(self.pieces) > self.most:
            self.pieces.clear()
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(vocabulary: str = VOCABULARY, pieces: int = PIECES) -> Encoder:
    """One encoder a worker, vocabulary and size."""
    key = (vocabulary, pieces)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, pieces)
    return _encoders[key]
