"""Token ids of whole texts with a public BPE vocabulary, cached by pre-token.

Texts of Latin letters, digits and ASCII marks are cut into the vocabulary's own pre-tokens here, by
its pattern, after lower-casing; other texts are cut at ASCII spaces, across which no pre-token
reaches, and go through the tokenizers library chunk by chunk. Either way a text's ids are those of
its parts, one after the other, and each worker keeps the parts and the words between white space
that it has met (bounded two-generation caches), since words repeat far more often than they are new.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np

from .common import worker_state

#: Texts whose pre-tokens _PART finds: printable ASCII, white space, Latin-1 letters and the two signs among them.
_SAFE = re.compile(r"[\x20-\x7E\t-\rÀ-ÿ]*")
#: The pre-tokens of lower-case safe texts.
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~×÷]+")
#: Entries of one generation of the cache.
CACHE = 400_000


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE writes byte b as the character b where that is printable, else as the next free one from 256 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


class Kept(dict):
    """What make gives for a short text, of the last two generations of entries."""

    def __init__(self, make: Callable[[str], bytes], cache: int):
        super().__init__()
        self.make, self.cache, self.old = make, cache, {}

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            found = self.make(part)
        if len(part) <= 64:
            if len(self) >= self.cache:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found


class WordIds(Kept):
    """pre-token -> its ids as little-endian bytes; misses go to the vocabulary's model."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        super().__init__(self._model, cache)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters, self.chunks, self.words = _byte_letters(), {}, Kept(self._cut, cache)
        self.plain = self._plain()

    def _plain(self) -> bool:
        """Whether pre-tokens may go straight to the model: true if both ways agree on texts of every kind of part."""
        probes = ["of thonener Mément\tÜBER WORD\nçñß ×2÷", "it's don'T we'Ll I'm 'd'' they've''re o'neil's", "a1b22 3,50% x--y (z)!!\x0b[q]_{}~`@#", "<a|b> \\ /|\\ ^&*"]
        try:
            return all(self._parts(t) == self._whole(t) for t in probes)
        except Exception:  # a model without tokenize(): every chunk goes through the whole pipeline
            return False

    def _model(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(part)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _cut(self, word: str) -> bytes:
        """Ids of a lower-case safe word between white space."""
        return b"".join(map(self.__getitem__, _PART.findall(word)))

    def _parts(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.lower().split()))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run between ASCII spaces."""
        if self.plain and _SAFE.fullmatch(chunk):
            return self._parts(chunk)
        found = self.chunks.get(chunk)
        if found is None:
            found = self._whole(chunk)
            if len(chunk) <= 64:
                if len(self.chunks) >= self.cache // 4:
                    self.chunks.clear()
                self.chunks[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        if "<|" in text:  # special tokens are matched before anything else
            return self._whole(text)
        if self.plain and _SAFE.fullmatch(text):
            return self._parts(text)
        return b"".join(map(self._chunk, text.replace("\n", " ").split(" ")))


def word_ids(path: str) -> WordIds:
    return worker_state(("word ids", path), lambda: WordIds(path))
