"""Words and token ids of texts of any length, in bounded memory."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np

from folioforge.llm.common import WORKER_STORES

#: Bytes of a text that are split into words at a time.
CHUNK = 1 << 19
_BLANK = b" \t\n\x0b\x0c\r"


def chunks(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes that end at ASCII white space."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            while end < len(data) and data[end] not in _BLANK:
                end += 1
        yield data[start:end]
        start = end


def _plain(word: str) -> bool:
    """Letters alone that normalising and lower-casing leave as they are."""
    return word.isalpha() and word.lower() == word and unicodedata.is_normalized("NFC", word)


class WordEncoder:
    """Encodes word by word with a store of the words that it has met.

    Right for tokenizers that lower-case, drop white space and never join what it parts.
    New words of letters alone go to the tokenizer many at a time: each is one unit to it,
    and its last id is one of those that end a unit. A stop or comma after letters is a
    unit of its own. All other words are encoded alone.
    """

    def __init__(self, path: str, most_words: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.most_words = Tokenizer.from_file(path), most_words
        self.store: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

        # the same vocabulary for words of letters that need no normalising any more
        plain = json.loads(self.tokenizer.to_str())
        units = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        self.plain = Tokenizer.from_str(json.dumps(plain | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": units}, "added_tokens": []}))

    @staticmethod
    def _encode(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        letters: dict[bytes, None] = {}
        stopped, rest = [], []
        for w in new:
            if w.isalpha() or (not w.isascii() and _plain(w.decode())):
                letters[w] = None
                continue
            base = w[:-1]
            if w[-1] in b".," and (base.isalpha() or (not base.isascii() and _plain(base.decode()))):
                stopped.append(w)
                if base not in self.store:
                    letters[base] = None
            else:
                rest.append(w)
        for mark in (b".", b","):
            if stopped and mark not in self.store:
                rest.append(mark)
        keys = list(letters)
        ids = self._encode(self.plain, [b" ".join(keys[i : i + 64]).decode() for i in range(0, len(keys), 64)])
        for at, part in zip(range(0, len(keys), 64), ids, strict=True):
            own, cuts = keys[at : at + 64], (4 * (np.flatnonzero(self.ends[part]) + 1)).tolist()
            if len(cuts) == len(own):
                data = part.tobytes()
                self.store.update(zip(own, map(data.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
            else:
                rest += own
        for w, part in zip(rest, self._encode(self.tokenizer, [w.decode() for w in rest]), strict=True):
            self.store[w] = part.tobytes()
        for w in stopped:
            self.store[w] = self.store[w[:-1]] + self.store[w[-1:]]

    def _joined(self, group: list[bytes]) -> list[bytes]:
        lists = [data.lower().split() for data in group]
        words: set[bytes] = set()
        for own in lists:
            words.update(own)
        if new := words.difference(self.store):
            if self.store and len(self.store) + len(new) > self.most_words:
                self.store.clear()
                new = words
            self._learn(list(new))
        get = self.store.__getitem__
        return [b"".join(map(get, own)) for own in lists]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers; long texts go in parts."""
        group: list[bytes] = []
        held = 0
        for data in texts:
            special = b"<|" in data  # special tokens keep their case
            if special or len(data) > CHUNK:
                yield from self._joined(group)
                group, held = [], 0
                yield b"".join(self._encode(self.tokenizer, [part.decode()])[0].tobytes() if special else self._joined([part])[0] for part in chunks(data))
                continue
            group.append(data)
            held += len(data)
            if held > 8 * CHUNK:
                yield from self._joined(group)
                group, held = [], 0
        yield from self._joined(group)


_ENCODERS: dict[str, WordEncoder] = {}
WORKER_STORES["tokens"] = _ENCODERS.clear


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
