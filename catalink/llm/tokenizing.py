"""Token ids of whole texts, by the tokenizers library with a bounded cache.

The vocabularies split a text into pre-tokens before any merge, so a text can be
cut at places that are certain to lie between two pre-tokens, and each chunk
encoded once. A batch of texts is cut by Arrow and its chunks are numbered there, so the
cache is asked once a batch for each different chunk, and numpy lays the ids out. Added tokens
('<|endoftext|>') are cut out first, as the library does. Chunks that are letters and then
punctuation go straight to the library's model; every other chunk goes through the library's whole encoding.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from catalink.llm.shared import held

#: Entries of each of the caches, about 150 bytes each.
CACHED = 450_000
#: Between any character and a lone space or line end that a visible character follows.
_BETWEEN = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Letters whose case and normal form are single characters, then ASCII punctuation; never an apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: ASCII punctuation that is cut from letters before it; never an apostrophe.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Texts whose spaces aren't single ones between chunks: at an end, next to each other, or of another kind.
_UNEVEN = r"(?:^|[ \n])(?:[ \n]|$)|[" + "".join(rf"\x{{{c:x}}}" for c in range(0x110000) if chr(c).isspace() and chr(c) not in " \n") + "]"
#: Stands before a text's first chunk, which no space precedes; chunks have no other line ends next to each other.
_FIRST = "\n\n"


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets show printable bytes as themselves and the rest, in order, from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """Ids by chunk; one that is missing is made, and a full cache is emptied first."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, chunk: str) -> bytes:
        ids = self.make(chunk)
        if len(self) >= self.most:
            self.clear()
        self[chunk] = ids
        return ids


class Encoder:
    """Encodes texts with one vocabulary file; ids are little-endian, of 16 bits where the vocabulary allows it."""

    def __init__(self, path: str, spaces: bool, cached: int = CACHED):
        """``spaces``: a lone space belongs to the pre-token after it; else white space is dropped and case folded."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spaces = spaces
        added = self.library.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens must match as they stand")
        self.size = max([*self.library.get_vocab().values(), 0]) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.added = {t.content: self._bytes(i) for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        letters, model = _byte_letters(), self.library.model.tokenize
        self.space = letters[32]
        known = [self._bytes(i) for i in range(self.size)]

        def pre_token(piece: str) -> bytes:
            shown = piece if piece.isascii() and piece.isalpha() else "".join(map(letters.__getitem__, piece.encode()))
            return b"".join([known[t.id] for t in model(shown)])

        self.words = _Cache(pre_token, cached)
        self.joined = _Cache(self._after_space if spaces else self._folded, cached)  # a chunk that follows a space, or stands alone
        self.exact = _Cache(self._whole, cached)
        self._known, self._model = known, model

    def _bytes(self, i: int) -> bytes:
        return int(i).to_bytes(self.dtype.itemsize, "little")

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()

    def _after_space(self, chunk: str) -> bytes:
        letters = chunk.rstrip(_MARKS)
        if letters.isascii() and letters.isalpha():
            if letters != chunk:
                return self.joined[letters] + self.words[chunk[len(letters) :]]
            return b"".join([self._known[t.id] for t in self._model(self.space + chunk)])
        if chunk.startswith(_FIRST):
            return self.exact[chunk[2:]]
        new_line = chunk[:1] == "\n"
        if not (m := _PLAIN.fullmatch(chunk, new_line)):
            return self._whole(chunk if new_line else " " + chunk)
        ids = self.words["\n"] + self.words[m[1]] if new_line else self.joined[m[1]] if m[2] else self.words[" " + chunk]
        return ids + self.words[m[2]] if m[2] else ids

    def _folded(self, chunk: str) -> bytes:
        letters = chunk.rstrip(_MARKS)
        if letters.isascii() and letters.isalpha():
            if letters != chunk:
                return self.joined[letters] + self.words[chunk[len(letters) :]]
            return b"".join([self._known[t.id] for t in self._model(chunk)]) if chunk.islower() else self.joined[chunk.lower()]
        if not (m := _PLAIN.fullmatch(chunk)):
            return self._whole(chunk)
        folded = m[1].lower()
        ids = self.words[folded] if folded == chunk else self.joined[folded]
        return ids + self.words[m[2]] if m[2] else ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text; of null, none."""
        if not text:
            return np.zeros(0, self.dtype)
        if self.cut and self.cut.search(text):
            ids = b"".join(self.added.get(part) or self._part(part) for part in self.cut.split(text) if part)
        else:
            ids = self._part(text)
        return np.frombuffer(ids, self.dtype)

    def _part(self, text: str) -> bytes:
        """A text, not empty, without added tokens."""
        if self.spaces:
            return b"".join(map(self.exact.__getitem__, _BETWEEN.split(text)))
        return b"".join(map(self.joined.__getitem__, text.replace("\n", " ").split(" ")))

    def encode_all(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each followed by ``end``; where each text's ids end)."""
        texts = pc.fill_null(texts, "")
        apart = np.zeros(len(texts), bool)
        for token in self.added:
            apart |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if self.spaces:
            apart |= pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        whole = pc.if_else(pa.array(~apart), texts, "") if apart.any() else texts
        if self.spaces:
            whole = pc.binary_join_element_wise(_FIRST, pc.replace_substring(whole, "\n", " \n"), "")
        else:
            whole = pc.replace_substring(whole, "\n", " ")
        chunks = pc.split_pattern(whole, " ")
        numbered = chunks.flatten().dictionary_encode()
        known = list(map(self.joined.__getitem__, numbered.dictionary.to_numpy(zero_copy_only=False).tolist()))
        code = numbered.indices.to_numpy()
        many = np.fromiter(map(len, known), np.int32, len(known)) // self.dtype.itemsize
        first = np.cumsum(many, dtype=np.int32) - many  # a batch is far below 2**31 ids
        n = many[code]
        before = np.concatenate([[0], np.cumsum(n, dtype=np.int32)], dtype=np.int32)
        at = np.repeat(first[code] - before[:-1], n)
        at += np.arange(len(at), dtype=np.int32)
        ids = np.frombuffer(b"".join(known), self.dtype)[at]
        offsets = chunks.offsets.to_numpy()
        ends = before[offsets[1:] - offsets[0]] + np.arange(1, len(texts) + 1, dtype=np.int64)
        out = np.empty(len(ids) + len(texts), self.dtype)
        own = np.ones(len(out), bool)
        own[ends - 1] = False
        out[own], out[ends - 1] = ids, end
        if not apart.any():
            return out, ends
        parts = [np.append(self.encode(texts[i].as_py()), self.dtype.type(end)) if a else out[e - k : e] for i, (a, e, k) in enumerate(zip(apart, ends, np.diff(ends, prepend=0)))]
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])


def encoder(path: str, spaces: bool, cached: int = CACHED) -> Encoder:
    """A vocabulary's encoder, kept in a worker between tasks."""
    return held((path, spaces, cached), lambda: Encoder(path, spaces, cached))


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
