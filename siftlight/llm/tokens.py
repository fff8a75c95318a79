"""Token ids of a ``tokenizers`` file, with a memo of what the library gave.

All ids come from the library, with its defaults and without special tokens. A text is cut
into chunks that the library encodes alike alone and in the text; each different chunk is
encoded once and remembered, up to a bound. The cuts are before runs of ASCII white space:

- ``byte_level``: the pre-tokenizer takes a space into the piece after it, and no
  alternative of its pattern matches across a step from a non-space to white space.
- ``word_end``: white space only parts pieces and is dropped, so chunks go without it.

Special tokens hold no white space, and the normalizers (NFC, lower case) never join
characters over an ASCII space, so both act within chunks. A chunk that is one word of
Latin-1 letters is given to the library's model directly; one with marks after it is two
pieces to both pre-tokenizers.
Texts with any other white space (but that of Latin-1, for ``word_end``), or with a chunk
longer than ``LONG``, go to the library whole. It also encodes one text of every call again as a whole, and a difference is an
error.
"""

from __future__ import annotations

import os
import re
from array import array

#: White space of Unicode that isn't a cut; texts with it aren't cut at all.
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_OTHER_BYTES = b"\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_CHUNK = re.compile("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_BYTES_CHUNK = re.compile(_CHUNK.pattern.encode())
_BEYOND_LATIN1 = re.compile("[^\x00-\xff]")
LONG = 1 << 14

# Byte-level vocabularies show printable bytes as themselves, the others as characters from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # of ASCII, what is no letter, digit or space
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPACE = chr(_SHOWN[32])


class ChunkTokenizer:
    """``encode(texts)`` gives, per text, its ids as bytes of unsigned 32-bit integers."""

    _open: dict[tuple, ChunkTokenizer] = {}

    def __init__(self, path: str, kind: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if kind not in ("byte_level", "word_end"):
            raise ValueError(kind)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.marks_ends = kind == "word_end"
        # Two generations of chunks, of about `limit` each, keep what is frequent.
        self.limit = limit
        self.known = _Known(self)

    @classmethod
    def of(cls, path: str, kind: str, limit: int = 400_000) -> ChunkTokenizer:
        key = (path, kind, limit)
        if key not in cls._open:
            cls._open[key] = cls(*key)
        return cls._open[key]

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunks(self, text: str) -> list | None:
        """The chunks of a text, as bytes if its characters are all of Latin-1; None if it
        has to be encoded whole."""
        # The library lowers letters itself; done here, chunks that differ in case are one. Beyond
        # Latin-1, and where a special token may stand, that is left to it.
        try:
            raw = (text.lower() if self.marks_ends and "<|" not in text else text).encode("latin-1")
        except UnicodeEncodeError:
            if _OTHER_SPACE.search(text):
                return None
            chunks = text.split() if self.marks_ends else _CHUNK.findall(text)
        else:
            if self.marks_ends:
                chunks = raw.split()
            elif len(raw.translate(None, _OTHER_BYTES)) < len(raw):
                return None
            else:
                chunks = _BYTES_CHUNK.findall(raw)
        return None if len(text) > LONG and max(map(len, chunks), default=0) > LONG else chunks

    def _piece(self, word: str) -> bytes:
        """The ids of a word of Latin-1 letters, with a space before it or none: one piece to
        both pre-tokenizers and normal to NFC, so its bytes go straight to the library's model."""
        if self.marks_ends:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_SHOWN)
        elif word[0] == " ":
            word = _SPACE + word[1:]
        return array("I", [x.id for x in self.model.tokenize(word)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            chunks = self._chunks(text)
            if chunks is None:
                out.append(self._library(text))
                continue
            out.append(b"".join(map(self.known.__getitem__, chunks)))
            if len(self.known) > self.limit:
                self.known = _Known(self, self.known)
        again = next((i for i, t in enumerate(texts) if t), None)
        if again is not None and self._library(texts[again]) != out[again]:
            raise AssertionError("the chunks' ids differ from the whole text's")
        return out


class _Known(dict):
    """Chunk -> its ids, found when they are first asked for; what the generation before
    had is taken over."""

    def __init__(self, tokenizer: ChunkTokenizer, older: dict | None = None):
        super().__init__()
        self.older = dict(older or {})
        self.piece, self.library = tokenizer._piece, tokenizer._library

    def __missing__(self, chunk: bytes | str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            text = chunk.decode("latin-1") if isinstance(chunk, bytes) else chunk
            word = text[1:] if text[0] == " " else text
            if isinstance(chunk, str):
                ids = self.library(text) if _BEYOND_LATIN1.search(text) else self[text.encode("latin-1")]
            elif word.isalpha():
                ids = self.piece(text)
            else:
                stem = word.rstrip(_MARKS)
                n = len(word) - len(stem)
                if n and stem.isalpha():  # two pieces, and no more
                    ids = self[chunk[:-n]] + self[chunk[-n:]]
                else:
                    ids = self.library(text)
        self[chunk] = ids
        return ids
