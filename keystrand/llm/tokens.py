"""Token ids of whole texts by the tokenizers library, with a bounded memo of text chunks.

A text is cut only where the vocabulary's own pre-tokenizer always cuts: before a
space or line feed that follows another character.  Each chunk is encoded by the
library once and then remembered, so the ids are those of the whole text.  A text
whose spaces and line feeds all stand alone is split at them; others are cut by a pattern.  Texts
for which the rule doesn't hold (other white space before a space, or one of the
vocabulary's added tokens, which the library looks for first) go to the library whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from operator import attrgetter

import numpy as np

#: Chunks remembered in a Python worker, about 200 bytes each.
MEMO = 1_000_000
_ID = attrgetter("id")
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A Latin word with the space before it, a full stop or comma that ends a chunk, a line feed before a letter, or any other chunk whole.
_CHUNK = re.compile(rf" ?[{_LATIN}]+(?=[.,]?(?:[ \n]|\Z))|[.,](?=[ \n]|\Z)|\n(?=[{_LATIN}])|[ \n]*[^ \n]+|[ \n]+")
_WORD = re.compile(rf" ?[{_LATIN}]+")
#: White space, one run of Latin letters, ASCII punctuation: parts between which every pre-tokenizer here cuts.
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_RUN = re.compile(f"[{_LATIN}]+")
_SIMPLE = re.compile(rf"( ?)([{_LATIN}]+)([!-/:-@\[-`{{-~]*)")
_LETTERS = [chr(c) for c in range(0x100) if re.fullmatch(f"[{_LATIN}]", chr(c))]


def _worker_memos() -> dict[tuple[str, int, str], dict[str, bytes]]:
    """Memos live as long as the Python worker, which serves many tasks."""
    return sys.__dict__.setdefault("_keystrand_token_memos", {})


def forget() -> None:
    """Give the memory of all memos back, in tasks that encode nothing."""
    for memo in _worker_memos().values():
        memo.clear()


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary lies; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class TextEncoder:
    """Encodes texts with one vocabulary; ``end_id`` follows each text."""

    def __init__(self, vocabulary: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if max(self.library.get_vocab_size(), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end = self.pack([end_id])
        self.memo = _worker_memos().setdefault((vocabulary, end_id, "chunks"), {})
        # by what follows a space, or by a line feed and what follows it
        self.parts = _worker_memos().setdefault((vocabulary, end_id, "parts"), {})
        self.model = self.library.model
        # how the vocabulary's own normalizer and pre-tokenizer write a letter, and a space before one
        self.written = {ord(c): self.pieces(c) for c in _LETTERS}
        self.space = self.pieces(" a")[:-1]
        self.plain = all(self.written[ord(c)] == c for c in _LETTERS if c.isascii())

    def pieces(self, text: str) -> str:
        """The pre-tokens of a text that is one pre-token at most, as the model reads them."""
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return "".join(p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text))

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def direct(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def known(self, chunk: str) -> bytes:
        found = self.memo.get(chunk)
        return self.remember(chunk, self.direct(chunk)) if found is None else found

    def letters(self, space: str, run: str) -> bytes:
        """Ids of a run of Latin letters after what the vocabulary keeps of a space."""
        text = run if self.plain and run.isascii() else run.translate(self.written)
        return self.pack(list(map(_ID, self.model.tokenize(space + text))))

    def word(self, word: str) -> bytes:
        """Ids of a run of Latin letters, with the space before it if the vocabulary keeps it."""
        return self.remember(word, self.letters(self.space, word[1:]) if word[0] == " " else self.letters("", word))

    def part(self, part: str) -> bytes | None:
        """Ids of a part not met before, with the space before it; None if it ends in white space, as for a chunk."""
        if part[-1].isspace() or part[-1] == "\u180e":
            return None
        if part[0] == "\n":
            if not _RUN.match(part, 1):
                return self.remember(part, self.direct(part), self.parts)
            ids = self.memo.get(part[1:]) or self.chunk(part[1:])
            return self.remember(part, self.known("\n") + ids, self.parts)
        run = part.rstrip(_PUNCTUATION)
        if not run.isalpha() or not (run.isascii() or _RUN.fullmatch(run)):
            return self.remember(part, self.direct(" " + part), self.parts)
        if len(run) == len(part):
            return self.remember(run, self.letters(self.space, run), self.parts)
        ids = self.parts.get(run)
        if ids is None:
            # a rare word needn't be remembered twice
            return self.remember(run, self.letters(self.space, run), self.parts) + self.known(part[len(run) :])
        return self.remember(part, ids + self.known(part[len(run) :]), self.parts)

    def chunk(self, chunk: str) -> bytes | None:
        """Ids of a chunk not met before, or None if it ends in white space that the next chunk may belong to."""
        last = chunk[-1]
        if last.isalpha() and _WORD.fullmatch(chunk):
            return self.word(chunk)
        if last not in " \n" and (last.isspace() or last == "\u180e"):
            return None
        m = _SIMPLE.fullmatch(chunk)
        if not m:
            return self.remember(chunk, self.direct(chunk))
        word, rest = m[1] + m[2], m[3]
        return self.remember(chunk, (self.memo.get(word) or self.word(word)) + self.known(rest))

    def remember(self, chunk: str, ids: bytes, memo: dict[str, bytes] | None = None) -> bytes:
        if len(self.memo) + len(self.parts) >= MEMO:
            # those met last go: the common ones were met early
            for full in (self.memo, self.parts):
                for _ in range(-(-len(full) // 2)):
                    full.popitem()
        if len(chunk) <= 64:
            (self.memo if memo is None else memo)[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text and the end id, packed as little-endian unsigned integers."""
        if not text:
            return self.end
        if "<" in text and any(t in text.lower() for t in self.added):
            return self.direct(text) + self.end
        spaced = text.replace("\n", " \n")
        if not ("  " in spaced or "\n " in spaced or spaced[0] == " " or spaced[-1] in " \n"):
            return self.split(text, spaced.split(" "))
        chunks = _CHUNK.findall(text)
        parts = list(map(self.memo.get, chunks))
        if None in parts:
            for k, ids in enumerate(parts):
                if ids is None:
                    ids = parts[k] = self.chunk(chunks[k])
                    if ids is None:
                        return self.direct(text) + self.end
        parts.append(self.end)
        return b"".join(parts)

    def split(self, text: str, parts: list[str]) -> bytes:
        """Ids of a text whose parts after the first follow a space or begin with a line feed."""
        first = self.memo.get(parts[0]) or self.chunk(parts[0])
        if first is None:
            return self.direct(text) + self.end
        found = list(map(self.parts.get, parts))
        found[0] = first
        found.append(self.end)
        for k in [k for k, ids in enumerate(found) if ids is None]:
            # it may have come before in this text
            ids = found[k] = self.parts.get(parts[k]) or self.part(parts[k])
            if ids is None:
                return self.direct(text) + self.end
        return b"".join(found)
