"""Token ids of whole texts from a public tokenizer file (`tokenizers`).

A byte-level BPE splits a text before it merges, and a single space or line
break between two characters that are no white space always starts such a
part.  So a text is cut there, every distinct part is encoded once a worker,
and a text's ids are the parts' ids strung together.  Parts with other white
space inside are encoded as they stand.  The table of known parts stops
growing at ``MAX_KNOWN``; parts beyond it are encoded batch by batch.

Ids are held as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import cache
from itertools import chain, islice

import numpy as np

MAX_KNOWN = 400_000
BREAK = re.compile(r"(?<=\S)\n(?=\S)")
GAP = re.compile(r"(?<=\S) (?=\S)")
#: How the byte-level alphabet writes the bytes for a space and a line break.
SPACE_CHAR, BREAK_CHAR = "Ġ", "Ċ"
#: ASCII marks, each of them a character of its own in that alphabet.
MARKS = frozenset(".,;:!?")


def _byte_chars() -> dict[int, str]:
    """The alphabet's rule: printable bytes stand for themselves, the others
    take the code points from 256 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


class Encoder:
    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are built as little-endian 32-bit numbers")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith(SPACE_CHAR)]] = True
        self.line_break = vocabulary[BREAK_CHAR]
        #: Marks, which stand behind very many words.
        self._kept: dict[str, bytes] = {}
        self._kept = {mark: self._merged(mark) for mark in MARKS}
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # first on its line, after a space

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _merged(self, piece: str) -> bytes:
        ids = self._kept.get(piece)
        return ids if ids is not None else array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()

    @staticmethod
    def _bytes(text: str) -> str:
        return text if text.isascii() else text.encode("utf-8").decode("latin-1").translate(BYTE_CHARS)

    def _encode(self, parts: list[str], after_space: bool) -> dict[str, bytes]:
        """Ids of distinct parts.  A run of letters is one piece to the merges,
        and so is a mark behind it: such parts go to the model directly.  The
        others without white space are encoded in one go."""
        out, whole = {}, []
        space = SPACE_CHAR if after_space else ""
        for p in parts:
            if p.isalpha():
                out[p] = self._merged(space + self._bytes(p))
            elif p[:-1].isalpha() and p[-1] in MARKS:
                out[p] = self._merged(space + self._bytes(p[:-1])) + self._merged(p[-1])
            elif p and not p.isspace() and len(p.split()) == 1 and p == p.strip():
                whole.append(p)
            else:
                out[p] = self._plain(f" {p}" if after_space else p).tobytes()
        for at in range(0, len(whole), 5000):
            block = whole[at : at + 5000]
            if after_space:
                ids = self._plain(" " + " ".join(block))
                cut = np.flatnonzero(self.starts[ids])
                ends = np.append(cut[1:], len(ids))
            else:
                ids = self._plain("\n".join(block))
                at_break = np.flatnonzero(ids == self.line_break)
                cut, ends = np.concatenate(([0], at_break + 1)), np.append(at_break, len(ids))
            if len(cut) != len(block):
                raise ValueError("the tokenizer does not split at white space")
            raw = ids.tobytes()
            out.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(block, cut.tolist(), ends.tolist(), strict=True))
        return out

    def encode(self, texts: list[str], step: int = 1000) -> list[bytes]:
        out = []
        for at in range(0, len(texts), step):
            out += self._block(texts[at : at + step])
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        lines = [[self._parts(line) for line in BREAK.split(t)] if t else [] for t in texts]
        heads = {parts[0] for text in lines for parts in text}
        tails = set(chain.from_iterable(islice(parts, 1, None) for text in lines for parts in text))
        extra = []
        for after_space, (known, seen) in enumerate(zip(self.known, (heads, tails), strict=True)):
            new = self._encode(list(seen.difference(known)), bool(after_space))
            if len(known) + len(new) > MAX_KNOWN:
                extra.append((known, new))
            known.update(new)
        first, rest = (known.__getitem__ for known in self.known)
        end = np.array([self.line_break], "<u4").tobytes()
        out = [end.join([first(parts[0]) + b"".join(map(rest, islice(parts, 1, None))) for parts in text]) for text in lines]
        for known, new in extra:
            for p in new:
                del known[p]
        return out

    @staticmethod
    def _parts(line: str) -> list[str]:
        parts = line.split(" ")
        return parts if parts == line.split() else GAP.split(line)


@cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)
