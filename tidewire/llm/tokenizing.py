"""Exact ids of the tokenizers library for many texts, with the work of repeated pre-tokens done once.

Both tokenizers cut a text into pre-tokens by a pattern and encode each pre-token by itself, so ids can be kept by pre-token.
A plain text (ASCII and Latin letters up to U+017F) is cut here by the tokenizer's own pattern, written with the classes as
they are in that range, and each pre-token goes to the library's BPE model. In any other text the runs of visible characters
(with the white space before them) are cut apart, which no pre-token spans, and each that is not plain goes through the
library's whole ``encode``, as does a text with white space that engines class differently, and any text if the tokenizer comes from
another file than the two that the patterns are for. The cache is bounded and only saves time.
"""

from __future__ import annotations

import filecmp
import re
from functools import cache as once

import numpy as np

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"

#: Letters, numbers and white space of a plain text.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \\t-\\r"
#: The pre-token patterns of the two tokenizer files, for plain texts.
PATTERNS = {
    WORD_BPE: rf"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_S}{_L}{_N}]+",
    BYTE_BPE: rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+| ?[{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+",
}
#: No dotted capital I: its small form is two characters.
_PLAIN = re.compile(r"[\t-\r -~\xa1-\u012f\u0131-\u017f]*")
#: White space besides the ASCII one, and separators that only some engines count as such.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PIECES = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level BPE: itself if it is printable, else the next from U+0100."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str, path: str | None = None, most: int = 500_000) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        own = public_tokenizers.path(name)
        self.known = path is None or filecmp.cmp(path, own, shallow=False)
        self.whole = Tokenizer.from_file(path or own)
        self.cut = re.compile(PATTERNS[name]).findall
        self.folds = name == WORD_BPE
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.most = most

    def full(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: set[str]) -> None:
        if len(self.parts) + len(parts) > self.most:
            self.parts = {}
        letters, tokenize, held = self.letters, self.whole.model.tokenize, self.parts
        for p in parts:
            if p not in held:
                held[p] = np.array([t.id for t in tokenize("".join([letters[b] for b in p.encode()]))], "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        parts = self.cut(text.lower() if self.folds else text)
        try:
            held = self.parts
            return b"".join([held[p] for p in parts])
        except KeyError:
            self._learn(set(parts))
            held = self.parts
            return b"".join([held[p] for p in parts])

    def encode(self, text: str) -> bytes:
        if not self.known or "<|" in text or _ODD_SPACE.search(text):
            return self.full(text)
        if _PLAIN.fullmatch(text):
            return self._plain(text)
        return b"".join([self._plain(p) if _PLAIN.fullmatch(p) else self.full(p) for p in _PIECES.findall(text)])


@once
def encoder(name: str, path: str | None = None) -> Encoder:
    """One for each Python worker."""
    return Encoder(name, path)
