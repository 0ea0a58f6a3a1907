"""Pre-tokens and ids of a byte-level BPE, as the ``tokenizers`` library gives them."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: The vocabulary file, by the name that the tokenizer package gives it.
VOCABULARY = "byte_bpe_50k.json"
#: Texts of other characters than these go to ``tokenizers`` as they are. Within them the classes of
#: Python's ``re`` and of the libraries' expressions agree on letters, digits and white space.
_OTHER = re.compile("[^\\t\\n\\r -~¡«»¿À-ɏА-я–-…€]")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: tiktoken's merge takes time with the square of a pre-token's length; a block of so many characters without a space goes to ``tokenizers``.
_RUN = 1000


class Tokenizer:
    """One vocabulary in a Python worker.

    Common texts are merged by tiktoken from the ranks of the same vocabulary, about eight times as
    fast; all others by ``tokenizers`` itself, which defines the result. ``<|endoftext|>`` inside a
    text is the special token, the default of ``tokenizers``. No token is added at either end.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tiktoken
        from tokenizers import Tokenizer as Exact

        self.exact = Exact.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        spec = json.loads(open(path, encoding="utf-8").read())
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        to_byte = {c: b for b, c in _byte_alphabet().items()}
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=_pattern(), mergeable_ranks=ranks, special_tokens={})

    def _common(self, text: str) -> bool:
        if _OTHER.search(text):
            return False
        return not any(" " not in (part := text[i : i + _RUN]) or part.isspace() for i in range(0, len(text) - _RUN + 1, _RUN))

    def ids(self, text: str) -> np.ndarray:
        if not self._common(text) or (self._special and any(s in text for s in self.special)):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def split(self, text: str) -> list[str]:
        """The pre-tokens, special tokens among them as themselves."""
        if self._special and any(s in text for s in self.special):
            return [p for part in self._special.split(text) if part for p in ([part] if part in self.special else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not _OTHER.search(text):
            return _SPLIT.findall(text)
        to_byte = {c: b for b, c in _byte_alphabet().items()}
        return [bytes(to_byte[c] for c in p).decode() for p, _ in self.exact.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, pre_token: str) -> int:
        """How many tokens one pre-token becomes."""
        return len(self.ids(pre_token))


@lru_cache
def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=4)
def load(path: str | None = None) -> Tokenizer:
    """The tokenizer of ``path``, once for each Python worker; None: the installed default vocabulary, looked up where the code runs."""
    return Tokenizer(path or default_path())
