"""Token ids of words under a public word-end BPE vocabulary, cached by word.

White space is dropped by that vocabulary's rules, so a text's ids are those of its white-space words one after the other.
Words of ASCII and extended Latin are split by the vocabulary's own pattern and merged by `tiktoken`, for which
the word-end mark is spelled as a final NUL; merges rank by id, so the merges are the same. All other words, and texts with
special tokens in them, go to `tokenizers` itself.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np
import regex

CACHE_WORDS = 200_000
_PLAIN = regex.compile(r"[!-~À-įı-ɏ]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_END = "\0"


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordIds:
    """Little-endian 32-bit ids of texts as bytes; holds at most `CACHE_WORDS` words."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        stands_for = _byte_characters()
        ranks = {}
        for token, number in vocabulary.items():
            ended = token.endswith("</w>")
            spelled = bytes(stands_for[c] for c in (token[:-4] if ended else token))
            if not (ended and spelled == b"\0"):
                ranks[spelled + b"\0" * ended] = number
        self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.ends[[n for spelled, n in ranks.items() if len(spelled) > 1 and spelled[-1] == 0]] = True
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _split(self, word: bytes) -> list[str] | None:
        """The pieces that the vocabulary's pattern cuts a lower-case word into; None if only `tokenizers` may tell."""
        text = word.decode()
        if not text.isascii() and not _PLAIN.fullmatch(text):
            return None
        text = text.lower()
        if text.isalpha():
            return [text]
        if text[-1] in ".," and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        return _PIECE.findall(text) if _PLAIN.fullmatch(text) else None

    def _learn(self, words: set[bytes]) -> None:
        known, split, asked = self.pieces, [], {}
        for word in words:
            found = self._split(word)
            if found is None:
                ids = self.exact.encode(word.decode(), add_special_tokens=False).ids
                self.words[word] = np.array(ids, dtype="<u4").tobytes()
                continue
            split.append((word, found))
            for p in found:
                if p not in known:
                    asked[p] = None
        if asked:
            ids = np.array(self.merge.encode_ordinary(_END.join(asked) + _END), dtype="<u4")
            packed, low = ids.tobytes(), 0
            for piece, high in zip(asked, (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), strict=True):
                known[piece] = packed[low:high]
                low = high
        for word, found in split:
            self.words[word] = known[found[0]] if len(found) == 1 else b"".join([known[p] for p in found])

    def forget(self) -> None:
        self.words.clear()
        self.pieces.clear()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts in UTF-8; words that are new are learnt together."""
        split = [None if b"<|" in t else t.lower().split() for t in texts]
        seen: set[bytes] = set()
        for words in split:
            seen.update(words or ())
        missing = seen.difference(self.words)
        if len(self.words) + len(missing) > CACHE_WORDS:
            self.forget()
            missing = seen
        self._learn(missing)
        known = self.words
        return [
            np.array(self.exact.encode(t.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            if words is None
            else b"".join([known[w] for w in words])
            for t, words in zip(texts, split, strict=True)
        ]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One encoder for all tasks that a Python worker runs."""
    return WordIds(path)
