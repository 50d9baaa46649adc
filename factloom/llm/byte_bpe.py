"""Ids of a byte-level BPE vocabulary, the same as the tokenizers library gives, by a faster encoder of the same vocabulary."""

from __future__ import annotations

import array
import json
import re
import sys
from collections.abc import Iterator

# Fixed value: the split pattern that byte-level vocabularies are made for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEGMENT = 1 << 20  # characters of a long text tokenised at once
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")  # the pattern begins a new token here, whatever stands around
_LONG_BLANK = re.compile(r"\s{2000}")  # runs beyond this overflow the fast encoder's stack


def safe_parts(text: str, size: int | None = None) -> Iterator[str]:
    """The text in parts of about `size` characters, cut only before a space between two Latin letters."""
    size, start = size or SEGMENT, 0
    while len(text) - start > size and (cut := _SAFE.search(text, start + size)):
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: itself where it is printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """Tokenizer of a vocabulary file. The fast way is taken when the file says plain byte-level BPE with merges in the order of
    their ids, the plain one otherwise and for texts with very long runs of white space; both give the same ids."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        letters, vocabulary = _byte_letters(), told["model"]["vocab"]
        self.token_bytes = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
        for token, i in (vocabulary | added).items():
            self.token_bytes[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
        split = told.get("pre_tokenizer") or {}
        regular = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and told["normalizer"] is None
            and not told["model"].get("ignore_merges") and merged == sorted(merged) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]))
        ranks = {self.token_bytes[i]: i for token, i in vocabulary.items() if token not in added}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if regular else None
        self.added = added
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def ordinary(self, text: str) -> list[int]:
        """Ids of a text in which the names of special tokens are plain text."""
        if self.fast is None or _LONG_BLANK.search(text):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def ids(self, text: str) -> array.array:
        """Ids, as unsigned 32-bit numbers, of a text in which the names of special tokens are those tokens."""
        found = array.array("I")
        for part in self._cut.split(text) if any(name in text for name in self.added) else [text]:
            if part in self.added:
                found.append(self.added[part])
            elif part:
                for piece in safe_parts(part) if self.fast else [part]:
                    found.extend(self.ordinary(piece))
        return found


def little_endian(ids: array.array) -> bytes:
    if sys.byteorder != "little":
        ids = array.array("I", ids)
        ids.byteswap()
    return ids.tobytes()


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The tokenizer of a path, read once by each worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
