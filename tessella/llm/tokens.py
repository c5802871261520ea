"""Token ids of whole texts by a public byte-level BPE.

The ids are those of the ``tokenizers`` library for the given vocabulary file.
The same vocabulary read as ranks gives the same ids about five times faster
through ``tiktoken``; that way is taken for texts of characters up to U+024F
and common punctuation, whose classes are the same in every Unicode version.
Texts with anything else, with control characters or with a special token's
string go through ``tokenizers`` itself, as does every text when the file is
not a plain byte-level BPE whose merges stand in the order of their ids.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSURE = "[^\t-\r -~\xa0-ɏ–—‘-”…]"


def _ranks(path: str) -> tuple[dict[bytes, int] | None, list[str]]:
    """Ranks of the vocabulary by bytes, or None where they would not give the same ids; special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    special = [t["content"] for t in spec.get("added_tokens", [])]
    plain_bpe = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback"))
    if not plain_bpe or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None, special
    ids = model["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    order = [ids[m] for m in merged]
    if order != sorted(order):
        return None, special
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*printable}))}
    return {bytes(byte_of[c] for c in t): i for t, i in ids.items() if t not in special}, special


class Encoder:
    """ids(text): little-endian unsigned 32-bit words."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        if not os.path.isabs(tokenizer):
            import public_tokenizers

            tokenizer = str(public_tokenizers.path(tokenizer))
        self._slow = Tokenizer.from_file(tokenizer)
        ranks, special = _ranks(tokenizer)
        self._fast = None
        if ranks is not None:
            self._fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._unsure = re.compile("|".join([_UNSURE, *map(re.escape, special)]))

    def ids(self, text: str) -> bytes:
        if self._fast is None or self._unsure.search(text):
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self._fast(text), "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """One per worker process and vocabulary file (an absolute path, or a name that public_tokenizers knows)."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer]
