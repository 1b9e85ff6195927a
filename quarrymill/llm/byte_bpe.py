"""A quicker encoder for byte-level BPE files whose ids follow the order of their merges.

Both libraries merge the neighbours of lowest rank first. One looks pairs up in
the list of merges, the other takes any two neighbours whose concatenation is a
token. If every token's own text encodes to that token alone, and a token's
parts have smaller ids, these are the same pairs: where two neighbours make up
token s, the merges inside s so far are those made when s stands alone, so the
neighbours are the very pair that the list has for s. ``encoder`` checks this,
and the settings, and returns None for any other tokenizer.

The splitting pattern is the one built into the byte-level pre-tokenizer; the
tests compare both libraries on every code point.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with longer runs go to the tokenizer's own library, whose cost stays near linear in a run.
RUN = 1 << 15
_LONG_RUN = re.compile(r"\S{%d}|\s{%d}" % (RUN, RUN))


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte: itself if it is printable Latin-1, else one from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    def __init__(self, ranks: dict[bytes, int], special: dict[str, int]):
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.bytes = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special.items()}

    def takes(self, text: str) -> bool:
        return len(text) < RUN or not _LONG_RUN.search(text)

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=self.special)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encoder(tok: Tokenizer) -> ByteEncoder | None:
    spec = json.loads(tok.to_str())
    model, split, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
    settings = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model["type"] != "BPE" or any(model.get(k) for k in settings) or spec["normalizer"] or spec["post_processor"]:
        return None
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or (spec["decoder"] or {}).get("type") != "ByteLevel":
        return None
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] or not a["special"] or not a["content"].isascii() for a in added):
        return None
    if any(not 33 <= ord(c) < 127 for a in added for c in a["content"]):
        return None
    special, chars, vocab = {a["content"]: a["id"] for a in added}, byte_characters(), model["vocab"]
    words = [w for w in vocab if w not in special]
    if any(c not in chars for w in words for c in w) or any(c not in vocab for c in chars):
        return None
    if any(len(tok.model.tokenize(w)) != 1 for w in words):
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocab[a + b] for a, b in merges]
    if ids != sorted(ids) or any(max(vocab[a], vocab[b]) >= i for (a, b), i in zip(merges, ids, strict=True)) or len(ids) + len(chars) != len(words):
        return None
    return ByteEncoder({bytes(chars[c] for c in w): vocab[w] for w in words}, special)
