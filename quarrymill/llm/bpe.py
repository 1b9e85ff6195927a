"""Operator 3: BPE encoding and decoding, with tree concatenation for long texts.

A text of more than ``long_chars`` characters is cut at strings of special
tokens, which the tokenizer cuts out as well, and each piece in halves, again
and again, wherever the middles fall, until a part has at most
``segment_chars`` characters. Parts are rows of their own, which tasks encode
in parallel; shorter texts are encoded where they are read, in the same scan.

The parts' encodings are then joined pair by pair, as the leaves of a tree. At
a join the text between a certain cut on the left and one on the right is
encoded again; the window grows on each side until such a cut, which no match
of the splitting pattern can cross, is in it, so that what lies outside agrees
exactly. In text without cuts the window grows over all of it; if a word there
is long and reaches over the join, its tokens are encoded over a growing window
until the window's first token is the left part's and its last token the right
part's. An encoding is the right one if all neighbouring tokens are, so both
sides agree exactly.

``byte_bpe`` encodes where the tokenizer file allows it; for any other file
every text is encoded whole by the tokenizer's own library. Ids are equal.

Defined results: null encodes as the empty text (no ids); a text of any length
has the ids of the whole text, and a task holds one text's ids; repeated rows
are encoded each on its own; an empty table gives no rows; kept columns whose
names clash with a result column are left out, and columns of any other name
may be kept.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .byte_bpe import ByteEncoder, encoder
from .storage import materialise, quoted

LONG_CHARS = 1 << 13
SEGMENT_CHARS = 1 << 13
#: A word of up to so many characters is encoded as a whole at a join.
SHORT_WORD = 2048
# Unicode's white space, which is what the splitting pattern means by it (str.isspace knows four controls more).
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters and signs whose class no version of Unicode changes.
_LETTER, _SIGN = "A-Za-zß-öø-ÿа-яぁ-ゖァ-ヺ一-龥가-힣", "!-&(-/:-@\\[-`{-~。"
#: Places that no match crosses and where one starts: white space behind anything else, and a change of class.
CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[{_LETTER}])(?=[0-9'{_SIGN}])|(?<=[0-9])(?=['{_LETTER}{_SIGN}])|(?<=[{_SIGN}])(?=[0-9{_LETTER}])")
_BATCH_CHARS = 1 << 20

_LOADED: dict[str, tuple[Tokenizer, ByteEncoder | None]] = {}


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding; one for each Python worker.

    Tasks run side by side, so the library's own threads would only contend for cores.
    """
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok, encoder(tok)
    return _LOADED[path][0]


def quick_of(path: str) -> ByteEncoder | None:
    load(path)
    return _LOADED[path][1]


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text, as a whole."""
    tok, quick = load(path), quick_of(path)
    out: list = [quick.encode(t) if quick is not None and quick.takes(t) else None for t in texts]
    rest = [i for i, ids in enumerate(out) if ids is None]
    for i, e in zip(rest, tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = np.asarray(e.ids, np.uint32)
    return out


def decode_texts(path: str, ids: list[np.ndarray]) -> list[str]:
    tok, quick = load(path), quick_of(path)
    if quick is not None:
        return list(map(quick.decode, ids))
    return tok.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)


def pieces(text: str, specials: list[str]) -> list[str]:
    """The text cut at special tokens; each special token is a piece of its own."""
    if not specials:
        return [text]
    return [p for p in re.split("(" + "|".join(map(re.escape, specials)) + ")", text) if p]


def segments(text: str, limit: int, specials: list[str]) -> list[tuple[str, bool]]:
    """(part, joined): joined if the part goes on where the one before it was cut in halves."""
    return [part for p in pieces(text, specials) for part in ([(p, False)] if p in specials else _halves(p, limit, False))]


def _halves(run: str, limit: int, joined: bool) -> list[tuple[str, bool]]:
    if len(run) <= limit:
        return [(run, joined)]
    mid = len(run) // 2
    return _halves(run[:mid], limit, joined) + _halves(run[mid:], limit, True)


class Joiner:
    """Joins the ids of neighbouring parts of a text exactly."""

    def __init__(self, tok: Tokenizer, quick: ByteEncoder):
        self.tok, self.quick = tok, quick

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        return np.array([len(self.quick.bytes[i]) for i in ids.tolist()], np.int64)

    def _text(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.quick.bytes.__getitem__, ids.tolist()))

    def tail(self, ids: np.ndarray) -> tuple[str, int]:
        """The text behind the last certain cut, and how many tokens come before it."""
        k = 32
        while True:
            k = min(k, len(ids))
            data = self._text(ids[len(ids) - k :])
            # A token may start within a character.
            whole = data[next((i for i, b in enumerate(data[:4]) if b & 0xC0 != 0x80), len(data)) :].decode()
            cuts = [m.start() for m in CUT.finditer(whole)]
            if cuts or k == len(ids):
                text = whole[cuts[-1] if cuts else 0 :]
                size = len(text.encode())
                ends = np.cumsum(self._sizes(ids[len(ids) - k :])[::-1])
                return text, len(ids) - 1 - int(np.searchsorted(ends, size))
            k *= 2

    def head(self, ids: np.ndarray) -> tuple[str, int]:
        """The text before the first certain cut, and how many tokens it has."""
        k = 32
        while True:
            k = min(k, len(ids))
            text = self._text(ids[:k]).decode("utf-8", "ignore")
            cut = CUT.search(text)
            if cut or k == len(ids):
                text = text[: cut.start()] if cut else text
                return text, 1 + int(np.searchsorted(np.cumsum(self._sizes(ids[:k])), len(text.encode())))
            k *= 2

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(left) or not len(right):
            return left if len(left) else right
        (a, i), (b, j) = self.tail(left), self.head(right)
        return np.concatenate((left[:i], self._window(a, left[i:], b, right[:j]), right[j:]))

    def _window(self, a: str, left: np.ndarray, b: str, right: np.ndarray) -> np.ndarray:
        """Ids of the text a + b, whose parts have the ids ``left`` and ``right``."""
        if len(a) + len(b) <= SHORT_WORD:
            return self._encode(a + b)
        split = self.tok.pre_tokenizer.pre_tokenize_str
        before, behind = split(a)[-1][1], split(b)[0][1]
        over = a[before[0] :] + b[: behind[1]]
        out = []
        for _, (start, end) in split(a + b):
            word = (a + b)[start:end]
            if start < len(a) < end and len(word) > SHORT_WORD and word == over:
                i = len(left) - 1 - int(np.searchsorted(np.cumsum(self._sizes(left)[::-1]), len(a[before[0] :].encode())))
                j = 1 + int(np.searchsorted(np.cumsum(self._sizes(right)), len(b[: behind[1]].encode())))
                out.append(self.join_tokens(left[i:], right[:j]))
            else:
                out.append(self._encode(word))
        return np.concatenate(out)

    def _encode(self, text: str) -> np.ndarray:
        if self.quick.takes(text):
            return self.quick.encode(text)
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def join_tokens(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of one word from those of its halves: a window around the join grows until both sides agree."""
        name = self.tok.id_to_token
        i, j = min(8, len(left)), min(8, len(right))
        while True:
            window = "".join(map(name, left[len(left) - i :].tolist())) + "".join(map(name, right[:j].tolist()))
            ids = np.array([t.id for t in self.tok.model.tokenize(window)], np.uint32)
            left_agrees = i == len(left) or ids[0] == left[-i]
            right_agrees = j == len(right) or ids[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return np.concatenate((left[: len(left) - i], ids, right[j:]))
            i = i if left_agrees else min(2 * i, len(left))
            j = j if right_agrees else min(2 * j, len(right))

    def tree(self, parts: list[np.ndarray]) -> np.ndarray:
        while len(parts) > 1:
            parts = [self.join(*p) if len(p) == 2 else p[0] for p in (parts[k : k + 2] for k in range(0, len(parts), 2))]
        return parts[0]

    def whole(self, parts: list[np.ndarray], joined: list[bool]) -> np.ndarray:
        starts = [k for k, j in enumerate(joined) if not j] + [len(parts)]
        return np.concatenate([np.empty(0, np.uint32), *(self.tree(parts[a:b]) for a, b in pairwise(starts))])


def encode_tree(tok: Tokenizer, text: str, limit: int) -> list[int]:
    """Ids of a text by parts of at most ``limit`` characters, joined exactly."""
    quick = next((q for t, q in _LOADED.values() if t is tok), None) or encoder(tok)
    joiner, cut = Joiner(tok, quick), segments(text, limit, sorted(quick.special))
    return joiner.whole([joiner._encode(p) for p, _ in cut], [j for _, j in cut]).tolist()


def _digest(ids) -> str:
    return hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _groups(texts: list[str]):
    """Index ranges of at most about ``_BATCH_CHARS`` characters, which bounds what an encoder call holds."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total > _BATCH_CHARS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32)))


_NEW = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_PART = "__uid long, __at long, __joined boolean, __part string"


def _results(path: str, ids: list[np.ndarray], with_ids: bool) -> list[pa.Array]:
    decoded = [_sha(t) for t in decode_texts(path, ids)]
    out = [pa.array(list(map(len, ids)), pa.int64()), pa.array(list(map(_digest, ids)), pa.string()), pa.array(decoded, pa.string())]
    return [*out, _lists(ids)] if with_ids else out


def _first_pass(path: str, long: int, limit: int, keep: list[str], out: pa.Schema, with_ids: bool):
    """Short texts are encoded; of long ones, each part is a row, the first with what is kept of the document."""
    new = 3 + with_ids

    def run(batches):
        quick = quick_of(path)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            is_long = np.array([quick is not None and len(t) > long for t in texts], bool)
            kept = [batch.column(c).cast(out.field(c).type) for c in keep]
            short = np.flatnonzero(~is_long)
            chosen = [texts[i] for i in short]
            for a, b in _groups(chosen):
                rows = pa.array(short[a:b])
                none = [pa.nulls(b - a, f.type) for f in list(out)[-4:]]
                yield pa.RecordBatch.from_arrays([*(k.take(rows) for k in kept), *_results(path, encode_texts(path, chosen[a:b]), with_ids), *none], schema=out)
            for i in np.flatnonzero(is_long).tolist():
                parts = segments(texts[i], limit, sorted(quick.special))
                n, first = len(parts), pa.array([i] + [None] * (len(parts) - 1), pa.int64())
                none = [pa.nulls(n, f.type) for f in list(out)[len(keep) : len(keep) + new]]
                cols = [np.full(n, uid), np.arange(n), np.array([j for _, j in parts]), [t for t, _ in parts]]
                yield pa.RecordBatch.from_arrays([*(k.take(first) for k in kept), *none, *(pa.array(c, f.type) for c, f in zip(cols, list(out)[-4:], strict=True))], schema=out)
                uid += 1

    return run


def _width(path: str) -> str:
    """Type in which ids travel between tasks."""
    return "<u2" if load(path).get_vocab_size() < 1 << 16 else "<u4"


def _encode_parts(path: str):
    def run(batches):
        for batch in batches:
            ids = [i.astype(_width(path)).tobytes() for i in encode_texts(path, batch.column("__part").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__uid", "__at", "__joined")), pa.array(ids, pa.binary())], names=["__uid", "__at", "__joined", "ids"])

    return run


def _assemble(path: str, with_ids: bool):
    """One text's ids from its parts; what a task holds is one text's ids."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__at")
        ids = Joiner(load(path), quick_of(path)).whole([np.frombuffer(i, _width(path)).astype(np.uint32) for i in pdf["ids"]], pdf["__joined"].tolist())
        out = {"__uid": [pdf["__uid"].iloc[0]], "n_tokens": [len(ids)], "ids_sha256": [_digest(ids)], "decoded_sha256": [_sha(decode_texts(path, [ids])[0])]}
        return pd.DataFrame(out | ({"ids": [ids.astype(np.int32)]} if with_ids else {}))

    return run


def encode_documents(
    docs: DataFrame, tokenizer: str, keep: list[str] | None = None, text: str = "text", with_ids: bool = False, whole_chars: int = LONG_CHARS, segment_chars: int = SEGMENT_CHARS
) -> DataFrame:
    """The ``keep`` columns with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    ``tokenizer``: path of a tokenizer file that every executor can open.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T.StructType.fromDDL(_NEW + ", ids array<int>" * with_ids)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    named = docs.select(*(F.col(quoted(c)).alias(f"__k{i}") for i, c in enumerate(keep)), F.col(quoted(text)).alias("__text"))
    kept = named.columns[:-1]
    # Of a long text only the first part's row has what is kept, so all of it may be null here.
    fields = [T.StructField(f.name, f.dataType) for f in named.schema.fields[:-1]]
    schema = T.StructType([*fields, *new.fields, *T.StructType.fromDDL(_PART).fields])
    first = materialise(named.mapInArrow(_first_pass(tokenizer, whole_chars, segment_chars, kept, to_arrow_schema(schema), with_ids), schema), "bpe-first")

    parts = first.where("__uid is not null").select("__uid", "__at", "__joined", "__part")
    encoded = parts.repartition("__uid", "__at").mapInArrow(_encode_parts(tokenizer), "__uid long, __at long, __joined boolean, ids binary")
    joined = encoded.groupBy("__uid").applyInPandas(_assemble(tokenizer, with_ids), T.StructType([T.StructField("__uid", T.LongType()), *new.fields]))
    long = first.where("__at = 0").select("__uid", *kept).join(joined, "__uid")
    out = first.where("__uid is null").select(*kept, *new.names).unionByName(long.select(*kept, *new.names))
    return out.select(*(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)), *new.names)
