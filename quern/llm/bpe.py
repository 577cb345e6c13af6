"""Byte-level BPE by monoid tree reduction (operator 6).

A text is a tree of halves. Leaves are encoded as they are; two neighbours join by re-encoding a window
around their border. The window grows until each of its ends is a place where a character that is not
white space meets a space or a line feed. No match of the split pattern crosses such a place, none before
it depends on what follows, and a search that starts there finds what a search from the start finds, so
the tokens outside the window stand. Without such a place the window grows to the end of that half.
Decoding concatenates up the same tree.

The vocabulary's rank file is read by the driver and travels with the tasks (its size is the vocabulary's).
Null or empty text: no tokens.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame

from quern.llm.common import column_bytes

LEAF = 256  # characters
PIECE = 4 << 20  # bytes of text whose ids are held at once
_coders: dict[int, Coder] = {}


class Coder:
    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.plain = tiktoken.Encoding("quern", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size = {rank: len(token) for token, rank in table.items()}
        self.leaf = leaf

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, stop: int) -> list[int]:
        if stop - start <= self.leaf:
            return self.plain.encode_ordinary(text[start:stop])
        middle = (start + stop) // 2
        left, right = self._encode(text, start, middle), self._encode(text, middle, stop)
        return self._join(text, start, middle, stop, left, right)

    def _join(self, text: str, start: int, middle: int, stop: int, left: list[int], right: list[int]) -> list[int]:
        i, reach = middle, 64
        while i > start and not stable(text, i):
            i = next((k for k in range(i - 1, max(start, middle - reach), -1) if stable(text, k)), max(start, middle - reach))
            reach *= 2
        j, reach = middle, 64
        while j < stop and not stable(text, j):
            j = next((k for k in range(j + 1, min(stop, middle + reach)) if stable(text, k)), min(stop, middle + reach))
            reach *= 2
        before, after = len(left) - self._tokens(reversed(left), text[i:middle]), self._tokens(right, text[middle:j])
        return left[:before] + self.plain.encode_ordinary(text[i:j]) + right[after:]

    def _tokens(self, ids, text: str) -> int:
        """How many of the first ids spell this text."""
        n, left, ids = 0, len(text.encode()), iter(ids)
        while left > 0:
            left -= self.size[next(ids)]
            n += 1
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.plain.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def stable(text: str, i: int) -> bool:
    return text[i] in " \n" and not text[i - 1].isspace()


def coder(ranks: bytes, pattern: str, leaf: int) -> Coder:
    key = hash((ranks, pattern, leaf))
    if key not in _coders:
        _coders[key] = Coder(ranks, pattern, leaf)
    return _coders[key]


def _pieces(batch: pa.RecordBatch):
    """The rows of a batch in slices of about PIECE bytes of text."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + PIECE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF, with_ids: bool = True, with_decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids (array) and decoded (binary) on request."""
    with open(ranks_path, "rb") as f:
        ranks = f.read()

    def run(batches):
        own = coder(ranks, pattern, leaf)
        for batch in batches:
            for part in _pieces(batch):
                n, digests, back, all_ids, decoded = [], [], [], [np.zeros(0, np.int32)], []
                for text in column_bytes(part["text"]):
                    ids = own.encode(text.decode())
                    out = own.decode(ids)
                    n.append(len(ids))
                    packed = np.array(ids, "<u4")
                    digests.append(hashlib.sha256(packed).hexdigest())
                    back.append(hashlib.sha256(out).hexdigest())
                    if with_ids:
                        all_ids.append(packed.astype(np.int32))
                    if with_decoded:
                        decoded.append(out)
                columns = [part["doc_id"], pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
                columns += [pa.ListArray.from_arrays(np.cumsum([0, *n]).astype(np.int32), np.concatenate(all_ids))] if with_ids else []
                columns += [pa.array(decoded, pa.binary())] if with_decoded else []
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded binary" * with_decoded
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)
