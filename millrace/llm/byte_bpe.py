"""Byte-level BPE encoding and decoding in linear time.

Every token is entered into an Aho-Corasick automaton as a Latin-1 string, one character a byte.  One
pass over a piece of text gives the longest token that starts at each byte.  The encoder then walks
from left to right, always trying the longest token first and falling back to its longest proper
prefix that is a token, and steps back when no token fits.  A token may follow another if and only if
the two stay apart when their joined bytes are merged by rank; that answer depends on the pair alone
and is memoised.  A position that has been left once is never entered again, so the walk is linear.

Nulls are encoded as the empty text.  Empty texts give no ids.  Repeated rows give repeated results;
an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_arrow, refuse_clash
from .words import chunks, forget

#: Entries of the caches of a worker; beyond that they are emptied, so memory stays bounded.
PIECES_KEPT, PAIRS_KEPT, LONGEST_KEPT_PIECE = 250_000, 300_000, 64
#: Bytes of text whose ids are made at once, about.
BLOCK_BYTES = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    """Encoder and decoder over a rank file; splits text by ``pattern`` first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pair_to_id: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.known: dict[int, bool] = {}  # of two tokens, whether the second may follow the first
        size = max(ranks.values(), default=-1) + 1
        self.shorter, self.length = [-1] * size, [0] * size
        made: set[bytes] = set()  # tokens that merging can produce
        for tok, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.halves[i] = (i, i)
            if len(tok) == 1:
                made.add(tok)
                continue
            for cut in range(len(tok) - 1, 0, -1):
                a, b = tok[:cut], tok[cut:]
                if a in made and b in made and self._apart(ranks[a], ranks[b]):
                    self.pair_to_id[ranks[a], ranks[b]] = i
                    self.halves[i] = (ranks[a], ranks[b])
                    made.add(tok)
                    break
        if any(bytes([i]) not in made for i in range(256)):
            raise ValueError("the rank file lacks single bytes")
        auto = ahocorasick.Automaton()
        for tok in made:
            i = ranks[tok]
            self.length[i] = len(tok)
            auto.add_word(tok.decode("latin-1"), (len(tok) - 1, i))
            for cut in range(len(tok) - 1, 0, -1):
                if tok[:cut] in made:
                    self.shorter[i] = ranks[tok[:cut]]
                    break
        auto.make_automaton()
        self.matches = auto.iter
        self._pieces = _Pieces(self)

    def _apart(self, a: int, b: int) -> bool:
        """True if a merge by rank of a's and b's joined bytes never crosses the border between them.

        Undo the later of the two merges step by step and look at what meets at the border: if that
        pair itself merges, before the merge that was undone last, the border would have vanished.
        """
        until = 1 << 62
        while True:
            if self.pair_to_id.get((a, b), until) < until:
                return False
            if a > b:
                inner = self.halves[a][1]
                if inner != a:
                    until, a = a, inner
                    continue
                inner = self.halves[b][0]
                if inner == b:
                    return True
                until, b = b + 1, inner
            else:
                inner = self.halves[b][0]
                if inner != b:
                    until, b = b + 1, inner
                    continue
                inner = self.halves[a][1]
                if inner == a:
                    return True
                until, a = a, inner

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * (n + 1)
        for end, (back, i) in self.matches(piece.decode("latin-1")):
            longest[end - back] = i  # ends rise, so the longest stays
        known, length, shorter = self.known, self.length, self.shorter
        if len(known) >= PAIRS_KEPT:
            known.clear()
        left = bytearray(n + 1)  # positions that the walk has stepped back from
        out: list[int] = []
        tok, last, pos = longest[0], -1, 0
        while pos < n:
            end = pos + length[tok]
            if not left[end]:
                if last < 0:
                    fit = True
                elif (fit := known.get(key := last << 32 | tok)) is None:
                    fit = known[key] = self._apart(last, tok)
                if fit:
                    out.append(tok)
                    pos, last, tok = end, tok, longest[end]
                    continue
            while (tok := shorter[tok]) < 0:
                left[pos] = 1
                tok = out.pop()
                pos -= length[tok]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._pieces.__getitem__, self.find(text)))

    def decode(self, packed: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class _Pieces(dict):
    """Packed ids by piece of text, computed on first use."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        import struct

        ids = self.bpe.encode_piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_KEPT_PIECE:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = packed
        return packed


_loaded: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    """One encoder a process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode each text and decode it again.

    Returns the id column, the columns in ``keep``, ``ids`` (packed little-endian 32-bit, if asked for),
    ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.  ``path`` is a place on every worker.
    """
    refuse_clash((id_col, *keep), ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))
    cols = [id_col, *[c for c in keep if c not in (id_col, text_col)]]
    src = docs.select(*[docs[c] for c in cols], docs[text_col].alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "__text"]
    if text_col in keep:
        fields.append(f"`{text_col}` string")
    schema = ", ".join([*fields, *(["ids binary"] if ids else []), "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"])
    with_text = text_col in keep

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = loaded(path, pattern)
        forget()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in (part for whole in batches for part in chunks(whole, most=BLOCK_BYTES)):
            packed, decoded = [], []
            for text in batch.column("__text"):
                packed.append(p := bpe.encode(text.as_py() or ""))
                decoded.append(sha(bpe.decode(p)))
            arrays = [batch.column(c) for c in cols]
            if with_text:
                arrays.append(batch.column("__text"))
            if ids:
                arrays.append(pa.array(packed, pa.binary()))
            arrays += [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(map(sha, packed), pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*cols, *([text_col] if with_text else []), *(["ids"] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(src, run, schema)
