"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the characters cuts texts into chunks, so texts that share
a passage share chunks wherever the passage stands.  A chunk is encoded once
and looked up from then on (in the Python worker that met it; nothing is
shuffled).  Only the inside of a chunk is taken over as it is: from its first
to its last place where a text may be cut (``pieces``).  What is left at both
ends is joined with the ends of the neighbours and encoded anew, over as many
chunks as it takes to reach such a place on either side, so that the ids agree
exactly with those of the whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from echoline.llm.common import map_texts
from echoline.llm.pieces import SAFE_CUT, PieceEncoder, Recent, check_decoding, split_pieces

MEAN_CHUNK, MIN_CHUNK = 256, 64
KEPT_CHUNKS = 20_000


def cut_points(text: str, mean: int = MEAN_CHUNK, least: int = MIN_CHUNK) -> list[int]:
    """Places where the hash of the last 16 characters has its low bits all zero, ``least`` apart or more."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    if len(c) <= least:
        return [len(c)]
    h = c * np.uint32(2654435761) ^ (c >> np.uint32(3))
    with np.errstate(over="ignore"):
        for width, factor in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (4, 0xC2B2AE35), (8, 0x27D4EB2F)):
            h[width:] = h[width:] + h[:-width].copy() * np.uint32(factor)
    h ^= h >> np.uint32(15)
    cuts, last = [], 0
    for at in (np.flatnonzero(h % np.uint32(mean) == 0) + 1).tolist():
        if at - last >= least:
            cuts.append(at)
            last = at
    if last < len(c):
        cuts.append(len(c))
    return cuts


def piece_values(ids: list[list[int]], tokenizer) -> list[tuple[int, bytes, bytes]]:
    """(number of ids, their decimal form with a comma before each, decoded bytes)."""
    texts = tokenizer.decode_batch(ids, skip_special_tokens=False)
    return [(len(i), f",{','.join(map(str, i))}".encode() if i else b"", t.encode("utf-8")) for i, t in zip(ids, texts)]


class ChunkEncoder:
    def __init__(self, path: str, kept: int = KEPT_CHUNKS):
        self.encoder = PieceEncoder.shared(path, piece_values, _join)
        check_decoding(self.encoder.tokenizer)
        self.chunks = Recent(kept)
        self.reused = self.encoded = 0

    def _plan(self, text: str) -> list:
        """The document in order: a chunk's inside (its text), or a joined end that is encoded anew."""
        plan, open_end, start = [], "", 0
        for end in cut_points(text):
            chunk = text[start:end]
            start = end
            first = SAFE_CUT.search(chunk)
            if first is None:
                open_end += chunk
                continue
            head = first.start()
            last = _last_cut(chunk)
            plan.append((False, open_end + chunk[:head]))
            if last > head:
                plan.append((True, chunk[head:last]))
            open_end = chunk[last:]
        plan.append((False, open_end))
        return plan

    def encode(self, texts: list[str]) -> list[list[tuple[int, bytes, bytes]]]:
        """For each text the values of its parts, in order."""
        plans = [self._plan(t) for t in texts]
        inside: dict[str, list | tuple] = {}
        wanted: set[str] = set()
        ends: dict[str, list[str]] = {}
        for plan in plans:
            for is_chunk, part in plan:
                if is_chunk:
                    if part not in inside:
                        known = self.chunks.get(part)
                        if known is None:
                            known = split_pieces(part)
                            wanted.update(known)
                            self.encoded += 1
                        inside[part] = known
                    else:
                        self.reused += 1
                elif part not in ends:
                    ends[part] = split_pieces(part)
                    wanted.update(ends[part])
        values = self.encoder.lookup(wanted)
        for part, known in inside.items():
            if isinstance(known, list):
                inside[part] = _join([values[p] for p in known])
                self.chunks.put(part, inside[part])
            else:
                self.reused += 1
        joined = {part: _join([values[p] for p in pieces]) for part, pieces in ends.items()}
        return [[inside[p] if is_chunk else joined[p] for is_chunk, p in plan] for plan in plans]


def _last_cut(chunk: str) -> int:
    """Where the last safe cut lies; there is one."""
    at = len(chunk)
    while True:
        at = max(chunk.rfind(s, 0, at) for s in " \t\r\n")
        if at > 0 and not chunk[at - 1].isspace():
            return at


def _join(values: list[tuple[int, bytes, bytes]]) -> tuple[int, bytes, bytes]:
    numbers, ids, decoded = zip(*values) if values else ((), (), ())
    return sum(numbers), b"".join(ids), b"".join(decoded)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """All columns of ``docs`` but text, and: n_tokens, ids (decimal, joined by commas), decoded (the text the ids stand for).

    Null and empty texts have no ids.  Texts of any length are encoded whole; repeated rows each give a
    row, an empty table none.  Columns of ``docs`` that have one of these names are replaced.  A tokenizer
    whose pieces can't be encoded and decoded one by one ends the job (``pieces.UnknownTokenizer``).
    """

    def make():
        chunks = ChunkEncoder(tokenizer_path)

        def work(texts: list[str]) -> dict:
            parts = chunks.encode(texts)
            return {
                "n_tokens": [sum(v[0] for v in p) for p in parts],
                "ids": [b"".join([v[1] for v in p])[1:].decode() for p in parts],
                "decoded": [b"".join([v[2] for v in p]).decode() for p in parts],
            }

        return work

    return map_texts(docs.drop("n_tokens", "ids", "decoded"), "text", make, "n_tokens long, ids string, decoded string")


def digest_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """As ``encode_documents``, with SHA-256 sums instead of ids and decoded text."""

    def make():
        chunks = ChunkEncoder(tokenizer_path)

        def work(texts: list[str]) -> dict:
            parts = chunks.encode(texts)
            return {
                "n_tokens": [sum(v[0] for v in p) for p in parts],
                "ids_sha256": [hashlib.sha256(b"".join([v[1] for v in p])[1:]).hexdigest() for p in parts],
                "decoded_sha256": [hashlib.sha256(b"".join([v[2] for v in p])).hexdigest() for p in parts],
            }

        return work

    return map_texts(docs.drop("n_tokens", "ids_sha256", "decoded_sha256"), "text", make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
