"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so that one pyahocorasick automaton over the vocabulary
finds every token that occurs in a piece. The encoder then walks from the start, taking the
longest token that is compatible with the one before it (the two would not have been merged
differently had they stood side by side) and stepping back where none is. Compatibility of a
pair of tokens is memoised, and no position is tried twice, so a piece takes time linear in its
length; the result is that of applying the merges in order of rank.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from stripchart.llm.common import over_batches, table, text_slices
from stripchart.llm.tokens import PieceCache, file_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Compatible and incompatible pairs a worker remembers.
PAIRS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_in_order(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The plain rule: merge the neighbours of least rank, leftmost first, until none merges.
    With `below`, only merges into tokens of smaller rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None and (below is None or r < below)]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class BacktrackingBPE:
    """Encoder and decoder for a table of ranks that holds all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        if len([t for t in ranks if len(t) == 1]) != 256:
            raise ValueError("the ranks must hold all 256 single bytes")
        self.ranks = ranks
        self.bytes_of: dict[int, bytes] = {r: t for t, r in ranks.items()}
        self.length: dict[int, int] = {r: len(t) for t, r in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.words = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merge_in_order(token, ranks, below=rank)
                if len(parts) != 2:  # no order of merges makes it: only a whole piece can be it
                    continue
                self.halves[rank] = pair = (ranks[parts[0]], ranks[parts[1]])
                self.merged[pair] = rank
            self.words.add_word(token.decode("latin-1"), rank)
        self.words.make_automaton()
        self.memo: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE over the joined bytes of the two tokens leaves them as they are: no merge
        across the border may come before the merges that built the border's two sides. Both
        sides are taken apart from the later merge to the earlier one."""
        pair = (left, right)
        known = self.memo.get(pair)
        if known is None:
            if len(self.memo) >= PAIRS:
                self.memo.clear()
            known = self.memo[pair] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        bound = float("inf")  # what crosses the border must have this rank at least
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < bound:
                return False
            # undo the later of the two merges beside the border; of equal tokens the right one
            # was merged later, as the leftmost of equal merges comes first
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the splitting pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        starts: list[list[int]] = [[] for _ in range(size)]
        length = self.length
        for end, rank in self.words.iter(piece.decode("latin-1")):
            starts[end - length[rank] + 1].append(rank)  # ends only grow: the longest comes last
        memo, compatible = self.memo, self.compatible
        out: list[int] = []
        dead = bytearray(size + 1)  # positions from which the rest cannot be encoded
        trail: list[tuple[int, list[int]]] = []
        at, options, last = 0, starts[0].copy(), -1
        while at < size:
            while options:
                rank = options.pop()
                to = at + length[rank]
                if dead[to]:
                    continue
                if last >= 0:
                    fits = memo.get((last, rank))
                    if not (compatible(last, rank) if fits is None else fits):
                        continue
                trail.append((at, options))
                out.append(rank)
                last, at = rank, to
                options = starts[at].copy() if at < size else []
                break
            else:
                dead[at] = 1
                out.pop()
                last = out[-1] if out else -1
                at, options = trail.pop()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def piece_cache(bpe: BacktrackingBPE, pattern: str) -> PieceCache:
    split = regex.compile(pattern)

    def encode(pieces: list[str]) -> list[bytes]:
        one = bpe.encode_piece
        return [np.array([i for m in split.findall(p) for i in one(m.encode("utf-8", "surrogatepass"))], "<u4").tobytes() for p in pieces]

    return PieceCache(encode)


@functools.lru_cache(maxsize=2)
def worker_bpe(name: str, pattern: str) -> tuple[BacktrackingBPE, PieceCache]:
    """One per worker process."""
    bpe = BacktrackingBPE(load_ranks(file_of(name)))
    return bpe, piece_cache(bpe, pattern)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoded(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) of each whole text; a null or empty text has no ids. Repeated
    and null keys are carried as they are."""
    pattern = pattern or default_pattern()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, cache = worker_bpe(ranks, pattern)
        ids = [np.frombuffer(x, "<i4") for texts in text_slices(batch.column(1)) for x in cache(texts)]
        offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype("<i4")
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, np.concatenate(ids))], names=["key", "ids"])

    return over_batches(docs.select(key, text), run, f"key {docs.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def round_trips(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 (of the
    bytes the ids decode to); nothing but these leaves the task. A null text is an empty one; no
    rows give no rows."""
    pattern = pattern or default_pattern()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, cache = worker_bpe(ranks, pattern)
        rows: list[tuple[int, str, str]] = []
        for texts in text_slices(batch.column(1)):
            for data in cache(texts):
                ids = np.frombuffer(data, "<u4").tolist()
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        n, digest, decoded = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest), pa.array(decoded)], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return over_batches(docs.select(key, text), run, f"key {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op8_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes of every document. A null
    text is an empty one, with no ids; repeated rows and null ids stay; no rows give no rows;
    other columns are not looked at."""
    return round_trips(table(spark, sf_dir, "documents"))
