"""Packing tokenised documents into sequences, shortest pack first over the length histogram.

A document's ids are cut into pieces of the sequence length and a rest. Only the
histogram of piece lengths (one count for each length, so a bounded table) comes
to the driver. There the lengths are placed, longest first: each goes to the packs
that are shortest so far, whole runs of equal packs at once, and opens new packs
where none has room. What results is a list of runs: "ranks r to r+n of length l go
to packs p to p+n at offset o". Pieces meet their run by rank: a piece's rank among
its length is its rank within its task plus the counts of the tasks before.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import durable, give_back, small_batches
from cairn.llm.token_counts import byte_symbols

MOST_BLOBS, TEXT_AT_ONCE = 300_000, 2_000_000
CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
TOGETHER = 256
#: What keeps a blob from the faster library: a special token's sign, letters that are not Latin, white space but one space in front.
UNUSUAL = re.compile(r"[<\u0250-\U0010ffff]|[^\S \n]|[\x1c-\x1f]| [ \n]|[^\n] | $|^$|\n\n|^\n|\n$")


def blobs(text: str) -> list[str]:
    """text cut before each space and on either side of each line break."""
    if "\0" in text:
        return [""]  # irregular: cut at safe places instead
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit words; remembers the blobs of the latest texts.

    What the library gives for a text is what it gives for its blobs, one after
    the other. New blobs of Latin letters are encoded together by the library of
    ranks, which is the faster one on single words and agrees on these; all others by the
    library that the vocabulary file belongs to.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        of_symbol = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(of_symbol[c] for c in t): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in special}
        self.ranks = tiktoken.Encoding("cairn", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.line = np.frombuffer(self._one("\n"), np.uint32)
        assert self.line.size == 1, "a line break has to be one token"
        self.known: dict[str, bytes | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.known["\n"] = self.line.tobytes()

    def _one(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: Iterable[str], even_irregular: bool = False) -> None:
        fast, slow, known, new = [], [], self.known, list(new)
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            together = "\n".join(some)
            if not UNUSUAL.search(together) and together.count("\n") == len(some) - 1:
                fast += some
                continue
            for b in some:
                word = b[1:] if b[:1] == " " else b
                if not word or word[0].isspace() or word[-1].isspace():
                    # a cut is safe at one space or line break between characters that are no white space; here it may not be
                    if even_irregular:
                        slow.append(b)
                    else:
                        known[b] = None
                elif UNUSUAL.search(b) or "\n" in b:
                    slow.append(b)
                else:
                    fast.append(b)
        if fast:
            ids = self.ranks.encode_to_numpy("\n".join(fast))
            ends = np.append(np.flatnonzero(ids == self.line), ids.size).tolist()
            assert len(ends) == len(fast), "line breaks part the blobs"
            raw, at = ids.astype("<u4").tobytes(), 0
            for b, end in zip(fast, ends, strict=True):
                known[b] = raw[4 * at : 4 * end]
                at = end + 1
        if slow:
            for b, e in zip(slow, self.library.encode_batch_fast(slow, add_special_tokens=False), strict=True):
                known[b] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [blobs(t) for t in texts]
        here = set().union(*parts)
        if len(self.known) + len(here) > MOST_BLOBS:
            self._forget()
        new = here - self.known.keys()
        self._learn(new)
        out = []
        for text, p in zip(texts, parts, strict=True):
            try:
                out.append(b"".join(map(self.known.__getitem__, p)))
            except TypeError:  # an irregular blob: cut at safe places only
                p = CUT.split(text)
                unsure = {b for b in set(p) if self.known.get(b) is None}
                self._learn(unsure, even_irregular=True)
                out.append(b"".join(map(self.known.__getitem__, p)))
                self.known.update(dict.fromkeys(unsure))
        for b in new:
            if len(b) > 64:
                self.known.pop(b, None)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def groups_of(cells, most: int) -> Iterator[list[str]]:
    """Texts in lists of bounded size, in order; nulls are empty."""
    held, chars = [], 0
    for cell in cells:
        text = cell.as_py() or ""
        if held and chars + len(text) > most:
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield held


def place(histogram: dict[int, int], width: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first pack, offset), shortest pack first, longest length first."""
    runs: list[tuple[int, int, int, int, int]] = []
    open_packs: list[tuple[int, int, int]] = []  # heap of (filled, first pack, how many)
    packs = 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank, next_packs = histogram[length], 0, []
        while left and open_packs and open_packs[0][0] + length <= width:
            filled, first, many = heapq.heappop(open_packs)
            taken = min(many, left)
            runs.append((length, rank, taken, first, filled))
            rank, left = rank + taken, left - taken
            if filled + length < width:
                heapq.heappush(open_packs, (filled + length, first, taken))
            if taken < many:
                heapq.heappush(open_packs, (filled, first + taken, many - taken))
        each = width // length
        for stack, many in ((each, left // each), (left % each, 1)):
            if stack and many:
                for i in range(stack):
                    runs.append((length, rank, many, packs, i * length))
                    rank += many
                if stack * length < width:
                    next_packs.append((stack * length, packs, many))
                packs += many
        for x in next_packs:
            heapq.heappush(open_packs, x)
    return runs


def pieces(docs: DataFrame, path: str, width: int, end_id: int) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, its task and its rank there among pieces of its length."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(width + 1, np.int64)
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            rows: list[tuple[int, int, int, int, int, int]] = []
            at = 0
            for texts in groups_of(batch.column(1), TEXT_AT_ONCE):
                for ids in library.encode(texts):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, width):
                        length = min(width, n - start)
                        rows.append((at, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, int(seen[length])))
                        seen[length] += 1
                    at += 1
            if rows:
                who, start, length, crc, n, rank = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(who), start, length, crc, n, pa.array(np.full(len(who), task, np.int64)), rank],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "task_rank"],
                )
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return made.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, task_rank bigint")


def pack(docs: DataFrame, path: str, width: int = 2048, end_id: int = 1) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path: a byte-level byte-pair vocabulary; end_id follows each document. Null
    text counts as empty: a document of end_id alone. Null ids stay; repeated rows
    are documents of their own; other columns are not read; an empty table gives
    an empty one. Texts are read once; the table of pieces, some bytes for each
    width ids, is kept in the shared folder, as ranks must not change later.
    """
    held = durable(pieces(docs, path, width, end_id))
    by_task = held.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}  # width rows at most
    runs = sorted(place(histogram, width))
    table = np.array(runs, np.int64).reshape(-1, 5)
    base = np.zeros(width + 2, np.int64)
    for length, n in histogram.items():
        base[length + 1] = n
    base = np.cumsum(base)  # ranks of all lengths, one after the other
    starts = base[table[:, 0]] + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            key = base[length] + rank
            at = np.searchsorted(starts, key, "right") - 1
            found = table[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(found[:, 3] + key - starts[at]), pa.array(found[:, 4])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    ranked = held.join(before, ["task", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("task_rank")).alias("rank"))
    return ranked.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint")
