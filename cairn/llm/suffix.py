"""Repeated byte strings, found by merging the Burrows-Wheeler transforms of shards.

Every window of W bytes belongs to the smallest of its k-byte grams (by hash, the leftmost of
equals): its anchor. Equal windows have equal anchors, so windows can only meet in the bucket
of their anchor's hash, and a run of windows with one anchor travels as one short string. Four
passes, of which texts take part in three:

1. blocks of documents send their anchors' hashes to buckets; buckets find which occur twice or more
   anywhere, from sums for each sender, and blocks learn which of theirs do;
2. blocks send the strings of these anchors, each distinct one of a block once, with its first place;
3. in buckets, the strings of one anchor are put in shards, which hold equal ones once; each shard is transformed, and the shards'
   transforms are merged by refining their interleave: a round takes the rows, in the order of their first d symbols,
   s symbols back by the transform's steps, and deals them out by what they begin with, so they are in order by d + s
   symbols. Where neighbours part, their common prefix follows from those of the round before. Intervals in
   which neighbours share W symbols are the repeated windows; the first place of each stays. No suffix is compared
   with another, and none is sorted again from its symbols;
4. blocks mark what is covered, and cut it out.

A block's request is answered in its order, so what is sent back is a few bits for a string.
Blocks and buckets grow in number with the input, not in size. An anchor that is met too often (at the edges of a passage
that many documents share, each with a text of its own around it) is dealt out again, window by window: the smallest place
of each window's 128-bit digest is aggregated in part before it is sent, and only the block that holds it gets an answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.llm.common import durable, fresh, give_back, small_batches
from cairn.llm.features import mixed

GRAM = 32
HOT_USES = 4096
BLOCK_BYTES, BUCKET_BYTES, SHARD_BYTES = 4 << 20, 6 << 20, 1 << 15
#: Rows of a merge, if the strings of one anchor are not more: ranks fit in 16 bits, which sort by counting.
MERGE_ROWS = 1 << 16
#: Anchors that a task sends at once, and such sendings whose blocks are answered together.
FLUSH, FLUSHES = 1_000_000, 64
#: Bits of a key that hold a gram's place.
PLACES = 1 << 24
BYTES = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)
MULTIPLIERS = np.random.default_rng(78).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
LAST = np.iinfo(np.int64).max


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64 bits for each run of gram bytes, put together from runs of powers of two."""
    h, size, out, covered = BYTES[data], 1, None, 0
    while gram:
        if gram & 1:
            if out is None:
                out = h
            else:
                out = out[: h.size - covered] * MULTIPLIERS[size % 64] + h[covered:]
                out = out[: data.size - covered - size + 1]
            covered += size
        gram >>= 1
        if gram:
            h = h[:-size] * MULTIPLIERS[(size + 1) % 64] + h[size:]
            size *= 2
    return mixed(out)


def anchors(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchors' hashes, and the first window and the end (of windows) of each run.

    The smallest gram goes by the upper bits of its hash, then by its place, so the
    leftmost of equals is taken and a run never holds one window twice.
    """
    windows = data.size - width + 1
    if windows <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if windows > PLACES // 2:  # places must fit in their bits
        parts = [(at, anchors(data[at : at + PLACES // 2 + width - 1], width, gram)) for at in range(0, windows, PLACES // 2)]
        return tuple(np.concatenate([p[i] + at if i else p[i] for at, p in parts]) for i in range(3))
    h = gram_hashes(data, gram)
    least = (h & ~np.uint64(PLACES - 1)) | np.arange(h.size, dtype=np.uint64)
    per, size = width - gram + 1, 1
    while size * 2 <= per:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if per > size:
        least = np.minimum(least[: size - per], least[per - size :])
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    place = (least[starts] & np.uint64(PLACES - 1)).astype(np.int64)
    return h[place], starts, np.append(starts[1:], windows)


def codes(symbols: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A number for each row's first two symbols, in their order; 16 bits if there are few enough."""
    there = np.bincount(symbols, minlength=257) + np.bincount(after, minlength=257) > 0
    dense = np.cumsum(there) - 1
    many = int(dense[-1]) + 1
    dense = dense.astype(np.uint16 if many * many <= 1 << 16 else np.int64)
    return dense.take(symbols) * dense.dtype.type(many) + dense.take(after)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where one of the keys differs from that of the row before."""
    out = np.ones(keys[0].size, bool)
    if keys[0].size > 1:
        np.not_equal(keys[0][1:], keys[0][:-1], out=out[1:])
        for k in keys[1:]:
            out[1:] |= k[1:] != k[:-1]
    return out


def by_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stable order of pairs of ranks, and the pairs in it."""
    if first.dtype != np.uint16:
        order = np.lexsort((second, first))
        return order, first[order], second[order]
    key = first.astype(np.uint64) << np.uint64(48) | second.astype(np.uint64) << np.uint64(32) | np.arange(first.size, dtype=np.uint64)
    key.sort()  # all different, so no order is lost
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(48)).astype(np.uint16), (key >> np.uint64(32)).astype(np.uint16)


def rank_type(rows: int) -> type:
    return np.uint16 if rows <= 1 << 16 else np.int64


def transform(shard: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of a shard's strings (0 ends a string, bytes are one more), and string and offset of the suffix in each row.

    End symbols are smaller than all bytes, and the earlier string's is the smaller one.
    """
    sizes = np.fromiter(map(len, shard), np.int64, len(shard)) + 1
    ends = np.cumsum(sizes) - 1
    text = np.frombuffer(b"\0".join(shard) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    text[ends] = 0
    n, string = text.size, np.repeat(np.arange(len(shard)), sizes)
    left = (ends.take(string) - np.arange(n)).astype(np.int32)  # bytes before the end symbol
    after = np.append(text[1:], np.uint16(0))
    after[ends] = 0
    key = codes(text, after)
    order = np.argsort(key, kind="stable")
    rank, slots, rows, new, seen = np.empty(n, rank_type(n)), np.arange(n), order, starts_of(key.take(order)), 2
    while True:
        # a row's rank is the place where its interval begins; one whose end is in sight goes by string, and is in order
        new |= left.take(rows) < seen
        heads = np.flatnonzero(new)
        many = np.diff(np.append(heads, rows.size))
        rank[rows] = np.repeat(slots.take(heads).astype(rank.dtype), many)
        open_ = np.repeat(many > 1, many)
        slots, rows = slots.compress(open_), rows.compress(open_)
        if not rows.size:
            break
        by, first, then = by_pairs(rank.take(rows), rank.take(rows + seen))
        rows = rows.take(by)
        order[slots] = rows
        new = starts_of(first, then)
        seen *= 2
    before = text.take(order - 1, mode="wrap")
    string = string.take(order)
    offset = (sizes.take(string) - 1) - left.take(order)
    before[offset == 0] = 0
    return before, string, offset


def preceding(bwt: np.ndarray) -> np.ndarray:
    """For each row the row of the suffix that is one symbol longer, by counting symbols; of no meaning where a string begins."""
    out = np.empty(bwt.size, np.int64)
    out[np.argsort(bwt, kind="stable")] = np.arange(bwt.size)
    return out


def least_between(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest of values from first to before end (first < end), for many pairs of places."""
    out = values[first]
    far = np.flatnonzero(end - first > 1)
    if far.size:
        first, end = first[far], end[far]
        level = (np.frexp(end - first)[1] - 1).astype(np.int64)
        rows = np.empty((int(level.max()) + 1, values.size), values.dtype)
        rows[0] = values
        for i in range(1, len(rows)):
            step = 1 << (i - 1)
            np.minimum(rows[i - 1, :-step], rows[i - 1, step:], out=rows[i, :-step])
            rows[i, -step:] = rows[i - 1, -step:]
        out[far] = np.minimum(rows[level, first], rows[level, end - (1 << level)])
    return out


def merged(shards: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of `depth` bytes or more over the strings of all shards, in the order of their first depth bytes: string and offset of each, and how many bytes (depth at most) it shares with the one before.

    The rows of a shard come in the order of its transform, and the transform tells the row of each longer suffix. A round
    knows the order by d symbols. Taken s symbols back, the rows are in order by symbols s to s + d; dealt out by the interval of
    their own first d symbols, which keeps that order within an interval, they are in order by d + s. A suffix that has
    fewer symbols is no row's way back, and drops out.
    """
    symbols, after, back, owner, offset, left, base, strings = [], [], [], [], [], [], 0, 0
    for shard in shards:
        bwt, string, at = transform(shard)
        sizes = np.fromiter(map(len, shard), np.int64, len(shard))
        lf = preceding(bwt)
        first = np.repeat(np.arange(257, dtype=np.uint16), np.bincount(bwt, minlength=257))
        own = np.zeros(bwt.size, np.uint16)  # the symbol after each row's first one: the first one of the row that it is reached from
        has = np.flatnonzero(at)
        own[lf.take(has)] = first.take(has)
        symbols.append(first)
        after.append(own)
        back.append(lf + base)
        owner.append(string + strings)
        offset.append(at)
        left.append(sizes.take(string) - at)
        base, strings = base + bwt.size, strings + len(shard)
    symbols, after, back, owner, offset, left = (np.concatenate(x) if len(x) > 1 else x[0] for x in (symbols, after, back, owner, offset, left))
    room = offset.astype(np.uint8 if depth < 256 else np.int64) if offset.max() < 256 else offset
    steps = [back]  # by 1, 2, 4 ... symbols

    def backward(rows: np.ndarray, n: int) -> np.ndarray:
        i = 0
        while n >> i:
            if len(steps) <= i:
                steps.append(steps[-1].take(steps[-1]))
            if n >> i & 1:
                rows = steps[i].take(rows)
            i += 1
        return rows

    seen, small = min(2, depth), np.uint8 if depth < 256 else np.int32
    key = codes(symbols, after) if seen == 2 else symbols
    rows = np.flatnonzero(left >= seen)
    order = rows.take(np.argsort(key.take(rows), kind="stable"))
    new = starts_of(key.take(order))
    heads = order.compress(new)
    shared = np.zeros(heads.size, small)
    if seen == 2 and heads.size:
        shared[1:] = symbols[heads[1:]] == symbols[heads[:-1]]
    rank = np.empty(base, rank_type(base))
    while True:
        rank[order] = np.cumsum(new, dtype=rank.dtype) - rank.dtype.type(1)
        if seen >= depth or not order.size:
            break
        step = min(seen, depth - seen)
        ahead = order.compress(room.take(order) >= step)
        rows = backward(ahead, step)
        by, own, then = dealt(rank.take(rows), rank.take(ahead))
        order = rows.take(by)
        new = starts_of(own, then)
        heads, was = np.flatnonzero(new), shared
        a, b = own.take(heads).astype(np.int64), then.take(heads).astype(np.int64)
        shared = np.zeros(heads.size, small)
        if heads.size > 1:
            alike = a[1:] == a[:-1]  # of one interval so far: apart by what comes then
            pair = np.where(alike, b[:-1], a[:-1]), np.where(alike, b[1:], a[1:])
            shared[1:] = least_between(was, pair[0] + 1, pair[1] + 1) + alike * small(step)
        seen += step
    common = np.full(order.size, depth, np.int32)
    common[new] = shared
    return owner.take(order), offset.take(order), common


def dealt(own: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that come in the order of `then`, dealt out by their own interval, and both ranks in that order. Counting keeps the order within an interval."""
    by = np.argsort(own, kind="stable")
    return by, own.take(by), then.take(by)


def shards_of(strings: list[bytes], job: np.ndarray, turn: np.ndarray) -> tuple[list[list[bytes]], np.ndarray, list[int]]:
    """Shards of a job's strings (numbers, in the order of their senders): the distinct ones of each, the number of the earliest of each, and the numbers of all later copies."""
    shards, kept, copies, size, known = [], [], [], 0, {}
    for i in job.tolist():
        x = strings[i]
        if size > SHARD_BYTES or not shards:
            shards.append([])
            size, known = 0, {}
        size += len(x)
        at = known.setdefault(x, len(kept))
        if at == len(kept):
            kept.append(i)
            shards[-1].append(x)
        else:
            first, last = sorted((i, kept[at]), key=turn.__getitem__)
            kept[at] = first
            copies.append(last)
    return shards, np.array(kept, np.int64), copies


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any integers, bytes of like weight together, compressed."""
    import zstandard

    parts = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.size else b""
        parts += [a.dtype.str.encode().ljust(4), a.size.to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 2, []
    for _ in range(int.from_bytes(raw[:2], "little")):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        at += 12
        out.append(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy().view(kind).reshape(-1))
        at += n * kind.itemsize
    return out


class Block:
    """The documents of a block, in order: by id (null last), equal ids by text, equal texts by a hash of the row's other columns."""

    def __init__(self, ids: list, texts: list, width: int, gram: int, more: list | None = None):
        coded = [(t or "").encode("utf-8") for t in texts]
        tie = [int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "little") >> 1 for c in coded]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, tie[i], more[i] if more else 0))
        self.ids = [ids[i] for i in self.order]
        self.tie = [tie[i] for i in self.order]
        self.texts = [coded[i] for i in self.order]
        self.width = width
        runs = [anchors(np.frombuffer(t, np.uint8), width, gram) for t in self.texts]
        self.doc = np.repeat(np.arange(len(runs)), [r[0].size for r in runs])
        self.hash, self.start, self.stop = (np.concatenate([r[i] for r in runs] or [np.empty(0, d)]) for i, d in enumerate((np.uint64, np.int64, np.int64)))

    def pieces(self, repeated: np.ndarray, hot: np.ndarray) -> "Pieces":
        """What is sent of the block: runs whose anchor is repeated; those of a hot anchor window by window."""
        runs = np.flatnonzero(np.isin(self.hash, repeated))
        doc, start, stop, key = (x[runs] for x in (self.doc, self.start, self.stop, self.hash))
        wide = np.isin(key, hot)
        if wide.any():
            many = np.where(wide, stop - start, 1)
            which = np.repeat(np.arange(runs.size), many)
            step = np.arange(which.size) - np.repeat(np.cumsum(many) - many, many)
            wide = wide[which]
            doc, start, key = doc[which], start[which] + step, key[which]
            stop = np.where(wide, start + 1, stop[which])
        return Pieces(self, doc, start, stop, key, wide)


class Pieces:
    """Runs, or single windows, of a block, and the distinct strings among them, each with the piece where it comes first.

    A string of a run goes to the bucket of its anchor. Where an anchor is hot, strings that hold it may
    all be different, so each window goes its own way, by its digest.
    """

    def __init__(self, block: Block, doc, start, stop, key, wide):
        self.block, self.doc, self.start, self.stop = block, doc, start, stop
        number: dict[bytes, int] = {}
        self.of = np.empty(doc.size, np.int64)
        for i, (d, a, b, w) in enumerate(zip(doc.tolist(), start.tolist(), stop.tolist(), wide.tolist(), strict=True)):
            text = block.texts[d][a : b + block.width - 1]
            self.of[i] = number.setdefault((text, w), len(number))
        self.strings = [x for x, _ in number]
        self.lead = np.full(len(self.strings), -1)
        self.lead[self.of[::-1]] = np.arange(doc.size)[::-1]
        self.key, self.wide = key[self.lead], wide[self.lead]

    def routed(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The strings in the order in which they are sent to buckets, and these; windows of hot anchors are not among them."""
        narrow = np.flatnonzero(~self.wide)
        to = (self.key[narrow] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        return narrow[order], to[order]


def spans(cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], (cover > 0).astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def merges(sizes: np.ndarray, anchor: np.ndarray) -> Iterator[np.ndarray]:
    """Strings in jobs: those of one anchor together, some anchors to a job; an anchor with one string has no window twice, and is in none."""
    by = np.argsort(anchor, kind="stable")
    starts = np.flatnonzero(starts_of(anchor[by]))
    many = np.diff(np.append(starts, by.size))
    rows = np.add.reduceat(sizes[by] + 1, starts) if by.size else starts
    held, total = [], 0
    for a, n, r in zip(starts.tolist(), many.tolist(), rows.tolist(), strict=True):
        if n > 1:
            if held and total + r > MERGE_ROWS:
                yield np.sort(np.concatenate(held))
                held, total = [], 0
            held.append(by[a : a + n])
            total += r
    if held:
        yield np.sort(np.concatenate(held))


def resolve(group: pa.Table, width: int) -> pa.Table:
    """A bucket's strings: for each block's request, which windows of each string occur earlier."""
    requests = sorted(((b.as_py(), unpack(x.as_py())) for b, x in zip(group["block"], group["data"], strict=True)), key=lambda r: r[0])
    sizes = np.concatenate([r[1][0] for r in requests]).astype(np.int64)
    ids, tie, start, run = (np.concatenate([r[1][i] for r in requests]).astype(np.int64) for i in (1, 2, 3, 4))
    anchor = np.concatenate([r[1][5] for r in requests])
    raw = np.concatenate([r[1][6] for r in requests]).tobytes()
    ends = np.cumsum(sizes)
    strings = [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    order = np.lexsort((start, run, tie, ids))
    turn = np.empty(order.size, np.int64)  # places in order: of one document, by start
    turn[order] = np.arange(order.size)
    windows = sizes - width + 1
    base = np.cumsum(windows) - windows
    again = np.zeros(int(windows.sum()), bool)
    for job in merges(sizes, anchor):
        shards, kept, copies = shards_of(strings, job, turn)
        for i in copies:
            again[base[i] : base[i] + windows[i]] = True
        owner, offset, common = merged(shards, width)
        entry = kept[owner]
        interval = np.cumsum(common < width)
        by = np.lexsort((turn[entry], interval))
        later = by[1:][interval[by[1:]] == interval[by[:-1]]]
        again[base[entry[later]] + offset[later]] = True
    seen = np.add.reduceat(again, base) if base.size else base
    kinds = np.where(seen == windows, 1, np.where(seen > 0, 2, 0)).astype(np.uint8)
    rows, at = [], 0
    for block, r in requests:
        n = r[0].size
        kind = kinds[at : at + n]
        bits = [again[base[i] : base[i] + windows[i]] for i in (at + np.flatnonzero(kind == 2)).tolist()]
        rows.append((block, pack(kind, np.packbits(np.concatenate(bits)) if bits else np.empty(0, np.uint8))))
        at += n
    del raw, strings, requests
    give_back()
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([group["bucket"][0].as_py()] * len(rows), pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})


def placed(docs: DataFrame, blocks: int) -> DataFrame:
    """A block for each document: by id, and by text where ids are equal or null."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)))


def repeated_hashes(texts: DataFrame, total: int, buckets: int, width: int, gram: int, hot_uses: int) -> DataFrame:
    """block, n_hot, data: for each block the hashes of its anchors that occur twice or more anywhere, and those of them that occur more than hot_uses times.

    A task sends its anchors in parts: for each bucket sums by hash, and which blocks use each. Buckets see
    sums alone, so a hash costs as much as it has senders; their answers go to the senders' parts, some
    at a time, which know the blocks. So nothing holds all blocks that share an anchor.
    """
    salts = max(1, total // (FLUSH * FLUSHES * 32))

    def flush(held: list[np.ndarray], turn: int) -> pa.RecordBatch:
        h, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        to = h % np.uint64(buckets)
        order = np.lexsort((b, h, to))
        h, b, to = h[order], b[order], to[order]
        pairs = np.flatnonzero(starts_of(h, b))
        uses = np.diff(np.append(pairs, h.size)).astype(np.uint32)
        h, b, to = h[pairs], b[pairs].astype(np.uint32), to[pairs]
        cuts = np.flatnonzero(starts_of(to))
        sums, blocks = [], []
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), h.size], strict=True):
            heads = np.flatnonzero(starts_of(h[i:j]))
            sums.append(pack(np.diff(h[i:j][heads], prepend=np.uint64(0)), np.add.reduceat(uses[i:j], heads)))
            blocks.append(pack(np.diff(np.append(heads, j - i)).astype(np.uint32), b[i:j]))
        return pa.RecordBatch.from_arrays([pa.array(to[cuts].astype(np.int64)), pa.array(np.full(cuts.size, turn % salts), pa.int64()), pa.array(sums, pa.binary()), pa.array(blocks, pa.binary())], names=["bucket", "salt", "sums", "blocks"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, turn = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for block, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = anchors(np.frombuffer((cell.as_py() or "").encode("utf-8"), np.uint8), width, gram)[0]
                held.append((h, np.full(h.size, block, np.int64)))
                size += h.size
                if size > FLUSH:
                    yield flush(held, turn)
                    held, size, turn = [], 0, turn + 1
        if size:
            yield flush(held, turn)
        del held
        give_back()

    def count(group: pa.Table) -> pa.Table:
        got = [unpack(x.as_py()) for x in group["sums"]]
        h = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got])
        uses = np.concatenate([x[1] for x in got]).astype(np.int64)
        order = np.argsort(h)
        h, uses = h[order], uses[order]
        heads = np.flatnonzero(starts_of(h))
        uses, h = np.add.reduceat(uses, heads), h[heads]
        known = h[uses > 1]
        return pa.table({"bucket": pa.array([group["bucket"][0].as_py()], pa.int64()), "known": pa.array([pack(np.diff(known, prepend=np.uint64(0)), uses[uses > 1] > hot_uses)], pa.binary())})

    def answer(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            known, hot = unpack(right["known"][0].as_py())
            known = np.cumsum(known, dtype=np.uint64)
            found = []
            for sums, blocks in zip(left["sums"].to_pylist(), left["blocks"].to_pylist(), strict=True):
                h = np.cumsum(unpack(sums)[0], dtype=np.uint64)
                many, b = unpack(blocks)
                at = np.searchsorted(known, h)
                here = np.repeat((at < known.size) & (known[np.minimum(at, max(0, known.size - 1))] == h) if known.size else np.zeros(h.size, bool), many)
                found.append((np.repeat(at, many)[here], b[here]))
            at, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
            order = np.lexsort((at, b))
            at, b = at[order], b[order]
            heads = np.flatnonzero(starts_of(at, b)) if at.size else at
            at, b = at[heads], b[heads]
            cuts = np.flatnonzero(starts_of(b)).tolist() if b.size else []
            for i, j in zip(cuts, [*cuts[1:], b.size], strict=False):
                mine = at[i:j]
                warm = known[mine][hot[mine]]
                rows.append((int(b[i]), int(warm.size), pack(np.diff(known[mine], prepend=np.uint64(0)), np.diff(warm, prepend=np.uint64(0)))))
        kinds = (("block", pa.int64()), ("n_hot", pa.int64()), ("data", pa.binary()))
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})

    sent = durable(texts.select("block", "text").mapInArrow(send, "bucket bigint, salt bigint, sums binary, blocks binary"))
    known = sent.select("bucket", "sums").groupBy("bucket").applyInArrow(count, "bucket bigint, known binary")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return sent.groupBy("bucket", "salt").cogroup(known.groupBy("bucket", "salt")).applyInArrow(answer, "block bigint, n_hot bigint, data binary")


def removals(docs: DataFrame, width: int = 100, gram: int = GRAM, whole_rows: bool = False, hot_uses: int = HOT_USES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text); with whole_rows also `row`, all columns of docs but text, and `rest`, the bytes that stay as text (a character of which a byte goes is gone).

    Every byte is removed that a string of `width` bytes covers which also starts
    earlier: in a document with a smaller id, or in the same one. Strings are
    bytes of whole UTF-8 texts, and never cross documents; a very long text is a block of its own size, anchored by parts. Null text counts
    as empty. Null ids come after all others. Rows with one id come in the order of a hash of their texts, rows with one text too in
    that of a hash of their other columns; of equal rows all but one are copies. Other
    columns are not read (but with whole_rows); an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    texts = docs.select("doc_id", text)
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // BUCKET_BYTES))
    full = docs.select("doc_id", text, row.alias("row"), F.xxhash64(row.cast("string")).alias("more"))
    texts, full = placed(texts, blocks), placed(full, blocks)
    known = durable(repeated_hashes(texts, total, buckets, width, gram, hot_uses))

    def hashes(data: list) -> list[np.ndarray]:
        got = [unpack(x) for x in data]
        return [np.concatenate([*(np.cumsum(x[i], dtype=np.uint64) for x in got), np.empty(0, np.uint64)]) for i in (0, 1)]

    def pieces(left: pa.Table, data: list) -> Pieces:
        more = left["more"].to_pylist() if "more" in left.column_names else None
        return Block(left["doc_id"].to_pylist(), left["text"].to_pylist(), width, gram, more).pieces(*hashes(data))

    def place(block: Block, p: Pieces, these: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where strings come first in the block, as numbers in the order of all places: id, tie, start, document in the block."""
        ids = np.array([LAST if i is None else int(i) for i in block.ids], np.int64)
        at = p.lead[these]
        d = p.doc[at]
        return ids[d], np.array(block.tie, np.int64)[d], p.start[at], d.astype(np.uint32)

    def ask(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            p = pieces(left, right["data"].to_pylist())
            order, to = p.routed(buckets)
            short = np.uint16 if width < 20_000 else np.uint32
            cuts = np.flatnonzero(starts_of(to)) if to.size else []
            for i, j in zip(cuts, [*cuts[1:], to.size], strict=False):
                these = order[i:j]
                strings = [p.strings[s] for s in these.tolist()]
                sizes = np.array([len(x) for x in strings], short)
                out.append((int(to[i]), key[0].as_py(), pack(sizes, *place(p.block, p, these), p.key[these], np.frombuffer(b"".join(strings), np.uint8))))
        kinds = (("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary()))
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(kinds)})

    def ask_windows(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The windows of hot anchors: their digests, places, and numbers among the block's strings."""
        wide, place_, digests = np.empty(0, np.int64), [np.empty(0, np.int64)] * 4, []
        if left.num_rows and right.num_rows:
            p = pieces(left, right["data"].to_pylist())
            wide = np.flatnonzero(p.wide)
            place_ = place(p.block, p, wide)
            digests = [hashlib.blake2b(p.strings[i], digest_size=16).digest() for i in wide.tolist()]
        half = [pa.array([int.from_bytes(d[at : at + 8], "little", signed=True) for d in digests], pa.int64()) for at in (0, 8)]
        return pa.table([*half, *(pa.array(x.astype(np.int64)) for x in place_), pa.array(np.full(wide.size, key[0].as_py()), pa.int64()), pa.array(wide)], names=["w1", "w2", "id", "tie", "start", "doc", "block", "string"])

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            none = pa.table({n: pa.array([], t) for n, t in fields})
            return none.append_column("rest", pa.array([], pa.string())).append_column("row", left["row"]) if whole_rows else none
        from_, data = right["bucket"].to_pylist(), right["data"].to_pylist()
        p = pieces(left, [x for x, b, s in zip(data, from_, right["string"].to_pylist(), strict=True) if b is None and s is None])
        block = p.block
        kind, bits = np.ones(len(p.strings), np.uint8), {}  # windows of hot anchors that have no answer are met earlier
        kind[[s for s in right["string"].to_pylist() if s is not None]] = 0
        order, to = p.routed(buckets)
        if order.size:
            answers = {b: unpack(x) for b, x in zip(from_, data, strict=True) if b is not None}
            cuts = np.flatnonzero(starts_of(to))
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), to.size], strict=True):
                these = order[i:j]
                told, packed = answers[int(to[i])]
                kind[these], at = told, 0
                plain = np.unpackbits(packed)
                for s in these[told == 2].tolist():
                    n = len(p.strings[s]) - width + 1
                    bits[s] = plain[at : at + n]
                    at += n
        cover = [None] * len(block.texts)
        first = p.lead[p.of] == np.arange(p.of.size) if p.strings else np.empty(0, bool)
        for s, d, a, b, leads in zip(p.of.tolist(), p.doc.tolist(), p.start.tolist(), p.stop.tolist(), first.tolist(), strict=True):
            if leads and kind[s] == 0:
                continue
            if cover[d] is None:
                cover[d] = np.zeros(len(block.texts[d]) + 1, np.int32)
            if leads and kind[s] == 2:
                at = a + np.flatnonzero(bits[s])
                np.add.at(cover[d], at, 1)
                np.add.at(cover[d], at + width, -1)
            else:
                cover[d][a] += 1
                cover[d][b + width - 1] -= 1
        rows = []
        for d, data in enumerate(block.texts):
            rest, removed, many = data, 0, 0
            if cover[d] is not None:
                starts, stops = spans(np.cumsum(cover[d][:-1]))
                removed, many = int((stops - starts).sum()), int(starts.size)
                edges = [0, *np.column_stack((starts, stops)).reshape(-1).tolist(), len(data)]
                rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((block.ids[d], len(data), removed, many, hashlib.sha256(rest).hexdigest(), rest))
        out = pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(fields)})
        if whole_rows:
            out = out.append_column("rest", pa.array([r[-1].decode("utf-8", "ignore") for r in rows], pa.string())).append_column("row", left["row"].take(pa.array(block.order)))
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("doc_id", pa.int64() if kind == "bigint" else pa.int32()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    out = StructType.fromDDL(schema)
    if whole_rows:
        out = out.add("rest", "string").add("row", full.schema["row"].dataType)
    asked = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(ask, "bucket bigint, block bigint, data binary")
    answers = durable(asked.groupBy("bucket").applyInArrow(lambda group: resolve(group, width), "block bigint, bucket bigint, data binary"))
    replies = known.select("block", "data").unionByName(answers, allowMissingColumns=True).withColumn("string", F.lit(None).cast("bigint"))
    hot = known.select("block", "data", "n_hot")
    if not hot.filter("n_hot > 0").isEmpty():
        windows = texts.groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(ask_windows, "w1 bigint, w2 bigint, id bigint, tie bigint, start bigint, doc bigint, block bigint, string bigint")
        first = windows.groupBy("w1", "w2").agg(F.min(F.struct("id", "tie", "doc", "start", "block", "string")).alias("f"))
        replies = replies.unionByName(first.select("f.block", "f.string"), allowMissingColumns=True)
    kept = full if whole_rows else texts
    return kept.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(cut, out)


def cut_out(docs: DataFrame, width: int = 100, gram: int = GRAM) -> DataFrame:
    """docs, each text without its repeated bytes, and n_chars (if there is one) of what is left.

    A character of which a byte goes is gone. A text that was null stays so; all rows stay.
    """
    was_null = fresh(docs, "text_was_null")[0]
    got = removals(docs.withColumn(was_null, F.col("text").isNull()), width, gram, whole_rows=True)
    text = F.when(~F.col("row")[was_null], F.col("rest"))
    values = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": text.cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.coalesce(F.char_length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return got.select(*[values[c].alias(c) for c in docs.columns])
