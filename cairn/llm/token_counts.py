"""Token counts by a compiled finite-state transducer.

The vocabulary's merge list is compiled into a deterministic transducer over a
word's symbols. After any prefix of a word, its state holds what a merge can
still reach: the longest suffix that begins some token, and the last token of the
encoding of each prefix that a later token can start after. A transition carries
the number of tokens by which the encoding grows (negative where tokens merge).
States are made when first reached and numbered; equal futures share a state.

The end of a word resets the transducer, so a chunk of text acts on the states as a
map: what is left of a word that is under way takes the state on entry to the tokens it emits, all
words after it emit the same whatever came before, and the word under way at the chunk's end leaves its state, a value that any
process can take up. Texts are cut near fixed places, before white space or
inside long runs of letters, and the maps are composed in pairs, by the reduction
of a prefix scan; no word is lost or counted twice where a cut falls within it.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small_batches

#: Entries of what each worker remembers; beyond them the older half is made again when needed.
MOST_BLOBS, MOST_WORDS, MOST_STATES, MOST_STEPS = 250_000, 120_000, 120_000, 400_000
SPACE = r"\t-\r \x85\xa0  -     　"
NOT_LIBRARY_SPACE = regex.compile(r"[\x1c-\x1f]")
WORD = regex.compile(rf"[^{SPACE}]+")
SPACES = regex.compile(rf"[{SPACE}]")
#: Letters that neither composition nor case ties to their neighbours; and so many of them that a special token or an elision ends before.
LETTER, RUN = r"A-Za-z\u4e00-\u9fff", 24
SAFE = regex.compile(rf"(?=[{SPACE}])|(?<=[{LETTER}]{{{RUN}}})(?=[{LETTER}])")


def byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Transducer:
    """Compiled from the merges of a byte-level vocabulary; counts the tokens of one word at a time."""

    #: A state: the suffix that begins a token, and for each place where a later token can start how far back it lies, the token before it, and how many tokens fewer there are.
    START = ("", ((0, None, 0),))

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.vocab, self.end = vocab, end
        self.ranks: dict[tuple[str, str], int] = {}
        made: dict[str, tuple[int, str, str]] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[left, right] = rank
            made.setdefault(left + right, (rank, left, right))
        self.begins = {t[:i] for t in vocab for i in range(1, len(t.removesuffix(end)) + 1)}
        self.symbols = byte_symbols()
        self.rights = {t: self._edge(t, made, 2) for t in vocab}
        self.lefts = {t: self._edge(t, made, 1) for t in vocab}
        self._reset()

    def _reset(self) -> None:
        self.states, self.numbers, self.steps = [self.START], {self.START: 0}, {}

    @staticmethod
    def _edge(token: str, made: dict, side: int) -> list[tuple[str, float]]:
        """The pieces at one edge of a token while it is merged, each with the rank of the merge that takes it up."""
        out, taken = [], float("inf")
        while True:
            out.append((token, taken))
            if token not in made:
                return out
            taken, token = made[token][0], made[token][side]

    def adjoin(self, left: str | None, right: str) -> bool:
        """Whether the two tokens, side by side, are the encoding of their text.

        Merges happen by ascending rank, leftmost first. So the tokens stay apart
        unless two pieces that meet there have a merge that comes before those
        that take them up (of one rank, the merge further left comes first).
        """
        if left is None:
            return True
        ranks = self.ranks
        for a, until_a in self.rights[left]:
            for b, until_b in self.lefts[right]:
                rank = ranks.get((a, b))
                if rank is not None and rank < until_a and rank <= until_b:
                    return False
        return True

    def step(self, number: int, char: str, last: bool) -> tuple[int, int]:
        """The next state and the tokens emitted on the way."""
        tail, recent = self.states[number]
        symbol = char + self.end if last else char
        size = len(tail)
        for back, before, more in recent:
            token = tail[size - back :] + symbol
            if token in self.vocab and self.adjoin(before, token):
                break
        else:
            raise ValueError(f"no token of the vocabulary ends in {symbol!r}")
        emitted = 1 + more
        if last:
            return 0, emitted
        grown, begins = tail + char, self.begins
        kept = [(back + 1, t, n - emitted) for back, t, n in recent if grown[size - back :] in begins]
        kept.append((0, token, 0))
        state = (grown[size + 1 - kept[0][0] :], tuple(kept))
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state], emitted

    def run(self, entry: tuple, word: bytes, whole: bool) -> tuple[tuple, int]:
        """The state after more bytes of a word, from a state on entry, and the tokens emitted. whole: the word ends with these."""
        if len(self.states) > MOST_STATES or len(self.steps) > MOST_STEPS:
            self._reset()  # only what was learnt; it is made again when needed
        state = self.numbers.get(entry)
        if state is None:
            state = self.numbers[entry] = len(self.states)
            self.states.append(entry)
        total = 0
        steps, ends = self.steps, len(word) - 1 if whole else len(word)
        for i, b in enumerate(word):
            key = state << 9 | (b if i < ends else b + 256)
            got = steps.get(key)
            if got is None:
                after, emitted = self.step(state, self.symbols[b], i == ends)
                got = steps[key] = after << 8 | emitted + 128
            state = got >> 8
            total += (got & 255) - 128
        return self.states[state], total

    def count(self, word: bytes) -> int:
        """Tokens of one word, without white space."""
        return self.run(self.START, word, True)[1]


class Recent(dict):
    """Remembers the latest entries: up to twice `most`, the older ones in a generation of their own."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key: str) -> int:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value

    def make(self, key: str) -> int:
        raise NotImplementedError


class Words(Recent):
    """A word to its tokens."""

    def __init__(self, machine: Transducer):
        super().__init__(MOST_WORDS)
        self.machine = machine

    def make(self, key: str) -> int:
        return self.machine.count(key.encode("utf-8"))


class Counter(Recent):
    """A blob (text without white space) to its tokens; what is not remembered is run through the transducer."""

    def __init__(self, path: str):
        super().__init__(MOST_BLOBS)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        self.machine = Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.words = regex.compile(pre["pattern"]["Regex"].replace(r"\s", SPACE))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.of_word = Words(self.machine)

    def pieces(self, text: str) -> list[str | None]:
        """The words of a text without white space, normalised as the vocabulary asks (composed, lower case letter by letter), and None for each special token."""
        out = []
        for i, part in enumerate(self.special.split(text) if "<" in text else (text,)):
            if i % 2:
                out.append(None)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            out += self.words.findall("".join(c.lower() for c in part) if "Σ" in part else part.lower())
        return out

    def sum(self, pieces: list[str | None]) -> int:
        return sum(1 if p is None else self.of_word[p] for p in pieces)

    def make(self, key: str) -> int:
        return self.sum(self.pieces(key))


class Chunk(NamedTuple):
    """A chunk as a map of states: an entry state goes, over head, on to another (no reset), or to the end of its word, some tokens, and state."""

    head: bytes  # what the word under way still gets
    resets: bool  # whether it ends in the chunk
    emitted: int  # tokens of what follows it
    state: tuple  # of the word under way at the chunk's end

    def of(self, entry: tuple, machine: Transducer) -> tuple[tuple, int]:
        """The state and tokens that an entry state goes to."""
        if not self.resets:
            return machine.run(entry, self.head, False)
        return self.state, self.emitted + (machine.run(entry, self.head, True)[1] if self.head else 0)


NEUTRAL = Chunk(b"", False, 0, Transducer.START)


def chunk_of(text: str, counter: Counter, enters: bool = False, leaves: bool = False) -> Chunk:
    """enters, leaves: a word is under way at the start, at the end; both lie between two letters."""
    blobs = WORD.findall(text) if NOT_LIBRARY_SPACE.search(text) or not text.strip() else text.split()
    start = counter.machine.START
    if not enters and not leaves:
        return Chunk(b"", True, sum(map(counter.__getitem__, blobs)), start)
    first = counter.pieces(blobs[0])
    if len(blobs) == 1:
        if enters and leaves and len(first) == 1:
            return Chunk(first[0].encode("utf-8"), False, 0, start)
        inner, last = first, first
    else:
        inner, last = first, counter.pieces(blobs[-1])
    emitted = sum(map(counter.__getitem__, blobs[1:-1]))
    if len(blobs) > 1:
        inner = inner + last
    head, state = b"", start
    if enters:
        head, inner = inner[0].encode("utf-8"), inner[1:]
    if leaves:
        state, on_the_way = counter.machine.run(start, inner[-1].encode("utf-8"), False)
        inner, emitted = inner[:-1], emitted + on_the_way
    return Chunk(head, True, emitted + counter.sum(inner), state)


def compose(a: Chunk, b: Chunk, counter: Counter) -> Chunk:
    """First a, then b. Associative; NEUTRAL is neutral."""
    if a.resets:
        state, emitted = b.of(a.state, counter.machine)
        return Chunk(a.head, True, a.emitted + emitted, state)
    return Chunk(a.head + b.head, b.resets, b.emitted, b.state)


def cut(text: str, chars: int) -> list[tuple[int, bool]]:
    """Where chunks end, and whether inside a word: at the first place after each `chars` characters that is before white space, or in a run of letters that no rule of words or special tokens reaches into."""
    out, at = [], chars
    while at < len(text) and (found := SAFE.search(text, at)):
        out.append((found.start(), not SPACES.match(text, found.start())))
        at = found.start() + chars
    return [*(x for x in out if x[0] < len(text)), (len(text), False)]


def chunks_of(text: str, counter: Counter, chars: int) -> list[Chunk]:
    out, at, inside = [], 0, False
    for end, leaves in cut(text, chars):
        out.append(chunk_of(text[at:end], counter, inside, leaves))
        at, inside = end, leaves
    return out


def scan(chunks: list[Chunk], counter: Counter) -> list[Chunk]:
    """All prefixes' compositions, in log2(n) rounds of independent steps."""
    out, step = list(chunks), 1
    while step < len(out):
        out = [compose(out[i - step], x, counter) if i >= step else x for i, x in enumerate(out)]
        step *= 2
    return out


def total(text: str, counter: Counter, chunk_chars: int) -> int:
    return reduce_pairs(chunks_of(text, counter, chunk_chars), counter).emitted


def reduce_pairs(chunks: list[Chunk], counter: Counter) -> Chunk:
    """The last prefix of the scan, by its reduction tree."""
    while len(chunks) > 1:
        chunks = [compose(chunks[i], chunks[i + 1], counter) if i + 1 < len(chunks) else chunks[i] for i in range(0, len(chunks), 2)]
    return chunks[0]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk_chars: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (columns doc_id, text).

    path: the vocabulary file of a word-end byte-pair encoding. Null text counts
    as empty: 0 bytes, 0 tokens; very long texts are counted whole, chunk by chunk. Null ids and repeated rows stay, one row out for
    each row in; other columns are not read; an empty table gives an empty one.
    Nothing is shuffled, and a task holds one batch and a bounded memory of words.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for batch in batches:
            sizes, counts = [], []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                sizes.append(len(text) if text.isascii() else len(text.encode("utf-8")))
                counts.append(total(text, known, chunk_chars))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
