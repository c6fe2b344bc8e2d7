"""Packing tokenised documents into sequences by non-negative least squares.

A document is its ids and a closing id.  Its whole windows are sequences of
their own; what is left, shorter than a window, is counted in a histogram of
lengths over the corpus (never more than ``window`` numbers).  Combinations of
up to three lengths that fill a window exactly are the columns of a
non-negative least-squares problem against that histogram.  Its repeat counts
are rounded, and what then remains is packed greedily, longest first, cutting a
piece where no other fills the gap.  The plan says, for each length and range of
ranks, which place in which sequence the piece takes; pieces look theirs up.

Every sequence is full, but for the last tokens of the corpus, which are dealt
to sequences of a power of two: there is no padding.

Ids stay where they were made; only one small row for each document moves, and
the ids of the few pieces that the greedy step cuts.

Defined cases: a null or empty text is the closing id alone; equal rows are
packed each for themselves; doc_id may be null or repeat; an empty table gives
no pieces.
"""

from __future__ import annotations

import base64
import functools
import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: A single space between two other characters: no token reaches over the place before it.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Characters that are encoded at once, so that memory doesn't grow with a text.
STRETCH = 1 << 20
END_ID = 0
#: So many cut documents at most are broadcast; more are joined by a shuffle.
BROADCAST_CUT = 100_000
SWEEPS = 25
#: A block of whole windows is numbered within its scan task.
_PER_TASK = 1 << 32


class Encoder:
    """Little-endian 32-bit ids of texts, as the ``tokenizers`` file gives them.

    Texts go through the same vocabulary as ``ranks``, long ones in stretches cut
    before a single space between two other characters, over which no token
    reaches; texts with a special token's brackets go to the tokenizer whole.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        self.tokenizer_path, self.tokenizer, self.fast = tokenizer_path, None, None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> list[int]:
        """By the tokenizer file, which is read when it is first needed."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.tokenizer_path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
        start = 0
        while len(text) - start > size and (cut := _BETWEEN.search(text, start + size)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> bytes:
        if self.fast is None or "<|" in text:
            return np.array(self.whole(text), np.uint32).tobytes()
        return b"".join(np.array(self.fast.encode_ordinary(x), np.uint32).tobytes() for x in self.stretches(text))


@functools.cache
def encoder(*files: str | None) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(*files)


def tokenized(docs: DataFrame, window: int, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """part, row, doc_id, ids (with the closing id), n_tokens, tail, rank of the tail's length within the part, block_base; stored."""
    names = ["part", "row", "doc_id", "ids", "n_tokens", "tail", "rank", "block_base"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path, pattern).encode
        part, row, block = TaskContext.get().partitionId(), 0, 0
        ranks = [0] * window
        end = np.array([END_ID], np.uint32).tobytes()
        for batch in batches:
            doc_ids = batch.column("doc_id")
            lengths = np.array([len(x.as_buffer()) for x in batch.column("body")], np.int64) if batch.num_rows else np.zeros(0, np.int64)
            for start, stop in shared.blocks(lengths):
                ids = [encode(x.as_py()) + end for x in batch.column("body").slice(start, stop - start)]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                tails = n % window
                rank = []
                for t in tails.tolist():
                    rank.append(ranks[t])
                    ranks[t] += 1
                bases = block + np.cumsum(n // window) - n // window
                block += int((n // window).sum())
                m = stop - start
                columns = [np.full(m, part), np.arange(row, row + m), doc_ids.slice(start, m), pa.array(ids, pa.binary()), n, tails, np.array(rank, np.int64), bases]
                row += m
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in columns], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty(text).alias("body"))
    return shared.stored(rows.mapInArrow(scan, "part long, row long, doc_id long, ids binary, n_tokens long, tail long, rank long, block_base long"), "tokens")


def combinations(window: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """Up to three lengths that sum to the window, all of them present, long ones first."""
    found = [(window - a, a) for a in range(1, window // 2 + 1) if present[a] and present[window - a]]
    for a in range(window - 2, (window - 1) // 3, -1):
        if present[a]:
            rest = window - a
            found += [(a, b, rest - b) for b in range(min(a, rest - 1), (rest - 1) // 2, -1) if present[b] and present[rest - b]]
    return found


def repeat_counts(histogram: np.ndarray, columns: list[tuple[int, ...]], sweeps: int = SWEEPS) -> list[float]:
    """Non-negative least squares by coordinate descent: how often each combination repeats."""
    left = histogram.astype(float).tolist()
    counts = [0.0] * len(columns)
    sets = [[(x, c.count(x)) for x in dict.fromkeys(c)] for c in columns]
    norms = [sum(m * m for _, m in s) for s in sets]
    for _ in range(sweeps):
        moved = 0.0
        for j, own in enumerate(sets):
            slope = 0.0
            for x, m in own:
                slope += m * left[x]
            step = max(slope / norms[j], -counts[j])
            if step:
                counts[j] += step
                moved = max(moved, abs(step))
                for x, m in own:
                    left[x] -= m * step
        if moved < 0.05:
            break
    return counts


class Plan:
    """Where the pieces go: rows (tail, piece start, rank from, rank to, length, sequence, offset).

    A lot is a range of ranks of one tail length, and what is left of those
    pieces from ``start`` on; ``lots[length]`` are the lots of that length.
    """

    def __init__(self, histogram: np.ndarray, window: int) -> None:
        self.window, self.rows, self.n_sequences = window, [], 0
        self.counts = histogram.astype(np.int64).copy()
        self.lots: dict[int, deque] = defaultdict(deque)
        for length in np.flatnonzero(self.counts).tolist():
            self.lots[length].append((length, 0, 0, int(self.counts[length])))
        self._least_squares()
        self._greedy()

    def _take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        out = []
        self.counts[length] -= n
        while n:
            tail, start, low, high = self.lots[length].popleft()
            m = min(n, high - low)
            if m < high - low:
                self.lots[length].appendleft((tail, start, low + m, high))
            out.append((tail, start, low, low + m))
            n -= m
        return out

    def _put(self, length: int, n: int, sequence: int, offset: int, most: int | None = None) -> None:
        """n pieces of ``length`` to the same offset of n sequences; beyond ``most`` tokens they are cut."""
        for tail, start, low, high in self._take(length, n):
            self.rows.append((tail, start, low, high, length if most is None else most, sequence, offset))
            sequence += high - low
            if most is not None:
                self.counts[length - most] += high - low
                self.lots[length - most].append((tail, start + most, low, high))

    def _repeat(self, lengths: tuple[int, ...], n: int) -> None:
        offset = 0
        for length in lengths:
            self._put(length, n, self.n_sequences, offset)
            offset += length
        self.n_sequences += n

    def _least_squares(self) -> None:
        columns = combinations(self.window, self.counts > 0)
        counts = repeat_counts(self.counts, columns)
        for j in sorted(range(len(columns)), key=lambda j: (-counts[j], j)):
            n = min(round(counts[j]), *(int(self.counts[x]) // columns[j].count(x) for x in columns[j]))
            if n > 0:
                self._repeat(columns[j], n)

    def _greedy(self) -> None:
        while self.counts.any():
            chosen, used, rest, cut = [], defaultdict(int), self.window, 0
            while rest:
                free = self.counts.copy()
                for x, m in used.items():
                    free[x] -= m
                fits = np.flatnonzero(free[: rest + 1])
                if len(fits):
                    x = int(fits[-1])
                    chosen.append(x)
                    used[x] += 1
                    rest -= x
                    continue
                longer = np.flatnonzero(free[rest + 1 :])
                if len(longer):
                    cut = rest + 1 + int(longer[-1])
                    used[cut] += 1
                break
            if rest and not cut:
                self._last(chosen)
                continue
            n = min(int(self.counts[x]) // m for x, m in used.items())
            offset = 0
            for x in chosen:
                self._put(x, n, self.n_sequences, offset)
                offset += x
            if cut:
                self._put(cut, n, self.n_sequences, offset, rest)
            self.n_sequences += n

    def _last(self, chosen: list[int]) -> None:
        """The last pieces, once each, over sequences of powers of two."""
        sizes = [1 << b for b in range(self.window.bit_length(), -1, -1) if sum(chosen) >> b & 1]
        room, offset = sizes.pop(0), 0
        waiting = deque(chosen)
        while waiting:
            x = waiting.popleft()
            if x > room:
                self._put(x, 1, self.n_sequences, offset, room)
                waiting.appendleft(x - room)
                # the cut rest must be the next of its length
                self.lots[x - room].rotate(1)
                x = room
            else:
                self._put(x, 1, self.n_sequences, offset)
            room, offset = room - x, offset + x
            if not room and (waiting or sizes):
                self.n_sequences += 1
                room, offset = (sizes.pop(0) if sizes else 0), 0
        self.n_sequences += 1

    def lookup(self) -> "Lookup":
        return Lookup(self.rows)


class Lookup:
    """The plan's rows as sorted arrays; never more than a few for each combination of lengths."""

    def __init__(self, rows: list[tuple[int, ...]]) -> None:
        table = np.array(sorted(rows), np.int64).reshape(-1, 7)
        layers = sorted({(int(t), int(s)) for t, s in table[:, :2]})
        number = {x: i for i, x in enumerate(layers)}
        self.of_tail = defaultdict(list)
        for tail, start in layers:
            self.of_tail[tail].append(number[tail, start])
        layer = np.array([number[int(t), int(s)] for t, s in table[:, :2]], np.int64)
        self.key = (layer << 40) + table[:, 2] if len(table) else np.zeros(0, np.int64)
        self.table, self.deepest = table, max(map(len, self.of_tail.values()), default=0)

    def pieces(self, tails: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(which rows, start in the tail, length, sequence, offset), layer by layer."""
        for depth in range(self.deepest):
            layer = np.array([self.of_tail[t][depth] if depth < len(self.of_tail[t]) else -1 for t in range(int(tails.max(initial=0)) + 1)], np.int64)[tails]
            at = np.searchsorted(self.key, (layer << 40) + ranks, side="right") - 1
            row = self.table[np.maximum(at, 0)]
            hit = np.flatnonzero((layer >= 0) & (at >= 0) & (self.key[np.maximum(at, 0)] >> 40 == layer) & (ranks < row[:, 3]))
            row = row[hit]
            yield hit, row[:, 1], row[:, 4], row[:, 5] + ranks[hit] - row[:, 2], row[:, 6]


def pack(tokens: DataFrame, window: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, part, row for every piece of ``tokens``."""
    spark = tokens.sparkSession
    counts = tokens.where("tail > 0").groupBy("part", "tail").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = np.zeros(window, np.int64)
    for tail, n in counts.groupBy("tail").agg(F.sum("n")).collect():  # at most window - 1 rows
        histogram[tail] = n
    plan = Plan(histogram, window)
    lookup = spark.sparkContext.broadcast(plan.lookup())
    arrow = ["part", "row", "doc_id", "doc_tokens", "tail_crc32", "cut", "start", "length", "sequence_id", "offset"]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails, ranks = batch.column("tail").to_numpy(), batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            for hit, start, length, sequence, offset in lookup.value.pieces(tails, ranks):
                own = batch.take(pa.array(hit))
                first = own.column("doc_tokens").to_numpy() - tails[hit]
                more = [length < tails[hit], first + start, length, sequence, offset]
                yield pa.RecordBatch.from_arrays([own.column(c) for c in arrow[:5]] + [pa.array(x) for x in more], names=arrow)

    ids_of = lambda start, length: F.substring("ids", start * 4 + 1, length * 4)
    small = tokens.where("tail > 0").select("part", "row", "doc_id", F.col("n_tokens").alias("doc_tokens"), "tail", "rank", F.crc32(ids_of(F.col("n_tokens") - F.col("tail"), F.col("tail"))).alias("tail_crc32"))
    placed = small.join(bases, ["part", "tail"]).select("part", "row", "doc_id", "doc_tokens", "tail_crc32", "tail", "rank", "base")
    schema = "part long, row long, doc_id long, doc_tokens long, tail_crc32 long, cut boolean, start long, length long, sequence_id long, offset long"
    pieces = shared.stored(placed.mapInArrow(assign, schema), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "row"]
    uncut = pieces.where("NOT cut").withColumn("ids_crc32", F.col("tail_crc32")).select(columns)
    n_cut = sum(high - low for tail, _, low, high, length, _, _ in plan.rows if length < tail)
    cut = pieces.where("cut")
    cut = (F.broadcast(cut) if n_cut <= BROADCAST_CUT else cut).join(tokens.select("part", "row", "ids"), ["part", "row"])
    cut = cut.withColumn("ids_crc32", F.crc32(ids_of(F.col("start"), F.col("length")))).select(columns)
    n_blocks = F.floor(F.col("n_tokens") / window)
    blocks = tokens.where(F.col("n_tokens") >= window).select("*", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("i"))
    blocks = blocks.select(
        "doc_id", (F.col("i") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.crc32(ids_of(F.col("i") * window, F.lit(window))).alias("ids_crc32"),
        F.col("n_tokens").alias("doc_tokens"), (F.lit(plan.n_sequences) + F.col("part") * _PER_TASK + F.col("block_base") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "part", "row",
    )
    return uncut.unionByName(cut).unionByName(blocks)


def sequences(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """sequence_id, ids: the training sequences themselves; here the ids move, once."""
    piece = F.struct("offset", F.substring("ids", F.col("start") * 4 + 1, F.col("length") * 4).alias("ids"))
    held = pieces.select("part", "row", "start", "length", "sequence_id", "offset").join(tokens.select("part", "row", "ids"), ["part", "row"]).select("sequence_id", piece.alias("piece"))
    inside = F.sort_array(F.collect_list("piece"))  # a sequence has at most ``window`` ids
    return held.groupBy("sequence_id").agg(inside.alias("pieces")).select("sequence_id", F.aggregate("pieces", F.lit(b""), lambda done, x: F.concat(done, x.ids)).alias("ids"))
