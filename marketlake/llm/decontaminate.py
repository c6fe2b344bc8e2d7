"""Benchmark decontamination as a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (a shorter item is
one window).  Its tokens are its word shingles.  Tokens are ordered by how rare
they are in the whole corpus; as every token of a window must occur in a
document that contains it, the rarest one is a sufficient prefix.  A scan of the
documents keeps the positions of prefix tokens (a bitmap of bounded size lets
nearly nothing else pass), a join on the token finds the windows, the token's
offset in the window bounds where the window must begin and end, and the words
that stand there are joined with the windows exactly.

Defined cases: null or wordless texts have no words and no hits; wordless items
have no windows; repeated rows, also of one doc_id, each get their own result;
items that share a window are all reported; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

_BASE, _STEP, _MIX = 0x100000001B3, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD
_M64 = (1 << 64) - 1
BLOCK = 1 << 20


class Words:
    """The words of some texts laid end to end, with a 64-bit hash each."""

    _powers = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def __init__(self, texts: list[bytes], table: bytes = shared.WORD_BYTES) -> None:
        self.buffer = b" ".join([x.translate(table) for x in texts]) + b" "
        raw = np.frombuffer(self.buffer, np.uint8)
        inside = raw != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        self.starts, self.ends = edges[0::2], edges[1::2]
        text_ends = np.cumsum([len(x) + 1 for x in texts])
        #: word numbers at which each text begins, and the end
        self.bounds = np.r_[0, np.searchsorted(self.starts, text_ends)]
        power, inverse = self._get_powers(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        self.hashes = _mixed((total[self.ends] - total[self.starts]) * inverse[self.starts])
        self.stops = np.repeat(self.bounds[1:], np.diff(self.bounds))

    @classmethod
    def _get_powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers[0]) < n:
            size = max(n, BLOCK + (BLOCK >> 1))
            made = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps))
            if size > 4 * BLOCK:
                return made[0][:n], made[1][:n]
            cls._powers = (made[0], made[1])
        return cls._powers[0][:n], cls._powers[1][:n]

    def grams(self, size: int) -> np.ndarray:
        """A hash of the ``size`` words from each position on, whichever texts they belong to."""
        n = len(self.hashes) - size + 1
        total = np.full(max(n, 0), (size * _MIX) & _M64, np.uint64)
        for i in range(size if n > 0 else 0):
            total = total * np.uint64(_STEP) + self.hashes[i : n + i]
        return total

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Word positions at which ``size`` words of one text follow, and their hash."""
        total = self.grams(size)
        at = np.flatnonzero(np.arange(size, len(total) + size) <= self.stops[: len(total)])
        return at, _mixed(total[at])

    def minimizers(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Word positions at which ``window`` words of one text follow, and the least hash of ``gram`` words among these."""
        each = _mixed(self.grams(gram))
        n = len(self.hashes) - window + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = each[:n]
        for i in range(1, window - gram + 1):
            least = np.minimum(least, each[i : n + i])
        at = np.flatnonzero(np.arange(window, n + window) <= self.stops[:n])
        return at, least[at]

    def text(self, first: int, stop: int) -> str:
        return b" ".join(self.buffer[self.starts[first] : self.ends[stop - 1]].split()).decode()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


def pieces(batch: pa.RecordBatch, column: str = "body", table: bytes = shared.WORD_BYTES, size: int = BLOCK) -> Iterator[tuple[int, int, Words]]:
    """Row ranges of a batch of texts with their words, some texts at a time."""
    body = batch.column(column)
    lengths = np.array([len(x.as_buffer()) for x in body], np.int64) if batch.num_rows else np.zeros(0, np.int64)
    for start, stop in shared.blocks(lengths, size):
        yield start, stop, Words(body.slice(start, stop - start).to_pylist(), table)


def windows(items: DataFrame, window: int = 10, shingle: int = 5, text: str = "text") -> DataFrame:
    """item_id, window (its words), n_words and tokens (a hash for each shingle) of every item window."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, words in pieces(batch):
                ids = batch.column("item_id").slice(start, stop - start).to_pylist()
                hashed = {k: dict(zip(*(x.tolist() for x in words.shingles(k)), strict=True)) for k in range(1, shingle + 1)}
                out: dict[str, list] = {"item_id": [], "window": [], "n_words": [], "tokens": []}
                for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
                    length = min(window, b - a)
                    size = min(shingle, length)
                    for at in range(a, b - length + 1) if length else ():
                        out["item_id"].append(ids[i])
                        out["window"].append(words.text(at, at + length))
                        out["n_words"].append(length)
                        out["tokens"].append(np.array([hashed[size][j] for j in range(at, at + length - size + 1)], np.uint64).view(np.int64))
                if out["item_id"]:
                    yield pa.RecordBatch.from_pydict(out, pa.schema([("item_id", pa.int64()), ("window", pa.string()), ("n_words", pa.int32()), ("tokens", pa.list_(pa.int64()))]))

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), shared.text_or_empty(text).cast("binary").alias("body"))
    return shared.stored(rows.mapInArrow(cut, "item_id long, window string, n_words int, tokens array<long>").distinct(), "windows")


def _bodies(docs: DataFrame, text: str, *columns) -> DataFrame:
    return docs.select(*columns, shared.text_or_empty(text).cast("binary").alias("body"))


def token_counts(docs: DataFrame, tokens: DataFrame, sizes: list[int], text: str = "text") -> DataFrame:
    """token, n: how often each of ``tokens`` occurs in all documents (a few foreign ones may be among them)."""
    bitmap = docs.sparkSession.sparkContext.broadcast(shared.Bitmap.of(tokens, "token"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, words in pieces(batch):
                for size in sizes:
                    _, hashes = words.shingles(size)
                    found.append(hashes[bitmap.value.has(hashes)])
            token, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            if len(token):
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return _bodies(docs, text).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def prefixes(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """token, window, n_words, at: the rarest token of each distinct window that can occur at all."""
    each = wins.select("window", "n_words", "tokens").distinct().select("window", "n_words", F.posexplode("tokens").alias("at", "token"))
    each = each.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = each.groupBy("window", "n_words").agg(F.min(F.struct("n", "token", "at")).alias("r"))
    return rarest.where("r.n > 0").select("r.token", "window", "n_words", "r.at")


def candidates(docs: DataFrame, prefix: DataFrame, sizes: list[int], window: int, shingle: int, text: str = "text") -> DataFrame:
    """_row, doc_id, _h (hash of the text), n_words and found (token, word position, words around it) of every document, stored."""
    bitmap = docs.sparkSession.sparkContext.broadcast(shared.Bitmap.of(prefix.select("token").distinct(), "token"))
    schema = "_row long, doc_id long, _h long, n_words long, found array<struct<token:long,pos:int,first:int,around:string>>"
    arrow = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("_h", pa.int64()), ("n_words", pa.int64()), ("found", pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32()), ("first", pa.int32()), ("around", pa.string())])))])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, words in pieces(batch):
                found: list[list] = [[] for _ in range(stop - start)]
                for size in sizes:
                    at, hashes = words.shingles(size)
                    passed = bitmap.value.has(hashes)
                    at, hashes = at[passed], hashes[passed].view(np.int64)
                    of = np.searchsorted(words.bounds, at, side="right") - 1
                    reach = window - size if size == shingle else 0  # shorter tokens are whole windows
                    for i, p, token in zip(of.tolist(), at.tolist(), hashes.tolist(), strict=True):
                        low, high = int(words.bounds[i]), int(words.bounds[i + 1])
                        first = max(low, p - reach)
                        found[i].append({"token": token, "pos": p - low, "first": first - low, "around": words.text(first, min(high, p + size + reach))})
                head = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([head.column("_row"), head.column("doc_id"), head.column("_h"), pa.array(np.diff(words.bounds).astype(np.int64)), pa.array(found, arrow.field("found").type)], schema=arrow)

    rows = _bodies(docs, text, F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(shared.text_or_empty(text)).alias("_h"))
    return shared.stored(rows.mapInArrow(scan, schema), "candidates")


def hits(found: DataFrame, prefix: DataFrame) -> DataFrame:
    """_row, start, stop, window: every exact occurrence of a window, in word positions."""
    each = found.select("_row", "n_words", F.explode("found").alias("f")).select("_row", F.col("n_words").alias("doc_words"), "f.*")
    start = F.col("pos") - F.col("at")
    # a token stands at a few offsets of windows, however many windows there are; the words at an offset are the key
    offsets = prefix.select("token", "at", "n_words").distinct()
    near = each.join(offsets, "token").withColumn("start", start).withColumn("stop", start + F.col("n_words")).where("start >= 0 AND stop <= doc_words AND start >= first")
    here = F.array_join(F.slice(F.split("around", " "), F.col("start") - F.col("first") + 1, F.col("n_words")), " ")
    found = near.withColumn("window", here).select("_row", "start", "stop", "token", "at", "n_words", "window")
    return found.join(prefix, ["token", "at", "n_words", "window"], "left_semi").select("_row", "start", "stop", "window")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, text: str = "text") -> DataFrame:
    """_row, doc_id, _h, n_words, n_hit, items (sorted list of item ids) for every document."""
    wins = windows(items, window, shingle, text)
    sizes = sorted(int(r[0]) for r in wins.select(F.least("n_words", F.lit(shingle))).distinct().collect())  # at most ``shingle`` rows
    tokens = wins.select(F.explode("tokens").alias("token")).distinct()
    prefix = shared.stored(prefixes(wins, token_counts(docs, tokens, sizes, text)), "prefixes")
    found = candidates(docs, prefix, sizes, window, shingle, text)
    hit = shared.stored(hits(found, prefix), "hits")
    before = Window.partitionBy("_row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = hit.select("_row", "start", "stop").distinct().withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0)))))
    n_hit = covered.groupBy("_row").agg(F.sum("new").alias("n_hit"))
    per_item = hit.select("_row", "window").distinct().join(wins.select("item_id", "window"), "window").groupBy("_row", "item_id").agg(F.count("*").alias("n"))
    named = per_item.groupBy("_row").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    out = found.select("_row", "doc_id", "_h", "n_words").join(n_hit, "_row", "left").join(named, "_row", "left")
    return out.select("_row", "doc_id", "_h", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any item window, in their own columns."""
    found = shared.stored(decontaminate(docs, items, window, shingle, text).where("n_hit > 0").select("doc_id", "_h"), "contaminated")
    return shared.without(docs, found, text)
