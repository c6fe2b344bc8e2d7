"""SimHash fingerprints, and near-duplicate groups by multi-index hashing.

A fingerprint bit is set where more than half of the XXH64 hashes of the text's
word shingles have it.  Two fingerprints within ``distance`` bits have a segment
within ``distance // segments`` bits; the Hamming ball of that radius is
enumerated half on the stored and half on the asking side, so one table of
(segment, variant) rows meets itself.  What meets under a key is verified over
all bits.  A key's many fingerprints are linked through pivots instead of in all
pairs, which leaves the same components.  The fingerprints of a key that has more
than HOT are dealt to ``distance + 1`` pieces of their other bits, one of which is
equal in any two that link, and again where a finer key still has eight times as many.

``deduped`` also links texts whose shingle sets are similar, however far apart
their fingerprints are.  A text has SIGNATURE min-hashes in bands of BAND; texts
that share a band meet, signatures of a bit of each min-hash sort out what cannot
be similar, and what is left is compared exactly.  Texts that share a passage
rarely share a band, those that are similar share many.  Rounds look at a few
bands first and at all in the end; in each, only texts of different components
are asked for, those outside a band's largest component for their closest one.
Where one has more that may be similar, a last round takes the shingles of what
still meets to the bands and compares all of it there, so that only links leave.

Defined cases: a null or wordless text has fingerprint 0 and links like any
other; a null doc_id takes part but never names a component that has another;
repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, shared

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 16
#: Up to so many rows under a key are compared in all pairs.
FEW = 16
#: So many fingerprints under a key at most meet in one group before it is split.
HOT = 20_000
#: Bits of a signature, one of each min-hash; a bit differs in (1 - j) / 2 of all cases.
SIGNATURE = 512
#: Standard deviations that a signature may differ more than expected.
SPREAD = 4.5
#: Min-hashes of a band.  Texts of similarity 0.8 have none of 64 bands in common with a chance of (1 - 0.8 ** 8) ** 64, 8 in a million.
BAND = 8
#: Bands that are looked at in the first rounds, so that what a few bands link needn't be asked for under the others; then all.
STEPS = (4, 16, SIGNATURE // BAND)
#: Texts under a band's key at most that are compared in one group.
BLOCK = 4096
_FACTORS = np.random.default_rng(42).integers(0, 2**63, SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes, words_each: int = 4, seed: int = 42) -> int:
    """Over lower-cased words split at ASCII white space."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n, each = max(1, len(words) - words_each + 1), min(words_each, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip((ends - lengths)[:n].tolist(), ends[each - 1 : each - 1 + n].tolist(), strict=True)
    hashes = np.fromiter([digest(line[i:j], seed) for i, j in spans], np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        part = hashes[at : at + _AT_ONCE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_each: int = 4, seed: int = 42, text: str = "text") -> DataFrame:
    """doc_id, hash _h of the text and its fingerprint ``fp`` as a signed long, stored."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words_each, seed) for x in batch.column("body")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_h"), pa.array(found.view(np.int64))], names=["doc_id", "_h", "fp"])

    whole = shared.text_or_empty(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole).alias("_h"), whole.cast("binary").alias("body"))
    return shared.stored(rows.mapInArrow(scan, "doc_id long, _h long, fp long"), "fingerprints")


def ball(width: int, radius: int) -> np.ndarray:
    """The masks of up to ``radius`` set bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)], np.uint64)


def local_components(fps: np.ndarray, distance: int) -> np.ndarray:
    """A label for each fingerprint, equal where chains of links within ``fps`` connect.

    Pivots are compared with all; afterwards only what lies outside the largest
    component has to be, for a link that is still unknown has an end there.
    """
    n = len(fps)
    label, parent, pivots = np.full(n, -1), [], set()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def meet(i: int, own: int) -> None:
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance)
        known = label[near]
        for other in np.unique(known[known >= 0]).tolist():
            parent[root(other)] = root(own)
        label[near[known < 0]] = own

    for i in range(n):
        if label[i] < 0:
            parent.append(len(parent))
            pivots.add(i)
            meet(i, len(parent) - 1)
    roots = np.array([root(x) for x in range(len(parent))])
    if len(np.unique(roots)) > 1:
        of = roots[label]
        largest = np.bincount(of).argmax()
        for i in np.flatnonzero(of != largest).tolist():
            if i not in pivots:
                meet(i, label[i])
        roots = np.array([root(x) for x in range(len(parent))])
    return roots[label]


def link_runs(keys: np.ndarray, fps: np.ndarray, distance: int) -> np.ndarray:
    """Rows (a, b) whose components are those of the verified links among the fingerprints of equal, sorted keys.

    Up to FEW fingerprints give the pairs that link; of more, all of a component
    are tied to one of theirs.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    found = []

    def pairs(group: np.ndarray, values: np.ndarray, at: np.ndarray) -> None:
        for step in range(1, FEW):
            at = at[at + step < len(group)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                return
            linked = at[np.bitwise_count(values[at] ^ values[at + step]) <= distance]
            found.append(np.stack([values[linked], values[linked + step]], 1))

    size_at = np.repeat(sizes, sizes)
    pairs(keys, fps, np.flatnonzero((size_at > 1) & (size_at <= FEW)))
    for start, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        label = local_components(fps[start : start + size], distance)
        order = np.argsort(label, kind="stable")
        own, values = label[order], fps[start : start + size][order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        head = np.repeat(values[first], np.diff(np.r_[first, size]))
        found.append(np.stack([head, values], 1)[head != values])
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)


def whole_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, fps) of batches sorted by key, cut so that no key is split."""
    for found in in_runs(batches, "key"):
        yield found.column("key").to_numpy(), found.column("fp").to_numpy().view(np.uint64)


def finer_keys(key: np.ndarray, fp: np.ndarray, mask: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, fp, mask) of finer keys for rows of hot ones, ``distance + 1`` each: a piece of the bits outside ``mask``, which then has it too.

    Two fingerprints that differ in ``distance`` bits are alike in one of these pieces.
    """
    for used in np.unique(mask).tolist():
        own, alike = mask == used, fp[mask == used]
        free = [b for b in range(64) if not used >> b & 1]
        for j in range(distance + 1):
            bits = sum(1 << b for b in free[j * len(free) // (distance + 1) : (j + 1) * len(free) // (distance + 1)])
            mixed = (key[own].view(np.uint64) ^ np.uint64(bits)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29) ^ (alike & np.uint64(bits))) * np.uint64(0xD6E8FEB86659FD93)
            yield (mixed ^ mixed >> np.uint64(32)).view(np.int64), alike, np.full(len(alike), used | bits, np.uint64)


def hot_keys(unique: DataFrame, table: DataFrame, near: np.ndarray, width: int, segments: int, hot: int) -> DataFrame | None:
    """The keys of ``table`` that more than ``hot`` fingerprints have, or None.

    A key gathers the segment values within the radius, so one of these must be
    frequent; only keys around frequent values are counted.
    """
    mask = (1 << width) - 1
    value = F.explode(F.array(*(F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(s << 32)) for s in range(segments)))).alias("value")
    often = shared.stored(unique.select(value).groupBy("value").count().where(F.col("count") > hot // len(near)), "segments-often")
    if often.isEmpty():
        return None
    around = often.select(F.explode(F.array(*(F.col("value").bitwiseXOR(F.lit(x)) for x in near.tolist()))).alias("key")).distinct()
    counted = shared.stored(table.select("key").join(around, "key", "left_semi").groupBy("key").count().where(F.col("count") > hot).select("key"), "segments-hot")
    return None if counted.isEmpty() else counted


def links(unique: DataFrame, distance: int = 4, segments: int = 2, hot: int = HOT) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` whose components are those of all links within ``distance``."""
    n = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width, radius = 64 // segments, distance // segments
    near = ball(width, (radius + 1) // 2)  # half the radius on either side

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(whole), 2000):
                fp = whole[at : at + 2000]
                keys = [((fp >> np.uint64(s * width) & np.uint64((1 << width) - 1))[:, None] ^ near[None, :]) | np.uint64(s << 32) for s in range(segments)]
                key = np.concatenate([k.ravel() for k in keys]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(np.repeat(fp, len(near)), segments).view(np.int64))], names=["key", "fp"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in whole_runs(batches):
            # a text meets another under many keys; what the batch's keys link already isn't said again
            edges = graph.stars(*link_runs(keys, fps, distance).view(np.int64).T)
            if len(edges[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in edges], names=["a", "b"])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, fp, mask in finer_keys(batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("mask").to_numpy().view(np.uint64), distance):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)), pa.array(mask.view(np.int64))], names=["key", "fp", "mask"])

    table = unique.select("fp").mapInArrow(spread, "key long, fp long")
    crowded = hot_keys(unique, table, near, width, segments, hot)
    if crowded is not None:
        segment = F.element_at(F.array(*(F.lit(np.uint64(((1 << width) - 1) << s * width).astype(np.int64).item()) for s in range(segments))), F.shiftrightunsigned("key", 32).cast("int") + 1)
        fine = table.join(crowded, "key", "left_semi").withColumn("mask", segment)
        table = table.join(crowded, "key", "left_anti")
        while not fine.isEmpty():
            # what is still far too hot is split again, by other bits, while a piece has four; what is hot then lies close together
            fine = shared.stored(fine.select("key", "fp", "mask").mapInArrow(split, "key long, fp long, mask long"), "segments-split")
            crowded = shared.stored(fine.groupBy("key").count().where(F.col("count") > 8 * hot).select("key"), "segments-hot")
            last = F.bit_count("mask") > 64 - 4 * (distance + 1)
            table = table.unionByName(fine.where(last).unionByName(fine.where(~last).join(crowded, "key", "left_anti")).select("key", "fp"))
            fine = fine.where(~last).join(crowded, "key", "left_semi")
    return table.repartition(n, "key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def similar(edges: DataFrame, unique: DataFrame, docs: DataFrame, least: float, words_each: int, text: str = "text", by_text: bool = False) -> DataFrame:
    """The edges whose texts' word shingles have a Jaccard similarity of at least ``least``.

    For each end one text is read, that of its ``first_id``: a doc_id, or with
    ``by_text`` a hash of the text.  A bitmap of bounded size picks those texts,
    only their shingles' hashes move.
    """
    ends = shared.stored(edges.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(unique, "fp").select("fp", "first_id"), "fingerprints-asked")
    sets = shingle_sets(ends, docs, words_each, text, by_text)
    left, right = sets.select(F.col("fp").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("fp").alias("b"), F.col("set").alias("set_b"))

    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = edges.select("a", "b").join(left, "a").join(right, "b")
    return joined.where(both >= F.lit(least) * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def shingle_sets(ends: DataFrame, docs: DataFrame, words_each: int, text: str = "text", by_text: bool = False) -> DataFrame:
    """fp and the ``set`` of its text's shingles for each of ``ends`` (fp, first_id), stored."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch.column("text_key").to_pylist(), batch.column("body").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"text_key": [key], "set": [shingle_set(body, words_each).view(np.int64)]}, pa.schema([("text_key", pa.int64()), ("set", pa.list_(pa.int64()))]))

    whole = shared.text_or_empty(text)
    rows = docs.select((F.xxhash64(whole) if by_text else F.col("doc_id").cast("long")).alias("text_key"), whole.cast("binary").alias("body")).where("text_key IS NOT NULL")
    marked, asked = shared.maybe_in(rows, F.col("text_key"), ends.select(F.col("first_id").alias("key")).where("key IS NOT NULL"), 64)
    sets = marked.where(asked).select("text_key", "body").mapInArrow(scan, "text_key long, set array<long>")
    return shared.stored(ends.join(sets, ends.first_id == sets.text_key).select("fp", "set").dropDuplicates(["fp"]), "fingerprints-shingles")


def shingle_set(text: bytes, words_each: int) -> np.ndarray:
    """The distinct hashes of the text's word shingles, sorted."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - words_each + 1)
    found = np.zeros(n, np.uint64)
    for i in range(min(words_each, len(words))):
        found = found * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    found = (found ^ found >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(found ^ found >> np.uint64(32))


def signature(shingles: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A bit of each of SIGNATURE min-hashes, and a hash of each band of them."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max)
    for at in range(0, SIGNATURE, 64):
        for start in range(0, len(shingles), _AT_ONCE):
            least[at : at + 64] = np.minimum(least[at : at + 64], (shingles[start : start + _AT_ONCE, None] * _FACTORS[None, at : at + 64]).min(0))
    bands = np.arange(1, SIGNATURE // BAND + 1, dtype=np.uint64)
    for column in least.reshape(-1, BAND).T:
        bands = (bands ^ column ^ column >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
        bands ^= bands >> np.uint64(32)
    return np.packbits((least >> np.uint64(31) & np.uint64(1)).astype(bool)).tobytes(), bands.view(np.int64)


def sketches(docs: DataFrame, rows: DataFrame, words_each: int, text: str = "text") -> DataFrame:
    """_h, fp, number n of shingles, signature ``sig`` and ``bands`` of each distinct text, stored."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), words_each) for x in batch.column("body")]
            made = [signature(x) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("_h"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x for x, _ in made], pa.binary()), pa.array([x for _, x in made], pa.list_(pa.int64()))], names=["_h", "n", "sig", "bands"])

    whole = shared.text_or_empty(text)
    found = docs.select(F.xxhash64(whole).alias("_h"), whole.cast("binary").alias("body")).mapInArrow(scan, "_h long, n long, sig binary, bands array<long>")
    return shared.stored(found.dropDuplicates(["_h"]).join(rows.select("_h", "fp").distinct(), "_h"), "sketches")


def in_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of batches sorted by ``key``, cut so that no key is split; a batch is copied once, however long a key's run is."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or held[-1].column(key)[-1].as_py() != keys[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def promising(found: pa.Table, least: float):
    """A function of row numbers a, b of ``found``: the bits in which signatures differ, -1 where no similarity of ``least`` is possible."""
    n, sig = found.column("n").to_numpy(), np.frombuffer(b"".join(found.column("sig").to_pylist()), np.uint64).reshape(-1, SIGNATURE // 64)
    differs = (1 - least) / 2
    most = SIGNATURE * differs + SPREAD * (SIGNATURE * differs * (1 - differs)) ** 0.5

    def ask(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        of_size = np.flatnonzero(np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]))
        bits = np.full(len(a), -1)
        found = np.bitwise_count(sig[a[of_size]] ^ sig[b[of_size]]).sum(1, dtype=np.int64)
        bits[of_size] = np.where(found <= most, found, -1)
        return bits

    return ask


def under(sketched: DataFrame, nodes: DataFrame, mixed: DataFrame) -> DataFrame:
    """_h, n, sig, root, key: the texts under each band of ``mixed`` (column key), and few others, with their roots by ``nodes`` (node, root).

    Only what stands there moves, and its bands stay behind.
    """
    bitmap = sketched.sparkSession.sparkContext.broadcast(shared.Bitmap.of(mixed, "key"))

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bands")
            values = lists.flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            kept = bitmap.value.has(values.view(np.uint64))
            at = pa.array(of[kept])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("_h", "n", "sig", "fp")), pa.array(values[kept])], names=["_h", "n", "sig", "fp", "key"])

    rows = sketched.select("_h", "n", "sig", "fp", "bands").mapInArrow(choose, "_h long, n long, sig binary, fp long, key long")
    return with_root(rows, nodes).select("_h", "n", "sig", "root", "key")


def with_root(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of their fingerprint, which is its own where ``nodes`` (node, root) doesn't have it."""
    moved = nodes.where("node <> root")
    return rows.join(moved, rows.fp == moved.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def mixed_keys(rows: DataFrame) -> DataFrame:
    """key and n_texts of the keys under which ``rows`` (key, root) of several roots stand."""
    keys = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n_texts"))
    return keys.where("low < high").select("key", "n_texts")


def meeting(rows: DataFrame, mixed: DataFrame, block: int = BLOCK) -> DataFrame:
    """_h, n, sig, root, key, home, main: ``rows`` as under() gives them, those of large keys of ``mixed`` (key, n_texts) dealt.

    Keys of more than ``block`` texts are dealt to blocks, those outside the
    largest component, ``main``, to each of them; one block is a text's home.
    """
    alone = lambda df: df.select("_h", "n", "sig", "root", "key", F.lit(True).alias("home"), F.lit(None).cast("long").alias("main"))
    crowded = shared.stored(mixed.where(F.col("n_texts") > block), "bands-hot")
    if crowded.isEmpty():
        rows = alone(rows)
    else:
        hot = rows.join(crowded.hint("merge"), "key")
        sizes = hot.groupBy("key", "root").count()
        main = shared.stored(sizes.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main")), "bands-main")
        hot = hot.join(main.hint("merge"), "key").withColumn("cuts", F.ceil(F.col("n_texts") / block)).withColumn("own", F.pmod(F.xxhash64("_h"), "cuts"))
        dealt = F.explode(F.when(F.col("root") == F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
        hot = hot.withColumn("cut", dealt).select("_h", "n", "sig", "root", F.xxhash64("key", "cut").alias("key"), (F.col("cut") == F.col("own")).alias("home"), "main")
        rows = alone(rows.join(crowded.hint("merge"), "key", "left_anti")).unionByName(hot)
    return rows


def outside(found: pa.Table, start: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row outside the main component of the key at ``start``, and those of other components that it meets there."""
    root, home = (found.column(c).to_numpy()[start : start + size] for c in ("root", "home"))
    first = found.column("main")[start].as_py()
    values, counts = np.unique(root, return_counts=True)
    main = values[counts.argmax()] if first is None else first
    for i in np.flatnonzero(root != main).tolist():
        # in a block of several, those outside the main component meet where the first is at home
        yield start + i, start + np.flatnonzero((root != root[i]) & (home | home[i]))


def crossing(rows: DataFrame, mixed: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """a, b, more: pairs of different roots among ``rows`` that share a band of ``mixed`` (key, n_texts) and may be similar.

    Of up to FEW texts under a key all such pairs; of more, each text outside the
    key's largest component gives its closest one and says whether there are ``more``.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cross(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in in_runs(batches, "key"):
            h, key, root = (found.column(c).to_numpy() for c in ("_h", "key", "root"))
            ask, out = promising(found, least), []
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            small = np.repeat(sizes <= FEW, sizes)
            at = np.flatnonzero(small)
            for step in range(1, FEW):
                at = at[at + step < len(h)]
                at = at[key[at] == key[at + step]]
                if not len(at):
                    break
                near = at[root[at] != root[at + step]]
                near = near[ask(near, near + step) >= 0]
                out.append((h[near], h[near + step], np.zeros(len(near), bool)))
            for start, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
                for i, other in outside(found, start, size):
                    bits = ask(np.full(len(other), i), other)
                    other, bits = other[bits >= 0], bits[bits >= 0]
                    if len(other):
                        chosen = other[np.lexsort((h[other], bits))[:1]]
                        out.append((np.full(len(chosen), h[i]), h[chosen], np.full(len(chosen), len(other) > 1)))
            if out:
                x, y, more = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(more)], names=["a", "b", "more"])

    pairs = meeting(rows, mixed, block).repartition(n, "key").sortWithinPartitions("key").mapInArrow(cross, "a long, b long, more boolean")
    return shared.stored(pairs.groupBy("a", "b").agg(F.max("more").alias("more")), "pairs-crossing")


def asking(met: DataFrame, least: float) -> DataFrame:
    """The rows of meeting() that may be similar to one of another root under their key, by their signatures."""
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in in_runs(batches, "key"):
            ask, key, asks = promising(found, least), found.column("key").to_numpy(), np.zeros(found.num_rows, bool)
            firsts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[firsts, len(key)])
            for first, size in zip(firsts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                for i, other in outside(found, first, size):
                    near = other[ask(np.full(len(other), i), other) >= 0]
                    asks[near] = True
                    asks[i] |= len(near) > 0
            yield from found.filter(pa.array(asks)).to_batches()

    return met.repartition(n, "key").sortWithinPartitions("key").mapInArrow(mark, met.schema)


def settled(rows: DataFrame, mixed: DataFrame, docs: DataFrame, least: float, words_each: int, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the roots of all similar texts among ``rows`` that share a band of ``mixed``, compared there by their shingles.

    Signatures say first who may be similar to another under a key; the shingles
    of those alone move, once for each such key, and what leaves a batch is
    stars: texts that may all be similar and aren't make no pairs.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in in_runs(batches, "key"):
            key, root = found.column("key").to_numpy(), found.column("root").to_numpy()
            ask, pairs = promising(found, least), []
            sets = found.column("set").combine_chunks()
            starts, lengths = sets.offsets.to_numpy()[:-1], sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = sets.values.to_numpy().view(np.uint64)
            firsts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for first, size in zip(firsts.tolist(), np.diff(np.r_[firsts, len(key)]).tolist(), strict=True):
                for i, other in outside(found, first, size):
                    other = other[ask(np.full(len(other), i), other) >= 0]
                    if len(other):
                        common = shared_with(values, starts, lengths, i, other)
                        near = other[common >= least * (lengths[i] + lengths[other] - common)]
                        pairs.append((np.full(len(near), root[i]), root[near]))
            if pairs:
                a, b = graph.stars(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    left = shared.stored(asking(meeting(rows, mixed, block), least), "texts-left")
    ends = left.select(F.col("_h").alias("fp"), F.col("_h").alias("first_id")).distinct()
    sets = shingle_sets(shared.stored(ends, "texts-asked"), docs, words_each, text, by_text=True).withColumnRenamed("fp", "_h")
    whole = left.join(sets.hint("merge"), "_h")
    return shared.stored(whole.repartition(n, "key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct(), "links-settled")


def shared_with(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, i: int, other: np.ndarray) -> np.ndarray:
    """How many values of sorted list i each of the lists ``other`` has, AT_ONCE values at a time."""
    own, out = values[starts[i] : starts[i] + lengths[i]], np.zeros(len(other), np.int64)
    upto = np.cumsum(lengths[other])
    cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(_AT_ONCE, upto[-1], _AT_ONCE)) + 1, len(other)])
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = other[low:high]
        ends = np.cumsum(lengths[part])
        at = np.repeat(starts[part] - (ends - lengths[part]), lengths[part]) + np.arange(ends[-1])
        of = np.repeat(np.arange(len(part)), lengths[part])
        place = np.minimum(np.searchsorted(own, values[at]), max(len(own) - 1, 0))
        same = own[place] == values[at] if len(own) else np.zeros(len(at), bool)
        out[low:high] = np.bincount(of[same], minlength=len(part))
    return out


def linked_texts(sketched: DataFrame, docs: DataFrame, edges: DataFrame, least: float, words_each: int, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of fingerprints whose components, with those of ``edges``, are those of all texts of similarity ``least``.

    In each round only texts of different components are asked for, so what is
    linked already, however large, asks nothing more; a pair is compared once.
    What is left where texts have more than they asked for is settled in one go.
    """
    texts = sketched.select(F.col("_h").alias("fp"), F.col("_h").alias("first_id"))
    of_a, of_b = sketched.select(F.col("_h").alias("a"), F.col("fp").alias("fp_a")), sketched.select(F.col("_h").alias("b"), F.col("fp").alias("fp_b"))
    found, asked, level, settle, mixed = edges.select("a", "b").where("false"), None, 0, False, None
    while True:
        nodes = shared.stored(graph.components(edges.select("a", "b").union(found)), "components-before")
        if settle:
            # what isn't mixed stays so, and of FEW texts all pairs were asked for in the round before
            rows = under(sketched, nodes, mixed)
            mixed = shared.stored(mixed_keys(rows).where(F.col("n_texts") > FEW), "bands-left")
            return found if mixed.isEmpty() else found.union(settled(under(sketched, nodes, mixed), mixed, docs, least, words_each, text, block))
        looked = sketched.withColumn("bands", F.slice("bands", 1, STEPS[level]))
        mixed = shared.stored(mixed_keys(with_root(looked.select("fp", "bands"), nodes).select("root", F.explode("bands").alias("key"))), "bands-mixed")
        more = False
        if not mixed.isEmpty():
            pairs = crossing(under(looked, nodes, mixed), mixed, least, block)
            new = pairs.select("a", "b") if asked is None else shared.stored(pairs.select("a", "b").join(asked.hint("merge"), ["a", "b"], "left_anti"), "pairs-asked")
            asked = new if asked is None else asked.union(new)
            known = similar(new, texts, docs, least, words_each, text, by_text=True)
            linked = known.join(of_a, "a").join(of_b, "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
            found = shared.stored(found.union(linked).distinct(), "pairs-similar")
            more = not pairs.where("more").isEmpty()
        if level + 1 < len(STEPS):
            level += 1
        elif more:
            settle = True
        else:
            return found


def near_duplicates(docs: DataFrame, distance: int = 4, words_each: int = 4, segments: int = 2, least: float | None = None, least_words: int = 5, text: str = "text") -> DataFrame:
    """doc_id, _h, fp, root and component_id (smallest doc_id that chains of links reach) for every row.

    With ``least``, texts that have such a similarity over shingles of
    ``least_words`` words are linked too, at any distance of their fingerprints.
    """
    rows = fingerprints(docs, words_each, text=text)
    unique = shared.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints-distinct")
    edges = links(unique, distance, segments)
    if least is not None:
        edges = shared.stored(edges.select("a", "b").distinct(), "links")
        edges = edges.union(linked_texts(sketches(docs, rows, least_words, text), docs, edges, least, least_words, text))
    nodes = graph.components(edges)
    linked = unique.join(nodes, unique.fp == nodes.node).select("fp", "root", "first_id")
    named = linked.join(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "root", "component_id")
    # stored, so that the last join stands alone and Spark can split its hot keys
    unique = unique.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(shared.stored(unique, "components"), "fp").select("doc_id", "_h", "fp", "root", "component_id")


def deduped(docs: DataFrame, distance: int = 4, words_each: int = 4, segments: int = 2, least: float = 0.8, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each near-duplicate group, in their own columns."""
    found = shared.stored(near_duplicates(docs, distance, words_each, segments, least, text=text).select("doc_id", "_h", "root"), "near-groups")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h")
    first = shared.stored(found.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first"), "near-first")
    losers = found.join(first, "root").where(place != F.col("first")).select("doc_id", "_h")
    return shared.without(docs, shared.stored(losers, "near-losers"), text)
