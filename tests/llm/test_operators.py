"""Each operator against brute force, held-out labels or an exact round trip, and on edge rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from oracle import compare
from pyspark.sql import functions as F

from conftest_edges import EDGES, LONG, make_docs
from marketlake.llm import chat, decontaminate, exact, lines, quality, queries, secrets, shared, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(sf=SF):
    return pd.read_parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) is None


# shared


def test_bitmap_never_holds_a_key_back(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bitmap = shared.Bitmap.of(keys, "k")
    held = np.array([r.k for r in keys.collect()], np.int64).view(np.uint64)
    assert bitmap.has(held).all()
    other = np.random.default_rng(0).integers(0, 2**63, 100_000).astype(np.uint64)
    assert bitmap.has(other).mean() < 0.05
    assert not shared.Bitmap.of(keys.where("false"), "k").has(held).any()


def test_without_keeps_columns_and_other_rows(spark, edges):
    losers = edges.where("doc_id IN (1, 7)").select("doc_id", F.xxhash64("text").alias("_h")).union(edges.where("doc_id IS NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("_h")))
    out = shared.without(edges, losers)
    assert out.columns == edges.columns and out.count() == len(EDGES) - 4
    assert out.where("_h <> 'z' OR _touched <> 'z'").count() == 0
    assert shared.without(edges, losers.where("false")).count() == len(EDGES)


# 1 decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                items_here = windows.get(tuple(w[i : i + n]))
                if items_here:
                    found |= items_here
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), sorted(map(str, found))))
    return out


def test_decontamination_on_edges(spark, edges, nothing):
    items = [(1, "quick brown fox jumps over the lazy dog and runs away"), (10, "X"), (2, "x y"), (3, None), (4, "!!"), (5, "kappa alpha beta gamma delta epsilon zeta eta theta iota kappa alpha"), (1, "x y"), (6, "dark forest")]
    bench = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, window string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(edges, bench).collect()]
    key = lambda r: (r[0] is None, r[0], r[1], r[2])
    assert sorted(got, key=lambda r: repr(key(r))) == sorted(contaminated(EDGES, items), key=lambda r: repr(key(r)))
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert decontaminate.decontaminate(edges, bench.where("false")).where("n_hit > 0").count() == 0
    clean = decontaminate.clean(edges, bench)
    assert clean.columns == edges.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _, n, _ in contaminated(EDGES, items) if not n)


def test_windows_that_share_their_rarest_token(spark):
    """Many windows have one rare token at each of its offsets, and the token stands in many documents."""
    w = [f"w{i}" for i in range(40)]
    items = [(i, " ".join([f"a{i}" if k % 2 else w[k] for k in range(5)] + w[10:15] + [f"b{i % 3}"])) for i in range(12)]
    items += [(50 + i, " ".join([*(f"c{i}x{k}" for k in range(i % 5 + 1)), *w[10:15], *w[20 : 24 - i % 5]])) for i in range(10)]
    docs = [(i, f"own{i} " + items[i % len(items)][1] + f" end{i}") for i in range(66)] + [(100 + i, " ".join(w[8:18])) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(make_docs(spark, docs), bench).collect()]
    assert sorted(got) == sorted(contaminated(docs, items))


def test_words_equal_the_pattern():
    texts = ["Ab9_c-é漢 x\x7fy", "", "ONE", "a  b", LONG]
    found = decontaminate.Words([t.encode() for t in texts])
    got = [found.text(a, b).split() if b > a else [] for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
    assert got == [words(t) for t in texts]
    assert len(set(found.hashes.tolist())) == len({w for t in texts for w in words(t)})


# 3 chat


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|end|>"), (1, 2, "bob", "<|end|>"), (1, 3, None, None), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, 1070, "ann", "late"), (3, 1, "ann", "early"), (3, None, "al ex", "z")]
    df = spark.createDataFrame([(*r, "k", "k") for r in rows], "conv_id long, turn long, role string, text string, said string, chunk string")
    got = {(r.conv_id, r.perspective, r.chunk): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "unknown", 0), (None, "ann", 0), (3, "ann", 0), (3, "al ex", 0)}
    ann = got[1, "ann", 0]
    assert ann.text == "<|system|>\nrules<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n< |end|><|end|>\n<|user name=unknown|>\n<|end|>\n"
    assert [ann.text[s.start : s.stop] for s in ann.spans] == ["hi"] and [m["mask"] for m in ann.messages] == [0, 1, 0, 0]
    assert got[3, "ann", 0].text == "<|user name=al ex|>\nz<|end|>\n<|assistant|>\nearly<|end|>\n<|assistant|>\nlate<|end|>\n"
    assert chat.rotate(df.where("false")).count() == 0


def test_chat_of_many_parties_is_whole(spark):
    people = ["张三", "李四", "al ex", "al_ex", "a|b", "a%7Cb", "<|x|>", "line\nbreak"]
    said = [(people[i % 8] if i else "System", f"turn {i}") for i in range(200)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string").repartition(7)
    got = {r.perspective: r for r in chat.rotate(df).collect()}
    assert set(got) == {*people, "System"} - {"System"} and {r.chunk for r in got.values()} == {0}
    for me, r in got.items():
        assert [m.content for m in r.messages] == [t for _, t in said]
        assert [m["mask"] for m in r.messages] == [int(s == me) for s, _ in said]
        assert [r.text[s.start : s.stop] for s in r.spans] == [t for s, t in said if s == me]
        names = {m["name"] for m in r.messages if m["role"] == "user"}
        assert len(names) == 7 and not any(set(x) & set("<>|\n") for x in names)
        heads = re.findall(r"<\|(system|assistant|user name=([^|]*))\|>\n", r.text)
        assert len(heads) == 200 and heads[0][0] == "system" and {x for _, x in heads if x} == names


def test_chat_rows_are_bounded_by_turns(spark):
    """20,000 rows without a conversation, and a long one whose turns have no numbers or share them."""
    lost = [(None, None, f"p{i % 7}", f"lost {i}") for i in range(20_000)]
    long = [(9, None if i < 1500 else i // 3, "ann" if i % 2 else "bob", f"{i:05d}") for i in range(4000)]
    df = spark.createDataFrame(lost + long + long[:50] + [(None, None, "system", "s")], "conv_id long, turn long, role string, text string").repartition(5)
    rows = chat.rotate(df).select("conv_id", "perspective", "chunk", "text", F.size("messages").alias("n"), "spans").collect()
    alone = [r for r in rows if r.conv_id is None]
    assert len(alone) == 20_000 and {(r.n, r.chunk) for r in alone} == {(1, 0)} and all(r.text == f"<|assistant|>\n{r.text[14:-8]}<|end|>\n" and r.text[r.spans[0].start : r.spans[0].stop].startswith("lost ") for r in alone)
    want = "".join(t for *_, t in sorted(long, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])))
    for me in ("ann", "bob"):
        mine = sorted((r for r in rows if r.conv_id == 9 and r.perspective == me), key=lambda r: r.chunk)
        assert [(r.chunk, r.n) for r in mine] == [(0, 1024), (1, 1024), (2, 1024), (3, 4000 - 3 * 1024)]
        assert "".join(re.findall(r"\n(\d{5})<", "".join(r.text for r in mine))) == want


# 4 exact dedup


def test_directory_doubles_and_keeps_order():
    loads = np.zeros(64, np.int64)
    loads[[0, 1, 40]] = [50, 60, 5]
    d = exact.grow_directory(loads, 55)
    assert d.depth == 6 and len(d.slots) == 64 and (np.diff(d.slots) >= 0).all() and d.loads.sum() == 115
    assert d.slots[0] != d.slots[1] and (d.slots[32:] == d.slots[32]).all()
    assert exact.grow_directory(np.zeros(16, np.int64), 5).depth == 0
    assert (np.diff(d.owners(4)) >= 0).all()


def test_exact_on_edges_and_small_buckets(spark, edges, nothing):
    got = exact.dedup(edges, capacity=1).collect()
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for doc, text in EDGES:
        groups[bare(text)].append((-len(text or ""), doc is None, doc))
    assert len(got) == len(EDGES)
    for r in got:
        own = next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(own) and r.keep_id == min(own)[2]
    assert sum(r.kept for r in got) == len(groups)
    kept = exact.deduped(edges)
    assert kept.columns == edges.columns and kept.count() == len(groups)
    assert exact.dedup(nothing).count() == 0 and exact.deduped(nothing).count() == 0
    index = exact.build_index(exact.scanned(edges).where("NOT is_row").drop("is_row", "h"))
    found = index.find(make_docs(spark, [(99, "x"), (98, "new")])).collect()
    assert {r.doc_id: r.keep_id for r in found} == {99: 6, 98: None}


def test_owners_make_the_groups(spark, monkeypatch):
    """All keys collide, more tasks than FAN send each text, and owners still separate the texts."""
    monkeypatch.setattr(exact, "FAN", 3)
    texts = [f"text {i % 5}" + " " * (i % 3) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(20)
    same = lambda bare: F.lit(7).cast("long")
    entries = exact.scanned(docs, key=same).where("NOT is_row").drop("is_row", "h")
    merged, moved = exact.premerged(entries)
    assert moved and merged.count() < entries.count() and merged.agg(F.sum("n")).first()[0] == 60
    index = exact.build_index(entries, capacity=1)
    assert sorted(r.chain for r in index.found.where("head").collect()) == [0, 1, 2, 3, 4]
    for r in exact.dedup(docs, capacity=1, key=same).collect():
        own = [i for i, t in enumerate(texts) if t.split() == texts[r.doc_id].split()]
        assert r.group_size == len(own) and r.keep_id == min(own, key=lambda i: (-len(texts[i]), i)) and r.kept == (r.doc_id == r.keep_id)


def test_many_buckets_have_many_owners(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 150).cast("string")).alias("text"))
    index = exact.build_index(exact.scanned(docs).where("NOT is_row").drop("is_row", "h"), capacity=1)
    assert index.directory.depth > 4
    buckets = index.found.groupBy("bucket").agg(F.countDistinct(F.col("_metadata.file_path")).alias("files")).collect()
    assert len(buckets) > 60 and {r.files for r in buckets} == {1}


# 5 quality and 8 toxicity


def held_out(sf):
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    return labels[[zlib.crc32(str(i).encode()) % 3 == 1 for i in labels.doc_id]]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_quality(spark, sf).toPandas()
    assert len(got) == len(documents(sf)) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    both = got.merge(held_out(sf), on="doc_id")
    assert both.held_out.all() and (both.predicted == both.quality).mean() > 0.95


def test_quality_on_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 0), (None, 1), (8, None)], "doc_id long, quality int")
    assert quality.classify(edges, labels).where("score BETWEEN 0 AND 1").count() == len(EDGES)
    assert quality.classify(edges, labels.where("false")).where("score = 0.5").count() == len(EDGES)
    assert quality.classify(nothing, labels).count() == 0


def test_quality_against_plain_numpy(spark):
    """The summed normal equations and the calibration, over all rows at once."""
    docs, labels = documents("/root/testdata/sf0.01"), pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    model = quality.fit(quality.features(table("documents").repartition(5)), table("labels"))
    x = np.stack([quality.statistics((t or "").encode()) for t in docs.text])
    kernel = quality.Kernel(x.mean(0), x.std(0))
    known = labels[labels.quality.notna() & np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in labels.doc_id])].set_index("doc_id").quality
    own = docs.doc_id.isin(known.index).to_numpy()
    z, y = kernel(x[own]), known[docs.doc_id[own]].to_numpy(float)
    penalty = np.diag([1e-3 * len(y)] * quality.COMPONENTS + [1e-9])
    weights = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.abs(kernel(x) @ weights - model.raw(x)).max() < 1e-6
    # the calibrated means are the best rising fit of the bins: no neighbour pair falls, and each block is the mean of its labels
    bins = np.floor((np.clip(z @ weights, -0.5, 1.5) + 0.5) * (quality.BINS // 2))
    centres, means = quality.isotonic(*(np.array([f(bins == b) for b in np.unique(bins)]) for f in (lambda m: (z @ weights)[m].mean(), lambda m: y[m].sum(), lambda m: float(m.sum()))))
    assert np.allclose(means, model.means, atol=1e-6) and np.allclose(centres, model.centres, atol=1e-6)


def test_isotonic_rises():
    x, y = quality.isotonic(np.arange(5.0), np.array([1.0, 0, 2, 1, 4]), np.array([2.0, 2, 2, 2, 4]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, sf).toPandas()
    assert len(got) == len(documents(sf)) and got.severity.between(0, 3).all()
    both = got.merge(held_out(sf), on="doc_id")
    assert both.rejected[both.toxic == 1].mean() > 0.85 and both.rejected[both.toxic == 0].mean() < 0.02


def test_ordinal_fit_is_the_optimum():
    """Against plain numpy: the penalised likelihood has no slope left where the fit ends."""
    rng = np.random.default_rng(0)
    x, weights = rng.normal(size=(400, 3)), rng.integers(1, 4, 400).astype(float)
    score = x @ [1.5, -1.0, 0.0] + rng.logistic(size=400)
    for most in (1, 3):
        grades = np.searchsorted([0.5, 1.5, 3.0][:most], score)
        w, cuts = toxicity.fit_ordinal(x, grades, weights, most, ridge=2.0, steps=3000)

        def loss(theta, most=most, grades=grades):
            above = 1 / (1 + np.exp(-((x @ theta[:3])[:, None] - theta[3:])))
            p = np.hstack([np.ones((400, 1)), above])[np.arange(400), grades] - np.hstack([above, np.zeros((400, 1))])[np.arange(400), grades]
            return (-(weights * np.log(p)).sum() + theta[:3] @ theta[:3]) / weights.sum()

        at = np.r_[w, cuts]
        slopes = [(loss(at + step) - loss(at - step)) / 2e-5 for step in 1e-5 * np.eye(len(at))]
        assert np.abs(slopes).max() < 2e-3 and (np.diff(cuts) > 0).all() and w[0] > 1 > -0.6 > w[1]


def test_severity_follows_what_labels_never_said(spark):
    """Labels are 0 and 1; texts with more insults get a higher severity, also where the fit saw no label."""
    rng = np.random.default_rng(2)
    calm, bad = [f"word{i}" for i in range(300)], [f"insult{chr(97 + i)}" for i in range(6)]
    docs = [(i, " ".join(rng.permutation([*rng.choice(calm, 60), *rng.choice(bad, (0, 1, 4, 16)[i % 4])]).tolist())) for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in docs], "doc_id long, toxic int")
    frame = make_docs(spark, docs)
    got = toxicity.classify(frame, toxicity.fit(frame, labels)).toPandas().set_index("doc_id")
    unseen = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    mean = [got.severity[[i for i in unseen if i % 4 == k]].mean() for k in range(4)]
    assert mean[0] < 0.3 and mean[0] < mean[1] - 0.3 and mean[1] < mean[2] - 0.3 and mean[2] < mean[3] - 0.3
    assert got.rejected[[i for i in unseen if i % 4]].mean() > 0.97 and not got.rejected[[i for i in unseen if i % 4 == 0]].any()


def test_copies_make_no_rules(spark):
    """A toxic text that was copied sixty times counts once, and near copies nearly so."""
    rng = np.random.default_rng(7)
    calm, own = [f"word{i}" for i in range(400)], [f"rare{i}" for i in range(80)]
    line = " ".join(own) + " insulta"
    bad = [line if i % 2 else line + f" x{i}" for i in range(120)]
    bad += [" ".join(rng.permutation([*rng.choice(calm, 80), f"insult{'abc'[i % 3]}"]).tolist()) for i in range(90)]
    good = [" ".join(rng.choice(calm, 80)) for _ in range(600)]
    labels = spark.createDataFrame([(i, int(i < len(bad))) for i in range(len(bad + good))], "doc_id long, toxic int")
    more = [" ".join([*rng.choice(calm, 100), "insultb"]), " ".join([*rng.choice(own, 40), *rng.choice(calm, 40)]), " ".join(rng.choice(calm, 1500))]
    model = toxicity.fit(make_docs(spark, list(enumerate(bad + good))), labels)
    assert {x for x in model.wanted if x.startswith("rare")} == set() and "insulta$" in model.wanted
    assert [r.rejected for r in toxicity.classify(make_docs(spark, list(enumerate(more))), model).orderBy("doc_id").collect()] == [True, False, False]


def test_opinions_never_see_the_row(spark):
    """A row's grade doesn't move with its own fold's labels."""
    rng = np.random.default_rng(3)
    x, folds = rng.random((200, 4)), np.arange(200) % 2
    toxic = x[:, 0] + 0.2 * rng.random(200) > 0.6
    one = toxicity.second_opinion(x, toxic, folds, np.ones(200), [[0, 1], [0, 2, 3]])
    other = toxicity.second_opinion(x, np.where(folds == 0, rng.random(200) < 0.5, toxic), folds, np.ones(200), [[0, 1], [0, 2, 3]])
    assert (one[folds == 0] == other[folds == 0]).all() and (one[folds == 1] != other[folds == 1]).any()


def test_toxicity_on_edges(spark, edges, nothing):
    bad = [(100 + i, f"some calm words {i} and then stupidword stupidword again {i}") for i in range(40)]
    docs = make_docs(spark, EDGES + bad)
    labels = spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i in (1, 2, 3, 4, 8, 9)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.cuts) > 0).all()
    kept = toxicity.filtered(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(EDGES)
    assert toxicity.classify(docs, model).where("rejected").count() == 40
    assert toxicity.filtered(nothing, model).count() == 0
    none = toxicity.fit(edges, labels.where("toxic = 0"))
    assert toxicity.filtered(edges, none).count() == len(EDGES)


# 6 simhash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance):
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def test_simhash_query_against_brute_force(spark):
    d = documents("/root/testdata/sf0.01")
    got = queries.op6_simhash(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id").loc[d.doc_id]
    fps = np.array([brute_fingerprint(t) for t in d.text], np.uint64)
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps.tolist()]
    label = brute_components(fps, 4)
    smallest = pd.Series(d.doc_id.to_numpy()).groupby(label).transform("min")
    assert got.component_id.tolist() == smallest.tolist()


def test_simhash_on_edges(spark, edges, nothing):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    assert {r.fp for r in got if r.doc_id in (3, 4, 5)} == {0} and {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.deduped(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 1 in ids and 2 not in ids and 8 in ids and 9 not in ids and ids.count(3) == 1 and 4 not in ids


@pytest.mark.parametrize(("distance", "segments", "hot"), [(4, 2, 20_000), (4, 2, 20), (5, 2, 20), (8, 3, 20_000), (8, 3, 40)])
def test_links_lose_nothing(spark, distance, segments, hot):
    rng = np.random.default_rng(distance)
    values = set()
    for centre in rng.integers(0, 2**63, 25).tolist():
        for _ in range(int(rng.integers(1, 60))):
            x = centre
            for b in rng.integers(0, 64, int(rng.integers(0, 9))).tolist():
                x ^= 1 << b
            values.add(x)
    fps = np.array(sorted(values), np.uint64)
    unique = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)})).repartition(3)
    parent = {x: x for x in fps.view(np.int64).tolist()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.links(unique, distance, segments, hot).distinct().collect():
        parent[root(r.a)] = root(r.b)
    label = brute_components(fps, distance).tolist()
    pairs = {(root(x), c) for x, c in zip(fps.view(np.int64).tolist(), label, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@pytest.mark.parametrize(("distance", "segments", "segment"), [(4, 2, 0), (4, 2, 1), (8, 3, 1)])
def test_pieces_of_a_hot_key_meet(distance, segments, segment):
    """Two fingerprints that link have one of their finer keys in common, whatever bits differ outside the segment."""
    rng, width = np.random.default_rng(1), 64 // segments
    a = rng.integers(0, 2**63, 2000, np.uint64) * np.uint64(2)
    outside = [b for b in range(64) if not segment * width <= b < (segment + 1) * width]
    b = a ^ np.array([sum(1 << int(x) for x in rng.choice(outside, distance, False)) for _ in a], np.uint64)
    key = (a >> np.uint64(segment * width) & np.uint64((1 << width) - 1) | np.uint64(segment << 32)).view(np.int64)
    mask = np.full(len(a), ((1 << width) - 1) << segment * width, np.uint64)
    for _ in range(2):  # and what these keys are split into again, for the piece that they share
        one, other = ([list(x) for x in zip(*simhash.finer_keys(key, x, mask, distance), strict=True)] for x in (a, b))
        same = np.stack(one[0]) == np.stack(other[0])
        assert same.any(0).all() and len(np.unique(one[0])) > len(np.unique(key))
        chosen = same.argmax(0), np.arange(len(a))
        # rows of one mask at a time
        first = chosen[0] == chosen[0][0]
        a, b, key, mask = a[first], b[first], np.stack(one[0])[chosen][first], np.stack(one[2])[chosen][first]


def test_fingerprints_of_one_segment_are_split(spark):
    """100,000 fingerprints that share their upper half: chains of four, and no group of more than a few hundred."""
    rng = np.random.default_rng(6)
    heads = np.unique(rng.integers(0, 2**32, 25_000, np.uint64))
    far = heads[np.r_[True, np.bitwise_count(heads[1:] ^ heads[:-1]) > 0]]
    steps = [np.uint64(0), np.uint64(0b1), np.uint64(0b111), np.uint64(0b1_0000_0000_0111)]
    fps = np.unique(np.concatenate([(far ^ s) | np.uint64(0xABCDEF12 << 32) for s in steps]))
    unique = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)})).repartition(4)
    edges = simhash.links(unique, hot=500).toPandas()
    a, b = edges.a.to_numpy().view(np.uint64), edges.b.to_numpy().view(np.uint64)
    touched = np.unique(np.r_[a, b])
    for s in steps[1:]:
        assert np.isin((far ^ s) | np.uint64(0xABCDEF12 << 32), touched).all()


def test_distant_links_need_similar_texts(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
    near = base.copy()
    near[200] = "changed"
    docs = make_docs(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"v{i}" for i in rng.integers(0, 10**6, 400)))])
    assert sorted(r.doc_id for r in simhash.deduped(docs).collect()) == [1, 3]
    unique = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "fp long, first_id long")
    edges = spark.createDataFrame([(10, 20), (10, 30)], "a long, b long")
    assert [(r.a, r.b) for r in simhash.similar(edges, unique, docs, 0.8, 5).collect()] == [(10, 20)]


def brute_kept(docs, sure=4, most=64, least=0.8):
    """The smallest doc_id of each chain of links of ``sure`` bits, or of similarity ``least`` and ``most`` bits; and the bits of the latter."""
    ids, texts = zip(*docs, strict=True)
    fps = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    bits = np.bitwise_count(fps[:, None] ^ fps[None, :]).astype(int)
    alike = np.array([[len(x & y) >= least * len(x | y) for y in sets] for x in sets])
    near = (bits <= sure) | (alike & (bits <= most))
    label = np.arange(len(ids))
    while (label != (new := np.array([label[n].min() for n in near]))).any():
        label = new
    return sorted({min(i for i, c in zip(ids, label, strict=True) if c == k) for k in label}), bits[alike]


def test_documents_that_share_a_passage_stay(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    passage = word(300)
    docs = [(i, " ".join(passage + word(150))) for i in range(300)]
    base = passage + word(150)
    for i in range(300, 360):  # near copies that share the passage too
        own = base.copy()
        for at in rng.integers(0, 450, int(rng.integers(1, 4))).tolist():
            own[at] = f"e{i}"
        docs.append((i, " ".join(own)))
    want, _ = brute_kept(docs)
    assert 280 < len(want) < 310
    assert sorted(r.doc_id for r in simhash.deduped(make_docs(spark, docs)).select("doc_id").collect()) == want


def test_poor_texts_ask_for_few_pairs(spark, monkeypatch):
    """Texts of 20 of 60 shared paragraphs, none alike: what meets grows with the texts, not with their square."""
    asked = []
    crossing = simhash.crossing
    monkeypatch.setattr(simhash, "crossing", lambda *args: asked.append(crossing(*args)) or asked[-1])
    for n in (150, 600):
        rng = np.random.default_rng(7)
        shared_text = [" ".join(f"p{k}w{i}" for i in rng.integers(0, 10**6, 12)) for k in range(60)]
        docs = [(i, " ".join(shared_text[k] for k in rng.choice(60, 20, False))) for i in range(n)]
        assert simhash.deduped(make_docs(spark, docs)).count() == n
        assert sum(p.count() for p in asked) <= n // 20
        asked.clear()


def test_near_texts_that_never_link_make_no_pairs(spark, monkeypatch):
    """A grid of texts of similarity 0.71 or 0.78 that share bands, and one pair of 0.8 or more among them."""
    asked = []
    crossing = simhash.crossing
    monkeypatch.setattr(simhash, "crossing", lambda *args: asked.append(crossing(*args)) or asked[-1])
    docs = []
    for i in range(144):
        words = [f"w{k}" for k in range(124)]
        words[4 + i // 12 * 5], words[64 + i % 12 * 5] = f"x{i}", f"y{i}"
        docs.append((i, " ".join(words)))
    docs.append((144, " ".join([*docs[17][1].split()[:-5], *"abcde"])))
    table = make_docs(spark, docs)
    rows = simhash.fingerprints(table, 4)
    none = spark.createDataFrame([], "a long, b long")
    found = simhash.linked_texts(simhash.sketches(table, rows, 5), table, none, 0.8, 5)
    of = {r.fp: r.doc_id for r in rows.collect()}
    assert len(of) == 145 and {frozenset((of[r.a], of[r.b])) for r in found.collect()} == {frozenset((17, 144))}
    assert sum(p.count() for p in asked) <= 20 * len(docs), [p.count() for p in asked]


def test_shingles_of_texts_that_cannot_be_similar_stay_where_they_are(spark, monkeypatch):
    """The last round takes the shingles of the grid's texts, not those of 800 that share a passage, and so bands, with similarity 0.5."""
    asked, stored = [], simhash.shared.stored

    def recorded(df, name, *args):
        out = stored(df, name, *args)
        if name == "texts-asked":
            asked.append({r.first_id for r in out.select("first_id").collect()})
        return out

    monkeypatch.setattr(simhash.shared, "stored", recorded)
    rng = np.random.default_rng(11)
    word = lambda n: [f"v{i}" for i in rng.integers(0, 10**6, n)]
    passage = word(100)
    docs = [(i, " ".join(passage + word(50))) for i in range(800)]
    for i in range(144):
        words = [f"w{k}" for k in range(124)]
        words[4 + i // 12 * 5], words[64 + i % 12 * 5] = f"x{i}", f"y{i}"
        docs.append((800 + i, " ".join(words)))
    docs.append((944, " ".join([*docs[817][1].split()[:-5], *"abcde"])))
    table = make_docs(spark, docs)
    rows = simhash.fingerprints(table, 4)
    found = simhash.linked_texts(simhash.sketches(table, rows, 5), table, spark.createDataFrame([], "a long, b long"), 0.8, 5)
    of = {r.fp: r.doc_id for r in rows.collect()}
    assert {frozenset((of[r.a], of[r.b])) for r in found.collect()} == {frozenset((817, 944))}
    doc_of = {r._h: r.doc_id for r in rows.collect()}
    assert len(asked) == 1 and asked[0] and all(doc_of[h] >= 800 for h in asked[0])


def test_lists_are_met_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "_AT_ONCE", 7)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, n).astype(np.uint64) << np.uint64(58)) for n in (0, 5, 30, 1, 12, 25, 0)]
    lengths = np.array([len(x) for x in sets])
    starts, values = np.cumsum(lengths) - lengths, np.concatenate(sets)
    for i in range(len(sets)):
        other = np.array([k for k in range(len(sets)) if k != i])
        assert simhash.shared_with(values, starts, lengths, i, other).tolist() == [len(np.intersect1d(sets[i], sets[k])) for k in other]


def test_similar_texts_of_distant_fingerprints_go(spark):
    rng = np.random.default_rng(3)
    docs = []
    for i in range(40):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        near = base.copy()
        near[int(rng.integers(5, 55))] = "changed"
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    want, bits = brute_kept(docs)
    assert (bits > 8).sum() >= 6 and want == list(range(0, 80, 2))
    docs += [(None, docs[0][1] + " more")]  # a text without an id is compared too
    assert sorted((r.doc_id is None, r.doc_id) for r in simhash.deduped(make_docs(spark, docs)).select("doc_id").collect()) == [(False, i) for i in want]


# 7 secrets


def brute_secrets(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII | re.IGNORECASE):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets_query_against_brute_force(spark):
    d = documents("/root/testdata/sf0.01").set_index("doc_id")
    for r in queries.op7_secrets(spark, "/root/testdata/sf0.01").collect():
        want = brute_secrets(d.text[r.doc_id])
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k) for k in ("assign:", "access:", "hex:"))


@pytest.mark.parametrize("text", ["token: token: abcdefgh", "PassWord = 'abcdef'", "secret=abc", "ſecret=abcdefgh", "apiKey=abcdef api_key: x", "AKIA" + "A" * 15, "AKIA" * 6, "f" * 23 + "g" + "0" * 24, "token=token=abcdef"])
def test_secret_rules(text):
    assert ",".join(f"{k}:{s}:{e}" for s, k, e in secrets.find(text)) == brute_secrets(text)


def test_ledger_scans_only_unseen_pairs(spark, edges, nothing):
    path = shared.new_path(spark, "ledger")
    first = secrets.scan(edges, path)
    assert first.count() == len(EDGES) and {r.path: r.n_assign for r in first.collect()}[10] == 1
    blobs = spark.read.parquet(path).count()
    assert blobs == len({t or "" for _, t in EDGES})
    more = edges.unionByName(make_docs(spark, [(50, "secret: abcdefgh"), (51, "x")]))
    assert secrets.scan(more, path).count() == len(EDGES) + 2
    assert spark.read.parquet(path).count() == blobs + 1
    secrets.scan(more, path, rule_version="next").count()
    assert spark.read.parquet(path).count() == 2 * blobs + 2
    odd = make_docs(spark, [(60, "-----BEGIN RSA PRIVATE KEY----- and token=abcdefgh")])
    old, new = (secrets.scan(odd, path, rule_version=v).first() for v in ("base-1", "more-1"))
    assert old.spans == old.base_spans == new.base_spans == "assign:36:50" and new.spans == "pem:0:31,assign:36:50"
    assert secrets.scan(nothing, path).count() == 0


def test_ledger_query_scans_each_pair_once(spark, monkeypatch):
    """Two increments and two rule versions on one ledger: two scans, and one row for each blob and rule version."""
    made, scanned, whole = [], [], secrets.scan_unseen
    monkeypatch.setattr(queries.shared, "new_path", lambda spark, name, f=shared.new_path: made.append(f(spark, name)) or made[-1])

    def counted(*args):
        scanned.append(shared.stored(whole(*args), "t"))
        return scanned[-1]

    monkeypatch.setattr(secrets, "scan_unseen", counted)
    found = queries.op7_secrets(spark, SF)
    d = documents()
    first = {t or "" for i, t in zip(d.doc_id, d.text, strict=True) if zlib.crc32(str(i).encode()) % 2 == 0}
    n_blobs = d.text.fillna("").nunique()
    ledger = spark.read.parquet(next(x for x in made if "secret-ledger" in x))
    assert found.count() == len(d) and ledger.count() == ledger.select("blob", "rule_version").distinct().count() == 2 * n_blobs
    assert [x.count() for x in scanned] == [len(first), 2 * n_blobs - len(first)]


def test_planted_secrets_of_the_later_rules(spark, tmp_path):
    """Private keys, signed tokens and personal access tokens among base ones, in copies and in both increments."""
    planted = [
        "-----BEGIN RSA PRIVATE KEY----- token: abcdefgh", "x eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK y", "ghp_" + "A1" * 18 + " password=hunter22", "-----BEGIN PRIVATE KEY-----" * 2,
        "secret='eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK'", "nothing", "", None, "é🙂 gho_" + "b" * 40,
    ]
    docs = [(i, planted[i % len(planted)]) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_secrets(spark, str(tmp_path)).collect()}
    assert got.keys() == {i for i, _ in docs}
    later = [("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), ("pat", r"gh[pousr]_[A-Za-z0-9]{36,}")]
    order = ["assign", "access", "hex", "pem", "jwt", "pat"]
    for i, text in docs:
        base = [x.split(":") for x in brute_secrets(text or "").split(",") if x]
        more = [(kind, str(m.start()), str(m.end())) for kind, pattern in later for m in re.finditer(pattern, text or "")]
        want = ",".join(":".join(x) for x in sorted([tuple(x) for x in base] + more, key=lambda x: (int(x[1]), order.index(x[0]), int(x[2]))))
        assert got[i].spans == want and got[i].base_sha256 == hashlib.sha256(brute_secrets(text or "").encode()).hexdigest()
    assert sum(r.spans.count("pem:") for r in got.values()) > 5 and sum("jwt:" in r.spans for r in got.values()) > 5 and sum("pat:" in r.spans for r in got.values()) > 5


# 9 line dedup


def test_line_dedup_on_edges(spark, edges, nothing):
    run = "\n".join(f"line {i} with a few more words in it than before" for i in range(12))
    docs = make_docs(spark, EDGES + [(20, f"start\n{run}\nend"), (21, f"other start\n\n{run}\nend"), (22, f"{run}\nmid\n{run}"), (23, "line 3 with a few more words in it than before\nown")])
    got = {(r.doc_id, r.text, r.n_deleted) for r in lines.dedup_lines(docs).collect()}
    assert (20, f"start\n{run}\nend", 0) in got and (21, "other start\n", 13) in got and (22, "mid", 24) in got
    assert (23, "line 3 with a few more words in it than before\nown", 0) in got
    assert (3, "", 0) in got and (11, "line one\n\nline two\nline one", 0) in got
    assert lines.dedup_lines(nothing).count() == 0


def brute_lines(docs, least=50):
    """Deleted line numbers of each document: runs of any length that have an earlier copy apart from them."""
    texts = [[(i, x.strip()) for i, x in enumerate((t or "").split("\n")) if x.strip()] for _, t in docs]
    seen, gone = {}, [set() for _ in docs]
    for d in sorted(range(len(docs)), key=lambda d: (docs[d][0] is None, docs[d][0], d)):
        own = texts[d]
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = tuple(x for _, x in own[a:b])
                if sum(len(x.split()) for x in run) >= least:
                    at = seen.setdefault(run, (d, a, b))
                    if at[0] != d or at[2] <= a:
                        gone[d] |= {i for i, _ in own[a:b]}
    return gone


def test_line_runs_against_brute_force(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    pool = [words(int(n)) for n in rng.integers(5, 30, 12)]
    same = "one line of ten words that stands again and again"
    docs = [(1, "\n".join([same] * 8)), (2, "\n".join(["own " + same] * 21)), (3, "\n".join([pool[0], pool[1]] * 9 + [pool[2]]))]
    for i in range(25):
        parts, at = [], int(rng.integers(0, 12))
        for _ in range(int(rng.integers(1, 40))):
            at = (at + 1) % 12 if rng.random() < 0.8 else int(rng.integers(0, 12))
            parts.append(pool[at] if rng.random() < 0.95 else words(8))
            if rng.random() < 0.1:
                parts.append("  ")
        docs.append((100 - i, "\n".join(parts)))
    docs += [docs[5], (None, docs[7][1]), (None, words(60))]
    want = sorted((str(d), len(g), "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g)) for (d, t), g in zip(docs, brute_lines(docs), strict=True))
    got = lines.dedup_lines(make_docs(spark, docs).coalesce(2)).collect()
    assert sorted((str(r.doc_id), r.n_deleted, r.text) for r in got) == want
    assert ("1", 0, docs[0][1]) in want and {n for d, n, _ in want if d == "2"} == {16}


def test_line_runs_are_maximal(spark):
    run = [f"line {i} with a few more words in it than before" for i in range(40)]
    docs = [(1, "\n".join(run)), (2, "\n".join(["start", *run[3:30], "end"])), (3, "\n".join(run[10:]))]
    rows = shared.stored(shared.with_row_id(make_docs(spark, docs).coalesce(1)), "t")
    assert sorted((r.doc_id, r.depth) for r in lines.repeated_runs(lines.line_table(rows)).collect()) == [(2, 27), (3, 30)]


# 10 warc


def test_warc_round_trip(spark):
    page = "<p>é漢" + "x" * 120
    rows = [(3, "http://a/\r\nX: y", page), (1, None, page), (2, "http://b", page), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (1, None, page), (None, "n", page), (8, "u", "\r\n\r\nWARC/1.1" + "y" * 100), (9, "http://é.漢/a%20b%C3%A9 c", "long " * 2_000_000)]
    df = spark.createDataFrame([(*r, "k", "k") for r in rows], "page_id long, url string, html string, digest string, refers_to string")
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.page_id].append(r)
    assert {r.record_type for r in by_id[1]} == {"response"} and bytes(by_id[1][0].payload).decode() == page
    assert [(r.record_type, r.refers_to, r.payload) for r in by_id[3] + by_id[2]] == [("revisit", 1, None)] * 2
    assert by_id[3][0].payload_bytes == len(page.encode()) and by_id[3][0].payload_digest == hashlib.sha256(page.encode()).hexdigest()
    assert "\n" not in by_id[3][0].url and by_id[1][0].url is None and {r.record_type for r in by_id[7]} == {"response"}
    assert bytes(by_id[8][0].payload).decode() == rows[9][2] and by_id[None][0].record_type == "response"
    assert bytes(by_id[9][0].payload).decode() == rows[10][2] and by_id[9][0].url == "http://é.漢/a%20b%C3%A9 c"
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_reader_refuses_what_is_broken():
    import gzip
    import io

    good = warc.record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), "response", None, "d")
    stream = lambda *records: io.BytesIO(b"".join(gzip.compress(r) for r in records))
    assert [warc.parse_record(x)["page_id"] for x in warc.members(stream(good, good))] == [1, 1]
    for bad in (good.replace(b"payload", b"pAyload"), good[:-1], good + b"x", b"junk"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(gzip.compress(good)[:-9])))
