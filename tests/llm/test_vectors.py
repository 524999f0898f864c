"""Whitening, hard negatives and SimHash against brute force, and on awkward input."""

import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mastline.llm import negatives, simhash, vectors, whitening

DDL = "vec_id long, embedding array<float>, label int"
WORD = re.compile("[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], lab) for i, v, lab in rows], DDL)


def clustered(n=700, dim=12, seed=1):
    """Clusters apart from each other, a third of all rows equal, ties, and moved labels."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim)) * 4
    rows = []
    for k in range(n):
        v = centres[k % 8] + rng.standard_normal(dim) * 0.4 if k % 3 else centres[0]
        rows.append((k, v.tolist(), int(rng.integers(0, 4)) if k % 3 else k % 2))
    return rows


BAD = [(900, None, 1), (901, [1.0, None] + [0.0] * 10, 2), (902, [math.nan] * 12, 1), (903, [math.inf] + [0.0] * 11, 1), (904, [1.0] * 5, 1), (905, [], 1)]


def whole(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


# -- 11 --------------------------------------------------------------------------
def check_whitening(got, rows, components=4):
    x = np.array([whole(v) for _, v, _ in rows], float)
    fit = np.unique(x, axis=0)
    cov = np.cov(fit.T, bias=True)
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    assert len(got) == components * len(rows)
    by = {(r.vec_id, r.component): r for r in got}
    n, s = len(fit), fit.sum(axis=0).astype(int).tolist()
    want = (x - fit.mean(axis=0)) @ vector / np.sqrt(value)
    have = np.array([[by[i, c + 1].whitened for c in range(components)] for i, _, _ in rows])
    assert np.abs(have - want * np.sign((have * want).sum(axis=0))).max() < 1e-7
    for i, v, _ in rows:
        for c in range(components):
            r = by[i, c + 1]
            assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(whole(v), s))
            assert r.explained == pytest.approx(value[c] / np.trace(cov), rel=1e-9) and r.identity_error < 1e-6


def test_whitening_equals_numpy(spark):
    rows = clustered()
    check_whitening(whitening.whiten(table(spark, rows + BAD)).collect(), rows)
    far = [(i, (np.array(v) + 3e5).tolist(), lab) for i, v, lab in rows]  # centring first keeps the digits
    check_whitening(whitening.whiten(table(spark, far)).collect(), far)


def test_whitening_on_awkward_tables(spark):
    assert whitening.whiten(table(spark, [])).collect() == [] == whitening.whiten(table(spark, BAD[:4])).collect()
    assert whitening.whiten(table(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)])).collect() == []  # no variance
    line = whitening.whiten(table(spark, [(k, [0.5, k / 8], None) for k in range(5)] + [(None, [0.5, 0.0], 1), (1, [0.5, 0.125], 0)])).collect()
    assert len(line) == 7 and {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)
    clash = table(spark, clustered(60)).withColumn("x", F.lit(1)).withColumn("n", F.lit("a")).withColumn("i", F.lit(2)).withColumn("component", F.lit(3))
    check_whitening(whitening.whiten(clash).collect(), clustered(60))
    huge = whitening.whiten(table(spark, [(1, [1e30, 1.0], 0), (2, [-1e30, 2.0], 0)])).collect()
    assert len(huge) == 2 and all(r.deviation is None for r in huge)


@pytest.mark.parametrize("d", [1, 2, 3, 30, 90])
def test_leading_eigenpairs(d):
    rng = np.random.default_rng(d)
    a, q = rng.standard_normal((d, 2 * d)), np.linalg.qr(rng.standard_normal((d, d)))[0]
    repeated = q @ np.diag([5.0] * min(3, d) + [1.0] * max(0, d - 3)) @ q.T
    for v in (a @ a.T, np.eye(d) * 3, (repeated + repeated.T) / 2, np.outer(a[:, 0], a[:, 0]) * 1e9, np.zeros((d, d))):
        value, vector = whitening.leading(v, 4)
        scale = max(np.abs(v).max(), 1)
        assert np.abs(value - np.linalg.eigvalsh(v)[::-1][:4]).max() < 1e-12 * scale * d
        assert np.abs(vector.T @ vector - np.eye(len(value))).max() < 1e-12
        assert np.abs(v @ vector - vector * value).max() < 1e-12 * scale * d


def test_sturm_counts():
    rng = np.random.default_rng(3)
    diagonal, off = rng.standard_normal(20), rng.standard_normal(19)
    value = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    x = np.linspace(-4, 4, 50)
    assert whitening.count_below(diagonal, off, x).tolist() == [int((value < y).sum()) for y in x]


def test_packed_rows_keep_their_values():
    x = np.array([[0, -1, 40_000], [5, 6, 7], [-(1 << 52), 0, 1]])
    assert vectors.unpack(vectors.pack(x), 3).tolist() == x.tolist()


# -- 12 --------------------------------------------------------------------------
def brute_negatives(rows):
    fine = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(whole(v))) for i, v, lab in rows}
    out = set()
    for i, lab, x in fine:
        if i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), j, other) for j, other, y in fine if j != i))
        for p, pid, _ in [s for s in scored if s[2] == lab][:5]:
            found = [(n, j) for n, j, other in scored if other != lab and 30 * -p <= 100 * -n <= 90 * -p]
            out |= {(i, pid, k + 1, j, -p, -n) for k, (n, j) in enumerate(found[:10])}
    return out


@pytest.mark.parametrize("block_rows,part_anchors,range_rows", [(4096, 32_768, 1 << 14), (16, 3, 50), (5, 2, 20)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block_rows, part_anchors, range_rows):
    monkeypatch.setattr(negatives, "PART_ANCHORS", part_anchors)
    monkeypatch.setattr(negatives, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(negatives, "BUILD_ROWS", 200)
    rows = clustered(1500)
    odd = [(None, rows[0][1], 1), (906, rows[1][1], None), rows[3], rows[3], rows[100]]
    got = negatives.mine(table(spark, rows + odd + BAD), block_rows=block_rows).collect()
    want = brute_negatives(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_hard_negatives_on_awkward_tables(spark):
    assert negatives.mine(table(spark, [])).collect() == [] == negatives.mine(table(spark, BAD)).collect()
    assert negatives.mine(table(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 2)])).collect() == []  # no anchor
    few = [(100, [1.0, 0.0], 1), (101, [1.0, 0.1], 1), (102, [0.5, 0.5], 2), (103, [-1.0, 0.0], 2), (104, [0.0, 0.0], 1)]
    clash = table(spark, few).withColumn("block", F.lit(7)).withColumn("x", F.lit(1)).withColumn("key", F.lit(1)).withColumn("part", F.lit("p"))
    assert {tuple(r) for r in negatives.mine(clash).collect()} == brute_negatives(few) != set()
    same_id = [(200, [1.0, 0.0], 1), (200, [1.0, 0.5], 1), (201, [0.9, 0.1], 1), (202, [0.5, 0.5], 2)]
    assert {(r.anchor_id, r.positive_id, r.negative_id) for r in negatives.mine(table(spark, same_id)).collect()} == {(200, 201, 202)}


def test_zone_maps_spare_blocks(spark):
    """Of clustered vectors, an anchor's windows read a small part of the blocks."""
    rng = np.random.default_rng(5)
    rows = [(k, (np.eye(8)[k % 8] * 6 + rng.standard_normal(8) * 0.1).tolist(), 0) for k in range(4000)]
    df = table(spark, rows).select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = negatives.blocks(df, 8, 1 << 24, size=50)
    anchor = blocks.where("vec_id = 800").select("vec_id", "label", "x", F.lit(0).cast("long").alias("part"), F.array(F.lit(6 * 6 * 256 * 200)).alias("low"),
                                                 F.array(F.lit(1 << 62)).alias("high"))
    read = negatives.needed(blocks, anchor, 1, 4000, 8, True)
    own = {r.block for r in blocks.where("vec_id % 8 = 0").select("block").distinct().collect()}
    total = blocks.select("block").distinct().count()
    assert own <= {r.block for r in read.collect()} and read.count() <= len(own) + 1 < total / 4


def test_hilbert_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = negatives.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        step = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1)
        assert (step == 1).all()


def test_score_bounds_hold():
    rng = np.random.default_rng(2)
    a, x = rng.integers(-90, 90, (5, 6)), rng.integers(-90, 90, (40, 6))
    least, most = negatives.score_bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    score = negatives.product(a, x)
    assert (score >= least).all() and (score <= most).all()


# -- 13 --------------------------------------------------------------------------
def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def roots(keys, alike):
    root = list(range(len(keys)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in range(len(keys)):
        for b in range(a):
            if alike(keys[a], keys[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(keys))]


def simhash_texts():
    rng = random.Random(4)
    words = [a + b for a in "ba ce di fo gu ha".split() for b in "lan mer nis tor".split()]
    texts = [" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.choice([1, 2, 3, 4, 60, 400]))) for _ in range(60)]
    for k in range(40):  # small edits of long texts: few bits
        base = rng.choice([t for t in texts if t.count(" ") > 300]).split(" ")
        base[rng.randrange(len(base))] = "edit"
        texts.append(" ".join(base))
    return texts + ["", None, " \n\t", "A b\x1fC", "a  B\x1fc", texts[5], texts[5].upper().replace(" ", "\n"), "é É x y", "w " * 5000]


def test_simhash_equals_brute_force(spark):
    texts = simhash_texts()
    prints = [plain_fingerprint(t) for t in texts]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].fingerprint for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[k].component_id for k in range(len(texts))] == roots(prints, lambda a, b: (a ^ b).bit_count() <= 2)


def test_links_join_exactly_what_two_bits_join(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(30)} | {0, (1 << 64) - 1, 1 << 63}
    for p in list(prints):
        for bits in (1, 2, 3, 4, 2):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), bits)))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    place = {v: k for k, v in enumerate(signed)}
    found = [(place[r.a], place[r.b]) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "bits long")).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in found)
    joined = set(found) | {(b, a) for a, b in found}
    assert roots(range(len(prints)), lambda a, b: (a, b) in joined) == roots(prints, lambda a, b: (a ^ b).bit_count() <= 2)


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = " ".join("w" * rng.randint(1, 30) + str(rng.randint(0, 9)) for _ in range(400)) + "  \n" + "x" * 300 + " y"
    monkeypatch.setattr(simhash, "PIECE", 64)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_simhash_takes_null_and_repeated_ids(spark):
    rows = [(4, "alpha beta gamma"), (4, "other words here now"), (7, "other words here now"), (None, "alpha beta gamma"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bits", F.lit(1)).withColumn("component_id", F.lit("c"))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.component_id) for r in got} == {(4, 4), (7, 4), (None, None), (2, 2), (3, 2)}
    assert simhash.near_duplicates(df.limit(0)).collect() == []
