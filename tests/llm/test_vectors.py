"""Hard negatives, whitening and SimHash against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from wikiloom.llm import hard_negatives, queries, simhash, whitening

# -- hard negatives ----------------------------------------------------------------------


def plain_negatives(rows, is_anchor, positives=5, negatives=10):
    """``rows`` are (id, label, vector); all pairs."""
    found = []
    rows = [r for r in rows if None not in r]
    for i, (anchor, label, vector) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, other)), id, own)
            for j, (id, own, other) in enumerate(rows)
            if j != i and len(other) == len(vector)
        ]
        scored.sort(key=lambda s: s[:2])
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and -30 * score <= -100 * s[0] <= -90 * score]
            found += [(anchor, positive, k, s[1], -score, -s[0]) for k, s in enumerate(inside[:negatives], 1)]
    return sorted(found)


def vectors(seed, count, dims, spread=9):
    numbers = random.Random(seed)
    centres = [[numbers.randint(-spread, spread) for _ in range(dims)] for _ in range(6)]
    found = []
    for i in range(count):
        centre = numbers.choice(centres)
        found.append((i, numbers.randint(0, 3), [c + numbers.randint(-2, 2) for c in centre]))
    return found


UNTIDY = [
    (None, 1, [1, 2, 3]), (600, None, [1, 2, 3]), (700, 1, None),  # no part
    (800, 2, [5, 5, 5]), (800, 2, [5, 5, 5]), (800, 2, [5, 5, 5]),  # repeated rows
    (900, 1, [4]), (901, 1, [5]), (902, 2, [3]), (903, 3, []), (1000, 3, []), (1001, 2, []),  # other lengths
    *[(1100 + i, i % 3, [7, 7, 7]) for i in range(60)],  # ties
    (-100, 1, [7, 7, 6]), (2000, 1, [0, 0, 0]), (2001, 1, [-9, -9, -9]),
]


@pytest.mark.parametrize(("block", "page"), [(2048, 4096), (7, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, page):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CHUNK", block)
    monkeypatch.setattr(hard_negatives, "PAGE", page)
    rows = vectors(1, 150, 3) + UNTIDY
    table = spark.createDataFrame(rows, "vec_id long, label int, q array<long>").repartition(3)
    table = table.withColumns({c: F.lit("x") for c in ("row", "score", "key", "place", "window")})
    found = hard_negatives.hard_negatives(table, F.col("vec_id") % 20 == 0)
    assert rows_of(found) == sorted(plain_negatives(rows, lambda i: i % 20 == 0), key=repr)
    assert found.count() > 100


def test_blocks_out_of_reach_are_not_read(spark, monkeypatch):
    """Two far heaps: an anchor's windows lie in its own, so half of the blocks and more are left out."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    rows = [(i, i % 2, [100 + i % 7, 100 + i % 5]) for i in range(200)] + [(1000 + i, i % 2, [-100 - i % 7, -100 - i % 5]) for i in range(400)]
    seen = []
    original = hard_negatives._reading

    def reading(chunks, blocks, same, spread):
        pairs = original(chunks, blocks, same, spread)
        seen.append((pairs.select("place").distinct().count(), blocks.count()))
        return pairs

    monkeypatch.setattr(hard_negatives, "_reading", reading)
    table = spark.createDataFrame(rows, "vec_id long, label int, q array<long>")
    found = hard_negatives.hard_negatives(table, F.col("vec_id") == 100)
    assert rows_of(found) == sorted(plain_negatives(rows, lambda i: i == 100), key=repr)
    assert seen and all(2 * read < blocks for read, blocks in seen)


def test_large_numbers_stay_exact(spark):
    rows = [(i, i % 2, [10**8 + i, -(10**8) + 3 * i]) for i in range(12)]
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, q array<long>"), F.col("vec_id") % 5 == 0, low=0, high=100)
    expected = []
    for a in (0, 5, 10):
        scores = {i: sum(x * y for x, y in zip(rows[a][2], rows[i][2])) for i in range(12) if i != a}
        for p in sorted((i for i in scores if i % 2 == a % 2), key=lambda i: (-scores[i], i))[:5]:
            inside = sorted((i for i in scores if i % 2 != a % 2 and 0 <= scores[i] <= scores[p]), key=lambda i: (-scores[i], i))
            expected += [(a, p, k, i, scores[p], scores[i]) for k, i in enumerate(inside[:10], 1)]
    assert rows_of(found) == sorted(expected, key=repr)


def test_no_rows_and_no_anchors(spark):
    none = spark.createDataFrame([], "vec_id long, label int, q array<long>")
    some = spark.createDataFrame([(1, 1, [1, 2])], "vec_id long, label int, q array<long>")
    assert hard_negatives.hard_negatives(none, F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(some, F.lit(None).cast("boolean")).count() == 0
    assert hard_negatives.hard_negatives(some, F.lit(True)).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    keys = [k.tobytes() for k in hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


hilbert_keys = hard_negatives.hilbert_keys


def test_bounds_hold(spark):
    numbers = np.random.default_rng(3)
    anchors, inside = numbers.integers(-50, 50, (20, 5)), numbers.integers(-50, 50, (40, 5))
    low, high = hard_negatives.bounds(anchors, inside.min(axis=0)[None], inside.max(axis=0)[None])
    scores = anchors @ inside.T
    assert (low[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= high[:, 0]).all()


# -- whitening ---------------------------------------------------------------------------


def plain_whitening(vectors, components=16):
    fit = np.unique(np.array(vectors, dtype=np.float64), axis=0)
    off = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(off.T @ off / len(fit))
    return fit, values[::-1][:components], axes.T[::-1][:components], values.sum()


def check_whitening(found, vectors):
    fit, values, axes, total = plain_whitening(vectors)
    n, sums = len(fit), fit.sum(axis=0)
    rows = [r.asDict() for r in found.collect()]
    real = int((values > 1e-12 * values[0]).sum())
    assert len(rows) == real * len(vectors)
    by_row = defaultdict(dict)
    for r in rows:
        by_row[r["vec_id"]][r["component"]] = r
        assert r["n"] == n and r["identity_error"] < 1e-8
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / total, rel=1e-9)
    signs = None
    for i, x in enumerate(vectors):
        own = [by_row[i][k + 1] for k in range(real)]
        exact = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))
        assert {int(r["deviation"]) for r in own} == {exact}
        white = np.array([r["whitened"] for r in own])
        expected = axes[:real] @ (np.array(x) - sums / n) / np.sqrt(values[:real])
        gaps = np.abs(np.diff(values)) / values[0]
        alone = [k for k in range(real) if (k == 0 or gaps[k - 1] > 1e-6) and (k >= len(gaps) or gaps[k] > 1e-6)]
        assert np.abs(white[alone]) == pytest.approx(np.abs(expected[alone]), abs=1e-6)
        turned = np.sign(white * expected)
        signs = turned if signs is None else np.where(signs == 0, turned, signs)
        large = [k for k in alone if abs(expected[k]) > 1e-3]
        assert (turned[large] == signs[large]).all()


def test_whitening_of_the_table_equals_eigenvectors(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    vectors = [[int(np.floor(64 * float(x))) + 1_000_000 for x in r["embedding"]] for r in sorted(given, key=lambda r: r["vec_id"])]
    check_whitening(queries.op12_whitening(spark, "/root/testdata/sf0.001"), vectors)


@pytest.mark.parametrize("kind", ["repeats", "rank", "equal deviations", "one direction", "wide"])
def test_whitening_of_odd_tables(spark, kind):
    numbers = np.random.default_rng(5)
    table = {
        "repeats": np.repeat(numbers.integers(-9, 9, (30, 5)), 3, axis=0),
        "rank": numbers.integers(-9, 9, (60, 3)) @ numbers.integers(-3, 3, (3, 8)),
        # The corners of two boxes: only three different deviations in six dimensions.
        "equal deviations": np.array([[s * 7 * (i == k) for k in range(6)] for i in range(6) for s in (1, -1)]) * [1, 1, 2, 2, 3, 3],
        "one direction": np.outer(np.arange(10), [1, 2, 3]),
        "wide": numbers.integers(-9, 9, (12, 40)) + 1_000_000,
    }[kind]
    vectors = table.tolist()
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, x array<long>").withColumns({"n": F.lit("a"), "block": F.lit(1)})
    check_whitening(whitening.fit_and_whiten(rows.select("vec_id", "x"), "x"), vectors)
    if kind == "repeats":
        again = whitening.whiten(rows, whitening.fit(rows, "x"), "x")
        assert again.columns == ["vec_id", "n", "block", "whitened", "deviation"] and again.count() == len(vectors)


def test_whitening_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, x array<long>")
    same = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (None, [1, 2])], "vec_id long, x array<long>")
    for rows in (none, same):
        found = whitening.fit_and_whiten(rows, "x")
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0
    odd = spark.createDataFrame([(None, [1, 2]), (2, [3, 5]), (2, [3, 5]), (4, [1]), (5, [])], "vec_id long, x array<long>")
    found = whitening.fit_and_whiten(odd, "x").collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in found) == [("2", 1, 2), ("2", 1, 2), ("None", 1, 2)]


def test_complete_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, [1.0]), (2, None), (3, [None]), (4, [nan, 1.0]), (5, [-inf]), (6, [])], "id long, v array<float>")
    assert [r[0] for r in rows.filter(whitening.is_complete("v")).collect()] == [1, 6]


def test_large_deviations_stay_exact():
    model = whitening.Whitening(3 * 10**8, np.array([5, -7]), np.eye(2), np.ones(2), np.ones(2), 0.0)
    values = np.array([[10**6, 3], [-(10**6), 10**6]])
    assert model.deviations(values) == [sum((3 * 10**8 * int(a) - s) ** 2 for a, s in zip(x, (5, -7))) for x in values]


# -- simhash -----------------------------------------------------------------------------


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode("utf-8", "surrogatepass").split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(codes, radius):
    """The least code that links reach, of each code."""
    codes, seen = sorted(set(codes)), {}
    for code in codes:
        if code not in seen:
            seen[code], todo = code, [code]
            while todo:
                own = todo.pop()
                for other in codes:
                    if other not in seen and (own ^ other).bit_count() <= radius:
                        seen[other] = code
                        todo.append(other)
    return seen


def test_simhash_equals_brute_force(spark, documents, texts):
    codes = [(i, plain_fingerprint(t)) for i, t in texts]
    classes = plain_classes([c for _, c in codes], 2)
    least = defaultdict(list)
    for i, c in codes:
        least[classes[c]].append(i)
    expected = [(i, f"{c:016x}", min((x for x in least[classes[c]] if x is not None), default=None)) for i, c in codes]
    assert rows_of(simhash.near_copies(documents)) == sorted(expected, key=repr)


def test_first_hash_is_that_of_the_library():
    assert simhash.shingle_hashes("A b\tC")[0] == xxhash.xxh64(b"a b c", seed=42).intdigest()
    assert len(simhash.shingle_hashes("a b c d e")) == 3 and len(simhash.shingle_hashes(" \n")) == 0
    long = " ".join(f"w{i}" for i in range(70_000))
    assert simhash.fingerprint(simhash.shingle_hashes(long)) == plain_fingerprint(long)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_trees_find_all_within_the_radius(radius):
    numbers = random.Random(radius)
    codes = [numbers.getrandbits(12) for _ in range(300)] + [numbers.getrandbits(64) for _ in range(50)]
    tree = simhash.BKTree()
    for code in codes:
        tree.add(code)
    for code in codes[:80]:
        assert sorted(tree.within(code, radius)) == [i for i, c in enumerate(codes) if (c ^ code).bit_count() <= radius]


def test_crowded_shards_are_cut_and_lose_no_link(spark, monkeypatch):
    """Many fingerprints around one: each part has a crowd, so shards are cut several times."""
    monkeypatch.setattr(simhash, "SHARD", 8)
    numbers = random.Random(7)
    base = numbers.getrandbits(64)
    codes = {base ^ sum(1 << b for b in numbers.sample(range(64), numbers.randint(0, 5))) for _ in range(700)}
    codes |= {numbers.getrandbits(64) for _ in range(100)}
    signed = [(simhash._signed(c),) for c in codes]
    links = simhash.near_links(spark.createDataFrame(signed, "code long")).collect()
    assert links and all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in links)
    joined = {c: c for c, in signed}

    def root(c):
        while joined[c] != c:
            c = joined[c]
        return c

    for a, b in links:
        joined[root(a)] = root(b)
    expected = plain_classes(codes, 2)
    groups, ours = defaultdict(set), defaultdict(set)
    for c in codes:
        groups[expected[c]].add(c)
        ours[root(simhash._signed(c))].add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_simhash_of_nothing(spark, nothing):
    assert simhash.near_copies(nothing).count() == 0
    rows = spark.createDataFrame([(3, None), (2, ""), (2, " "), (None, "x"), (None, "x")], "doc_id long, text string")
    zero = "0" * 16
    x = f"{plain_fingerprint('x'):016x}"
    assert rows_of(simhash.near_copies(rows)) == sorted([(3, zero, 2), (2, zero, 2), (2, zero, 2), (None, x, None), (None, x, None)], key=repr)
