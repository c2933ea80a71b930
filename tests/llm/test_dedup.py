import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import rows_of
from wikiloom.llm import jaccard_join, substring_dedup, suffix_dedup
from wikiloom.llm.common import Rolling, minimisers
from wikiloom.llm.gsaca import common_prefixes, suffix_array


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def removed_runs(starts, length, total):
    gone = np.zeros(total, dtype=bool)
    for s in starts:
        gone[s : s + length] = True
    return gone


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(500):
        text = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))]
        sa, rank = suffix_array(np.array(text, dtype=np.int64))
        assert sa == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = common_prefixes(text, sa, rank)
        for r in range(1, len(sa)):
            a, b = text[sa[r - 1] :], text[sa[r] :]
            assert lcp[r] == sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b)))


def test_repeated_starts_equal_counting():
    rng = random.Random(2)
    rolling = Rolling()
    for _ in range(300):
        base = bytes(rng.choice(b"ab cd\n") if rng.random() < 0.9 else rng.randrange(256) for _ in range(60))
        segments, length = [], rng.choice([8, 12, 20])
        for _ in range(rng.randint(1, 5)):
            a = rng.randint(0, 30)
            segments.append(bytes(rng.choices(b"xyab ", k=rng.randint(0, 10))) + base[a : rng.randint(a, 60)] + bytes(rng.choices(b"xyz ", k=5)))
        counted = Counter(s[i : i + length] for s in segments for i in range(len(s) - length + 1))
        expected = [[i for i in range(len(s) - length + 1) if counted[s[i : i + length]] > 1] for s in segments]
        assert [x.tolist() for x in suffix_dedup.repeated_starts(segments, length, rolling)] == expected


def test_equal_runs_have_equal_anchors():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    a = np.concatenate([rng.integers(0, 1 << 63, 37).astype(np.uint64), shared])
    b = np.concatenate([shared, rng.integers(0, 1 << 63, 11).astype(np.uint64)])
    of_a, of_b = minimisers(a, 20)[0], minimisers(b, 20)[0]
    assert (of_a[37 : 37 + 81] - 37 == of_b[:81]).all()


def brute_bytes(texts, length):
    data = [(t or "").encode() for _, t in texts]
    counted = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    found = []
    for (doc, _), d in zip(texts, data):
        gone = removed_runs([i for i in range(len(d) - length + 1) if counted[hash(d[i : i + length])] > 1], length, len(d))
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        found.append((doc, len(d), int(gone.sum()), spans, sha(np.frombuffer(d, dtype=np.uint8)[~gone].tobytes())))
    return sorted(found, key=repr)


def test_byte_repeats_equal_brute_force(documents, texts):
    found = suffix_dedup.find_repeats(documents, with_kept=True)
    assert rows_of(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute_bytes(texts, 200)
    for r in found.select("n_bytes", "n_removed", "kept").collect():
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"]


@pytest.mark.parametrize("batch", [1, 1 << 21])
def test_byte_repeats_in_any_batches(spark, monkeypatch, batch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(40)]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for i in range(60):
        head, tail = (" ".join(rng.choices(words, k=rng.randint(0, 20))) for _ in range(2))
        cut = rng.randint(0, 80)
        rows.append((i, f"{head} {passage[cut:]} {tail}" if i % 3 else head + tail))
    rows += [(60, rows[1][1]), (61, "z" * 900), (62, "ab" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(suffix_dedup.find_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute_bytes(rows, 200)


def brute_words(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in texts]
    counted = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    found = []
    for (doc, _), w in zip(texts, words):
        gone = removed_runs([i for i in range(len(w) - window + 1) if counted[tuple(w[i : i + window])] > 1], window, len(w))
        found.append((doc, len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return sorted(found, key=repr)


def test_word_repeats_equal_brute_force(documents, texts):
    found = substring_dedup.find_repeats(documents, with_text=True)
    assert rows_of(found.select("doc_id", "n_words", "n_removed", "kept_sha256")) == brute_words(texts, 35)
    for r in found.select("text", "clean_text", "n_words", "n_removed").collect():
        assert len((r["clean_text"] or "").encode().split()) == r["n_words"] - r["n_removed"]


def test_removing_repeats_leaves_the_rest(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"Alpha  beta\n{passage}\tgamma"), (2, f"{passage} delta"), (3, passage), (4, "clean  text\nstays"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substring_dedup.remove_repeats(docs)) == [(1, "Alpha  beta\n\tgamma"), (2, " delta"), (4, "clean  text\nstays"), (5, None)]


def brute_copies(texts, words=5, percent=75):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for doc, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set())
    group = list(range(len(texts)))
    links = [0] * len(texts)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    places = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            places[g].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in places[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(root(i)) if sets[i] else doc, links[i]) for i, (doc, _) in enumerate(texts)), key=repr)


def test_near_copies_equal_brute_force(documents, texts):
    assert rows_of(jaccard_join.near_copies(documents)) == brute_copies(texts)


@pytest.mark.parametrize(("frequent", "block", "group"), [(2, 15, 1000), (200, 4000, 1000), (200, 4000, 9)])
def test_near_copies_with_frequent_passages(spark, monkeypatch, frequent, block, group):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=120)
    line = rng.choices(words, k=30)
    rows = []
    for i in range(80):
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy[: rng.randint(90, 120)])))
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.randint(3, 60)) + line)) for i in range(60)]
    rows += [(200 + i, " ".join(line[: rng.randint(20, 30)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(jaccard_join.near_copies(docs)) == brute_copies(rows)


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", 40 * 60)
    met = []
    plain = jaccard_join._pairs

    def watched(groups, percent):
        sizes = groups.groupBy("key", "x", "y").count().collect()
        met.append(max((r["count"] for r in sizes), default=0))
        return plain(groups, percent)

    monkeypatch.setattr(jaccard_join, "_pairs", watched)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    base, start = rng.choices(words, k=64), rng.choices(words, k=40)
    # Near copies of one text, and texts that are alike but mostly not linked.
    rows = [(i, " ".join([*base[: rng.randint(0, 3) + 58], f"own{i}"])) for i in range(300)]
    rows += [(1000 + i, " ".join(start + rng.choices(words[:40], k=rng.randint(10, 24)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(jaccard_join.near_copies(docs)) == brute_copies(rows)
    assert max(met) <= 120 and len(met) > 2  # two blocks, unevenly filled


@pytest.mark.parametrize("leaf", [8, 64, 200])
def test_trees_lose_no_pair(monkeypatch, leaf):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = []
    for _ in range(120):
        kept = base[rng.random(300) < rng.uniform(0.3, 1)]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    pairs = jaccard_join.candidate_pairs(sizes, [jaccard_join.bitmap(s) for s in sets], np.arange(len(sets)), 75, merging=False)
    found = {tuple(sorted(p)) for p in pairs}
    for i, j in itertools.combinations(range(len(sets)), 2):
        shared = len(np.intersect1d(sets[i], sets[j]))
        if 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
            assert (i, j) in found


@pytest.mark.parametrize("few", [0, 20, 1 << 16])
def test_long_chains_are_one_component(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (100, 101)]
    found = dict(rows_of(jaccard_join.components(spark.createDataFrame(chain, "a long, b long"))))
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert rows_of(jaccard_join.components(spark.createDataFrame([], "a long, b long"))) == []


def test_components_of_one_task():
    rng = np.random.default_rng(5)
    for n, links in ((1, 3), (40, 25), (400, 380), (3000, 2500)):
        a, b = (rng.choice(rng.integers(-(1 << 62), 1 << 62, n), links) for _ in range(2))
        b[: links // 2] = a[links // 2 : links // 2 * 2]
        parents = {x: x for x in (*a.tolist(), *b.tolist())}

        def root(x):
            while parents[x] != x:
                x = parents[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            parents[max(x, y)] = min(x, y)
        ends, least = jaccard_join._least_reached(a, b)
        assert dict(zip(ends.tolist(), least.tolist())) == {x: root(x) for x in parents}


def test_no_documents(nothing):
    assert rows_of(jaccard_join.near_copies(nothing)) == []
    assert rows_of(suffix_dedup.find_repeats(nothing)) == []
    assert rows_of(substring_dedup.find_repeats(nothing)) == []


def test_a_row_without_an_id_links_two_others(spark):
    rows = [(1, 0), (None, 10), (2, 20), (None, 10)]
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(s, s + 100))) for i, s in rows], "doc_id long, text string")
    assert rows_of(jaccard_join.near_copies(docs)) == brute_copies([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_links_are_counted_between_blocks_once(spark, monkeypatch):
    """A crowd of copies and near copies over several blocks, some under one id."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i % 7, " ".join([*base[: rng.randint(44, 60)], *[f"x{rng.randint(0, 9)}"] * rng.randint(0, 2)])) for i in range(40)] + [(50, "a b c"), (51, "a b c"), (52, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = rows_of(jaccard_join.near_copies(docs))
    assert found == brute_copies(rows)
    assert {r[3] for r in found if r[0] in (50, 51)} == {1} and max(r[3] for r in found) > 20


def test_linked_sets_are_met_at_the_first_shingle_they_share():
    rng = random.Random(23)
    links = ruled_out = 0
    for _ in range(300):
        base = rng.sample(range(200), rng.randint(4, 60))
        sets = [sorted(set(rng.sample(base, max(1, len(base) - rng.randint(0, 12))) + rng.sample(range(200), rng.randint(0, 12)))) for _ in range(6)]
        groups = defaultdict(list)
        for i, items in enumerate(sets):
            for at, item in enumerate(items[: jaccard_join.prefix_length(len(items), 75)]):
                groups[item].append((i, (len(items) << jaccard_join.PLACE_BITS) + at))
        kept = {}
        for item, members in groups.items():
            found = jaccard_join.meeting(np.array([m[1] for m in members]), np.arange(len(members)), 75)
            kept[item] = {m[0] for m, k in zip(members, found) if k}
            ruled_out += int((~found).sum()) if len(members) > 1 else 0
        for i, j in itertools.combinations(range(len(sets)), 2):
            shared = set(sets[i]) & set(sets[j])
            if 100 * len(shared) >= 75 * len(set(sets[i]) | set(sets[j])):
                links += 1
                assert {i, j} <= kept[min(shared)]
    assert links > 100 and ruled_out > 100


def test_chance_meetings_are_not_carried_with_their_bitmaps(spark, monkeypatch):
    """Texts that share one shingle, too late in each set for a link."""
    rng, rolling = random.Random(29), Rolling()
    passages = ("a common passage of words%d" % i for i in range(10_000))
    passage = next(p for p in passages if 0.18 < int(jaccard_join.shingles(p, 5, rolling)[0]) / 2**64 < 0.19)
    rows = [(i, " ".join([f"w{rng.random()}" for _ in range(rng.choice([300, 500, 900]))] + [passage])) for i in range(60)]
    rows += [(100 + i, t + f" end{i}") for i, t in rows[:10]]
    plain, carried = jaccard_join._group_pairs, []

    def watched(members, *rest):
        carried.append(members.count())
        return plain(members, *rest)

    monkeypatch.setattr(jaccard_join, "_group_pairs", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(jaccard_join.near_copies(docs)) == brute_copies(rows)
    shared = jaccard_join.shingles(passage, 5, rolling)[0]
    sets = [jaccard_join.shingles(t, 5, rolling) for _, t in rows]
    holders = sum(shared in s[: jaccard_join.prefix_length(len(s), 75)] for s in sets)
    assert len(carried) == 2 and holders > 60 and carried[1] < 20
