import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SMALL, rows_of
from wikiloom.llm import bpe_trie, decontaminate, fingerprints, langid, token_counts
from wikiloom.llm.common import Rolling, is_held_out

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WILD = [
    "", " ", "  ", "a  b\nc", " lead", "trail ", "trail  ", "\n", "\t x", "▁", "▁▁a ▁", "</s> <unk> <s>", "日本語 テキスト", "é\u0301 🙂🙂", "x" * 3000,
    "ab" * 700, "don't I'll we've", "1234 5,678.90", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "\x00\x01", "   \n\n  z", "ﬁ ﬀ ½",
]


def wild_texts():
    rng = random.Random(1)
    parts = ["the", " ", "  ", "ing", "tion", "\n", "é", "ß", "▁", "<", "|", "日", "1", ",", "'s", "A", "_", "\t"]
    return WILD + ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(400)]


def test_piece_counts_equal_the_library(texts):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    every = wild_texts() + [t or "" for _, t in texts]
    assert token_counts.PieceCounter(PIECES, remembered=50).count(every) == [len(x) for x in processor.encode(every, num_threads=1)]


def test_token_counts(documents, texts, nothing):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = [(d, len((t or "").encode()), n, n > 4096) for d, t in texts for n in [len(processor.encode(t or ""))]]
    assert rows_of(token_counts.count_tokens(documents, PIECES)) == sorted(expected, key=repr)
    assert rows_of(token_counts.count_tokens(nothing, PIECES)) == []


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_trie_encoding_equals_the_library(texts):
    every = wild_texts() + [t or "" for _, t in texts]
    tokenizer, expected = library_ids(every)
    encoder = bpe_trie.TrieEncoder(BYTES, public_tokenizers.PATTERN, remembered=500)
    for at in range(0, len(every), 100):
        for text, ids, words in zip(every[at : at + 100], expected[at : at + 100], encoder.encode(every[at : at + 100])):
            assert ",".join(w[0] for w in words) == ",".join(map(str, ids)), text
            assert sum(w[1] for w in words) == len(ids)
            assert b"".join(w[2] for w in words).decode() == tokenizer.decode(ids, skip_special_tokens=False) == text


def test_encoded_documents(documents, texts, nothing):
    tokenizer, ids = library_ids([t or "" for _, t in texts])
    expected = []
    for (doc, _), i in zip(texts, ids):
        decoded = tokenizer.decode(i, skip_special_tokens=False)
        expected.append((doc, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert rows_of(bpe_trie.encode_documents(documents, BYTES, public_tokenizers.PATTERN)) == sorted(expected, key=repr)
    kept = bpe_trie.encode_documents(documents, BYTES, public_tokenizers.PATTERN, keep=("lang",), with_ids=True)
    assert sorted(map(list, (r["ids"] for r in kept.select("ids").collect()))) == sorted(ids)
    assert rows_of(bpe_trie.encode_documents(nothing, BYTES, public_tokenizers.PATTERN)) == []


def brute_winnow(text, k, window):
    rolling = Rolling()
    codes = np.array([ord(c) for c in text], dtype=np.uint32)
    if not len(codes):
        return []
    hashes = [int(h) >> 32 for h in rolling.grams(codes, min(k, len(codes)))]
    window = min(window, len(hashes))
    kept = []
    for i in range(len(hashes) - window + 1):
        least = min(hashes[i : i + window])
        place = max(j for j in range(i, i + window) if hashes[j] == least)
        if not kept or kept[-1] != (least, place):
            kept.append((least, place))
    return kept


def test_winnowing_by_definition():
    rng = random.Random(2)
    for text in ["", "a", "abc" * 40, "z" * 99, *["".join(rng.choices("abé🙂 ", k=rng.randint(0, 200))) for _ in range(60)]]:
        hashes, places = fingerprints.winnow(text, Rolling(), 5, 8)
        assert list(zip(hashes.tolist(), places.tolist())) == brute_winnow(text, 5, 8)


def test_shared_runs_share_a_hash():
    rng = random.Random(3)
    shared = "".join(rng.choices("abcdefgh ", k=fingerprints.K + fingerprints.WINDOW - 1))
    a, b = ("".join(rng.choices("xyz", k=90)) + shared + "".join(rng.choices("uvw", k=70)) for _ in range(2))
    assert set(fingerprints.winnow(a, Rolling())[0]) & set(fingerprints.winnow(b, Rolling())[0])


def test_edited_copies(documents, texts, nothing):
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = []
    rolling = Rolling()
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        marks = [fingerprints.winnow(x, rolling) for x in (text, edited, following)]
        expected.append((
            doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.as_text(*marks[0]), fingerprints.as_text(*marks[1]),
            fingerprints.likeness(marks[0][0], marks[1][0]), fingerprints.likeness(marks[0][0], marks[2][0]),
        ))
    assert rows_of(fingerprints.edited_fingerprints(documents)) == sorted(expected, key=repr)
    plain = {(r["doc_id"], r["text"]): r["fingerprint"] for r in fingerprints.fingerprint(documents).collect()}
    assert sorted(plain.values()) == sorted(set_of[3] for set_of in {(e[0], e[1], e[2], e[3]) for e in expected}) or len(plain) < len(expected)
    assert rows_of(fingerprints.edited_fingerprints(nothing)) == []


def test_one_document_follows_itself(spark):
    (row,) = fingerprints.edited_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert row["near_next"] == 1.0


def brute_hits(texts, items, window=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = []
    for item, text in items:
        w = cut(text)
        name = "null" if item is None else str(item)
        windows += [(name, w[i : i + window]) for i in range(max(len(w) - window + 1, 1))] if w else []
    found = []
    for doc, text in texts:
        w = cut(text)
        gone, names = set(), set()
        joined = f" {' '.join(w)} "
        for name, run in windows:
            if f" {' '.join(run)} " in joined:
                for i in range(len(w) - len(run) + 1):
                    if w[i : i + len(run)] == run:
                        gone |= set(range(i, i + len(run)))
                        names.add(name)
        found.append((doc, len(w), len(gone), sorted(names)))
    return sorted(found, key=repr)


@pytest.mark.parametrize("words", [50, 50_000])
def test_contamination_equals_brute_force(spark, documents, texts, words):
    given = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    some = (texts[3][1] or "").split()
    items = [*given, (1000, "one two"), (1001, "text here"), (1001, "other"), (1002, None), (1003, "!!"), (None, "x"), (1004, " ".join(some[2:30])), (1005, "aaaa " * 12)]
    items += [(1006, "aaaa aaaa"), (1007, " ".join(some[5:14])), (1008, "word5 und5 word6 und6")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(documents, table, automaton_words=words, with_text=True)
    assert rows_of(found.select("doc_id", "n_words", "n_hit", "hit_items")) == brute_hits(texts, items)
    for r in found.select("clean_text", "n_words", "n_hit").collect():
        assert len(decontaminate.words_of(r["clean_text"])) == r["n_words"] - r["n_hit"]


def test_removing_contamination(spark):
    item = "the quick brown fox jumps over one lazy old dog"
    rows = [(1, f"Before. {item.upper()}, after it come many more words that stay in place."), (2, item), (3, "clean!  text"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert rows_of(decontaminate.remove_contamination(docs, items)) == [(1, "Before. , after it come many more words that stay in place."), (3, "clean!  text"), (4, None)]
    assert rows_of(decontaminate.remove_contamination(docs, items.limit(0))) == sorted(rows, key=repr)


def test_languages_of_held_out_documents(spark, documents, nothing):
    docs = documents.withColumn("held_out", is_held_out(F.col("doc_id")))
    model = langid.train(docs.filter("NOT held_out AND doc_id < 900"))
    found = langid.identify(docs, model).select("doc_id", "text", "lang", "held_out", "lang_pred", "score").collect()
    judged = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(r["lang"] == r["lang_pred"] for r in judged) >= 0.97 * len(judged)
    for r in found:
        letters = bool(r["text"]) and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0 <= r["score"] <= 1
    assert (np.abs(model.weights) == 0).mean() > 0.3
    assert langid.train(nothing) is None
    assert {r["lang_pred"] for r in langid.identify(documents, None).collect()} == {"und"}
    assert rows_of(langid.identify(nothing, model)) == []


def test_long_texts_are_counted_whole(monkeypatch):
    text = "abcdé " * 500
    whole = langid.term_counts(text, langid.Settings())
    monkeypatch.setattr(langid, "_CHUNK", 64)
    cut = langid.term_counts(text, langid.Settings())
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert math.isclose(whole[1].sum(), 3 * len(text) - 3)


def test_the_sample_is_bounded_whatever_is_copied(spark):
    """A frequent text is drawn once, so it can neither fill the sample nor go beyond its bound."""
    settings = langid.Settings(sample=200)
    rows = [("en", "the same words over and over")] * 3000 + [("en", f"some words number {i}") for i in range(400)]
    rows += [("de", f"einige Wörter Nummer {i}") for i in range(400)]
    table = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    drawn, original = [], langid._follow_the_leader

    def counted(learnt, labels, s):
        drawn.append(len(learnt))
        return original(learnt, labels, s)

    langid._follow_the_leader = counted
    try:
        model = langid.train(table, settings=settings)
    finally:
        langid._follow_the_leader = original
    assert 60 <= drawn[0] <= 200
    assert langid.predict("einige Wörter", model)[0] == "de" and langid.predict("the same words", model)[0] == "en"


def test_leader_updates_by_definition():
    """Each weight is the least of the regularised sum of all gradients so far, found here by search."""
    s = langid.Settings(bits=2, epochs=1, alpha=0.5, beta=1.0, l1=0.05, l2=0.1)
    rng = np.random.default_rng(4)
    rows = [(np.array(p), rng.random(len(p)) + 0.2, label) for p, label in (([0, 1], 0), ([1, 2], 1), ([0, 3], 2), ([2], 1), ([0, 1, 2], 0))]
    found, bias = langid._follow_the_leader(rows, 3, s)
    size, labels = 5, 3
    gradients, points = np.zeros((0, size, labels)), []

    def least(i, k):
        """argmin over w of sum(g) w + sum(sigma (w - w_t)^2) / 2 + beta w^2 / (2 alpha) + l1 |w| + l2 w^2 / 2."""
        g = gradients[:, i, k]
        squares = np.cumsum(g**2)
        sigma = np.diff(np.sqrt(np.concatenate([[0], squares]))) / s.alpha
        past = np.array([w[i, k] for w in points])

        def cost(w):
            own = (sigma * (w - past) ** 2).sum() / 2 if len(g) else 0.0
            return g.sum() * w + own + s.beta / s.alpha * w * w / 2 + s.l1 * abs(w) + s.l2 * w * w / 2

        low, high = -10.0, 10.0
        for _ in range(200):
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, b) if cost(a) < cost(b) else (a, high)
        return (low + high) / 2

    for places, values, label in rows:
        w = np.array([[least(i, k) for k in range(labels)] for i in range(size)])
        x = np.zeros(size)
        x[places], x[-1] = values, 1.0
        scores = x @ w
        p = np.exp(scores) / np.exp(scores).sum()
        p[label] -= 1
        points.append(w)
        gradients = np.concatenate([gradients, (x[:, None] * p)[None]])
    w = np.array([[least(i, k) for k in range(labels)] for i in range(size)])
    assert np.abs(w[:-1] - found).max() < 1e-6 and np.abs(w[-1] - bias).max() < 1e-6
    assert (found == 0).any() and (found != 0).any()


def test_temperature_by_search():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(200, 3)) * 5
    labels = np.where(rng.random(200) < 0.7, logits.argmax(axis=1), rng.integers(0, 3, 200))

    def loss(t):
        e = np.exp(logits / t - (logits / t).max(axis=1, keepdims=True))
        return -np.log((e / e.sum(axis=1, keepdims=True))[np.arange(200), labels]).mean()

    found = langid._temperature(logits, labels)
    assert loss(found) <= min(loss(t) for t in np.linspace(0.05, 9.9, 400)) + 2e-3
    assert langid._temperature(np.zeros((0, 3)), np.zeros(0, dtype=int)) == 1.0
