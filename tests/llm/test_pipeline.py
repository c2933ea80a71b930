import hashlib
import re
from collections import Counter

import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SMALL, rows_of
from tests.llm.test_dedup import brute_copies, removed_runs
from wikiloom.llm import langid
from wikiloom.llm.common import is_held_out

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(text, words, gone):
    """The text without each run of gone words and what lies between them."""
    kept, place, i = [], 0, 0
    while i < len(words):
        if gone[i]:
            kept.append(text[place : words[i].start()])
            while i + 1 < len(words) and gone[i + 1]:
                i += 1
            place = words[i].end()
        i += 1
    return "".join([*kept, text[place:]])


def plain_repeats(rows, window=35):
    words = [list(re.finditer(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    runs = [[tuple(m[0] for m in w[i : i + window]) for i in range(len(w) - window + 1)] for w in words]
    counted = Counter(run for found in runs for run in found)
    left = []
    for r, w, found in zip(rows, words, runs):
        gone = removed_runs([i for i, run in enumerate(found) if counted[run] > 1], window, len(w))
        if not (len(w) and gone.all()):
            left.append({**r, "text": without(r["text"], w, gone) if gone.any() else r["text"]})
    return left


def plain_decontamination(rows, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for text in items:
        w = re.findall(pattern, (text or "").translate(LOWER))
        windows |= {tuple(w[i : i + window]) for i in range(max(len(w) - window + 1, 1))} if w else set()
    left = []
    for r in rows:
        w = list(re.finditer(pattern, (r["text"] or "").translate(LOWER)))
        plain = [m[0] for m in w]
        gone = [False] * len(w)
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(plain[i : i + size]) in windows:
                    gone[i : i + size] = [True] * size
        if sum(gone) <= 0.5 * len(w):
            left.append({**r, "text": without(r["text"], w, gone) if any(gone) else r["text"]})
    return left


def test_pipeline_equals_plain_stages(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).drop("ids")

    # The model's decisions are held against held-out rows elsewhere.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.train(docs.filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))))
    judged = langid.identify(docs, model).collect()
    rows = [r.asDict() for r in judged if r["lang_pred"] != "und" and r["score"] >= 0.5]
    assert 0.9 * len(judged) <= len(rows) < len(judged)

    # Rows are told by their place: each is an id of its own for the brute force.
    groups = {place: component for place, _, component, _ in brute_copies([(i, r["text"]) for i, r in enumerate(rows)])}
    first: dict[int, tuple] = {}
    for place, r in enumerate(rows):
        order = (r["doc_id"] is None, r["doc_id"] or 0, place)
        if (r["text"] or "").split() and (groups[place] not in first or order < first[groups[place]]):
            first[groups[place]] = order
    copies = {place for place, r in enumerate(rows) if (r["text"] or "").split() and first[groups[place]][2] != place}
    assert copies
    rows = [r for place, r in enumerate(rows) if place not in copies]
    longer = sum(len(r["text"] or "") for r in rows)
    rows = plain_repeats(rows)
    assert sum(len(r["text"] or "") for r in rows) < longer
    rows = plain_decontamination(rows, [r["text"] for r in items.collect()])

    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encoded(r):
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded)]
        return r["doc_id"], r["lang"], r["source"], len(ids), *hashes

    names = ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows_of(found.select(names)) == sorted(map(encoded, rows), key=repr)


def test_pipeline_of_no_documents(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_row_of_each_group_of_near_copies_stays(spark):
    """Also where rows repeat an id or have none, so that the next stage does not take their text for a repeat."""
    words = [f"word{i}" for i in range(60)]
    story, other, third = (" ".join(f"{head}{w}" for w in words) for head in ("a", "b", "c"))
    rows = [
        (1, story), (1, story), (2, story + " end"), (3, other), (None, other), (None, third), (None, third), (None, third + " end"),
        (4, "alone with some words here"), (4, "not the same words at all"), (5, " "), (5, " "), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, "").select("doc_id", "text").collect()]
    nameless = [t for i, t in kept if i is None and t]
    assert len(nameless) == 1 and nameless[0].startswith(third)
    expected = [(1, story), (3, other), rows[8], rows[9], (5, " "), (5, " "), (None, None)]
    assert sorted((k for k in kept if k[0] or not k[1]), key=repr) == sorted(expected, key=repr)
    cleaned = corpus_pipeline.repeated_passages(spark, spark.createDataFrame([(i, t, "en", None, 0) for i, t in kept], docs.schema), "")
    assert sorted((tuple(r) for r in cleaned.select("doc_id", "text").collect()), key=repr) == sorted(kept, key=repr)


def test_a_clean_row_stays_whatever_else_has_its_id(spark):
    story, other, third = (" ".join(f"{head}{i}" for i in range(60)) for head in ("a", "b", "c"))
    rows = [(1, story), (2, story + " end"), (2, other), (3, third)]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert kept == [(1, story), (2, other), (3, third)]
