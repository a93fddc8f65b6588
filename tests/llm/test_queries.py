"""The registered queries on a small folder, learned operators against plain Python, the pipeline against a second one, clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_minhash import brute as brute_copies
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_texts import cut, words_of
from tests.llm.test_vectors import brute as brute_vectors
from tidemark.llm import quality, queries, toxicity
from tidemark.llm import text as tx
from tidemark.llm.lines import remove_boilerplate
from tidemark.llm.mixing import mix
from tidemark.llm.quality import with_quality
from tidemark.llm.tokens import read_ranks, with_token_counts
from tidemark.llm.toxicity import with_toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(31)
    pool = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    bad = ["zzidiot", "zzmoron", "zzscum"]
    texts = [list(rng.choice(pool, rng.integers(1, 140))) for _ in range(130)]
    for k in range(0, 130, 4):
        texts[k][:: max(1, len(texts[k]) // 6)] = [str(x) for x in rng.choice(bad, len(texts[k][:: max(1, len(texts[k]) // 6)]))]
    passage = list(rng.choice(pool, 50))
    lines = [" ".join(t) for t in texts] + [" ".join([*rng.choice(pool, 9), *passage, *rng.choice(pool, 4)]) for _ in range(8)]
    lines += [lines[5], lines[5] + " more", lines[7].upper(), None, "", "\n", "same " * 90] + [lines[9].replace(" ", "\n", 3)]
    rows = [(i, None if t is None else t + ("\nshared footer" if i % 3 == 0 else ""), ["en", "de"][i % 2], f"src{i % 13}") for i, t in enumerate(lines)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(0, 130)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    centres = rng.standard_normal((6, 12))
    vectors = [(k, [float(np.float32(x)) for x in centres[k % 6] + rng.standard_normal(12) * 0.06], k % 2, "x") for k in range(70)] + [(70, None, 1, "x"), (71, [0.0] * 12, 0, "x"), (72, [1.0] * 12, None, "x")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, other string").write.parquet(f"{path}/embeddings.parquet")
    return path, rows, vectors


def test_op1(spark, folder):
    out = queries.QUERIES["op1_minhash_dedup"](spark, folder[0]).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == brute_copies([r[:2] for r in folder[1]], 4)


def test_op2(spark, folder):
    out = queries.QUERIES["op2_embedding_dedup"](spark, folder[0]).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str) == brute_vectors(folder[2]) and all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert max(r.n_links for r in out) > 3


def test_op3(spark, folder):
    out = {r.doc_id: r for r in queries.QUERIES["op3_substring_dedup"](spark, folder[0]).collect()}
    for (i, t, *_), kept in zip(folder[1], cut([r[1] for r in folder[1]], 35), strict=True):
        n = len(words_of(t))
        assert (out[i].n_words, out[i].n_removed, out[i].kept_sha256) == (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    assert sum(r.n_removed for r in out.values()) > 400


def test_op6_and_op7(spark, folder):
    ranks = set(read_ranks(queries.VOCABULARY))

    def pieces(word):
        left, n = b" " + word.encode(), 0
        while left:
            k = next((k for k in range(len(left), 0, -1) if left[:k] in ranks), None)
            if k is None:
                return 1
            left, n = left[k:], n + 1
        return n

    counts = {r.doc_id: r.n_tokens for r in queries.QUERIES["op6_token_counts"](spark, folder[0]).collect()}
    assert counts == {i: sum(map(pieces, words_of(t))) for i, t, *_ in folder[1]}
    total = Counter()
    for r in queries.QUERIES["op7_packing"](spark, folder[0]).collect():
        total[r.doc_id] += r.n_tokens
    assert total == Counter(counts)


@pytest.mark.parametrize("name, modulus, rest, label", [("op5_toxicity", 5, 0, "toxic"), ("op9_quality_classifier", 3, 1, "quality")])
def test_scores(spark, folder, name, modulus, rest, label):
    out = queries.QUERIES[name](spark, folder[0])
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = {r.doc_id: r for r in out.collect()}
    truth = {i: int(i % 4 == 0) if label == "toxic" else int(i % 4 != 0) for i in range(130)}
    assert len(got) == len(folder[1]) and all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == rest) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i].score, y) for i, y in truth.items() if got[i].held_out]
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x > y]
    assert np.mean(pairs) > 0.8  # the share of pairs of a 1 and a 0 that the scores order rightly


def test_labels_of_the_held_out_rows_are_not_used(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder[0]}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in with_quality(docs, x, train_where=~out).collect()} for x in (labels, turned))
    assert a == b


def test_op10(spark, folder):
    out = {r.doc_id: r for r in queries.QUERIES["op10_quality_rules"](spark, folder[0]).collect()}
    assert set(out) == {r[0] for r in folder[1]} and not any(r.kept and r.base_failed for r in out.values()) and any(r.kept for r in out.values())


def test_quality_score_against_plain_python():
    rng = np.random.default_rng(32)
    odds = rng.standard_normal(2 * quality.SLOTS).astype(np.float32)
    texts = ["one two  two\tthree", "é ß\nx", "a", "", None, "word"]

    def slots(text):
        words = words_of(text)
        h = [int(tx.word_hashes(tx.split_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])))[0]) for w in words]
        out = [x % quality.SLOTS for x in h]
        out += [(1 if a == b else int(tx.mix(np.array([(a * 3 + b) % 2**64], np.uint64))[0])) % quality.SLOTS for a, b in zip(h, h[1:])]
        chars = re.sub(r"[\x20\x09-\x0D]", " ", text or "")
        for n in quality.GRAMS:
            for k in range(len(chars) - n + 1):
                if " " not in chars[k + 1 : k + n - 1]:
                    g = 0x811C9DC5 + n
                    for c in chars[k : k + n]:
                        g = (g ^ ord(c)) * 0x01000193 % 2**32
                    out.append(quality.SLOTS + (g ^ g >> 15) % quality.SLOTS)
        return out

    got = quality.QualityModel(odds, 0.3).score(pa.array(texts))
    want = [1 / (1 + math.exp(-((float(np.mean(odds[slots(t)], dtype=np.float64)) if slots(t) else 0.0) + 0.3))) for t in texts]
    assert np.allclose(got, want, atol=1e-6)


def test_quality_training_against_plain_python(monkeypatch):
    monkeypatch.setattr(quality, "SLOTS", 4)
    rows = [(1, np.array([0, 3], np.uint32), np.array([2, 1], np.uint8)), (0, np.array([1], np.uint32), np.array([1], np.uint8)), (1, np.array([], np.uint32), np.array([], np.uint8))]
    vectors, weights, bias = quality.train(rows, seed=1, rate=0.5)
    rng = np.random.default_rng(1)
    v, w, b, done = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (8, quality.DIM)), np.zeros((2, quality.DIM)), np.zeros(2), 0
    for _ in range(quality.EPOCHS):
        for k in rng.permutation(3):
            label, ids, counts = rows[k]
            share = [c / sum(int(x) for x in counts) for c in counts]
            mean = sum((s * v[i] for s, i in zip(share, ids)), np.zeros(quality.DIM))
            e = np.exp(w @ mean + b)
            error = e / e.sum() - np.eye(2)[label]
            step = 0.5 * (1 - done / (3 * quality.EPOCHS))
            back = w.T @ error
            w, b = w - step * np.outer(error, mean), b - step * 0.1 * error
            for s, i in zip(share, ids):
                v[i] = v[i] - step * s * back
            done += 1
    assert np.allclose(vectors, v, atol=1e-4) and np.allclose(weights, w, atol=1e-4) and np.allclose(bias, b, atol=1e-4)


def test_toxic_features_against_plain_python():
    texts = ["You are an IDIOT!! stupid, you?", "nothing here", "an id1ot 4 U", "", None, "étrange vous êtes IDIOTEN 77"]
    grams = lambda word: [m[k : k + toxicity.GRAM] for m in [f" {word} ".encode()] for k in range(max(1, len(m) - toxicity.GRAM + 1))]
    word = tx.split_words(np.frombuffer(b"idioten", np.uint8), np.array([0, 7]))
    learned = np.sort(toxicity.gram_hashes(word)[0][:1])
    assert len(toxicity.gram_hashes(word)[0]) == len(grams("idioten"))
    got = toxicity.TextFeatures(toxicity.LEXICON, learned)(pa.array(texts))
    strong, mild = set(toxicity.LEXICON["strong"]), set(toxicity.LEXICON["mild"])
    for row, text in zip(got, texts, strict=True):
        data = (text or "").encode()
        letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
        plain = bytes(c + 32 if 65 <= c <= 90 else c if letter(c) else 32 for c in data)
        words = [w.decode() for w in plain.split()]
        masked = [w.decode() for w in bytes(ord(toxicity.DISGUISES[chr(c)]) if chr(c) in toxicity.DISGUISES else p for c, p in zip(data, plain)).split()]
        n, size = max(1, len(words)), max(1, len(data))
        hits = [w in strong | mild for w in words]
        known = [b" idiot" in grams(w) for w in words]
        second = [w in toxicity.SECOND_PERSON for w in words]
        near = sum((hits[k] or known[k]) and any(second[max(0, k - toxicity.NEAR) : k + toxicity.NEAR + 1]) for k in range(len(words)))
        punct = [not letter(c) and c > 32 and not 48 <= c <= 57 for c in data]
        letters = max(1, sum(map(letter, data)))
        spans = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", plain)]
        shouted = sum(b - a > 1 and all(65 <= c <= 90 for c in data[a:b]) for a, b in spans)
        want = {
            "learned": sum(known) / n, "learned_hits": sum(known), "strong": sum(w in strong for w in words) / n, "mild": sum(w in mild - strong for w in words) / n, "strong_hits": sum(w in strong for w in words),
            "any_hits": sum(hits), "disguised": max(0, sum(w in strong | mild for w in masked) - sum(hits)) / n, "near_second_person": near, "second_person": sum(second) / n,
            "capital_letters": sum(65 <= c <= 90 for c in data) / letters, "capital_words": shouted / n, "exclamations": data.count(b"!") / size, "questions": data.count(b"?") / size,
            "other_punctuation": (sum(punct) - data.count(b"!") - data.count(b"?")) / size, "punctuation_runs": sum(a and b for a, b in zip(punct, punct[1:])) / size,
            "digits": sum(48 <= c <= 57 for c in data) / size, "log_words": math.log1p(len(words)), "mean_word": letters / n,
        }
        assert np.allclose(row, [want[f] for f in toxicity.FEATURES]), (text, dict(zip(toxicity.FEATURES, row)), want)


def test_calibrated_scores_rise_with_the_trees(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder[0]}/{t}.parquet") for t in ("documents", "labels"))
    fitted, learned = toxicity.fit(docs, labels, "doc_id", "text", "toxic", 1000, toxicity.LEXICON)
    b, p = (list(x) for x in (fitted.stages[1].boundaries, fitted.stages[1].predictions))
    assert p == sorted(p) and b == sorted(b) and all(0 <= x <= 1 for x in p)


CLASHES = ["left", "cut", "gone", "fulls", "_n", "_k0", "_id", "h", "at", "_drop", "_kept", "score", "score_", "values", "features", "raw", "domain_", "_ROW", "odd.name"]


@pytest.mark.parametrize("rows", [3, 0])
def test_columns_of_any_name_come_back(spark, rows):
    base = spark.createDataFrame([(1, "a b c\nfoot", "x"), (1, "a b c\nfoot", "x"), (None, None, None)][:rows], "doc_id long, text string, source string")
    frame = base.withColumns({c: F.lit(c) for c in CLASHES} | {"domain": F.lit("d"), "lang": F.lit("en"), "n_tokens": F.lit(3)})
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for out in (
        remove_boilerplate(frame, min_sites=1), mix(frame, {}, 1.0, 1), with_toxicity(frame, labels, score_col="mine"), with_quality(frame, labels, score_col="mine"), with_token_counts(frame, [b" a"]),
    ):
        got = out.collect()
        assert len(got) == rows and all(r[c] == c for r in got for c in CLASHES) and set(frame.columns) <= set(out.columns)


def test_pipeline_against_a_second_one(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    path, rows, _ = folder
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in with_quality(docs, labels).where("score >= 0.5").collect()}
    left = {i: (t, lang, source) for i, t, lang, source in rows if i in good}
    sites = defaultdict(set)
    for t, _, source in left.values():
        for line in (t or "").split("\n"):
            if line.strip():
                sites[line.strip()].add(source)
    left = {i: (None if t is None else "\n".join(x for x in t.split("\n") if len(sites[x.strip()]) < 10), lang, source) for i, (t, lang, source) in left.items()}
    left = {i: left[i] for i, _, _, kept in brute_copies([(i, v[0]) for i, v in sorted(left.items())], 5) if kept}
    domain = lambda s: queries.DOMAINS[int(re.search(r"(\d{1,9})$", s)[1]) % 4]
    taken = brute_mix([(i, domain(s), lang, s, len(words_of(t))) for i, (t, lang, s) in left.items()], queries.WEIGHTS, 0.9, 1, 1)
    texts = {i: left[i][0] for i, *_ in taken}
    counts = with_token_counts(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), read_ranks(queries.VOCABULARY))
    want = {r.doc_id: r.n_tokens for r in counts.collect()}
    got = Counter()
    for r in pipeline.run(spark, path).collect():
        got[r.doc_id] += r.n_tokens
    assert got == Counter(want) and len(want) > 40


def test_pipeline_of_odd_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars int, score string, domain string, _row string, n_lines string"
    rows = [(1, "a b c d e f", "en", "s1"), (1, "a b c d e f", "en", "s1"), (None, "x y z", None, None), (None, "x y z", "en", "s2"), (3, None, "en", "s1"), (4, "", "en", "")]
    frame = spark.createDataFrame([(*r, len(r[1] or ""), "own", "own", "own", "own") for r in rows], schema)
    labels = "doc_id long, quality int, toxic int"
    for docs in (frame, frame.limit(0)):
        folder = f"{tmp_path}/{docs.count()}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{folder}/labels.parquet")
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == frame.columns
            docs = spark.createDataFrame(out.collect(), frame.schema)
            assert all((r.score, r.domain, r._row, r.n_lines) == ("own",) * 4 for r in docs.collect()), name
        assert pipeline.run(spark, folder).count() == docs.count()
        assert docs.count() in (0, 3, 4)
