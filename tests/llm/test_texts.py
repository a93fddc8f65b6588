"""Line and substring removal, quality and toxicity, against brute force, odd rows and held-out accuracy."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.lines import remove_boilerplate
from tidemark.llm.quality import with_quality
from tidemark.llm.substring import remove_repeats
from tidemark.llm.toxicity import with_toxicity


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def cut(texts, n):
    where = defaultdict(list)
    for i, t in enumerate(texts):
        w = words_of(t)
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].append((i, k))
    covered = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for i, k in places:
                covered[i] |= set(range(k, k + n))
    return [[x for k, x in enumerate(words_of(t)) if k not in covered[i]] for i, t in enumerate(texts)]


@pytest.mark.parametrize("n", [4, 9])
def test_substrings_match_brute_force(spark, n):
    rng = np.random.default_rng(21)
    pool = ["".join(rng.choice(list("abcdé"), 3)) for _ in range(60)]
    passage = list(rng.choice(pool, 14))
    texts = [" ".join(rng.choice(pool, rng.integers(0, 70))) for _ in range(60)]
    texts += [" ".join([*rng.choice(pool, 5), *passage, *rng.choice(pool, 3)]) for _ in range(20)]
    texts += [texts[1]] * 5 + [None, "", " \n", "one two", "x " * 40, "  ".join(passage), "\t".join(passage[:-1]), "w" * 90_000 + " y"]
    rows = [(i if i % 30 else None, t, "x", "y") for i, t in enumerate(texts)]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_words string, spans string"), window=n).collect()
    want = Counter((r[0], len(words_of(r[1])), " ".join(kept)) for r, kept in zip(rows, cut(texts, n)))
    assert Counter((r.doc_id, r.n_words, r.kept_text) for r in out) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)


def test_substrings_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_match_brute_force(spark):
    rng = np.random.default_rng(22)
    lines = [f"line {k}" for k in range(40)]
    rows = [(i, "\n".join(str(x) for x in rng.choice(lines, 6)), f"s{rng.integers(0, 25)}", 1, "z") for i in range(300)]
    rows += [(900 + i, f"common line\n own {i}\n\n  common line \t", f"t{i}", 1, "z") for i in range(12)]
    rows += [(950, None, "a", 1, "z"), (951, "", "b", 1, "z"), (952, "common line", None, 1, "z"), (None, "common line\nx", "q", 1, "z"), (953, "only here\n" * 30, "c", 1, "z")]
    sites = defaultdict(set)
    for _, t, s, *_ in rows:
        for x in (t or "").split("\n"):
            if s is not None and x.strip(" \t\n\x0b\x0c\r"):
                sites[x.strip(" \t\n\x0b\x0c\r")].add(s)
    want = []
    for i, t, s, *_ in rows:
        split = [] if t is None else t.split("\n")
        kept = [x for x in split if len(sites[x.strip(" \t\n\x0b\x0c\r")]) < 10]
        want.append((i, None if t is None else "\n".join(kept), len(split), len(split) - len(kept)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int, line_hash string")
    out = remove_boilerplate(frame, min_sites=10)
    assert out.columns == ["doc_id", "text", "source", "line_hash", "n_lines", "n_removed"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()) == Counter(want)
    assert remove_boilerplate(frame.limit(0)).count() == 0


def labelled(rng, n, mark):
    plain = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        label = int(rng.random() < 0.4)
        w = list(rng.choice(plain, rng.integers(20, 80)))
        for _ in range(8 if label else 0):
            w[rng.integers(0, len(w))] = mark + str(rng.choice(plain))
        rows.append((i, " ".join(w)))
        labels.append((i, label))
    return rows, labels


@pytest.mark.parametrize("scored, column", [(with_quality, "quality"), (with_toxicity, "toxic")])
def test_held_out_accuracy_and_odd_rows(spark, scored, column):
    rows, labels = labelled(np.random.default_rng(23), 900, "zxq")
    odd = [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "zxqab " * 20_000), (2004, "zxqab"), (None, "a b c")]
    docs = spark.createDataFrame([(*r, 7.0, "f") for r in rows + odd], "doc_id long, text string, score double, features string")
    known = spark.createDataFrame([(*x, 1) for x in labels] + [(5000, 1, 1), (None, 1, 1), (3, None, 1)], f"doc_id long, {column} int, score int")
    out = scored(docs, known, train_where=F.col("doc_id") % 3 != 1)
    assert sorted(out.columns) == ["doc_id", "features", "score", "text"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [(r.score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id in truth and r.doc_id % 3 == 1]
    assert np.mean(held) > 0.9
    assert scored(docs.limit(0), known).count() == 0
    none = scored(docs, known.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}


def test_pipeline_against_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(24)
    pool = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(pool, 60)) + "\nshared footer line", "en", f"src{i % 14}") for i in range(120)]
    rows += [(500 + i, rows[i][1], "en", "src3") for i in range(10)]
    folder = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = dict(pipeline.STAGES)["quality_classifier"](spark, docs, folder)
    assert kept.count() == 130  # one label alone can reject nothing
    lines = dict(pipeline.STAGES)["line_dedup"](spark, kept, folder)
    assert lines.columns == docs.columns and {r.text for r in lines.collect()} == {t.split("\n")[0] for _, t, *_ in rows}
    single = dict(pipeline.STAGES)["minhash_dedup"](spark, lines, folder)
    assert sorted(r.doc_id for r in single.collect()) == list(range(120))
    mixed = dict(pipeline.STAGES)["mixing"](spark, single, folder)
    taken = [r.doc_id for r in mixed.collect()]
    assert len(taken) == len(set(taken)) and 60 <= len(taken) <= 120
    packed = pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(taken)
    assert len({hashlib.md5(str(r).encode()).hexdigest() for r in packed}) == len(packed)


def test_pipeline_keeps_one_row_of_repeated_and_null_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, a), (7, a), (None, b), (None, b), (None, c), (4, c), (4, c + " end"), (5, None), (None, "")]
    out = dict(pipeline.STAGES)["minhash_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert out.columns == ["doc_id", "text"]
    kept = Counter((r.doc_id, r.text if r.doc_id != 4 else "c") for r in out.collect())
    assert kept == Counter([(1, a), (None, b), (4, "c"), (5, None), (None, "")])
