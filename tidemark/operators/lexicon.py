"""Weighted lexicons against texts: two-axis scores, vetoes, verdicts, tags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.matching import Trie, in_blocks, names_by_text, sums_by_text
from tidemark.functions.money import rounded
from tidemark.functions.text import haystack
from tidemark.operators.storage import spread

#: What a term in the title counts, how often one in the body counts at most, and the verdict's thresholds.
TITLE_TIMES, BODY_CAP = 2.5, 3
PUBLISH, REVIEW, LEAST_DOMAIN, LEAST_DISCIPLINE = 14.0, 8.0, 1.5, 3.0


def needle(term: str) -> str:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in term.lower()).split()
    return " " + " ".join(words) + " "


#: Bytes of bodies that are matched at a time inside a task.
BLOCK_BYTES = 1 << 20


def scored(axes: list[dict[str, float]], title: Column, body: Column) -> list[tuple[Column, Column]]:
    """Score and terms hit for each axis, from padded texts (text.haystack): 2.5 times the weight for the title, once for each of up to three places in the body.

    All terms of all axes are found in one pass over a text, by a trie over words in Arrow batches, so a long lexicon costs
    little more than a short one.  Places of a term count if they share no word and no space with the one counted before.
    """
    names = [list(terms) for terms in axes]
    weights = [np.array(list(terms.values()), dtype=np.float64) for terms in axes]
    trie = Trie(tuple(tuple(needle(t).split()) for terms in axes for t in terms))
    ends = np.cumsum([0, *map(len, axes)])

    def matched(titles: pa.Array, bodies: pa.Array) -> pa.Array:
        n, out = len(bodies), []
        in_title, in_body = trie.counted(titles, 1), trie.counted(bodies, BODY_CAP)
        text, term, count = (np.concatenate(x) for x in zip(in_title, in_body, strict=True))
        times = np.concatenate([in_title[2] * TITLE_TIMES, in_body[2].astype(np.float64)])
        place = np.repeat([0, 1], [len(in_title[0]), len(in_body[0])])
        order = np.lexsort((place, term, text))
        text, term, times = text[order], term[order], times[order]
        for k in range(len(axes)):
            own = (term >= ends[k]) & (term < ends[k + 1])
            rows, terms = text[own], term[own] - ends[k]
            once = np.append(True, (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])) if len(rows) else own[own]
            out += [pa.array(sums_by_text(n, rows, times[own] * weights[k][terms])), names_by_text(n, rows[once], terms[once], names[k])]
        return pa.StructArray.from_arrays(out, names=[f"{x}{k}" for k in range(len(axes)) for x in ("s", "h")])

    def work(titles: pa.Array, bodies: pa.Array) -> pa.Array:
        return in_blocks(titles, bodies, BLOCK_BYTES, matched)

    kind = ", ".join(f"s{k}: double, h{k}: array<string>" for k in range(len(axes)))
    found = F.arrow_udf(work, f"struct<{kind}>")(title, body)
    return [(found[f"s{k}"], found[f"h{k}"]) for k in range(len(axes))]


def axis(terms: dict[str, float], title: Column, body: Column) -> tuple[Column, Column]:
    """Score and terms hit of one axis, see scored."""
    return scored([terms], title, body)[0]


def classify(df: DataFrame, title: str, body: str, employer: str, domain: dict[str, float], discipline: dict[str, float], exclusions: list[str]) -> DataFrame:
    """df with domain_score, discipline_score, score, domain_hits, discipline_hits, excluded_by, verdict.

    An exclusion in title or body rejects with score 0.  Else both axes must reach their floors and
    the sum decides: publish, review or reject.
    """
    out = spread(df).withColumn("_t", haystack(title)).withColumn("_b", haystack(body, employer))
    found = scored([dict.fromkeys(exclusions, 0.0), domain, discipline], F.col("_t"), F.col("_b"))
    out = out.withColumn("excluded_by", found[0][1])
    clear = F.size("excluded_by") == 0
    none = F.array().cast("array<string>")
    for name, (score, hits) in zip(("domain", "discipline"), found[1:], strict=True):
        out = out.withColumn(f"{name}_score", F.when(clear, score).otherwise(F.lit(0.0))).withColumn(f"{name}_hits", F.when(clear, hits).otherwise(none))
    out = out.withColumn("score", F.col("domain_score") + F.col("discipline_score"))
    floors = (F.col("domain_score") >= LEAST_DOMAIN) & (F.col("discipline_score") >= LEAST_DISCIPLINE)
    verdict = F.when(~clear | ~floors, "reject").when(F.col("score") >= PUBLISH, "publish").when(F.col("score") >= REVIEW, "review").otherwise("reject")
    return out.withColumn("verdict", verdict).drop("_t", "_b")


def derive_tags(hits: Column, tag_sets: dict[str, list[str]], remote: Column | None = None) -> Column:
    """Sorted tags whose set shares a term with the hits, and `remote`."""
    tags = [F.when(F.arrays_overlap(hits, F.array(*map(F.lit, terms))), F.lit(tag)) for tag, terms in tag_sets.items()]
    if remote is not None:
        tags.append(F.when(remote, F.lit("remote")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tags))))


def once_axis(terms: dict[str, float], families: list[set[str]], found: Column) -> tuple[Column, Column]:
    """Score and hits of the terms found, where each counts once, one inside a longer hit not at all, and of a family only the heaviest."""
    family = {t: "|".join(sorted(f)) for f in families for t in f}
    entries = F.array(*(
        F.struct(F.lit(t).alias("term"), F.lit(needle(t)).alias("needle"), F.lit(float(w)).alias("weight"), F.lit(family.get(t, t)).alias("family")) for t, w in terms.items()
    ))
    at = F.create_map(*(x for k, t in enumerate(terms) for x in (F.lit(t), F.lit(k)))) if terms else None
    matched = F.transform(found, lambda t: F.get(entries, at[t])) if terms else entries
    top = F.filter(matched, lambda e: ~F.exists(matched, lambda o: F.contains(o["needle"], e["needle"]) & (o["needle"] != e["needle"])))
    names = F.array_distinct(F.transform(top, lambda e: e["family"]))
    best = F.transform(names, lambda f: F.array_max(F.transform(F.filter(top, lambda e: e["family"] == f), lambda e: e["weight"])))
    return F.aggregate(best, F.lit(0.0), lambda a, w: a + w), F.transform(top, lambda e: e["term"])


def score_awards(df: DataFrame, text: str, program: dict[str, float], discipline: dict[str, float], context: dict[str, float], families: list[set[str]], cap: float = 1.5) -> DataFrame:
    """df with award_score: 0 unless a program or discipline term is named; context adds at most `cap`."""
    axes, names = (program, discipline, context), ("_p", "_q", "_c")
    df = df.withColumn("_hay", haystack(text))
    # Columns of their own: a text is folded and walked once.
    for name, (_, hits) in zip(names, scored(list(axes), F.lit(" "), F.col("_hay")), strict=True):
        df = df.withColumn(name, hits)
    (p, p_hits), (d, d_hits), (c, _) = (once_axis(terms, families, F.col(name)) for terms, name in zip(axes, names, strict=True))
    named = (F.size(p_hits) > 0) | (F.size(d_hits) > 0)
    return df.withColumn("award_score", F.when(named, rounded(p + d + F.least(c, F.lit(cap)), 2)).otherwise(F.lit(0.0))).drop("_hay", *names)
