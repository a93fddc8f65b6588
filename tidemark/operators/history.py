"""Identity, seen state, revisions and upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.graph import connected_components
from tidemark.operators.ranks import numbered
from tidemark.operators.storage import small_or_not, stored


def latest(df: DataFrame, key: str, when: str, seq: str) -> DataFrame:
    """The newest row of each key: latest time, then latest in sequence; undated rows lose."""
    names = df.columns
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*names), F.struct(F.col(when), F.col(seq))).alias("_r")).select("_r.*")


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key (null keys are one) that comes first in order."""
    return df.groupBy(*(F.col(k).alias(f"_first_{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def revisions(df: DataFrame, key: str, seq: str, content: str) -> DataFrame:
    """Rows whose content differs from the row before of the same key: A, A, B, A gives three."""
    before = F.lag(content).over(Window.partitionBy(key).orderBy(seq))
    first = F.row_number().over(Window.partitionBy(key).orderBy(seq)) == 1
    return df.withColumn("_before", before).withColumn("_first", first).where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(content))).drop("_before", "_first")


def append_revisions(new: DataFrame, archive: DataFrame, key: str, seq: str, content: str) -> DataFrame:
    """Rows of `new` to add to the archive: consecutive changes, the first against the archive's last content."""
    last = archive.groupBy(key).agg(F.max_by(content, seq).alias("_last"))
    first = new.groupBy(key).agg(F.min(seq).alias("_seq"))
    same = new.join(first, key).where(F.col(seq) == F.col("_seq")).join(last, key).where(F.col(content).eqNullSafe(F.col("_last"))).select(key, seq)
    return revisions(new, key, seq, content).join(same, [key, seq], "left_anti")


#: Rows that one task walks in order, and so many such blocks one after the other before components are looked for.
BLOCK_ROWS, FEW_BLOCKS = 200_000, 8
#: So few open rows (a micro-batch, what rounds leave over) aren't worth another round.
FEW_ROWS = 10_000


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, s, i, f) sorted by group and order: the rows whose two keys no row of their group taken before has."""
    used_i, used_f, last = set(), set(), None
    for batch in batches:
        taken = []
        for k, (c, i, f) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("c", "i", "f")), strict=True)):
            if c != last:
                used_i, used_f, last = set(), set(), c
            if i not in used_i and f not in used_f:
                used_i.add(i)
                used_f.add(f)
                taken.append(k)
        yield batch.take(pa.array(taken, pa.int64()))


def _walked(rows: DataFrame) -> DataFrame:
    """The rows that the walk takes of each group c, a group a task's run of rows."""
    return rows.select("c", "s", "i", "f").sortWithinPartitions("c", "s").mapInArrow(_greedy, rows.select("c", "s", "i", "f").schema)


def _by_blocks(left: DataFrame, block_rows: int) -> DataFrame:
    """The s of the rows taken of `left` (s, i, f): blocks of its order one after the other, each a task's walk.

    What a block takes goes on only by the keys that a later block has.
    """
    if left.count() <= block_rows:
        return _walked(left.withColumn("c", F.lit(0)).repartition(1)).select("s")
    blocks = numbered(left.withColumn("part", F.lit(0)), "part", ["s"]).withColumn("c", F.floor(F.col("pos") / block_rows)).select("c", "s", "i", "f")
    blocks = stored(blocks, "blocks")
    for key in ("i", "f"):
        spans = blocks.groupBy(key).agg(F.min("c").alias(f"{key}_from"), F.max("c").alias(f"{key}_to"))
        blocks = stored(blocks.join(spans, key), "blocks")
    several = F.col("i_from") < F.col("i_to"), F.col("f_from") < F.col("f_to")
    taken, known = None, {}
    for k in range(blocks.agg(F.max("c")).first()[0] + 1):
        rows = blocks.where(F.col("c") == k)
        for key, used in known.items():
            rows = rows.join(used.where(F.col("to") >= k).select(key).distinct(), key, "left_anti")
        took = stored(_walked(rows.repartition(1)).select("s", "i", "f"), "took")
        ends = took.join(blocks.where((F.col("c") == k) & (several[0] | several[1])).select("s", "i_to", "f_to"), "s")
        for key in ("i", "f"):
            used = ends.where(F.col(f"{key}_to") > k).select(key, F.col(f"{key}_to").alias("to"))
            known[key] = stored(used if key not in known else known[key].where(F.col("to") > k).unionByName(used), "used")
        taken = took.select("s") if taken is None else taken.unionByName(took.select("s"))
    return taken


def _node(kind: int, key: str):
    return F.xxhash64(F.lit(kind), key)


def _by_components(left: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The s of the rows taken of components of `left` (s, i, f) of at most block_rows rows, each walked by itself, and the rows of all others.

    Rows are edges between their two keys.  Keys go by 64-bit hashes: one clash makes two components one, which is walked as rightly.
    """
    edges = left.select(_node(0, "i").alias("u"), _node(1, "f").alias("v"))
    parts = connected_components(edges).withColumnRenamed("component", "c")
    rows = stored(left.join(parts, _node(0, "i") == F.col("node")).select("c", "s", "i", "f"), "parts")
    large = stored(rows.groupBy("c").count().where(F.col("count") > block_rows).select("c"), "large")
    taken = _walked(rows.join(small_or_not(large), "c", "left_anti").repartition("c"))
    return taken.select("s"), rows.join(small_or_not(large), "c", "left_semi").select("s", "i", "f")


def filter_new(
    new: DataFrame, seen: DataFrame, identity: str = "identity", fingerprint: str = "fingerprint", seq: str = "seq", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows of `new` that are in neither key known, taken greedily by seq: a row goes only if a row taken before shares a key.

    Two anti-joins against the seen state.  Then rounds over all rows at once: an open row that is first in both of its
    groups is taken, open rows that share a key with one taken are dropped.  Rounds go on while each settles a tenth of the open
    rows and more than a few are left.  What is left are chains, in which each row waits for the one before.  Chains fall into components over
    shared keys: those of at most block_rows rows are walked in their order inside tasks, many a task.  Larger ones are cut into blocks of
    block_rows rows by their order, which are walked one after the other and hand on only keys that later blocks have; a
    few blocks' rows are walked so at once, without components.  No task walks more rows than that of one component or block.

    seq must be unique; it may be of any type that sorts.  A null key matches nothing.  Extra columns are returned as they are.
    """
    names = new.columns
    fresh = new.join(seen.select(identity).distinct(), identity, "left_anti").join(seen.select(fingerprint).distinct(), fingerprint, "left_anti").select(*names)
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.concat(F.lit("\0"), F.col(seq)))
    left, taken = stored(fresh.select(F.col(seq).alias("s"), own(identity).alias("i"), own(fingerprint).alias("f")), "open"), []
    count, before = left.count(), None
    while count > min(FEW_ROWS, block_rows) and (before is None or 10 * count <= 9 * before):
        by_i, by_f = left.groupBy("i").agg(F.min("s").alias("mi")), left.groupBy("f").agg(F.min("s").alias("mf"))
        ranked = stored(left.join(by_i, "i").join(by_f, "f"), "ranked")
        now = ranked.where("s = mi and s = mf").select("s", "i", "f")
        rest = ranked.where("not (s = mi and s = mf)").select("s", "i", "f")
        left = stored(rest.join(now.select("i"), "i", "left_anti").join(now.select("f"), "f", "left_anti"), "open")
        taken.append(now.select("s"))
        count, before = left.count(), count
    if count > FEW_BLOCKS * block_rows:
        own_walks, left = _by_components(left, block_rows)
        taken.append(own_walks)
        left = stored(left, "open")
        count = left.count()
    if count:
        taken.append(_by_blocks(left, block_rows))
    out = taken[0] if taken else left.select("s")
    for more in taken[1:]:
        out = out.unionByName(more)
    return new.join(out.select(F.col("s").alias(seq)), seq, "left_semi").select(*names)


def mark(state: DataFrame, batch: DataFrame, key: str = "identity") -> DataFrame:
    """Seen state (key, first_seen, last_seen, status) after a batch (key, seen_at, status): first_seen stays, the rest is the batch's."""
    was = state.select(key, "first_seen", "last_seen", "status")
    now = batch.groupBy(key).agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.max_by("status", "seen_at").alias("status"))
    return was.unionByName(now).groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max_by("status", "last_seen").alias("status"), F.max("last_seen").alias("last_seen"))


def prune(state: DataFrame, now, max_age_days: int) -> DataFrame:
    """State rows seen within three times max_age_days of now."""
    return state.where(F.col("last_seen") >= F.lit(now) - F.expr(f"interval {3 * max_age_days} days"))


def upsert(board: DataFrame, new: DataFrame, key: str = "id", listed: str = "listed_at", now=None, retain_days: int = 0) -> DataFrame:
    """Board rows replaced by new ones of the same key; rows listed over retain_days before now leave, unlisted times count as now."""
    both = board.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c != "_new"]
    out = both.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*names), F.struct("_new", listed)).alias("_r")).select("_r.*")
    if now is not None:
        now = F.lit(now).cast(out.schema[listed].dataType)
        out = out.withColumn(listed, F.coalesce(F.col(listed), now))
        out = out.where(F.col(listed) >= now - F.expr(f"interval {retain_days} days")) if retain_days > 0 else out
    return out


def archive_stats(archive: DataFrame) -> DataFrame:
    """One row: records, identities, revisions, sources, employers, characters, first and last time."""
    counted = F.count_if(F.col("id").isNotNull())
    return archive.agg(
        F.count("*").alias("records"), F.count_distinct("id").alias("identities"), (counted - F.count_distinct("id")).alias("revisions"),
        F.count_distinct("source").alias("sources"), F.count_distinct("employer").alias("employers"), F.sum(F.length("description")).cast("long").alias("chars"),
        F.min("archived_at").alias("first_at"), F.max("archived_at").alias("last_at"),
    )
