"""Related works against brute force, and how many rows they make."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import related
from textloom.plans import records, views


def brute_affinity(tags, atoms, n, cap):
    """Related works by pairs: {atom: [(other, s, shared), ...]}; atoms: {atom: (work, tags)}."""
    works = {}
    for w, t in tags:
        works.setdefault(w, set()).add(t)
    df = {t: sum(t in x for x in works.values()) for _, t in tags}
    weight = {t: 1 / math.log2(c + 1) for t, c in df.items() if cap is None or c <= cap}
    out = {}
    for a, (w, mine) in atoms.items():
        rows = [(o, sum(weight[t] for t in mine & x if t in weight), sum(t in weight for t in mine & x)) for o, x in works.items() if o != w]
        best = sorted((r for r in rows if r[2]), key=lambda r: (-round(r[1], 9), -r[2], r[0]))[:n]
        if best:
            out[a] = [(o, round(s, 6), k) for o, s, k in best]
    return out


@pytest.mark.parametrize(("cap", "group"), [(80, 80), (None, 80), (None, 4), (9, 4)])
def test_affinity_by_pairs(spark, monkeypatch, cap, group):
    """Hot tags, sets of hot tags and copies of works; atoms with other tags than their work's, or works as atoms."""
    monkeypatch.setattr(related, "GROUP", group)
    rng = random.Random(7)
    tags = {(w, int(rng.paretovariate(0.7)) % 40) for w in range(90) for _ in range(rng.randrange(1, 6))} | {(w, t) for w in range(0, 90, 4) for t in (100, 101, 102, 103)}
    atoms = {(1000 + i, rng.randrange(90), t) for i in range(60) for t in [rng.choice([1, 2, 3, 4, 100, 101, 102, 7, 777])]}
    work = {a: w for a, w, _ in atoms}
    atoms |= {(a, w, t) for a, w in work.items() for t in rng.sample([1, 2, 3, 5, 100, 101, 102, 103], 3)}
    rows = spark.createDataFrame(sorted(tags), "w long, t long")

    def got(df, atom):
        out = {}
        for r in df.orderBy(atom, "rank").collect():
            out.setdefault(r[atom], []).append((r["other"], round(r["s"], 6), r["shared"]))
        return out

    mine = {a: (w, {t for b, _, t in atoms if b == a}) for a, w in work.items()}
    df = related.affinity(spark.createDataFrame(sorted(atoms), "atom long, w long, t long"), rows, "atom", "w", "t", n=3, cap=cap)
    assert got(df, "atom") == brute_affinity(tags, mine, 3, cap)
    own = {w: (w, {t for v, t in tags if v == w}) for w in range(90)}
    assert got(related.affinity(rows, rows, "w", "w", "t", n=3, cap=cap), "w") == brute_affinity(tags, own, 3, cap)


def test_affinity_lists_few_works_of_a_tag(spark):
    """A tag on 3000 works makes rows by their number, not by its square."""
    rows = spark.range(3000).select(F.col("id").alias("w"), F.lit(1).alias("t"))
    df = related.affinity(rows, rows, "w", "w", "t", cap=None)
    assert 3000 <= shuffled(spark, "affinity", df) <= 3000 * 20
    assert df.count() == 3000 * 6


def brute_contrast(tags, opposed, atoms, n, cap):
    works = {}
    for w, t in tags:
        works.setdefault(w, set()).add(t)
    df = {t: sum(t in x for x in works.values()) for _, t in tags}
    out = {}
    for a, (w, mine) in atoms.items():
        best = {}
        for t, u in opposed:
            if t not in mine or u not in df or df[u] > cap:
                continue
            for o, x in works.items():
                if o != w and u in x and t not in x:
                    entry = (-round(1 / math.log2(df[u] + 1), 9), o, t, u)
                    best[o] = min(best.get(o, entry), entry)
        if best:
            out[a] = [e[1:] for e in sorted(best.values())[:n]]
    return out


@pytest.mark.parametrize("cap", [80, 12])
def test_contrast_by_pairs(spark, cap):
    rng = random.Random(5)
    tags = {(w, rng.randrange(30)) for w in range(90) for _ in range(rng.randrange(1, 8))}
    opposed = [(rng.randrange(30), rng.randrange(30)) for _ in range(40)]
    opposed += opposed[:5]
    mine = {1000 + i: (rng.randrange(90), {rng.randrange(33) for _ in range(4)}) for i in range(50)}
    rows = spark.createDataFrame(sorted(tags), "w long, t long")
    pairs = spark.createDataFrame(opposed, "t long, against long")

    def got(df, atom):
        out = {}
        for r in df.orderBy(atom, "rank").collect():
            out.setdefault(r[atom], []).append((r["other"], r["t"], r["against"]))
        return out

    atoms = spark.createDataFrame([(a, w, t) for a, (w, ts) in mine.items() for t in ts], "atom long, w long, t long")
    assert got(related.contrast(atoms, rows, pairs, "atom", "w", "t", n=3, cap=cap), "atom") == brute_contrast(tags, opposed, mine, 3, cap)
    own = {w: (w, {t for v, t in tags if v == w}) for w, _ in tags}
    assert got(related.contrast(rows, rows, pairs, "w", "w", "t", n=3, cap=cap), "w") == brute_contrast(tags, opposed, own, 3, cap)


def shuffled(spark, name, df):
    """Rows that a query writes to shuffles."""
    spark.sparkContext.setJobGroup(name, name)
    df.write.format("noop").mode("overwrite").save()
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    stages = {stage for job in tracker.getJobIdsForGroup(name) for stage in tracker.getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(stage).shuffleWriteRecords() for stage in stages)


def test_contrast_lists_few_works_of_a_pair(spark):
    """70 works of a tag and 70 of its opposite make rows by their number, not its square."""
    rows = spark.range(140).select(F.col("id").alias("w"), (F.col("id") % 2).alias("t"))
    pairs = spark.createDataFrame([(0, 1)], "t long, against long")
    assert shuffled(spark, "contrast", related.contrast(rows, rows, pairs, "w", "w", "t")) < 140 * 10


def test_shards_have_frequent_tags(spark, tmp_path):
    """Orders that share only a part of over 80 orders are related; the SQL has no cap either."""
    orders = spark.range(200).select(F.col("id").alias("l_orderkey"), F.lit(5).cast("long").alias("l_partkey"))
    orders.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["atom"]: (r["n"], r["others"]) for r in records.related_shards(spark, str(tmp_path)).collect()}
    assert got == {i: (6, ",".join(str(j) for j in range(8) if j != i and j < 6 + (i < 6))) for i in range(200)}
    assert "HAVING" not in records.SHARDS_SQL and "HAVING count(*) <= 80" in records.AFFINITY_SQL
    assert records.affinity_topn(spark, str(tmp_path)).count() == 0


def written(spark, name):
    """Rows that a job group has written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    stages = {stage for job in tracker.getJobIdsForGroup(name) for stage in tracker.getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(stage).shuffleWriteRecords() for stage in stages)


def test_affinity_of_repeated_rows_and_null_works(spark):
    """Works as atoms: repeated rows count once; a null work counts for its tags' frequency only."""
    rng = random.Random(11)
    tags = {(w, rng.randrange(30)) for w in range(60) for _ in range(rng.randrange(1, 7))}
    own = {w: (w, {t for v, t in tags if v == w}) for w, _ in tags}
    rows = spark.createDataFrame(sorted(tags) + sorted(tags)[:40] + [(None, t) for t in range(0, 30, 3)] + [(3, None)], "w long, t long")
    df = related.affinity(rows, rows, "w", "w", "t", n=3)
    got = {}
    for r in df.orderBy("w", "rank").collect():
        got.setdefault(r["w"], []).append((r["other"], round(r["s"], 6), r["shared"]))
    nowhere = max(own) + 1  # a work like a null one, that comes last
    want = brute_affinity(tags | {(nowhere, t) for t in range(0, 30, 3)}, own, 4, 80)
    assert got == {a: [x for x in best if x[0] != nowhere][:3] for a, best in want.items()}


def test_enriched_deals_tags_once(spark, tmp_path):
    """The tags are dealt once by tag and once by order, and a part's list goes only to the orders that need it."""
    rows = spark.range(1000).select(F.col("id").alias("l_orderkey"), F.explode(F.array(*[F.expr(f"id % {m} + {100 * m}") for m in (20, 23, 29, 31)])).alias("l_partkey"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = spark.range(1000).select(F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit(1).cast("long").alias("o_custkey"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    assert views.related_enriched(spark, str(tmp_path)).count() == 6000
    tags = spark.read.parquet(str(tmp_path / "lineitem.parquet"))
    assert shuffled(spark, "dealt", related.affinity(tags, tags, "l_orderkey", "l_orderkey", "l_partkey")) < 1000 * 40


def test_shards_look_for_frequent_tags_first(spark, tmp_path):
    """Without a part on over 80 orders, all parts aren't dealt to orders only to see that there is none."""
    rows = spark.range(2000).select(F.col("id").alias("l_orderkey"), F.explode(F.array(*[F.expr(f"id % {m} + {100 * m}") for m in (50, 53, 59, 61)])).alias("l_partkey"))
    rows.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sparkContext.setJobGroup("plan", "plan")
    records.related_shards(spark, str(tmp_path))
    assert written(spark, "plan") < 1000
