import random

from pyspark.sql import functions as F

import math

from corpusforge.operators.rank import grouped_order_statistics, kth_smallest_hex, order_statistics
from corpusforge.operators.score import apply_score_cut, score_distribution
from corpusforge.operators.split import exact_split, val_size


def ref_dist(scores):
    s = sorted(scores)
    n = len(s)
    return (n, round(s[0], 4), round(s[n // 10], 4), round(s[n // 2], 4), round(s[n * 9 // 10], 4), round(s[-1], 4))


def test_score_distribution_floor_index(spark):
    rnd = random.Random(7)
    groups = {
        "n1": [0.5],
        "n2": [0.9, 0.1],
        "n9": [rnd.random() for _ in range(9)],
        "n10": [i / 10 for i in range(10)],
        "n11": [rnd.choice([0.8, 0.85, 0.9]) for _ in range(11)],  # ties
        "big": [rnd.gauss(0.86, 0.03) for _ in range(5000)],
        "wide": [rnd.uniform(-1e6, 1e6) for _ in range(3000)] + [1e-300, -1e-300, 0.0],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("n1", None)]
    df = spark.createDataFrame(data, "source string, score double")
    got = {tuple(r)[0]: tuple(r)[1:] for r in score_distribution(df).collect()}
    assert got == {g: ref_dist(vs) for g, vs in groups.items()}


def test_order_statistics_small_buckets(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([1.0, 2.0, 2.0, 3.5]) * rnd.random() for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    ks = [0, 1, 17, 999, 1999]
    st = order_statistics(df, "v", [], lambda n: [(str(k), k) for k in ks], buckets=4)
    s = sorted(vals)
    assert {k: st[0].values[str(k)] for k in ks} == {k: s[k] for k in ks}


def ref_cut(scores, pct):
    scored = [s for s in scores if s is not None]
    if pct <= 0 or not scored:
        return len(scores)
    ss = sorted(scored)
    idx = int(len(ss) * pct / 100)
    cutoff = ss[idx] if idx < len(ss) else ss[-1]
    return sum(1 for s in scored if s >= cutoff) + sum(1 for s in scores if s is None)


def test_score_cut_ties_and_edges(spark):
    scores = [0.1, 0.2, 0.2, 0.2, 0.5, 0.7, None, None, 0.9, 0.9]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "id int, score double")
    for pct in (0, 10, 25, 50, 99, 100, 150):
        kept, _ = apply_score_cut(df, pct)
        assert kept.count() == ref_cut(scores, pct), pct
    none = spark.createDataFrame([(1, None)], "id int, score double")
    assert apply_score_cut(none, 10)[0].count() == 1


def test_exact_split_sizes_and_independence(spark):
    for n in (0, 1, 19, 20, 1000):
        df = spark.createDataFrame([(f"k{i}",) for i in range(n)], "key string")
        a = exact_split(df.repartition(1), "key", 0.05, 42)
        b = exact_split(df.repartition(7), "key", 0.05, 42)
        va = sorted(r.key for r in a.where("split = 'val'").collect())
        vb = sorted(r.key for r in b.where("split = 'val'").collect())
        assert len(va) == val_size(n, 0.05) == int(n * 0.05)
        assert va == vb
        assert a.count() == n
        # the val set is the n_val smallest shuffle keys
        keys = sorted(r.shuffle_key for r in a.collect())
        assert sorted(r.shuffle_key for r in a.where("split = 'val'").collect()) == keys[: len(va)]


def test_kth_smallest_hex(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("h"))
    hs = sorted(r.h for r in df.collect())
    for k in (0, 1, 2499, 4999):
        assert kth_smallest_hex(df, "h", k, digits=2) == hs[k]


def test_order_statistics_nan_ranks_last(spark):
    import math

    vals = [0.1, 0.5, float("nan"), 0.3, float("nan"), 0.9]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    st = order_statistics(df, "v", [], lambda n: [(str(k), k) for k in range(n)])[0]
    got = [st.values[str(k)] for k in range(6)]
    assert got[:4] == [0.1, 0.3, 0.5, 0.9] and all(math.isnan(x) for x in got[4:])
    assert st.lo == 0.1 and math.isnan(st.hi)
    only_nan = spark.createDataFrame([(float("nan"),)], "v double")
    assert math.isnan(order_statistics(only_nan, "v", [], lambda n: [("m", 0)])[0].values["m"])


def test_grouped_order_statistics(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = []
    for g in [*range(40), None]:
        kind = rng.randrange(5)
        for _ in range(rng.choice([1, 2, 3, 50, 400])):
            v = [rng.random(), rng.uniform(-1e300, 1e300), float(rng.randrange(4)), rng.gauss(0, 1) * 10.0 ** rng.randrange(-300, 300), 7.5][kind]
            rows.append((g, v))
    rows += [(3, None), (50, None), (60, math.nan), (61, math.nan), (61, 1.0), (62, math.inf), (62, -math.inf), (62, 0.0), (62, -0.0), (63, 5e-324), (63, 1e308)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    ranks = {"p10": lambda n: F.floor(n / 10), "median": lambda n: F.floor(n / 2), "last": lambda n: n - 1, "beyond": lambda n: n}
    got = {r.g: r for r in grouped_order_statistics(df, "v", ["g"], ranks, buckets=16).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs, key=lambda v: (math.isnan(v), v if not math.isnan(v) else 0))
        r = got[g]
        want = [vs[len(vs) // 10], vs[len(vs) // 2], vs[-1], None, len(vs), vs[0], vs[-1]]
        for a, b in zip([r.p10, r.median, r["last"], r.beyond, r.n, r["min"], r["max"]], want, strict=True):
            assert a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b)), (g, r, want)
    assert grouped_order_statistics(df.limit(0), "v", ["g"], ranks).count() == 0


def test_grouped_order_statistics_jobs_do_not_grow_with_groups(spark):
    from corpusforge.operators.score import FLOOR_RANKS

    def jobs(n_groups):
        name = f"groups-{n_groups}"
        spark.sparkContext.setJobGroup(name, name)
        df = spark.range(200_000).selectExpr(f"id % {n_groups} as g", "cast(pmod(id * 7919, 1000) as double) as v")
        out = grouped_order_statistics(df, "v", ["g"], FLOOR_RANKS)
        assert out.count() == n_groups
        done = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setJobGroup("other", "other")
        return done

    few, many = jobs(10), jobs(100_000)
    assert many <= max(few, 40)
