"""Heavy keys."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from arcweave.operators import skew


def rows(spark):
    data = [("hot", f"s{k % 40}") for k in range(400)] + [(f"k{k % 150}", f"s{k % 7}") for k in range(600)]
    data += [(None, "s1"), ("", "s1"), ("  ", "s1"), ("odd", None), ("odd", " "), ("odd", "s1"), ("hot", "s3")]
    return data, spark.createDataFrame([(d, s, 1, "x") for d, s in data], "dst string, src string, n int, k string")


def test_heavy_hitters(spark):
    data, df = rows(spark)
    got = {r.dst: r.n for r in skew.heavy_hitters(df.where(skew.not_blank("dst")), "dst", 1 / 20).collect()}
    assert got == {"hot": 401}
    assert skew.heavy_hitters(df.limit(0), "dst").count() == 0


def test_shared_targets(spark):
    data, df = rows(spark)
    counted = Counter(d for d, _ in data if d and d.strip())
    for share in (1 / 20, 4 / sum(counted.values())):
        want = {d for d, n in counted.items() if n >= share * sum(counted.values())}
        assert {r.dst for r in skew.shared_targets(df.withColumnRenamed("n", "m"), share).collect()} == want
    assert skew.shared_targets(df.limit(0)).count() == 0


def test_hubs_are_whole(spark):
    data, df = rows(spark)
    want = Counter((d, s) for d, s in data if d and d.strip() and s and s.strip())
    got = {(r.dst, r.src): r.n for r in skew.target_hubs(df.withColumnRenamed("n", "m")).collect()}
    assert got == want and len([s for d, s in got if d == "hot"]) == 40
    assert skew.target_hubs(df.limit(0)).count() == 0


def test_report(spark):
    data, df = rows(spark)
    for share in (1 / 20, 0.9):
        got = {r.dst: (r.n_links, r.n_src, r.hubs) for r in skew.target_report(df, hubs=3, share=share, salts=5).collect()}
        want = defaultdict(Counter)
        for d, s in data:
            if d and d.strip():
                want[d][s if s and s.strip() else None] += 1
        assert got.keys() == want.keys()
        for d, c in want.items():
            best = sorted(((-n, s) for s, n in c.items() if s is not None))[:3]
            assert got[d] == (sum(c.values()), len([s for s in c if s is not None]), " | ".join(f"{s}={-n}" for n, s in best))
    assert skew.target_report(df.limit(0)).count() == 0


def test_split_join(spark):
    _, df = rows(spark)
    right = df.select("dst").distinct().selectExpr("dst", "length(dst) as size")
    left = df.select("dst", "src")
    want = Counter(map(tuple, left.join(right, "dst").collect()))
    assert Counter(map(tuple, skew.split_join(left, right, "dst", 1 / 20).collect())) == want


def test_heavy_is_what_fills_a_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, want in ((2, 1 / 200), (100, 1 / 400), (10**6, 1 / skew.FINEST)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            assert skew.fair_share(spark) == want
        spark.conf.set("spark.sql.shuffle.partitions", "100")
        df = spark.range(20_000).selectExpr("if(id % 333 = 0, 'hot', string(id)) as k")  # 0.3 % of the rows
        values, n = skew.key_candidates(df, F.col("k"), skew.fair_share(spark))
        assert values == ["hot"] and n == 20_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
