import math

import numpy as np
from pyspark.sql import functions as F

from engramlake.functions import quantize as Z


def test_noise_is_normal_and_reproducible():
    x = Z.gaussian_noise(np.arange(-20_000, 20_000), 3, 8)
    assert abs(x.mean()) < 0.01 and abs(x.var() - 1) < 0.01 and abs((x**3).mean()) < 0.03 and abs((x**4).mean() - 3) < 0.06
    assert np.abs(np.corrcoef(x.T) - np.eye(8)).max() < 0.03
    later = Z.gaussian_noise(np.arange(-20_000, 20_000), 4, 8)
    assert abs(np.corrcoef(x[:, 0], later[:, 0])[0, 1]) < 0.03 and abs(np.corrcoef(x[:-1, 0], x[1:, 0])[0, 1]) < 0.03
    assert (Z.gaussian_noise(np.array([7, -5]), 3, 8) == x[[20_007, 19_995]]).all()
    assert (Z.gaussian_noise(np.array([7]), 3, 8, seed=1) != x[20_007]).all()


def plain(x, key, acc, age, imp, temperature, step, rounds):
    """One fact, a number at a time."""
    x = list(x)
    for k in range(rounds):
        square = min(sum(v * v for v in x), 0.99**2)
        length = math.sqrt(sum(v * v for v in x))
        m = (1 - square) / 2
        pull = 2 * (3 + 0.08 * math.log(1 + acc) - 0.005 * min(age, 365) / 365 + 0.5 * imp)
        forget = 0.1 / max(0.5, 0.3 * math.log(1 + acc) + 0.4 * imp)
        noise = Z.gaussian_noise(np.array([key]), k, len(x))[0]
        new = [v + step * (-m * m * pull * v + (forget * v / length if length > 1e-12 else 0) + 0.5 * temperature * (len(x) - 2) * m * v) + math.sqrt(2 * step * temperature) * m * e for v, e in zip(x, noise)]
        length = math.sqrt(sum(v * v for v in new))
        x = [v * 0.99 / length for v in new] if length > 0.99 else new
    return x


def test_steps_are_a_plain_loop_within_the_ball():
    keys = np.array([1, 2, 3, 4])
    start = np.array([[0.1, 0.2, -0.3], [0, 0, 0], [0.7, 0.7, 0.0], [0.5, 0.5, 0.69]])
    acc, age, imp = np.array([0, 5, 50, 3]), np.array([0, 30, 900, 1]), np.array([0.1, 0.5, 1.0, 0.0])
    for temperature in (0.0, 0.3, 40.0):
        got = Z.langevin_steps(start, keys, acc, age, imp, temperature, 0.01, 30)
        want = [plain(s, k, a, g, i, temperature, 0.01, 30) for s, k, a, g, i in zip(start, keys, acc, age, imp)]
        assert np.allclose(got, want) and (np.linalg.norm(got, axis=1) <= 0.99 + 1e-9).all()


def test_partitions_and_cuts_do_not_matter(spark):
    df = spark.range(500).select(F.col("id").alias("fact_id"), (F.col("id") % 20).alias("access_count"), (F.col("id") % 300).alias("age_days"), (F.col("id") % 10 / 10).alias("importance"))
    whole = {r.fact_id: r.position for r in Z.langevin(df, "fact_id", 0.3, rounds=12).collect()}
    other = {r.fact_id: r.position for r in Z.langevin(df.repartition(7), "fact_id", 0.3, rounds=12).collect()}
    assert whole == other
    half = Z.langevin(df, "fact_id", 0.3, rounds=5).select("fact_id", "position")
    rest = {r.fact_id: r.position for r in Z.langevin(df.join(half, "fact_id"), "fact_id", 0.3, rounds=7, first=5).collect()}
    assert all(np.allclose(rest[k], whole[k]) for k in whole)
    assert Z.langevin(df.limit(0), "fact_id").count() == 0
