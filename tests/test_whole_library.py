"""The findings of the first review on the library: each test fails on the code before it."""

import numpy as np

from orrery.plans import REGISTRY


def test_full_grid_ranks_every_stat_line(spark, small_dir):
    found = REGISTRY["q_iv_rank_grid"][0](spark, small_dir).toPandas()
    n = spark.read.parquet(f"{small_dir}/nation.parquet").count()
    ia, idf, ist = (x.ravel() for x in np.meshgrid(*[np.arange(16)] * 3, indexing="ij"))
    level2 = np.arange(2, 101)
    cpm = 0.05 * np.sqrt(level2.astype(float))
    want = []
    for k in range(n):
        a, d, s = 100 + k * 7 + ia, 90 + k * 5 + idf, 110 + k * 3 + ist
        cp = np.maximum(10, np.floor(a[:, None] * np.sqrt(d.astype(float))[:, None] * np.sqrt(s.astype(float))[:, None] * cpm * cpm / 10))
        for league, cap in (("LL", 500), ("GL", 1500), ("UL", 2500)):
            fits = cp <= cap
            some = np.flatnonzero(fits.any(axis=1))
            best = len(level2) - 1 - np.argmax(fits[some, ::-1], axis=1)
            c = cpm[best]
            product = a[some] * c * (d[some] * c) * np.floor(s[some] * c)
            order = np.lexsort((ist[some], idf[some], ia[some], -best, -product))
            want += [(k, league, *map(int, (ia[some[o]], idf[some[o]], ist[some[o]], level2[best[o]], r))) for r, o in enumerate(order, 1)]
    assert found["species"].nunique() == n > 2
    assert sorted(found.itertuples(index=False, name=None)) == sorted(want)
