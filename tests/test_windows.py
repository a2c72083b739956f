"""Windows by events against every start by itself."""

from collections import Counter

import numpy as np
import pytest

from specimen_spark.operators import windows


@pytest.mark.parametrize(("length", "width", "share"), [(16_000, 300, 0.01), (40, 7, 0.2), (10, 10, 0.0), (5, 9, 0.5)])
def test_every_start(spark, length, width, share):
    rng = np.random.default_rng(length)
    rows = []
    for i in range(24):
        own = rng.choice(list("ACGT-?"), length if i % 6 else max(length - 4, 0))
        own[rng.random(len(own)) < 0.008] = "R"
        own[: int(rng.integers(0, max(length // 4, 1)))] = "_"
        rows.append((None if i % 7 == 3 else f"s{i % 5}", "".join(own)))
    rows += [("empty", ""), ("none", None)]
    want = {}
    for start in range(length - width + 1):
        n = Counter(sp for sp, s in rows if s and len(s) >= start + width and "_" not in s[start : start + width] and s[start : start + width].count("R") <= int(share * width))
        if n:
            named = {k: v for k, v in n.items() if k}
            want[start] = (sum(n.values()), sum(named.values()), len(named), sum(v > 1 for v in named.values()))
    df = spark.createDataFrame(rows, "species string, seq string").repartition(3)
    assert {r["start"]: tuple(r)[1:] for r in windows.window_stats(df, width, share).collect()} == want
    assert bool(want) == (length >= width)
