"""Similar items against all pairs."""

from __future__ import annotations

import random

import numpy as np

import __spark_entry__ as e
from gyeol.operators import context


def test_every_row_is_a_query(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(4)], i % 2) for i in range(60)] + [(60, [0.0] * 4, 0), (61, None, 0)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    docs.write.parquet(str(tmp_path / "embeddings.parquet"))
    v = np.array([x[1] for x in rows[:61]])
    norm = np.sqrt((v * v).sum(axis=1))
    want = {}
    for q in range(61):
        cos = {i: round(float(v[q] @ v[i]) / (norm[q] * norm[i]), 12) if norm[q] * norm[i] else 0.0 for i in range(61) if i != q}
        want[q] = sorted(cos, key=lambda i: (-cos[i], i))[:10]
    for block in (7, 4096):
        got: dict[int, list] = {}
        for x in sorted(context.all_similar(docs, "vec_id", "embedding", block=block).collect(), key=lambda x: (x["query"], -x["similarity"], x["vec_id"])):
            got.setdefault(x["query"], []).append(x["vec_id"])
        assert got == want
    assert {x["query"] for x in e.queries()["g08_most_similar"](spark, str(tmp_path)).collect()} == {0, 20, 40, 60}
