"""The registered queries of the subpackage, and that nothing else depends on it."""

import os
import re

import pytest
from oracle import compare

from ranksight.llm.queries import QUERIES, SQL

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(SQL))
def test_with_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], SQL[name])


def test_neighbor_pairs_recall(spark, sf):
    import numpy as np

    got = {tuple(r) for r in QUERIES["p1_found"](spark, sf).collect()}
    v = spark.read.parquet(f"{sf}/chunks_vec.parquet").where("size(embedding) = 64").dropDuplicates(["chunk_id"]).orderBy("chunk_id").toPandas()
    x = np.stack(v.embedding.map(np.asarray)).astype(float)
    n = np.linalg.norm(x, axis=1)
    x, ids = x[n > 0] / n[n > 0][:, None], v.chunk_id.to_numpy()[n > 0]
    want = set()
    for i in range(len(ids)):
        s = x @ x[i]
        s[i] = -9
        want |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in np.lexsort((ids, -s))[:5]}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(got)


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "ranksight")):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert not re.search(r"ranksight\.llm|from \.*llm", f.read()), n
