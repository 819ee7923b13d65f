"""Embedding links on tables larger than the sample that trains the index."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ashlar.llm import embeddings


def test_recall_where_partners_are_not_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SAMPLE", 40)
    monkeypatch.setattr(embeddings, "CELL_ROWS", 4)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = np.r_[x, x + rng.normal(size=x.shape) * 0.1]  # cosines around 0.94
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= embeddings.COSINE).sum(1) - 1
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.links(docs).collect()}
    recall = sum(got.values()) / want.sum()
    assert all(got[i] <= n for i, n in enumerate(want))
    assert recall >= 0.9, recall


@pytest.mark.parametrize(("n", "every"), [(50_000, 1000), (20_000, 100), (20_000, 10)])
def test_recall_where_links_are_sparse(spark, tmp_path, n, every):
    """One vector in ``every`` has one partner, of cosine 0.9 to 0.95: sample queries meet few or none of them."""
    rng = np.random.default_rng(every)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    base = np.arange(0, n, every)
    cosine = rng.uniform(0.9, 0.95, len(base))[:, None] + 1e-9
    r = rng.normal(size=(len(base), 64))
    r[::2, 32:] = 0.0  # half of the partners differ in one half of the vector alone
    r -= (r * x[base]).sum(1)[:, None] * x[base]
    y = cosine * x[base] + np.sqrt(1 - cosine**2) * r / np.linalg.norm(r, axis=1)[:, None]
    every_vector = np.r_[x, y]
    table = pa.table({"vec_id": np.arange(len(every_vector)), "embedding": list(every_vector)})
    pq.write_table(table, tmp_path / "v.parquet")
    rows = embeddings.links(spark.read.parquet(str(tmp_path / "v.parquet"))).filter("n_links > 0").toPandas()
    pairs = set(zip(rows["component_id"], rows["vec_id"], strict=True)) - set(zip(rows["vec_id"], rows["vec_id"], strict=True))
    want = {(int(b), n + i) for i, b in enumerate(base) if x[b] @ y[i] >= 0.9}
    assert pairs <= want and len(pairs) >= 0.95 * len(want), (len(pairs), len(want))


def test_ties_and_clashing_columns(spark):
    """Equal vectors link with each other; columns of the operator's own names are not read."""
    rows = [(4, [1.0, 0.0], 1, 2, "h"), (2, [2.0, 0.0], 1, 2, "h"), (2, [0.0, 3.0], 5, 6, "c"), (None, [1.0, 0.0], 0, 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node long, home int, cells string")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embeddings.links(df).collect())
    assert got == sorted([("4", 2, 2, False), ("2", 2, 2, True), ("2", 0, 2, True), ("None", 2, 2, False)])
