"""The neural embedder with a made-up model in the place of the package: batches, unit vectors, one load in a worker."""

import math
import sys

import pytest
from docquarry.operators import embedding

MODEL = '''
class SentenceTransformer:
    loads = 0

    def __init__(self, name):
        type(self).loads += 1
        self.name = name

    def encode(self, texts, batch_size, normalize_embeddings):
        import numpy as np
        assert normalize_embeddings and self.name == "some/model" and batch_size == 2
        out = np.array([[len(t), t.count("a"), 1.0, float(type(self).loads)] for t in texts])
        return out / np.linalg.norm(out, axis=1, keepdims=True)
'''


def test_missing_package(spark):
    if "sentence_transformers" not in sys.modules:
        with pytest.raises(RuntimeError, match="sentence-transformers"):
            embedding.neural_vectors(spark.createDataFrame([(1, "a")], "k long, t string"), "k", "t")


def test_vectors_of_a_model(spark, tmp_path, monkeypatch):
    (tmp_path / "sentence_transformers.py").write_text(MODEL)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "sentence_transformers.py"))
    rows = [(i, "ab" * (i % 5)) for i in range(40)] + [(99, None)]
    got = {r["k"]: r["embedding"] for r in embedding.neural_vectors(spark.createDataFrame(rows, "k long, t string").repartition(2), "k", "t", "some/model", 2).collect()}
    assert len(got) == 41
    for k, text in rows:
        v = got[k]
        assert math.isclose(sum(x * x for x in v), 1.0) and math.isclose(v[0] / v[2], len(text or "")) and math.isclose(v[1] / v[2], (text or "").count("a"))
    sys.modules.pop("sentence_transformers", None)
