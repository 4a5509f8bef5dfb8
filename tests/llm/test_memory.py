"""What the driver holds doesn't grow beyond its bounds."""

import tracemalloc

import numpy as np

from folioscope.llm import embedding_dedup


def test_fitting_the_largest_quantiser_is_bounded():
    n, d = embedding_dedup.SAMPLE // 4, 256
    x = np.random.default_rng(1).normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    q = embedding_dedup.Quantiser(x, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * x.nbytes + 128 * 2**20
    at, codes, lost, probes = q.encode(x[:3000])
    assert all(a in p for a, p in zip(at, probes, strict=True)) and codes.shape == (3000, 8) and (lost >= 0).all()
    assert (embedding_dedup._nearest(x, q.centroids)[:50] == (x[:50] @ q.centroids.T).argmax(1)).all()
    assert len(embedding_dedup._nearest(x[:0], q.centroids)) == 0
