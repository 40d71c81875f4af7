"""What op10 sends to its tasks."""

import pickle

import numpy as np

from lapforge.llm import latent_leaks


def test_a_block_travels_without_derived_tables():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 60)) + "\nan answer" for _ in range(200)] + ["same same same"]
    block = latent_leaks.Block(list(range(201)), texts)
    block.weigh(rng.integers(1, 50, len(block.terms)), 100)
    block.project(rng.standard_normal((len(block.terms), 8)))
    sent = pickle.dumps(block, 5)
    assert len(sent) < block.counts.nbytes / 2 and block.counts.max() == 3
    got = pickle.loads(sent)
    assert set(got.__dict__) == set(block.__dict__)
    for name in ("near", "counts", "terms", "idf", "latent", "vectors", "needed"):
        assert np.array_equal(getattr(got, name), getattr(block, name)), name
    words, first = latent_leaks.word_hashes(latent_leaks.pa.array([texts[3] + " more words", "none", texts[9]]))
    assert got.search(words, first) == block.search(words, first)
