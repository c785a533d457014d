import numpy as np

from samewise.llm import toxicity


def test_words_count_once_in_each_window():
    model = toxicity.Model()
    words = [f"w{i}" for i in range(18)]
    words[6] = words[0]
    values = np.zeros(18)
    values[[0, 6, 15]] = 1.0
    ids = np.array([words.index(w) for w in words])
    got = model._windows(values, toxicity.distance_back(ids), *toxicity.windows(18)) - float(model.bias[1] - model.bias[0])
    assert np.allclose(got * toxicity.WINDOW, [1, 2])  # places 0 to 11 hold the word twice, 6 to 17 once and another
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 12, 13, 40, 101):
        ids, value = rng.integers(0, 9, n), rng.random(9)
        begin, end = toxicity.windows(n)
        want = [value[list(set(ids[b:e].tolist()))].sum() for b, e in zip(begin, end)]
        assert np.allclose(model._windows(value[ids], toxicity.distance_back(ids), begin, end) * toxicity.WINDOW, want)
