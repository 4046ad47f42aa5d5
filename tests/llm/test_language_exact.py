"""The shortcut around the recursion gives the recursion's labels."""

import numpy as np

from lociq.llm import language


def test_shortcut_equals_viterbi():
    rng = np.random.default_rng(5)
    model = language.Model(["a", "b", "c"], np.zeros((1, 3), np.float32), np.zeros((1, 3), bool), 8.0)
    texts = [[[0.0, -20.0, -7.0], [-20.0, 0.0, -7.0]]]  # c is best as a whole, a then b is better
    for _ in range(3000):
        # Stretches that lean to one language each, so that scores stand near one switch.
        lean = np.repeat(rng.integers(0, 3, 4), rng.integers(1, 6, 4))
        texts.append((rng.normal(0, 1.0, (len(lean), 3)) + 2.0 * (lean[:, None] == np.arange(3))).tolist())
    differ = 0
    for e in texts:
        model.rows, model.sizes = np.array(e, np.float64), np.ones(len(e), np.int64)
        model.known = {b"%d" % i: i for i in range(len(e))}
        path, _ = model._spans([b"%d" % i for i in range(len(e))])
        differ += path.tolist() != model._viterbi(model.rows).tolist()
    assert not differ
