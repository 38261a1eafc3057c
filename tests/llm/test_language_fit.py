import tracemalloc

import numpy as np

from passagemill.llm import language


def _counts(n: int):
    return ((f"l{k % 2}", f"word{k}tail{k * 7919}", 1 + k % 5) for k in range(n))


def test_the_driver_holds_few_words_at_once():
    """What a fit holds besides the model doesn't follow the number of words."""
    tracemalloc.start()
    model = language.fit(_counts(150_000), ["l0", "l1"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.words.keys) == 150_000
    assert peak < 100e6


def test_slices_make_the_same_model(monkeypatch):
    whole = language.fit(_counts(3000), ["l0", "l1"])
    monkeypatch.setattr(language, "FIT_WORDS", 97)
    cut = language.fit(_counts(3000), ["l0", "l1"])
    for a, b in zip([whole.words, *whole.grams.values()], [cut.words, *cut.grams.values()]):
        assert (a.keys == b.keys).all()
        assert np.allclose(a.scores, b.scores, atol=1e-6)
