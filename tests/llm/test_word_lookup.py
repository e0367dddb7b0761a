"""Looking up words by the leading bits of their hashes."""

import numpy as np

from tessera.llm import neural_lm


def test_words_are_entered_by_leading_bits_and_found_exactly():
    rng = np.random.default_rng(4)
    some = rng.integers(-(1 << 63), (1 << 63) - 8, 3000)
    ends = np.concatenate([np.iinfo(np.int64).min + np.arange(5), (1 << 63) - 1 - np.arange(5), some[0] + np.arange(7), [0, -1, 1]])  # runs of equal leading bits, the first and the last too
    table = np.unique(np.concatenate((some[:2000], ends[::2])))
    counts = neural_lm.Counts(table, np.ones(len(table), np.int64), np.zeros(len(table), np.int64), 1, 1, np.zeros(neural_lm.CLASSES))
    asked = np.concatenate((some, ends))
    at, there = counts.find(asked)
    assert np.array_equal(there, np.isin(asked, table)) and np.array_equal(table[at[there]], asked[there])
    assert len(counts.begin) == (1 << neural_lm.LEADING) + 1 and counts.begin[-1] == len(table)
    none = neural_lm.Counts(table[:0], table[:0], table[:0], 0, 0, np.zeros(neural_lm.CLASSES))
    assert not none.find(asked)[1].any() and len(none.find(asked)[0]) == len(asked)


def test_gradients_of_a_row_are_added_in_full():
    """In double width: many small gradients beside a large one are not lost."""
    rows = np.array([7] * 2001 + [0, 4095])
    grad = np.full((len(rows), 3), 1, np.float32)
    grad[0] = 1 << 24
    at, sums = neural_lm.summed_by(rows, grad)
    assert at.tolist() == [0, 7, 4095] and sums.dtype == np.float32
    assert sums[1].tolist() == [(1 << 24) + 2000] * 3 and sums[0].tolist() == sums[2].tolist() == [1, 1, 1]


def test_gradients_of_odd_and_even_widths_and_words_of_texts_are_summed_apart():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 50, 400)
    for wide in (1, 2, 5, 64):
        grad = rng.normal(size=(400, wide)).astype(np.float32)
        at, sums = neural_lm.summed_by(rows, grad)
        plain = np.zeros((50, wide))
        for row, g in zip(rows, grad, strict=True):
            plain[row] += g
        assert np.array_equal(at, np.unique(rows)) and np.array_equal(sums, plain[at].astype(np.float32))
    key, h = np.array([5, 5, -3, 5, -3]), np.array([7, 8, 7, 7, 7])
    got = sorted(zip(*(x.tolist() for x in neural_lm.summed_words(key, h, h + 100, np.arange(5.0))), strict=True))
    assert got == [(-3, 7, 107, 2, 6.0), (5, 7, 107, 2, 3.0), (5, 8, 108, 1, 1.0)]
    assert [len(x) for x in neural_lm.summed_words(*(key[:0],) * 3, np.zeros(0))] == [0] * 5


def test_the_chance_of_noise_may_overflow_to_nothing():
    with np.errstate(over="ignore"):
        got = neural_lm._sigmoid_of_negative(np.array([-200, -1, 0, 1, 50, 200], np.float32))
    assert np.allclose(got, [1, 0.7310586, 0.5, 0.26894143, 0, 0])


def test_distinct_hashes_with_a_place_and_a_count():
    h = np.random.default_rng(2).integers(-9, 9, 300)
    u, at, n = neural_lm.distinct(h)
    assert [x.tolist() for x in (u, n)] == [x.tolist() for x in np.unique(h, return_counts=True)] and np.array_equal(h[at], u)
    assert [len(x) for x in neural_lm.distinct(h[:0])] == [0, 0, 0]
