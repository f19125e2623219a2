"""Words of any length: the sum over all segmentations in logs equals the plain sum, in one language as in the next; whole texts against brute force."""

import math

import numpy as np
import pytest

from cohortlake.llm.language import MARK, SAFE, Unigrams, letters


def model():
    pieces = [MARK + "a", MARK + "ab", "a", "b", "ab", "ba", "abc", "c", "cab"]
    m = Unigrams(pieces, ["x", "y"])
    m.learn([("abcab", 0, 3), ("baab", 1, 2), ("cabcab", 0, 1), ("ab" * 40, 1, 1)])
    return m, {p: m.p[int(np.searchsorted(m.hashes, np.uint64(m._hash(p))))] for p in pieces}


def brute(word, pieces, unknown):
    """Sum over all segmentations, exactly, with big exponents: (mantissa in logs)."""
    text = MARK + word
    log = [np.zeros(2)] + [np.full(2, -np.inf)] * len(text)
    for j in range(1, len(text) + 1):
        ways = []
        for i in range(max(0, j - 8), j):
            part = text[i:j]
            if part in pieces:
                ways.append(log[i] + np.log(pieces[part]))
            elif j == i + 1:
                ways.append(log[i] + math.log(unknown))
        log[j] = np.logaddexp.reduce(ways, axis=0)
    return log[-1]


def test_marginals_of_any_length():
    m, pieces = model()
    words = ["a", "abcab", "zz", "ab" * (SAFE // 2), "abc" * 30, "ab" * 5000 + "z" * 50]
    order, logs = m.marginals(words)
    for word, log in zip(order, logs):
        assert log == pytest.approx(brute(word, pieces, m.unknown), rel=1e-9)
    # both ways of the same word
    word = "abcabbacab"
    assert m.logs_of(m.pieces_of(word))[-1] == pytest.approx(m.marginals([word])[1][0]) and m.logs_of(m.pieces_of(word), True)[0] == pytest.approx(m.marginals([word])[1][0])


def test_no_word_is_cut():
    word = "ab" * 100
    assert list(letters(f"one {word} two2three ²x")) == ["one", word, "two", "three", "x"]
    m, pieces = model()
    text = f"ab {word} cab abcab"
    total = sum(brute(w, pieces, m.unknown) for w in letters(text))
    p = np.exp(total - total.max())
    assert m.score([text, None, "12"]) == ([m.langs[int(p.argmax())], "und", "und"], [pytest.approx(p.max() / p.sum()), 0.0, 0.0])


def test_learning_counts_long_words_like_short_ones(monkeypatch):
    from cohortlake.llm import language

    counts = [("abcab" * 5, 0, 3), ("baab" * 6, 1, 2), ("cab", 0, 1), ("zba", 1, 4)]
    one = Unigrams([MARK + "a", "a", "b", "ab", "ba", "abc", "c"], ["x", "y"])
    one.learn(counts)
    monkeypatch.setattr(language, "SAFE", 2)
    two = Unigrams([MARK + "a", "a", "b", "ab", "ba", "abc", "c"], ["x", "y"])
    two.learn(counts)
    assert two.p == pytest.approx(one.p, rel=1e-8)
