"""Training steps of the language model meet each context of a batch once."""

import numpy as np

from ashlar.llm import lm


def _batch(rng):
    model = lm.Model(np.array([40, 30, 20, 10, 5, 5]))
    topic, previous = rng.integers(0, 2, 600), rng.integers(0, 3, 600)
    return model, topic, previous, rng.integers(0, 6, 600), rng.integers(0, 6, lm.NOISE)


def test_noise_meets_distinct_contexts(monkeypatch):
    model, topic, previous, target, noise = _batch(np.random.default_rng(1))
    rows, product = [], lm._product
    monkeypatch.setattr(lm, "_product", lambda a, b: rows.append(len(a)) or product(a, b))
    model.step(topic, previous, target, noise, np.zeros(len(model.rows), np.int64))
    assert max(rows) == 6  # contexts, not tokens


def test_a_step_is_that_of_every_token_by_itself():
    model, topic, previous, target, noise = _batch(np.random.default_rng(2))
    p, w = model.rows.astype(float), lm.WIDTH
    grad, times = np.zeros((len(p), w + 1)), np.zeros(len(p), np.int64)
    for t, b, c in zip(topic, previous, target, strict=True):
        mix, carried, led = p[model.mix :, :w], p[model.input + b, :w], p[model.topic + t, :w]
        hidden, back = np.append(carried @ mix + led, 1.0), np.zeros(w + 1)
        for word, want in [(c, 1.0), *((x, 0.0) for x in noise)]:
            miss = 1.0 / (1.0 + np.exp(model.odds[word] - hidden @ p[word, : w + 1])) - want
            grad[word] += miss * hidden
            back += miss * p[word, : w + 1]
        grad[model.input + b, :w] += mix @ back[:w]
        grad[model.topic + t, :w] += back[:w]
        grad[model.mix :, :w] += np.outer(carried, back[:w])
        times[[c, model.input + b, model.topic + t]] += 1
    times += np.bincount(noise, minlength=len(p))
    times[model.mix :] += 1
    square = model.square + np.where(times, (grad**2).sum(1) / (w + 1), 0)
    want = p[:, : w + 1] - lm.RATE / np.sqrt(square)[:, None] * grad
    touched = np.zeros(len(p), np.int64)
    model.step(topic, previous, target, noise, touched)
    assert np.abs(model.rows[:, : w + 1] - want).max() < 1e-3 and (model.rows[:, w + 1 :] == 0).all()
    assert (touched[: model.mix] == times[: model.mix]).all()
