import math
import random

import numpy as np

from churnkit.llm.masked_lm import BUCKETS, CLASSES, SIDES, MaskedModel, Network, neighbours, pseudo_likelihood, vocabulary


def test_score_is_the_sum_of_conditional_logs():
    rng = np.random.default_rng(1)
    counts = np.floor(rng.exponential(3, BUCKETS))
    words = vocabulary(counts)
    net = Network.start(np.bincount(words.of_bucket, weights=counts, minlength=CLASSES))
    model = MaskedModel(words, net)
    bucket = rng.integers(0, BUCKETS, 30)
    doc = np.repeat([0, 2], [18, 12])
    got = model.score(bucket, doc, 3)
    for d in range(3):
        own, want = bucket[doc == d], 0.0
        c = [int(words.of_bucket[b]) for b in own]
        for i, b in enumerate(own):
            total = net.hidden_bias.astype(float).copy()
            for k, s in enumerate(SIDES):
                total += net.embed[k][c[i + s] if 0 <= i + s < len(c) else 0]
            z = np.tanh(total) @ net.out + net.out_bias
            z = z - z.max()
            members = np.flatnonzero(words.of_bucket == c[i])
            share = (counts[b] + 0.5) / (counts[members] + 0.5).sum()
            want += z[c[i]] - math.log(np.exp(z).sum()) + math.log(share)
        assert abs(got[d] - want) < 1e-2


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(2)
    target = rng.integers(1, CLASSES, 600)
    around = neighbours(target, np.zeros(600, int))
    net = Network.start(np.ones(CLASSES))
    before = -net.log_probability(around, target).mean()
    memory = np.full(len(net.vector), 1e-3, np.float32)
    for _ in range(60):
        net.train(around, target, memory, 0.15)
    assert -net.log_probability(around, target).mean() < before - 0.5


def test_order_of_words_counts(spark):
    """Texts of a fixed rhythm score better than the same words shuffled; edge rows are defined."""
    rng = random.Random(3)
    rhythm = ["the", "cat", "sat", "on", "a", "mat", "and", "slept"]
    rows = [(i, " ".join(rhythm * rng.randint(20, 40)), "x") for i in range(200)]
    shuffled = rhythm * 30
    rng.shuffle(shuffled)
    rows += [(900, " ".join(rhythm * 30), "x"), (901, " ".join(shuffled), "x"), (902, None, "x"), (903, " \n", "x"),
             (None, "the cat", "x"), (904, "the cat", "x"), (904, "the cat", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(4)
    got = pseudo_likelihood(df, rounds=3, stride=4)
    by = {r.doc_id: r for r in got.collect()}
    assert by[900].mean_log_likelihood > by[901].mean_log_likelihood + 1
    assert by[902].log_likelihood == 0 and by[902].mean_log_likelihood is None and by[903].n_words == 0
    assert by[None].log_likelihood == by[904].log_likelihood < 0
    assert got.count() == len(rows)


def test_production_parameters_train_on_every_word(spark):
    """Places 0 and 1 of every 16 words are noise, the rhythm is in the other 14: it is learned only from those."""
    rng = random.Random(4)
    noise, rhythm = ["n%d" % k for k in range(20)], ["r%d" % k for k in range(14)]

    def text(parts, blocks=100):
        return " ".join(w for _ in range(blocks) for w in (rng.choice(noise), rng.choice(noise), *parts))
    mixed = list(rhythm)
    rng.shuffle(mixed)
    rows = [(i, text(rhythm)) for i in range(300)] + [(900, text(rhythm)), (901, text(mixed))]
    got = pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    by = {r.doc_id: r.mean_log_likelihood for r in got.collect()}
    assert by[900] > by[901] + 1


def test_empty_table(spark):
    assert pseudo_likelihood(spark.createDataFrame([], "doc_id long, text string")).collect() == []
