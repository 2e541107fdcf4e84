"""The suffix tree against one of plain dictionaries, and rare phrases of a larger corpus."""

import math
import random
from collections import Counter, defaultdict

import pytest

from cohortlens.llm import op08_suffix_tree as op
from cohortlens.llm.common import stored


def plain_scores(train, texts, settings):
    """log10 probability of each text; contexts and entries are tuples of words, None is the start, b'' the end."""
    split = lambda t: [None, *(t or "").encode().lower().split(), b""]
    unigrams = Counter(w for t in train for w in split(t)[1:])
    n, v, least = sum(unigrams.values()), len(unigrams), settings.least_count
    n1, n2 = (sum(c == k for c in unigrams.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    root = lambda w: math.log((unigrams[w] - d) / n) if unigrams[w] else math.log(min(1.0, max(d * v, 1.0) / n))
    counts = Counter(tuple(w[i:i + k]) for t in train for w in [split(t)] for k in range(1, settings.depth + 2) for i in range(len(w) - k + 1))
    followers, model = defaultdict(dict), {}
    for g, c in counts.items():
        if len(g) > 1 and c >= least:
            followers[g[:-1]][g[-1]] = c

    def log_p(context, w):
        for k in range(len(context)):
            if context[k:] in model:
                entries, rest = model[context[k:]]
                return entries[w] if w in entries else rest + log_p(context[k + 1:], w)
        return root(w)

    for context in sorted(followers, key=len):
        total, entries = counts[context], {}
        for w, c in followers[context].items():
            p, q = math.log((c - settings.discount) / total), log_p(context[1:], w)
            if abs(p - q) > 0.05:
                entries[w] = (p, q, c)
        own, theirs = (sum(math.exp(e[k]) for e in entries.values()) for k in (0, 1))
        rest = math.log(min(max(1 - own, 1e-6), 1)) - math.log(min(max(1 - theirs, 1e-6), 1))
        gain = sum(c * (p - q) for p, q, c in entries.values()) + (total - sum(e[2] for e in entries.values())) * rest
        if gain > settings.entry_cost * math.log(max(n, 2)) * (1 + len(entries)) and own < 1 - 1e-6 and theirs < 1 - 1e-6:
            model[context] = {w: e[0] for w, e in entries.items()}, rest
    out = []
    for t in texts:
        w = split(t)
        out.append(sum(log_p(tuple(w[max(0, i - settings.depth):i]), w[i]) for i in range(1, len(w))) / math.log(10))
    return out, model


def scores(spark, train, texts, settings):
    train = spark.createDataFrame([(t,) for t in train], "text string").repartition(3)
    words = stored(op.word_counts(train), "test")
    tree = op.fit(train, words, settings)
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    return [r.score for r in op.score(docs, tree, words).orderBy("doc_id").collect()], tree


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(8)
    phrases = [" ".join(draw.choice("abcdefghijklmnop") * draw.randint(1, 2) for _ in range(draw.randint(2, 5))) for _ in range(40)]
    texts = [" ".join(draw.choice(phrases) for _ in range(draw.randint(0, 12))) for _ in range(300)]
    return [*texts, None, "", *["so Rare a phrase"] * 4]


@pytest.mark.parametrize("hot, depth", [(0.0, 2), (0.004, 3), (0.05, 2), (1.0, 1)])
def test_scores_agree_with_a_plain_tree_whatever_is_hot(spark, corpus, hot, depth):
    settings = op.Settings(hot=hot, depth=depth)
    texts = [*corpus, "so rare a", "unseen words so rare a phrase", "a b c a b c"]
    expected, model = plain_scores(corpus, texts, settings)
    assert len({len(c) for c in model}) == depth
    assert scores(spark, corpus, texts, settings)[0] == pytest.approx(expected)


def test_full_filters_change_nothing(spark, corpus, monkeypatch):
    settings = op.Settings(hot=0.05)
    monkeypatch.setattr(op, "FILTER_BITS", 6)
    monkeypatch.setattr(op, "TOKENS", 50)
    assert scores(spark, corpus, corpus, settings)[0] == pytest.approx(plain_scores(corpus, corpus, settings)[0])


def test_a_rare_phrase_is_modelled_in_a_large_corpus_too(spark):
    """The phrase's words are 1e-5, its pairs and triples 1e-5 of the corpus, less than what contexts once had to be."""
    draw = random.Random(9)
    large = [" ".join(f"w{draw.randrange(2000)}" for _ in range(1000)) for _ in range(400)]
    phrase = "zig zag zog"
    with_it, without = scores(spark, [*large, *[phrase] * 4], [phrase, "zog zig zag"], op.Settings())[0]
    assert with_it > without + 4
