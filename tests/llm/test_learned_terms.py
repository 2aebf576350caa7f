"""Misspellings of terms as they are learned, where a word and its stems occur in the same texts."""

import random

from prismrank.llm import toxicity

ABUSE = ["trash", "idiot", "clown", "moron", "stupid", "pathetic"]


def test_learned_terms_match_misspellings(spark):
    rng = random.Random(5)
    texts = [(" ".join([f"w{rng.randrange(3000)}" for _ in range(30)] + rng.sample(ABUSE, 2)), 1) for _ in range(150)]
    texts += [(" ".join(f"w{rng.randrange(3000)}" for _ in range(30)), 0) for _ in range(400)]
    terms = toxicity.learn_terms(spark.createDataFrame(texts, "text string, toxic int"))
    trie = toxicity.FuzzyTrie(terms)
    for word in ABUSE:
        assert trie.find(word)[1] == 0 and trie.find(word + "like")[1] == 0  # the stem still matches longer words
        for i in range(len(word)):  # inside the stem as well as after it
            for wrong in (word[:i] + "z" + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + "z" + word[i:]):
                found = trie.find(wrong)
                assert found and found[1] <= 1, wrong
    assert len({(t.text, t.stem) for t in terms}) == len(terms)
