"""Misspellings that the lexicon must reach, and evidence that does not tighten as the sample grows."""

import random

from quantpanel.llm import toxicity as t


def test_swaps_and_two_edits_from_nine_letters():
    words = t.Lexicon({("worthless", False): 3.0, ("idiot", False): 2.0})
    for w in ("wrothless", "worhtless", "wortlhess", "worthlses", "owrthless", "wrothlses", "worthlsse", "wxrthlexs", "orthles"):
        assert words.match(w) == (2, 3.0), w
    for w in ("idoit", "diiot", "idito"):
        assert words.match(w) == (2, 2.0), w
    assert words.match("worxxxess") is None and words.match("doiit") is None and words.match("idiot") == (0, 2.0)


def test_every_word_within_the_edits_is_met():
    r, terms = random.Random(2), ["abcde", "abcabcab", "cabbacabc", "aabbccaabbcc"]
    words = t.Lexicon({(x, False): 1.0 for x in terms})
    for _ in range(20_000):
        x, w = (y := r.choice(terms)), list(y)
        for _ in range(t.allowed(len(x))):
            i = r.randrange(len(w) - 1)
            w[i : i + 2] = r.choice([w[i + 1 : i - 1 : -1] if i else w[1::-1], [w[i]], [w[i], r.choice("abc"), w[i + 1]], [r.choice("abc"), w[i + 1]]])
        w = "".join(w)
        if any(t.distance(t.automaton(y), len(y), w) <= t.allowed(len(y)) for y in terms):
            assert words.match(w) is not None, (x, w)


def sample(spark, n, seed=1):
    """A tenth toxic; one term in a fifth of them, one in 8 rows, one in a tenth of them and a hundredth of the rest."""
    r, rows = random.Random(seed), []
    for i in range(n):
        toxic, words = int(i % 10 == 0), [f"w{r.randrange(5000)}" for _ in range(20)]
        words += ["strongest"] if i % 50 == 0 else []
        words += ["seldom"] if toxic and i < 80 else []
        words += ["common"] if (i % 100 == 10 if toxic else i % 100 == 1) else []
        rows.append((" ".join(words), toxic))
    rows += [("one text that stands here often beside copyword and others", 1)] * 20
    return spark.createDataFrame(rows, "text string, toxic int").repartition(8)


def test_rare_terms_stay_as_the_sample_grows(spark):
    for n in (2000, 20_000):
        held = {x for x, _ in t.learn_lexicon(sample(spark, n))}
        assert {"strongest", "seldom"} <= held and "copyword" not in held, n
    assert "common" in held
