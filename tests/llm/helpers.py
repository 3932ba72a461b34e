"""Brute force in plain Python, and a small corpus with every awkward case."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, words string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, width=5):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghiklmnoprstuü") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def corpus(seed=3):
    """Rows of (doc_id, text, source): copies, near copies, chains, long, short, empty, null."""
    rng = random.Random(seed)
    vocab = vocabulary(rng)
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [None, "", "   \n\t ", "one", "One", "two words", "a b c d", "a b c d e", "x" * 5000, " ".join(["again"] * 300), "line\nline\nline"]
    bases = [say(rng.choice((30, 80, 200))) for _ in range(12)]
    for base in bases:
        texts += [base] * rng.randint(1, 3) + [base.upper()]
        near = base.split()
        for _ in range(rng.randint(0, 6)):  # each copy departs from the last one: a chain
            near = list(near)
            near[rng.randrange(len(near))] = rng.choice(vocab)
            texts.append(" ".join(near))
    texts += [say(6000), say(60) + "\n" + bases[0] + "\n" + say(40), "\n".join(say(8) for _ in range(30))]
    rng.shuffle(texts)
    return [(i, t, rng.choice(["s0", "s0", "s0", "s1", "s2", None])) for i, t in enumerate(texts)]


def frame(spark, rows, parts=5):
    """Extra columns carry names that operators use inside."""
    full = [(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
