import pytest

WORDS = "the of and in to is on that by this with from or had not are but at for all been have one two some many".split()


@pytest.fixture
def prose():
    """Invented prose of a given number of words, the same for the same seed."""
    import random

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["a", "e", "ing", "er", "ly"]) * rng.randint(0, 2) for _ in range(n))
    return make
