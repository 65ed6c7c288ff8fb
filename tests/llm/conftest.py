import random

import pytest


@pytest.fixture
def prose():
    """Made-up sentences from a seeded vocabulary."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]

    def make(n, seed):
        r = random.Random(seed)
        return [r.choice(vocabulary) for _ in range(n)]

    return make
