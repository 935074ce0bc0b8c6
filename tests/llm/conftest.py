import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Seeded invented words: prose(rng, n) gives n of them."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(1, 7))) for _ in range(250)]

    def make(r: random.Random, n: int) -> list[str]:
        return [r.choice(words) for _ in range(n)]
    return make
