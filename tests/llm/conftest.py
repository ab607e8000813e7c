import random

import pytest


@pytest.fixture
def folder(tmp_path):
    """Writes frames as the tables of a data folder."""
    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


@pytest.fixture
def prose():
    """Invented texts from a seed."""
    def make(n_words, seed):
        rng = random.Random(seed)
        parts = ["ka", "lo", "mi", "ret", "sun", "ta", "ber", "fe", "gil", "do", "ñu", "vé"]
        return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n_words))
    return make
