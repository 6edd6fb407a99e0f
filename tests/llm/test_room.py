import tracemalloc

import numpy as np

from kithgraph.llm import phrases, pitman_yor


class Held:
    def __init__(self, value):
        self.value = value


def peak(run) -> int:
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_stirling_numbers_are_made_once():
    assert pitman_yor.stirling(0.4, 64) is pitman_yor.stirling(0.4, 64)


def test_suffix_array_and_filters_stay_small():
    """Bytes for each code: 8-byte hashes and places of all codes at once took over 40."""
    rng = np.random.default_rng(0)
    n = 1_000_000
    codes = np.where(rng.random(n) < 0.1, 0, rng.integers(1, 60000, n)).astype(np.int32)
    filters = [Held(phrases.Filter([(0, rng.integers(0, 256, 1 << 18, dtype=np.uint8).tobytes())], 1 << 21)) for _ in range(3)]
    h = rng.integers(1, 1 << 63, n).astype(np.uint64)
    assert peak(lambda: phrases.suffix_array(codes, 4)) < 40 * n
    assert peak(lambda: phrases._masked(codes, h, filters, 3)) < 30 * n
