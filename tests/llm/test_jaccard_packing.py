"""What the Jaccard join sends: signatures as distances."""

import numpy as np
import pyarrow as pa

from tilewright.llm import jaccard_join as J


def test_signatures_travel_as_distances():
    """Every signature and its class arrive; about six bytes each after the shuffle's compression at 51 ranges (eight as plain words)."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**64, int(n), np.uint64)) for n in rng.integers(50, 500, 1100)]
    keys = [J.set_key(s) for s in sets]
    sig, own = J.signatures(sets)
    for ranges, bits, most in ((1, 48, 8), (51, 39, 6.5), (3000, 32, 10)):
        batch = J._packed(sets, keys, ranges, bits)
        met, sent = [], b""
        for _, s, o, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            met += zip(np.cumsum(J._from_planes(s, J.SIG_BYTES), dtype=np.uint64).tolist(), np.frombuffer(names, "<i8")[J._from_planes(o, 2).astype(int)].tolist(), strict=True)
            sent += s + o + names
        assert sorted(met) == sorted(zip((sig >> np.uint64(64 - bits)).tolist(), (keys[i] for i in own), strict=True))
        assert sum(len(pa.compress(sent[i : i + 32768], codec="lz4_raw", asbytes=True)) for i in range(0, len(sent), 32768)) < most * len(sig)
