import numpy as np

from riskweave.llm import quality


def test_rows_that_the_fit_does_not_see_may_be_of_one_kind():
    rows = [("sun moon sea" if y else "buy win now", y) for y in [0, 1, 1, 0] * 6]
    other = [(t if i % 4 < 3 else "other words", y) for i, (t, y) in enumerate(rows)]
    (w, *_), (v, slope, offset) = (quality.fit(x) for x in (rows, other))
    from riskweave.llm.words import Chunk

    chunk = Chunk(0, [b"other words"])
    own = {(k, int(p)) for k, (places, _) in enumerate(quality.families(chunk, chunk.hashes())) for p in places}
    chunk = Chunk(0, [b"sun moon sea buy win now"])
    own -= {(k, int(p)) for k, (places, _) in enumerate(quality.families(chunk, chunk.hashes())) for p in places}
    assert own and all(v[key] == 0 for key in own)  # every fourth row is not learnt from
    assert np.isfinite([slope, offset]).all() and slope > 0
