"""What the driver holds of the labelled rows."""

import numpy as np

from pairloom.llm import quality


def test_packed_rows_stay_in_four_bytes(spark):
    """Pipeline: the driver held each entry thrice, twice of it in eight bytes and more."""
    rows = [(k, k % 2, np.arange(k % 5, dtype=np.uint32).tobytes(), np.full(k % 5, k, np.float32).tobytes()) for k in (9, 3, 7, 5, 12, -4)]
    c, x, at, label = quality.packed(spark.createDataFrame(rows, "k long, label int, c binary, x binary").repartition(5))
    assert (c.dtype, x.dtype) == (np.uint32, np.float32)
    order = sorted(rows)
    assert at.tolist() == np.cumsum([0] + [k % 5 for k, *_ in order]).tolist() and label.tolist() == [r[1] for r in order]
    assert c.tolist() == [i for k, *_ in order for i in range(k % 5)] and x.tolist() == [k for k, *_ in order for _ in range(k % 5)]


def test_no_rows(spark):
    c, x, at, label = quality.packed(spark.createDataFrame([], "k long, label int, c binary, x binary"))
    assert len(c) == len(x) == len(label) == 0 and at.tolist() == [0]
