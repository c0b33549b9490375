"""Columns that tasks hand on: equal to what pyarrow makes, and without loading pandas."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tablework.llm.common import arrow_column, rows_at

COLUMNS = [
    (pa.int64(), [1, None, -(2**63), 2**63 - 1]), (pa.int32(), [None, None]), (pa.int32(), []), (pa.float64(), [0.5, None, float("inf"), -0.0]), (pa.bool_(), [True, None, False, True, True, True, True, True, True]),
    (pa.binary(), [b"", None, b"a\x00b", b"\xff" * 300]), (pa.string(), ["", None, "日本🙂", "a"]), (pa.string(), []), (pa.list_(pa.int64()), [[1, None], None, [], [3]]), (pa.list_(pa.string()), [["a", ""], []]),
    (pa.list_(pa.list_(pa.int32())), [[[1], None], [[]], None]), (pa.list_(pa.int64()), [np.array([1, 2]), np.array([3])]), (pa.list_(pa.int64()), []), (pa.int64(), np.arange(5)), (pa.int64(), np.arange(6, dtype=np.int32)[::2]),
    (pa.int32(), np.arange(3)), (pa.bool_(), np.arange(11) % 3 == 0), (pa.float32(), np.float32([1, 2])), (pa.decimal128(5, 2), [None]), (pa.struct([("a", pa.int64())]), [{"a": 1}, None]),
]


@pytest.mark.parametrize("kind, values", COLUMNS)
def test_columns_equal_those_of_pyarrow(kind, values):
    made = arrow_column(values, kind)
    made.validate(full=True)
    want = pa.array(values, type=kind)
    assert made.type == kind and made.equals(want) and made.null_count == want.null_count
    if len(want):
        assert rows_at(made, [len(want) - 1, 0, 0]).equals(want.take(pa.array([len(want) - 1, 0, 0])))


def test_pandas_is_not_loaded():
    code = (
        "import sys; import numpy as np, pyarrow as pa; from tablework.llm.common import arrow_column, rows_at; before = 'pandas' in sys.modules\n"
        "x = arrow_column([b'a', None], pa.binary()); rows_at(x, [1]).to_pylist(); np.from_dlpack(arrow_column(np.arange(3), pa.int64())[1:])\n"
        "arrow_column([[1], None], pa.list_(pa.int64())); pa.RecordBatch.from_arrays([x], schema=pa.schema([('x', pa.binary())])); print(before, 'pandas' in sys.modules)"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout
    assert out.split()[-2:] == ["False", "False"]
