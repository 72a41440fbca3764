"""Order-free comparison of a result with the oracle's."""

import pandas as pd


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        try:
            out[c] = out[c].astype("float64").round(6) + 0.0
        except (TypeError, ValueError):
            out[c] = out[c].astype(str).str.replace(" 00:00:00", "")
    return out.astype(str).sort_values(list(out.columns)).reset_index(drop=True)


def assert_same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    assert sorted(ours.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(normal(ours), normal(theirs))
