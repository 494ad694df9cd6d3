"""Results as sorted rows that two engines agree on."""

import pandas as pd


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 6)
    return v


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(v) for v in r]) for r in df[names].astype(object).values.tolist())
