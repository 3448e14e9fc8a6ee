"""Pearson correlations of many columns by mergeable co-moment matrices.

Each task keeps, for every pair of columns, the count, both means, both sums of
squares and the sum of products about the means, over the rows where both are
present: six matrices, whatever the number of rows. An Arrow batch is one set of
matrix products (values, and 0/1 masks of the present ones), shifted by the
batch's own column means, so values near 1e9 lose nothing; batches and tasks are
merged by the pairwise update of moments. A task sends its matrices by rows, one
shuffle deals the rows out and each receiver merges them as they come. No row of
the table is fanned out over pairs, and no task or driver holds more than the
matrices.

The functions that run in tasks hold all they need, so the package need not be
installed there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import as_double

_ARRAYS = ("n", "ma", "mb", "qa", "qb", "c")


def correlations(df: DataFrame, cols: Sequence[str], firsts: Sequence[int] | None = None) -> DataFrame:
    """(a, b, r): pairwise-complete Pearson r of columns ``cols[a]`` and
    ``cols[b]``, for a in ``firsts`` (default: all) and every b; null when a side
    is constant over the shared rows or there are none."""
    firsts, d = list(range(len(cols)) if firsts is None else firsts), len(cols)
    wide = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(cols)])

    def merge(total, part):
        """Pairwise update; both are tuples of arrays in the order of _ARRAYS."""
        import numpy as np
        if total is None:
            return part
        (n1, a1, b1, qa1, qb1, c1), (n2, a2, b2, qa2, qb2, c2) = total, part
        n = n1 + n2
        with np.errstate(all="ignore"):
            share, both = np.where(n > 0, n2 / np.maximum(n, 1), 0.0), np.where(n > 0, n1 * n2 / np.maximum(n, 1), 0.0)
            da, db = np.where(n1 * n2 > 0, a2 - a1, 0.0), np.where(n1 * n2 > 0, b2 - b1, 0.0)
            a = np.where(n1 > 0, a1 + da * share, a2)
            b = np.where(n1 > 0, b1 + db * share, b2)
            return n, a, b, qa1 + qa2 + da * da * both, qb1 + qb2 + db * db * both, c1 + c2 + da * db * both

    def partial(batches):
        import numpy as np
        import pyarrow as pa
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64, copy=False)
            there = ~np.isnan(x)
            with np.errstate(all="ignore"):
                shift = np.where(there, x, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
                x = np.where(there, x - shift, 0.0)
                m, xa, ma = there.astype(np.float64), x[:, firsts], there[:, firsts].astype(np.float64)
                n = ma.T @ m
                safe = np.maximum(n, 1)
                sa, sb = xa.T @ m, ma.T @ x
                qa, qb, c = (xa * xa).T @ m, ma.T @ (x * x), xa.T @ x
                # a side that is constant over the shared rows leaves only rounding here
                va, vb = qa - sa * sa / safe, qb - sb * sb / safe
                va, vb = np.where(va <= 1e-13 * qa, 0.0, va), np.where(vb <= 1e-13 * qb, 0.0, vb)
                part = (n, shift[firsts][:, None] + sa / safe, shift[None, :] + sb / safe, va, vb, c - sa * sb / safe)
            total = merge(total, part)
        if total is not None:
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int32()), *[pa.array(list(t), kind) for t in total]], ["a", *names])

    def finish(batches):
        import numpy as np
        import pyarrow as pa
        totals = {}
        for batch in batches:
            arrays = [np.array(batch.column(k + 1).flatten()).reshape(-1, d) for k in range(len(names))]
            for row, a in enumerate(batch.column(0).to_pylist()):
                totals[a] = merge(totals.get(a), tuple(t[row] for t in arrays))
        for a, (n, ma, mb, qa, qb, c) in totals.items():
            with np.errstate(all="ignore"):
                # a spread below a mean's own rounding is a constant side
                qa, qb = np.where(qa <= n * (1e-14 * ma) ** 2, 0.0, qa), np.where(qb <= n * (1e-14 * mb) ** 2, 0.0, qb)
                below = np.sqrt(qa) * np.sqrt(qb)
                r = c / below
            yield pa.RecordBatch.from_arrays([pa.array([a] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(r, mask=(below == 0) | (n == 0))],
                                             ["a", "b", "r"])

    names = _ARRAYS
    parts = wide.mapInArrow(partial, "a int, " + ", ".join(f"{x} array<double>" for x in names))
    return parts.repartition(F.col("a")).mapInArrow(finish, "a int, b int, r double")
