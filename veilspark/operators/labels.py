"""Form labels and the values beside or below them."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy_values as V
from ..functions.text import normalized, redactable
from ..policy import java
from .layout import by_page

LABEL = java(rf"(?i)^\s*(?:{V.LABEL_NAME})\s*(?::|-)?\s*$")
LABEL_VALUE = java(rf"(?i)^\s*(?:{V.LABEL_NAME})\s*[:|-]\s*(.+)$")


def label_value(x: Column) -> Column:
    """The value that shares a line with its label, or null."""
    return F.when(x.rlike(LABEL_VALUE), F.regexp_extract(x, LABEL_VALUE, 1))


def is_label(x: Column) -> Column:
    return x.rlike(LABEL)


def is_firm(x: Column) -> Column:
    """A firm word and an organisation marker in at most ten words."""
    return x.rlike(java(V.FIRM)) & x.rlike(java(V.ORGANIZATION)) & (F.size(F.split(F.trim(x), java(r"\s+"))) <= 10)


def is_map_label(x: Column) -> Column:
    return x.rlike(java(V.MAP_LABEL))


_BOX = ("x0", "y0", "x1", "y1")
_VALUES = 256  # a block of values meets a block of labels at once
_LABELS = 512
_PAIRS = 1 << 19  # pairs in a batch of rows


def _over(v, l, lo: int, hi: int):  # noqa: E741
    """Whether extents overlap as SQL has it: nulls are left out, NaN is above all numbers. Rectangles are (values, nulls), each with four rows."""
    import numpy as np

    (v, vn), (l, ln) = v, l  # noqa: E741
    if vn is None:
        return np.minimum(v[hi], l[hi][:, None]) > np.maximum(v[lo], l[lo][:, None])
    low = np.maximum(np.where(vn[lo], -np.inf, v[lo]), np.where(ln[lo], -np.inf, l[lo])[:, None])
    high = np.fmin(v[hi], l[hi][:, None])
    known = ~(vn[hi] & ln[hi][:, None]) & ~(vn[lo] & ln[lo][:, None])
    return known & ((high > low) | (np.isnan(high) & ~np.isnan(low)))


def _aligned(v, l, wide: float, flat: bool):  # noqa: E741
    """A mask of labels by values: which rectangles are aligned; without nulls and odd numbers the masks of nulls are None."""
    import numpy as np

    (a, an), (b, bn) = v, l
    width = np.maximum(1.0, b[2] - b[0]) if bn is None else np.where(bn[0] | bn[2], 1.0, np.maximum(1.0, b[2] - b[0]))
    limit = np.maximum(wide, width * 0.5)
    near = np.abs(a[0] - b[0][:, None]) <= limit[:, None]
    if an is not None:
        near = (near | np.isnan(limit)[:, None]) & ~an[0] & ~bn[0][:, None]
    if near.all():
        return near
    return near | (_over(v, l, 0, 2) & _over(v, l, 1, 3) if flat else _over(v, l, 0, 2))


def _ends(start, y1, null, deepest, known, reach: float):
    """For each label the first place from ``start`` whose deepest line is too far down, or the number of places."""
    import numpy as np

    n, tables = len(deepest), [deepest]
    while 2 << (len(tables) - 1) <= n:  # tables[k][i]: the deepest of 2^k places from i
        step = 1 << (len(tables) - 1)
        tables.append(np.maximum(tables[-1][:-step], tables[-1][step:]))
    at = start.copy()
    for k in range(len(tables) - 1, -1, -1):
        inside = at + (1 << k) <= n
        ahead = tables[k][np.minimum(at, len(tables[k]) - 1)]
        at += np.where(inside & (ahead - y1 <= reach), 1 << k, 0)
    odd = np.isnan(y1) | (y1 == -np.inf)  # any line that has a place is too far down
    if odd.any():
        places = np.append(np.flatnonzero(known), n)
        at[odd] = places[np.searchsorted(places, np.minimum(start[odd], n))]
    return np.where(null, n, at)


def _sweep(keys: list[str], reach: float, scale: float, mode: str, schema):
    """One pass over lines in the order of (page, ord), for mapInArrow; it holds a batch, the lines of its last ord and the open labels."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def changed(column):
            if pa.types.is_nested(column.type):
                values = column.to_pylist()
                return np.array([a != b for a, b in zip(values[1:], values[:-1], strict=True)], bool)
            return pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)

        def taken(column, index):
            return column.take(pa.array(index))

        def lists(column, index, sizes):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), taken(column, np.concatenate(index)))

        page, box, null, weight, oid, label_ord, label = None, np.zeros((4, 0)), np.zeros((4, 0), bool), np.zeros(0, np.int64), np.zeros(0, np.int64), None, None

        def swept(x, g, first_of_page):
            """Whole ords: x, the ord's place of each line, and the places at which pages begin."""
            nonlocal page, box, null, weight, oid, label_ord, label
            col = {n: x.column(k) for k, n in enumerate(x.schema.names)}
            n = int(g[-1]) + 1
            rect = np.stack([pc.fill_null(col[k], np.nan).to_numpy(zero_copy_only=False) for k in _BOX])
            none = np.stack([col[k].is_null().to_numpy(zero_copy_only=False) for k in _BOX])
            fits, lone = (np.flatnonzero(col[k].to_numpy(zero_copy_only=False)) for k in ("fits", "lone"))
            if mode != "count":
                new_ord, new = taken(col["ord"], lone), taken(col["t"], lone)
                label_ord, label = (new_ord, new) if label is None else (pa.concat_arrays([label_ord, new_ord]), pa.concat_arrays([label, new]))
            here = [col[k][0].as_py() for k in keys]
            page_end = np.append(first_of_page[1:], n)
            old = len(weight)
            start = np.concatenate([np.zeros(old, np.int64), g[lone] + 1])
            stop = np.concatenate([np.full(old, page_end[0] if here == page else 0), page_end[np.searchsorted(first_of_page, g[lone], "right") - 1]])
            box, null = np.concatenate([box, rect[:, lone]], 1), np.concatenate([null, none[:, lone]], 1)
            weight, oid = np.concatenate([weight, np.ones(len(lone), np.int64)]), np.concatenate([oid, g[lone]])
            firsts = np.flatnonzero(np.diff(g, prepend=-1))
            deep = np.where(none[1], -np.inf, np.where(np.isnan(rect[1]), np.inf, rect[1]))
            close = _ends(start, box[3], null[3], np.maximum.reduceat(deep, firsts), np.logical_or.reduceat(~none[1], firsts), reach)
            end, done = np.minimum(close, stop), np.zeros(len(weight), bool)
            odd_label, odd_line = ~np.isfinite(box).all(0), ~np.isfinite(rect).all(0)
            made, size = [], 0
            for b in range(0, len(fits), _VALUES):
                lines = fits[b : b + _VALUES]
                place = g[lines]
                live = np.flatnonzero((start <= place[-1]) & (end > place[0]) & ~done)
                v, hits, count = rect[:, lines], [], np.zeros(len(lines), np.int64)
                for c in range(0, len(live), _LABELS):
                    some = live[c : c + _LABELS]
                    odd = odd_label[some].any() or odd_line[lines].any()
                    mask = _aligned((v, none[:, lines] if odd else None), (box[:, some], null[:, some] if odd else None), 36.0 * scale, scale == 1.0)
                    if start[some].max() > place[0] or end[some].min() <= place[-1]:
                        mask &= (place >= start[some][:, None]) & (place < end[some][:, None])
                    if mode == "count":
                        count += weight[some] @ mask
                    elif mode == "first":
                        any_ = np.flatnonzero(mask.any(1))
                        hits.append((some[any_], mask[any_].argmax(1)))
                    else:
                        pairs = np.flatnonzero(mask)
                        if len(pairs):
                            made.append((some, lines, pairs // len(lines) * _VALUES + pairs % len(lines)))
                            size += len(pairs)
                if mode == "count":
                    made.append((lines[count > 0], count[count > 0]))
                elif mode == "first" and hits:  # labels of one ord share their first value
                    of, at = (np.concatenate(h) for h in zip(*hits, strict=True))
                    order = np.lexsort((of, at, oid[of]))
                    of, at = of[order], at[order]
                    once = np.flatnonzero(np.diff(oid[of], prepend=np.iinfo(np.int64).min))
                    made.append((of[once], lines[at[once]]))
                    done |= np.isin(oid, oid[of])
                elif size >= _PAIRS:
                    yield emit(col, made)
                    made, size = [], 0
            if made:
                yield emit(col, made)
            page = [col[k][-1].as_py() for k in keys]
            keep = np.flatnonzero((close == n) & (stop == n) & ~done)
            if mode == "count":  # equal rectangles go one way
                _, of, inverse = np.unique(np.concatenate([box[:, keep], null[:, keep]]).T, axis=0, return_index=True, return_inverse=True)
                weight, keep = np.bincount(inverse.ravel(), weight[keep], len(of)).astype(np.int64), keep[of]
            else:
                weight, label_ord, label = weight[keep], taken(label_ord, keep), taken(label, keep)
            box, null, oid = box[:, keep], null[:, keep], -1 - np.unique(oid[keep], return_inverse=True)[1].astype(np.int64)

        def emit(col, made):
            if mode == "count":
                at, count = (np.concatenate(m) for m in zip(*made, strict=True))
                arrays = [taken(col["t"], at), pa.array(count)]
            elif mode == "first":
                of, at = (np.concatenate(m) for m in zip(*made, strict=True))
                arrays = [*[taken(col[k], at) for k in keys], taken(label_ord, of), taken(col["ord"], at), taken(label, of), *[taken(col[k], at) for k in ("t", "raw", *_BOX)]]
            else:
                of, at, pairs = zip(*made, strict=True)
                n_of, n_at = [len(x) for x in of], [len(x) for x in at]
                value = {k: lists(col[k], at, n_at) for k in (*keys, "ord", "t", "raw", *_BOX)}
                codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in pairs])]), pa.int32()), pa.array(np.concatenate(pairs), pa.int32()))
                arrays = [*[value[k] for k in keys], lists(label_ord, of, n_of), value["ord"], lists(label, of, n_of), *[value[k] for k in ("t", "raw", *_BOX)], codes]
            return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

        def whole(x, last):
            """Sweeps the lines of all ords that have ended and returns the others."""
            new_page = np.append(True, np.logical_or.reduce([changed(x.column(k)) for k in range(len(keys))]))
            new_ord = new_page | np.append(True, changed(x.column(len(keys))))
            cut = x.num_rows if last else int(np.flatnonzero(new_ord)[-1])
            if cut:
                g = np.cumsum(new_ord[:cut]) - 1
                yield from swept(x.slice(0, cut), g, g[new_page[:cut]])
            return x.slice(cut)

        left = None
        with np.errstate(invalid="ignore"):
            for batch in batches:
                if batch.num_rows:
                    x = batch if left is None or not left.num_rows else pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
                    left = yield from whole(x, False)
            if left is not None and left.num_rows:
                yield from whole(left, True)

    return run


def _swept(lines: DataFrame, page: tuple[str, ...], reach: float, scale: float, value_wins: bool, mode: str) -> DataFrame:
    from pyspark import cloudpickle
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package
    text = F.col("__t")
    alone = is_label(text) & (label_value(F.col("text")).isNull() if value_wins else F.lit(True))
    fits = redactable(text, True) & (F.size(F.split(text, java(r"\s+"))) <= 10) & ~is_label(text)
    x = by_page(lines, page).where(" and ".join(f"{k} is not null" for k in (*page, "ord"))).withColumn("__t", F.explode(F.array(normalized(F.col("text")))))
    x = x.select(*page, "ord", "text", "__t", F.coalesce(alone, F.lit(False)).alias("lone"), F.coalesce(fits, F.lit(False)).alias("fits"), *[F.col(k).cast("double").alias(k) for k in _BOX])
    x = x.select(*page, "ord", F.when(F.col("lone") | F.col("fits"), F.col("__t")).alias("t"), F.when(F.col("fits"), F.col("text")).alias("raw"), "lone", "fits", *_BOX)
    x = x.sortWithinPartitions(*page, "ord")
    kinds = x.schema
    if mode == "count":
        out = StructType().add("value", "string").add("labels", LongType())
    else:
        out = StructType()
        for k in page:
            out = out.add(k, kinds[k].dataType)
        out = out.add("label_ord", kinds["ord"].dataType).add("value_ord", kinds["ord"].dataType).add("label", "string").add("value", "string").add("raw", "string")
        for k in _BOX:
            out = out.add(k, "double")
    if mode != "all":
        return x.mapInArrow(_sweep(list(page), reach, scale, mode, to_arrow_schema(out)), out)
    # a row is a block of labels and values with the pairs as numbers; pairs become rows only here, so they aren't moved with their texts
    blocks = StructType([StructField(f.name, ArrayType(f.dataType)) for f in out]).add("pairs", ArrayType(IntegerType()))
    pairs = x.mapInArrow(_sweep(list(page), reach, scale, mode, to_arrow_schema(blocks)), blocks).withColumn("__k", F.explode("pairs"))
    at = {True: F.shiftright("__k", _VALUES.bit_length() - 1), False: F.col("__k").bitwiseAND(_VALUES - 1)}
    return pairs.select(*[F.get(c, at[c in ("label_ord", "label")]).alias(c) for c in out.names])


def following_values(lines: DataFrame, page: tuple[str, ...] = ("doc_id",), reach: float = 120.0, only_first: bool = False, scale: float = 1.0, value_wins: bool = False) -> DataFrame:
    """(page, label_ord, value_ord, label, value, raw, x0, y0, x1, y1): label-only lines with the aligned value lines below them.

    lines(*page, ord, text, x0, y0, x1, y1). A label's search ends at the first later line (by ``ord``) that begins more than
    ``reach`` points under it, whatever comes after. Lines are read once, in their order, beside the labels whose search is
    open (no built-in function has "the first later line beyond a bound that differs by row"): memory holds a batch and the open
    labels, and pairs are numbers until they become rows. A label whose search never ends pairs with all later aligned lines. ``only_first`` keeps the nearest value of each label; ``scale`` is pixels a
    point; with ``value_wins`` a line that holds its own value is no label for others.
    """
    return _swept(lines, page, reach, scale, value_wins, "first" if only_first else "all")


def following_counts(lines: DataFrame, page: tuple[str, ...] = ("doc_id",), reach: float = 120.0) -> DataFrame:
    """(value, labels): each line that is a value, with the number of ``following_values`` pairs that it is in; no pair is made, open labels with one rectangle are one."""
    return _swept(lines, page, reach, 1.0, False, "count")
