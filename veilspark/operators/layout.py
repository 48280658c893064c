"""Words to lines, lines to blocks and pages, each with character offsets."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tasks(df: DataFrame) -> int:
    """How many parts costly rows are dealt to: a few for each core, however few splits a small or narrow input has."""
    session = df.sparkSession
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), 3 * session.sparkContext.defaultParallelism)


def by_page(lines: DataFrame, page: tuple[str, ...]) -> DataFrame:
    """The same rows, pages whole: what is grouped or swept by page (and block) afterwards moves no more, and the number of parts is kept as given."""
    return lines.repartition(tasks(lines), *page)


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, text, x0, y0, x1, y1): the lines of plain texts with a made-up geometry of 20 points a line; blank lines count but go."""
    rows = docs.select(key, F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")).alias("line", "text"))
    y = F.col("line") * 20
    return rows.where(F.trim("text") != "").select(key, "line", "text", F.lit(0.0).alias("x0"), y.cast("double").alias("y0"), F.lit(100.0).alias("x1"), (y + 12).cast("double").alias("y1"))


def lines_of_words(words: DataFrame, keys: tuple[str, ...] = ("doc_id", "page", "block", "line"), order: str = "word", glue: str = " ") -> DataFrame:
    """Words grouped to lines in stream order, with the union of their boxes."""
    grouped = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("w"), *[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])
    return grouped.select(*keys, F.array_join(F.transform("w", lambda t: t["text"]), glue).alias("text"), "x0", "y0", "x1", "y1")


def with_offsets(lines: DataFrame, scope: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Adds start and end of each line in its scope's text (lines joined by a line break)."""
    before = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return lines.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def joined_text(lines: DataFrame, scope: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One text for each scope: its lines in order, joined by line breaks; (block, line) order for pages, not geometry."""
    parts = F.sort_array(F.collect_list(F.struct(*order, "text")))
    return lines.groupBy(*scope).agg(parts.alias("p")).select(*scope, F.array_join(F.transform("p", lambda t: t["text"]), "\n").alias("text"))


def span_lines(found: DataFrame, lines: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Matches (start, end in their scope's text) to the lines that they overlap, with the part of each line."""
    x = lines.select(*scope, F.col("line").alias("line"), F.col("start").alias("ls"), F.col("end").alias("le"))
    both = found.join(x, list(scope)).where("le > start and ls < end")
    return both.withColumn("line_start", F.expr("greatest(0, start - ls)")).withColumn("line_end", F.expr("least(le - ls, end - ls)")).drop("ls", "le")


def page_kind(pages: DataFrame, chars: str = "chars", ratio: str = "ratio") -> DataFrame:
    """searchable, mixed or raster, and whether a page needs the raster pass."""
    c, r = F.col(chars), F.col(ratio)
    return pages.withColumn("page_kind", F.when((c >= 20) & (r >= 0.02), "mixed").when(c >= 20, "searchable").otherwise("raster")).withColumn("needs_raster", (c < 20) | (r >= 0.02))


def _clusters(schema):
    """One pass over words in the order of (doc_id, page, cy, x), for mapInArrow; it holds a batch and the open row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def fresh(column):
            return np.append(True, pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False) | np.diff(column.is_null().to_numpy(zero_copy_only=False).astype(np.int8)).astype(bool))

        def number(column):
            return pc.fill_null(column, np.nan).to_numpy(zero_copy_only=False)

        held, open_row, total, size = None, 0, 0.0, 0  # the words of the open row, its number in its page, the sum and number of its centres

        def clustered(x, old, last):
            """Rows that have ended; ``old`` words at the front are the open row, which stays one."""
            nonlocal held, open_row, total, size
            n = x.num_rows
            new_page = fresh(x.column(0)) | fresh(x.column(1))
            cy, h = number(x.column(2)), number(x.column(5))
            reach = np.fmax(8.0, 0.6 * h).tolist()
            begins = new_page.copy()
            for i, c, r, page in zip(range(old, n), cy[old:].tolist(), reach[old:], new_page[old:].tolist(), strict=True):
                if page or not abs(c - total / size) <= r:
                    begins[i], total, size = True, c, 1
                else:
                    total += c
                    size += 1
            starts = np.flatnonzero(begins)
            row = np.cumsum(begins) - 1
            page_at = np.flatnonzero(new_page)
            before = row[page_at][np.cumsum(new_page) - 1]  # the row that its page begins with
            in_page = row - before + np.where(np.cumsum(new_page) == 1, open_row if old else 0, 0)
            cut, open_row = n if last else int(starts[-1]), int(in_page[-1])
            held = x.slice(cut)
            if not cut:
                return
            left, width = number(x.column(3))[:cut], number(x.column(4))[:cut]
            limit = np.fmax(100.0, 4 * np.fmax.reduceat(h[:cut], starts[starts < cut]))
            order = np.lexsort((left, row[:cut]))  # stable: words at one edge stay from top to bottom
            left, width, row = left[order], width[order], row[:cut][order]
            edge = np.append(True, (row[1:] != row[:-1]) | (left[1:] - (left[:-1] + width[:-1]) > limit[row[1:]]))
            parts = np.flatnonzero(edge)
            ordinal = np.arange(len(parts))
            first_part = np.flatnonzero(np.diff(row[parts], prepend=-1))
            segment = ordinal - first_part[row[parts]]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(parts, cut), pa.int32()), x.column(6).take(pa.array(order))), " ")
            at = pa.array(order[parts])
            arrays = [x.column(0).take(at), x.column(1).take(at), pa.array(in_page[order[parts]]), pa.array(segment), texts]
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

        for batch in batches:
            if batch.num_rows:
                old = held.num_rows if held is not None else 0
                yield from clustered(pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if old else batch, old, False)
        if held is not None and held.num_rows:
            yield from clustered(held, held.num_rows, True)

    return run


def cluster_rows(words: DataFrame) -> DataFrame:
    """Words of each page to rows by a running mean of centres, rows to segments at wide gaps (order-dependent, so swept in Python).

    words(doc_id, page, text, x, y, w, h) to (doc_id, page, row, segment, text). Words are read once in the order of their
    centres; many small pages share a batch, of a large page only the open row is held. Words at the same place are ordered
    by width, height and text.
    """
    from pyspark import cloudpickle
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, LongType, StringType, StructType

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package
    out = StructType().add("doc_id", LongType()).add("page", IntegerType()).add("row", IntegerType()).add("segment", IntegerType()).add("text", StringType())
    x, y, w, h = (F.col(k).cast("double") for k in "xywh")
    placed = words.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), (y + h / 2).alias("cy"), x.alias("x"), w.alias("w"), h.alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    placed = by_page(placed, ("doc_id", "page")).sortWithinPartitions("doc_id", "page", *[F.col(k).asc_nulls_last() for k in ("cy", "x", "w", "h", "text")])
    return placed.mapInArrow(_clusters(to_arrow_schema(out)), out)
