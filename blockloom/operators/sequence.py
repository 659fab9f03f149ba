"""Ordered grouping. Greedy groupings that compare with the first member of the running group (and not with
the previous row) number the sorted rows of a page or document in one linear pass; the others are windows.

For such a pass the rows of a page are one sorted array; only the columns that it needs go to Python, as flat Arrow
columns of many pages at once, and come back as one number for each row."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import numbers as N
from blockloom.functions import text as X
from blockloom.functions.geometry import upper_median

LINE = ["x0", "y0", "x1", "y1"]


def sorted_rows(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str = "rows") -> DataFrame:
    """One array of structs per key, in order. The only way in which ordered aggregates are built."""
    body = F.struct(*order, *[c for c in columns if c not in order])
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(body)).alias(name))


def numbered(rows: DataFrame, keys: list[str], order: list[str], needs: list[str], add: str, run: Callable[..., list[int]]) -> DataFrame:
    """Adds an int column: run(*columns) for the rows of each key in order, columns being lists of the columns in
    needs, gives a number for each row. run sees a key's rows once, so a linear run makes a linear operator."""
    packed = sorted_rows(rows, keys, order, [c for c in rows.columns if c not in keys])

    def each(*lists: pa.Array) -> pa.Array:
        sizes, columns, out, at = pc.list_value_length(lists[0]).to_pylist(), [x.flatten().to_pylist() for x in lists], [], 0
        for n in sizes:
            out.append(run(*[c[at : at + n] for c in columns]))
            at += n
        return pa.array(out, pa.list_(pa.int32()))

    numbers = F.arrow_udf(each, "array<int>")(*[F.col(f"rows.{c}") for c in needs])
    flat = packed.withColumn("_numbers", numbers).select(*keys, F.explode(F.arrays_zip("rows", F.col("_numbers").alias("n"))).alias("z"))
    return flat.select(*[F.col(c) if c in keys else F.col(f"z.rows.{c}") for c in rows.columns], F.col("z.n").alias(add))


def greedy_batches(rows: DataFrame, keys: list[str], order: str, size: Column, budget: int, most: int) -> DataFrame:
    """Adds batch_no: rows in order, a new batch where the next one would exceed the budget or the cap. A row
    above the budget is a batch of its own."""

    def run(sizes: list[int]) -> list[int]:
        out, no, used, held = [], -1, 0, 0
        for n in sizes:
            if no < 0 or used + n > budget or held >= most:
                no, used, held = no + 1, 0, 0
            used, held = used + n, held + 1
            out.append(no)
        return out

    return numbered(rows.withColumn("_size", size.cast("long")), keys, [order], ["_size"], "batch_no", run).drop("_size")


def request_batches(blocks: DataFrame, doc: str = "doc_id", budget: int = 4000, most: int = 25) -> DataFrame:
    """Request batches: a block costs its length, its number's digits and six characters."""
    return greedy_batches(blocks, [doc], "block_id", F.length("text") + F.length(F.col("block_id").cast("string")) + 6, budget, most)


def ir_groups(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds group_id, dense per document from 1: a run of text of one style on a page is a group, a table
    (page and table_ref) is one, and a verbatim block, heading or the like stands alone. blocks: page_no,
    block_id, role, in_table, table_ref, verbatim, size, bold, align, color."""
    order = Window.partitionBy(doc).orderBy("block_id")
    same_page = F.lag("page_no").over(order) == F.col("page_no")
    style = F.struct("size", "bold", "align", "color")
    joins = same_page & (F.col("role") == "text") & ~F.lag("in_table").over(order) & ~F.col("verbatim") & ~F.lag("verbatim").over(order) & (F.lag(style).over(order) == style)
    seen = F.row_number().over(Window.partitionBy(doc, "page_no", "table_ref", "in_table").orderBy("block_id"))
    starts = F.when(F.col("in_table"), (F.col("table_ref") == 0) | (seen == 1)).otherwise(~F.coalesce(joins, F.lit(False)))
    numbered = blocks.withColumn("_run", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first("_run").over(Window.partitionBy(doc, "page_no", "table_ref", "in_table").orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("group_id", F.when(F.col("in_table") & (F.col("table_ref") > 0), first).otherwise(F.col("_run"))).drop("_run")


def joinable(blocks: DataFrame) -> Column:
    """Plain prose that may be joined with its neighbours."""
    return (F.col("role") == "text") & ~F.col("in_table") & ~F.col("ocr") & ~F.col("is_chart") & ~F.col("keep_original") & ~X.is_entry(F.col("text"))


def prose_units(blocks: DataFrame, doc: str = "doc_id", most: int = 2400) -> DataFrame:
    """Adds unit_no per document: neighbouring joinable blocks of a group while the joined text is at most
    `most` long. blocks: block_id, group_id, text, joinable."""
    # What joining with the nearest text before would put between; only read where that is in the same unit.
    before = F.last(F.when(F.col("text") != "", F.substring("text", -1, 1)), ignorenulls=True).over(Window.partitionBy(doc).orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1))
    sized = blocks.withColumn("_before", before).withColumn("_length", F.coalesce(F.length("text"), F.lit(0))).withColumn("_gap", F.coalesce(F.length(X.join_separator(F.col("_before"), F.col("text"))), F.lit(0))).drop("_before")

    def run(groups: list[int], joins: list[bool], lengths: list[int], gaps: list[int]) -> list[int]:
        out, no, group, open_, size, said = [], -1, None, False, 0, False
        for g, joinable_, n, gap in zip(groups, joins, lengths, gaps, strict=True):
            longer = n if not size else size if not n else size + (gap if said else 0) + n
            if open_ and joinable_ and group is not None and g == group and longer <= most:
                size, said = longer, said or n > 0
            else:
                no, group, open_, size, said = no + 1, g, joinable_, n, n > 0
            out.append(no)
        return out

    return numbered(sized, [doc], ["block_id"], ["group_id", "joinable", "_length", "_gap"], "unit_no", run).drop("_length", "_gap")


def cluster_rows(items: DataFrame, keys: list[str], tolerance: float = 4.5) -> DataFrame:
    """Adds row_id: items by vertical centre; a new row where the centre is further than the tolerance
    from that of the row's FIRST item."""

    def run(centres: list[float]) -> list[int]:
        out, no, anchor = [], -1, None
        for c in centres:
            if anchor is None or c - anchor > tolerance:
                no, anchor = no + 1, c
            out.append(no)
        return out

    return numbered(items.withColumn("_c", (F.col("y0") + F.col("y1")) / 2), keys, ["_c", "item_no"], ["_c"], "row_id", run).drop("_c")


def merge_labels(cells: DataFrame, keys: list[str], gap: float = 20.0) -> DataFrame:
    """Fragments of one label joined: neighbours of a row (row_id, in x order) in one column (col_id), neither
    numeric, at most `gap` apart, the second not a note mark. Result: a row per label with its box."""
    body = sorted_rows(cells, [*keys, "row_id"], ["x0", "item_no"], ["y0", "x1", "y1", "text", "col_id", "numeric"])
    item = lambda r, text=None, **over: F.struct(*[over.get(n, r[n]).alias(n) for n in ("item_no", "x0", "y0", "x1", "y1", "col_id", "numeric")], (r["text"] if text is None else text).alias("text"))

    def step(acc, r):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & ~r["numeric"] & ~F.get(acc, F.size(acc) - 1)["numeric"] & (F.get(acc, F.size(acc) - 1)["col_id"] == r["col_id"])
        last = F.get(acc, F.size(acc) - 1)
        joins = joins & (r["x0"] - last["x1"] <= gap) & (last["text"] != "") & (r["text"] != "") & ~r["text"].rlike(X.NOTE_MARK)
        both = item(last, X.join_fragments(last["text"], r["text"]), y0=F.least(last["y0"], r["y0"]), x1=F.greatest(last["x1"], r["x1"]), y1=F.greatest(last["y1"], r["y1"]))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(item(r))))

    empty = F.filter(F.transform("rows", lambda r: item(r)), lambda r: F.lit(False))
    return body.select(*keys, "row_id", F.explode(F.aggregate("rows", empty, step)).alias("c")).select(*keys, "row_id", "c.*")


def prose_split(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Marks the table region among text rows (row_id, numeric, prose): the run of rows around the numeric ones
    up to the nearest prose row above the first and below the last. Adds in_table."""
    page = Window.partitionBy(*keys)
    first, last = F.min(F.when(F.col("numeric"), F.col("row_id"))).over(page), F.max(F.when(F.col("numeric"), F.col("row_id"))).over(page)
    marked = rows.withColumn("_first", first).withColumn("_last", last)
    top = F.max(F.when(F.col("prose") & (F.col("row_id") < F.col("_first")), F.col("row_id"))).over(page)
    end = F.min(F.when(F.col("prose") & (F.col("row_id") > F.col("_last")), F.col("row_id"))).over(page)
    inside = (F.col("row_id") > F.coalesce(top, F.lit(-1))) & (F.col("row_id") < F.coalesce(end, F.lit(1 << 30)))
    return marked.withColumn("in_table", F.col("_first").isNull() | inside).drop("_first", "_last")


def cell_texts(runs: DataFrame, keys: list[str], slack: float = 1.0) -> DataFrame:
    """One row per cell (keys, row, col) from its runs (line_no order; text, box): runs of one visual line (tops within
    `slack` of the line's first run) are joined by a space, lines by a line break. lines counts the visual lines."""
    cell = [*keys, "row", "col"]

    def lines(tops: list[float]) -> list[int]:
        out, no, at = [], -1, None
        for y in tops:
            if at is None or abs(y - at) > slack:
                no, at = no + 1, y
            out.append(no)
        return out

    placed = numbered(runs, cell, ["line_no"], ["y0"], "_line", lines)
    line = placed.groupBy(*cell, "_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), " ").alias("t"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    body = F.array_sort(F.collect_list(F.struct("_line", "t")))
    return line.groupBy(*cell).agg(F.array_join(F.transform(body, lambda r: r["t"]), "\n").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("lines"))


def ocr_grid(items: DataFrame, keys: list[str], least: int = 4, tolerance: float = 4.5) -> DataFrame:
    """The grid of scanned cells (item_no, text, box) of pages without a ruled table: row_id, col_id and the rectangle of every
    row and column. A page is a table with `least` cells, two rows, two columns and a column of figures."""
    placed = with_columns(cluster_rows(items, keys, tolerance), keys)
    figure = N.is_numeric_cell(F.col("text"))
    column = placed.groupBy(*keys, "col_id").agg(F.count(F.lit(1)).alias("n"), F.sum(figure.cast("int")).alias("f"), F.bool_or(figure & N.is_strong_figure(F.col("text"))).alias("strong"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    column = column.withColumn("numeric", (F.col("f") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.5))) & F.col("strong"))
    row = placed.groupBy(*keys, "row_id").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    shape = column.groupBy(*keys).agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("cols"), F.bool_or("numeric").alias("numeric")).join(row.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), keys)
    tables = shape.where((F.col("cells") >= least) & (F.col("rows") >= 2) & (F.col("cols") >= 2) & F.col("numeric")).select(*keys)
    return tables.join(row, keys).join(column.select(*keys, "col_id", "x0", "x1"), keys).select(*keys, "row_id", "col_id", "x0", "y0", "x1", "y1")


def continuation_pages(elements: DataFrame, keys: list[str], height: float, margin: float = 36.0, most_gap: float = 24.0) -> DataFrame:
    """Places of elements that moved off a page, on continuation pages of the same height: page (from 0), y and repeated (height
    of the table's header rows drawn before it). elements: ordinal, kind ("row" or "prose"), table_no, is_header, height,
    orig_y0, orig_y1, head (height of its table's header). A row is never cut; prose that doesn't fit begins a page and runs on over as many as it
    needs; the first body row of a table on a page repeats its header."""
    limit = height - margin

    def run(kinds: list[str], tables: list[int], headers: list[bool], heights: list[float], tops: list[float], ends: list[float], heads: list[float]) -> list[list[float]]:
        out, page, y, shown, last = [], -1, limit, set(), None
        for kind, table, header, h, top, end, head in zip(kinds, tables, headers, heights, tops, ends, heads, strict=True):
            fresh = page < 0 or y <= margin
            lead = head if kind == "row" and not header and table not in shown else 0.0
            gap = 0.0 if kind == "row" or last is None or fresh else min(most_gap, max(0.0, top - last))
            if page < 0 or (y + lead + gap + h > limit and y > margin + 0.01):
                page, y, shown, gap = page + 1, margin, set(), 0.0
                lead = head if kind == "row" and not header else 0.0
            out.append([float(page), y + gap + lead, lead])
            y += gap + lead + h
            if kind == "row":
                shown.add(table)
            while kind != "row" and y > limit + 0.01:  # the rest of a paragraph goes on
                page, y = page + 1, margin + y - limit
            last = end
        return out

    packed = sorted_rows(elements, keys, ["ordinal"], [c for c in elements.columns if c not in keys])
    names = ["kind", "table_no", "is_header", "height", "orig_y0", "orig_y1", "head"]

    def each(*lists: pa.Array) -> pa.Array:
        columns = [x.to_pylist() for x in lists]
        return pa.array([run(*page) for page in zip(*columns, strict=True)], pa.list_(pa.list_(pa.float64())))

    placed = packed.withColumn("_p", F.arrow_udf(each, "array<array<double>>")(*[F.col(f"rows.{c}") for c in names]))
    flat = placed.select(*keys, F.explode(F.arrays_zip("rows", F.col("_p").alias("p"))).alias("z"))
    return flat.select(*[F.col(c) if c in keys else F.col(f"z.rows.{c}") for c in elements.columns], F.col("z.p")[0].cast("int").alias("page"), F.col("z.p")[1].alias("y"), F.col("z.p")[2].alias("repeated"))


def row_bands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(row_id, top, bottom) from each row's extent y0..y1: the boundary between two rows is the middle of
    their centres; the outer edges are the outer rows' own."""
    order = Window.partitionBy(*keys).orderBy("row_id")
    c = (F.col("y0") + F.col("y1")) / 2
    top = (F.lag(c).over(order) + c) / 2
    bottom = (F.lead(c).over(order) + c) / 2
    return rows.select(*keys, "row_id", F.coalesce(top, F.col("y0")).alias("top"), F.coalesce(bottom, F.col("y1")).alias("bottom"))


def fit_heights(rows: DataFrame, keys: list[str], slack: float = 1.5) -> DataFrame:
    """Room of each row: down to the next row's top less a slack; 0 for the last one."""
    order = Window.partitionBy(*keys).orderBy("row_id")
    return rows.withColumn("fit_height", F.greatest(F.lit(0.0), F.coalesce(F.lead("y0").over(order) - F.col("y0") - slack, F.lit(0.0))))


def push_down(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Adds shift: the sum of `extra` of all elements of the page that start strictly higher; equals share."""
    higher = F.expr(f"sum(extra) over (partition by {', '.join(keys)} order by y0 range between unbounded preceding and 0.000000001D preceding)")
    return elements.withColumn("shift", F.coalesce(higher, F.lit(0.0)))


def row_growth(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds cum: growth (needed - had, if more) of the rows above, within a table."""
    above = Window.partitionBy(*keys).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("cum", F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("needed") - F.col("had"))).over(above), F.lit(0.0)))


def clamp_growth(tables: DataFrame, page_height: float, margin: float = 2.0) -> Column:
    """Share of the growth (total_extra) that fits above the page's bottom edge (lowest: lowest element)."""
    limit = page_height - margin
    return F.when(F.col("lowest") + F.col("total_extra") > limit, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(limit) - F.col("lowest")) / F.col("total_extra")))).otherwise(1.0)


def continuation(elements: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Adds moves: from the first element (by y0, ordinal) that ends below the limit on, all move."""
    order = Window.partitionBy(*keys).orderBy("y0", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumn("moves", F.max(F.col("y1") > limit).over(order))


def header_rows(rows: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """Adds header: leading rows without a figure, `most` at most, never all rows. rows: row_no, numeric (null
    where no block is in the row, which counts as data)."""
    order = Window.partitionBy(*keys).orderBy("row_no")
    leading = F.min((~F.coalesce("numeric", F.lit(True))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    rank, count = F.row_number().over(order), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("header", leading & (rank <= most) & (rank < count))


def message_window(messages: DataFrame, conv: str = "conv_id", cap: int = 24, budget: int = 40_000) -> DataFrame:
    """The messages (turn, role, text) that one request carries: the first one and the last cap - 1, begun at a
    user message (looking back for one); then whole rounds are dropped from the front until the text fits; the
    newest message stays where no round does."""
    order = Window.partitionBy(conv).orderBy("turn")
    every = Window.partitionBy(conv)
    rows = messages.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(every))
    target = F.greatest(F.lit(0), F.col("_n") - cap) + 1
    user = (F.col("role") == "user") & (F.col("_i") >= 1)
    start = F.coalesce(F.max(F.when(user & (F.col("_i") <= target), F.col("_i"))).over(every), F.lit(1))
    rows = rows.withColumn("_start", F.when(F.col("_n") <= cap, 0).otherwise(start)).where((F.col("_i") == 0) | (F.col("_i") >= F.col("_start")))
    size = F.length(F.coalesce("text", F.lit("")))
    head = F.sum(F.when(F.col("_i") == 0, size).otherwise(0)).over(every)
    tail = F.sum(F.when(F.col("_i") > 0, size).otherwise(0)).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_rest", head + tail).withColumn("_all", F.sum(size).over(every))
    fits = (F.col("_i") >= 1) & (F.col("_rest") <= budget) & (F.col("role") == "user")
    first_in = F.min(F.when(F.col("_i") >= 1, F.col("_i"))).over(every)
    cut = F.when(F.col("_all") <= budget, first_in).otherwise(F.coalesce(F.min(F.when(fits, F.col("_i"))).over(every), F.col("_n") - 1))
    rows = rows.withColumn("_cut", cut)
    return rows.where((F.col("_i") == 0) | (F.col("_i") >= F.col("_cut"))).select(*messages.columns)


def chat_window(messages: DataFrame, conv: str = "conv_id", cap: int = 24) -> DataFrame:
    """The console's rule: the last cap messages from their first user turn on, or, where they have none, from
    the last user turn of the conversation."""
    every, order = Window.partitionBy(conv), Window.partitionBy(conv).orderBy("turn")
    rows = messages.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(every))
    user = F.col("role") == "user"
    inside = F.min(F.when(user & (F.col("_i") > F.col("_n") - cap), F.col("_i"))).over(every)
    last = F.max(F.when(user, F.col("_i"))).over(every)
    rows = rows.withColumn("_from", F.when(F.col("_n") <= cap, 1).otherwise(F.coalesce(inside, last)))
    return rows.where(F.col("_i") >= F.col("_from")).select(*messages.columns)


# -- groupings of a page's boxes: lists of coordinates in, one number for each box out -----------------------


def reading_places(x0: list[float], y0: list[float], x1: list[float]) -> list[int]:
    """Each box's place in reading order, column by column. Boxes far wider than the median that span most of
    the page stay out of the columns; only boxes aligned with a column's left edge widen it."""
    n = len(x0)
    rows = lambda ids: sorted(ids, key=lambda i: (round(y0[i], 1), x0[i]))
    widths = [b - a for a, b in zip(x0, x1, strict=True)]
    spread = sorted(widths)
    median = (spread[(n - 1) // 2] + spread[n // 2]) / 2 if n else 0
    order = None
    if n > 1 and median > 0:
        extent = max(x1) - min(x0)
        wide = max(1.5 * median, 0.75 * extent)
        columns: list[list[int]] = []
        left: list[float] = []
        right: list[float] = []
        for i in sorted((i for i in range(n) if widths[i] <= wide), key=x0.__getitem__):
            home = next((c for c, end in enumerate(right) if x0[i] < end - 2.0), None)
            if home is None:
                columns.append([i])
                left.append(x0[i])
                right.append(x1[i])
                continue
            columns[home].append(i)
            left[home] = min(left[home], x0[i])
            if x0[i] - left[home] <= max(12.0, 0.06 * extent):
                right[home] = max(right[home], x1[i])
        if len(columns) > 1:
            middle = [i for c in columns for i in rows(c)]
            across = [i for i in range(n) if widths[i] > wide]
            top = y0[middle[0]]
            order = rows(i for i in across if y0[i] < top) + middle + rows(i for i in across if y0[i] >= top)
    place = [0] * n
    for k, i in enumerate(rows(range(n)) if order is None else order):
        place[i] = k
    return place


def paragraphs(read: list[int], x0: list[float], y0: list[float], x1: list[float], y1: list[float], size: list[float], bold: list[bool], color: list[int], entry: list[bool]) -> list[int]:
    """Paragraph number of each line. A line starts a new paragraph if it moves up, changes style against the
    paragraph's first line, is an entry, leaves a gap, or stands beside the line before it or in another column."""
    out, no, base, prev = [0] * len(read), -1, None, None

    def breaks(i: int) -> bool:
        apart = lambda slack: x0[i] > x1[prev] + slack or x0[prev] > x1[i] + slack
        jump = abs((x0[i] + x1[i]) - (x0[prev] + x1[prev])) / 2
        restyled = abs(size[i] - size[base]) > 0.6 or bold[i] != bold[base] or color[i] != color[base]
        beside = abs(y0[i] - y0[prev]) <= max(1.0, 0.4 * size[base]) and apart(1.0)
        elsewhere = jump > max(24.0, 0.55 * (x1[prev] - x0[prev])) and apart(-1.0)
        return bool(entry[i]) or restyled or y0[i] < y0[prev] - 1.0 or y0[i] - y1[prev] > 1.1 * size[base] or beside or elsewhere

    for i in sorted(range(len(read)), key=read.__getitem__):
        if base is None or breaks(i):
            no, base = no + 1, i
        prev, out[i] = i, no
    return out


def column_numbers(x0: list[float], x1: list[float], slack: float = 4.0) -> list[int]:
    """Column number of each item by overlapping x ranges, left to right; items wider than one and a half times
    the median go to the column nearest to their centre afterwards."""
    n = len(x0)
    widths = [b - a for a, b in zip(x0, x1, strict=True)]
    spread = sorted(widths)
    median = (spread[(n - 1) // 2] + spread[n // 2]) / 2 if n else 0
    if n < 2 or median <= 0:
        return [0] * n
    columns: list[list[int]] = []
    right: list[float] = []
    for i in sorted((i for i in range(n) if widths[i] <= 1.5 * median), key=x0.__getitem__):
        home = next((c for c, end in enumerate(right) if x0[i] < end - slack), None)
        if home is None:
            columns.append([i])
            right.append(x1[i])
        else:
            columns[home].append(i)
            right[home] = max(right[home], x1[i])
    columns.sort(key=lambda c: min(x0[i] for i in c))
    out: list[int | None] = [None] * n
    for no, c in enumerate(columns):
        for i in c:
            out[i] = no
    edges = [(min(x0[i] for i in c), max(x1[i] for i in c)) for c in columns]
    for i in range(n):
        if out[i] is None:
            middle = (x0[i] + x1[i]) / 2
            away = [0.0 if a <= middle <= b else min(abs(middle - a), abs(middle - b)) for a, b in edges]
            out[i] = away.index(min(away))
            a, b = edges[out[i]]
            edges[out[i]] = (min(a, x0[i]), max(b, x1[i]))
    return out


def reading_order(items: list[dict]) -> list[int]:
    """Positions of boxes (x0, y0, x1) in reading order."""
    place = reading_places(*[[b[c] for b in items] for c in ("x0", "y0", "x1")])
    return sorted(range(len(items)), key=place.__getitem__)


def cluster_columns(items: list[dict]) -> list[int]:
    """column_numbers() of boxes (x0, x1)."""
    return column_numbers(*[[b[c] for b in items] for c in ("x0", "x1")])


def _ordinal(rows: DataFrame) -> list[str]:
    return ["line_no" if "line_no" in rows.columns else "item_no"]


def with_reading_order(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds read_no, from 0 per page."""
    return numbered(lines, keys, _ordinal(lines), ["x0", "y0", "x1"], "read_no", reading_places)


def with_paragraphs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds para_no, from 0 per page, to lines that have read_no."""
    marked = lines.withColumn("entry", X.is_entry(F.col("text")))
    return numbered(marked, keys, _ordinal(lines), ["read_no", *LINE, "size", "bold", "color", "entry"], "para_no", paragraphs).drop("entry")


def with_columns(items: DataFrame, keys: list[str]) -> DataFrame:
    """Adds col_id, from 0 per page, left to right."""
    return numbered(items, keys, _ordinal(items), ["x0", "x1"], "col_id", column_numbers)


def paragraph_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks from grouped lines: text de-hyphenated, box united, size by upper median, colour by count (ties: the
    first), pure symbols dropped; block_no counts what stays."""
    body = sorted_rows(lines, [*keys, "para_no"], ["read_no"], [*LINE, "size", "bold", "color", "text"])
    colors = F.array_distinct(F.col("rows.color"))
    often = F.transform(colors, lambda c, i: F.struct((-F.size(F.filter(F.col("rows.color"), lambda x: x == c))).alias("n"), i.alias("i"), c.alias("c")))
    made = body.select(
        *keys, "para_no", X.dehyphenate(F.col("rows.text")).alias("text"), F.array_min("rows.x0").alias("x0"), F.array_min("rows.y0").alias("y0"), F.array_max("rows.x1").alias("x1"), F.array_max("rows.y1").alias("y1"),
        upper_median(F.col("rows.size")).alias("size"), F.exists("rows.bold", lambda b: b).alias("bold"), (F.size("rows") <= 1).alias("single_line"), F.array_min(often)["c"].alias("color"),
    ).where(~X.is_pure_symbol(F.col("text")))
    return made.withColumn("block_no", F.row_number().over(Window.partitionBy(*keys).orderBy("para_no")) - 1)
