"""Places on a page or a picture: rectangles of a mark condensed to lines, lanes of a timeline, the graph of the best connected papers."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rectangles of a mark at most, and papers that a picture can label.
MOST_RECTS, LEGIBLE = 96, 20
#: The picture's width, its margins and the height of a row.
WIDTH, PAD_X, PAD_Y, ROW = 940, 96, 52, 76


def condense(rects: DataFrame) -> DataFrame:
    """(mark, n, x0, y0, x1, y1): rectangles (mark, x0, y0, x1, y1) of each mark joined to runs on its lines, in reading order, the first MOST_RECTS.

    A rectangle belongs to the line before it if they overlap by more than half of the lower one; on
    a line, gaps of up to 0.6 of its height, and 1.5 at least, are closed. Rectangles without area and
    those with nulls are left out. One mark's rectangles are handled together, in order.
    """
    sane = rects.where("x1 > x0 AND y1 > y0").select("mark", F.struct(*[F.col(c).cast("double").alias(c) for c in ("y0", "x0", "x1", "y1")]).alias("r"))
    packed = sane.groupBy("mark").agg(F.array_sort(F.collect_list("r")).alias("rects"))

    def runs(rects: list[dict]) -> list[dict]:
        lines: list[dict] = []
        for r in rects:
            line = lines[-1] if lines else None
            if line and min(line["bottom"], r["y1"]) - max(line["top"], r["y0"]) > 0.5 * min(line["height"], r["y1"] - r["y0"]):
                line["bottom"], line["height"] = max(line["bottom"], r["y1"]), max(line["height"], r["y1"] - r["y0"])
            else:
                line = {"top": r["y0"], "bottom": r["y1"], "height": r["y1"] - r["y0"], "rects": []}
                lines.append(line)
            line["rects"].append(r)
        out: list[dict] = []
        for line in lines:
            run = None
            for r in sorted(line["rects"], key=lambda r: r["x0"]):
                if run and r["x0"] - run["x1"] <= max(1.5, 0.6 * line["height"]):
                    run |= {"y0": min(run["y0"], r["y0"]), "x1": max(run["x1"], r["x1"]), "y1": max(run["y1"], r["y1"])}
                else:
                    run = dict(r)
                    out.append(run)
        return out[:MOST_RECTS]

    def condensed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.float64()) for c in ("y0", "x0", "x1", "y1")]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array([runs(r) for r in batch.column("rects").to_pylist()], kind)], names=["mark", "runs"])

    joined = packed.mapInArrow(condensed, f"mark {rects.schema['mark'].dataType.simpleString()}, runs array<struct<y0: double, x0: double, x1: double, y1: double>>")
    return joined.select("mark", F.posexplode("runs").alias("n", "r")).select("mark", "n", "r.x0", "r.y0", "r.x1", "r.y1")


def lanes(placed: DataFrame, gap: float) -> DataFrame:
    """placed (view, id, x) with lane: from left to right each takes the topmost lane whose last occupant is more than gap to its left.

    So lanes are as many as ever stand within a gap. A view is laid out in order of x and id, with two
    heaps over its lanes; rows with a null x are left out.
    """

    def assign(places: list[float]) -> list[int]:
        busy: list[tuple[float, int]] = []
        free: list[int] = []
        found, opened = [], 0
        for x in places:
            while busy and x - busy[0][0] > gap:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                lane = heapq.heappop(free)
            else:
                lane, opened = opened, opened + 1
            heapq.heappush(busy, (x, lane))
            found.append(lane)
        return found

    def assigned(views: pa.Array) -> pa.Array:  # many views at a call
        return pa.array([assign(places) for places in views.to_pylist()], pa.list_(pa.int32()))

    each = placed.where("x IS NOT NULL").groupBy("view").agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), "id"))).alias("p"))
    lane = F.arrow_udf(assigned, "array<int>")("p.x")
    return each.select("view", "p", lane.alias("l")).select("view", F.inline(F.zip_with("p", "l", lambda p, n: F.struct(p["id"].alias("id"), p["x"].alias("x"), n.alias("lane")))))


def ranked(edges: DataFrame, dates: DataFrame) -> DataFrame:
    """(id, x, y, above, hidden): a report of the LEGIBLE best connected papers of edges (src, dst), spaced by the order of their dates (id, date), rows in turn; hidden counts connected papers that are not shown."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    total = degree.agg(F.count(F.lit(1)).alias("total"))  # one row
    shown = degree.orderBy(F.desc("degree"), "id").limit(LEGIBLE).join(dates, "id")
    every = Window.partitionBy(F.lit(1))
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date", "id")) - 1
    n = F.count(F.lit(1)).over(every)
    rows = F.greatest(F.lit(3), F.least(F.lit(9), F.ceil(n / 4)))
    placed = shown.select("id", order.alias("i"), n.alias("n"), rows.alias("rows"))
    x = PAD_X + F.col("i") / F.greatest(F.lit(1), F.col("n") - 1) * (WIDTH - 2 * PAD_X)
    return placed.crossJoin(F.broadcast(total)).select("id", x.alias("x"), (PAD_Y + F.col("i") % F.col("rows") * ROW).cast("long").alias("y"), (F.col("i") % 2 == 0).alias("above"), (F.col("total") - F.col("n")).alias("hidden"))
