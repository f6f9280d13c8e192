"""Empty regions of a page, which may hold pictures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

CELL = 50
REGION = "doc_key string, page_num long, x0 long, y0 long, x1 long, y1 long"


def empty_regions(boxes: list[tuple[float, float, float, float]], width: int, height: int, least: int = 100) -> list[tuple[int, int, int, int]]:
    """Boxes around connected empty cells of a 50-pixel grid, at least `least` wide and high, from the top left."""
    if not boxes:
        return []
    columns, lines = -(-width // CELL), -(-height // CELL)
    free = {(r, c) for r in range(lines) for c in range(columns)}
    for x0, y0, x1, y1 in boxes:
        rows = range(max(0, int(y0) // CELL), min(lines, -(-int(y1) // CELL)))
        free -= {(r, c) for r in rows for c in range(max(0, int(x0) // CELL), min(columns, -(-int(x1) // CELL)))}
    out = []
    for start in sorted(free):
        if start not in free:
            continue
        free.discard(start)
        group, edge = [start], [start]
        while edge:
            r, c = edge.pop()
            for near in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if near in free:
                    free.discard(near)
                    group.append(near)
                    edge.append(near)
        rs, cs = [r for r, _ in group], [c for _, c in group]
        box = (min(cs) * CELL, min(rs) * CELL, (max(cs) + 1) * CELL, (max(rs) + 1) * CELL)
        if box[2] - box[0] >= least and box[3] - box[1] >= least:
            out.append(box)
    return out


def image_regions(elements: DataFrame, width: int = 1275, height: int = 1650, least: int = 100) -> DataFrame:
    """(doc_key, page_num, x0, y0, x1, y1) of the empty regions around a page's texts; a page is one small group."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        boxes = list(page[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None))
        found = empty_regions(boxes, width, height, least)
        key, number = page["doc_key"].iloc[0], page["page_num"].iloc[0]
        return pd.DataFrame([(key, number, *box) for box in found], columns=["doc_key", "page_num", "x0", "y0", "x1", "y1"])

    text = elements.filter("elem_type = 'text' and x0 is not null").select("doc_key", "page_num", "x0", "y0", "x1", "y1")
    return text.groupBy("doc_key", "page_num").applyInPandas(run, REGION)
