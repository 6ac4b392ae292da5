import numpy as np
import pytest

from framesieve.operators import heat as H


def lines_by_hand(cells, width, height, levels):
    grid = len(cells)

    def value(x, y):
        gx, gy = (x + 0.5) / (width / grid) - 0.5, (y + 0.5) / (height / grid) - 0.5
        x0, y0 = min(max(int(np.floor(gx)), 0), grid - 1), min(max(int(np.floor(gy)), 0), grid - 1)
        x1, y1, fx, fy = min(x0 + 1, grid - 1), min(y0 + 1, grid - 1), min(max(gx - x0, 0), 1), min(max(gy - y0, 0), 1)
        upper = cells[y0][x0] + (cells[y0][x1] - cells[y0][x0]) * fx
        lower = cells[y1][x0] + (cells[y1][x1] - cells[y1][x0]) * fx
        return upper + (lower - upper) * fy

    field = [[value(x, y) for x in range(width)] for y in range(height)]
    low, span = np.min(cells), max(np.max(cells) - np.min(cells), 0.01)
    out = set()
    for i in range(1, levels + 1):
        level = low + span * i / (levels + 1)
        for y in range(1, height - 1):
            for x in range(1, width - 1):
                if any((field[y][x] - level) * (field[y + b][x + a] - level) < 0 for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))):
                    out.add((i, x, y))
    return out


@pytest.mark.parametrize(("grid", "width", "height"), [(5, 21, 13), (7, 9, 30), (1, 6, 6), (15, 10, 10)])
def test_lines(spark, grid, width, height):
    rng = np.random.default_rng(grid)
    maps = {"a": rng.uniform(2, 5, (grid, grid)), "flat": np.full((grid, grid), 3.0), None: np.add.outer(np.arange(grid), np.arange(grid)) * 0.7}
    cells = spark.createDataFrame([(g, grid, x, y, float(v[y, x])) for g, v in maps.items() for y in range(grid) for x in range(grid)], "`a map` string, grid int, gx int, gy int, fwhm double").repartition(5)
    found = {}
    for r in H.contours(cells, "a map", width, height, 4).collect():
        found.setdefault(r[0], set()).add((r.level, r.x, r.y))
    assert found == {g: lines for g, v in maps.items() if (lines := lines_by_hand(v, width, height, 4))}


def test_pictures(spark):
    cells = spark.createDataFrame([("m", 2, x, y, float(x)) for x in range(2) for y in range(2)], "frame string, grid int, gx int, gy int, fwhm double")
    row = H.heat_pictures(cells, "frame", 8, 3, "plasma").first()
    picture = np.array(row.pixels).reshape(3, 8, 3)
    assert tuple(picture[0, 0]) == H.PALETTES["plasma"][0] and tuple(picture[2, 7]) == H.PALETTES["plasma"][-1] and (row.width, row.height, row.channels) == (8, 3, 3)
    with pytest.raises(KeyError):
        H.heat_pictures(cells, "frame", 8, 3, "none such")
