"""All fields of a tile are traced in one pass."""

import numpy as np

from furrow.operators import outlines


def test_fields_with_a_hole_and_a_corner_touch():
    # field 0: a 3 x 3 square with a hole; field 1: two cells of a row below a gap; field 2: three cells around a corner touch of field 1
    runs = [(0, 0, 0, 2), (0, 1, 0, 0), (0, 1, 2, 2), (0, 2, 0, 2), (1, 4, 0, 1), (2, 5, 2, 3), (2, 6, 2, 2)]
    name, y, x0, x1 = (np.array(c) for c in zip(*runs))
    points, sizes, of = outlines._trace(name, y, x0, x1)
    rings = [[tuple(p) for p in part.tolist()] for part in np.split(points, np.cumsum(sizes)[:-1])]
    assert of.tolist() == [0, 0, 1, 2]
    assert rings == [
        [(0, 0), (3, 0), (3, 3), (0, 3), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)], [(0, 4), (2, 4), (2, 5), (0, 5), (0, 4)],
        [(2, 5), (4, 5), (4, 6), (3, 6), (3, 7), (2, 7), (2, 5)]]


def test_a_ring_keeps_to_its_cell_where_two_cells_touch():
    points, sizes, of = outlines._trace(*(np.array(c) for c in ((0, 0, 0, 0), (0, 1, 1, 2), (0, 0, 2, 0), (1, 0, 2, 2))))
    assert of.tolist() == [0] and sizes.tolist() == [11]
    assert [tuple(p) for p in points.tolist()] == [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (2, 2), (2, 1), (3, 1), (3, 3), (0, 3), (0, 0)]
