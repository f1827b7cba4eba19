"""Room schedules of all plans of the grid, also those that the query and its SQL leave out."""

import duckdb

from levelgrid.plans import drawing
from levelgrid.queries.plans import GRID, rooms_of

SF = "/root/testdata/sf0.001"


def test_room_schedule_of_all_plans(spark):
    con = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "supplier", "part", "nation", "region"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    grid = con.execute(f"select plan_id, 'r' || (j * nx + i + 1)::bigint, i, j, nx, t from ({GRID}) r").fetchall()
    want = {(p, room): (i, j * nx + i + 1, (5 - t) * (4 - t), t) for p, room, i, j, nx, t in grid}
    rows = drawing.room_schedule(rooms_of(spark, SF)[0]).collect()
    assert len(rows) == len(want) and {(r.plan_id, r.room_id) for r in rows} == set(want)
    assert {round(t, 6) for *_, t in want.values()} >= {0.15}
    for r in rows:
        i, number, area, _ = want[(r.plan_id, r.room_id)]
        assert (r.name, r.number) == (f"Room {i + 1}", str(number))
        assert abs(r.area - area) < 1e-6 and abs(r.label_x - (5 * i + 2.5)) < 1e-6
        assert r.area_text.endswith(" m²") and abs(float(r.area_text[:-3]) * 10 - area * 10) <= 0.5 + 1e-6
