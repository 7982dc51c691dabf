from roadweave.operators import rematch

PTS = "array<struct<x: double, y: double>>"


def street(x0, x1, y=0.0):
    return [(float(x0), y), ((x0 + x1) / 2.0, y), (float(x1), y)]


def test_outcomes(spark):
    """A street a hundred metres long for each row, 1000 apart: what became of its way, case by case."""
    rows, ways = [], []

    def case(row, was, *now, kind="stress", value="3", name="Main St", warns=False, way=None):
        y = 1000.0 * row
        rows.append((row, kind, way or row, value, name, "residential", 100.0, None if was is None else street(*was, y), warns))
        ways.extend((w, n, h, street(a, b, y + dy)) for w, n, h, a, b, dy in now)

    same = ("Main Street", "residential")
    case(1, (0, 100), (1, *same, 0, 100, 0.0))  # as it was
    case(2, (0, 100), (202, *same, 100, 0, 1.0))  # a new id, drawn the other way
    case(3, (0, 100), (3, *same, 0, 60, 0.0), (303, *same, 60, 100, 0.0))  # split, its id on a piece
    case(4, (0, 100), (404, *same, 0, 50, 0.0), (405, *same, 50, 100, 0.0))  # split, its id gone
    case(5, (0, 100), (5, *same, 0, 180, 0.0))  # merged
    case(6, (0, 100), (6, *same, 0, 180, 0.0), warns=True)
    case(7, (0, 100), (7, *same, 0, 100, 15.0))  # redrawn
    case(8, (0, 100), (8, "Oak Street", "residential", 0, 100, 0.0))  # its name
    case(9, (0, 100))  # gone
    case(10, (0, 100), (1010, *same, 0, 180, 0.0))  # only a longer way
    case(11, (0, 100), (1111, *same, 0, 40, 0.0))  # only a piece of it
    case(12, (0, 100), (1212, *same, 0, 100, 0.0), (1213, *same, 0, 100, 4.0))  # two side by side
    case(13, (0, 100), (1313, "Main Street", "service", 0, 100, 0.0))
    case(14, None)  # gone, and no fingerprint
    case(15, None, (15, *same, 0, 50, 0.0))
    case(16, (0, 100), (3, *same, 0, 60, -13_000.0), way=3, value="4")  # (another row of way 3, far from its line)
    case(17, (0, 100), (1717, *same, 0, 100, 0.0))
    rows.append((18, "stress", 1717, "2", None, None, None, None, False))  # another value is there
    case(19, (0, 100), (1919, *same, 0, 100, 0.0))
    rows.append((20, "stress", 1919, "3", None, None, None, None, False))  # the same value is there
    ways = [w for i, w in enumerate(ways) if w[0] not in {x[0] for x in ways[:i]}]
    rows = [r for r in rows if r[0] != 16]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"row long, kind string, way long, value string, name string, highway string, length double, pts {PTS}, warns boolean, reason string")
    now = spark.createDataFrame(ways, f"way long, name string, highway string, pts {PTS}")
    report, applied = rematch.rematch(df.drop("reason"), now)
    got = {r.row: (r.outcome, sorted(r.ways or []), r.reason) for r in report.collect()}
    assert got == {
        2: ("rematched", [202], None),
        3: ("rematched", [3, 303], "split"),
        4: ("rematched", [404, 405], None),
        5: ("failed", [], "merged"),
        6: ("drifted", [6], "merged"),
        7: ("drifted", [7], "redrawn"),
        8: ("drifted", [8], "tags"),
        9: ("failed", [], "none"),
        10: ("failed", [], "overreach"),
        11: ("failed", [], "uncovered"),
        12: ("failed", [], "parallel"),
        13: ("failed", [], "none"),
        14: ("failed", [], "no fingerprint"),
        17: ("failed", [], "another value there"),
        19: ("covered", [1919], None),
    }
    where = {}
    for r in applied.collect():
        where.setdefault(r.row, set()).add(r.way)
    assert where == {1: {1}, 2: {202}, 3: {3, 303}, 4: {404, 405}, 6: {6}, 7: {7}, 8: {8}, 15: {15}, 18: {1717}, 20: {1919}}
    assert rematch.rematch(df.limit(0), now)[0].collect() == []


def test_crossing_and_length(spark):
    """A short way across the line's middle isn't it; pieces must add up to the length the row was written for."""
    rows = spark.createDataFrame([(1, "a", "x", 8.0, [(0.0, 0.0), (8.0, 0.0)]), (2, "b", "x", 300.0, street(0, 100, 500.0))], f"row long, name string, highway string, length double, pts {PTS}")
    ways = spark.createDataFrame([(7, "a", "x", [(4.0, -4.0), (4.0, 4.0)]), (8, "b", "x", street(0, 100, 500.0))], f"way long, name string, highway string, pts {PTS}")
    assert {r.row: r.reason for r in rematch.standing_for(rows, ways).collect()} == {1: "crosses", 2: "length"}
