"""Users, motors and readings as nested documents."""

from pyspark.sql import functions as F

from rotorline.operators import access, ordering


def unnested(tree):
    motors = tree.select("user_id", "document", F.explode("motors").alias("m")).select("user_id", "document", "m.*")
    return [(r.user_id, r.motor_id, r.part, [x.reading_id for x in r.readings]) for r in motors.collect()]


def fleet(spark, make, busy=3_000):
    users = spark.createDataFrame([("c1", "One"), ("c2", "Two"), ("c3", "None")], "id string, name string")
    motors = make.motors(("busy", "c1"), ("busy", "c2"), ("calm", "c1"), ("mute", "c2"), ("orphan", "gone"))
    readings = make.readings(*[("busy", i, i) for i in range(busy)], *[("calm", i, i) for i in range(7)], ("unknown", 1, 1))
    return users, motors, readings


def test_every_reading_once_and_no_large_array(spark, make, monkeypatch):
    for span in (ordering.SPAN, 500):
        monkeypatch.setattr(ordering.with_spans, "__defaults__", (span,))
        users, motors, readings = fleet(spark, make)
        tree = access.fleet_tree(users, motors, readings, part_rows=100, parts=4).cache()
        found = unnested(tree)
        assert all(len(ids) <= 100 for *_, ids in found)
        ids = {r.reading_id for r in readings.filter("motor_id = 'busy'").collect()}
        for user in ("c1", "c2"):
            mine = [(part, ids_) for u, m, part, ids_ in found if (u, m) == (user, "busy")]
            assert sorted(i for _, part_ids in mine for i in part_ids) == sorted(ids)
            assert sorted(part for part, _ in mine) == list(range(len(mine)))
            in_order = [i for _, part_ids in sorted(mine) for i in part_ids]
            assert in_order == sorted(in_order)
        assert [(u, part, ids_) for u, m, part, ids_ in found if m == "mute"] == [("c2", 0, [])]
        assert max(len(r.motors) for r in tree.collect()) <= 20  # dealt by a hash, about 4
        assert tree.filter("user_id = 'c1'").count() > 4
        assert [(r.document, r.motors) for r in tree.filter("user_id = 'c3'").collect()] == [(0, [])]
        assert {u for u, *_ in found} == {"c1", "c2"}


def test_nothing_at_all(spark, make):
    users, motors, readings = fleet(spark, make, busy=1)
    assert access.fleet_tree(users.limit(0), motors, readings).count() == 0
    assert {r.user_id: r.motors for r in access.fleet_tree(users, motors.limit(0), readings).collect()} == {"c1": [], "c2": [], "c3": []}
    assert all(ids == [] for *_, ids in unnested(access.fleet_tree(users, motors, readings.limit(0))))
