"""Rewards of completions against references."""

from pyspark.sql import functions as F

from reelmill.functions import protocol as pr


def test_rewards(spark):
    present = '{"target_status":"present","bbox_2d":[0,0,100,100]}'
    absent = '{"target_status":"absent","bbox_2d":null}'
    cases = [
        (present, present, (1, 1, 1, 1)),
        (f"```json\n{present}\n```", present, (0, 1, 1, 1)),
        ('{"target_status":"present","bbox_2d":[0,0,100,50]}', present, (1, 1, 0.5, 1)),
        ('{"target_status":"present","bbox_xywh":[0,0,50,100]}', present, (0, 1, 0.5, 0)),
        ('{"target_status":"present","bbox_2d":[0,0,100,2000]}', present, (0, 1, 0, 0)),
        ('{"target_status":"present","bbox_2d":[0,0,100,100],"memory_update":7}', present, (0, 1, 1, 0)),
        (absent, absent, (1, 1, 1, 1)),
        ('{"target_status":"absent","bbox_2d":[1,2,3,4]}', absent, (0, 1, 0, 0)),
        (absent, present, (1, 0, 0, 1)),
        ("no json", absent, (0, 0, 0, 0)),
        (None, present, (0, 0, 0, 0)),
        (present, None, (1, 0, 0, 1)),
    ]
    df = spark.createDataFrame([(i, c, r) for i, (c, r, _) in enumerate(cases)], "i int, c string, r string")
    got = {r.i: tuple(r.w) for r in pr.with_rewards(df, F.col("c"), F.col("r"), "w").collect()}
    assert got == {i: tuple(map(float, want)) for i, (_, _, want) in enumerate(cases)}
