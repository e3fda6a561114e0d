"""Random sequences of writes against a dict."""

import random

from keyloom import SUM, KeyedFrame, fold
from pyspark.sql import functions as F


def test_against_dict(spark):
    r = random.Random(7)
    for _ in range(3):
        start = {i: r.randint(-9, 9) for i in r.sample(range(30), 12)}
        t, model = KeyedFrame.from_df(spark.createDataFrame(list(start.items()), "k long, v int"), "k", n=3), dict(start)
        for _ in range(4):
            some = {r.randrange(30): r.randint(-9, 9) for _ in range(6)}
            match r.randrange(5):
                case 0:
                    t, model = t.multiput(some), model | some
                case 1:
                    t, model = t.multiput(some, SUM), model | {k: model.get(k, 0) + v for k, v in some.items()}
                case 2:
                    spec = fold(lambda k, u: u - k, lambda k, a, u: a * 2 + u)
                    t, model = t.multiput(some, spec), model | {k: model[k] * 2 + v if k in model else v - k for k, v in some.items()}
                case 3:
                    t, model = t.delete(list(some)), {k: v for k, v in model.items() if k not in some}
                case 4:
                    rows = spark.createDataFrame(list(some.items()), "k long, u int")
                    t, model = t.update_join(rows, lambda k, v, u: v - u), {k: v - some.get(k, 0) for k, v in model.items()}
        assert {x.k: x.v for x in t.to_df().withColumn("v", F.col("v").cast("int")).collect()} == model
