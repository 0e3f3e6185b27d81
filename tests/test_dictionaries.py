"""Names found in texts: by hash as one by one, at a cost that does not grow with the dictionary."""

import random
import time

from pyspark.sql import functions as F

from farewright.functions import parsing

LETTERS = "가나다라마바사아자차도쿄오사카"


def dictionary(n, seed=1):
    r = random.Random(seed)
    names = {"ANA", "Aa", "LA", "도쿄", "나다", "a나 b"}
    while len(names) < n:
        names.add("".join(r.choice(LETTERS if r.random() < 0.7 else "ABCDEFabc") for _ in range(r.randrange(2, 8))))
    return sorted(sorted(names), key=lambda x: r.random())


def texts(spark, n=400):
    r = random.Random(2)
    rows = ["", " ", "LA", "la 특가", "LAX", "xANAx", "a나 b", "ana", None]
    rows += ["".join(r.choice(LETTERS + "ABCDEFabc 1-!") for _ in range(r.randrange(60))) for _ in range(n)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")


def test_by_hash_is_one_by_one(spark):
    names, t = dictionary(300), texts(spark)
    for tokens in (True, False):
        both = t.select(parsing.first_name(F.col("t"), names, tokens, few=10**9).alias("a"), parsing.first_name(F.col("t"), names, tokens, few=0).alias("b")).collect()
        assert all(x.a == x.b for x in both) and 50 < sum(x.a is not None for x in both) < len(both)


def test_names_and_tokens(spark):
    """ASCII tokens need letters on neither side; the longest name goes first, then the order of the list."""
    t = spark.createDataFrame([("to LA now",), ("LAX",), ("la도쿄행",), ("도쿄도 NY",), ("ny 도쿄",)], "t string")
    for few in (0, 99):
        got = [r[0] for r in t.select(parsing.first_name(F.col("t"), ["NY", "도쿄", "LA", "도쿄도"], few=few)).collect()]
        assert got == ["LA", None, "도쿄", "도쿄도", "NY"]


def test_cost_does_not_grow_with_the_dictionary(spark):
    t = texts(spark, 4000).repartition(4).cache()
    t.count()

    def seconds(n):
        # Ten times the names, of which the texts hold no more: their letters are not in any text.
        names = dictionary(300) + [chr(0xB000 + i % 5000) + chr(0xB000 + i // 5000) + "힣" for i in range(n)]
        best = 9e9
        for _ in range(3):
            start = time.perf_counter()
            t.select(parsing.first_name(F.col("t"), names)).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return best

    seconds(700)
    small, large = seconds(700), seconds(9_700)
    assert large < 3 * small + 0.5
