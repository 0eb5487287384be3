import random

import pytest
from pyspark.sql import SparkSession

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def peptides(spark):
    """Sixty short sequences: near copies, exact copies, labels, groups, dates, clusters, descriptors."""
    rng, rows = random.Random(5), []
    for i in range(40):
        rows.append("".join(rng.choice(LETTERS) for _ in range(rng.randint(20, 40))))
    for i in range(15):
        s = list(rows[i])
        at = rng.randrange(len(s))
        s[at] = rng.choice(LETTERS.replace(s[at], ""))
        rows.append("".join(s))
    rows += rows[:5]
    data = [
        (f"p{i:03d}", s, i % 3 and 1 or 0, f"g{i % 7}", f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", f"c{i % 11}", float(i * 7 % 60) + i / 100, rng.gauss(0, 1), rng.gauss(0, 1))
        for i, s in enumerate(rows)
    ]
    return spark.createDataFrame(data, "id string, sequence string, label int, group string, date string, cluster_id string, y double, desc_0 double, desc_1 double").cache()


@pytest.fixture(scope="session")
def vectors(spark):
    rng, rows = random.Random(9), []
    for i in range(50):
        base = [rng.gauss(0, 1) for _ in range(8)]
        rows.append((f"p{i:03d}", [x + (rng.gauss(0, 0.05) if i % 3 else 0) for x in (rows[-1][1] if rows and i % 3 else base)]))
    return spark.createDataFrame(rows, "id string, embedding array<double>").cache()
