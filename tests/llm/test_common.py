import random

from quillmark.llm.common import Forest, components


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (7, 900_000)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(42_000, k) for k in range(42_001, 42_400)]
    frame = spark.createDataFrame([*edges, (None, 3)], "u long, v long").repartition(7)
    names = sorted({x for e in edges for x in e})
    at, f = {x: i for i, x in enumerate(names)}, Forest(len(names))
    for a, b in edges:
        f.join(at[a], at[b])
    want = {(x, names[f.root(at[x])]) for x in names if names[f.root(at[x])] != x}
    assert {tuple(r) for r in components(frame).collect()} == want
    assert components(frame.limit(0)).count() == 0
