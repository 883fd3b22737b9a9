"""Connected components: the plans of a round stay small, and hubs and chains come out whole."""

import random

from prismata.plans import components


def _plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_plans_do_not_nest(spark, monkeypatch):
    """Each plan that is written groups once at most, so what the driver plans and keeps of a round is of one size."""
    rnd = random.Random(5)
    edges = [(1, k) for k in range(2, 200)] + [(k, k + 1) for k in range(300, 340)] + [(rnd.randint(400, 500), rnd.randint(400, 500)) for _ in range(80)]
    edges = [(a, b) for a, b in edges if a != b]
    grouped, write = [], components.materialize

    def seen(df, name):
        grouped.append(df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate"))
        return write(df, name)

    monkeypatch.setattr(components, "materialize", seen)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == _plain(edges)
    assert max(grouped) == 1
