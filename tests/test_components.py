import random

from strandweave.operators.components import connected_components


def test_components(spark):
    seeded = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60) if i % 13] + [(seeded.randrange(100, 160), seeded.randrange(100, 160)) for _ in range(40)] + [(7, 7), (999, 999)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            if (root[a], root[b]) != (m, m):
                root[a] = root[b] = m
                changed = True
    frame = spark.createDataFrame([*edges, (None, 3), (4, None)], "u long, v long")
    assert {r.id: r.component for r in connected_components(frame).collect()} == root
    assert connected_components(frame.limit(0)).collect() == []


def test_hubs_are_not_gathered(spark, monkeypatch):
    """With a hub of any size split off, the components stay the same."""
    from strandweave.operators import components

    edges = [(5, i) for i in range(50, 120)] + [(i, i + 1) for i in range(130, 150)] + [(119, 130), (300, 301)]
    frame = spark.createDataFrame(edges, "u long, v long")
    expected = {i: 300 if i >= 300 else 5 for e in edges for i in e}
    for hub in (1, 8, 10**6):
        monkeypatch.setattr(components, "HUB", hub)
        monkeypatch.setattr(components, "FEW", 0)
        assert {r.id: r.component for r in connected_components(frame).collect()} == expected


def test_small_graphs_are_united_in_one_task(spark):
    for kind, name in (("long", lambda i: i), ("string", lambda i: f"v{i}")):
        edges = [(name(a), name(b)) for a, b in ((1, 2), (30, 2), (4, 5), (6, 6), (7, 30))] + [(None, name(3))]
        frame = spark.createDataFrame(edges, f"u {kind}, v {kind}")
        rounds, one = (sorted(map(tuple, connected_components(frame, gather=g).collect())) for g in (False, True))
        assert one == rounds and len(one) == 7
        assert connected_components(frame.limit(0), gather=True).collect() == []
