import random
from collections import deque
from itertools import combinations

import pytest
from conftest import SMALL

import __spark_entry__ as contract
from reviewmine.operators import communities as com
from reviewmine.operators import graph

REVIEWED = "a1 a2 a3 b1 b2 b3 b4 c1 c2 d3 d4 d5 d6 d7 e4 e5 f4 f5 f6 g5 g6".split()


def example(spark, threshold):
    pairs = spark.createDataFrame([(p[0], p[1]) for p in REVIEWED], "user_id string, business_id string")
    return graph.co_review_graph(pairs, threshold).cache()


def groups(members):
    found = {}
    for r in members.collect():
        found.setdefault(r.community, set()).add(r.node)
    return sorted("".join(sorted(g)) for g in found.values())


def scores(edges):
    return {(r.src, r.dst): round(r.betweenness, 6) for r in graph.edge_betweenness(edges).collect()}


def test_example_with_two_in_common(spark):
    edges = example(spark, 2)
    assert scores(edges) == {
        ("b", "d"): 12.0, ("a", "b"): 5.0, ("b", "c"): 5.0, ("d", "e"): 4.5, ("d", "g"): 4.5, ("d", "f"): 4.0,
        ("e", "f"): 1.5, ("f", "g"): 1.5, ("a", "c"): 1.0,
    }
    steps = com.parallel_steps(edges, 2).cache()
    first = steps.where("round = 1").first()
    assert (first.component, first.src, first.dst, round(first.q, 6)) == ("a", "b", "d", 0.364198)
    best = com.best_of_rounds(edges, steps)
    assert groups(best) == ["abc", "defg"]
    listed = com.member_lists(best).orderBy("size", "community", "position").collect()
    assert [(r.size, r.position, r.node) for r in listed] == [
        *((3, i, n) for i, n in enumerate("abc")), *((4, i, n) for i, n in enumerate("defg")),
    ]


def test_example_with_one_in_common(spark):
    edges = example(spark, 1)
    assert edges.count() == 13
    score = scores(edges)
    assert max(score.values()) == score["b", "c"] == 4.25


def test_example_with_three_in_common(spark):
    edges = example(spark, 3)
    assert edges.count() == 2
    whole = graph.connected_components(edges)
    assert graph.modularity(edges, whole).first().q == pytest.approx(0.5)
    steps = [round(r.q, 6) for r in com.removal_trace(edges).orderBy("step").collect()]
    assert steps == [0.125, -0.25]


def test_empty_and_single_edge(spark):
    schema = "src string, dst string"
    one = spark.createDataFrame([("a", "b")], schema)
    assert [r.q for r in com.removal_trace(one).collect()] == [pytest.approx(-0.5)]
    none = spark.createDataFrame([], schema)
    assert com.removal_trace(none).isEmpty()
    assert graph.edge_betweenness(none).isEmpty()
    assert graph.connected_components(none).isEmpty()


def random_edges(seed, groups=4, size=6):
    rng = random.Random(seed)
    edges = set()
    for g in range(groups):
        nodes = range(100 * g, 100 * g + size)
        edges |= {p for p in combinations(nodes, 2) if rng.random() < 0.4}
    edges |= {(1000, 1001 + k) for k in range(8)}  # a hub
    return sorted(edges)


def neighbours(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def search(near, root):
    level, paths, queue = {root: 0}, {root: 1}, deque([root])
    while queue:
        node = queue.popleft()
        for other in near[node]:
            if other not in level:
                level[other], paths[other] = level[node] + 1, 0
                queue.append(other)
            if level[other] == level[node] + 1:
                paths[other] += paths[node]
    return level, paths


def betweenness_by_pairs(edges):
    """Straight from the definition: the share of shortest paths over the edge, for all pairs."""
    near = neighbours(edges)
    found = {r: search(near, r) for r in near}
    total = dict.fromkeys(edges, 0.0)
    for s, t in combinations(sorted(near), 2):
        if t not in found[s][0]:
            continue
        for a, b in edges:
            for x, y in ((a, b), (b, a)):
                if x in found[s][0] and y in found[t][0] and found[s][0][x] + 1 + found[t][0][y] == found[s][0][t]:
                    total[a, b] += found[s][1][x] * found[t][1][y] / found[s][1][t]
    return total


def components_of(edges, nodes):
    near = neighbours(edges)
    label = {}
    for n in sorted(nodes):
        if n not in label:
            for m in search(near, n)[0] if n in near else [n]:
                label[m] = n
    return label


def quality(edges, label):
    near, m = neighbours(edges), len(edges)
    return sum(
        ((b in near[a]) - len(near[a]) * len(near[b]) / (2 * m)) / (2 * m)
        for a in near for b in near if label[a] == label[b]
    )


def removals_by_hand(edges):
    left, steps, nodes = list(edges), [], neighbours(edges)
    while left:
        score = betweenness_by_pairs(left)
        top = min(left, key=lambda e: (-round(score[e], 9), e))
        left.remove(top)
        steps.append((*top, quality(edges, components_of(left, nodes))))
    return steps


def test_paths_and_betweenness(spark, monkeypatch):
    monkeypatch.setattr(graph, "BATCH_CELLS", 400)  # several batches of roots
    edges = random_edges(1)
    df = spark.createDataFrame(edges, "src long, dst long")
    near = neighbours(edges)
    got = {(r.root, r.node): (r.level, r.sigma) for r in graph.shortest_paths(df, graph.degrees(df).select("node")).collect()}
    want = {(s, t): (level[t], paths[t]) for s in near for level, paths in [search(near, s)] for t in level}
    assert got == want
    first = {(r.root, r.node): (r.level, r.sigma) for r in graph.shortest_paths(df).collect()}
    label = components_of(edges, near)
    assert first == {(s, t): v for (s, t), v in want.items() if label[s] == s}
    assert scores(df) == {e: round(v, 6) for e, v in betweenness_by_pairs(edges).items()}


def test_components_of_a_long_path(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 200), (150, 200), (150, 300)]
    random.Random(4).shuffle(chain)
    df = spark.createDataFrame(chain, "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert got == components_of(chain, neighbours(chain))


def test_removal_order(spark):
    edges = [e for e in random_edges(7, 3, 4) if e[0] < 1000]
    trace = com.removal_trace(spark.createDataFrame(edges, "src long, dst long"))
    got = [(r.src, r.dst, round(r.q, 9)) for r in trace.orderBy("step").collect()]
    assert got == [(a, b, round(q, 9)) for a, b, q in removals_by_hand(edges)]


@pytest.mark.parametrize("few", [256, 4])
def test_removal_order_of_small_and_large_components(spark, monkeypatch, few):
    """Small components are cut up in a task, without a round of searches for each edge; large ones in rounds."""
    monkeypatch.setattr(com, "FEW", few)
    rounds, plain = [], com.searched
    monkeypatch.setattr(com, "searched", lambda edges: rounds.append(1) or plain(edges))
    clique = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    ring = [(20 + k, 20 + (k + 1) % 5) for k in range(5)]
    edges = [*clique, *((min(e), max(e)) for e in ring), (20, 22), (40, 41), (41, 42)]
    trace = com.removal_trace(spark.createDataFrame(edges, "src long, dst long"))
    got = [(r.src, r.dst, round(r.q, 9)) for r in trace.orderBy("step").collect()]
    assert got == [(a, b, round(q, 9)) for a, b, q in removals_by_hand(edges)]
    assert bool(rounds) == (few < 5)


def test_documents(spark):
    """All removals of the smallest tables' graph, and the first best partition."""
    edges = [(r.src, r.dst) for r in contract.queries()["cooccurrence_graph"](spark, SMALL).collect()]
    steps = removals_by_hand(edges)
    got = contract.queries()["gn_trace"](spark, SMALL).orderBy("step").collect()
    assert [(r.src, r.dst, r.q) for r in got] == [(a, b, round(q, 6)) for a, b, q in steps]
    best = max(range(len(steps)), key=lambda i: (round(steps[i][2], 9), -i))
    left = [e for e in edges if e not in {s[:2] for s in steps[: best + 1]}]
    trace = spark.createDataFrame([(i + 1, *s) for i, s in enumerate(steps)], "step int, src long, dst long, q double")
    found = com.best_partition(spark.createDataFrame(edges, "src long, dst long"), trace)
    assert {r.node: r.community for r in found.collect()} == components_of(left, neighbours(edges))


def test_little_is_searched(spark, monkeypatch):
    """Trees are peeled off; only what is on cycles is searched."""
    edges = [(k, k + 1) for k in range(12)] + [(100, 100 + k) for k in range(1, 9)] + [(12, 13), (13, 14), (12, 14), (200, 201)]
    cells, plain = [], graph._weighted_levels
    monkeypatch.setattr(graph, "_weighted_levels", lambda *a: cells.append(plain(*a)) or cells[-1])
    assert scores(spark.createDataFrame(edges, "src long, dst long")) == {e: round(v, 6) for e, v in betweenness_by_pairs(edges).items()}
    near = neighbours(edges)
    assert sum(level.count() for levels in cells for level in levels) < sum(len(search(near, n)[0]) for n in near) / 2


def test_parallel_steps(spark):
    edges = random_edges(1)
    nodes, left, want, states = neighbours(edges), list(edges), [], [components_of(edges, neighbours(edges))]
    for number in (1, 2):
        score, top = betweenness_by_pairs(left), {}
        for e in left:
            own = states[-1][e[0]]
            if own not in top or (-round(score[e], 9), e) < (-round(score[top[own]], 9), top[own]):
                top[own] = e
        left = [e for e in left if e not in top.values()]
        states.append(components_of(left, nodes))
        q = quality(edges, states[-1])
        want += [(number, own, *e, round(score[e], 6), round(q, 9)) for own, e in top.items()]
    df = spark.createDataFrame(edges, "src long, dst long")
    steps = com.parallel_steps(df, 2).cache()
    got = [(*r[:4], round(r.betweenness, 6), round(r.q, 9)) for r in steps.collect()]
    assert sorted(got) == sorted(want)
    best = max(range(3), key=lambda i: (round(quality(edges, states[i]), 9), -i))
    assert {r.node: r.community for r in com.best_of_rounds(df, steps).collect()} == states[best]


def test_modularity_of_any_partition(spark):
    edges = random_edges(3)
    label = {n: n % 3 for n in neighbours(edges)}
    members = spark.createDataFrame(sorted(label.items()), "node long, community long")
    df = spark.createDataFrame(edges, "src long, dst long")
    assert graph.modularity(df, members).first().q == pytest.approx(quality(edges, label))


def test_dense_components_are_searched_in_place(spark, monkeypatch):
    """The same scores and labels whether levels are joined or multiplied, beside a sparse component and with peeled leaves."""
    rng = random.Random(4)
    edges = {(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.3}
    edges |= {(100 + a, 100 + b) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.6}
    edges |= {(200 + i, 201 + i) for i in range(30)} | {(200, 230), (39, 300), (300, 301), (104, 302)}
    table = spark.createDataFrame(sorted(edges), "src long, dst long")
    want = [sorted(map(tuple, x.collect())) for x in graph.searched(table)]
    for name, value in (("MUCH", 0), ("SMALL", 12), ("SPARSE", 20), ("ROOTS", 16), ("BLOCK", 5), ("STRIP", 7), ("LARGE", 3.0)):
        monkeypatch.setattr(graph, name, value)
    cells, plain = [], graph._weighted_levels
    monkeypatch.setattr(graph, "_weighted_levels", lambda *a: cells.append(plain(*a)) or cells[-1])
    scores, labels = graph.searched(table)
    got = sorted(map(tuple, scores.collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want[0]]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want[0]])
    assert sorted(map(tuple, labels.collect())) == want[1]
    assert {r.root // 100 for r in cells[0][0].collect()} == {2}  # only the long ring


def test_components_of_some_hundred_nodes_take_no_rounds(spark, monkeypatch):
    """A star of 300 nodes: 299 rounds of Spark jobs before, now one task."""
    monkeypatch.setattr(com, "_large_sequences", None)
    trace = com.removal_trace(spark.createDataFrame([(0, i) for i in range(1, 300)], "src long, dst long"))
    rows = sorted(tuple(r) for r in trace.select("src", "dst").collect())
    assert rows == [(0, i) for i in range(1, 300)]
