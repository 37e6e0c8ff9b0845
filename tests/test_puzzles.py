"""Order-dependent and numerical operators against plain versions of their definitions."""

import collections
import itertools
import math

import numpy as np
import pytest

from tessella.operators import assembly, clusters, curves, graphs, kernels, layout, ranking, registry, scoring, series, similar, text, thresholds
from tessella.plans import puzzles
from tessella.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _greedy_pairs(pairs, cap):
    used, out = collections.Counter(), []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if used[a] < cap and used[b] < cap:
            used[a] += 1
            used[b] += 1
            out.append((a, b, s))
    return sorted(out)


@pytest.mark.parametrize("cap", [1, 3])
def test_greedy_matching_in_rounds_and_in_order(spark, cap):
    rng = np.random.default_rng(cap)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (300, 2)) if a < b})
    scored = [(a, b, float(rng.integers(0, 12)) / 12) for a, b in pairs] + [(100 + k, 101 + k, 1 - k / 100) for k in range(12)]
    df = spark.createDataFrame([("c", *p) for p in scored], "channel string, a long, b long, score double")
    for few in (1000, 5):
        got = ranking.greedy_matching(df, ["channel"], cap, few=few).collect()
        assert sorted((r.a, r.b, r.score) for r in got) == _greedy_pairs(scored, cap)


def test_filter_chain(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), float(s), int(n)) for a, b, s, n in zip(rng.integers(0, 12, 400), rng.integers(0, 12, 400), rng.random(400).round(2), rng.integers(0, 9, 400), strict=True) if a != b]
    best = {}
    for a, b, s, n in rows:
        if s >= 0.3 and n >= 2:
            best[min(a, b), max(a, b)] = max(best.get((min(a, b), max(a, b)), (0, 0)), (s, n))
    want = sorted(_greedy_pairs([(a, b, s) for (a, b), (s, _) in best.items()], 4), key=lambda p: (-p[2], p[0], p[1]))[:15]
    got = ranking.filter_pairs(spark.createDataFrame(rows, "a long, b long, score double, n_inliers long"), 0.3, 2, 4, 15).collect()
    assert sorted((r.a, r.b, r.score) for r in got) == sorted(want)


def test_greedy_sequence_against_a_dense_matrix(spark):
    rng = np.random.default_rng(5)
    for signed in (False, True):
        cells = {(int(i), int(j)): round(float(s) - 0.5 * signed, 1) for i, j, s in zip(rng.integers(0, 15, 120), rng.integers(0, 15, 120), rng.random(120), strict=True)}
        items = sorted({k for c in cells for k in c})
        m = np.zeros((len(items), len(items)))
        for (i, j), s in cells.items():
            m[items.index(i), items.index(j)] = s
        order, free = [int(m.sum(1).round(9).argmax())], np.ones(len(items), bool)
        free[order[0]] = False
        while free.any():
            order.append(int(np.where(free, m[order[-1]], -np.inf).argmax()))
            free[order[-1]] = False
        df = spark.createDataFrame([("x", i, j, s) for (i, j), s in cells.items()], "channel string, i long, j long, score double")
        got = kernels.greedy_sequence(df, ["channel"]).orderBy("pos").collect()
        assert [r.item for r in got][1:] == [items[k] for k in order][1:] or signed
        assert sorted(r.item for r in got) == items


def _dtw(x, y, window):
    n, m = len(x), len(y)
    if not n or not m:
        return math.inf
    band, t = max(window, abs(n - m)), {(0, 0): 0.0}
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            t[i, j] = float(np.linalg.norm(x[i - 1] - y[j - 1])) + min(t.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return t[n, m] / (n + m)


def _frechet(x, y):
    d = lambda i, j: float(np.linalg.norm(x[i] - y[j]))
    t = {}
    for i, j in itertools.product(range(len(x)), range(len(y))):
        before = [t[k] for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if k in t]
        t[i, j] = max(min(before), d(i, j)) if before else d(i, j)
    return t[len(x) - 1, len(y) - 1]


def test_curve_distances():
    rng = np.random.default_rng(6)
    xs, ys = ([rng.random((int(n), 2)) for n in rng.integers(1, 12, 30)] for _ in range(2))
    for window in (2, 20):
        assert np.allclose(curves.dtw_distances(xs, ys, window), [_dtw(x, y, window) for x, y in zip(xs, ys, strict=True)])
    assert np.allclose(curves.frechet_distances(xs, ys), [_frechet(x, y) for x, y in zip(xs, ys, strict=True)])
    assert curves.dtw_distances([np.zeros((0, 2))], [xs[0]])[0] == math.inf
    # Equal steps, as else the centroid about which the curve is turned would move.
    x = curves.resampled(rng.random((20, 2)).cumsum(0), 64)
    for degrees in (0.0, 40.0, 130.0):
        d, a, mirrored = curves.rotation_dtw(x, curves.turned(x, -degrees), 36, 64, 10, True)
        assert d < 1e-2 and a == degrees and not mirrored
    flipped = np.column_stack([2 * x[:, 0].mean() - x[:, 0], x[:, 1]])
    assert curves.rotation_dtw(x, flipped, 36, 64, 10, True)[2]


def _walked(points, step):
    """Steps of a ruler along the points: segment by segment, the rest of a segment carried on."""
    n, at, i = 0, points[0], 0
    while i < len(points) - 1:
        left = step
        while i < len(points) - 1 and left > 0:
            d = float(np.hypot(*(points[i + 1] - at)))
            if d <= left:
                left, at, i = left - d, points[i + 1], i + 1
            else:
                at, left = at + left / d * (points[i + 1] - at), 0
        n += 1
    return n


def test_divider_dimension():
    rng = np.random.default_rng(7)
    for n in (40, 300):
        x = rng.standard_normal((n, 2)).cumsum(0)
        whole = np.hypot(*np.diff(x, axis=0).T).sum()
        steps = np.geomspace(whole * 0.005, whole * 0.15, 8)
        counts = np.array([_walked(x, s) for s in steps])
        want = 1 - np.polyfit(np.log(steps[counts > 1]), np.log((counts * steps)[counts > 1]), 1)[0]
        assert curves.divider_dimension(x) == pytest.approx(np.clip(want, 1, 2), abs=1e-6)
    assert curves.divider_dimension(np.zeros((5, 2))) == 1.0 and curves.divider_dimension(np.zeros((1, 2))) == 1.0


def test_css_vectors():
    t = np.linspace(0, 2 * np.pi, 128, endpoint=False)
    circle, wave = np.column_stack([np.cos(t), np.sin(t)]), np.column_stack([(1 + 0.3 * np.cos(5 * t)) * np.cos(t), (1 + 0.3 * np.cos(5 * t)) * np.sin(t)])
    for c in (circle, wave):
        assert np.linalg.norm(curves.css_vector(c)) == pytest.approx(1)
    assert curves.css_vector(wave) @ curves.css_vector(wave * 3 + 1) == pytest.approx(1) and curves.css_vector(wave) @ curves.css_vector(circle) < 0.9


def test_matrix_and_solvers(spark):
    edges = puzzles._edges(spark, SF).where("assembly < 2").cache()
    rows = {(r.assembly, r.edge_id): r for r in edges.collect()}
    want = {}
    for (s, i), (t, j) in itertools.combinations(sorted(rows), 2):
        x, y = rows[s, i], rows[t, j]
        if s == t and x.fragment_id != y.fragment_id:
            p, q = (np.array(r.curve) for r in (x, y))
            dtw = min(_dtw(p, q, 20), _dtw(p, q[::-1], 20))
            n = min(len(x.css), len(y.css))
            a, b = np.array(x.css[:n]), np.array(y.css[:n])
            whole = np.array(y.css[::-1][:n])
            css = max(a @ b / np.linalg.norm(a) / np.linalg.norm(b), a @ whole / np.linalg.norm(a) / np.linalg.norm(whole))
            k = min(len(x.ifs), len(y.ifs))
            ifs = np.linalg.norm(np.array(x.ifs[:k]) - np.array(y.ifs[:k])) / np.sqrt(k)
            score = 0.35 * css + 0.3 * (0.7 / (1 + dtw) + 0.3 / (1 + ifs)) + 0.2 / (1 + abs(x.fd - y.fd))
            ratio = min(x.length, y.length) / (max(x.length, y.length) + 1e-5)
            want[s, i, j] = score * (ratio if ratio < 0.5 else 1)
    scored = assembly.entries(edges).cache()
    got = {(r.assembly, r.edge_i, r.edge_j): r.score for r in scored.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    totals = {}
    for method in assembly.SOLVERS:
        placed = assembly.solve(edges, scored, method, **({"rounds": 50} if method == "annealing" else {})).collect()
        assert sorted((r.assembly, r.fragment_id) for r in placed) == sorted({(r.assembly, r.fragment_id) for r in rows.values()})
        totals[method] = {r.assembly: r.total for r in placed}
    assert all(abs(totals["greedy"][s] - sum(v for k, v in got.items() if k[0] == s)) < 1e-9 for s in (0, 1))
    assert all(totals["exhaustive"][s] >= totals["beam"][s] - 1e-9 for s in (0, 1))


def test_solvers_on_small_puzzles():
    rng = np.random.default_rng(8)
    for n in (1, 2, 4, 5):
        edges = {2 * f + k: f for f in range(n) for k in (0, 1)}
        scored = [(i, j, edges[i], edges[j], round(float(rng.random()), 3)) for i, j in itertools.combinations(edges, 2) if edges[i] != edges[j]]
        puzzle = assembly.Puzzle(list(range(n)), scored, {e: (float(rng.random()), float(rng.random())) for e in edges})

        def best(placed, total):
            steps = [(new, s) for _, _, i, j, s in scored if (i in placed) != (j in placed) for new in ([j] if i in placed else [i])]
            return max([best(placed | {f}, total + s) for f, s in steps], default=total)

        if n <= 4:
            assert puzzle.exhaustive()[1] == pytest.approx(best({0}, 0.0))
        for solve in assembly.SOLVERS.values():
            placed, _ = solve(puzzle)
            assert sorted(placed) == list(range(n))
        placed, _ = puzzle.beam()
        assert placed[0] == (0.0, 0.0, 0.0)
        # The middles of the edges that joined a fragment lie at one point.
        for new, at, _ in puzzle.steps({0: (0.0, 0.0, 0.0)}):
            i, j = next((i, j) for i, j, f, g, _ in puzzle.scored if {f, g} == {0, new})
            own, other = (i, j) if edges[i] == 0 else (j, i)
            (mx, my), c, s = puzzle.middles[other], math.cos(at[2]), math.sin(at[2])
            assert (at[0] + c * mx - s * my, at[1] + s * mx + c * my) == pytest.approx(puzzle.middles[own])
            break


def test_graphs(spark):
    rng = np.random.default_rng(9)
    links = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 24, (22, 2)) if a != b})
    weights = {e: float(w) for e, w in zip(links, rng.integers(1, 6, len(links)), strict=True)}
    edges = spark.createDataFrame([(*e, w) for e, w in weights.items()], "a long, b long, weight double")
    root = {k: k for e in links for k in e}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    forest = []
    for w, a, b in sorted((w, a, b) for (a, b), w in weights.items()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            forest.append((a, b, w))
    assert {r.node: r.component for r in graphs.connected(edges).collect()} == {k: find(k) for k in root}
    assert sorted((r.a, r.b, r.weight) for r in graphs.spanning_forest(edges).collect()) == sorted(forest)
    chain = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in itertools.pairwise(rng.permutation(60).tolist())], "a long, b long, weight double")
    assert {r.component for r in graphs.connected(chain).collect()} == {0}


def test_vector_search(spark):
    rng = np.random.default_rng(10)
    v = rng.integers(-3, 4, (120, 5)).astype(float)
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "id long, v array<double>")
    got = {(r.a, r.b): (r.c, r.d) for r in similar.scored(df.where("id % 20 = 0"), df).collect()}
    assert got.keys() == {(a, b) for a in range(0, 120, 20) for b in range(120) if a != b}
    for (a, b), (c, d) in got.items():
        norm = np.linalg.norm(v[a]) * np.linalg.norm(v[b])
        assert c == pytest.approx(v[a] @ v[b] / norm if norm else 0.0) and d == pytest.approx(np.linalg.norm(v[a] - v[b]))
    best = similar.scored(df.where("id % 20 = 0"), df, 3).select("a", "b").collect()
    for a in range(0, 120, 20):
        near = sorted((round(d, 9), b) for (q, b), (_, d) in got.items() if q == a)[:3]
        assert {b for _, b in near} <= {r.b for r in best if r.a == a}


def test_tracks_frames_and_merged_boxes(spark):
    frames = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (2, 1, 0.9, 0.0), (2, 3, 5.0, 0.0), (3, 9, 90.0, 0.0)], "frame long, id long, x double, y double")
    assert sorted((r.frame, r.a, r.b) for r in clusters.tracked(frames, 8.0).collect()) == [(1, 1, 1), (1, 2, 3)]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (2, 3.0, 3.0, 4.0, 4.0), (3, 0.5, 5.5, 1.0, 1.0), (4, 50.0, 50.0, 1.0, 1.0), (5, 51.0, 50.0, 1.0, 1.0)], "id long, x double, y double, w double, h double")
    assert sorted(map(tuple, layout.merged(boxes, 8.0).collect())) == [(1, 0.0, 0.0, 7.0, 7.0, 3), (4, 50.0, 50.0, 1.0, 1.0, 1), (5, 51.0, 50.0, 1.0, 1.0, 1)]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_turn_similarity_by_characters(spark):
    got = {(r.conv_id, r.turn): r.similarity for r in QUERIES["text_turn_similarity"](spark, SF).collect()}
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text))
    n = 0
    for conv, own in turns.items():
        for (_, _, a), (t, _, b) in itertools.pairwise(sorted(own)):
            if max(len(a), len(b)) < 400:
                n += 1
                want = 1 - _distance(a, b) / max(len(a), len(b)) if a or b else 1.0
                assert got[conv, t] == pytest.approx(want, abs=1e-5)
    assert n > 5


def test_seams_and_cleaned_texts(spark):
    cases = [("the of ", "an end", 0.2), ("whole word", "of", 0.5), ("pre-ab", "whole", 1.0), ("", "x", 0.5), (" \n", "word", 0.5), ("слово не", "да", 0.2), ("abc.", "whole", 1.0), ("ends", "a1 b", 1.0)]
    df = spark.createDataFrame(cases, "l string, r string, want double")
    assert all(r.got == r.want for r in df.withColumn("got", text.seam_score(df.l, df.r)).collect())
    raw = spark.createDataFrame([("é  A​\t B!\x00\n c ",), (None,), ("",)], "t string")
    assert [r[0] for r in raw.select(text.cleaned(raw.t)).collect()] == ["é A B!\n c", None, ""]
    assert [r[0] for r in raw.select(text.cleaned(raw.t, True, True)).collect()] == ["é a b\n c", None, ""]


def test_conventions(spark):
    flat = spark.createDataFrame([("r", k, 0.5) for k in range(3)] + [("s", 0, 0.2)], "a string, b long, score double")
    assert {(r.a, r.normed) for r in scoring.rank_in_rows(flat, "score", ["a"], ["b"]).collect()} == {("r", 0.5), ("s", 0.0)}
    gaps = spark.createDataFrame([(1, 1, None), (1, 2, float("nan")), (1, 3, 4.0), (1, 4, float("nan")), (1, 5, 8.0), (2, 1, float("nan"))], "series long, step long, value double")
    assert [r.filled for r in scoring.fill_gaps(gaps).orderBy("series", "step").collect()] == [4.0, 4.0, 4.0, 6.0, 8.0, 0.0]
    none = spark.createDataFrame([("g", 4)], "g string, n_pairs long")
    assert scoring.boundary_quality(spark.createDataFrame([], "g string, severity double"), none, ["g"]).first().quality == 1.0
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, v double")
    assert {r.normed for r in thresholds.minmax(same, "v", low=-1.0).collect()} == {-1.0}
    odd = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([3, 1, 2], 1)], "series long, step long, value double")
    assert [r.rolling for r in series.reflected_mean(odd, 8).collect()] == [None] * 3


def test_registered_functions(spark):
    items = spark.createDataFrame([("4",), ("x",), (None,)], "item string")
    got = registry.applied(items, "item", int, "long", 2).collect()
    assert [(r.success, r.result, r.retries) for r in got] == [(True, 4, 0), (False, None, 2), (False, None, 2)]
    assert got[1].error.startswith("ValueError: ") and got[2].error.startswith("TypeError: ")
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.7), (3, 4, 0.1)], "a long, b long, score double")
    kept = registry.filtered(pairs, [("score", {"least": 0.3}), ("best", {}), ("top", {"k": 1})])
    assert [tuple(r) for r in kept.collect()] == [(1, 2, 0.7)]
    with pytest.raises(KeyError):
        registry.filtered(pairs, [("unknown", {})])
