"""From edges of fragments to placed assemblies: pair scores, the compatibility matrix, and solvers that run one assembly a task.

Edges: (assembly, fragment_id, edge_id, curve array<array<double>>, css array<double>, ifs array<double>, fd, length, text). Entries:
(assembly, edge_i, edge_j, frag_i, frag_j, score, ...) with edge_i < edge_j. A solver holds one assembly's entries and is
sequential by nature; assemblies, methods and seeds run side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import curves

# Weights of the matchers.
WEIGHTS = {"css": 0.35, "dtw": 0.30, "fd": 0.20, "text": 0.15}

Placements = dict[int, tuple[float, float, float]]


def _ifs_distance(a: Column, b: Column) -> Column:
    """Distance of the common beginnings over the root of their length; 1 if there is none."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n == 0, 1.0).otherwise(V.euclidean(F.slice(a, 1, n), F.slice(b, 1, n)) / F.sqrt(n))


def match_scores(pairs: DataFrame, weights: dict[str, float] | None = None, how: str = "weighted") -> DataFrame:
    """pairs with columns css_x, css_y, curve_x ... length_x, length_y, text: adds css_sim, dtw_dist, fd_diff and score in [0, 1].

    how: weighted, min, max or rank over the matchers css, dtw (0.7 warping and 0.3 transform coefficients), fd and text. Edges of very
    different lengths (below 1 : 2) lose in proportion.
    """
    w = weights or WEIGHTS
    near = lambda d: 1 / (1 + d)
    rows = pairs.withColumns({
        "css_sim": V.css_similarity_mirror(F.col("css_x"), F.col("css_y")), "dtw_dist": curves.dtw("curve_x", "curve_y", mirror=True),
        "fd_diff": F.abs(F.col("fd_x") - F.col("fd_y")), "ifs_dist": _ifs_distance(F.col("ifs_x"), F.col("ifs_y")),
    })
    parts = {"css": F.col("css_sim"), "dtw": 0.7 * near(F.col("dtw_dist")) + 0.3 * near(F.col("ifs_dist")), "fd": near(F.col("fd_diff")), "text": F.col("text")}
    used = [parts[k] for k in w if k in parts]
    n = len(used)
    score = {
        "weighted": sum((w[k] * parts[k] for k in w if k in parts), F.lit(0.0)), "min": F.least(*used) if n > 1 else used[0], "max": F.greatest(*used) if n > 1 else used[0],
        "rank": F.lit((n + 1) / (2 * n)),
    }[how]
    ratio = F.least("length_x", "length_y") / (F.greatest("length_x", "length_y") + 1e-5)
    score = score * F.when(ratio < 0.5, ratio).otherwise(1.0)
    return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop("ifs_dist")


def entries(edges: DataFrame, threshold: float = 0.0, weights: dict[str, float] | None = None, how: str = "weighted") -> DataFrame:
    """The upper triangle of an assembly's compatibility matrix: every two edges of different fragments, scored, at least `threshold`.

    The matrix is quadratic in an assembly's edges by definition; an assembly's pairs are dealt over tasks by both edges.
    """
    columns = [c for c in edges.columns if c not in ("assembly", "text")]
    side = lambda s: edges.select("assembly", *[F.col(c).alias(f"{c}_{s}") for c in columns])
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = side("x").repartition(parts, "assembly", "edge_id_x").join(F.broadcast(side("y")) if _small(edges) else side("y"), "assembly")
    pairs = pairs.where("edge_id_x < edge_id_y and fragment_id_x <> fragment_id_y").withColumn("text", F.lit(0.0))
    found = match_scores(pairs, weights, how).where(F.col("score") >= threshold)
    return found.select("assembly", F.col("edge_id_x").alias("edge_i"), F.col("edge_id_y").alias("edge_j"), F.col("fragment_id_x").alias("frag_i"), F.col("fragment_id_y").alias("frag_j"), "score", "css_sim", "dtw_dist", "fd_diff")


def _small(df: DataFrame, most: int = 10_000) -> bool:
    """At most `most` rows, found without reading more than that."""
    return len(df.select("edge_id").take(most + 1)) <= most


def top_candidates(scored: DataFrame, k: int = 5) -> DataFrame:
    """(assembly, edge, other, score, rank): the k best partners of every edge, only those above 0."""
    both = scored.select("assembly", F.col("edge_i").alias("edge"), F.col("edge_j").alias("other"), "score").union(scored.select("assembly", "edge_j", "edge_i", "score"))
    best = Window.partitionBy("assembly", "edge").orderBy(F.desc("score"), "other")
    return both.where("score > 0").withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


class Puzzle:
    """One assembly: its fragments in order of id, its entries from the best on, the middles of its edges."""

    def __init__(self, fragments: list[int], scored: list[tuple[int, int, int, int, float]], middles: dict[int, tuple[float, float]]):
        self.fragments = sorted(fragments)
        self.scored = sorted(scored, key=lambda e: (-e[4], e[0], e[1]))
        self.middles = middles

    def beside(self, placed: Placements, edge: int, anchor: int, new_edge: int) -> tuple[float, float, float]:
        """Where a fragment lies whose edge meets a placed one's: turned by half a turn against it, the middles of both edges at one point."""
        x, y, angle = placed[anchor]
        (mx, my), (nx, ny) = self.middles[edge], self.middles[new_edge]
        turn = angle + math.pi
        c, s, d, t = math.cos(angle), math.sin(angle), math.cos(turn), math.sin(turn)
        return x + c * mx - s * my - (d * nx - t * ny), y + s * mx + c * my - (t * nx + d * ny), turn

    def steps(self, placed: Placements) -> Iterator[tuple[int, tuple[float, float, float], float]]:
        """Entries that join a placed and an open fragment, from the best on: (new fragment, its place, score)."""
        for edge_i, edge_j, i, j, score in self.scored:
            if (i in placed) != (j in placed):
                new, edge, anchor, own = (j, edge_i, i, edge_j) if i in placed else (i, edge_j, j, edge_i)
                yield new, self.beside(placed, edge, anchor, own), score

    def first(self) -> Placements:
        return {self.fragments[0]: (0.0, 0.0, 0.0)} if self.fragments else {}

    def with_orphans(self, placed: Placements) -> Placements:
        """Fragments that no entry joins stand in a row below the others."""
        low = max((y for _, y, _ in placed.values()), default=0.0) + 200.0
        rest = [f for f in self.fragments if f not in placed]
        return placed | {f: (k * 150.0, low, 0.0) for k, f in enumerate(rest)}

    def greedy(self) -> tuple[Placements, float]:
        """One pass over the entries from the best on: an entry places its open fragment if the other one is placed already.

        The score sums all entries, as orphans are placed too.
        """
        placed = self.first()
        for edge_i, edge_j, i, j, _ in self.scored:
            if (i in placed) != (j in placed):
                new, edge, anchor, own = (j, edge_i, i, edge_j) if i in placed else (i, edge_j, j, edge_i)
                placed[new] = self.beside(placed, edge, anchor, own)
        return self.with_orphans(placed), sum(e[4] for e in self.scored)

    def beam(self, width: int = 10) -> tuple[Placements, float]:
        """The `width` best partial assemblies go on, each by its best entry for each of up to 2 * width open fragments."""
        live: list[tuple[Placements, float]] = [(self.first(), 0.0)]
        for _ in self.fragments[1:]:
            if all(len(p) == len(self.fragments) for p, _ in live):
                break
            grown = []
            for placed, score in live:
                seen: set[int] = set()
                for new, at, gain in self.steps(placed):
                    if new not in seen:
                        seen.add(new)
                        grown.append((placed | {new: at}, score + gain))
                        if len(seen) >= 2 * width:
                            break
            if not grown:
                break
            live = sorted(grown, key=lambda h: -h[1])[:width]
        placed, score = max(live, key=lambda h: h[1])
        return self.with_orphans(placed), score

    def nearness(self, placed: Placements, reach: float = 120.0) -> float:
        """Sum of the scores of entries whose fragments lie near each other, less the farther they are."""
        total = 0.0
        for _, _, i, j, score in self.scored:
            if i in placed and j in placed:
                off = math.hypot(placed[i][0] - placed[j][0], placed[i][1] - placed[j][1])
                total += score * max(0.0, 1.0 - off / (2 * reach))
        return total

    def annealed(self, seed: int = 42, hot: float = 1000.0, cold: float = 0.1, cooling: float = 0.995, rounds: int = 10_000) -> tuple[Placements, float]:
        """From the greedy assembly: swap two fragments, turn or shift one; worse ones are taken with probability exp(loss / temperature)."""
        placed, _ = self.greedy()
        rng = np.random.default_rng(seed)
        now = best = self.nearness(placed)
        kept, heat = dict(placed), hot
        for _ in range(rounds if len(self.fragments) > 1 else 0):
            if heat < cold:
                break
            trial, move = dict(placed), rng.integers(3)
            a = self.fragments[rng.integers(len(self.fragments))]
            if move == 0:
                b = self.fragments[rng.integers(len(self.fragments))]
                trial[a], trial[b] = trial[b], trial[a]
            elif move == 1:
                trial[a] = (*trial[a][:2], trial[a][2] + math.pi / 2 * rng.integers(1, 4))
            else:
                trial[a] = (trial[a][0] + rng.normal(0, 20), trial[a][1] + rng.normal(0, 20), trial[a][2])
            then = self.nearness(trial)
            if then > now or rng.random() < math.exp((then - now) / heat):
                placed, now = trial, then
                if now > best:
                    kept, best = dict(placed), now
            heat *= cooling
        return kept, best

    def exhaustive(self, most: int = 8) -> tuple[Placements, float]:
        """The best tree of entries over all orders, by branch and bound from the greedy chain's score; the beam beyond `most` fragments.

        The bound adds to a partial score the best entry of every open fragment.
        """
        if len(self.fragments) > most:
            return self.beam()
        best_of = {f: max((e[4] for e in self.scored if f in e[2:4]), default=0.0) for f in self.fragments}
        found = self.beam(1)
        seen: dict[frozenset[int], float] = {}

        def search(placed: Placements, score: float) -> None:
            nonlocal found
            if score > found[1] + 1e-12:
                found = (self.with_orphans(placed), score)
            if score + sum(v for f, v in best_of.items() if f not in placed) <= found[1] + 1e-12:
                return
            for new, at, gain in self.steps(placed):
                # What can still be gained depends on the placed fragments alone.
                state = frozenset((*placed, new))
                if seen.get(state, -1.0) < score + gain:
                    seen[state] = score + gain
                    search(placed | {new: at}, score + gain)

        search(self.first(), 0.0)
        return found


#: Solvers by name; further ones may be registered.
SOLVERS = {"greedy": Puzzle.greedy, "beam": Puzzle.beam, "annealing": Puzzle.annealed, "exhaustive": Puzzle.exhaustive}


def solve(edges: DataFrame, scored: DataFrame, method: str, **options) -> DataFrame:
    """(assembly, fragment_id, x, y, angle, total) of every assembly by one method: a task holds one assembly's entries."""
    import pandas as pd

    mid = lambda d: F.aggregate("curve", F.lit(0.0), lambda s, p: s + p[d]) / F.size("curve")
    middles = edges.select("assembly", F.col("fragment_id").alias("frag_i"), F.col("edge_id").alias("edge_i"), mid(0).alias("x"), mid(1).alias("y"))
    rows = scored.select("assembly", "edge_i", "edge_j", "frag_i", "frag_j", "score").withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")})
    rows = rows.unionByName(middles.withColumns({"edge_j": F.lit(None).cast("long"), "frag_j": F.lit(None).cast("long"), "score": F.lit(None).cast("double")}))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, links = pdf[pdf["score"].isna()], pdf[pdf["score"].notna()]
        middle = {int(e): (x, y) for e, x, y in zip(own["edge_i"], own["x"], own["y"], strict=True)}
        at = [(int(a), int(b), int(i), int(j), float(s)) for a, b, i, j, s in links[["edge_i", "edge_j", "frag_i", "frag_j", "score"]].itertuples(index=False)]
        placed, total = SOLVERS[method](Puzzle([int(f) for f in own["frag_i"].unique()], at, middle), **options)
        return pd.DataFrame([(key[0], f, *place, total) for f, place in sorted(placed.items())], columns=["assembly", "fragment_id", "x", "y", "angle", "total"])

    kind = edges.schema["assembly"].dataType.simpleString()
    return rows.groupBy("assembly").applyInPandas(run, f"assembly {kind}, fragment_id long, x double, y double, angle double, total double")


def fragment_scores(placed: DataFrame, adjacent: DataFrame, costs: DataFrame, least: int = 1) -> DataFrame:
    """(id, local_score, n_neighbors, reliable) of placed(id): the mean cost to placed neighbours in adjacent(a, b), clipped; 0.5 without any."""
    ids = placed.select("id").distinct()
    both = adjacent.select("a", "b").union(adjacent.select("b", "a")).distinct()
    near = both.join(ids.withColumnRenamed("id", "b"), "b", "left_semi").join(costs.select("a", "b", "cost"), ["a", "b"], "left")
    sums = near.groupBy(F.col("a").alias("id")).agg(F.avg(F.coalesce("cost", F.lit(0.0))).alias("m"), F.count("*").alias("n"))
    score = F.when(F.col("n").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m"))))
    n = F.coalesce("n", F.lit(0))
    return ids.join(sums, "id", "left").select("id", score.alias("local_score"), n.alias("n_neighbors"), (n >= least).alias("reliable"))
