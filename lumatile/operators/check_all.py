"""Exhaustive barcode decoding: spots of different rounds that lie together are tried in all combinations.

Per field of view, in one task: passes go from strict to lenient (rounds that may be missing, how
ambiguous a seed may be, bright spots first, growing radius), and spots used by one pass are gone
for the next. Candidates come from a grid of cells; a combination is a tuple of spot numbers by
round, 0 for a round left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Radii of the passes for spots in several planes and in one (fixed values), and within what distance spots share a brightness norm.
RADII_3D = (0, 1.05, 1.5, 1.8, 2.05, 2.3, 2.45, 2.85, 3.05, 3.2, 3.35, 3.5, 3.65, 3.75, 4.05, 4.15, 4.25, 4.4, 4.5)
RADII_2D = (0, 1.05, 1.5, 2.05, 2.3, 2.85, 3.05, 3.2, 3.65, 4.05, 4.15, 4.25, 4.5)
BRIGHT_WITHIN = 100
#: By mode: strictness of passes (positive: seeds with more combinations are dropped, the best is chosen before matching;
#: negative: matching first, seeds with more matches are dropped), of the last pass for missing rounds, by how much fewer
#: than all rounds must agree, and the largest score (fixed values).
MODES = {"high": ((50, -1), 1, (1, 0), 3), "med": ((50, -5), 5, (1, 0), 3), "low": ((50, -100), 10, (1, 1), 100)}
RESULT = "fov STRING, feature_id BIGINT, z DOUBLE, y DOUBLE, x DOUBLE, radius DOUBLE, target STRING, distance DOUBLE, passes_thresholds BOOLEAN, rounds_used INT, barcode ARRAY<INT>, spot_ids ARRAY<BIGINT>"


class Cells:
    """Points of one round by grid cell."""

    def __init__(self, points: np.ndarray, size: float) -> None:
        self.points, self.size = points, size
        self.cells: dict[tuple, list[int]] = defaultdict(list)
        for i, p in enumerate(points):
            self.cells[tuple(np.floor(p / size).astype(int))].append(i)

    def within(self, p: np.ndarray, radius: float) -> np.ndarray:
        home = np.floor(p / self.size).astype(int)
        reach = range(-int(np.ceil(radius / self.size)), int(np.ceil(radius / self.size)) + 1)
        near = [i for d in product(reach, repeat=3) for i in self.cells.get(tuple(home + d), ())]
        if not near:
            return np.zeros(0, int)
        near = np.array(sorted(near))
        return near[np.sqrt(((self.points[near] - p) ** 2).sum(axis=1)) <= radius]


def qualities(points: np.ndarray, channel: np.ndarray, bright: np.ndarray) -> np.ndarray:
    """Brightness over the norm of that of the spots of the same channel and plane within BRIGHT_WITHIN; alone there, of the channel's; alone in it, of all spots'."""
    out = np.zeros(len(points))
    for c in np.unique(channel):
        own = np.flatnonzero(channel == c)
        for z in np.unique(points[own, 0]):
            plane = own[points[own, 0] == z]
            grid = Cells(points[plane], BRIGHT_WITHIN)
            for i in plane:
                near = plane[grid.within(points[i], BRIGHT_WITHIN)]
                group = near if len(near) > 1 else own if len(own) > 1 else np.arange(len(points))
                norm = np.linalg.norm(bright[group])
                out[i] = bright[i] / norm if norm else 0.0
    return out


class Decoder:
    """One field of view."""

    def __init__(self, spots: pd.DataFrame, codes: list[tuple[str, tuple[int, ...]]], rounds: int, search_radius: float, error_rounds: int, mode: str, scale: tuple[float, float, float] | None = None) -> None:
        self.rounds, self.error_rounds, self.mode = rounds, error_rounds, mode
        self.points, self.channel, self.quality, self.ids = [], [], [], []
        for r in range(rounds):
            own = spots[spots["r"] == r].sort_values("spot_id")
            p = own[["z", "y", "x"]].to_numpy(float)
            self.points.append(p)
            self.channel.append(own["c"].to_numpy(int) + 1)
            self.ids.append(own["spot_id"].to_numpy())
            self.quality.append(qualities(p, self.channel[-1], own["intensity"].to_numpy(float)))
        planes = {z for p in self.points for z in p[:, 0]}
        ladder = RADII_3D if len(planes) > 1 and (scale is None or scale[0] < search_radius) else RADII_2D
        unit = 1.0 if scale is None else scale[2]
        top = next(x for x in ladder if x >= search_radius)
        self.radii = [round(x * unit, 5) for x in ladder if x <= top]
        last = self.radii[-1]
        grids = [Cells(p, last or 1.0) for p in self.points]
        # Neighbours and distances at the largest radius, once; smaller radii filter them.
        self.near: list[list[dict[int, tuple[np.ndarray, np.ndarray]]]] = []
        for r in range(rounds):
            rows = []
            for p in self.points[r]:
                found = {}
                for o in range(rounds):
                    if o != r and len(self.points[o]):
                        i = grids[o].within(p, last)
                        found[o] = (i, np.sqrt(((self.points[o][i] - p) ** 2).sum(axis=1)))
                rows.append(found)
            self.near.append(rows)
        self.codes = codes
        self.books = {omit: self._book(omit) for omit in range(error_rounds + 1)}

    def _book(self, omit: int) -> dict[tuple, str]:
        """Channel patterns to targets; with omit, every pattern with that many rounds set to 0."""
        if not omit:
            return {code: t for t, code in self.codes}
        # Patterns that later rounds' omission makes again take the later code.
        return {tuple(0 if r == gone else c for r, c in enumerate(code)): t for gone in reversed(range(self.rounds)) for t, code in self.codes}

    def score(self, code: tuple[int, ...], omit: int) -> float:
        used = [(r, s - 1) for r, s in enumerate(code) if s]
        bright = sum(self.quality[r][i] for r, i in used)
        spread = np.var(np.array([self.points[r][i] for r, i in used]), axis=0).sum()
        return float(np.log(1 + self.rounds - omit - bright) + 2 * np.log(1 + spread))

    def best(self, codes: list[tuple[int, ...]], omit: int) -> tuple[int, float] | None:
        """Place and score of the one best combination; None for a tie."""
        scores = np.array([self.score(c, omit) for c in codes])
        at = np.flatnonzero(scores == scores.min())
        return (int(at[0]), float(scores[at[0]])) if len(at) == 1 else None

    def seeds(self, live: list[set[int]], radius: float, omit: int, strictness: int):
        """(round, combinations) for each seed spot that has enough neighbours."""
        for r in range(self.rounds):
            for i in sorted(live[r]):
                options: list[list[int]] = []
                for o in range(self.rounds):
                    if o == r:
                        options.append([i + 1])
                        continue
                    j, d = self.near[r][i].get(o, (np.zeros(0, int), np.zeros(0)))
                    options.append([int(k) + 1 for k in j[d <= radius] if k in live[o]])
                there = [x for x in options if x]
                if len(there) < self.rounds - omit:
                    continue
                if strictness > 0 and np.prod([len(x) for x in there]) > strictness:
                    continue
                if omit:
                    options = [x if o == r else [*x, 0] for o, x in enumerate(options)]
                codes = [c for c in product(*options) if c.count(0) == omit]
                if codes:
                    yield r, codes

    def chosen(self, live: list[set[int]], radius: float, omit: int, strictness: int) -> list[tuple[tuple[int, ...], str, float]]:
        """Each seed's best decodable combination."""
        book, out = self.books[omit], []
        named = lambda c: book.get(tuple(int(self.channel[r][s - 1]) if s else 0 for r, s in enumerate(c)))
        for _, codes in self.seeds(live, radius, omit, strictness):
            if strictness < 0:
                codes = [c for c in codes if named(c) is not None]
                if not codes or len(codes) > -strictness:
                    continue
            if (found := self.best(codes, omit)) and (target := named(codes[found[0]])) is not None:
                out.append((codes[found[0]], target, found[1]))
        return out

    def independent(self, found: dict[tuple[int, ...], tuple[str, float]]) -> list[tuple[int, ...]]:
        """Combinations that share no spot: those that clash most go first, of equal ones the highest score."""
        by_spot: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        for code in found:
            for r, s in enumerate(code):
                if s:
                    by_spot[r, s].append(code)
        clashes = {c: Counter(o for r, s in enumerate(c) if s for o in by_spot[r, s] if o != c) for c in found}
        keep = [c for c in found if not clashes[c]]
        clashes = {c: n for c, n in clashes.items() if n}
        while clashes:
            edges = {c: sum(n.values()) for c, n in clashes.items()}
            most = max(edges.values())
            for worst in sorted((c for c in edges if edges[c] == most), key=lambda c: (found[c][1], c), reverse=True):
                if worst not in clashes or sum(clashes[worst].values()) != most:
                    continue
                for other in clashes.pop(worst):
                    if other in clashes:
                        del clashes[other][worst]
                        if not clashes[other]:
                            del clashes[other]
                            keep.append(other)
        return keep

    def run(self) -> list[tuple[tuple[int, ...], str, float]]:
        strict, last, fewer, most_score = MODES[self.mode]
        passes = [(s, self.rounds - f) for s, f in zip(strict, fewer, strict=True)]
        if self.error_rounds:
            passes.append((last, self.rounds - 1))
        live = [set(range(len(p))) for p in self.points]
        out = []
        for omit in range(self.error_rounds + 1):
            for k, (strictness, agree) in enumerate(passes):
                final = k == len(passes) - 1
                if omit and not final or self.error_rounds and not omit and final:
                    continue
                for percentile in (50, 0):
                    if sum(not x for x in live) > omit:
                        continue
                    now = [{i for i in x if self.quality[r][i] >= np.percentile(self.quality[r][sorted(x)], percentile)} if x else set() for r, x in enumerate(live)]
                    for radius in self.radii:
                        votes = self.chosen(now, radius, omit, strictness)
                        count = Counter(c for c, _, _ in votes)
                        found = {c: (t, s) for c, t, s in votes if count[c] >= agree}
                        done = [c for c in self.independent(found) if found[c][1] <= most_score]
                        for c in done:
                            out.append((c, *found[c]))
                            for r, s in enumerate(c):
                                if s:
                                    live[r].discard(s - 1)
                                    now[r].discard(s - 1)
        return out


def check_all(spots: DataFrame, codes: DataFrame, rounds: int, channels: int, search_radius: float = 3, error_rounds: int = 0, mode: str = "med", scale: tuple[float, float, float] | None = None) -> DataFrame:
    """Decode spots by trying combinations; codes are (code_idx, target, trace). scale: physical size of a z, y and x step, if radii are physical.

    A field of view whose rounds lack spots beyond error_rounds gives no rows.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {sorted(MODES)}")
    if error_rounds not in (0, 1) or not 0 <= search_radius <= 4.5:
        raise ValueError("error_rounds must be 0 or 1, search_radius 0 to 4.5")
    if scale is not None and min(scale) <= 0:
        raise ValueError("invalid physical coords")
    book = [(r.target, tuple(int(np.argmax(r.trace[k * channels : (k + 1) * channels])) + 1 for k in range(rounds))) for r in codes.orderBy("code_idx").collect()]  # a codebook

    def run(f: pd.DataFrame) -> pd.DataFrame:
        own = f.copy()
        if scale is not None:
            own[["z", "y", "x"]] = own[["z", "y", "x"]] * np.array(scale)
        rows = []
        if sum((own["r"] == r).sum() == 0 for r in range(rounds)) <= error_rounds:
            d = Decoder(own, book, rounds, search_radius, error_rounds, mode, scale)
            raw = {(r, s): p for r, s, p in zip(f["r"], f["spot_id"], f[["z", "y", "x"]].to_numpy(float), strict=True)}
            for code, target, score in d.run():
                ids = [int(d.ids[r][s - 1]) if s else -1 for r, s in enumerate(code)]
                z, y, x = np.mean([raw[r, i] for r, i in enumerate(ids) if i >= 0], axis=0).round()
                barcode = [int(d.channel[r][s - 1]) - 1 if s else -1 for r, s in enumerate(code)]
                rows.append((f["fov"].iloc[0], len(rows), z, y, x, 1.0, target, score, True, rounds - code.count(0), barcode, ids))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return spots.select("fov", "r", "c", "spot_id", "z", "y", "x", "intensity").groupBy("fov").applyInPandas(run, RESULT)
