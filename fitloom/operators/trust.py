"""A reflective trust region for least squares within bounds, from sums only.

What a step needs are the sums of products of derivatives (``a``), of derivatives and residuals (``g``), and of squared residuals (``sse``)
at a point: k * k + k + 1 numbers, however many rows they stand for. Variables are measured by the norms of their columns, and towards a
bound by the square root of the distance to it, so steps shrink as they come near one. A step that leaves the box is cut at it, reflected from
it, or replaced by the steepest descent, whichever the quadratic model likes best. Each call proposes up to three points, for the radius, a
shorter and a longer one, to be looked at side by side: all sums of the first, the squared residuals of the others. The best of them counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Gains below this part of the sum of squares end a fit: the first that is as the model says, or two in a row.
TOLERANCE = 1e-10
#: Norms of the scaled step below which a fit ends.
LEAST_STEP = 1e-11
#: Steps that lower the sum of squares without bounds, at most, as ``fitting.marquardt`` takes them.
MOVES = 200


@dataclass
class Sums:
    """Of all rows at one point; ``bad`` rows have no finite value there. Without ``a`` and ``g`` where only residuals were looked at."""

    sse: float
    a: np.ndarray | None = None
    g: np.ndarray | None = None
    bad: int = 0

    def usable(self) -> bool:
        return bool(np.isfinite(self.sse) and (self.a is None or np.all(np.isfinite(self.a)) and np.all(np.isfinite(self.g))))


@dataclass
class State:
    """Where a fit stands, and what it wants to know next: the sums at its ``trials``."""

    lower: np.ndarray
    upper: np.ndarray
    x: np.ndarray
    trials: list[np.ndarray]
    sums: Sums | None = None
    radius: float = 0.0
    scale: np.ndarray | None = None
    sizes: list[float] = field(default_factory=list)
    gains: list[float] = field(default_factory=list)
    quiet: int = 0
    settled: bool = False

    @classmethod
    def begin(cls, start: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> State:
        x = inside(np.clip(start, lower, upper), lower, upper)
        return cls(lower, upper, x, [x])

    def learn(self, found: list[Sums]) -> None:
        """The sums at the trials, in order: the best one becomes the point, and there are new trials or the fit is settled."""
        if self.sums is None or self.sums.a is None:  # the derivatives at a point that has been taken
            if not found[0].usable():
                self.sums, self.settled, self.trials = None, True, []
                return
            self.sums = found[0]
        else:
            best = min(range(len(found)), key=lambda i: (not found[i].usable(), found[i].sse if found[i].usable() else 0.0))
            gain = self.sums.sse - found[best].sse if found[best].usable() else -1.0
            little = TOLERANCE * self.sums.sse
            if gain > 0:
                ratio, size = gain / max(self.gains[best], 1e-300), self.sizes[best]
                self.radius = size / 2 if ratio < 0.25 else max(self.radius, 2 * size) if ratio > 0.75 else size
                self.quiet = 0 if gain > little else self.quiet + 1 + (ratio > 0.25)
                self.x, self.sums = self.trials[best], found[best]
            else:
                self.quiet += max(self.gains, default=0.0) <= little
                self.radius = min(self.sizes, default=0.0) / 16
        if not len(self.x) or self.sums.sse == 0 or self.quiet >= 2:
            self.settled, self.trials = True, []
        elif self.sums.a is None:
            self.trials = [self.x]
        else:
            self.propose()

    def propose(self) -> None:
        norms = np.sqrt(np.diag(self.sums.a))
        norms = norms if self.scale is None else np.maximum(norms, self.scale)
        self.scale = norms
        unit = 1.0 / np.where(norms > 0, norms, 1.0)
        model = Model(self.x / unit, unit * self.sums.g, self.sums.a * np.outer(unit, unit), self.lower / unit, self.upper / unit)
        if not self.radius:
            self.radius = float(np.linalg.norm(self.x / unit / model.d)) or 1.0
        steps: list[tuple[np.ndarray, float, float]] = []
        for times in (1.0, 0.125, 8.0):
            step, size, gain = model.step(self.radius * times)
            if gain > 0 and all(abs(size - s) > 1e-6 * s for _, s, _ in steps):
                steps.append((inside((model.z + step) * unit, self.lower, self.upper), size, gain))
        self.trials, self.sizes, self.gains = [p for p, _, _ in steps], [s for _, s, _ in steps], [g for _, _, g in steps]
        if not steps or max(self.sizes) < LEAST_STEP * (1 + float(np.linalg.norm(model.z))):
            self.settled, self.trials = True, []


@dataclass
class Damped(State):
    """The same without bounds, by the steps of ``fitting.marquardt``: each round looks at three dampings, of which the least that lowers the sum
    of squares counts, as if they were tried one after the other."""

    damping: float = 1e-3
    moves: int = 0
    used: list[float] = field(default_factory=list)

    @classmethod
    def begin(cls, start: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> Damped:
        return cls(lower, upper, start, [start])

    def learn(self, found: list[Sums]) -> None:
        if self.sums is None or self.sums.a is None:
            if not found[0].usable():
                self.sums, self.settled, self.trials = (None if self.sums is None else self.sums), True, []
                return
            self.sums = found[0]
        else:
            best = next((i for i, s in enumerate(found) if np.isfinite(s.sse) and s.sse < self.sums.sse), None)
            if best is None:
                self.damping *= 4.0 ** len(found)
            else:
                gain = self.sums.sse - found[best].sse
                self.moves += 1
                self.quiet = self.quiet + 1 if gain <= 1e-12 * found[best].sse else 0
                self.x, self.sums, self.damping = self.trials[best], found[best], max(self.used[best] / 6, 1e-15)
        if not len(self.x) or self.sums.sse == 0 or self.quiet >= 2 or self.moves >= MOVES:
            self.settled, self.trials = True, []
        elif self.sums.a is None or not self.sums.usable():
            self.trials, self.sums = [self.x], Sums(self.sums.sse, bad=self.sums.bad)
            self.settled = self.sums.bad > 0
        else:
            self.propose()

    def propose(self) -> None:
        norms = np.sqrt(np.diag(self.sums.a))
        scale = np.where(norms > 0, norms, 1.0)
        a, g, self.trials, self.used = self.sums.a / np.outer(scale, scale), self.sums.g / scale, [], []
        while len(self.trials) < 3 and self.damping * 4.0 ** len(self.trials) < 1e14:
            damping = self.damping * 4.0 ** len(self.trials)
            try:
                step = np.linalg.solve(a + damping * np.eye(len(g)), -g) / scale
            except np.linalg.LinAlgError:
                self.damping *= 10
                continue
            self.trials.append(self.x + step)
            self.used.append(damping)
        self.settled = not self.trials


def inside(x: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``x``, moved off its bounds by the least that can be told apart, or to the middle of a narrow range."""
    gap = 1e-12 * np.maximum(1.0, np.abs(x))
    low, high = lower + np.where(np.isfinite(lower), gap, 0.0), upper - np.where(np.isfinite(upper), gap, 0.0)
    with np.errstate(invalid="ignore"):
        return np.where(low < high, np.minimum(np.maximum(x, low), high), np.where(np.isfinite(lower) & np.isfinite(upper), (lower + upper) / 2, x))


class Model:
    """The quadratic model around ``z`` (scaled variables), in steps measured by the distances to the bounds that the gradient points to."""

    def __init__(self, z: np.ndarray, g: np.ndarray, a: np.ndarray, lower: np.ndarray, upper: np.ndarray):
        self.z, self.lower, self.upper = z, lower, upper
        to_upper, to_lower = (g < 0) & np.isfinite(upper), (g > 0) & np.isfinite(lower)
        v = np.where(to_upper, upper - z, np.where(to_lower, z - lower, 1.0))
        self.d = np.sqrt(np.maximum(v, 1e-300))
        self.g = self.d * g
        self.b = a * np.outer(self.d, self.d) + np.diag(np.where(to_upper | to_lower, np.abs(g), 0.0))
        self.stay = max(0.995, 1 - float(np.max(np.abs(v * g), initial=0.0)))
        self.values, self.vectors = np.linalg.eigh((self.b + self.b.T) / 2)
        self.values = np.maximum(self.values, 0.0)

    def gain(self, p: np.ndarray) -> float:
        """By how much the sum of squares falls: twice what the model of half of it says."""
        return -float(2 * self.g @ p + p @ self.b @ p)

    def newton(self, radius: float) -> np.ndarray:
        """The minimum of the model within the radius."""
        c = self.vectors.T @ self.g
        floor = 1e-14 * max(float(self.values.max(initial=0.0)), 1e-300)
        with np.errstate(all="ignore"):
            free = np.where(self.values > floor, c / np.where(self.values > floor, self.values, 1.0), 0.0)
        if np.linalg.norm(free) <= radius:
            return -self.vectors @ free
        low, high = 0.0, float(np.linalg.norm(c)) / radius
        for _ in range(100):
            middle = (low + high) / 2
            if np.linalg.norm(c / (self.values + middle)) > radius:
                low = middle
            else:
                high = middle
            if high - low <= 1e-10 * high:
                break
        return -self.vectors @ (c / (self.values + high))

    def room(self, at: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray]:
        """The multiple of ``step`` that reaches a bound from ``at``, and which variables are there then."""
        with np.errstate(all="ignore"):
            times = np.where(step > 0, (self.upper - at) / step, np.where(step < 0, (self.lower - at) / step, np.inf))
        times = np.where(np.isnan(times), np.inf, np.maximum(times, 0.0))
        least = float(times.min(initial=np.inf))
        return least, times <= least

    def along(self, p: np.ndarray, r: np.ndarray, most: float) -> np.ndarray:
        """The best point p + t r of the model, t up to ``most``."""
        curve, slope = float(r @ self.b @ r), float(r @ (self.g + self.b @ p))
        t = most if curve <= 0 and slope < 0 else -slope / curve if curve > 0 else 0.0
        return p + min(max(t, 0.0), most) * r

    def step(self, radius: float) -> tuple[np.ndarray, float, float]:
        """(step of z, its size in the model's measure, the gain that the model promises)."""
        p = self.newton(radius)
        t, hit = self.room(self.z, self.d * p)
        if t <= 1:
            cut = p * t
            ways = [cut * self.stay]
            r = np.where(hit, -p, p)
            size, along, whole = float(r @ r), float(cut @ r), float(cut @ cut)
            if size > 0:
                reach = (-along + np.sqrt(max(along * along - size * (whole - radius * radius), 0.0))) / size
                wall, _ = self.room(self.z + self.d * cut, self.d * r)
                ways.append(self.along(cut, r, max(min(reach, self.stay * wall), 0.0)))
            down = -self.g
            if norm := float(np.linalg.norm(down)):
                wall, _ = self.room(self.z, self.d * down)
                ways.append(self.along(np.zeros_like(p), down, min(radius / norm, self.stay * wall)))
            p = max(ways, key=self.gain)
        return self.d * p, float(np.linalg.norm(p)), self.gain(p)


def minimum(sums: Callable[[np.ndarray], Sums], start: np.ndarray, lower: np.ndarray, upper: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """The point that a fit reaches and its sum of squares (infinite where no point was usable)."""
    state = State.begin(start, lower, upper)
    for _ in range(rounds):
        if state.settled:
            break
        state.learn([sums(p) for p in state.trials[:1]] + [Sums(sums(p).sse) for p in state.trials[1:]])
    return state.x, state.sums.sse if state.sums is not None else np.inf
