"""Order-dependent work on one track, run or frame at a time: tracking, matching, fusion, queues.

Every function here folds over the rows of one group in order, most of them lazily, so that the grouped form can stream
sorted partitions through Python in Arrow batches and hold no more than the fold's own state: a run or a camera with a
third of all rows needs no more memory than any other. The same folds serve the streaming jobs.
"""

from __future__ import annotations

import math
import heapq
import itertools
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

UNKNOWN = "unknown"


def overlap(a, b) -> float:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 for an empty union."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def suppress(boxes: list, scores: list[float], classes: list, threshold: float) -> list[int]:
    """Positions kept, best first: a box goes if a better one of its class overlaps it by more than the threshold."""
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda i: (-scores[i], i)):
        if all(classes[i] != classes[k] or overlap(boxes[i], boxes[k]) <= threshold for k in kept):
            kept.append(i)
    return kept


def match_greedy(left: list, right: list, least: float, same: Callable[[int, int], bool] = lambda i, j: True) -> list[tuple[int, int, float]]:
    """Pairs (left, right, overlap), each side at most once, the greatest overlaps first; ties by position."""
    found = sorted(((-overlap(a, b), i, j) for i, a in enumerate(left) for j, b in enumerate(right) if same(i, j)), key=lambda x: x)
    used_l, used_r, out = set(), set(), []
    for score, i, j in found:
        if -score >= least and i not in used_l and j not in used_r:
            used_l.add(i)
            used_r.add(j)
            out.append((i, j, -score))
    return out


def match_optimal(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """The assignment of rows to columns with the least total cost, without pairs above `most`.

    Shortest augmenting paths with potentials. Pairs that are not allowed cost as much as leaving both sides alone.
    """
    n, m = cost.shape
    size = n + m
    full = np.full((size, size), most)
    full[:n, :m] = np.where(cost <= most, cost, most * 4 + 1)
    full[n:, m:] = 0.0
    row_of, u, v = np.full(size + 1, -1), np.zeros(size), np.zeros(size + 1)
    for i in range(size):
        row_of[size] = i
        j0, least, came, done = size, np.full(size, np.inf), np.full(size, size), np.zeros(size + 1, bool)
        while True:
            done[j0] = True
            i0 = row_of[j0]
            reduced = full[i0] - u[i0] - v[:size]
            better = ~done[:size] & (reduced < least)
            least[better], came[better] = reduced[better], j0
            open_ = np.where(done[:size], np.inf, least)
            j1 = int(open_.argmin())
            step = open_[j1]
            busy = np.flatnonzero(done)
            u[row_of[busy]] += step
            v[busy] -= step
            least[~done[:size]] -= step
            j0 = j1
            if row_of[j0] < 0:
                break
        while j0 != size:
            row_of[j0] = row_of[came[j0]]
            j0 = came[j0]
    return sorted((int(row_of[j]), j) for j in range(m) if 0 <= row_of[j] < n and cost[row_of[j], j] <= most)


def predict(before: tuple, last: tuple, gap: float, elapsed: float) -> tuple:
    """A box moved on by its last motion: `gap` between the two observations, `elapsed` since the last."""
    k = elapsed / gap if gap > 0 else 0.0
    return tuple(b + (b - a) * k for a, b in zip(before, last, strict=True))


@dataclass
class Track:
    id: int
    box: tuple
    first: int
    last: int
    hits: int = 1
    confirmed: bool = False


@dataclass
class Tracker:
    """Boxes to tracks by greatest overlap. Frames must have rising sequences and the current generation; a frame that is
    late or of another generation, or that holds an invalid box, is rejected whole. A track is confirmed at its
    `least_hits`-th hit and exits when a frame comes `timeout` ms or more after its last one."""

    least_overlap: float = 0.30
    least_hits: int = 3
    timeout: int = 1500
    generation: int = 1
    last_sequence: int | None = None
    next_id: int = 1
    active: list[Track] = field(default_factory=list)
    rejected: int = 0

    def frame(self, sequence: int, at: int, boxes: list[tuple], generation: int = 1) -> tuple[list[int] | None, list[Track]]:
        """(the track of each box, tracks that exit); None instead of tracks for a rejected frame."""
        valid = all(0 <= b[0] < b[2] <= 1 and 0 <= b[1] < b[3] <= 1 for b in boxes)
        if not valid or generation != self.generation or (self.last_sequence is not None and sequence <= self.last_sequence):
            self.rejected += 1
            return None, []
        self.last_sequence = sequence
        of_box = [0] * len(boxes)
        for i, j, _ in match_greedy([t.box for t in self.active], boxes, self.least_overlap):
            t = self.active[i]
            t.box, t.last, t.hits = boxes[j], at, t.hits + 1
            t.confirmed |= t.hits >= self.least_hits
            of_box[j] = t.id
        for j, b in enumerate(boxes):
            if not of_box[j]:
                self.active.append(Track(self.next_id, b, at, at, confirmed=self.least_hits <= 1))
                of_box[j], self.next_id = self.next_id, self.next_id + 1
        gone = [t for t in self.active if at - t.last >= self.timeout]
        self.active = [t for t in self.active if at - t.last < self.timeout]
        return of_box, gone

    def stop(self, at: int) -> list[Track]:
        """All tracks exit; none was last seen before the stop."""
        for t in self.active:
            t.last = max(t.last, at)
        gone, self.active = self.active, []
        return gone


def follow_in_order(frames: Iterable[tuple[int, list[tuple]]], least: float = 0.15, most_gap: int = 4) -> Iterator[list[int]]:
    """Tracks by detection order: each box takes the free track it overlaps most, of those seen at most `most_gap` samples
    ago. Gives the tracks of each frame's boxes; older tracks are forgotten."""
    tracks: dict[int, tuple[tuple, int]] = {}
    count = 0
    for at, boxes in frames:
        tracks = {i: t for i, t in tracks.items() if at - t[1] <= most_gap}
        free = set(tracks)
        ids = []
        for b in boxes:
            score, best = max(((overlap(tracks[i][0], b), -i) for i in free), default=(0.0, 0))
            if free and score >= least:
                i = -best
                free.discard(i)
            else:
                count += 1
                i = count
            tracks[i] = (b, at)
            ids.append(i)
        yield ids


# ---- fusion of labels along a track


def scores_of(window: Iterable[tuple[str, float, float]]) -> dict[str, float]:
    """Weight by known label: confidence times quality, each within 0 and 1."""
    out: dict[str, float] = {}
    for label, confidence, quality in window:
        if label != UNKNOWN:
            out[label] = out.get(label, 0.0) + min(1.0, max(0.0, confidence)) * min(1.0, max(0.0, quality))
    return out


def leading(scores: dict[str, float]) -> tuple[str, float, float]:
    """(label, share, margin) of the heaviest label, the smallest of equals; ('unknown', 0, 0) without weight."""
    total = sum(scores.values())
    if total <= 0:
        return UNKNOWN, 0.0, 0.0
    ranked = sorted(scores.items(), key=lambda s: (-s[1], s[0]))
    second = ranked[1][1] if len(ranked) > 1 else 0.0
    return ranked[0][0], ranked[0][1] / total, (ranked[0][1] - second) / total


def fuse_window(observations: Iterable[tuple[str, float, float]], window: int, share: float, margin: float) -> Iterator[str]:
    """Per observation the label that leads its trailing window by share and margin, else 'unknown'."""
    history: deque = deque(maxlen=window)
    for o in observations:
        history.append(o)
        label, s, m = leading(scores_of(history))
        yield label if label != UNKNOWN and s >= share and m >= margin else UNKNOWN


@dataclass
class Challenge:
    """Evidence against a held label: who challenges, for how long, and for how long anything has conflicted."""

    label: str | None = None
    count: int = 0
    conflicts: int = 0

    def clear(self) -> None:
        self.label, self.count, self.conflicts = None, 0, 0

    def by(self, label: str) -> int:
        self.count = self.count + 1 if label == self.label else 1
        self.label = label
        return self.count


def fuse_guarded(observations: Iterable, window: int, share: float, margin: float, confirmations: int = 3, unknown_after: int = 2, override: float = 1.15) -> Iterator[str]:
    """As fuse_window, but a label once held is given up only to one that outweighs it by `override` in that many windows
    running; from the `unknown_after`-th conflicting window on, until then, the outcome is 'unknown'."""
    held: str | None = None
    challenge = Challenge()
    history: deque = deque(maxlen=window)
    for o in observations:
        history.append(o)
        scores = scores_of(history)
        label, s, m = leading(scores)
        if s < share or m < margin:
            label = UNKNOWN
        if held is None or label == held:
            held = held or (label if label != UNKNOWN else None)
            challenge.clear()
            yield held or UNKNOWN
            continue
        if label == UNKNOWN:
            challenge.label, challenge.count = None, 0
            challenge.conflicts += 1
        elif 0.0 < scores.get(held, 0.0) and scores[label] < scores[held] * override:
            challenge.clear()
        else:
            challenge.conflicts += 1
            if challenge.by(label) >= confirmations:
                held = label
                challenge.clear()
        yield held if challenge.conflicts < unknown_after else UNKNOWN


def fuse_held(observations: Iterable, window: int, least: int, entry: tuple[float, float], switch: tuple[float, float], patience: int, hold: int | None = None) -> Iterator[str]:
    """A label enters by share and margin `entry` and gives way to one that leads by `switch` in `patience` windows running;
    other conflicts give 'unknown'. With `hold`, an unknown observation repeats the held label up to that many times, and
    never counts as evidence; without it, it is judged like any other."""
    history: deque = deque(maxlen=window)
    held: str | None = None
    challenge = Challenge()
    silent = 0
    for o in observations:
        history.append(o)
        if hold is not None:
            silent = silent + 1 if o[0] == UNKNOWN else 0
            if silent:
                yield held if held and silent <= hold else UNKNOWN
                continue
        weighed = [x for x in history if x[0] != UNKNOWN and x[1] > 0 and x[2] > 0]
        label, s, m = leading(scores_of(weighed))
        enters = s >= entry[0] and m >= entry[1]
        if label == UNKNOWN:
            yield UNKNOWN
        elif held is None:
            if len(weighed) >= least and enters:
                held = label
                challenge.clear()
            yield held or UNKNOWN
        elif label == held:
            challenge.clear()
            yield held if enters else UNKNOWN
        elif len(weighed) >= least and s >= switch[0] and m >= switch[1]:
            if challenge.by(label) >= patience:
                held = label
                challenge.clear()
            yield held
        else:
            challenge.clear()
            yield UNKNOWN


def fuse_by_length(observations, short: int, short_limits: dict[str, float], long_limits: dict[str, float], least_quality: float, short_hold: int, **how) -> Iterator[str]:
    """Different thresholds for short and long tracks; short ones never have lower ones. Labels below their threshold
    become 'unknown' before fuse_held."""
    brief = len(observations) <= short
    limits = {k: max(v, long_limits.get(k, 1.01)) for k, v in short_limits.items()} if brief else long_limits
    passed = ((lab if lab != UNKNOWN and c >= limits.get(lab, 1.01) and (not brief or q >= least_quality) else UNKNOWN, c, q) for lab, c, q in observations)
    return fuse_held(passed, hold=short_hold if brief else 0, **how)


@dataclass
class Head:
    """One attribute of a track: the label held, its confidence, and the evidence against it."""

    threshold: float
    label: str = UNKNOWN
    confidence: float = 0.0
    switches: int = 0
    challenge: Challenge = field(default_factory=Challenge)


@dataclass
class Aggregator:
    """Hysteresis over the best observations of a track.

    The `keep` best by quality (newest first among equals) vote: a label's weight is the sum of quality times confidence,
    its confidence that weight over the quality of all kept rows, unknown ones included. A label is adopted with `least`
    samples and the threshold; it is given up to another after `confirmations` strong observations running whose weight
    is `override` times its own. From `unknown_after` strong conflicts on the outcome is 'unknown'. An observation that
    is unknown, below the threshold, or of less than `weak` times the best quality kept for the label, conflicts with
    nothing and clears what has gathered. Sequences must rise.
    """

    thresholds: dict[str, float]
    least: int = 3
    keep: int = 5
    confirmations: int = 3
    unknown_after: int = 2
    override: float = 1.15
    weak: float = 0.75
    kept: list[dict] = field(default_factory=list)
    last_sequence: int = 0
    stale: int = 0
    heads: dict[str, Head] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.heads = {h: Head(t) for h, t in self.thresholds.items()}

    def _weights(self, head: str) -> dict[str, tuple[float, int]]:
        out: dict[str, tuple[float, int]] = {}
        for o in self.kept:
            label, confidence = o[head]
            if label != UNKNOWN:
                w, n = out.get(label, (0.0, 0))
                out[label] = w + o["quality"] * confidence, n + 1
        return out

    def candidate(self, head: str) -> tuple[str, float, int]:
        weights = self._weights(head)
        base = sum(o["quality"] for o in self.kept)
        if not weights or base <= 0:
            return UNKNOWN, 0.0, 0
        label = min(weights, key=lambda k: (-weights[k][0], k))
        return label, weights[label][0] / base, weights[label][1]

    def add(self, sequence: int, quality: float, **heads: tuple[str, float]) -> bool:
        """Takes an observation: quality and (label, confidence) per head. False if its sequence does not rise."""
        if sequence <= self.last_sequence:
            self.stale += 1
            return False
        self.last_sequence = sequence
        self.kept.append({"sequence": sequence, "quality": quality, **heads})
        self.kept = sorted(self.kept, key=lambda o: (-o["quality"], -o["sequence"]))[: self.keep]
        for name, head in self.heads.items():
            self._update(name, head, quality, *heads[name])
        return True

    def _update(self, name: str, head: Head, quality: float, label: str, confidence: float) -> None:
        best, share, n = self.candidate(name)
        if head.label == UNKNOWN:
            if best != UNKNOWN and n >= self.least and share >= head.threshold:
                head.label, head.confidence = best, share
            head.challenge.clear()
            return
        if label == head.label:
            if best == label:
                head.confidence = share
            head.challenge.clear()
            return
        trusted = max((o["quality"] for o in self.kept if o[name][0] == head.label), default=0.0)
        if label == UNKNOWN or confidence < head.threshold or quality <= 0 or (trusted > 0 and quality < trusted * self.weak):
            head.challenge.clear()
            return
        head.challenge.conflicts += 1
        running = head.challenge.by(label)
        weights = self._weights(name)
        own, new = weights.get(head.label, (0.0, 0))[0], weights.get(label, (0.0, 0))[0]
        if running >= self.confirmations and (own <= 0 or new >= own * self.override):
            head.label, head.confidence, head.switches = label, confidence, head.switches + 1
            head.challenge.clear()

    def outcome(self, name: str) -> tuple[str, float, bool]:
        """(label, confidence, stable)."""
        head = self.heads[name]
        if head.challenge.conflicts >= self.unknown_after:
            return UNKNOWN, 0.0, False
        if head.label != UNKNOWN:
            return head.label, head.confidence, True
        return UNKNOWN, self.candidate(name)[1], False


@dataclass
class AdmissionQueue:
    """The best candidate per key, at most `capacity` keys: a newer and better one replaces, and a better one evicts the worst."""

    capacity: int
    held: dict = field(default_factory=dict)
    replaced: int = 0
    stale: int = 0
    evicted: int = 0
    rejected: int = 0

    def offer(self, key, sequence: int, quality: float) -> None:
        old = self.held.get(key)
        if old is not None:
            if sequence <= old[0] or quality <= old[1]:
                self.stale += 1
            else:
                self.held[key] = (sequence, quality)
                self.replaced += 1
            return
        if len(self.held) >= self.capacity:
            worst = min(self.held, key=lambda k: (self.held[k][1], -self.held[k][0]))
            if quality <= self.held[worst][1]:
                self.rejected += 1
                return
            del self.held[worst]
            self.evicted += 1
        self.held[key] = (sequence, quality)

    def take(self, n: int = 16) -> list:
        """The n best keys, removed: by quality, then the earlier sequence."""
        best = heapq.nsmallest(n, self.held, key=lambda k: (-self.held[k][1], self.held[k][0]))
        for k in best:
            del self.held[k]
        return best


def fps_windows(times: Iterable[int], least: int = 1000) -> Iterator[tuple[int, int, float]]:
    """(start, end, frames per second) of windows that close at the first frame `least` ms or more after their start, where
    the next one starts. The very first frame counts in the first window; later windows begin after their first frame."""
    start, frames = None, 0
    for t in times:
        frames += 1
        start = t if start is None else start
        if t - start >= least:
            yield start, t, frames * 1000.0 / (t - start)
            start, frames = t, 0


def at_cadence(times: Iterable[int], interval: int, ages: Iterable[int] | None = None, most_age: int | None = None) -> Iterator[int]:
    """Positions taken at fixed due times: the first frame at or after each; due times that passed meanwhile are skipped.

    A frame older than most_age uses up its due time, but is dropped.
    """
    due = None
    for i, (t, age) in enumerate(zip(times, itertools.repeat(0) if ages is None else ages)):  # noqa: B905
        if due is None or t >= due:
            if most_age is None or age <= most_age:
                yield i
            due = t + interval if due is None else due + interval * ((t - due) // interval + 1)


def micro_batches(times: Iterable[int], most: int, wait: int) -> Iterator[int]:
    """The number of the batch of each item: a batch closes when it holds `most` items, or `wait` after its oldest."""
    batch, held, first = -1, most, 0
    for t in times:
        if held >= most or t > first + wait:
            batch, held, first = batch + 1, 0, t
        held += 1
        yield batch


# How much each measure counts in the cost of a link, and the greatest value of each that is allowed.
LINK_WEIGHTS = {"motion": 0.43, "overlap": 0.17, "appearance": 0.32, "size": 0.08, "gap": 0.08}
LINK_GATES = {"motion": (1.65, 1.25), "appearance": 0.48, "size": 0.90}


def link_cost(track: tuple, box: tuple, gap: int, most_gap: int, appearance: float, seen: int) -> float | None:
    """What it costs to continue a track, of which `track` is the box expected, with a box; None if it may not be.

    Motion is the distance of the centres over the larger diagonal, size the greatest ratio of sides as a logarithm,
    appearance a distance given. A track seen only once may move further.
    """
    if not 0 < gap <= most_gap:
        return None
    side = lambda b: (max(b[2] - b[0], 1e-9), max(b[3] - b[1], 1e-9))
    (w, h), (v, k) = side(track), side(box)
    apart = math.hypot(box[0] + box[2] - track[0] - track[2], box[1] + box[3] - track[1] - track[3]) / 2
    motion, size = apart / max(math.hypot(w, h), math.hypot(v, k)), max(abs(math.log(v / w)), abs(math.log(k / h)))
    reach = LINK_GATES["motion"][0 if seen < 2 else 1]
    if motion > reach or size > LINK_GATES["size"] or appearance > LINK_GATES["appearance"]:
        return None
    parts = {"motion": motion / reach, "overlap": 1 - overlap(track, box), "appearance": appearance / LINK_GATES["appearance"], "size": size / LINK_GATES["size"], "gap": gap / most_gap}
    return sum(LINK_WEIGHTS[k] * min(v, 1.0) for k, v in parts.items())


def within_budget(sizes: Iterable[int], budget: int, most: int) -> Iterator[int]:
    """Positions taken in order while they fit; what does not fit is skipped, not the end."""
    taken, used = 0, 0
    for i, s in enumerate(sizes):
        if taken == most:
            return
        if used + s <= budget:
            yield i
            taken, used = taken + 1, used + s


def separate_windows(starts: list[int], length: int, most: int) -> list[int]:
    """Of windows of `length` consecutive frames, up to `most` evenly spaced (rounded half to even), without those that
    overlap one taken before."""
    if len(starts) > most:
        at = [round(i * (len(starts) - 1) / (most - 1)) for i in range(most)] if most > 1 else [0]
        starts = [starts[i] for i in dict.fromkeys(at)]
    out: list[int] = []
    for s in starts:
        if not out or s >= out[-1] + length:
            out.append(s)
    return out


def leases(commands: Iterable[tuple[int, str, str, int]]) -> Iterator[int]:
    """Outcome of each (time, action, holder, ttl): 1 newly held or released, 2 renewed, 0 refused."""
    holder, until = None, -1
    for at, action, who, ttl in commands:
        live = holder is not None and at < until
        if action == "release":
            mine = live and holder == who
            holder = None if mine else holder
            yield int(mine)
        elif live and holder != who or action == "refresh" and not live:
            yield 0
        else:
            holder, until = who, at + ttl
            yield 2 if live else 1


def three_means(values: np.ndarray, weights: np.ndarray | None = None, rounds: int = 100) -> list[float]:
    """Centres of three clusters of rising numbers with whole weights, from the least, the median and the greatest.

    Raises ValueError if there are fewer than three numbers (equal ones count), or if a cluster is left empty.
    """
    if (len(values) if weights is None else np.sum(weights)) < 3:
        raise ValueError("fewer than three values")
    weights = np.ones(len(values)) if weights is None else np.asarray(weights, float)
    upto = np.cumsum(weights)
    middle = [values[np.searchsorted(upto, q, side="right").clip(0, len(values) - 1)] for q in ((upto[-1] - 1) / 2 - 1e-9, upto[-1] / 2)]
    centres = np.array([values[0], sum(middle) / 2, values[-1]], float)
    for _ in range(rounds):
        nearest = np.abs(values[:, None] - centres[None, :]).argmin(1)
        if len(np.unique(nearest)) < 3:
            raise ValueError("a cluster is empty")
        new = np.array([np.average(values[nearest == k], weights=weights[nearest == k]) for k in range(3)])
        if np.allclose(new, centres, rtol=0, atol=1e-9):
            break
        centres = new
    return sorted(map(float, centres))


def detection_outcomes(predictions: list[tuple[tuple, float]], truths: list[tuple], least: float) -> list[str]:
    """'tp' or 'fp' for each prediction (box, confidence), best first, then one 'fn' for each truth left over."""
    free, out = set(range(len(truths))), ["fp"] * len(predictions)
    for i in sorted(range(len(predictions)), key=lambda i: (-predictions[i][1], i)):
        best = max(((overlap(predictions[i][0], truths[j]), -j) for j in free), default=(0.0, 0))
        if free and best[0] >= least:
            free.discard(-best[1])
            out[i] = "tp"
    return out + ["fn"] * len(free)


# ---- grouped forms


def per_group(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Applies a fold to each group as a whole, in order; for groups that are small by nature."""
    return rows.groupBy(*keys).applyInPandas(lambda pdf: fold(pdf.sort_values(order, kind="stable")), schema)


def streamed(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Folds each group lazily: the fold takes an iterator over the group's rows, in order, and gives rows of the schema.

    Rows come as tuples of the columns. Nothing but what the fold holds is kept, so a group may be of any size.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    at = [rows.columns.index(k) for k in keys]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (r for pdf in frames for r in zip(*[pdf[c] for c in pdf.columns], strict=True))
        out: list[tuple] = []
        for _, group in itertools.groupby(each, key=lambda r: tuple(r[i] for i in at)):
            for row in fold(group):
                out.append(row)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def fused(rows: DataFrame, track: str, position: str, fuse: Callable[[Iterable[tuple[str, float, float]]], Iterable[str]], kind: str = "long") -> DataFrame:
    """track, position, label: rows (track, position, label, confidence, quality) fused track by track."""

    def fold(group: Iterator[tuple]) -> Iterator[tuple]:
        places, seen = itertools.tee(group)
        for r, label in zip(places, fuse(o[2:5] for o in seen), strict=True):
            yield r[0], r[1], label

    return streamed(rows.select(track, position, "label", "confidence", "quality"), [track], [position], fold, f"{track} {kind}, {position} long, label string")
