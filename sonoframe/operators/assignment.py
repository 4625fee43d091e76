"""Best anonymous-label mapping for one recording's distinct activity patterns.

With at most as many hypothesis labels as references all of them are mapped, and the frame error is a constant minus the
overlap won: one assignment. Otherwise some stay unmapped. Of u unmapped labels in a frame with e hypothesis labels too
many min(u, e) save an error, and for any a from 0 to 1 that is at most a * u + (1 - a) * e. With such an a for each
distinct frame the unmapped labels have prices of their own, dummy columns take them, and one assignment is a lower
bound. The a are moved to where the bound is highest; where it still lies below the error of the mappings met, a label is
fixed as mapped or unmapped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Price of what is not allowed; frame counts stay far below. Errors are whole numbers, so bounds need not be exact.
NEVER, NEARLY = 1e15, 1e-3
#: Moves of the bound at the root and below it.
ROOT_MOVES, MOVES = 60, 10


def minimum_assignment(cost: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Minimum-cost assignment of every row to its own column (rows <= columns), by shortest augmenting paths.

    Returns the column of each row, and by how much any assignment with a cell costs more at least.
    """
    rows, columns = cost.shape
    u, v = np.zeros(rows + 1), np.zeros(columns + 1)
    owner = np.zeros(columns + 1, dtype=int)
    for row in range(1, rows + 1):
        owner[0], column = row, 0
        slack = np.full(columns + 1, np.inf)
        came_from = np.zeros(columns + 1, dtype=int)
        used = np.zeros(columns + 1, dtype=bool)
        while owner[column]:
            used[column] = True
            reduced = cost[owner[column] - 1] - u[owner[column]] - v[1:]
            closer = ~used[1:] & (reduced < slack[1:])
            slack[1:][closer] = reduced[closer]
            came_from[1:][closer] = column
            step_to = int(np.argmin(np.where(used, np.inf, slack)))
            delta = slack[step_to]
            u[owner[used]] += delta
            v[used] -= delta
            slack[~used] -= delta
            column = step_to
        while column:
            owner[column] = owner[came_from[column]]
            column = came_from[column]
    chosen = [0] * rows
    for column in range(1, columns + 1):
        if owner[column]:
            chosen[owner[column] - 1] = column - 1
    return chosen, cost - u[1:, None] - v[1:]


def frame_totals(ref: np.ndarray, mapped: np.ndarray, frames: np.ndarray) -> tuple[int, int, int]:
    """(missed, false alarm, confusion) frames once hypothesis labels are reference labels."""
    r, h = ref.sum(axis=1), mapped.sum(axis=1)
    shared = (ref * mapped).sum(axis=1)
    missed = int((np.maximum(0, r - h) * frames).sum())
    false_alarm = int((np.maximum(0, h - r) * frames).sum())
    confusion = int(((np.minimum(r, h) - shared) * frames).sum())
    return missed, false_alarm, confusion


def apply_mapping(hyp: np.ndarray, mapping: Sequence[int | None], n_ref: int) -> np.ndarray:
    mapped = np.zeros((hyp.shape[0], n_ref), dtype=np.int64)
    for label, target in enumerate(mapping):
        if target is not None:
            mapped[:, target] |= hyp[:, label]
    return mapped


class Mapping:
    """Targets 0..n_ref - 1 of the hypothesis labels; n_ref means none, and sorts last."""

    def __init__(self, ref: np.ndarray, hyp: np.ndarray, weight: np.ndarray) -> None:
        self.n_ref, self.n_hyp = ref.shape[1], hyp.shape[1]
        self.spare = max(0, self.n_hyp - self.n_ref)
        self.won = (hyp.T @ (ref * weight[:, None])).astype(np.int64)
        excess = hyp.sum(axis=1) - ref.sum(axis=1)
        # Only frames with too many hypothesis labels can save; equal sets and excesses are one.
        crowded = (excess > 0) & (self.spare > 0)
        rows = np.concatenate((hyp[crowded], excess[crowded, None]), axis=1)
        rows, at = np.unique(rows, axis=0, return_inverse=True)
        self.sets, self.excess = rows[:, :-1], rows[:, -1]
        self.frames = np.bincount(at.ravel(), weight[crowded], len(rows)).astype(np.int64)
        self.shares = np.ones(len(rows))

    def true_cost(self, targets: Sequence[int]) -> int:
        """Error frames of a mapping but for a constant."""
        unmapped = [k for k, t in enumerate(targets) if t == self.n_ref]
        saved = int((np.minimum(self.sets[:, unmapped].sum(axis=1), self.excess) * self.frames).sum())
        return -sum(int(self.won[k, t]) for k, t in enumerate(targets) if t < self.n_ref) - saved

    def bound(self, shares: np.ndarray, fixed: Sequence[int], mapped: Sequence[int], out: Sequence[int]):
        """A lower bound on the cost, the mapping that reaches it, and what a choice of target adds to it at least."""
        prices = self.sets.T @ (shares * self.frames)
        cost = -np.concatenate((self.won, np.repeat(prices[:, None], self.spare, axis=1)), axis=1)
        cost[list(mapped), self.n_ref :] = NEVER
        cost[list(out), : self.n_ref] = NEVER
        for label, target in enumerate(fixed):
            column = slice(target, target + 1) if target < self.n_ref else slice(self.n_ref, None)
            kept = cost[label, column].copy()
            cost[label] = NEVER
            cost[label, column] = kept
        chosen, reduced = minimum_assignment(cost)
        value = sum(cost[k, c] for k, c in enumerate(chosen)) - ((1 - shares) * self.excess * self.frames).sum()
        more = reduced[:, : self.n_ref]
        if self.spare:
            more = np.concatenate((more, reduced[:, self.n_ref :].min(axis=1)[:, None]), axis=1)
        return value, [min(c, self.n_ref) for c in chosen], more

    def least(self, fixed: Sequence[int] = (), limit: int | None = None) -> tuple[int, list[int]] | None:
        """Least cost with the targets of the first labels fixed, and targets that reach it.

        With a limit, any cost within it will do, and None says that there is none.
        """
        best: tuple[int, list[int]] | None = None
        waiting = [([], [k for k, t in enumerate(fixed) if t == self.n_ref], self.shares, ROOT_MOVES if limit is None else MOVES)]
        while waiting:
            mapped, out, shares, moves = waiting.pop()
            fewest, most = self.sets[:, out].sum(axis=1), self.sets.sum(axis=1) - self.sets[:, mapped].sum(axis=1)
            highest, closed, split = -np.inf, False, []
            for _ in range(moves):
                # Where it is decided whether there are more unmapped labels than can save, so is the share.
                shares = np.where(fewest >= self.excess, 0.0, np.where(most <= self.excess, 1.0, shares))
                value, targets, more = self.bound(shares, fixed, mapped, out)
                if value > NEVER / 2:
                    closed = True
                    break
                true = self.true_cost(targets)
                if best is None or true < best[0]:
                    best = true, targets
                if limit is not None and true <= limit:
                    return best
                goal = best[0] if limit is None else limit + 1
                unmapped = [k for k, t in enumerate(targets) if t == self.n_ref]
                many = self.sets[:, unmapped].sum(axis=1)
                if value > highest:
                    highest, split = value, [k for k in unmapped if k not in out]
                    twice = np.maximum(many - self.excess, 0) * self.frames
                    if limit is None and not mapped and not out:
                        self.shares, self.root, self.more = shares, value, more
                if highest > goal - 1 + NEARLY:
                    closed = True
                    break
                slope = (self.excess - many) * self.frames
                slope = np.where(((shares <= 0) & (slope < 0)) | ((shares >= 1) & (slope > 0)), 0, slope)
                size = float((slope * slope).sum())
                if not size:
                    break
                shares = np.clip(shares + (goal - value) / size * slope, 0, 1)
            if closed or not split:
                continue
            shared = self.sets.T @ twice
            label = max(split, key=lambda k: shared[k])
            waiting += [([*mapped, label], out, shares, MOVES), (mapped, [*out, label], shares, MOVES)]
        return best if limit is None else None

    def first(self) -> list[int]:
        """The first in lexicographic order of all mappings of least cost."""
        if not self.n_hyp:
            return []
        found = self.least()
        cost, targets = found
        # Targets that would raise the root's bound above the least cost are in no answer.
        may = self.root + self.more <= cost + NEARLY
        fixed: list[int] = []
        for label in range(self.n_hyp):
            for target in np.flatnonzero(may[label]).tolist():
                if target == targets[label]:
                    break
                if target < self.n_ref and target in fixed:
                    continue
                found = self.least((*fixed, target), cost)
                if found:
                    targets = found[1]
                    break
            fixed.append(targets[label])
        return fixed


def best_mapping(
    ref: np.ndarray, hyp: np.ndarray, weight: np.ndarray
) -> tuple[tuple[int | None, ...], tuple[int, int, int]]:
    """Mapping with the fewest error frames, and its (missed, false alarm, confusion) frames.

    ``ref``/``hyp`` are 0/1 matrices of patterns by labels, ``weight`` the frames of each pattern. Ties
    go to the first mapping in permutation order, where surplus hypothesis labels map to nothing and
    nothing sorts last.
    """
    n_ref = ref.shape[1]
    mapping = tuple(None if t == n_ref else t for t in Mapping(ref, hyp, weight).first())
    return mapping, frame_totals(ref, apply_mapping(hyp, mapping, n_ref), weight)
