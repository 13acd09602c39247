"""Ordered rule lists learned by incremental reduced-error pruning and written out as SQL CASE expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x >= self.value if self.at_least else x <= self.value

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value!r}D"


@dataclass(frozen=True)
class Rule:
    label: str
    conditions: tuple[Condition, ...]

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(table.values())))
        out = np.ones(n, dtype=bool)
        for c in self.conditions:
            out &= c.holds(table)
        return out

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


@dataclass(frozen=True)
class RuleList:
    rules: tuple[Rule, ...]
    default: str

    def sql(self) -> str:
        """CASE over columns of the features' names; the first rule that holds decides."""
        if not self.rules:
            return f"'{self.default}'"
        return "CASE " + " ".join(f"WHEN {r.sql()} THEN '{r.label}'" for r in self.rules) + f" ELSE '{self.default}' END"

    def predict(self, table: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(table.values())))
        out = np.full(n, self.default, dtype=object)
        open_ = np.ones(n, dtype=bool)
        for r in self.rules:
            hit = open_ & r.holds(table)
            out[hit] = r.label
            open_ &= ~hit
        return out


def _cuts(x: np.ndarray, most: int) -> np.ndarray:
    """Midpoints between neighbouring values, at most ``most`` of them."""
    v = np.unique(x)
    if len(v) < 2:
        return np.empty(0)
    mid = (v[1:] + v[:-1]) / 2
    if len(mid) > most:
        # wide gaps between values are the natural places to cut; the rest is spread evenly
        gaps = np.argsort(-(v[1:] - v[:-1]), kind="stable")[: most // 2]
        even = np.linspace(0, len(mid) - 1, most - len(gaps)).astype(int)
        mid = mid[np.union1d(gaps, even)]
    return np.round(mid, 6)


def _grow(table: dict[str, np.ndarray], y: np.ndarray, label: str, most_cuts: int, most_conditions: int) -> list[Condition]:
    """Adds the condition of most information gain until only wanted rows are left or nothing gains."""
    live = np.ones(len(y), dtype=bool)
    found: list[Condition] = []
    while len(found) < most_conditions:
        p0, n0 = int((live & y).sum()), int((live & ~y).sum())
        if n0 == 0 or p0 == 0:
            break
        before = np.log2(p0 / (p0 + n0))
        best, best_gain = None, 1e-9
        for name in table:
            x, yl = table[name][live], y[live]
            cuts = _cuts(x, most_cuts)
            if not len(cuts):
                continue
            pos, neg = np.sort(x[yl]), np.sort(x[~yl])
            for at_least in (True, False):
                if at_least:
                    p = len(pos) - np.searchsorted(pos, cuts, "left")
                    n = len(neg) - np.searchsorted(neg, cuts, "left")
                else:
                    p, n = np.searchsorted(pos, cuts, "right"), np.searchsorted(neg, cuts, "right")
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - before), 0.0)
                i = int(np.argmax(gain))
                if gain[i] > best_gain:
                    best, best_gain = Condition(name, at_least, float(cuts[i])), float(gain[i])
        if best is None:
            break
        found.append(best)
        live &= best.holds(table)
    return found


def _pruned(rule: list[Condition], table: dict[str, np.ndarray], y: np.ndarray) -> tuple[list[Condition], float]:
    """The prefix of the rule with the best (p - n) / (p + n) on the pruning rows, shorter ones first among equals."""
    best, best_worth = rule, -2.0
    for k in range(1, len(rule) + 1):
        hit = Rule("", tuple(rule[:k])).holds(table)
        p, n = int((hit & y).sum()), int((hit & ~y).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best_worth + 1e-12:
            best, best_worth = rule[:k], worth
    return best, best_worth


def induce(
    table: dict[str, np.ndarray], labels: np.ndarray, default: str, seed: int = 11, most_cuts: int = 64, most_rules: int = 12, most_conditions: int = 6, least_rows: int = 4
) -> RuleList:
    """Rules for each label but the default, rarest first; each is grown on two thirds of the rows and pruned on the rest.

    A label's rules end when a pruned rule is wrong more often than right or no row of the label is left. Rows that a
    rule covers leave before the next rule is learned. The learner is bounded: ``most_cuts`` thresholds are tried per feature and
    step, a rule has ``most_conditions`` conditions before pruning, a label ``most_rules`` rules, and a label of which fewer than ``least_rows``
    rows are left, too few to grow and prune on, gets no further rule; each may be raised. Without rows, or with one label, the list is empty.
    """
    rng = np.random.default_rng(seed)
    left = np.ones(len(labels), dtype=bool)
    rules: list[Rule] = []
    kinds, counts = np.unique(labels, return_counts=True) if len(labels) else (np.empty(0), np.empty(0))
    for kind in [k for _, k in sorted(zip(counts, kinds)) if k != default]:
        for _ in range(most_rules):
            idx = np.flatnonzero(left)
            y = labels[idx] == kind
            if y.sum() < least_rows:
                break
            in_grow = np.zeros(len(idx), dtype=bool)
            for part in (np.flatnonzero(y), np.flatnonzero(~y)):
                in_grow[rng.permutation(part)[: (2 * len(part) + 2) // 3]] = True
            grow = {k: v[idx[in_grow]] for k, v in table.items()}
            prune = {k: v[idx[~in_grow]] for k, v in table.items()}
            rule = _grow(grow, y[in_grow], kind, most_cuts, most_conditions)
            if not rule:
                break
            rule, worth = _pruned(rule, prune, y[~in_grow])
            if worth <= 0:
                break
            rules.append(Rule(str(kind), tuple(rule)))
            hit = rules[-1].holds(table)
            left &= ~hit
    return RuleList(tuple(rules), default)
