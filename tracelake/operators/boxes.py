"""Rules as boxes: intervals per feature that both exports of a tree are read back to."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: lo < value <= hi for each constrained feature.
Intervals = Mapping[str, tuple[float, float]]
EVERYTHING = (-math.inf, math.inf)


@dataclass(frozen=True)
class Box:
    sides: tuple[tuple[str, float, float], ...]
    action: str

    @property
    def intervals(self) -> dict[str, tuple[float, float]]:
        return {f: (lo, hi) for f, lo, hi in self.sides}

    def contains(self) -> Column:
        tests = [F.col(f"`{f}`") > lo for f, lo, _ in self.sides if lo > -math.inf] + [F.col(f"`{f}`") <= hi for f, _, hi in self.sides if hi < math.inf]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def box(conditions: Sequence[tuple[str, str, float]], action: str) -> Box:
    """The intersection of conditions (feature, <= or >, threshold)."""
    sides: dict[str, tuple[float, float]] = {}
    for f, op, cut in conditions:
        lo, hi = sides.get(f, EVERYTHING)
        sides[f] = (lo, min(hi, cut)) if op == "<=" else (max(lo, cut), hi)
    return Box(tuple(sorted((f, *s) for f, s in sides.items())), action)


def intersection(a: Intervals, b: Intervals) -> dict[str, tuple[float, float]] | None:
    """Common part of two boxes, None if it is empty."""
    both = {f: (max(a.get(f, EVERYTHING)[0], b.get(f, EVERYTHING)[0]), min(a.get(f, EVERYTHING)[1], b.get(f, EVERYTHING)[1])) for f in {*a, *b}}
    return both if all(lo < hi for lo, hi in both.values()) else None


def difference(a: Intervals, b: Intervals) -> list[dict[str, tuple[float, float]]]:
    """``a`` without ``b`` as disjoint boxes, at most two for each feature of ``b``."""
    common = intersection(a, b)
    if common is None:
        return [dict(a)]
    out, rest = [], dict(a)
    for f in b:
        lo, hi = rest.get(f, EVERYTHING)
        inner_lo, inner_hi = common[f]
        if lo < inner_lo:
            out.append({**rest, f: (lo, inner_lo)})
        if inner_hi < hi:
            out.append({**rest, f: (inner_hi, hi)})
        rest[f] = (inner_lo, inner_hi)
    return out


def uncovered(boxes: Sequence[Box]) -> list[dict[str, tuple[float, float]]]:
    """What the boxes leave of the whole space."""
    rest: list[dict[str, tuple[float, float]]] = [{}]
    for b in boxes:
        rest = [piece for r in rest for piece in difference(r, b.intervals)]
    return rest


def overlaps(boxes: Sequence[Box]) -> int:
    """Pairs of boxes that share a point; a tree has at most 2^depth boxes."""
    return sum(intersection(a.intervals, b.intervals) is not None for i, a in enumerate(boxes) for b in boxes[:i])


CONDITION = re.compile(r"`?([^`()]+?)`?\s*(<=|>)\s*(-?[\d.]+(?:[eE][-+]?\d+)?)D?")


def boxes_of_sql(text: str) -> list[Box]:
    """Boxes of a ``CASE WHEN ... THEN 'action'`` export, one per branch."""
    return [box([(f.strip(), op, float(x)) for f, op, x in CONDITION.findall(m[1].replace(" AND ", "\n"))], m[2])
            for m in re.finditer(r"WHEN (.*?) THEN '([^']*)'", text)]


def boxes_of_text(text: str, actions: Sequence[str]) -> list[Box]:
    """Boxes of the indented If / Else / Predict export."""
    found, path = [], []
    for line in text.splitlines():
        depth, words = len(line) - len(line.lstrip()), line.strip()
        if words.startswith(("If ", "Else ")):
            path = [p for p in path if p[0] < depth] + [(depth, CONDITION.search(words[words.index("(") + 1:]).groups())]
        elif words.startswith("Predict:"):
            path = [p for p in path if p[0] < depth]
            found.append(box([(f.strip(), op, float(x)) for _, (f, op, x) in path], actions[int(float(words.split(":")[1]))]))
    return found


def boxes_table(boxes: Sequence[Box], spark: SparkSession) -> DataFrame:
    """(box, feature, lo, hi, action): one row per bounded side, open ends as infinities."""
    rows = [(i, f, lo, hi, b.action) for i, b in enumerate(boxes) for f, lo, hi in b.sides]
    return spark.createDataFrame(rows, "box int, feature string, lo double, hi double, action string")


def decided_by_boxes(states: DataFrame, boxes: Sequence[Box]) -> DataFrame:
    """Add ``n_boxes`` that hold the state and ``box_action``, the action of the first of them."""
    inside = [F.when(b.contains(), F.lit(b.action)) for b in boxes]
    return states.withColumns({"n_boxes": reduce(lambda a, b: a + b, [i.isNotNull().cast("int") for i in inside], F.lit(0)), "box_action": F.coalesce(*inside, F.lit(None).cast("string"))})
