"""Number repair: readings vote for an offset between place and number, changes of it cost."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.operators.fold import Fold, fold
from scorelake.operators.ordered import apart, backwards

# Votes count in 2000ths, so that a vote against (half as heavy) is whole too.
JUMP = 5000


class Forward(Fold):
    """Scores of the offsets up to each place, above a floor that all others share.

    A vote lifts one offset. The floor is the best score less the cost of a change: who would be below it comes from
    the best one instead, anew at this place. So each offset is held with its score and the place since which it has
    kept its own way, and those below the floor leave a heap as it rises: a place costs the time of a heap step,
    however many offsets were voted for. Gives per place the best offset so far and since when it keeps."""

    def fresh(self):
        return {"held": {}, "reset": 0}

    def __init__(self, state: str | None = None):
        super().__init__(state)
        self.held = {int(o): (v, since) for o, (v, since) in self.s["held"].items()}
        self.floor, self.reset = 0, self.s["reset"]
        self.heap = [(v, o) for o, (v, _) in self.held.items()]
        heapify(self.heap)
        self.best = min(self.held, key=lambda o: (-self.held[o][0], o), default=None)

    def row(self, i, vote, weight):
        if self.best is not None and self.held[self.best][0] - JUMP > self.floor:
            self.floor, self.reset = self.held[self.best][0] - JUMP, i
            while self.heap[0][0] < self.floor:
                v, o = heappop(self.heap)
                if self.held.get(o, (None, 0))[0] == v:
                    del self.held[o]
        if vote is not None and vote == vote:
            offset = int(vote) - i
            v, since = self.held.get(offset, (self.floor, self.reset))
            v += 3 * int(weight) // 2
            self.held[offset] = (v, since)
            heappush(self.heap, (v, offset))
            if self.best is None or (-v, offset) < (-self.held[self.best][0], self.best):
                self.best = offset
        return [(i, self.best, self.held[self.best][1] if self.best is not None else 0)]

    def state(self) -> str:
        held = {str(o): (v - self.floor, since) for o, (v, since) in self.held.items()}
        return json.dumps({"held": held, "reset": self.reset}, sort_keys=True)


class Backward(Fold):
    """From the last place on: the best offset there, as long as it keeps; then the best one of the place before."""

    def row(self, i, best, since):
        if self.s is None or i < self.s[1]:
            self.s = [1 if best is None or best != best else int(best), int(since)]
        return [(i, i + self.s[0])]


class Whole(Fold):
    """Both ways over a key that was not cut: three whole numbers a place are kept in between."""

    def __init__(self, state: str | None = None):
        super().__init__(state)
        self.ahead, self.kept = Forward(), array("q")

    def row(self, i, vote, weight):
        _, best, since = self.ahead.row(i, vote, weight)[0]
        self.kept.extend((i, 1 if best is None else best, since))
        return []

    def end(self) -> Iterator[tuple]:
        back = Backward()
        for k in range(len(self.kept) - 3, -1, -3):
            yield back.row(*self.kept[k : k + 3])[0]


def repaired_numbers(df: DataFrame, keys: list[str], place: str, number: str, conf: str) -> DataFrame:
    """``(place, number)`` with numbers in step with the places. Readings below confidence 0.5 do
    not vote; places count from 0. Keys that were not cut are read once, both ways. For the others both folds hand on
    little: offsets within the cost of a change of the best, and one offset on the way back."""
    sure = F.col(conf) >= 0.5
    votes = df.withColumns({
        "_vote": F.when(sure, F.col(number)),
        "_w": F.bround(F.col(conf) * 1000, 0).cast("long") * 2,
    })
    short, long = apart(votes, keys, place)
    numbers, seen = f"{place} bigint, number bigint", [place, "_vote", "_w"]
    done = fold(short, keys, [place], seen, Whole, numbers)
    if long is None:
        return done
    ahead = fold(long, keys, [place], seen, Forward, f"{place} bigint, best bigint, since bigint", keep=True)
    back = backwards(ahead.withColumn("_rev", -F.col(place)), keys, ["_rev"])
    return done.unionByName(fold(back, keys, ["_rev"], [place, "best", "since"], Backward, numbers))
