"""How much of a source's amount can have reached a target: exact intervals on time-expanded transfer graphs.

A scenario is one source amount and the ordered transfers that follow. Money of an account mixes, so any share of what it holds
at the time may be the source's: the greatest amount that reaches a target is a maximum flow, capacities being the
transfers' amounts and what an account holds carried from event to event. The least is what is left of the source if as much as
possible goes elsewhere or stays. Each flow is certified by a cut of its capacity. Scenarios are independent: Spark groups them, and a task solves one at a time in exact integers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

#: Parts of a scenario that move money, and those of them that take it out of the graph.
MOVES, OUTWARD = ("transfer", "incoming", "gas", "outflow"), ("gas", "outflow")
SCHEMA = "scenario string, target string, lower string, upper string, status string"


class Network:
    """Arcs as parallel lists, each with its reverse beside it (i ^ 1); flows by blocking flows over layers."""

    def __init__(self) -> None:
        self.number: dict[object, int] = {}
        self.arcs_of: list[list[int]] = []
        self.head: list[int] = []
        self.room: list[int] = []

    def node(self, name: object) -> int:
        if name not in self.number:
            self.number[name] = len(self.arcs_of)
            self.arcs_of.append([])
        return self.number[name]

    def arc(self, a: object, b: object, capacity: int) -> None:
        for x, y, room in ((a, b, capacity), (b, a, 0)):
            self.arcs_of[self.node(x)].append(len(self.head))
            self.head.append(self.node(y))
            self.room.append(room)

    def layers(self, source: int) -> list[int]:
        """Distance of each node from the source along arcs with room, -1 where there is none."""
        depth = [-1] * len(self.arcs_of)
        depth[source], edge = 0, [source]
        while edge:
            edge = [self.head[i] for x in edge for i in self.arcs_of[x] if self.room[i] and depth[self.head[i]] < 0 and not depth.__setitem__(self.head[i], depth[x] + 1)]
        return depth

    def most(self, source: object, sink: object) -> tuple[int, int]:
        """The greatest flow from source to sink, and the capacity of the cut that the last layers leave: equal, it certifies the flow."""
        s, t, total = self.node(source), self.node(sink), 0
        capacity = list(self.room)
        while (depth := self.layers(s))[t] >= 0:
            untried, path, x = [list(arcs) for arcs in self.arcs_of], [], s
            while True:
                if x == t:
                    least = min(self.room[i] for i in path)
                    for i in path:
                        self.room[i] -= least
                        self.room[i ^ 1] += least
                    total, path, x = total + least, [], s
                elif untried[x]:
                    i = untried[x][-1]
                    if self.room[i] and depth[self.head[i]] == depth[x] + 1:
                        path.append(i)
                        x = self.head[i]
                    else:
                        untried[x].pop()
                elif path:
                    x = self.head[path.pop() ^ 1]
                    untried[x].pop()
                else:
                    break
        cut = sum(capacity[i] for x, d in enumerate(depth) if d >= 0 for i in self.arcs_of[x] if depth[self.head[i]] < 0)
        return total, cut


def interval(seed: tuple[str, int], transfers: list[tuple[str | None, str | None, int]], balances: dict[str, int], target: str | frozenset[str]) -> tuple[int, int] | None:
    """Least and greatest amount of the seed (account, amount) that enters target, or a set of targets together, by the transfers
    (from, to, amount), which are in order; None if some account spends more than it holds. Money from nobody isn't the
    seed's; money to nobody (gas, what leaves the graph) is gone. A target keeps what it gets. An account without a
    known balance holds an unknown amount before, which only widens the interval."""
    targets = frozenset([target]) if isinstance(target, str) else target
    held = dict(balances)
    account, amount = seed
    if account in held:
        held[account] += amount
    for a, b, n in transfers:
        if a in held:
            held[a] -= n
            if held[a] < 0:
                return None
        if b in held:
            held[b] += n

    def most(wanted: bool) -> int:
        """The most of the seed that ends in the target, or anywhere else."""
        net, step = Network(), {}
        net.arc("source", (account, 0), amount)
        holding = {account: balances.get(account, 0) + amount} if account in balances else {}
        for a, b, n in transfers:
            if a is None and b in balances:
                holding[b] = holding.get(b, balances[b]) + n
            if a is None or a in targets or a == b:
                continue
            # Each event of an account is a node of its own; what is not spent is carried to the next.
            here = (a, step.get(a, 0))
            later = (a, step.get(a, 0) + 1)
            step[a] = later[1]
            carried = amount
            if a in balances:
                holding[a] = holding.get(a, balances[a]) - n
                carried = min(amount, holding[a])
            net.arc(here, later, carried)
            net.arc(here, "rest" if b is None else "target" if b in targets else (b, step.get(b, 0)), n)
            if b in balances:
                holding[b] = holding.get(b, balances[b]) + n
        for a in {account, *(x for t in transfers for x in t[:2])} - targets - {None}:
            net.arc((a, step.get(a, 0)), "rest", amount)
        flow, cut = net.most("source", "target" if wanted else "rest")
        if flow != cut:
            raise ArithmeticError("a flow without the cut that certifies it")
        return flow

    if account in targets:
        return amount, amount
    return amount - most(False), most(True)


def intervals(scenarios: DataFrame) -> DataFrame:
    """scenario, target, lower, upper, status (OPTIMAL, OVERSPENT, TARGET_SPENDS, NO_SINGLE_SEED) of every scenario and target.

    Rows of `scenarios`: scenario, part (seed; transfer, incoming from outside, gas, outflow to outside; balance; target; group),
    ord, sender, recipient, amount (decimal text, of any length). A group (named by sender) is a set of recipients that are targets
    together. It is solved first: where it gets nothing, none of its members does. Amounts stay text outside, as
    they may exceed every number type."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable")
        cells = list(zip(rows["part"], rows["sender"], rows["recipient"], rows["amount"], strict=True))
        name, seeds = rows["scenario"].iloc[0], [(b, int(n)) for part, _, b, n in cells if part == "seed"]
        moves = [(None if part == "incoming" else a, None if part in OUTWARD else b, int(n)) for part, a, b, n in cells if part in MOVES]
        balances = {b: int(n) for part, _, b, n in cells if part == "balance"}
        groups: dict[str, set[str]] = {}
        for part, a, b, _ in cells:
            if part == "group":
                groups.setdefault(a, set()).add(b)
        spenders, out, nothing = {a for a, _, _ in moves}, [], set()

        def solved(target: str, members: frozenset[str]) -> None:
            status, found = "OPTIMAL", None
            if len(seeds) != 1:
                status = "NO_SINGLE_SEED"
            elif members & spenders:
                status = "TARGET_SPENDS"
            elif members <= nothing:
                found = 0, 0
            elif (found := interval(seeds[0], moves, balances, members)) is None:
                status = "OVERSPENT"
            elif found[1] == 0:
                nothing.update(members)
            out.append((name, target, *(map(str, found) if found else (None, None)), status))

        for group, members in groups.items():
            solved(group, frozenset(members))
        for part, _, b, _ in cells:
            if part == "target":
                solved(b, frozenset([b]))
        return pd.DataFrame(out, columns=["scenario", "target", "lower", "upper", "status"])

    return scenarios.groupBy("scenario").applyInPandas(solve, SCHEMA)
