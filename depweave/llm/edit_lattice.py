"""The cheapest edits that make a conversation's roles alternate, by Dijkstra's search from both ends."""

from __future__ import annotations

from heapq import heappop, heappush

#: What a row's first fault may be.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Edits and their costs.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: What stands so far: nothing, a system turn, a user's turn, an answer. A conversation may end with nothing or an answer.
NOTHING, SYSTEM, USER, ANSWER = range(4)
ENDS = (NOTHING, ANSWER)
#: Who speaks next, as a state; nobody but a user follows nothing, the system or an answer.
NEXT = (USER, USER, ANSWER, USER)
ROLES = {USER: "user", ANSWER: "assistant"}

Row = tuple[str, int]
Node = tuple[int, int]


def kept_as(initial: str, state: int) -> int | None:
    """The state after a row that is kept, None where it can't stand."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    return NEXT[state] if initial == {USER: "u", ANSWER: "a"}[NEXT[state]] else None


def after(rows: list[Row], node: Node) -> list[tuple[Node, int, str]]:
    """The edges that leave a node of the lattice: (rows consumed, state)."""
    i, state = node
    out = [((i, NEXT[state]), INSERT_COST, INSERT)]
    if i < len(rows):
        initial, fault = rows[i]
        out.append(((i + 1, state), DELETE_COST, DELETE))
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            out.append(((i + 1, NEXT[state]), REROLE_COST + more, REROLE))
            if (to := kept_as(initial, state)) is not None:
                out.append(((i + 1, to), more, KEEP))
    return out


def before(rows: list[Row], node: Node) -> list[tuple[Node, int, str]]:
    """The edges that lead to a node."""
    i, state = node
    out = [((i, s), INSERT_COST, INSERT) for s in range(4) if NEXT[s] == state]
    if i:
        initial, fault = rows[i - 1]
        out.append(((i - 1, state), DELETE_COST, DELETE))
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            out += [((i - 1, s), REROLE_COST + more, REROLE) for s in range(4) if NEXT[s] == state]
            out += [((i - 1, s), more, KEEP) for s in range(4) if kept_as(initial, s) == state]
    return out


def cheapest(rows: list[Row], start: int = NOTHING, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits that lead from ``start`` to one of ``ends``; of several, the ASCII-least audit. None if there are none.

    One heap goes forward from the start, one back from the ends. Each node is settled with its
    least audit of least cost: edges that cost nothing consume a row, so by cost and place all that
    lead to a node at its cost are settled before it. Two audits of a node at one cost differ before
    either ends (the longer one has an insertion more, which costs), so the least prefix and the
    least suffix make the least whole. The search ends when the heaps' sum exceeds the best crossing:
    then every cheapest path has an edge from a node settled forward to one settled in reverse, and
    the least of all such crossings is taken.
    """
    n = len(rows)
    first = (0, start)
    label: list[dict[Node, tuple[int, str]]] = [{first: (0, "")}, {(n, e): (0, "") for e in ends}]
    heaps = [[(0, 0, first)], [(0, -n, (n, e)) for e in ends]]
    settled: list[set[Node]] = [set(), set()]
    best = 0 if first in label[1] else float("inf")
    side = 0
    while heaps[0] and heaps[1] and (not settled[0] or heaps[0][0][0] + heaps[1][0][0] <= best):
        _, _, node = heappop(heaps[side])
        if node not in settled[side]:
            settled[side].add(node)
            cost, audit = label[side][node]
            for to, more, letter in (before if side else after)(rows, node):
                new = (cost + more, letter + audit if side else audit + letter)
                if to not in settled[side] and (to not in label[side] or new < label[side][to]):
                    label[side][to] = new
                    heappush(heaps[side], (new[0], -to[0] if side else to[0], to))
                if to in label[1 - side]:
                    best = min(best, new[0] + label[1 - side][to][0])
        if heaps[0] and heaps[1]:
            side = int(heaps[1][0][0] < heaps[0][0][0])
    if best == float("inf"):
        return None
    audits = []
    for node in settled[0]:
        cost, audit = label[0][node]
        if node[0] == n and node[1] in ends and cost == best:
            audits.append(audit)
        for to, more, letter in after(rows, node):
            if to in settled[1] and cost + more + label[1][to][0] == best:
                audits.append(audit + letter + label[1][to][1])
    return int(best), min(audits)


def replay(audit: str, turns: list[tuple[str, str]], start: int = NOTHING) -> list[tuple[str, str]]:
    """The turns (role, text) after the edits of an audit."""
    out, state, rows = [], start, iter(turns)
    for edit in audit:
        if edit == INSERT:
            state = NEXT[state]
            out.append((ROLES[state], ""))
            continue
        role, text = next(rows)
        if edit == KEEP:
            state = kept_as(role[:1], state)
            out.append((role, text))
        elif edit == REROLE:
            state = NEXT[state]
            out.append((ROLES[state], text))
    return out
