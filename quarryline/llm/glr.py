"""Table-driven generalized LR recogniser.

A grammar text is compiled into an LR(0) automaton whose reductions carry SLR
look-aheads.  Where a cell of the table holds one action the parser is an
ordinary LR automaton; where it holds several, all of them are followed over a
graph-structured stack, so any context-free grammar can be used as written and
the cost stays polynomial.  No tree is built: the answer is the first token at
which no reading of the file survives.

Grammar notation::

    rule : 'literal' TOKEN other_rule ( a | b ) x? y* z+ ;

Upper-case names are token classes, lower-case names rules, the first rule is
the start.  Optional and repeated items are expanded so that no rule derives
the empty string (apart from the start), which keeps the recogniser exact.
"""

from __future__ import annotations

import re
from itertools import product

_ITEM = re.compile(r"'[^']+'|[A-Za-z_][A-Za-z_0-9]*|[:|;()?*+]")


class Grammar:
    """Productions, parse table and token inventory of one grammar text."""

    def __init__(self, text: str):
        text = re.sub(r"(?m)^\s*#.*$", "", text)
        self._toks = _ITEM.findall(text)
        self._at = 0
        self.rules: dict[str, set[tuple[str, ...]]] = {}
        self._made: dict = {}
        first = None
        while self._at < len(self._toks):
            name = f"<{self._take()}>"
            first = first or name
            assert self._take() == ":", name
            alts = self._alts()
            assert self._take() == ";", (name, self._toks[self._at - 3 : self._at + 1])
            self.rules.setdefault(name, set()).update(alts)
        self.start = first
        self.nullable_start = () in self.rules[first]
        self._drop_empty()
        self._build()

    # -- notation -> plain productions
    def _take(self) -> str:
        self._at += 1
        return self._toks[self._at - 1]

    def _peek(self) -> str:
        return self._toks[self._at]

    def _new(self, key, alts) -> str:
        if key not in self._made:
            self._made[key] = f"@{len(self._made)}"
            self.rules[self._made[key]] = set(alts(self._made[key]))
        return self._made[key]

    def _alts(self) -> list[tuple[str, ...]]:
        out = []
        while True:
            out.extend(self._seq())
            if self._peek() != "|":
                return out
            self._take()

    def _seq(self) -> list[tuple[str, ...]]:
        parts: list[list[tuple[str, ...]]] = []
        while self._peek() not in "|;)":
            t = self._take()
            if t == "(":
                alts = self._alts()
                assert self._take() == ")"
            else:
                alts = [(t[1:-1] if t[0] == "'" else t if t.isupper() else f"<{t}>",)]
            while self._peek() in "?*+":
                op = self._take()
                if op == "?":
                    alts = [*alts, ()]
                else:
                    body = tuple(sorted(alts))
                    name = self._new(("+", body), lambda me, b=body: [*b, *((me, *x) for x in b)])
                    alts = [(name,)] + ([()] if op == "*" else [])
            if len(alts) > 2 or (len(alts) == 2 and () not in alts):
                body = tuple(sorted(a for a in alts if a))
                empty = () in alts
                name = self._new(("|", body), lambda me, b=body: b)
                alts = [(name,)] + ([()] if empty else [])
            parts.append(alts)
        return [tuple(x for p in combo for x in p) for combo in product(*parts)]

    def _drop_empty(self) -> None:
        """Rewrite rules that can be empty into rules that cannot."""
        nullable: set[str] = set()
        while True:
            more = {n for n, alts in self.rules.items() if n not in nullable and any(all(x in nullable for x in a) for a in alts)}
            if not more:
                break
            nullable |= more
        for n, alts in list(self.rules.items()):
            out = set()
            for a in alts:
                for combo in product(*[((x,), ()) if x in nullable else ((x,),) for x in a]):
                    body = tuple(y for c in combo for y in c)
                    if body and body != (n,):
                        out.add(body)
            self.rules[n] = out

    # -- LR(0) automaton with SLR look-aheads
    def _build(self) -> None:
        prods: list[tuple[str, tuple[str, ...]]] = [("@start", (self.start,))]
        by: dict[str, list[int]] = {}
        for n, alts in self.rules.items():
            for a in sorted(alts):
                by.setdefault(n, []).append(len(prods))
                prods.append((n, a))
        self.prods = prods
        nts = set(by)
        for _, body in prods:
            for x in body:
                if x not in nts and re.fullmatch(r"<\w+>", x):
                    raise ValueError(f"rule {x} has no production")
        self.terminals = {x for _, b in prods for x in b if x not in nts}
        first: dict[str, set[str]] = {n: set() for n in nts}
        changed = True
        while changed:
            changed = False
            for n, b in prods[1:]:
                add = first[b[0]] if b[0] in nts else {b[0]}
                if not add <= first[n]:
                    first[n] |= add
                    changed = True
        follow: dict[str, set[str]] = {n: set() for n in nts}
        follow[self.start].add("$")
        changed = True
        while changed:
            changed = False
            for n, b in prods[1:]:
                for i, x in enumerate(b):
                    if x in nts:
                        add = (first[b[i + 1]] if b[i + 1] in nts else {b[i + 1]}) if i + 1 < len(b) else follow[n]
                        if not add <= follow[x]:
                            follow[x] |= add
                            changed = True

        def closure(items: frozenset) -> list[tuple[int, int]]:
            seen, todo = set(items), list(items)
            while todo:
                p, d = todo.pop()
                body = prods[p][1]
                if d < len(body) and body[d] in nts:
                    for q in by[body[d]]:
                        if (q, 0) not in seen:
                            seen.add((q, 0))
                            todo.append((q, 0))
            return list(seen)

        start = frozenset([(0, 0)])
        ids, order, self.action, self.goto = {start: 0}, [start], [], []
        self.units: dict[tuple[int, int, str], int] = {}
        k = 0
        while k < len(order):
            moves: dict[str, set] = {}
            reduces: dict[str, list[tuple[str, int]]] = {}
            accept = False
            for p, d in closure(order[k]):
                body = prods[p][1]
                if d < len(body):
                    moves.setdefault(body[d], set()).add((p, d + 1))
                elif p == 0:
                    accept = True
                else:
                    for t in follow[prods[p][0]]:
                        reduces.setdefault(t, []).append((prods[p][0], len(body)))
            act: dict[str, tuple] = {}
            go: dict[str, int] = {}
            for x, kernel in moves.items():
                kernel = frozenset(kernel)
                if kernel not in ids:
                    ids[kernel] = len(order)
                    order.append(kernel)
                if x in nts:
                    go[x] = ids[kernel]
                else:
                    act[x] = (ids[kernel], ())
            for t, rs in reduces.items():
                act[t] = (act[t][0] if t in act else -1, tuple(sorted(set(rs))))
            if accept:
                act["$"] = (-2, act.get("$", (0, ()))[1])
            # one action: plain tuple; several: marked for the graph-structured path
            self.action.append({t: (s, None, 0) if not r else ((-1, *r[0]) if s == -1 and len(r) == 1 else (s, r, -1)) for t, (s, r) in act.items()})
            self.goto.append(go)
            k += 1


def recognise(g: Grammar, tokens: list[str], asi: list[bool] | None = None) -> int:
    """Index of the first token no reading accepts, -1 if all are accepted.

    ``tokens`` must not hold the end marker.  ``asi`` marks the tokens before
    which a missing semicolon, the token ``ASI``, may be supplied (the last
    entry stands for the end): it is supplied where the token would be an error,
    and tried as one more reading where several readings are open.
    An empty token list is accepted if the start rule may be empty.
    """
    if not tokens:
        return -1 if g.nullable_start else 0
    action, goto, units = g.action, g.goto, g.units
    top = [0, None]  # node: [state, parent or list of parents]
    single = True
    front: list = []
    n = len(tokens)
    i = 0
    while i <= n:
        t = tokens[i] if i < n else "$"
        if single:
            node = top
            while True:
                a = action[node[0]].get(t)
                if a is None:
                    break
                s, lhs, k = a
                if lhs is None:
                    if s == -2:
                        return -1
                    top = [s, node]
                    break
                if k == 1:
                    # reductions of one symbol leave the node below in place, so a chain of them ends in a state that can be kept
                    base = node[1]
                    if base[0].__class__ is list:
                        a = (0, 0, -1)
                        break
                    key = (base[0], node[0], t)
                    if (to := units.get(key)) is None:
                        to = units[key] = _chain(action, goto[base[0]], node[0], t)
                    node = [to, base]
                    continue
                if k == -1:
                    break
                base = node
                while k:
                    base = base[1]
                    if base.__class__ is list and base and base[0].__class__ is list:
                        break
                    k -= 1
                if k:
                    a = (0, 0, -1)
                    break
                node = [goto[base[0]][lhs], base]
            if a is None:
                if asi is None or not asi[i] or not (front := _supplied(g, [top], t)):
                    return i
                single = False
                continue
            if a[1] is None:
                i += 1
                continue
            front = [node]
            single = False
        if asi is not None and asi[i]:
            front = front + _supplied(g, front, t)
        nxt = _many(g, front, t)
        if nxt is True:
            return -1
        if not nxt:
            return i
        i += 1
        if len(nxt) == 1 and not _multi(nxt[0]):
            single, top = True, nxt[0]
        else:
            front = nxt
    return -1


def _chain(action: list, go: dict, state: int, t: str) -> int:
    """The state after all reductions of one symbol over one node; a grammar without rules that produce themselves ends it."""
    while (a := action[state].get(t)) is not None and a[1] is not None and a[2] == 1:
        state = go[a[1]]
    return state


def _supplied(g: Grammar, front: list, t: str) -> list:
    """Readings that accept ``t`` once an automatic semicolon stands before it."""
    return [x for x in _many(g, front, "ASI") or () if _many(g, [x], t)]


def _multi(node) -> bool:
    p = node[1]
    return bool(p) and p[0].__class__ is list


def _parents(node):
    p = node[1]
    if p is None:
        return ()
    return p if p and p[0].__class__ is list else (p,)


def _many(g: Grammar, front: list, t: str):
    """All nodes after shifting ``t``; True when the input is accepted."""
    action, goto = g.action, g.goto
    nodes: dict[int, list] = {}
    own: set[int] = set()  # states whose node was made here and may be changed
    for x in front:
        y = nodes.get(x[0])
        if y is None:
            nodes[x[0]] = x
        else:
            ps = [*_parents(y), *(p for p in _parents(x) if not any(q is p for q in _parents(y)))]
            nodes[x[0]] = [x[0], ps if len(ps) > 1 else ps[0]]
            own.add(x[0])
    todo = list(nodes.values())
    while todo:
        x = todo.pop()
        a = action[x[0]].get(t)
        if a is None or a[1] is None:
            continue
        for lhs, k in a[1] if a[2] == -1 else (a[1:],):
            y = x
            for _ in range(k):
                y = y[1]
                if y[0].__class__ is list:
                    bases = _bases(x, k)
                    break
            else:
                bases = (y,)
            for b in bases:
                to = goto[b[0]].get(lhs)
                if to is None:
                    continue
                have = nodes.get(to)
                if have is None:
                    nodes[to] = have = [to, b]
                    own.add(to)
                    todo.append(have)
                    continue
                ps = _parents(have)
                if any(q is b for q in ps):
                    continue
                if to not in own:
                    nodes[to] = have = [to, have[1]]
                    own.add(to)
                have[1] = [*ps, b]
                todo = list(nodes.values())  # a new path may end any reduction
    merged: dict[int, list] = {}
    for s, x in nodes.items():
        a = action[s].get(t)
        if a is None:
            continue
        to = a[0]
        if to == -2:
            return True
        if to >= 0 and (a[1] is None or a[2] == -1):
            merged.setdefault(to, []).append(x)
    return [[s, ps if len(ps) > 1 else ps[0]] for s, ps in merged.items()]


def _bases(x, k: int) -> list:
    """All nodes ``k`` links below."""
    bases = [x]
    for _ in range(k):
        seen: set[int] = set()
        below = []
        for b in bases:
            for p in _parents(b):
                if id(p) not in seen:
                    seen.add(id(p))
                    below.append(p)
        bases = below
    return bases
