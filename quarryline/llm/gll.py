"""Generalised LL recognition with a graph-structured stack.

Grammars are written as text, one rule a line (``Name: a b | c (d e)* f?``). Names with a rule are nonterminals, all
other words are terminals. A token is a character that stands for a set of terminals, so that a token can be a
keyword in one place and a name in another, and a whole bracketed group can be all things that its content may be.
Strings of tokens that were judged before are remembered, up to a bound.
"""

from __future__ import annotations

import re

END, AHEAD = "$", "!"
_KEPT = 80_000


class Tokens:
    """Sets of terminals as single characters."""

    def __init__(self) -> None:
        self.sets: list[frozenset[str]] = [frozenset()]
        self.codes: dict[frozenset[str], str] = {}

    def code(self, terminals: frozenset[str]) -> str:
        """The character of a set of terminals."""
        c = self.codes.get(terminals)
        if c is None:
            n = len(self.sets)
            c = self.codes[terminals] = chr(n if n < 0xD800 else n + 0x800)
            self.sets.append(terminals)
        return c

    def of(self, c: str) -> frozenset[str]:
        """The set of terminals of a character."""
        n = ord(c)
        return self.sets[n if n < 0xD800 else n - 0x800]


class Grammar:
    """A grammar ready for recognition; ``tokens`` may be shared by several grammars."""

    def __init__(self, rules: str, tokens: Tokens) -> None:
        self.tokens = tokens
        self.alts: dict[str, list[list[str]]] = {}
        self._fresh = 0
        for line in re.sub(r"\n\s+\|", " |", rules.strip()).split("\n"):
            if line.strip() and not line.lstrip().startswith("#"):
                name, _, body = line.strip().partition(": ")
                words = re.findall(r"'[^']+'|[()|?*+]|[^\s()|?*+']+", body)
                self.alts.setdefault(name, []).extend(self._read(words, 0)[0])
        self._number()
        self.known: dict[tuple[str, str], bool] = {}

    def _new(self, alts: list[list[str]]) -> str:
        self._fresh += 1
        name = f"@{self._fresh}"
        self.alts[name] = alts
        return name

    def _read(self, words: list[str], at: int) -> tuple[list[list[str]], int]:
        alts: list[list[str]] = [[]]
        while at < len(words):
            w = words[at]
            at += 1
            if w == ")":
                return alts, at
            if w == "|":
                alts.append([])
                continue
            if w == "(":
                inner, at = self._read(words, at)
                item = self._new(inner)
            elif w in ("?", "*", "+"):
                last = alts[-1].pop()
                if w == "?":
                    item = self._new([[last], []])
                else:
                    item = self._new([[last, f"@{self._fresh + 1}"], []])
                    if w == "+":
                        item = self._new([[last, item]])
            else:
                item = w[1:-1] if len(w) > 2 and w[0] == w[-1] == "'" else w
            alts[-1].append(item)
        return alts, at

    def _number(self) -> None:
        nullable: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in self.alts}
        while True:
            before = (len(nullable), sum(map(len, first.values())))
            for name, alts in self.alts.items():
                for alt in alts:
                    for s in alt:
                        if s in self.alts:
                            first[name] |= first[s]
                            if s not in nullable:
                                break
                        elif s != END and s[0] != AHEAD or len(s) == 1 and s == AHEAD:
                            first[name].add(s)
                            break
                        elif s == END:
                            first[name].add(END)
                            break
                    else:
                        nullable.add(name)
            if before == (len(nullable), sum(map(len, first.values()))):
                break
        #: at every slot: its symbol (None at an alternative's end), and whether that is a nonterminal
        self.symbol: list[str | None] = []
        self.calls: list[bool] = []
        #: of every nonterminal: (slot, terminals it may begin with, or None for any)
        self.starts: dict[str, list[tuple[int, frozenset[str] | None]]] = {}
        for name, alts in self.alts.items():
            self.starts[name] = []
            for alt in alts:
                begin: set[str] = set()
                for s in alt:
                    if s in self.alts:
                        begin |= first[s]
                        if s not in nullable:
                            break
                    elif s == END or s[0] == AHEAD and len(s) > 1:
                        if s == END:
                            begin.add(END)
                            break
                    else:
                        begin.add(s)
                        break
                else:
                    begin = set()
                self.starts[name].append((len(self.symbol), frozenset(begin) if begin else None))
                for s in alt:
                    self.symbol.append(s)
                    self.calls.append(s in self.alts)
                self.symbol.append(None)
                self.calls.append(False)

    def accepts(self, start: str, text: str) -> bool:
        """Whether the nonterminal derives the tokens."""
        key = (start, text)
        known = self.known.get(key)
        if known is None:
            if len(self.known) > _KEPT:
                self.known.clear()
            known = self.known[key] = self._run(start, text)
        return known

    def _run(self, start: str, text: str) -> bool:
        of = self.tokens.of
        sets = [of(c) for c in text]
        n = len(sets)
        sets.append(frozenset((END,)))
        symbol, calls, starts = self.symbol, self.calls, self.starts
        # stack nodes by (nonterminal, position): their return edges and the ends that they were left at
        edges: dict[tuple[str, int], list] = {(start, 0): []}
        ends: dict[tuple[str, int], set[int]] = {(start, 0): set()}
        seen: set = set()
        todo: list = []
        root = (start, 0)
        for slot, begin in starts[start]:
            if begin is None or not begin.isdisjoint(sets[0]):
                todo.append((slot, root, 0))
        while todo:
            slot, node, at = todo.pop()
            while True:
                s = symbol[slot]
                if s is None:
                    if at not in ends[node]:
                        ends[node].add(at)
                        if node is root and at == n or node == root and at == n:
                            return True
                        for back, parent in edges[node]:
                            d = (back, parent, at)
                            if d not in seen:
                                seen.add(d)
                                todo.append(d)
                    break
                if calls[slot]:
                    child = (s, at)
                    back = (slot + 1, node)
                    if child not in edges:
                        edges[child] = [back]
                        ends[child] = set()
                        now = sets[at]
                        for first, begin in starts[s]:
                            if begin is None or not begin.isdisjoint(now):
                                todo.append((first, child, at))
                    elif back not in edges[child]:
                        edges[child].append(back)
                        for end in ends[child]:
                            d = (slot + 1, node, end)
                            if d not in seen:
                                seen.add(d)
                                todo.append(d)
                    break
                if s == END:
                    if at != n:
                        break
                elif s[0] == AHEAD and len(s) > 1:
                    if s[1:] in sets[at]:
                        break
                elif s in sets[at] and at < n:
                    at += 1
                else:
                    break
                slot += 1
        return False
