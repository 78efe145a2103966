"""A tokenization automaton for byte-pair merges, and its use for encoding and decoding.

The automaton reads tokens and accepts exactly the token sequences that the merges produce. It
starts with one state and a loop for every base symbol. Merges are then added in order, each by
one gadget: for a merge of a and b into c, the state that a leads to is replaced, for arcs
labelled a, by a copy without its b-arc, and every state that had such an a-arc gets a c-arc to
where that b-arc led. All arcs with one label lead to one state throughout, so the state is
known by the last label, and the gadget reduces to: a no longer goes before b; c may come wherever
a may come at that time; and after c may come whatever might follow b at that time.

The compiled form keeps, for each label, its state's arcs as the history of these gadgets: for
the label c made by merge number m, arcs into c copy those into a as of m, arcs out of c copy
those out of b as of m, and single arcs (a, b) were cut at their merge's number. ``arc(x, y)`` is
read off these tables, and answers are kept in a bounded table of transitions.

Encoding a word walks its symbols from left to right through a second table, compiled from the labels' spellings:
from the state of the symbols so far and the next symbol it leads to the state that knows the longest label ending
there, and each label knows the next shorter one that ends it (both deterministic, one step a symbol). At each place
exactly one label ends an accepted path; it is the first of these whose arc leaves the state reached where it begins.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

#: Transitions kept in the table; beyond it the table starts anew.
MOST_ARCS = 2_000_000
NEVER = 1 << 60


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str = "") -> None:
        self.word_end = word_end
        self.vocab = vocab
        self.labels = {i: s for s, i in vocab.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        self.base = {i for s, i in vocab.items() if len(self.symbols(s)) == 1}
        for number, (a, b) in enumerate(merges):
            self._gadget(number, vocab[a], vocab[b], vocab[a + b])
        #: Labels that some arc has: base symbols, and what a gadget made.
        self.live = {s: i for s, i in vocab.items() if i in self.made or i in self.base}
        self.table: dict[tuple[int, int], bool] = {}
        self._spell()

    def symbols(self, spelling: str) -> list[str]:
        """The symbols of a word or label; a word's end goes with its last symbol."""
        end = self.word_end
        if end and spelling.endswith(end) and len(spelling) > len(end):
            plain = spelling[: -len(end)]
            return [*plain[:-1], plain[-1] + end]
        return list(spelling)

    def _spell(self) -> None:
        """Compile the spellings: ``step[state, symbol]``, the longest label at each state, the next shorter of each label."""
        self.step: dict[tuple[int, str], int] = {}
        parent, ends = [(0, "")], [-1]
        self.size: dict[int, int] = {}
        for spelling, label in self.live.items():
            state, own = 0, self.symbols(spelling)
            for symbol in own:
                key = (state, symbol)
                if key not in self.step:
                    self.step[key] = len(parent)
                    parent.append(key)
                    ends.append(-1)
                state = self.step[key]
            ends[state] = label
            self.size[label] = len(own)
        depth = [0] * len(parent)
        for state in range(1, len(parent)):
            depth[state] = depth[parent[state][0]] + 1
        self.back = [0] * len(parent)  # the state of the longest proper ending
        self.shorter: dict[int, int] = {}
        for state in sorted(range(1, len(parent)), key=depth.__getitem__):
            above, symbol = parent[state]
            self.back[state] = self.next(self.back[above], symbol) if above else 0
            below = ends[self.back[state]]
            if ends[state] < 0:
                ends[state] = below
            else:
                self.shorter[ends[state]] = below
        self.ends = ends

    def next(self, state: int, symbol: str) -> int:
        """The state after one more symbol; answers found by shorter endings are kept in the table."""
        key = (state, symbol)
        found = self.step.get(key)
        if found is None:
            found = self.next(self.back[state], symbol) if state else 0
            if state and len(self.step) < MOST_ARCS:
                self.step[key] = found
        return found

    def _gadget(self, number: int, a: int, b: int, c: int) -> None:
        """Add one merge: cut the arc a-b and record what c's arcs copy."""
        known = all(x in self.base or x in self.made for x in (a, b))
        if not known or not self._has_arc(a, b, number):
            return  # no state has this pair of arcs, so no text reaches the merge
        if c in self.made:
            raise ValueError(f"two merges make {self.labels[c]!r}")
        self.cut[a, b] = number
        self.left[c], self.right[c], self.made[c] = a, b, number

    def arc(self, x: int, y: int) -> bool:
        """Whether the state that label ``x`` leads to has an arc labelled ``y``."""
        key = (x, y)
        found = self.table.get(key)
        if found is None:
            found = self._has_arc(x, y, NEVER)
            if len(self.table) >= MOST_ARCS:
                self.table.clear()
            self.table[key] = found
        return found

    def _has_arc(self, x: int, y: int, when: int) -> bool:
        """Whether the arc is there just before gadget number ``when``.

        The younger label got its arcs as copies, so the question passes to the label they were
        copied from, at the time of the copy; on the way the arc must not have been cut. Arcs into
        a new label are copied after its gadget's own cut, arcs out of it before.
        """
        made = self.made
        while True:
            if self.cut.get((x, y), NEVER) < when:
                return False
            born_x, born_y = made.get(x, -1), made.get(y, -1)
            if born_x < 0 and born_y < 0:
                return True
            if born_y > born_x:
                y, when = self.left[y], born_y + 1
            elif born_x > born_y:
                x, when = self.right[x], born_x
            else:  # one label twice
                x, y, when = self.right[x], self.left[x], born_x

    def encode(self, word: str) -> list[int]:
        """Labels of the one accepted path that spells ``word`` (its last symbol ends the word)."""
        n, table, step, size, shorter = len(word), self.table, self.step, self.size, self.shorter
        last: list[int] = [-1] * (n + 1)  # by place: the label that ends the accepted path there
        state = 0
        for stop in range(1, n + 1):
            symbol = word[stop - 1] + self.word_end if stop == n else word[stop - 1]
            found = step.get((state, symbol))
            state = self.next(state, symbol) if found is None else found
            label = self.ends[state]
            while label >= 0:
                start = stop - size[label]
                if not start:
                    break
                key = (last[start], label)
                ok = table.get(key)
                if self.arc(*key) if ok is None else ok:
                    break
                label = shorter[label]
            if label < 0:
                raise ValueError(f"no label spells {symbol!r}")
            last[stop] = label
        out, place = [], n
        while place:
            out.append(last[place])
            place -= size[last[place]]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> list[str]:
        """The arcs' labels, one by one."""
        return [self.labels[i] for i in ids]
