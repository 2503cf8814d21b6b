"""Byte-pair encoding as a tropical shortest path over a trie: pieces are arcs, and weights add up along a path.

A sequence of pieces is what byte-pair merging makes of its text if and only if merging makes each two neighbours of
it of theirs. So an arc weighs one for each id that it puts out, and infinity where the pair that it makes with the
arc before is not merging's own. Of all arcs into a prefix one at most has a finite weight, so the minimum over them
is known with the first that is finite.

Words are inserted into a trie. Its nodes are prefixes, each with the best arc into it and the forward score of its
shortest path, computed once for all words that share the prefix, now and in later calls.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

INFINITE = float("inf")


class Lattice:
    """Arcs compiled from pieces with their ranks (lower merges first), and the trie of the words composed with them. A
    character that is no piece has a fallback arc of its own, with number -1 and a weight of `fallback` an id."""

    def __init__(self, ranks: dict, most_pairs: int = 1_000_000, most_nodes: int = 400_000):
        self.ranks, self.most_pairs, self.most_nodes = ranks, most_pairs, most_nodes
        self.pieces = list(ranks)
        self._index = {p: i for i, p in enumerate(ranks)}
        self._weights: dict[int, float] = {}
        # the last three characters say which lengths a last piece can have; the last two, where no piece has those
        self._lengths: dict = {}
        for p in ranks:
            self._lengths.setdefault(p[-3:], set()).add(len(p))
        shorter = {t: {1, *([2] if t in ranks else [])} for t in {p[k : k + 2] for p in ranks for k in range(len(p) - 1)}}
        for tail, own in self._lengths.items():
            own |= shorter.get(tail[-2:], {1}) if len(tail) == 3 else {1}
        self._shorter = {t: sorted(own, reverse=True) for t, own in shorter.items()}
        self._lengths = {tail: sorted(own, reverse=True) for tail, own in self._lengths.items()}
        self._plant()

    def _plant(self) -> None:
        self._children: dict[int, int] = {}
        #: For each node: number of the best arc into it (-1: the fallback), characters that the arc spans, forward score.
        self.number, self.span, self.score = [-1], [0], [0]

    def merged(self, text) -> list:
        """Plain byte-pair merging, by rank and from the left; for short texts."""
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = self.ranks
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def pair_weight(self, a, b) -> float:
        """Nothing where merging keeps a and b apart and makes both of their text, infinity elsewhere."""
        return 0 if self.merged(a + b) == [a, b] else INFINITE

    def arcs(self, word, end: int) -> Iterator[tuple[int, int]]:
        """(number, span) of the arcs that end there, longest first; the fallback if the last character is no piece."""
        for size in self._sizes(word, end):
            if size <= end and (i := self._index.get(word[end - size : end])) is not None:
                yield i, size
        if word[end - 1 : end] not in self._index:
            yield -1, 1

    def _sizes(self, word, end: int) -> Iterable[int]:
        sizes = self._lengths.get(word[end - 3 : end]) if end > 2 else None
        return sizes if sizes is not None else self._shorter.get(word[end - 2 : end], (1,)) if end > 1 else (1,)

    def walk(self, words: Iterable) -> Iterator[tuple]:
        """(word, path) of each word inserted into the trie, in sorted order: path, the walk's own list, holds its nodes by
        length of the prefix, the root first. The trie is planted anew between two words once it has most_nodes nodes."""
        index, lengths, shorter, weights, single = self._index, self._lengths, self._shorter, self._weights, (1,)
        children, number, span, score = self._children, self.number, self.span, self.score
        path: list[int] = [0]
        previous = b"" if isinstance(next(iter(index), b""), bytes) else ""
        for word in sorted(words):  # neighbours share prefixes, whose nodes are then known without a step
            shared, most = 0, min(len(word), len(previous))
            if word[:most] == previous[:most]:
                shared = most
            else:
                while word[shared] == previous[shared]:
                    shared += 1
            if len(number) > self.most_nodes:
                self._plant()
                children, number, span, score, shared = self._children, self.number, self.span, self.score, 0
            del path[shared + 1 :]
            node = path[-1]
            for end in range(shared + 1, len(word) + 1):
                last = word[end - 1 : end]
                key = node << 21 | ord(last)
                node = children.get(key)
                if node is None:
                    best, arc, size = INFINITE, -1, 1
                    sizes = lengths.get(word[end - 3 : end]) if end > 2 else None
                    if sizes is None:
                        sizes = shorter.get(word[end - 2 : end], single) if end > 1 else single
                    for size in sizes:
                        if size > end:
                            continue
                        arc = index.get(word[end - size : end])
                        if arc is None:
                            continue
                        start = path[end - size]
                        before = number[start]
                        if before < 0:
                            best = score[start] + 1
                            break
                        weight = weights.get(before << 24 | arc)
                        if weight is None:
                            if len(weights) >= self.most_pairs:
                                weights.clear()
                            weight = weights[before << 24 | arc] = self.pair_weight(self.pieces[before], self.pieces[arc])
                        if weight < INFINITE:  # the only finite one
                            best = score[start] + 1 + weight
                            break
                    if best == INFINITE:  # the last character is no piece: nothing merges with it
                        arc, size = -1, 1
                        best = score[path[-1]] + len(last.encode("utf-8", "surrogatepass") if last.__class__ is str else last)
                    node = children[key] = len(number)
                    number.append(arc)
                    span.append(size)
                    score.append(best)
                path.append(node)
            previous = word
            yield word, path


class Cache:
    """What is known of words, in two generations: what a call needs stays whatever its number, and only what
    was not needed for long is forgotten."""

    def __init__(self, learn, remembered: int):
        self.learn, self.remembered = learn, remembered
        self.new: dict = {}
        self.old: dict = {}

    def of(self, words: set) -> dict:
        """What is known of each of the words; learnt where nothing is."""
        new, old, found, missing = self.new, self.old, {}, []
        for w in words:
            got = new.get(w)
            if got is None:
                got = old.get(w)
            if got is None:
                missing.append(w)
            else:
                found[w] = got
        found.update(self.learn(missing))
        if len(new) + len(found) > self.remembered:
            self.old, self.new = new, {}
        self.new.update(found)
        return found
