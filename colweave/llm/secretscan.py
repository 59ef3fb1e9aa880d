"""Secret scanning: fixed formats, and automata inferred from labelled credentials.

Labelled are all credentials of each fixed kind in the documents, and
examples of widely used formats (SHAPES), made by rule. The examples of a kind form
a frequency prefix tree whose statistically compatible states are merged (ALERGIA,
Carrasco and Oncina 1994; of several the one that explains the state best) into a
probabilistic automaton with its final probabilities. Of a table's credentials that tree
is never held: rounds over all of them count, by state, what the next AHEAD characters are
(see Growth). All words of ordinary text give a background model. Every token of LEAST characters or more of
every document is a candidate; it becomes a span where the likelihood of its format under some automaton,
end included, beats the background's by EVIDENCE.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter, deque
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPANS, Shared, Span, map_rows, outside, span_rows, stash

# Kinds in order, and the formats of the contract.
KINDS = ["assign", "access", "hex", "format"]
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
# Published formats of credentials, as literal prefixes and (alphabet, length).
ALNUM = string.ascii_letters + string.digits
URLSAFE = ALNUM + "-_"
SHAPES = {
    "github": ("ghp_", (ALNUM, 36)),
    "gitlab": ("glpat-", (URLSAFE, 20)),
    "slack": ("xoxb-", (string.digits, 12), "-", (string.digits, 12), "-", (ALNUM, 24)),
    "stripe": ("sk_live_", (ALNUM, 24)),
    "google": ("AIza", (URLSAFE, 35)),
    "sendgrid": ("SG.", (URLSAFE, 22), ".", (URLSAFE, 43)),
    "npm": ("npm_", (ALNUM, 36)),
    "jwt": ("eyJhbGciOiJ", (ALNUM, 25), ".eyJ", (URLSAFE, 40), ".", (URLSAFE, 43)),
    "upper hex": (("0123456789ABCDEF", 40),),
}

EXAMPLES, WEIGHT = 100, 50
LEAST = 12
#: Credentials of a fixed kind without which no automaton of it is inferred.
LEAST_EXAMPLES = 8
ALPHA = 0.05
#: Over a whole table: characters by which states are compared, and the difference of two shares that tells states apart however many credentials there are.
AHEAD, APART = 2, 0.1
#: In natural logarithms: in all, and a character.
EVIDENCE, EVIDENCE_PER_CHARACTER = 16.0, 0.3
#: What the background adds to each pair's count: SMOOTH, or a share of all pairs, so that it stays as sure on a larger table.
SMOOTH, SMOOTH_SHARE = 0.5, 4e-6
ALPHABET = 66


def examples(shape: str, rng: random.Random, n: int = EXAMPLES) -> list[str]:
    return ["".join(p if isinstance(p, str) else "".join(rng.choices(p[0], k=p[1])) for p in SHAPES[shape]) for _ in range(n)]


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def candidates(text: str) -> list[Span]:
    return [(m.start(), m.end(), "format") for m in TOKEN.finditer(text) if m.end() - m.start() >= LEAST]


def pairs_of(words: dict[str, int]) -> Counter:
    """Character pairs of the words, each as often as documents have it, to a bound."""
    out = Counter()
    for w, n in words.items():
        for k in range(len(w) - 1):
            out[w[k : k + 2]] += min(n, WEIGHT)
    return out


class Automaton:
    """A probabilistic automaton as plain dicts: counts of visits, ends and moves by character."""

    def __init__(self, words: Iterable[str], alpha: float = ALPHA) -> None:
        self.visits, self.ends, self.moves, self.counts = [0], [0], [{}], [Counter()]
        for w in words:
            at = 0
            self.visits[0] += 1
            for c in w:
                if c not in self.moves[at]:
                    self.moves[at][c] = len(self.visits)
                    self.visits.append(0)
                    self.ends.append(0)
                    self.moves.append({})
                    self.counts.append(Counter())
                self.counts[at][c] += 1
                at = self.moves[at][c]
                self.visits[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    @classmethod
    def of(cls, states: list[tuple[int, int, dict[str, tuple[int, int]]]]) -> Automaton:
        """From its states: visits, ends, and moves with their targets and counts."""
        out = cls.__new__(cls)
        out.states = states
        return out

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.moves[a].keys() | self.moves[b].keys():
                if self._differ(self.counts[a][c], n, self.counts[b][c], m):
                    return False
                if c in self.moves[a] and c in self.moves[b]:
                    todo.append((self.moves[a][c], self.moves[b][c]))
        return True

    def _fit(self, a: int, b: int) -> float:
        """Log likelihood of what follows b under a."""
        room = self.visits[a] + 0.1 * (ALPHABET + 1)
        moves = sum(k * math.log((self.counts[a][c] + 0.1) / room) for c, k in self.counts[b].items())
        return moves + self.ends[b] * math.log((self.ends[a] + 0.1) / room)

    def _fold(self, a: int, b: int) -> None:
        """Add the tree at b to the state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, target in self.moves[b].items():
                if c in self.moves[a]:
                    todo.append((self.moves[a][c], target))
                else:
                    self.moves[a][c] = target
                self.counts[a][c] += self.counts[b][c]

    def _merge(self) -> None:
        red, seen = [0], {0}
        blue = deque((0, c) for c in sorted(self.moves[0]))
        while blue:
            at, c = blue.popleft()
            target = self.moves[at][c]
            if target in seen:
                continue
            alike = [r for r in red if self._compatible(r, target)]
            if alike:
                best = max(alike, key=lambda r: self._fit(r, target))
                self.moves[at][c] = best
                self._fold(best, target)
                waiting = set(blue)
                blue.extend((s, d) for s in red for d in sorted(self.moves[s]) if self.moves[s][d] not in seen and (s, d) not in waiting)
            else:
                red.append(target)
                seen.add(target)
                blue.extend((target, d) for d in sorted(self.moves[target]))
        number = {s: k for k, s in enumerate(red)}
        self.states = [
            (self.visits[s], self.ends[s], {d: (number[t], self.counts[s][d]) for d, t in self.moves[s].items() if t in number}) for s in red
        ]
        del self.visits, self.ends, self.moves, self.counts

    def likelihood(self, word: str) -> float:
        """Log probability of the word and its end; a move not seen costs its smoothed share and leaves the state."""
        at, total = 0, 0.0
        for c in word:
            n, _, moves = self.states[at]
            target, k = moves.get(c, (at, 0))
            total += math.log((k + 0.1) / (n + 0.1 * (ALPHABET + 1)))
            at = target
        n, ends, _ = self.states[at]
        return total + math.log((ends + 0.1) / (n + 0.1 * (ALPHABET + 1)))


#: What follows in one state: by the characters read since, up to AHEAD - 1, how often each next character came ("": the end).
Follows = dict[str, Counter]


class Growth:
    """A probabilistic automaton that grows by rounds over all words of a table, whose prefix tree would grow with them.

    A round reads every word up to its first move that leads nowhere yet (count) and adds up what follows in each state
    and behind each such move: numbers bounded by the states and the alphabet. Such a move then becomes a state, or
    leads to the state that is compatible and, by its visits too, explains it best (grow). Without such moves the counts are the automaton's.
    """

    def __init__(self) -> None:
        self.moves: list[dict[str, int]] = [{}]

    def count(self, word: str, seen: Counter) -> None:
        """Add (state, move or "", what follows) of the word to seen; what follows has "" at its end if the word ends in it."""
        at = 0
        for k in range(len(word) + 1):
            seen[at, "", word[k : k + AHEAD], k + AHEAD > len(word)] += 1
            if k < len(word):
                after = self.moves[at].get(word[k])
                if after is None:
                    seen[at, word[k], word[k + 1 : k + 1 + AHEAD], k + 1 + AHEAD > len(word)] += 1
                    return
                at = after

    @staticmethod
    def _differ(a: Follows, b: Follows) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / ALPHA))
        for read in a.keys() & b.keys():
            n, m = a[read].total(), b[read].total()
            least = max(APART, bound * (n**-0.5 + m**-0.5))
            if any(abs(a[read][c] / n - b[read][c] / m) > least for c in a[read].keys() | b[read].keys()):
                return True
        return False

    @staticmethod
    def _fit(a: Counter, b: Counter) -> float:
        """Log likelihood of b under a."""
        room = a.total() + 0.1 * (ALPHABET + 1)
        return sum(n * math.log((a[c] + 0.1) / room) for c, n in sorted(b.items()))

    def grow(self, seen: Iterable[tuple[int, str, str, bool, int]]) -> Automaton | None:
        """The automaton, or None if moves were added, for another round. seen has the whole table's counts, each with its number."""
        follows: dict[tuple[int, str], Follows] = {}
        for at, move, word, ends, n in seen:
            here = follows.setdefault((at, move), {})
            for k, c in enumerate([*word, ""] if ends else word):
                here.setdefault(word[:k], Counter())[c] += n
        states = [follows.pop((k, "")) for k in range(len(self.moves))]
        if not follows:
            return Automaton.of(
                [(f[""].total(), f[""][""], {c: (m[c], f[""][c]) for c in sorted(m)}) for f, m in zip(states, self.moves, strict=True)]
            )
        for (at, move), new in sorted(follows.items(), key=lambda x: (-x[1][""].total(), x[0])):
            alike = [k for k, f in enumerate(states) if not self._differ(f, new)]
            if alike:
                best = max(alike, key=lambda k: self._fit(states[k][""], new[""]) + math.log(states[k][""].total()))
                for read, after in new.items():
                    states[best].setdefault(read, Counter()).update(after)
            else:
                best = len(states)
                states.append(new)
                self.moves.append({})
            self.moves[at][move] = best
        return None


class Background:
    """Smoothed character pairs of ordinary words, each as often as documents have it, to a bound."""

    def __init__(self, words: dict[str, int]) -> None:
        self.pairs, self.firsts = Counter(), Counter()
        self.add(pairs_of(words))

    def add(self, pairs: dict[str, int]) -> None:
        for (a, b), n in pairs.items():
            self.pairs[a, b] += n
            self.firsts[a] += n
        self.smooth = max(SMOOTH, SMOOTH_SHARE * self.pairs.total())

    def likelihood(self, word: str) -> float:
        total = math.log(1 / ALPHABET)
        for a, b in zip(word, word[1:], strict=False):
            total += math.log((self.pairs[a, b] + self.smooth) / (self.firsts[a] + self.smooth * ALPHABET))
        return total


class Grammar:
    """The automata by kind and the background."""

    def __init__(self, tokens: dict[str, list[str]], words: dict[str, int]) -> None:
        kinds = {k: tokens[k] for k in KINDS[:3] if len(tokens.get(k, ())) >= LEAST_EXAMPLES}
        kinds |= {shape: examples(shape, random.Random(shape)) for shape in SHAPES}
        self.automata = {k: Automaton(words) for k, words in kinds.items()}
        self.background = Background(words)
        self.known: dict[str, bool] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def accepts(self, token: str) -> bool:
        if token not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            least = self.background.likelihood(token) + max(EVIDENCE, EVIDENCE_PER_CHARACTER * len(token))
            self.known[token] = any(a.likelihood(token) > least for a in self.automata.values())
        return self.known[token]

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        return [s for s in outside(candidates(text), base) if self.accepts(text[s[0] : s[1]])]


def infer(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> Grammar:
    """Learn from all documents: every distinct credential of each fixed kind, and every word that two documents have.

    The driver gets counts alone, by state and characters ahead or by pair of characters; their number does not grow with the table.
    """

    def found(texts):
        seen = Counter()
        for t in texts:
            base = base_spans(t or "")
            for a, b, k in base:
                seen[k, ASSIGN.match(t, a)[1] if k == "assign" else t[a:b]] += 1
            if base:
                words = outside({(m.start(), m.end(), "plain") for m in WORD.finditer(t)}, base)
                seen.update({("plain", t[a:b]) for a, b, _ in words})
            else:
                seen.update([("plain", w) for w in set(WORD.findall(t or ""))])
        return ((k, w, n) for (k, w), n in seen.items())

    rows = map_rows(documents.select(F.col(text).alias("_text")), found, "kind string, token string, n long")
    rows = stash(rows.groupBy("kind", "token").agg(F.sum("n").alias("n")).where("kind <> 'plain' or n > 1"))

    def pairs(words, numbers):
        return pairs_of(dict(zip(words, numbers, strict=True))).items()

    grammar = Grammar({}, {})
    counted = map_rows(rows.where("kind = 'plain'").select("token", "n"), pairs, "pair string, n long")
    grammar.background.add({r["pair"]: r["n"] for r in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect()})
    tokens = rows.where("kind <> 'plain'").select("kind", "token")
    enough = {r["kind"] for r in tokens.groupBy("kind").count().collect() if r["count"] >= LEAST_EXAMPLES}
    grammar.automata = grow(tokens, [k for k in KINDS if k in enough]) | grammar.automata
    return grammar


def grow(tokens: DataFrame, kinds: list[str]) -> dict[str, Automaton]:
    """The automata of the kinds, inferred from all tokens, each with its kind; a round of all kinds is one pass."""
    out: dict[str, Automaton] = {}
    growing = {k: Growth() for k in kinds}
    keys = ["kind", "at", "move", "word", "ends"]
    while growing:
        shared = Shared(tokens.sparkSession, growing)

        def count(kinds, words, shared=shared):
            seen = {k: Counter() for k in shared.value}
            for k, w in zip(kinds, words, strict=True):
                if k in seen:
                    shared.value[k].count(w, seen[k])
            return ((k, *key, n) for k, counts in seen.items() for key, n in counts.items())

        rows = map_rows(tokens, count, "kind string, at int, move string, word string, ends boolean, n long")
        seen: dict[str, list[tuple]] = {k: [] for k in growing}
        for r in rows.groupBy(*keys).agg(F.sum("n").alias("n")).collect():
            seen[r["kind"]].append(tuple(r)[1:])
        for k, counts in seen.items():
            done = growing[k].grow(counts)
            if done:
                out[k] = done
                del growing[k]
    return {k: out[k] for k in kinds}


def scan(documents: DataFrame, id_column: str = "doc_id", text: str = "text", model: Grammar | None = None) -> DataFrame:
    """One row per input row: doc_id and spans, structs of kind, start, end and base.

    Positions are code points, ends exclusive; spans are ordered by start, then kind.
    Spans of kind format come from the inferred automata and overlap no fixed (base)
    one. Null texts count as empty; repeated rows and null ids each give their row;
    with fewer than 8 known credentials of a fixed kind no automaton of it is inferred;
    an empty table gives no rows. Other columns are not read. model is what infer has returned, to share.
    """
    grammar = Shared(documents.sparkSession, model or infer(documents, id_column, text))

    def found(ids, texts):
        for i, t in zip(ids, texts, strict=True):
            base = base_spans(t or "")
            yield i, span_rows(base, grammar.value.spans(t or "", base), KINDS)

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(rows, found, f"doc_id long, spans {SPANS}")
