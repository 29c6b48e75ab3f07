"""A linear-chain conditional random field over word-shape features, in numpy.

Words fall into classes by their features, so a word's potentials are looked up, not
computed.  Training maximises the penalised likelihood of a small labelled table by Adam
over forward-backward expectations.  Decoding is Viterbi over batches.  A word whose own
score for "outside" beats every other state by more than transitions could ever make up
is outside in the best path; sequences are cut there, which leaves short pieces and the
same result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

# Words that stand beside personal data, and words of which names of secrets are made.
KEYWORDS = frozenset(
    "token secret password passwd pwd key api_key apikey access_key bearer auth = : phone tel call fax mobile ring dial cell "
    "at (at) [at] dot (dot) [dot] com org net mail email hash".split()
)
SECRET_WORDS = frozenset("token secret password passwd pwd key apikey auth credential".split())
_JOINED = re.compile(r"[_.-]")
ASSIGNED = re.compile(r"[\"'`]?([A-Za-z][A-Za-z0-9_.-]*)[\"'`]?[=:](?=.)")
_TRIM = "\"'`.,;:!?()[]{}<>#$%&*|"
_QUOTES = "\"'`"


def names_secret(low: str) -> bool:
    """Whether a lower-case name is made of several words of which one says that a secret follows."""
    return not SECRET_WORDS.isdisjoint(_JOINED.split(low.strip("=:")))


def word_features(word: str) -> tuple[str, ...]:
    """Shape features of one whitespace-separated word."""
    low = word.lower()
    if low in KEYWORDS:
        return ("kw=" + low,)
    bare = word.strip(_TRIM)
    low = bare.lower()
    if low in KEYWORDS:
        return ("kw=" + low, "trimmed") + (("ends=:",) if word[-1] in ":=" else ())
    if not bare:
        return ("marks",)
    if not any(c.isdigit() for c in low) and names_secret(low):
        return ("kw=compound",) + (("ends=:",) if word[-1] in ":=" else ())
    assigned = ASSIGNED.match(word)
    if assigned and names_secret(assigned[1].lower()):
        return ("assigns", f"len={min((len(word) - assigned.end()) // 4, 6)}")
    if bare.isalpha():
        case = "lower" if bare.islower() else "upper" if bare.isupper() else "title" if bare.istitle() else "mixed"
        return ("alpha", "case=" + case)
    digits = sum(c.isdigit() for c in bare)
    out = [f"len={min(len(bare) // 4, 6)}", f"digits={min(digits, 4)}"]
    if bare.isdigit():
        out += ["number", f"long={min(len(bare), 9)}"]
        if bare[0] == "0":
            out.append("zero")
    elif all(c in "0123456789-.()" for c in word.rstrip(".,;!?")):
        groups = "-".join(str(len(g)) for g in bare.replace(".", "-").replace("(", "-").replace(")", "-").split("-"))
        out += ["grouped", "groups=" + groups]
    elif digits and len(bare) >= 12 and bare.isalnum():
        out += ["key", "hex" if all(c in "0123456789abcdef" for c in low) else "base62"]
    elif digits and bare.isalnum():
        out.append("alnum")
    else:
        out.append("other")
    if word[0] in _QUOTES:
        out.append("quoted")
    if "@" in word:
        out.append("has@")
    return tuple(out)


class Classes:
    """Words to classes of equal features; remembers a bounded number of words of bounded length."""

    MOST_WORDS = 300_000
    LONGEST_HELD = 256

    def __init__(self) -> None:
        self.of_features: dict[tuple[str, ...], int] = {(): 0}  # 0: beyond either end
        self._of_word: dict[str, int] = {}

    def ids(self, words: list[str]) -> np.ndarray:
        known = self._of_word
        if len(known) > self.MOST_WORDS:
            known.clear()
        out = np.empty(len(words), np.int32)
        for i, word in enumerate(words):
            at = known.get(word)
            if at is None:
                at = self.of_features.setdefault(word_features(word), len(self.of_features))
                if len(word) <= self.LONGEST_HELD:
                    known[word] = at
            out[i] = at
        return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class Crf:
    """States 0 (outside), then begin and inside of each kind; weights by feature and offset."""

    kinds: tuple[str, ...]
    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None  # (offset -1, 0, +1; feature; state)
    moves: np.ndarray | None = None  # (state, state)

    @property
    def states(self) -> int:
        return 1 + 2 * len(self.kinds)

    def _allowed(self) -> np.ndarray:
        """An inside state follows only the begin or inside of its kind."""
        ok = np.ones((self.states, self.states), bool)
        for k in range(len(self.kinds)):
            inside = 2 + 2 * k
            ok[:, inside] = False
            ok[[inside - 1, inside], inside] = True
        return ok

    def potentials(self, classes: Classes) -> np.ndarray:
        """(offset, class, state) sums of weights; unknown features weigh nothing."""
        out = np.zeros((3, len(classes.of_features), self.states))
        for f, c in classes.of_features.items():
            at = [self.features[x] for x in f if x in self.features]
            if at:
                out[:, c] = self.weights[:, at].sum(axis=1)
        return out

    def fit(self, table: list[tuple[list[str], list[int]]], steps: int = 120, l2: float = 0.02) -> Crf:
        """Trains on rows (words, states)."""
        classes = Classes()
        ids = [classes.ids(words) for words, _ in table]
        for f in classes.of_features:
            for x in f:
                self.features.setdefault(x, len(self.features))
        nf, k, n, nc = len(self.features), self.states, len(table), len(classes.of_features)
        holds = np.zeros((nc, nf))
        for f, c in classes.of_features.items():
            holds[c, [self.features[x] for x in f]] = 1
        longest = max(map(len, ids))
        x = np.zeros((n, longest + 2), int)
        y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (own, (_, states)) in enumerate(zip(ids, table, strict=True)):
            x[i, 1 : len(own) + 1] = own
            y[i, : len(own)], mask[i, : len(own)] = states, True
        seen = [x[:, :-2][mask], x[:, 1:-1][mask], x[:, 2:][mask]]  # classes before, at and after each word
        banned = np.where(self._allowed(), 0.0, -1e4)
        gold = np.eye(k)[y] * mask[:, :, None]
        pairs = np.einsum("ntj,ntk->jk", gold[:, :-1], gold[:, 1:])
        params = np.zeros(3 * nf * k + k * k)
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, steps + 1):
            w, a = params[: 3 * nf * k].reshape(3, nf, k), params[3 * nf * k :].reshape(k, k) + banned
            e = np.zeros((n, longest, k))
            e[mask] = sum((holds @ w[o])[seen[o]] for o in range(3))
            alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            alpha[:, 0] = e[:, 0] + banned[0]
            for t in range(1, longest):
                new = _logsumexp(alpha[:, t - 1, :, None] + a[None], 1) + e[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = _logsumexp(a[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
            z = _logsumexp(alpha[:, -1], 1)
            p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
            joint = alpha[:, :-1, :, None] + a[None, None] + (e + beta)[:, 1:, None, :] - z[:, None, None, None]
            q = (np.exp(np.minimum(joint, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
            off = (p - gold)[mask]
            by_class = [np.stack([np.bincount(at, off[:, j], nc) for j in range(k)], axis=1) for at in seen]
            grad = np.concatenate([*((holds.T @ g).ravel() for g in by_class), (q - pairs).ravel()]) / n
            grad += l2 * params / n
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            params -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = params[: 3 * nf * k].reshape(3, nf, k)
        self.moves = params[3 * nf * k :].reshape(k, k) + banned
        return self

    def decode(self, ids: np.ndarray, lengths: list[int], potentials: np.ndarray) -> np.ndarray:
        """The best states of concatenated sequences of word classes."""
        n = len(ids)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        starts = np.cumsum([0, *lengths[:-1]])
        starts = starts[np.array(lengths) > 0]
        first = np.zeros(n, bool)
        first[starts] = True
        last = np.append(first[1:], True)
        before, after = np.where(first, 0, np.roll(ids, 1)), np.where(last, 0, np.roll(ids, -1))

        real = self.moves[self._allowed()]
        reach = 2 * (real.max() - real.min())  # the most that both transitions can gain
        margin = potentials[:, :, :1] - potentials[:, :, 1:]
        least = margin.min(axis=2)
        sure = least[0][before] + least[1][ids] + least[2][after] > reach
        if sure.all():
            return out
        open_ = ~sure
        begins = open_ & (first | np.append(True, sure[:-1]))
        ends = open_ & (last | np.append(sure[1:], True))
        at, size = np.flatnonzero(begins), np.flatnonzero(ends) - np.flatnonzero(begins) + 1
        order = np.argsort(-size, kind="stable")
        at, size = at[order], size[order]
        opened = first[at]  # at a sequence's start nothing precedes, elsewhere "outside" does
        entry = np.where(opened[:, None], np.where(self._allowed()[0], 0.0, -1e4), self.moves[0])
        closing = np.where(last[at + size - 1][:, None], 0.0, self.moves[:, 0])

        def own(where: np.ndarray) -> np.ndarray:
            return potentials[0][before[where]] + potentials[1][ids[where]] + potentials[2][after[where]]

        score = own(at) + entry
        back = []
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))  # pieces longer than t
            both = score[:live, :, None] + self.moves[None]
            back.append(both.argmax(axis=1).astype(np.int8))
            score[:live] = both.max(axis=1) + own(at[:live] + t)
        state = (score + closing).argmax(axis=1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            out[at[:live] + t] = state[:live]
            if t:
                state[:live] = back[t - 1][np.arange(live), state[:live]]
        return out
