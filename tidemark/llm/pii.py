"""Personal data: pattern spans and the spans of a conditional random field.

The patterns find emails, IPv4 addresses, card numbers and phone numbers by scans that are
linear in the text.  The field adds what has no fixed pattern: ``contact`` (addresses
spelled out), ``local_phone`` (numbers without a plus) and ``secret`` (keys and passwords).
It is trained from a small labelled table that is generated from the forms below.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.crf import _TRIM, ASSIGNED, Classes, Crf, names_secret

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("contact", "local_phone", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
Span = tuple[int, int, int]  # start, kind, end

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[Span]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, 0, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[Span]:
    for chain in _DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        parts, at = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, 1, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), 2, m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.start(), 3, m.end()


def base_spans(text: str) -> list[Span]:
    """The pattern spans, by start and kind."""
    out: list[Span] = []
    if "@" in text:
        out += _emails(text)
    if _DIGIT.search(text):
        out += _ips(text)
        out += _cards(text)
        if "+" in text:
            out += _phones(text)
    return sorted(out)


# The forms of the labelled table: {C}, {L}, {S} stand for a contact, a local phone and a
# secret, {A} for a secret behind its name in one word, {K} for such a name alone, {N} for an
# ordinary number, {W} for ordinary words, {R} for words that often stand beside such data.
FORMS = (
    "{W} token = {S} {W}", "{W} secret: {S} {W}", "{W} password is {S} {W}", "{W} api_key = {S} {W}",
    "{W} access_key: {S} {W}", "{W} bearer {S} {W}", "{W} the pwd {S} {W}", "{W} key = {S}",
    "{W} reach {C} {W}", "{W} write to {C} {W}", "{W} mail {C}", "{C} {W}",
    "{W} call {L} {W}", "{W} tel: {L} {W}", "{W} phone {L}", "{W} fax {L} {W}",
    "{W} hash {N} {W}", "{W} {N} {W}", "{W} at {N} {W}", "{W}", "{W} at the {W} dot {W}", "{W} token {W}",
    "{W} {K} = {S} {W}", "{W} {K}: {S}", "{W} {A} {W}", "{A}", "{W} ring {L} {W}", "{W} dial {L}", "{W} mobile: {L} {W}",
    "{W} {K} {W}", "{W} ring {W}", "{W} {N} {N} {N} {W}", "{W} from {N} to {N} {W}", "{N} {N}", "{W} call {N} {W}", "ring {N} {N} {W}",
    "{R} {W}", "{W} {R}", "{R} {R}", "{W} {R} {W} {R}", "{R}", "{R} {L} {W}", "{R} {S}",
    "{W} at at at {W} dot dot {W}", "at at at at at at", "{W} At At At At {W}",
    "{W} key {W}", "{W} = {N} {W}", "{W} call {W}", "{W} at {W}", "{N} {W} {N}", "{W} number {N}",
)


def labelled_table(rows: int = 550, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Generated rows (words, states) for training."""
    rng = random.Random(seed)
    syllables = "an en er th st on ti re ou ha la de un sch ver ge ción que é ment aux vi ll or ing".split()

    def word() -> str:
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        w = rng.choice([w, w, w, w.title(), w.upper(), w[:2].upper() + w[2:]])
        return w + rng.choice(["", "", "", "", ".", ",", "!!", "***", "%%%"])

    def text(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))

    def secret() -> list[str]:
        lower, mixed = "0123456789abcdef", "0123456789abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
        s = rng.choice([text(lower, 32, 48), text(lower.upper(), 32, 48), text(mixed, 16, 40) + "4", text(mixed, 11, 14) + "7"])
        quote = rng.choice(["", '"', '"', "'"])
        return [quote + s + quote + rng.choice(["", "", ".", "###"])]

    def contact() -> list[str]:
        at, dot = rng.choice([("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]")])
        return [word().strip(_TRIM).lower(), at, word().strip(_TRIM).lower(), dot, rng.choice(["com", "org", "net"])]

    def phone() -> list[str]:
        a, b, c = text("23456789", 3, 3), text("0123456789", 3, 3), text("0123456789", 4, 4)
        pairs = [text("0123456789", 2, 2) for _ in range(4)]
        return rng.choice(
            [[f"{a}-{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}.{b}.{c}"], [f"{b}-{c}"], ["0" + text("123456789", 1, 1), *pairs],
             ["0" + text("123456789", 2, 3), text("123456789", 4, 4), c], ["0" + text("123456789", 2, 4), c + a], ["-".join(pairs) + "-" + pairs[0]]]
        )

    def name() -> str:
        first = rng.choice(["aws", "client", "db", "my", "access", "x"])
        out = rng.choice(["_", "-"]).join([first, *rng.choice([["secret"], ["token"], ["api", "key"], ["secret", "access", "key"], ["password"]])])
        return rng.choice([out, out.upper()])

    def assigned() -> list[str]:
        return [rng.choice([name(), "token", "password", "key", "secret", "pwd"]) + rng.choice("=:") + secret()[0]]

    def number() -> list[str]:
        return [rng.choice([text("123456789", 1, 6), text("0123456789", 16, 16), "3.14", "10-20", "2024-05-01", "v2.0", "4x4", "b2b"])]

    def noise() -> list[str]:
        near = ["at", "dot", "token", "key", "call", "tel", "phone", "secret", "|", "=", "the", "1999", "2024", "2031"]
        return [rng.choice([*near, word(), number()[0]]) for _ in range(rng.randint(3, 9))] + ["und"]

    make = {"C": (contact, 0), "L": (phone, 1), "S": (secret, 2), "A": (assigned, 2)}
    table = []
    for i in range(rows):
        words, states = [], []
        for part in FORMS[i % len(FORMS)].split():
            slot = part[1] if part[0] == "{" else ""
            if slot in make:
                form, kind = make[slot]
                own = form()
                states += [1 + 2 * kind] + [2 + 2 * kind] * (len(own) - 1)
            else:
                if slot == "W":
                    own = [word() for _ in range(rng.randint(1, 7))]
                else:
                    own = number() if slot == "N" else noise() if slot == "R" else [part.replace("{K}", name())]
                states += [0] * len(own)
            words += own
        table.append((words, states))
    return table


@lru_cache(maxsize=1)
def trained() -> Crf:
    return Crf(ADDED_KINDS).fit(labelled_table())


def added_spans(text: str, words: list[str], states: np.ndarray) -> Iterator[Span]:
    """The spans of one text's words that are not outside; surrounding marks are left off."""
    at, i, n = 0, 0, len(words)
    wanted = np.flatnonzero(states)
    place: dict[int, tuple[int, int]] = {}
    marked = set(wanted.tolist())
    for j in range(int(wanted[-1]) + 1):
        start = text.find(words[j], at)
        at = start + len(words[j])
        if j in marked:
            place[j] = (start, at)
    while i < n:
        if not states[i]:
            i += 1
            continue
        kind, j = (states[i] - 1) // 2, i + 1
        while j < n and states[j] == 2 + 2 * kind:
            j += 1
        start, end = place[i][0], place[j - 1][1]
        named = ASSIGNED.match(words[i]) if kind == 2 else None
        first = words[i][named.end() :] if named and names_secret(named[1].lower()) else words[i]
        start += len(words[i]) - len(first.lstrip(_TRIM))
        end -= len(words[j - 1]) - len(words[j - 1].rstrip(_TRIM))
        if start < end:
            yield start, len(BASE_KINDS) + int(kind), end
        i = j


def _beside(base: list[Span], more: list[Span]) -> list[Span]:
    """The added spans that do not lie within one base span: those would tell nothing new."""
    out, at, reach = [], 0, 0
    for span in more:  # both are in the order of their starts
        while at < len(base) and base[at][0] <= span[0]:
            reach = max(reach, base[at][2])
            at += 1
        if span[2] > reach:
            out.append(span)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _finder(crf: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, potentials = Classes(), np.zeros((3, 0, crf.states))
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, len(whole), 512)):
                texts = [x or "" for x in batch.column(1).to_pylist()]
                words = [t.split() for t in texts]
                ids = np.concatenate([classes.ids(w) for w in words]) if words else np.zeros(0, np.int32)
                if potentials.shape[1] != len(classes.of_features):
                    potentials = crf.potentials(classes)
                lengths = [len(w) for w in words]
                states = crf.decode(ids, lengths, potentials)
                ends = np.cumsum([0, *lengths])
                counts, base_out, all_out = [], [], []
                for i, text in enumerate(texts):
                    base = base_spans(text)
                    own = states[ends[i] : ends[i + 1]]
                    more = list(added_spans(text, words[i], own)) if own.any() else []
                    more = _beside(base, more)
                    counts.append(np.bincount([k for _, k, _ in base], minlength=4)[:4])
                    base_out.append(hashlib.sha256(written(base).encode()).hexdigest())
                    all_out.append(written(sorted(base + more)))
                n = np.array(counts, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(n[:, k]) for k in range(4)), pa.array(base_out, pa.string()), pa.array(all_out, pa.string())],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of the pattern spans; ``spans`` lists these and all added
    ones that do not lie within one of them, as ``kind:start:end`` in code points, by start and
    then kind; spans may overlap.  Null texts count as empty and have no spans; texts and words
    of any length are read whole.  Repeated rows come back repeated, null ids stay null, an
    empty table gives an empty result, and other columns are not looked at.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _finder(trained()),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )


def redact(text: str, spans: str) -> str:
    """``text`` with every listed span replaced by its kind in brackets; of overlapping ones the first kind names all."""
    out, at = [], 0
    for entry in filter(None, spans.split(",")):
        kind, start, end = entry.split(":")
        start, end = int(start), int(end)
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
