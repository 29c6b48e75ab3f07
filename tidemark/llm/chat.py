"""Chat formatting: roles of a raw transcript by a hidden Markov model, then canonical turns.

A state is a role together with whether the line opens a turn or goes on with one.  Each
line shows a marker (a known speaker word, an unknown name, or none) and whether it asks a
question.  The model's probabilities are counted over turns of known roles, on top of the
prior counts below; without such turns the prior alone holds.  Viterbi gives the most likely
states of all lines together, so a missing or unfamiliar marker is read from the turns around
it.  Turns are then rendered in one form.

Long conversations are read in segments and decoded as wholes: every segment gives the best
score between each pair of its first and last states, one stream a conversation carries the
scores forward over these, another the best states back, and each segment is then decoded
between the scores before it and its last state.  Log-probabilities are multiples of 2**-20,
so sums are exact in any order and the states, ties included, are those of the uncut text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import stash

ROLES = ("system", "user", "assistant")

# Speaker words of transcript formats.
SPEAKERS = {
    "system": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "q": "user", "question": "user", "instruction": "user", "customer": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "answer": "assistant",
    "response": "assistant", "model": "assistant", "agent": "assistant",
}

_WORDS = "|".join(sorted(SPEAKERS, key=len, reverse=True))
_KNOWN = re.compile(
    rf"\s*(?:(?:\#{{1,6}}\s*|\*\*)?({_WORDS})(?:\*\*)?\s*:(?:\*\*)?|\#{{1,6}}\s*({_WORDS})\s*$|\[({_WORDS})\]|<\|?({_WORDS})\|?>)\s*",
    re.IGNORECASE,
)
_NAMED = re.compile(r"\s*([^\W\d_a-z][\w.'-]{0,23}):(?:\s+|$)")

# The prior: counts of a marker in a state, columns: system, user, assistant, a name, none.
_OPENS = 0.9 * np.eye(3) + 0.002
_MARKER_OPEN = np.column_stack([_OPENS * [[0.9], [0.75], [0.75]], [0.03, 0.2, 0.2], [0.07, 0.05, 0.05]])
_MARKER_ON = np.array([[0.001, 0.001, 0.001, 0.01, 0.987]] * 3)
# of lines that end in a question mark, by role
_ASKS = np.array([0.02, 0.3, 0.1])
# of the next turn's role by role, of the first turn's role, of lines that go on with a turn
_NEXT = np.array([[0.01, 0.94, 0.05], [0.01, 0.02, 0.97], [0.01, 0.97, 0.02]])
_FIRST = np.array([0.3, 0.65, 0.05])
_GOES_ON = 0.6
#: How many observations of each distribution the prior stands for.
PRIOR = 20.0


def _log(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.round(np.log(p) * 2**20) / 2**20


@dataclass(frozen=True)
class Hmm:
    """Log first, log moves, log markers, log asks and asks not; states 0..2 open a turn of a role, 3..5 go on with it."""

    first: np.ndarray
    moves: np.ndarray
    markers: np.ndarray
    ask: np.ndarray
    ask_not: np.ndarray

    @classmethod
    def of_counts(cls, first: np.ndarray, following: np.ndarray, lines: np.ndarray) -> Hmm:
        """From counts: roles of first turns, (role, next role), and (state, marker, asks) of lines."""
        share = lambda prior, n: (PRIOR * prior + n) / (PRIOR * prior + n).sum(axis=-1, keepdims=True)
        marker = np.vstack([_MARKER_OPEN, _MARKER_ON])
        marker = share(marker / marker.sum(axis=1, keepdims=True), lines.sum(axis=2))
        ask = share(np.stack([1 - _ASKS, _ASKS], axis=1), lines.sum(axis=1).reshape(2, 3, 2).sum(axis=0))
        by_state = lines.sum(axis=(1, 2))
        on = share(np.array([[1 - _GOES_ON, _GOES_ON]] * 3), np.stack([by_state[:3], by_state[3:]], axis=1))[:, 1]
        follows = share(_NEXT, following)
        move = np.zeros((6, 6))
        for r in range(3):
            for state in (r, r + 3):
                move[state, :3] = (1 - on[r]) * follows[r]
                move[state, r + 3] = on[r]
        start = np.concatenate([share(_FIRST, first), np.zeros(3)])
        return cls(_log(start), _log(move), _log(marker), np.tile(_log(ask[:, 1]), 2), np.tile(_log(ask[:, 0]), 2))


UNTRAINED = Hmm.of_counts(np.zeros(3), np.zeros((3, 3)), np.zeros((6, 5, 2)))


def read_line(line: str) -> tuple[int, int, bool]:
    """(marker, its length, asks): marker 0..2 a known role, 3 a name, 4 none."""
    asks = line.rstrip().endswith("?")
    known = _KNOWN.match(line)
    if known:
        word = next(filter(None, known.groups())).lower()
        return ROLES.index(SPEAKERS[word]), known.end(), asks
    named = _NAMED.match(line)
    return (3, named.end(), asks) if named else (4, 0, asks)


def emissions(lines: list[tuple[int, int, bool]], hmm: Hmm = UNTRAINED) -> np.ndarray:
    """Log-likelihood of each line in each state."""
    marker = hmm.markers[:, [m for m, _, _ in lines]].T
    ask = np.array([a for _, _, a in lines])[:, None]
    return marker + np.where(ask, hmm.ask, hmm.ask_not)


def _forward(e: np.ndarray, hmm: Hmm, before: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The last line's scores, and for each line the best state before each of its own.

    ``before`` are the scores of a line before the first; without them a conversation begins.
    """
    if before is None:
        score, back, rest = hmm.first + e[0], [], e[1:]
    else:
        score, back, rest = before, [], e
    for row in rest:
        both = score[:, None] + hmm.moves
        back.append(both.argmax(axis=0))
        score = both.max(axis=0) + row
    return score, back


def _back(back: list[np.ndarray], last: int) -> np.ndarray:
    path = [last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def viterbi(e: np.ndarray, hmm: Hmm = UNTRAINED) -> np.ndarray:
    """The most likely states of a sequence of emissions."""
    score, back = _forward(e, hmm)
    return _back(back, int(score.argmax()))


def _between(e: np.ndarray, hmm: Hmm) -> np.ndarray:
    """The best score of a sequence by its first and its last state."""
    score = np.where(np.eye(6, dtype=bool), e[0], -np.inf)
    for row in e[1:]:
        score = (score[:, :, None] + hmm.moves).max(axis=1) + row
    return score


def parse_transcript(text: str | None, hmm: Hmm = UNTRAINED) -> list[tuple[str, str]]:
    """The turns (role, text) of a transcript.  Blank transcripts have none.

    White space around a turn's text is left off.  A line of a turn that reads like a known
    speaker's marker (``A: ...``) may be taken for one: nothing in the text tells them apart.
    """
    lines = (text or "").split("\n")
    if not any(line.strip() for line in lines):
        return []
    read = [read_line(line) for line in lines]
    return _turns(lines, read, viterbi(emissions(read, hmm), hmm))


def _turns(lines: list[str], read: list[tuple[int, int, bool]], states: np.ndarray, tail: str | None = None) -> list[tuple[str, str]]:
    """The turns of lines, the first of which opens one; ``tail`` goes on with the last."""
    turns: list[tuple[str, list[str]]] = []
    for line, (_, cut, _), state in zip(lines, read, states, strict=True):
        if state < 3:
            turns.append((ROLES[state], [line[cut:]]))
        else:
            turns[-1][1].append(line)
    if tail is not None:
        turns[-1][1].append(tail)
    return [(role, "\n".join(own).strip()) for role, own in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form: each turn between ``<|im_start|>role`` and ``<|im_end|>``.

    Where a text has such a mark itself, a backslash goes before its last bar, and one more
    before those already there, so a text can never open or close a turn; :func:`unescaped`
    undoes it.
    """
    return "".join(f"<|im_start|>{role}\n{_MARK.sub(_escaped, text)}<|im_end|>\n" for role, text in turns)


_MARK = re.compile(r"<\|im_(start|end)(\\*)\|>")


def _escaped(m: re.Match) -> str:
    return f"<|im_{m[1]}{m[2]}\\|>"


def unescaped(text: str) -> str:
    """The text of a turn as it was before :func:`render`."""
    return re.sub(r"<\|im_(start|end)(\\*)\\\|>", r"<|im_\1\2|>", text)


def format_transcripts(transcripts: DataFrame, id_cols: list[str], text_col: str = "transcript", hmm: Hmm = UNTRAINED) -> DataFrame:
    """One row per transcript: the id columns, n_turns, roles, turns, rendered.

    Null, empty and blank transcripts have no turns and render as the empty string; texts of
    any length are read whole.  Repeated rows come back repeated, null ids stay null, an empty
    table gives an empty result, and other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _formatted(batch, id_cols, [parse_transcript(t, hmm) for t in batch.column(len(id_cols)).to_pylist()])

    own = transcripts.select(*id_cols, text_col)
    return own.mapInArrow(run, f"{_declared(own, id_cols)}, {_FORMATTED}")


_FORMATTED = "n_turns long, roles array<string>, turns array<string>, rendered string"


def _declared(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def _formatted(batch: pa.RecordBatch, id_cols: list[str], parsed: list[list[tuple[str, str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            *(batch.column(i) for i in range(len(id_cols))),
            pa.array([len(p) for p in parsed], pa.int64()),
            pa.array([[r for r, _ in p] for p in parsed], pa.list_(pa.string())),
            pa.array([[t for _, t in p] for p in parsed], pa.list_(pa.string())),
            pa.array([render(p) for p in parsed], pa.string()),
        ],
        names=[*id_cols, "n_turns", "roles", "turns", "rendered"],
    )


#: Marker styles of raw transcripts: what precedes a turn of each role.  The last has names only.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Instructions\n", "user": "### Human\n", "assistant": "### AI\n"},
    {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] "},
    {"system": "Context: ", "user": "Q: ", "assistant": "A: "},
    {"system": "System: ", "user": "Alice: ", "assistant": "Robin: "},
)


def _raw_turns(turns: DataFrame, *more: Column) -> DataFrame:
    """Each distinct turn behind its marker: conv_id, turn, role, raw, and more columns."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    marker = F.lit("")
    for i, markers in enumerate(STYLES):
        for role, shown in markers.items():
            marker = F.when((style == i) & (F.col("role") == role), shown).otherwise(marker)
    raw = F.concat(marker, F.coalesce("text", F.lit(""))).alias("raw")
    return turns.select("conv_id", *more, "turn", "role", raw).distinct()


def _line_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((6, 5, 2), np.int64)
    for batch in batches:
        for role, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i, line in enumerate(raw.split("\n")):
                marker, _, asks = read_line(line)
                counts[ROLES.index(role) + 3 * (i > 0), marker, int(asks)] += 1
    at = np.nonzero(counts)
    columns = [*(pa.array(a, pa.int64()) for a in at), pa.array(counts[at], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["state", "marker", "asks", "n"])


def train(turns: DataFrame) -> Hmm:
    """The model of conversations (conv_id, turn, role, text) as raw text, counted over all of their turns.

    Turns of unknown roles and such without a conversation or number are left out.  A turn
    follows the one of the number before; one without such a predecessor is a first turn.
    Counts are summed before they are shuffled; at most 72 numbers come to the driver.
    """
    known = _raw_turns(turns).where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    lines, first, following = np.zeros((6, 5, 2)), np.zeros(3), np.zeros((3, 3))
    counted = known.select("role", "raw").mapInArrow(_line_counts, "state long, marker long, asks long, n long")
    for r in counted.groupBy("state", "marker", "asks").agg(F.sum("n").alias("n")).collect():
        lines[r.state, r.marker, r.asks] = r.n
    roles = known.select("conv_id", "turn", "role").distinct()
    before = roles.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    for r in roles.join(before, ["conv_id", "turn"], "left").groupBy("before", "role").count().collect():
        if r.before is None:
            first[ROLES.index(r.role)] = r["count"]
        else:
            following[ROLES.index(r.before), ROLES.index(r.role)] = r["count"]
    return Hmm.of_counts(first, following, lines)


def raw_transcripts(turns: DataFrame, *, segment_turns: int = 64) -> DataFrame:
    """(conv_id, segment, transcript): conversations as raw text, in one of STYLES by conv_id.

    Columns read: conv_id, turn, role, text.  Conversations go in segments of
    ``segment_turns`` turn numbers, so no transcript grows without bound.  Repeated rows
    count once; rows of equal number are ordered by role and text.  A row without a
    conversation or number is a transcript of its own (segment null).  A null text is empty
    and a null or unknown role gets no marker.
    """
    segment = F.when(F.col("conv_id").isNotNull(), F.floor(F.col("turn") / segment_turns)).alias("segment")
    rows = _raw_turns(turns, segment)
    whole = (
        rows.where("segment is not null")
        .groupBy("conv_id", "segment")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "raw"))).alias("t"))
        .select("conv_id", "segment", F.array_join("t.raw", "\n").alias("transcript"))
    )
    return whole.unionByName(rows.where("segment is null").select("conv_id", "segment", F.col("raw").alias("transcript")))


_KEYS = ["conv_id", "segment"]


def _kept(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The keys of a batch beside new columns."""
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns.values()], names=[*_KEYS, *columns])


def _packed(lines: list[tuple[int, int, bool]]) -> bytes:
    return bytes(m + 8 * a for m, _, a in lines)


def _unpacked(codes: bytes, hmm: Hmm) -> np.ndarray:
    return emissions([(c & 7, 0, c >= 8) for c in codes], hmm)


def _scan(hmm: Hmm, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each segment: its lines as one byte each, best scores between its ends, whether it is blank."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        codes = [_packed([read_line(line) for line in t.split("\n")]) for t in texts]
        yield _kept(
            batch,
            codes=pa.array(codes, pa.binary()),
            between=pa.array([_between(_unpacked(c, hmm), hmm).ravel() for c in codes], pa.list_(pa.float64())),
            blank=pa.array([not t.strip() for t in texts], pa.bool_()),
        )


def _carry_forward(hmm: Hmm, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order: the scores before each (null at a conversation's start), and its best last state."""
    conv, score = None, None
    for batch in batches:
        before, last = [], []
        for own, between in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if own != conv:
                conv, score = own, None
            before.append(score)
            entry = hmm.first if score is None else (score[:, None] + hmm.moves).max(axis=0)
            score = (entry[:, None] + np.array(between).reshape(6, 6)).max(axis=0)
            last.append(int(score.argmax()))
            score = score - score.max()
        yield _kept(
            batch,
            codes=batch.column(2),
            blank=batch.column(4),
            before=pa.array(before, pa.list_(pa.float64())),
            last=pa.array(last, pa.int32()),
        )


def _exits(hmm: Hmm, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each last state of a segment: the state before the segment and how many lines go on from there."""
    for batch in batches:
        entries, leads, lines = [], [], []
        for codes, before in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
            _, back = _forward(_unpacked(codes, hmm), hmm, None if before is None else np.array(before))
            paths = [_back(back, s) for s in range(6)]
            own = paths if before is None else [p[1:] for p in paths]
            entries.append([int(p[0]) for p in paths])
            leads.append([0 if before is None else int(np.append(p < 3, True).argmax()) for p in own])
            lines.append(len(codes))
        yield _kept(
            batch,
            blank=batch.column(3),
            before=batch.column(4),
            last=batch.column(5),
            entries=pa.array(entries, pa.list_(pa.int32())),
            leads=pa.array(leads, pa.list_(pa.int32())),
            lines=pa.array(lines, pa.int64()),
        )


def _carry_back(types: list[pa.DataType]):
    """Segments in reverse order: each one's last state, and the segment whose last turn its first lines go on with."""
    names = [*_KEYS, "before", "last", "lead", "owner", "blank"]
    types = [*types, pa.list_(pa.float64()), pa.int32(), pa.int32(), types[1], pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, blank, waiting = None, None, True, []
        for batch in batches:
            out = []
            for own, segment, empty, before, last, entries, leads, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != conv:
                    conv, state, blank = own, last, True
                blank = blank and empty
                lead = leads[state]
                if lead < lines:  # a turn opens here
                    out += [(*row, segment, False) for row in waiting]
                    waiting.clear()
                row = (own, segment, before, state, lead)
                if lead:
                    waiting.append(row)
                else:
                    out.append((*row, None, blank and before is None))
                state = entries[state]
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _decode(hmm: Hmm, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parsed = []
        for text, before, last, lead, blank, tail in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            lines = text.split("\n")
            read = [read_line(line) for line in lines]
            if blank or lead == len(lines):
                parsed.append([])
                continue
            _, back = _forward(emissions(read, hmm), hmm, None if before is None else np.array(before))
            states = _back(back, last)[-len(lines) :]
            parsed.append(_turns(lines[lead:], read[lead:], states[lead:], tail))
        yield _formatted(batch, _KEYS, parsed)


def format_conversations(turns: DataFrame, *, segment_turns: int = 64, hmm: Hmm | None = None) -> DataFrame:
    """Rows of :func:`raw_transcripts` as by :func:`format_transcripts`, conversations decoded as wholes.

    One row per conversation and segment: conv_id, segment, n_turns, roles, turns, rendered.
    In the order of segments these make what the whole conversation gives as one transcript.
    A turn is in the segment where it opens; lines of later segments that go on with it
    move there.  Only conversations of several segments take more than the one pass.  Without
    ``hmm`` the model is trained on the same turns.  Nulls, repeated rows and ties are as in
    :func:`raw_transcripts`; an empty table gives an empty result.
    """
    hmm = train(turns) if hmm is None else hmm
    raw = raw_transcripts(turns, segment_turns=segment_turns)
    ends = turns.where("conv_id is not null").groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    several = F.floor(F.col("lo") / segment_turns) < F.floor(F.col("hi") / segment_turns)
    long = stash(ends.where(several).select("conv_id", F.lit(True).alias("long")), "long")
    if long.isEmpty():
        return format_transcripts(raw, _KEYS, hmm=hmm)
    tagged = stash(raw.join(long, "conv_id", "left"), "segments")
    whole = tagged.where("long and segment is not null").drop("long")
    keys = _declared(whole, _KEYS)
    scanned = whole.select(*_KEYS, "transcript").mapInArrow(
        partial(_scan, hmm), f"{keys}, codes binary, between array<double>, blank boolean"
    )
    carried = scanned.repartition("conv_id").sortWithinPartitions(*_KEYS).mapInArrow(
        partial(_carry_forward, hmm), f"{keys}, codes binary, blank boolean, before array<double>, last int"
    )
    exits = carried.repartition(*_KEYS).mapInArrow(
        partial(_exits, hmm), f"{keys}, blank boolean, before array<double>, last int, entries array<int>, leads array<int>, lines long"
    )
    segment = whole.schema["segment"].dataType.simpleString()
    found = stash(
        exits.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.desc("segment"))
        .mapInArrow(
            _carry_back([to_arrow_type(whole.schema[c].dataType) for c in _KEYS]),
            f"{keys}, before array<double>, last int, lead int, owner {segment}, blank boolean",
        ),
        "states",
    )
    leads = (
        whole.join(found.where("owner is not null"), _KEYS)
        .select(
            "conv_id",
            F.col("owner").alias("segment"),
            F.struct("segment", F.array_join(F.slice(F.split("transcript", "\n"), 1, F.col("lead")), "\n").alias("text")).alias("part"),
        )
        .groupBy(*_KEYS)
        .agg(F.sort_array(F.collect_list("part")).alias("parts"))
        .select(*_KEYS, F.array_join("parts.text", "\n").alias("tail"))
    )
    decoded = (
        whole.join(found, _KEYS)
        .join(leads, _KEYS, "left")
        .select(*_KEYS, "transcript", "before", "last", "lead", "blank", "tail")
        .mapInArrow(partial(_decode, hmm), f"{keys}, {_FORMATTED}")
    )
    alone = tagged.where("long is null or segment is null")
    return format_transcripts(alone, _KEYS, hmm=hmm).unionByName(decoded)
