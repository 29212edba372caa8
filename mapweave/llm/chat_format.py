"""Roles of transcript lines by a hidden Markov model, and canonical rendering of the turns.

A transcript is a sequence of lines.  Hidden states are a role and whether the line begins a turn; a line shows its speaker marker
("User:", "### Assistant", "<|system|>", ...), whether a block begins (a gap or a new row before it), its length class and whether it is the
transcript's first.  Probabilities are counts from training conversations plus fixed pseudo counts; Viterbi gives the
likeliest states, and turns are rendered as ``<|role|>`` lines followed by the text without markers and ``<|end|>``.

A conversation may be of any length: it is cut into chunks by turn number.  Tasks reduce a chunk to a table of the best score from each
state before it to each state at its end; a conversation's tables, in order, give the states at all cuts; tasks then
decode their chunks between those.  This finds the same path as one run over the whole conversation would.

Defined cases: a null or empty text is one empty line; a row whose conv_id is null is a conversation of its own; a null turn
comes first; rows that repeat all of conv_id, turn and text are read once and share the result; rows with one turn
number follow each other in order of text; roles other than ROLES teach nothing; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import remainder, stored

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role * 2 + (0 begins a turn, 1 goes on)
LENGTHS = 12
CHUNK = 512

#: Names that transcripts give to the roles.
SPEAKERS = {"system": "system", "instructions": "system", "context": "system", "user": "user", "human": "user", "question": "user", "q": "user", "customer": "user", "prompter": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant", "agent": "assistant", "gpt": "assistant"}
_NAMES = "|".join(SPEAKERS)
_MARKER = re.compile(rf"\s*(?:<\|(?:im_start\|>)?\s*({_NAMES})\s*(?:\|>)?|\[({_NAMES})\]:?|\*\*({_NAMES}):?\*\*:?|#+\s*({_NAMES})\s*:?(?=\s|$)|({_NAMES})\s*:)\s*", re.IGNORECASE)
_END = re.compile(r"\s*<\|(?:im_end|end|endofturn)\|>\s*$")

_SAME, _OTHER, _NONE = 40.0, 0.05, 5.0  # pseudo counts of a marker: of the line's own role, of another role, of none


def marker(line: str) -> tuple[int, str]:
    """The role number a line's marker names (-1 for none), and the line without it."""
    found = _MARKER.match(line)
    if not found:
        return -1, line
    return ROLES.index(SPEAKERS[next(g for g in found.groups() if g).lower()]), line[found.end():]


def observed(blocks: list[str], first: bool) -> tuple[np.ndarray, list[int], list[str]]:
    """Per line (marker + 1, block begins, length class, transcript begins), the lines of each block, and bare lines."""
    rows, counts, bare = [], [], []
    for text in blocks:
        lines = (text or "").split("\n")
        gap = True
        n = 0
        for k, line in enumerate(lines):
            if not line.strip() and len(lines) > 1:
                gap = True
                if k < len(lines) - 1 or n:
                    continue
            role, rest = marker(line)
            rest = _END.sub("", rest)
            rows.append((role + 1, int(gap), min(LENGTHS - 1, len(rest).bit_length()), int(first and not rows)))
            bare.append(rest)
            gap = False
            n += 1
        counts.append(n)
    return np.array(rows, np.int64).reshape(-1, 4), counts, bare


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    shown: list[np.ndarray]  # per observation: log probability by state and value

    def emission(self, rows: np.ndarray) -> np.ndarray:
        return sum((table[:, rows[:, k]].T for k, table in enumerate(self.shown)), np.zeros((len(rows), STATES)))


def _log(counts: np.ndarray, extra: np.ndarray | float) -> np.ndarray:
    p = counts + extra
    return np.log(p / p.sum(-1, keepdims=True))


def model(counts: dict[tuple[int, int, int], int]) -> Model:
    """From counts by (table, state, value); tables 0-3 are the observations, 4 the steps between states, 5 the starts."""
    shown = [np.zeros((STATES, n)) for n in (len(ROLES) + 1, 2, LENGTHS, 2)]
    step, start = np.zeros((STATES, STATES)), np.zeros(STATES)
    for (table, state, value), n in counts.items():
        if table < 4:
            shown[table][state, value] += n
        elif table == 4:
            step[state, value] += n
        else:
            start[state] += n
    prior = np.full((STATES, len(ROLES) + 1), _OTHER)
    prior[:, 0] = _NONE
    for r in range(len(ROLES)):
        prior[2 * r, r + 1] = _SAME
        prior[2 * r + 1, 1:] = _OTHER / 100
    # A line that goes on a turn follows its own role; a turn's first line may follow any.
    allowed = np.array([[b % 2 == 0 or a // 2 == b // 2 for b in range(STATES)] for a in range(STATES)])
    moves = np.where(allowed, np.log((step + 0.5) / (step + 0.5).sum(1, keepdims=True)), -np.inf)
    begins = np.where(np.arange(STATES) % 2 == 0, _log(start, 0.5), -np.inf)
    return Model(begins, moves, [_log(shown[0], prior), *(_log(x, 0.5) for x in shown[1:])])


def transfer(emission: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best score from each state before the lines to each state at the last of them."""
    best = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
    for e in emission:
        best = (best[:, :, None] + step[None]).max(1) + e
    return best


def viterbi(emission: np.ndarray, step: np.ndarray, before: np.ndarray, end: int | None = None) -> list[int]:
    """States of the lines; ``before`` scores the first line's states without its own emission; ``end`` is the last line's state if it is known."""
    if len(emission) == 0:
        return []
    score, back = before + emission[0], []
    for e in emission[1:]:
        all_ = score[:, None] + step
        back.append(all_.argmax(0))
        score = all_.max(0) + e
    path = [int(score.argmax()) if end is None else end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def parse(text: str, m: Model) -> list[tuple[str, str]]:
    """(role, text) of the turns of one raw transcript."""
    rows, _, bare = observed([text], True)
    turns: list[tuple[str, list[str]]] = []
    for state, line in zip(viterbi(m.emission(rows), m.step, m.start), bare):
        if state % 2 == 0 or not turns:
            turns.append((ROLES[state // 2], []))
        turns[-1][1].append(line)
    return [(role, "\n".join(lines).strip()) for role, lines in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"<|{role}|>\n{text}\n<|end|>" for role, text in turns)


def _blocks(table: pa.Table) -> tuple[pa.Table, list[str]]:
    table = table.sort_by([("turn", "ascending"), ("text", "ascending"), ("key", "ascending")])
    turn = table.column("turn")
    if turn.null_count:  # null turns come first
        table = pa.concat_tables([table.filter(turn.is_null()), table.filter(turn.is_valid())])
    return table, table.column("text").to_pylist()


def _counted(table: pa.Table) -> pa.Table:
    """Counts of one chunk's supervised lines and steps; the step into a chunk is counted from its ``before`` role."""
    table, blocks = _blocks(table)
    rows, counts, _ = observed(blocks, table.column("chunk")[0].as_py() == 0)
    roles = [ROLES.index(r) if r in ROLES else -1 for r in table.column("role").to_pylist()]
    states = [2 * r + (k > 0) if r >= 0 else -1 for r, n in zip(roles, counts) for k in range(n)]
    found: dict[tuple[int, int, int], int] = {}

    def add(*key: int) -> None:
        found[key] = found.get(key, 0) + 1

    for i, s in enumerate(states):
        if s < 0:
            continue
        for k in range(4):
            add(k, s, int(rows[i, k]))
        if i == 0 and rows[0, 3]:
            add(5, s, 0)
        elif i and states[i - 1] >= 0:
            add(4, states[i - 1], s)
    return pa.table({"of": pa.array([k[0] for k in found], pa.int32()), "state": pa.array([k[1] for k in found], pa.int32()), "value": pa.array([k[2] for k in found], pa.int32()), "n": pa.array(list(found.values()), pa.int64())})


def prepared(conversations: DataFrame) -> DataFrame:
    """Distinct rows with a conversation key, a row key and a chunk number."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("key", F.xxhash64("conv_id", "turn", "text"))
    chunk = F.floor(F.coalesce(F.col("turn"), F.lit(0)) / CHUNK)
    one = keyed.groupBy("key").agg(*(F.min(c).alias(c) for c in ("conv_id", "turn", "role", "text")))
    return one.select("*", F.coalesce(F.col("conv_id"), F.col("key")).alias("conv"), F.col("conv_id").isNull().alias("single"), chunk.alias("chunk"))


def learn(rows: DataFrame) -> Model:
    """From rows as of prepared(); the driver gets the counts by table, state and value."""
    first = rows.groupBy("conv", "single").agg(F.min("chunk").alias("c0"))
    placed = rows.join(first, ["conv", "single"]).withColumn("chunk", F.col("chunk") - F.col("c0"))
    counts = placed.groupBy("conv", "single", "chunk").applyInArrow(lambda table: _counted(table), "of int, state int, value int, n long")
    return model({(r["of"], r["state"], r["value"]): r["n"] for r in counts.groupBy("of", "state", "value").agg(F.sum("n").alias("n")).collect()})


def _tables(table: pa.Table, m: Model) -> pa.Table:
    head = table.slice(0, 1).select(["conv", "single", "chunk"])
    table, blocks = _blocks(table)
    e = m.emission(observed(blocks, table.column("chunk")[0].as_py() == table.column("c0")[0].as_py())[0])
    begins = table.column("chunk")[0].as_py() == table.column("c0")[0].as_py()
    if begins:  # the states before are none; every row holds the scores from the start
        best = transfer(e[1:], m.step)
        t = np.repeat((m.start + e[0])[:, None], STATES, 1) + best
        t = np.repeat(t.max(0)[None], STATES, 0)
    else:
        t = transfer(e, m.step)
    return head.append_column("t", pa.array([t.ravel().tolist()], pa.list_(pa.float64())))


def _ends(table: pa.Table) -> pa.Table:
    """State at the end of each chunk of one conversation, and at the end of the chunk before."""
    table = table.sort_by("chunk")
    t = np.array(table.column("t").to_pylist()).reshape(-1, STATES, STATES)
    score, back = t[0].max(0), []
    for x in t[1:]:
        all_ = score[:, None] + x
        back.append(all_.argmax(0))
        score = all_.max(0)
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path = path[::-1]
    return table.select(["conv", "single", "chunk"]).append_column("before", pa.array([-1, *path[:-1]], pa.int32())).append_column("end", pa.array(path, pa.int32()))


def _decoded(table: pa.Table, m: Model) -> pa.Table:
    table, blocks = _blocks(table)
    before, end = table.column("before")[0].as_py(), table.column("end")[0].as_py()
    rows, counts, bare = observed(blocks, before < 0)
    path = viterbi(m.emission(rows), m.step, m.start if before < 0 else m.step[before], end)
    role, turns, text, at = [], [], [], 0
    for n in counts:
        parts: list[tuple[str, list[str]]] = []
        for state, line in zip(path[at : at + n], bare[at : at + n]):
            if state % 2 == 0 or not parts:
                parts.append((ROLES[state // 2], []))
            parts[-1][1].append(line)
        role.append(parts[0][0])
        turns.append(len(parts))
        text.append(render([(r, "\n".join(x).strip()) for r, x in parts]))
        at += n
    return pa.table({"key": table.column("key"), "role_pred": role, "n_turns": pa.array(turns, pa.int32()), "rendered": text})


def format_conversations(conversations: DataFrame) -> DataFrame:
    """A row per row of conversations (conv_id, turn, role, text): conv_id, turn, held_out, role_pred (of its first line), n_turns found
    in it, rendered.  Roles are learned where crc32(conv_id) mod 5 is not 0, and not used otherwise."""
    rows = stored(prepared(conversations), "turns")
    m = learn(rows.where((remainder("conv_id", 5) != 0) & F.col("role").isin(*ROLES)))
    first = rows.groupBy("conv", "single").agg(F.min("chunk").alias("c0"))
    placed = rows.join(first, ["conv", "single"])
    by = ("conv", "single", "chunk")
    kind = "conv long, single boolean, chunk long"
    tables = placed.select(*by, "c0", "turn", "text", "key").groupBy(*by).applyInArrow(lambda table: _tables(table, m), f"{kind}, t array<double>")
    ends = tables.groupBy("conv", "single").applyInArrow(lambda table: _ends(table), f"{kind}, before int, end int")
    found = rows.select(*by, "turn", "text", "key").join(ends, list(by)).groupBy(*by).applyInArrow(lambda table: _decoded(table, m), "key long, role_pred string, n_turns int, rendered string")
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("text").cast("string")).alias("key"))
    return given.join(found, "key").select("conv_id", "turn", (remainder("conv_id", 5) == 0).alias("held_out"), "role_pred", "n_turns", "rendered")
