"""Transcript parsing by a hidden Markov model, and canonical chat turns.

Every line of a conversation is in one of six states: the first line or a later line of a
system, user or assistant turn.  Speaker labels, speaker markers and line features are what
the states emit; the most likely sequence (Viterbi) gives the roles.  A conversation is cut
into blocks; each block is solved for every pair of states it can begin after and end in, and
a second pass over the blocks' scores picks the pairs, so a conversation with a third of all
rows is many bounded tasks and the result does not depend on the cuts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import cut_lineage

ROLES = ("system", "user", "assistant")
N = 2 * len(ROLES)  # state 2 * role is a turn's first line, 2 * role + 1 a later line
WORDS = {
    "system": 0, "sys": 0, "instruction": 0, "instructions": 0, "developer": 0, "user": 1, "human": 1, "prompter": 1, "question": 1, "q": 1, "customer": 1, "client": 1, "me": 1,
    "assistant": 2, "ai": 2, "bot": 2, "chatbot": 2, "model": 2, "gpt": 2, "answer": 2, "a": 2, "agent": 2, "support": 2,
}
MARKER = re.compile(r"^\s*(?:[#>*_\[(<|-]{0,4}\s*)(" + "|".join(sorted(WORDS, key=len, reverse=True)) + r")\s*(?:[*_\])|>]{0,4}\s*)(?::|>|\|>|(?<=[\])>])\s*$)[*_]{0,2}\s*", re.I)
LISTED = re.compile(r"^\s*(?:[-*•]\s|\d{1,3}[.)]\s|```|\|)")
TOLD = re.compile(r"^\s*(?:you are|you must|your task|act as|always|never|respond)\b", re.I)

# Parameters of the model, as probabilities by role (system, user, assistant).
START = (0.25, 0.70, 0.05)
NEXT = ((0.02, 0.93, 0.05), (0.01, 0.09, 0.90), (0.01, 0.90, 0.09))
GO_ON = 0.6  # a further line of the same turn
MARKED = {"first": (0.30, 0.02), "later": (0.01, 0.005)}  # (own marker, each other role's)
LABELLED = (0.96, 0.02)  # (own label, each other role's) on the first line of a labelled row
ROW_START = {"first": 0.95, "later": 0.10}  # a line that starts a row
LABEL_SHOWN = {"first": 0.90, "later": 0.05}  # a known label on a line
FEATURES = ((lambda x: x.rstrip().endswith("?"), (0.05, 0.30, 0.10)), (lambda x: len(x) > 200, (0.20, 0.20, 0.40)), (lambda x: bool(LISTED.match(x)), (0.10, 0.08, 0.30)), (lambda x: bool(TOLD.match(x)), (0.30, 0.04, 0.03)))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    start = np.full(N, -np.inf)
    start[0::2] = np.log(START)
    move = np.full((N, N), -np.inf)
    for a in range(3):
        for of in (2 * a, 2 * a + 1):
            move[of, 2 * a + 1] = np.log(GO_ON)
            move[of, 0::2] = np.log(1 - GO_ON) + np.log(NEXT[a])
    return start, move


LOG_START, LOG_MOVE = _tables()


def emission(line: str, marker: int | None, row_start: bool, label: int | None) -> np.ndarray:
    """Log probability of a line's features in each state."""
    out = np.zeros(N)
    for kind, offset in (("first", 0), ("later", 1)):
        own, other = MARKED[kind]
        for r in range(3):
            s = 2 * r + offset
            out[s] += np.log((own if marker == r else other) if marker is not None else 1 - own - 2 * other)
            at = ROW_START[kind]
            out[s] += np.log(at if row_start else 1 - at)
            if label is not None:
                out[s] += np.log(LABEL_SHOWN[kind]) + np.log(LABELLED[0] if label == r else LABELLED[1])
            for holds, chances in FEATURES:
                out[s] += np.log(chances[r] if holds(line) else 1 - chances[r])
    return out


def read_line(line: str) -> tuple[str, int | None]:
    """(the line without its speaker marker, the marker's role)."""
    m = MARKER.match(line)
    return (line[m.end() :], WORDS[m[1].lower()]) if m else (line, None)


def label_of(role: str | None) -> int | None:
    return WORDS.get((role or "").strip().lower())


def row_lines(role: str | None, text: str | None) -> list[tuple[str, np.ndarray]]:
    """(line as it stands, emission) of one row's lines.

    In a row whose label names a speaker a control mark of another role is no marker: what
    a user types cannot begin an assistant's turn.
    """
    out, label = [], label_of(role)
    for k, raw in enumerate((text or "").split("\n")):
        line, marker = read_line(raw)
        if label is not None and marker != label and raw.lstrip().startswith("<|"):
            line, marker = raw, None
        out.append((raw, emission(line, marker, k == 0, label if k == 0 else None)))
    return out


def solve(emissions: list[np.ndarray], first: bool) -> list[tuple[int, int, float, str]]:
    """(state before, last state, log probability, states) of the best paths of a block.

    The first block of a conversation has state -1 before it.
    """
    entries = [-1] if first else list(range(N))
    best = np.stack([(LOG_START if e < 0 else LOG_MOVE[e]) + emissions[0] for e in entries])
    back = []
    for e in emissions[1:]:
        through = best[:, :, None] + LOG_MOVE[None]
        back.append(through.argmax(axis=1))
        best = through.max(axis=1) + e
    out = []
    for i, entry in enumerate(entries):
        for last in range(N):
            if np.isfinite(best[i, last]):
                path = [last]
                for b in reversed(back):
                    path.append(int(b[i, path[-1]]))
                out.append((entry, last, float(best[i, last]), "".join(map(str, reversed(path)))))
    return out


BLOCK = "conv string, block long, first boolean, lines array<string>, paths array<struct<before:int,last:int,score:double,states:string>>"
_PATH = pa.list_(pa.struct([("before", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("states", pa.string())]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, block, first, role, text) rows to solved blocks."""
    key: tuple | None = None
    rows: list[tuple[str, np.ndarray]] = []
    done: list[tuple] = []

    def end() -> None:
        if key is not None:
            paths = [{"before": b, "last": z, "score": s, "states": p} for b, z, s, p in solve([e for _, e in rows], key[2])]
            done.append((*key, [x for x, _ in rows], paths))

    def out() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) if done else [[]] * 5
        types = [pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string()), _PATH]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv", "block", "first", "lines", "paths"])
        done.clear()
        return batch

    for b in batches:
        for conv, block, first, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (conv, block, first) != key:
                end()
                key, rows = (conv, block, first), []
            rows.extend(row_lines(role, text))
        yield out()
    end()
    yield out()


def pick_paths(blocks: list[tuple[int, list[dict]]]) -> list[tuple[int, int, int]]:
    """(block, state before, last state) along the best sequence of a conversation's blocks."""
    best: dict[int, float] = {-1: 0.0}
    back: list[dict[int, int]] = []
    for _, paths in blocks:
        score: dict[int, float] = {}
        came: dict[int, int] = {}
        for p in paths:
            if p["before"] in best and best[p["before"]] + p["score"] > score.get(p["last"], -np.inf):
                score[p["last"]], came[p["last"]] = best[p["before"]] + p["score"], p["before"]
        best = score
        back.append(came)
    last = max(sorted(best), key=lambda s: best[s])
    out = []
    for (block, _), came in zip(reversed(blocks), reversed(back), strict=True):
        out.append((block, came[last], last))
        last = came[last]
    return out[::-1]


def _pick(t: pa.Table) -> pa.Table:
    rows = sorted(zip(t.column("block").to_pylist(), t.column("paths").to_pylist(), strict=True), key=lambda r: r[0])
    picked = pick_paths(rows)
    cols = list(zip(*picked, strict=True))
    return pa.table({"conv": pa.array([t.column("conv")[0].as_py()] * len(picked), pa.string()), "block": pa.array(cols[0], pa.int64()), "before": pa.array(cols[1], pa.int32()), "last": pa.array(cols[2], pa.int32())})


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, block, lines, states, begun) to a row for each turn or part of one in the block."""
    for b in batches:
        out: list[list] = [[] for _ in range(6)]
        for conv, block, lines, states, begun in zip(*(c.to_pylist() for c in b.columns), strict=True):
            turn, part, first = begun - 1, [], 0
            for k, (line, state) in enumerate(zip(lines, states, strict=True)):
                if state in "024":
                    if part:
                        for c, v in zip(out, (conv, block, turn, ROLES[int(states[first]) // 2], "\n".join(part), len(part)), strict=True):
                            c.append(v)
                    turn, part, first = turn + 1, [], k
                    bare, marker = read_line(line)
                    line = bare if marker == int(state) // 2 else line
                part.append(line)
            for c, v in zip(out, (conv, block, turn, ROLES[int(states[first]) // 2], "\n".join(part), len(part)), strict=True):
                c.append(v)
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["conv", "block", "turn", "role", "part", "n_lines"])


def rendered(role: Column, text: Column) -> Column:
    """The canonical form of a turn.

    The text holds no control mark: every "<|" gets a backslash inside, and those that have
    one get one more, so ``plain`` finds the text again.
    """
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|"), F.lit("\n<|end|>"))


def plain(whole: str) -> list[tuple[str, str]]:
    """(role, text) of rendered turns that follow each other."""
    turns = re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>", whole, re.S)
    return [(role, re.sub(r"<(\\*)\\\|", r"<\1|", text)) for role, text in turns]


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = "role", block_turns: int = 512) -> DataFrame:
    """(conv_id, turn, role, text, n_lines, rendered): canonical turns, numbered from 0.

    Rows of a conversation in order of (turn, role, text), nulls first; ``role_col`` is a
    speaker label the model may overrule (None: there is none; unknown labels say nothing).
    Markers such as "User:" are taken off the first line of a turn of their role and stay
    anywhere else.  Each row with a null
    conversation id is a conversation of its own; a null or empty text is one empty line;
    equal rows are turns of their own; every row's lines are in exactly one turn; an empty
    table gives no rows.  Blocks hold the turns of ``block_turns`` consecutive numbers.
    Control marks in a text are escaped in ``rendered``.
    """
    conv = F.coalesce(F.concat(F.lit("c"), F.col(id_col).cast("string")), F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string")))
    role = F.col(role_col).cast("string") if role_col else F.lit(None).cast("string")
    block = F.coalesce(F.floor(F.col(turn_col) / block_turns), F.lit(-(1 << 62))).cast("long")
    taken = rows.select(conv.alias("conv"), block.alias("block"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.col(text_col).alias("text"))
    firsts = taken.where(F.col("conv").startswith("c")).groupBy("conv").agg(F.min("block").alias("first_block"))
    first = F.coalesce(F.col("block") == F.col("first_block"), F.lit(True))  # rows without an id have one block
    dealt = taken.join(firsts, "conv", "left").select("conv", "block", first.alias("first"), "role", "text", "turn")
    ordered = dealt.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "role", "text").drop("turn")
    solved, _ = cut_lineage(ordered.mapInArrow(_blocks, BLOCK))

    many = solved.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")

    def pick(t: pa.Table) -> pa.Table:
        return _pick(t)

    chosen = solved.join(many, "conv", "left_semi").select("conv", "block", F.transform("paths", lambda p: F.struct(p["before"].alias("before"), p["last"].alias("last"), p["score"].alias("score"))).alias("paths"))
    chosen = chosen.groupBy("conv").applyInArrow(pick, "conv string, block long, before int, last int")
    alone = F.array_max(F.transform("paths", lambda p: F.struct(p["score"], -p["last"], p["states"].alias("states"))))["states"]
    along = F.get(F.filter("paths", lambda p: (p["before"] == F.col("before")) & (p["last"] == F.col("last"))), F.lit(0))["states"]
    states = solved.select("conv", "block", "paths").join(chosen, ["conv", "block"], "left").select("conv", "block", F.coalesce(along, alone).alias("states"))
    begins = F.length(F.translate("states", "135", ""))
    before = F.coalesce(F.sum(begins).over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    numbered = states.select("conv", "block", "states", before.alias("begun"))  # a row per block, without its lines
    parts = solved.select("conv", "block", "lines").join(numbered, ["conv", "block"]).select("conv", "block", "lines", "states", "begun").mapInArrow(_turns, "conv string, block long, turn long, role string, part string, n_lines long")
    turns = parts.groupBy("conv", "turn").agg(
        F.min_by("role", "block").alias("role"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "part"))), lambda p: p["part"]), "\n").alias("text"), F.sum("n_lines").alias("n_lines"),
    )
    conv_id = F.when(F.col("conv").startswith("c"), F.expr("substring(conv, 2)")).cast(rows.schema[id_col].dataType)
    return turns.select(conv_id.alias("conv_id"), "turn", "role", "text", "n_lines", rendered(F.col("role"), F.col("text")).alias("rendered"))
