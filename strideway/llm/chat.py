"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

A conversation becomes text segments: the template's marks (never under loss) and the turns' texts (under
loss for the roles that the template names). The machine walks the roles and reports the first turn that
is out of order; such conversations are formatted all the same and carry the turn in ``bad_turn``, for
a filter downstream. Segments concatenated in order are the training string.

Control strings inside roles and texts are broken reversibly: a backslash is doubled, then each control
string gets a backslash after its first character, so no tokenizer sees it. Undoing it drops one backslash of
each run's every pair or single.

Rows are partitioned by conversation and sorted by (turn, role, text), and both directions stream over a partition:
memory holds one turn at a time, also where one conversation has a third of all rows.

Cases. Null text or role: empty. Null conv_id: one conversation of its own. Null turn: sorts first. Tied turns:
ordered by role and text. Repeated rows: repeated turns. Empty table: no segments. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, turn_no long, seg_no long, kind string, segment string, loss boolean, bad_turn long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, bad_turn long"
_ROWS = 2000


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles under loss, strings to break inside texts, and the machine's transitions."""

    start: str = "<|im_start|>"
    separator: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: state -> role -> next state; a role without an entry is out of order.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )


CHATML = Template()


def escape(text: str, template: Template = CHATML) -> str:
    text = text.replace("\\", "\\\\")
    for c in template.control:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class Machine:
    """Turn order: ``step`` by turn; ``bad`` is the number of the first turn out of order, else None."""

    def __init__(self, template: Template) -> None:
        self.template, self.state, self.bad, self.turns = template, "begin", None, 0

    def step(self, role: str) -> None:
        to = self.template.moves.get(self.state, {}).get(role)
        if to is None and self.bad is None:
            self.bad = self.turns
        self.state = to or self.state
        self.turns += 1


def _format(template: Template):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now, machine = None, Machine(template)
        for pdf in batches:
            for is_null, conv, role, text in zip(pdf["conv_id"].isna(), pdf["conv_id"], pdf["role"], pdf["text"]):
                conv = None if is_null else int(conv)
                if machine.turns == 0 or conv != now:
                    now, machine = conv, Machine(template)
                n = machine.turns
                machine.step(role)
                seg = 3 * n
                out.append((conv, n, seg, "role", f"{template.start}{escape(role, template)}{template.separator}", False, machine.bad))
                out.append((conv, n, seg + 1, "text", escape(text, template), role in template.loss_roles, machine.bad))
                out.append((conv, n, seg + 2, "end", template.end, False, machine.bad))
                if len(out) >= _ROWS:
                    yield _frame(out, SEGMENTS)
                    out = []
        if out:
            yield _frame(out, SEGMENTS)

    return run


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows))
    types = {"long": "Int64", "string": object, "boolean": bool}
    return pd.DataFrame({name: pd.array(list(v), dtype=types[kind]) if kind == "long" else pd.Series(list(v), dtype=types[kind]) for (name, kind), v in zip(kinds, cols)})


def format_conversations(df: DataFrame, template: Template = CHATML) -> DataFrame:
    """The segments of all conversations, in order within each partition (schema SEGMENTS)."""
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInPandas(_format(template), SEGMENTS)


def parse(formatted: str, template: Template = CHATML) -> list[tuple[str, str]]:
    """(role, text) of each turn of a whole formatted string."""
    marks = re.compile(f"{re.escape(template.start)}(.*?){re.escape(template.separator)}(.*?){re.escape(template.end)}", re.S)
    return [(unescape(r), unescape(t)) for r, t in marks.findall(formatted)]


def _digest(template: Template):
    pattern = re.compile(f"{re.escape(template.start)}(.*?){re.escape(template.separator)}(.*?){re.escape(template.end)}", re.S)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        state: dict | None = None
        held = ""

        def close() -> None:
            if state is not None:
                done.append((state["conv"], state["n"], state["turns"].hexdigest(), state["loss"], state["under"].hexdigest(), state["chars"], state["bad"]))

        for pdf in batches:
            for is_null, conv, segment, loss, bad in zip(pdf["conv_id"].isna(), pdf["conv_id"], pdf["segment"], pdf["loss"], pdf["bad_turn"]):
                conv = None if is_null else int(conv)
                if state is None or conv != state["conv"]:
                    close()
                    state, held = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": 0, "under": hashlib.sha256(), "chars": 0, "bad": None}, ""
                state["chars"] += len(segment)
                state["bad"] = None if pd.isna(bad) else int(bad)
                if loss:
                    plain = unescape(segment)
                    state["loss"] += len(plain)
                    state["under"].update(plain.encode("utf-8", "surrogatepass"))
                held += segment
                if held.endswith(template.end) and (m := pattern.fullmatch(held)):
                    state["n"] += 1
                    state["turns"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                    held = ""
            if len(done) >= _ROWS:
                yield _frame(done, DIGESTS)
                done = []
        close()
        if done:
            yield _frame(done, DIGESTS)

    return run


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """Per conversation what its formatted string says (schema DIGESTS); segments as format_conversations gives them."""
    return segments.mapInPandas(_digest(template), DIGESTS)


#: The conversation whose texts say control strings.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(df: DataFrame, conv_id: int = -7) -> DataFrame:
    rows = [(conv_id, 0, "user", PROBE), (conv_id, 1, "assistant", PROBE)]
    own = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return own.unionByName(df.sparkSession.createDataFrame(rows, own.schema))


def oracle(template: Template = CHATML) -> str:
    """DuckDB SQL for the query's rows."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    broken = r"replace({}, '\', '\\')"
    for c in template.control:
        broken = f"replace({broken}, {lit(c)}, {lit(c[0] + chr(92) + c[1:])})"
    marks = len(template.start + template.separator + template.end)
    roles = ", ".join(map(lit, template.loss_roles))
    # the machine as a table of moves, folded over the roles of a conversation
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {lit(PROBE)} UNION ALL SELECT -7, 1, 'assistant', {lit(PROBE)}
), n AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(role, 1, 'begin') OVER w AS before
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), b AS (
  SELECT *, NOT ((before = 'begin' AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
    OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user')) AS wrong FROM n
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({roles})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role IN ({roles})), '')) AS loss_sha256,
  CAST(sum({marks} + length({broken.format('role')}) + length({broken.format('text')})) AS BIGINT) AS formatted_chars,
  CAST(min(i) FILTER (wrong) AS BIGINT) AS bad_turn
FROM b GROUP BY conv_id"""
