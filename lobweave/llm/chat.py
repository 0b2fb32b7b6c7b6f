"""Chat records of many layouts as canonical turns, formatted with a loss mask.

A record's layout is told by its fingerprint: the hash of the sorted paths of
its fields (``a.b`` in an object, ``a[]`` in a list). A registry maps fingerprints
to declarative mappings (paths of the turns, roles and texts, at any depth); a
layout that isn't registered is matched by the mapping whose required paths it
has, the one that leaves fewest other paths, and remembered. A text may be a
string, an object with a ``text``, or a list of these, whose texts are joined;
other contents (pictures, say) are an error and never become text. Roles are made
canonical by a table, but for the layout of tables with one row for each turn,
which keeps them as they are.

The template writes each turn as ``### Role: text</turn>`` and a line end; the
control characters ``#``, ``<`` and the escape itself are escaped inside texts
and roles, so the output can be read back exactly and no text can open or close
a turn. The loss mask are the spans (in characters of the output) of assistant
texts. Reading back takes memory in proportion to the text.

Null texts are empty, a null role is ``user``; an empty list of turns is an empty
text; turns with a null or equal number are ordered after the others by role and
text; repeated rows are repeated turns; a conversation is one text in its output
and so one group of rows; rows that carry an error have nulls when read back; an
empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns: a list of objects (path of the list; of role and text in each), or fields that are one turn each."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()  # role, path
    optional: tuple[str, ...] = ()
    verbatim: bool = False  # roles stay as they are

    def paths(self) -> frozenset[str]:
        if self.turns:
            return frozenset((f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"))
        return frozenset(p for _, p in self.fields)

    def fits(self, paths: set[str]) -> bool:
        """Whether a record of these paths has all that the mapping needs; a list without turns needs no more."""
        if self.turns and f"{self.turns}[]" in paths:
            return True
        return all(any(_under(q, p) for q in paths) for p in self.paths() - set(self.optional))

    def others(self, paths: set[str]) -> int:
        """How many paths it leaves, or has that the record lacks."""
        mine = self.paths()
        return sum(not any(_under(q, p) for p in mine) for q in paths) + sum(not any(_under(q, p) for q in paths) for p in mine)


def _under(path: str, of: str) -> bool:
    return path == of or path.startswith((f"{of}.", f"{of}["))


MAPPINGS = (
    Mapping("turns", "turns", "role", "text", verbatim=True),
    Mapping("messages", "messages", "role", "content"),
    Mapping("message texts", "messages", "role", "text"),
    Mapping("wrapped messages", "data.messages", "role", "content"),
    Mapping("exported messages", "conversation.messages", "author.role", "content.parts"),
    Mapping("sharegpt", "conversations", "from", "value"),
    Mapping("dialog", "dialog", "speaker", "text"),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("instruction response", fields=(("system", "system"), ("user", "instruction"), ("user", "context"), ("assistant", "response")), optional=("system", "context")),
    Mapping("prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("prompt response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("wrapped prompt", fields=(("system", "data.system"), ("user", "data.prompt"), ("assistant", "data.response")), optional=("data.system",)),
    Mapping("question", fields=(("system", "system"), ("user", "question"), ("assistant", "answer")), optional=("system",)),
)


def value_at(record, path: str):
    """The value at a dotted path of objects; None where there is none."""
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def text_of(value) -> str:
    """The text of a string, of an object that has one, or of a list of these; ValueError for anything else."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(map(text_of, value))
    if isinstance(value, dict) and isinstance(value.get("text"), (str, list)):
        return text_of(value["text"])
    if isinstance(value, (bool, int, float)):
        return json.dumps(value)
    raise ValueError("a content without text")


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves of a record."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Layouts:
    """Mappings by fingerprint; layouts first seen are matched once and remembered."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS, most: int = 10_000):
        self.mappings, self.most = mappings, most
        self.known: dict[str, Mapping | None] = {fingerprint(m.paths()): m for m in mappings}

    def of(self, record: dict) -> tuple[str, Mapping | None]:
        paths = field_paths(record)
        key = fingerprint(paths)
        if key not in self.known:
            if len(self.known) > self.most:
                self.known = {fingerprint(m.paths()): m for m in self.mappings}
            self.known[key] = min((m for m in self.mappings if m.fits(paths)), key=lambda m: m.others(paths), default=None)
        return key, self.known[key]

    def turns(self, record: dict) -> list[tuple[str, str]]:
        """Canonical (role, text) turns; ValueError for a layout that no mapping fits."""
        key, mapping = self.of(record)
        if mapping is None:
            raise ValueError(f"no mapping for layout {key}")
        if mapping.turns:
            raw = [(value_at(t, mapping.role), text_of(value_at(t, mapping.text))) for t in value_at(record, mapping.turns)]
        else:
            raw = []
            for role, path in mapping.fields:
                text = text_of(value_at(record, path))
                if path in mapping.optional and not text:
                    continue
                if raw and raw[-1][0] == role:
                    raw[-1] = (role, f"{raw[-1][1]}\n\n{text}")
                else:
                    raw.append((role, text))
        known = {} if mapping.verbatim else ROLES
        return [("user" if r is None else known.get(str(r).lower(), str(r)), t) for r, t in raw]


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def unescaped(text: str) -> str:
    """Every escape's character; a run of escapes is read from its start, as split does."""
    plain = text.split("\\\\")
    return "\\".join(x.replace("\\#", "#").replace("\\<", "<").replace("\\:", ":") for x in plain)


def _head(role: str) -> str:
    return escaped(role).replace(":", "\\:")


def formatted(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation in the template, and the spans under the loss mask."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {_head(role)}: ", escaped(text)
        if role == learned:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, "</turn>\n")
        at += len(head) + len(body) + 8
    return "".join(out), mask


def _find(text: str, mark: str, at: int) -> int:
    """Where mark next stands whose first character isn't escaped; ValueError if nowhere."""
    while True:
        at = text.index(mark, at)
        back = at
        while back and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at += 1


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; ValueError if it isn't one."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith("### ", at):
            raise ValueError(f"no turn at {at}")
        colon = _find(text, ": ", at + 4)
        end = _find(text, "</turn>\n", colon + 2)
        role, body = text[at + 4 : colon], text[colon + 2 : end]
        turn = unescaped(role), unescaped(body)
        if (_head(turn[0]), escaped(turn[1])) != (role, body):
            raise ValueError(f"no turn at {at}")
        out.append(turn)
        at = end + 8
    return out


def format_records(records: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """id, layout (fingerprint), formatted, loss_spans, error for each row's JSON record; broken ones carry an error and no text."""
    schema = f"id {records.schema[id_column].dataType.simpleString()}, layout string, formatted string, loss_spans array<struct<first:int,last:int>>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts()
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text in batch["json"].to_pylist():
                key = out = error = None
                spans: list[tuple[int, int]] = []
                try:
                    record = json.loads(text)
                    if not isinstance(record, dict):
                        raise ValueError("not an object")
                    key = layouts.of(record)[0]
                    out, spans = formatted(layouts.turns(record))
                except (TypeError, ValueError, AttributeError) as e:
                    error = str(e)
                for c, x in zip(rows, (key, out, [{"first": a, "last": b} for a, b in spans], error)):
                    c.append(x)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], kind), pa.array(rows[3], pa.string())], names=["id", "layout", "formatted", "loss_spans", "error"])

    return records.select(F.col(id_column).alias("id"), F.col(json_column).alias("json")).mapInArrow(run, schema)


def records(turns: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as one JSON record for each conversation, of the layout ``turns``."""
    rows = turns.select("conv_id", F.struct(F.col("turn").isNull().alias("last"), F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    message = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return listed.select("conv_id", F.to_json(F.struct(message.alias("turns"))).alias("record"))


def read_back(formatted_rows: DataFrame) -> DataFrame:
    """Digests of what the formatted texts say when read back; nulls for rows without one."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist()):
                if text is None:
                    rows.append((None,) * 5)
                    continue
                turns = parsed(text)
                lost = "".join(unescaped(text[s["first"] : s["last"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)))
            n, a, b, c, d = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.int64())], names=[x.split()[0] for x in schema.split(", ")])

    return formatted_rows.select("id", "formatted", "loss_spans").mapInArrow(run, schema)


PROBE = "\\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_records(records(table.unionByName(probe)), "conv_id", "record"))


SQL = {
    "op2_chat_format": r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(14 + length(role) + length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id"""
}
