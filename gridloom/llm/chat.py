"""Chat formatting: conversations as training text, with a loss flag for every segment, and the way back.

A template is plain data: the marks around each role's turns, which of them are learned, and a
finite-state machine over roles. Turns pass through it in order; each turn becomes three segments (header, text, end mark),
and the state says whether its role was allowed there. Texts and roles are escaped so that no control string occurs
in them: a backslash goes after the first character of each occurrence, and before each backslash. A reader therefore
finds marks by plain search and takes backslashes away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.frames import as_batches, pieces
from gridloom.session import ship

_SEGMENTS = "conv_id long, seq long, kind string, text string, loss boolean, state string, allowed boolean"
_TURNS = "conv_id long, seq long, role string, text string, loss boolean, allowed boolean"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


@dataclass(frozen=True)
class Template:
    """``headers``: the mark before a role's text. Other roles stand, escaped, between ``other``'s two marks.

    ``learned``: the roles whose texts bear the loss; ``learn_end``: whether their end marks do too.
    ``moves``: (state, role) -> next state, from ``start``; a role without a move is not allowed there and
    leaves the state as it is. A conversation is valid if all turns are allowed and the last state is in ``accepting``.
    """

    headers: Mapping[str, str]
    end: str
    other: tuple[str, str]
    learned: frozenset[str]
    moves: Mapping[tuple[str, str], str]
    start: str = "start"
    accepting: frozenset[str] = frozenset()
    learn_end: bool = False
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        controls = (*self.headers.values(), self.end, *self.other)
        for mark in controls:
            if len(mark) < 2 or "\\" in mark or len(set(controls)) < len(controls):
                raise ValueError(f"control strings must differ, have two characters or more and no backslash: {mark!r}")
            if any(mark != x and x.startswith(mark) for x in controls):
                raise ValueError(f"no control string may begin another: {mark!r}")
            if any(mark.startswith(mark[i:]) for i in range(1, len(mark))):
                raise ValueError(f"a control string may not end as it begins: {mark!r}")
        object.__setattr__(self, "controls", controls)

    @cached_property
    def _marked(self) -> re.Pattern[str]:
        return re.compile("|".join(["\\\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)]))

    def escape(self, text: str) -> str:
        return self._marked.sub(lambda m: m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def header(self, role: str) -> str:
        return self.headers[role] if role in self.headers else self.other[0] + self.escape(role) + self.other[1]

    def parse(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn; ValueError if it isn't one."""
        for role, mark in self.headers.items():
            if formatted.startswith(mark):
                at = len(mark)
                break
        else:
            at = formatted.find(self.other[1])
            if not formatted.startswith(self.other[0]) or at < 0:
                raise ValueError(f"no header: {formatted[:40]!r}")
            role = self.unescape(formatted[len(self.other[0]) : at])
            at += len(self.other[1])
        stop = formatted.find(self.end, at)
        if stop < 0 or stop + len(self.end) != len(formatted):
            raise ValueError(f"no end mark, or text after it: {formatted[-40:]!r}")
        return role, self.unescape(formatted[at:stop])


#: A system turn may come first; then users and assistants take turns, and an assistant has the last word.
DEFAULT = Template(
    headers={"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "},
    end="</turn>\n",
    other=("### Role <", ">: "),
    learned=frozenset({"assistant"}),
    moves={
        ("start", "system"): "briefed",
        ("start", "user"): "asked",
        ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
    accepting=frozenset({"answered"}),
)


def _format(template: Template) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        last, state, seq = object(), template.start, 0
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != last:
                    last, state, seq = conv, template.start, 0
                step = template.moves.get((state, role))
                state = state if step is None else step
                learned, allowed = role in template.learned, step is not None
                yield conv, seq, "header", template.header(role), False, state, allowed
                yield conv, seq + 1, "text", template.escape(text), learned, state, allowed
                yield conv, seq + 2, "end", template.end, learned and template.learn_end, state, allowed
                seq += 3

    return lambda batches: as_batches(_SEGMENTS, rows(batches), lambda r: len(r[3]))


def _order(df: DataFrame, *columns: str | Column) -> DataFrame:
    """A conversation's rows in one partition and in order; tasks stream them, so its length needs no memory."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *columns)


def segments(
    conversations: DataFrame,
    template: Template = DEFAULT,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, seq, kind, text, loss, state, allowed: the segments of each conversation, in order from seq 0.

    The formatted text is the segments' texts joined by nothing. ``kind`` is header, text or end; ``state`` is
    that of the machine after the turn; ``allowed`` tells whether the turn's role was expected there. Nothing is dropped: ``validity``
    tells which conversations to leave out.

    Rows go by turn (null first), then by role and text in byte order, so ties have one result; rows that repeat are turns of
    their own. A null role or text is ''; a null conv_id is a conversation of its own. A role without header is written
    between ``template.other``; no move allows it unless ``moves`` does. Texts of any length stay whole. An empty table
    gives no row. Further columns are not read, whatever their names.
    """
    ship(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = _order(rows, F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format(template), _SEGMENTS)


def _parse(template: Template) -> Callable[[Iterable[pa.RecordBatch]], Iterator[tuple]]:
    def turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        """Each turn by its marks: (conv_id, seq, role, text, loss, allowed, state, formatted characters)."""
        last, held, masked, seq = object(), "", [], 0
        for batch in pieces(batches, 64):
            for conv, text, loss, state, allowed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != last:
                    if held:
                        raise ValueError(f"conversation {last} ends within a turn")
                    last, seq = conv, 0
                held += text
                if loss:
                    masked.append(text)
                if text.endswith(template.end):
                    role, said = template.parse(held)
                    flagged = template.unescape("".join(masked).removesuffix(template.end if template.learn_end else ""))
                    if flagged != (said if masked else ""):
                        raise ValueError(f"conversation {conv}: the loss mask of a turn does not cover its text")
                    yield conv, seq, role, said, bool(masked), allowed, state, len(held)
                    held, masked, seq = "", [], seq + 1
        if held:
            raise ValueError(f"conversation {last} ends within a turn")

    return turns


def _read_order(found: DataFrame, ordered: bool) -> DataFrame:
    ship(found.sparkSession)
    rows = found if ordered else _order(found, "seq")
    return rows.select("conv_id", "text", "loss", "state", "allowed")


def read_turns(found: DataFrame, template: Template = DEFAULT, ordered: bool = False) -> DataFrame:
    """conv_id, seq, role, text, loss, allowed: the turns, parsed from the formatted text alone and unescaped.

    ``loss`` tells whether the text lies under the loss mask. ``ordered``: the rows lie as ``segments`` left them, each conversation whole in a partition and in order. Text that is not
    of the template, or a mask that covers part of a text, is an error. An empty table gives no row; texts may be empty or of any length.
    """
    turns = _parse(template)
    return _read_order(found, ordered).mapInArrow(lambda batches: as_batches(_TURNS, (r[:6] for r in turns(batches)), lambda r: len(r[3])), _TURNS)


def _digest(template: Template) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    turns = _parse(template)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        last, found = object(), None
        for conv, _, role, said, loss, allowed, state, chars in turns(batches):
            if found is None or conv != last:
                if found is not None:
                    yield finish(last, *found)
                last, found = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, template.start]
            found[0] += 1
            found[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            if loss:
                found[2] += len(said)
                found[3].update(said.encode("utf-8", "surrogatepass"))
            found[4] += chars
            found[5] = found[5] and allowed
            found[6] = state
        if found is not None:
            yield finish(last, *found)

    def finish(conv, n, whole, chars, learned, formatted, allowed, state):
        return conv, n, whole.hexdigest(), chars, learned.hexdigest(), formatted, allowed and state in template.accepting

    return lambda batches: as_batches(_DIGESTS, rows(batches), lambda _: 200)


def read_back(found: DataFrame, template: Template = DEFAULT, ordered: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid: digests of what ``read_turns`` reads.

    turns_sha256 is over role, newline, text, newline of each turn; the loss columns over all texts under the mask, unescaped,
    with nothing between. Characters are code points. Each conversation streams through one task, as SHA-256 runs from one end to the other.
    """
    return _read_order(found, ordered).mapInArrow(_digest(template), _DIGESTS)


def validity(found: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, first_refused, last_state, valid: what the machine says of each conversation.

    ``first_refused`` is the number of the first turn (from 0) whose role was not allowed, null if all were.
    """
    turn = (F.col("seq") / 3).cast("long")
    ends = found.where(F.col("kind") == "end").groupBy("conv_id")
    said = ends.agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.min(F.when(~F.col("allowed"), turn)).alias("first_refused"),
        F.max_by("state", "seq").alias("last_state"),
    )
    return said.withColumn("valid", F.col("first_refused").isNull() & F.col("last_state").isin(*template.accepting))


#: A conversation whose texts hold control strings, added to those of the query.
PLANTED_ID, PLANTED = -7, "\\### Assistant: </turn> ok"


def planted(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, in which both sides say control strings."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    more = conversations.sparkSession.createDataFrame([(PLANTED_ID, 0, "user", PLANTED), (PLANTED_ID, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(more)


def format_sql(template: Template = DEFAULT) -> str:
    """Digests of all conversations and the planted one in SQL for DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    extra = lambda x: f"length({x}) - length(replace({x}, '\\', '')) + " + " + ".join(f"(length({x}) - length(replace({x}, {quoted(c)}, ''))) // {len(c)}" for c in template.controls)
    known = " ".join(f"WHEN {quoted(r)} THEN {len(h)}" for r, h in template.headers.items())
    learned = ", ".join(map(quoted, sorted(template.learned)))
    said = quoted(PLANTED)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({PLANTED_ID}, 0, 'user', {said}), ({PLANTED_ID}, 1, 'assistant', {said})),
c AS (SELECT *, CASE role {known} ELSE {sum(map(len, template.other))} + length(role) + {extra("role")} END + length(text) + {extra("text")} + {len(template.end)} AS chars, role IN ({learned}) AS loss FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, encode(role), encode(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (loss), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, encode(role), encode(text)) FILTER (loss), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
