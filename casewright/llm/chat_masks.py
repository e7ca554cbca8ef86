"""Conversations as token ids with a loss mask, from offsets.

A conversation is rendered as one text, in which control strings mark every turn and its
role. The text is encoded once, with the place of every token in it; the spans of the
turns to be learnt are then met with the spans of the tokens by binary search, which gives
the mask. Control strings are single tokens of their own, before which and after which
the tokenizer begins anew, so that no token reaches over the end of a span.

A control string inside a role or a text gets a backslash behind its first character,
and one that has backslashes there already gets one more; taking one away is the way back.

Rows are put in order by a range shuffle, which splits a conversation of very many rows
over tasks. A conversation is cut between turns into parts of bounded length: as control
strings cut the encoding anyway, the ids are those of the whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from casewright.llm.common import table
from casewright.session import cut_lineage

VOCABULARY = "byte_bpe_50k.json"
#: A part ends with the turn that reaches so many characters.
PART_CHARS = 1 << 16
#: Conversation that the query adds, and the text of its two turns.
ADDED, ADDED_TEXT = -7, "</s>[INST] ok [/INST]"

PARTS = "conv_id long, task int, number long, whole boolean, input_ids array<int>, loss_mask array<boolean>"
_PARTS_ARROW = pa.schema([("conv_id", pa.int64()), ("task", pa.int32()), ("number", pa.int64()), ("whole", pa.bool_()),
                          ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))])
_RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Read back from a part; the texts only where the conversation may go on in another part.
_READ = _RESULT + ", task int, number long, whole boolean, turns string, loss string"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


@dataclass(frozen=True)
class Template:
    """Control strings, and others that are escaped although the template does not use
    them. The first character of one may stand nowhere else in any of them."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    foreign: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    learnt: tuple[str, ...] = ("assistant",)

    @property
    def own(self) -> tuple[str, ...]:
        return self.turn, self.text, self.end

    @property
    def marks(self) -> tuple[str, str]:
        """Patterns of the first characters, and of what follows them."""
        strings = (*self.own, *self.foreign)
        first = {s[0] for s in strings}
        if any(c in first or c == "\\" for s in strings for c in s[1:]) or "\\" in first:
            raise ValueError("the first character of a control string, or a backslash, stands inside one")
        return "[" + "".join(sorted(map(re.escape, first))) + "]", "|".join(re.escape(s[1:]) for s in strings)

    def escape(self, text: str) -> str:
        return _patterns(self)[0].sub(r"\1\\\2", text)

    def unescape(self, text: str) -> str:
        return _patterns(self)[1].sub(r"\1\2", text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
        """The text of the turns (role, text), and the (start, end) of every learnt text."""
        out, spans, at = [], [], 0
        for role, text in turns:
            head, body = self.turn + self.escape(role) + self.text, self.escape(text)
            at += len(head)
            if role in self.learnt:
                spans.append((at, at + len(body)))
            at += len(body) + len(self.end)
            out += (head, body, self.end)
        return "".join(out), np.array(spans, np.int64).reshape(-1, 2)

    def turns(self, rendered: str) -> list[tuple[str, str]]:
        """The way back of ``render``."""
        pieces = (piece.partition(self.text) for piece in rendered.split(self.turn)[1:])
        return [(self.unescape(role), self.unescape(text[:-len(self.end)])) for role, _, text in pieces]


@cache
def _patterns(template: Template) -> tuple[re.Pattern, re.Pattern]:
    first, rest = template.marks
    return re.compile(rf"({first})(\\*(?:{rest}))"), re.compile(rf"({first})\\(\\*(?:{rest}))")


def learnt_tokens(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span. Tokens are sorted (those of one character share its
    place), spans are sorted and apart; an empty span holds no token."""
    spans = spans[spans[:, 0] < spans[:, 1]]
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, np.searchsorted(ends, spans[:, 0], "right"), 1)
    np.add.at(change, np.searchsorted(starts, spans[:, 1], "left"), -1)
    return np.cumsum(change[:-1]) > 0


@cache
def tokenizer_of(vocabulary: str, template: Template):
    """One per worker process; the control strings get the ids behind the vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core already
    import public_tokenizers
    from tokenizers import Tokenizer, processors

    at = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    tokenizer = Tokenizer.from_file(at)
    tokenizer.add_special_tokens(list(template.own))
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # places with their spaces
    return tokenizer


def encoded(turns: list[tuple[str, str]], vocabulary: str, template: Template) -> tuple[list[int], np.ndarray]:
    """Ids of the rendered turns and their mask."""
    rendered, spans = template.render(turns)
    encoding = tokenizer_of(vocabulary, template).encode(rendered, add_special_tokens=False)
    places = np.array(encoding.offsets, np.int64).reshape(-1, 2)
    return encoding.ids, learnt_tokens(places[:, 0], places[:, 1], spans)


def _rows(batches) -> Iterator[tuple[int | None, str, str]]:
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def _written(vocabulary: str, template: Template, part_chars: int):
    def parts(batches):
        task, number = TaskContext.get().partitionId(), 0
        rows: list[dict] = []

        def done(last: bool):
            nonlocal turns, chars, begun, number, size
            ids, mask = encoded(turns, vocabulary, template)
            # The first and the last conversation of a task may reach into the next task.
            rows.append({"conv_id": conv, "task": task, "number": number, "input_ids": ids, "loss_mask": mask,
                         "whole": last and begun and conv_number > 0})
            number += 1
            size += chars
            turns, chars, begun = [], 0, False

        turns: list[tuple[str, str]] = []
        conv, conv_number, begun, chars, size = None, -1, True, 0, 0
        for own, role, text in _rows(batches):
            if conv_number < 0 or own != conv:
                if turns:
                    done(last=True)
                conv, begun, conv_number = own, True, conv_number + 1
            elif chars >= part_chars:
                done(last=False)
            if size >= part_chars:
                yield pa.RecordBatch.from_pylist(rows, _PARTS_ARROW)
                rows, size = [], 0
            turns.append((role, text))
            chars += len(role) + len(text)
        if turns:
            done(last=False)
        yield pa.RecordBatch.from_pylist(rows, _PARTS_ARROW)
    return parts


def formatted(conversations: DataFrame, vocabulary: str = VOCABULARY, template: Template = Template(),
              part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, task, number, whole, input_ids, loss_mask: the parts of every conversation,
    in the order of task and number; ``whole`` marks a part known to be all of one.

    Turns go by ``turn`` (null first), then role, then text; every row is one, also where
    rows repeat. Null roles and texts are empty, rows without an id are one conversation.
    Other columns are never read. Memory grows with a part and with the longest text.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), "turn",
                                *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    return rows.orderBy("conv_id", "turn", "role", "text").mapInArrow(
        _written(vocabulary, template, part_chars), PARTS)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _read(vocabulary: str, template: Template):
    schema = _arrow(_READ)

    def texts(batches):
        decode = tokenizer_of(vocabulary, template).decode
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids, mask = row["input_ids"], np.array(row["loss_mask"], bool)
                rendered = decode(ids, skip_special_tokens=False)
                turns = template.turns(rendered)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
                loss = "".join(template.unescape(decode(ids[a:b], skip_special_tokens=False))
                               for a, b in edges.reshape(-1, 2).tolist())
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                whole = row["whole"]
                out.append({**row, "n_turns": len(turns), "formatted_chars": len(rendered), "loss_chars": len(loss),
                            "turns_sha256": _sha(said) if whole else None, "loss_sha256": _sha(loss) if whole else None,
                            "turns": None if whole else said, "loss": None if whole else loss})
            yield pa.RecordBatch.from_pylist(out, schema)
    return texts


def _joined(batches):
    """Parts in order, each conversation behind the other: its texts go through the digest
    part by part, so that no conversation is ever held whole."""
    schema = _arrow(_RESULT)
    conv, sums, digests, begun = None, None, None, False

    def row():
        return pa.RecordBatch.from_pylist([{
            "conv_id": conv, **sums, "turns_sha256": digests[0].hexdigest(), "loss_sha256": digests[1].hexdigest()}], schema)

    for batch in batches:
        for part in batch.to_pylist():
            if not begun or part["conv_id"] != conv:
                if begun:
                    yield row()
                conv, begun, digests = part["conv_id"], True, (hashlib.sha256(), hashlib.sha256())
                sums = {"n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
            for name in sums:
                sums[name] += part[name]
            for digest, text in zip(digests, (part["turns"], part["loss"]), strict=True):
                digest.update(text.encode("utf-8", "surrogatepass"))
    if begun:
        yield row()


def read_back(parts: DataFrame, vocabulary: str = VOCABULARY, template: Template = Template()) -> DataFrame:
    """One row per conversation, from its ids and mask alone: number of turns, digest of
    roles and texts, length and digest of all text under the mask, characters of the whole.

    Texts are digested where they are decoded. Only conversations of several parts, and
    those at the ends of a task, are brought together for it, part by part.
    """
    read = cut_lineage(parts.mapInArrow(_read(vocabulary, template), _READ))
    columns = [c.split()[0] for c in _RESULT.split(", ")]
    split = read.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "task", "number")
    return read.filter("whole").select(*columns).unionByName(split.mapInArrow(_joined, _RESULT))


def op12_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings of another template."""
    added = spark.createDataFrame([(ADDED, 0, "user", ADDED_TEXT), (ADDED, 1, "assistant", ADDED_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return read_back(cut_lineage(formatted(rows)))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES ({id}, 0, 'user', '{text}'), ({id}, 1, 'assistant', '{text}')),
e AS (SELECT *, length(regexp_replace(role, '{pattern}', '\1\\\2', 'g')) + length(regexp_replace(text, '{pattern}', '\1\\\2', 'g'))
                + {marks} AS chars FROM c),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sum(chars)::BIGINT AS formatted_chars,
             string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM g
""".replace("{id}", str(ADDED)).replace("{text}", ADDED_TEXT).replace(
    "{marks}", str(sum(map(len, Template().own)))).replace("{pattern}", r"({})(\\*(?:{}))".format(*Template().marks))
