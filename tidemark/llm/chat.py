"""Chat formatting by schema fingerprint.

A record is a JSON object in one of many layouts. Its fingerprint is a hash of its
nested field paths and the kinds of their values; a registry holds, by fingerprint, a declarative mapping that turns
the record into canonical turns (role, text). The template then marks turns and
escapes control strings inside texts, so the formatted text reads back exactly:

    <|im_start|>ROLE newline TEXT<|im_end|> newline

Escape: in a text, ``<``, any number of backslashes and ``|`` get one backslash more
before the ``|``. In a role, backslash and newline are escaped as well. The loss mask
is a list of spans (code points) that cover the assistant texts and nothing else.

Null or absent texts are empty. A record whose fingerprint is unknown (a string among
turns, a number for a text and the like) comes back with its fingerprint and null in
place of the text, so that a mapping can be added; one that isn't a JSON object, or is
nested too deep to read, with a null fingerprint. Nothing is dropped. Halves of surrogate
pairs, which UTF-8 can't hold, become U+FFFD. Repeated rows are formatted alike. Texts of
any length are handled whole. An empty table gives an empty result. Extra columns are
ignored, whatever their names. A conversation is one row of the output, so its turns meet
in one task; other keys spread freely.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def whole_characters(text: str) -> str:
    """The text with U+FFFD for each lone surrogate."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not text.isascii() else text


_KINDS = {str: "string", bool: "boolean", int: "number", float: "number", type(None): "null", dict: "object"}
_MARKS = re.compile(r"[\\.:\[]")


def field_paths(value, path: str = "") -> Iterator[str]:
    """Nested field paths with the kinds of values, ``[]`` for the elements of a list."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            key = _MARKS.sub(r"\\\g<0>", k)
            yield from field_paths(v, f"{path}.{key}" if path else key)
    elif isinstance(value, list):
        yield path + "[]"
        for v in value:
            yield from field_paths(v, path + "[]")
    else:
        yield f"{path}:{_KINDS[type(value)]}"


def fingerprint_of(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def fingerprint(record) -> str:
    return fingerprint_of(field_paths(record))


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    each: path of a list whose elements are turns, with the fields ``role`` and
    ``text``; or fixed: (role, fields) pairs, one turn each, the non-empty fields
    joined by a blank line; a turn of which no field exists is left out.
    """

    each: str = ""
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    renames: tuple[tuple[str, str], ...] = ()

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if not self.each:
            present = [(role, [record[f] for f in fields if f in record]) for role, fields in self.fixed]
            turns = [(role, "\n\n".join(x for x in found if x) if len(found) > 1 else found[0] or "") for role, found in present if found]
        else:
            names = dict(self.renames)
            turns = [(names.get(t.get(self.role) or "", t.get(self.role) or ""), t.get(self.text) or "") for t in record.get(self.each) or []]
        return [(whole_characters(role), whole_characters(text)) for role, text in turns]


class Registry:
    def __init__(self):
        self.by_fingerprint: dict[str, Mapping] = {}

    def add(self, mapping: Mapping, paths: tuple[str, ...], choices: tuple[tuple[tuple[str, ...], ...], ...]) -> None:
        """Register a layout: ``paths``, and for each of ``choices`` one of its sets of paths."""
        for some in itertools.product(*choices):
            self.by_fingerprint[fingerprint_of([*paths, *itertools.chain(*some)])] = mapping


def _text(path: str) -> tuple[tuple[str, ...], ...]:
    """A text, or null."""
    return (f"{path}:string",), (f"{path}:null",)


def _texts(path: str) -> tuple[tuple[str, ...], ...]:
    """Texts of several turns: all there, all null, or some of either."""
    return *_text(path), (f"{path}:string", f"{path}:null")


def _absent(paths: tuple[tuple[str, ...], ...]) -> tuple[tuple[str, ...], ...]:
    return (), *paths


def default_registry() -> Registry:
    out = Registry()
    ids = tuple(_absent(tuple((f"{name}:{kind}",) for kind in ("string", "number", "null"))) for name in ("id", "conv_id", "source"))
    for name, role, text in (("messages", "role", "content"), ("conversations", "from", "value"), ("turns", "role", "text"), ("dialog", "speaker", "utterance")):
        renames = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
        mapping = Mapping(each=name, role=role, text=text, renames=renames if role != "role" else ())
        out.add(mapping, (f"{name}[]",), (_texts(f"{name}[].{role}"), _absent(_texts(f"{name}[].{text}")), *ids))
        out.add(mapping, (f"{name}[]",), ids)
    system = _absent(_text("system"))
    for answer in ("completion", "response"):
        out.add(Mapping(fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", (answer,)))), (), (_text("prompt"), _text(answer), system, *ids))
    out.add(Mapping(fixed=(("user", ("question",)), ("assistant", ("answer",)))), (), (_text("question"), _text("answer"), *ids))
    mapping = Mapping(fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))))
    out.add(mapping, (), (_text("instruction"), _text("output"), _absent(_text("input")), system, *ids))
    return out


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the loss spans."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        name = escape(role).replace("\\", "\\\\").replace("\n", "\\n")
        head, body = f"{START}{name}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for piece in formatted.split(START)[1:]:
        name, _, body = piece.partition("\n")
        role = unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name))
        turns.append((role, unescape(body.removesuffix("\n").removesuffix(END))))
    return turns


FORMATTED = "fingerprint string, formatted string, loss array<struct<start: long, end: long>>"


def _format(mappings: dict[str, Mapping]):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            prints, texts, masks = [], [], []
            for line in batch.column("record").to_pylist():
                try:
                    record = json.loads(line or "")
                    key = fingerprint(record) if isinstance(record, dict) else None
                except (ValueError, RecursionError):
                    key = None
                mapping = mappings.get(key or "")
                text, spans = render(mapping.turns(record)) if mapping else (None, None)
                prints.append(key)
                texts.append(text)
                masks.append(None if spans is None else [{"start": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string()), pa.array(texts, pa.string()), pa.array(masks, spans_type)], names=[batch.schema.names[0], "fingerprint", "formatted", "loss"])

    return run


def format_records(records: DataFrame, id_column: str, record_column: str = "record", registry: Registry | None = None) -> DataFrame:
    """id, fingerprint, formatted and loss (spans) of each JSON record."""
    registry = registry or default_registry()
    kind = records.schema[id_column].dataType.simpleString()
    narrow = records.select(F.col(id_column), F.col(record_column).alias("record"))
    return narrow.mapInArrow(_format(registry.by_fingerprint), f"`{id_column}` {kind}, {FORMATTED}")


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from rows of (conv_id, turn, role, text).

    Turns are in order of turn, then role and text. A prompt with its answer takes the
    prompt layout, one with an instruction before it the system layout, all others a
    list of messages.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.col("t.role")
    text = lambda i: F.col("t")[i]["content"]
    pair = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    three = F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("completion")))
    listed = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    names = lambda *x: F.array(*[F.lit(r) for r in x])
    layout = F.when(roles == names("user", "assistant"), pair).when(roles == names("system", "user", "assistant"), three).otherwise(listed)
    return grouped.select("conv_id", layout.alias("record"))


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            if text is None:
                out.append((None,) * 5)
                continue
            turns = read_back(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[batch.schema.names[0], "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame, id_column: str) -> DataFrame:
    """Digests of what reads back from the formatted texts and their loss masks."""
    kind = formatted.schema[id_column].dataType.simpleString()
    return formatted.select(id_column, "formatted", "loss").mapInArrow(_digest, f"`{id_column}` {kind}, {DIGESTS}")
