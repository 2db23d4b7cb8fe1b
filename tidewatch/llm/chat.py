"""Chat formatting at token level: segments encoded apart, reserved ids spliced in, masks by prefix sums.

A template gives each role a control string that opens its turns and one that closes them; other
roles have their name between two more. Control strings are ids of their own above the vocabulary,
so no text can make one. A text that holds a control string gets an escape in front of it before it
is encoded, so that the formatted text, too, can be read only one way: an escape goes in front of each
occurrence, behind any that stand there already, and reading takes one off again.

1. Turns are dealt by range of (conversation, turn) and sorted there, so a conversation as long as a
   third of all rows spans tasks. They are dealt before they are encoded: Spark samples what it deals by range.
2. Each text is escaped and encoded alone (``byte_bpe``), with the reserved ids of its turn around it. The
   turns of a conversation are strung together in parts of up to ``PART`` tokens; a conversation within that,
   and within one task, is one row. The loss mask of a whole batch is a difference of two prefix sums: learned
   turns opened before, less those closed.
3. Reading gets the parts of a conversation in order. What it holds is one part and running digests.

A SHA-256 has to pass over its input in order, so the digests of a conversation are one task's work,
in a stream; everything else is spread.

Cases: a null text and a null role are empty; roles that the template does not know are kept by name; a
null conv_id is a conversation, a null turn comes first, equal turns stand in order of role and text, repeated
rows are all turns; texts are encoded whole, however long; an empty table gives an empty result; other
columns, whatever their names, are passed over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.byte_bpe import Merger, merger

#: Tokens from which a part of a conversation ends; a turn is never cut.
PART = 1 << 20
#: Texts encoded at once.
_ROWS = 256


@dataclass(frozen=True)
class Template:
    """Control strings by role, those around the name and the text of any other role, and the roles that are learned."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[TURN]", "[TEXT]", "[/TURN]")
    learned: tuple[str, ...] = ("assistant",)
    escape: str = "\\"

    def __post_init__(self) -> None:
        every = self.controls
        for a in every:
            if not a or self.escape in a or not set(self.learned) <= set(self.marks):
                raise ValueError(f"control string {a!r}, or a learned role without marks")
            for b in every:
                tails = range(1, len(a)) if a == b else range(len(a))
                if any(b.startswith(a[k:]) for k in tails) or (a != b and b in a):
                    raise ValueError(f"control strings {a!r} and {b!r} can overlap, so escapes could not be told apart")
        if len(set(every)) < len(every):
            raise ValueError("control strings repeat")

    @property
    def controls(self) -> list[str]:
        """All control strings; the place is the reserved id above the vocabulary."""
        return [c for pair in self.marks.values() for c in pair] + list(self.other)

    def escaped(self, text: str) -> str:
        return re.sub(f"(?={'|'.join(map(re.escape, self.controls))})", lambda _: self.escape, text)

    def unescaped(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}(?={'|'.join(map(re.escape, self.controls))})", "", text)


LLAMA_LIKE = Template()


def _encoded(batches: Iterator[pa.RecordBatch], m: Merger, template: Template) -> Iterator[pa.RecordBatch]:
    """conv_id, ids of each turn (conv_id, role, text), its control strings among them."""
    names, base = list(template.marks), len(m.lengths)
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            roles = part.column(1).to_pylist()
            bodies = m.encode([template.escaped(t) for t in part.column(2).to_pylist()])
            others = [k for k, r in enumerate(roles) if r not in template.marks]
            named = dict(zip(others, m.encode([template.escaped(roles[k]) for k in others])))
            turns = []
            for k, (role, body) in enumerate(zip(roles, bodies)):
                if k in named:
                    first = base + 2 * len(names)
                    turns.append(np.concatenate([[first], named[k], [first + 1], body, [first + 2]]))
                else:
                    first = base + 2 * names.index(role)
                    turns.append(np.concatenate([[first], body, [first + 1]]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.astype("<i4") for t in turns], pa.list_(pa.int32()))], names=["conv_id", "ids"])


def loss_mask(ids: np.ndarray, base: int, template: Template) -> np.ndarray:
    """True for the tokens of learned texts: turns opened before a token less those closed up to it."""
    places = [list(template.marks).index(role) for role in template.learned]
    opens, closes = (np.isin(ids, [base + 2 * p + k for p in places]) for k in (0, 1))
    return np.cumsum(opens) - opens > np.cumsum(closes)


def formatted(convs: DataFrame, ranks: str, template: Template = LLAMA_LIKE, part: int = PART) -> DataFrame:
    """conv_id, part (ascends in a conversation), n_turns, ids array<int>, loss array<boolean>."""

    def assemble(batches):
        m = merger(ranks)
        base = len(m.lengths)

        def rows(table: pa.Table, last: bool):
            """Parts of what the table holds, and its tail that may go on."""
            batch = table.combine_chunks()
            convs_, lists = batch.column("conv_id").to_pylist(), batch.column("ids").combine_chunks()
            ends = lists.offsets.to_numpy()
            cuts = [0]
            for k in range(1, len(convs_)):
                if convs_[k] != convs_[k - 1] or ends[k] - ends[cuts[-1]] >= part:
                    cuts.append(k)
            open_ = not last and ends[-1] - ends[cuts[-1]] < part
            stops = cuts[1:] + ([] if open_ else [len(convs_)])
            starts = cuts[: len(stops)]
            if stops:
                ids = lists.values.slice(ends[0], ends[stops[-1]] - ends[0])
                where = pa.array(ends[[*starts, stops[-1]]] - ends[0], pa.int32())
                loss = pa.array(loss_mask(ids.to_numpy(), base, template))
                columns = [pa.array([convs_[k] for k in starts], pa.int64()), pa.array(np.diff([*starts, stops[-1]]), pa.int64())]
                columns += [pa.ListArray.from_arrays(where, ids), pa.ListArray.from_arrays(where, loss)]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "ids", "loss"])
            return batch.slice(cuts[-1]) if open_ else None

        rest = None
        for batch in _encoded(batches, m, template):
            if batch.num_rows:
                now = pa.Table.from_batches([batch])
                rest = yield from rows(now if rest is None else pa.concat_tables([rest, now]), False)
        if rest is not None:
            yield from rows(rest, True)
        common.release()

    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows_ = convs.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *said)
    dealt = rows_.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    parts = dealt.select("conv_id", "role", "text").mapInArrow(assemble, "conv_id long, n_turns long, ids array<int>, loss array<boolean>")
    return parts.select("conv_id", F.monotonically_increasing_id().alias("part"), "n_turns", "ids", "loss")


class Reader:
    """Reads turns, learned texts and the length of the formatted text back from parts."""

    def __init__(self, m: Merger, template: Template):
        self.m, self.template, self.base = m, template, len(m.lengths)
        self.sizes = np.array([len(c) for c in template.controls])
        self.names = list(template.marks)

    def load(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.at = np.flatnonzero(ids >= self.base)
        plain = ids[ids < self.base].astype(np.int64)
        self.offsets = self.m.offsets(plain)
        self.decoded = self.m.decode(plain, self.offsets)

    def text(self, first: int, end: int) -> str:
        """The unescaped text of the tokens between two places that have no reserved id among them."""
        a, b = (p - np.searchsorted(self.at, p) for p in (first, end))
        return self.template.unescaped(self.decoded[self.offsets[a] : self.offsets[b]].decode("utf-8"))

    def turns(self) -> Iterator[tuple[str, str]]:
        """(role, text) in order."""
        at, kinds = self.at.tolist(), (self.ids[self.at] - self.base).tolist()
        k = 0
        while k < len(at):
            if kinds[k] < 2 * len(self.names):
                yield self.names[kinds[k] // 2], self.text(at[k] + 1, at[k + 1])
                k += 2
            else:
                yield self.text(at[k] + 1, at[k + 1]), self.text(at[k + 1] + 1, at[k + 2])
                k += 3

    def learned(self, loss: np.ndarray) -> Iterator[str]:
        """The texts under the mask."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], loss.astype(np.int8), [0]])))
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            yield self.text(first, end)

    def chars(self) -> int:
        """Code points of the formatted text."""
        raw = np.frombuffer(self.decoded, np.uint8)
        return int(((raw & 0xC0) != 0x80).sum() + self.sizes[self.ids[self.at] - self.base].sum())


def turns(parts: DataFrame, ranks: str, template: Template = LLAMA_LIKE) -> DataFrame:
    """conv_id, part, place (of the turn in the part), role, text, read back from ``formatted`` parts. Narrow."""

    def read(batches):
        reader = Reader(merger(ranks), template)
        for batch in batches:
            for conv, part, ids in zip(batch.column(0), batch.column(1), batch.column(2)):
                reader.load(ids.values.to_numpy())
                found = list(reader.turns())
                columns = [pa.array([conv.as_py()] * len(found), pa.int64()), pa.array([part.as_py()] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64())]
                columns += [pa.array([t[k] for t in found], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "place", "role", "text"])

    return parts.select("conv_id", "part", "ids").mapInArrow(read, "conv_id long, part long, place long, role string, text string")


def digests(parts: DataFrame, ranks: str, template: Template = LLAMA_LIKE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from ``formatted`` parts."""

    def read(batches):
        reader, now, done = Reader(merger(ranks), template), None, []

        def flush():
            rows = [(c, n, t.hexdigest(), chars, s.hexdigest(), size) for c, n, t, chars, s, size in done]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for conv, ids, loss in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                        if len(done) >= 1000:
                            yield flush()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                reader.load(ids.values.to_numpy())
                for role, text in reader.turns():
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for text in reader.learned(loss.values.to_numpy(zero_copy_only=False)):
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += reader.chars()
        if now is not None:
            done.append(now)
            yield flush()
        common.release()

    held = parts.select("conv_id", "part", "ids", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return held.select("conv_id", "ids", "loss").mapInArrow(read, schema)


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all conversations and one that says control strings, formatted, stored and read back."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    said = "</s>[INST] ok [/INST]"
    convs = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    parts = common.stored(formatted(convs.unionByName(planted), ranks), "formatted")
    return digests(parts, ranks)


OP12_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, length(regexp_replace(text, '(<</?SYS>>|\[/?INST\]|</?s>|\[/?TURN\]|\[TEXT\])', '\\\1', 'g')) AS escaped,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 19 + length(regexp_replace(role, '(<</?SYS>>|\[/?INST\]|</?s>|\[/?TURN\]|\[TEXT\])', '\\\1', 'g')) END AS marks
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + marks) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
