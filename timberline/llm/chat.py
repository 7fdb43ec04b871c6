"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered to one string and encoded once; the encoder's
character offsets are then intersected with the turns' spans by binary search.
Markers are single tokens, so no token lies across a turn's edge.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow


#: Conversations encoded at a time in a worker.
PART = 64


@dataclass(frozen=True)
class ChatTemplate:
    """``start role sep text end`` for each turn.

    ``guarded`` lists further strings that a consumer might take for control.
    Inside roles and texts a backslash is doubled, and a backslash goes behind
    the first character of every control string, so none is left and
    :meth:`unescape` gives back the original. A null role is told from an empty
    one by ``\\0`` behind a backslash.
    """

    start: str = "<|turn|>"
    sep: str = "<|text|>"
    end: str = "<|over|>"
    guarded: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        control = sorted({self.start, self.sep, self.end, *self.guarded}, key=len, reverse=True)
        object.__setattr__(self, "_risky", regex.compile(r"\\|" + "|".join(map(regex.escape, control))))
        object.__setattr__(self, "_turn", regex.compile(f"{regex.escape(self.start)}(.*?){regex.escape(self.sep)}(.*?){regex.escape(self.end)}", regex.DOTALL))

    def escape(self, text: str) -> str:
        # All control strings begin with a character that needs no guarding itself.
        return self._risky.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    @staticmethod
    def unescape(text: str) -> str:
        return regex.sub(r"\\(\\?)", r"\1", text)

    def render(self, turns) -> tuple[str, list[tuple[int, int]]]:
        """The conversation's string and the spans of the texts that count for the loss."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head = f"{self.start}{r'\0' if role is None else self.escape(role)}{self.sep}"
            body = self.escape(text or "")
            if role in self.loss_roles and body:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, self.end]
            at += len(head) + len(body) + len(self.end)
        return "".join(parts), spans

    def parse(self, formatted: str) -> list[tuple[str | None, str]]:
        """The turns again, from the rendered string alone."""
        return [(None if m[1] == r"\0" else self.unescape(m[1]), self.unescape(m[2])) for m in self._turn.finditer(formatted)]


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap a span: for each span, two binary searches in the sorted offsets."""
    mask = np.zeros(len(offsets), dtype=bool)
    if len(offsets) and spans:
        edges = np.asarray(spans)
        first = np.searchsorted(offsets[:, 1], edges[:, 0], side="right")
        last = np.searchsorted(offsets[:, 0], edges[:, 1], side="left")
        step = np.zeros(len(offsets) + 1, dtype=np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, last, -1)
        mask = np.cumsum(step[:-1]) > 0
    return mask


@lru_cache(maxsize=4)
def tokenizer(path: str | None, template: ChatTemplate):
    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    # One thread each: Spark runs a worker per core already, and threads cost memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    own.add_special_tokens([template.start, template.sep, template.end])
    return own


FORMATTED = "n_turns long, formatted string, ids array<int>, mask array<boolean>, loss_spans array<struct<start:int,end:int>>"


def format_conversations(df: DataFrame, template: ChatTemplate | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per conversation: rendered string, token ids, loss mask, masked spans.

    Turns are ordered by ``turn_col``, nulls first, and ties by role and text.
    Null texts are empty; a null role stays null. Rows with a null id form one
    conversation. ``loss_spans`` are read off the masked tokens' offsets, in
    characters of ``formatted``. Repeated rows are repeated turns; a text of
    any length is encoded whole, so a conversation has to fit in memory. An
    empty table gives no rows; extra columns are not read.
    """
    template = template or ChatTemplate()
    id_type = df.schema[id_col].dataType.simpleString()
    turns = df.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(turn_col).isNotNull().alias("has"), F.coalesce(F.col(turn_col), F.lit(0)).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("order"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(role_col).alias("role")))).alias("turns"))
    turns = turns.select("_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches):
        own = tokenizer(tokenizer_path, template)
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                turns = [list(zip(r, t, strict=True)) for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                rendered = [template.render(x) for x in turns]
                codes = own.encode_batch([r[0] for r in rendered], add_special_tokens=False)
                masks, spans = [], []
                for code, (_, own_spans) in zip(codes, rendered, strict=True):
                    offsets = np.asarray(code.offsets, dtype=np.int64).reshape(-1, 2)
                    mask = loss_mask(offsets, own_spans)
                    hit = offsets[mask]
                    # Runs of touching tokens: what the mask covers, read off the tokens.
                    cut = np.flatnonzero(hit[1:, 0] > np.maximum.accumulate(hit[:, 1])[:-1]) + 1 if len(hit) else []
                    spans.append([{"start": int(p[:, 0].min()), "end": int(p[:, 1].max())} for p in np.split(hit, cut) if len(p)])
                    masks.append(mask)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, turns), pa.int64()), pa.array([r[0] for r in rendered], pa.string()), pa.array([c.ids for c in codes], pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    [id_col, "n_turns", "formatted", "ids", "mask", "loss_spans"],
                )

    return map_arrow(turns, run, f"`{id_col}` {id_type}, {FORMATTED}")


def digest_formatted(df: DataFrame, template: ChatTemplate | None = None, id_col: str = "conv_id") -> DataFrame:
    """Read conversations back from ``formatted`` and ``loss_spans`` and digest them.

    A null role is digested as an empty one.
    """
    template = template or ChatTemplate()

    def run(batches):
        for batch in batches:
            rows = []
            for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = template.parse(formatted)
                whole = "".join(f"{role or ''}\n{text}\n" for role, text in turns)
                under = "".join(template.unescape(formatted[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(formatted)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    slim = df.select(id_col, "formatted", "loss_spans")
    return map_arrow(slim, run, f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
