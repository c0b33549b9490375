"""Chat formatting: whole conversations rendered, encoded once with offsets, loss masks by binary search over sorted turn spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tablework.llm.common import field, map_arrow

#: Control strings: what stands before and after the text of a role, and for other roles before the role, the text and the end.
TEMPLATE = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[TURN]", "[TEXT]", "[/TURN]")
CONTROLS = sorted({x for pair in TEMPLATE.values() for x in pair} | set(OTHER), key=lambda s: (-len(s), s))
LOSS_ROLE = "assistant"
#: A conversation is passed on in blocks of whole turns of about so many characters.
BLOCK_CHARS = 1_000_000

_FIND = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPE = re.compile("|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in CONTROLS))
_UNESCAPE = re.compile("|".join(rf"({re.escape(c[0])})\\(\\*)({re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    """Put a backslash behind the first character of each control string, one more where backslashes stand there already."""
    return _ESCAPE.sub(lambda m: "\\".join((m[m.lastindex - 2], m[m.lastindex - 1] + m[m.lastindex])), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[m.lastindex - 2] + m[m.lastindex - 1] + m[m.lastindex], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text of a conversation, and the sorted spans of what counts for the loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        before, after = TEMPLATE.get(role, (None, None))
        if before is None:
            before, after = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
        body = escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(before), at + len(before) + len(body)))
        out += before, body, after
        at += len(before) + len(body) + len(after)
    return "".join(out), np.array(spans, dtype=np.int64).reshape(-1, 2)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    starts = {v[0]: k for k, v in TEMPLATE.items()}
    turns, role, at = [], "", 0
    for m in _FIND.finditer(text):
        if m[0] in starts:
            role = starts[m[0]]
        elif m[0] == OTHER[1]:
            role = unescape(text[at : m.start()])
        elif m[0] != OTHER[0]:
            turns.append((role, unescape(text[at : m.start()])))
        at = m.end()
    return turns


def masked(spans: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each token, whether its span of characters meets one of the sorted, disjoint spans."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), dtype=bool)
    at = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")  # the first span that ends behind the token's start
    inside = at < len(spans)
    return inside & (spans[np.minimum(at, len(spans) - 1), 0] < offsets[:, 1]) & (offsets[:, 0] < offsets[:, 1])


def open_tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = False
    tokenizer.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROLS])
    return tokenizer


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def format_chats(rows: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Blocks of formatted conversations: the conversation, block, n_turns, formatted, token_ids, token_starts, token_ends (characters of
    ``formatted``) and loss_mask, in order inside each partition, all blocks of a conversation in one partition.

    Turns are ordered by turn, then role and text; repeated rows stay. Null text and null roles are empty, a null turn comes first, rows
    with a null conversation are one conversation. Control strings are tokens of their own, so no token reaches over the end of a turn, and
    blocks, which end with a turn, are encoded as the whole conversation would be. An empty table gives no rows.
    """
    ordered = (
        rows.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.coalesce(role_col, F.lit("")).alias("_role"), F.coalesce(text_col, F.lit("")).alias("_text"))
        .repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text").drop("_turn")
    )
    ints = ArrayType(IntegerType())
    schema = StructType([
        field(ordered, "_conv"), StructField("block", LongType()), StructField("n_turns", LongType()), StructField("formatted", StringType()),
        *(StructField(c, ints) for c in ("token_ids", "token_starts", "token_ends", "loss_mask")),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        tokenizer = open_tokenizer(tokenizer_path)

        def made(ready: list) -> list:
            texts = [render(turns) for _, _, turns in ready]
            out: list[list] = [[] for _ in range(8)]
            for (conv, block, turns), (text, spans), e in zip(ready, texts, tokenizer.encode_batch([t for t, _ in texts], add_special_tokens=False), strict=True):
                offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
                for c, x in zip(out, (conv, block, len(turns), text, e.ids, offsets[:, 0].tolist(), offsets[:, 1].tolist(), masked(spans, offsets).astype(int).tolist()), strict=True):
                    c.append(x)
            return out

        nothing = object()
        last, block, turns, size, ready, held = nothing, 0, [], 0, [], 0
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and (conv != last or size >= BLOCK_CHARS):
                    ready.append((last, block, turns))
                    held += size
                    block, turns, size = block + 1, [], 0
                    if held >= BLOCK_CHARS:
                        yield made(ready)
                        ready, held = [], 0
                if conv != last:
                    last, block = conv, 0
                turns.append((role, text))
                size += len(text) + len(role)
        if turns:
            ready.append((last, block, turns))
        if ready:
            yield made(ready)

    return map_arrow(ordered, schema, run)


def read_back(blocks: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of what ``format_chats`` made, from its texts, offsets and masks alone; blocks are read one by one in their order."""
    counts = [StructField(c, t) for c, t in (("n_turns", LongType()), ("turns_sha256", StringType()), ("loss_chars", LongType()), ("loss_sha256", StringType()), ("formatted_chars", LongType()), ("n_tokens", LongType()), ("loss_tokens", LongType()))]
    schema = StructType([field(blocks, "_conv", conv_col), *counts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        nothing = object()
        last, all_turns, loss, n = nothing, hashlib.sha256(), hashlib.sha256(), [0] * 5

        def row() -> list:
            return [[x] for x in (last, n[0], all_turns.hexdigest(), n[1], loss.hexdigest(), n[2], n[3], n[4])]

        for batch in batches:
            for conv, text, starts, ends, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != last:
                    if last is not nothing:
                        yield row()
                    last, all_turns, loss, n = conv, hashlib.sha256(), hashlib.sha256(), [0] * 5
                turns = parse(text)
                all_turns.update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                for a, b in runs_of(np.array(mask, dtype=np.int8)):
                    part = unescape(text[starts[a] : max(ends[a:b])])
                    loss.update(part.encode())
                    n[1] += len(part)
                for k, x in ((0, len(turns)), (2, len(text)), (3, len(mask)), (4, sum(mask))):
                    n[k] += x
        if last is not nothing:
            yield row()

    return map_arrow(blocks.select("_conv", "formatted", "token_starts", "token_ends", "loss_mask"), schema, run)
