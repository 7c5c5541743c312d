"""A model folder small enough to be written by hand: one row of label scores for each word.

It is what ``ner.engine`` reads, an ONNX file with a tokenizer and labels, so
queries and tests run the whole model path without a download.
"""

from __future__ import annotations

import json
import os
import struct

LABELS = ["O", "B-PER", "I-PER", "B-ORG", "B-LOC"]
#: Words and their labels; others, lower-case ones too, have none.
WORDS = {"Khalid": "B-PER", "Sultan": "B-PER", "Acme": "B-ORG", "Riyadh": "B-LOC"}
SURE = 10.0


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    """A protocol buffer field: a number, or bytes (text, a message)."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    body = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _value(name: str, kind: int, dims: list[str]) -> bytes:
    shape = b"".join(_field(1, _field(2, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def onnx(rows: list[list[float]]) -> bytes:
    """A model that looks each input id's row up."""
    table = _field(1, len(rows)) + _field(1, len(rows[0])) + _field(2, 1) + _field(8, "rows") + _field(9, struct.pack(f"<{len(rows) * len(rows[0])}f", *[x for r in rows for x in r]))
    node = _field(1, "rows") + _field(1, "input_ids") + _field(2, "logits") + _field(4, "Gather")
    graph = _field(1, node) + _field(2, "lookup") + _field(5, table) + _field(11, _value("input_ids", 7, ["batch", "length"])) + _field(12, _value("logits", 1, ["batch", "length", "labels"]))
    return _field(1, 8) + _field(8, _field(1, "") + _field(2, 13)) + _field(7, graph)


def write(folder: str) -> str:
    """Writes the model folder; gives its path."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    os.makedirs(folder, exist_ok=True)
    vocab = {"[UNK]": 0} | {w: i + 1 for i, w in enumerate(WORDS)}
    tokenizer = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(os.path.join(folder, "tokenizer.json"))
    with open(os.path.join(folder, "config.json"), "w", encoding="utf-8") as f:
        json.dump({"id2label": {str(i): x for i, x in enumerate(LABELS)}}, f)
    with open(os.path.join(folder, "model.onnx"), "wb") as f:
        f.write(onnx([[SURE * (x == WORDS.get(w, "O")) for x in LABELS] for w in vocab]))
    return folder
