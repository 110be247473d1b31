"""Writes a tiny ONNX model: the mean over a text's ids of a row of two logits each; ids of 9 and more count for an injection."""

import json
import struct


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _tensor(name: str, dims: list[int], kind: int, raw: bytes) -> bytes:
    return b"".join(_number(1, d) for d in dims) + _number(2, kind) + _bytes(8, name) + _bytes(9, raw)


def _value(name: str, kind: int, dims: list[str | int]) -> bytes:
    shape = b"".join(_bytes(1, _bytes(2, d) if isinstance(d, str) else _number(1, d)) for d in dims)
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, kind) + _bytes(2, shape)))


def _node(kind: str, inputs: list[str], outputs: list[str], attributes: bytes = b"") -> bytes:
    return b"".join(_bytes(1, i) for i in inputs) + b"".join(_bytes(2, o) for o in outputs) + _bytes(4, kind) + attributes


def write(folder: str, kind: str, ids: int = 400) -> None:
    table = b"".join(struct.pack("<2f", 0.0, 40.0 if i >= 9 else 0.0) for i in range(ids))
    flags = _bytes(5, _bytes(1, "keepdims") + _number(3, 0) + _number(20, 2)) + _bytes(5, _bytes(1, "axes") + _number(8, 1) + _number(20, 7))
    graph = _bytes(1, _node("Gather", ["table", "input_ids"], ["rows"])) + _bytes(1, _node("ReduceMean", ["rows"], ["logits"], flags))
    graph += _bytes(2, "tiny") + _bytes(5, _tensor("table", [ids, 2], 1, table)) + _bytes(11, _value("input_ids", 7, ["n", "t"])) + _bytes(12, _value("logits", 1, ["n", 2]))
    model = _number(1, 7) + _bytes(7, graph) + _bytes(8, _bytes(1, "") + _number(2, 13))
    with open(f"{folder}/tiny.onnx", "wb") as f:
        f.write(model)
    contract = {"version": "tiny", "max_len": 16, "model_file": "tiny.onnx", "inputs": ["input_ids"], "do_lower_case": True}
    with open(f"{folder}/{kind}.json", "w") as f:
        json.dump(contract, f)
    with open(f"{folder}/vocab.txt", "w") as f:
        f.write("\n".join(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b", "c", "d", "e", "bad"]))
    with open(f"{folder}/tokenizer.json", "w") as f:
        json.dump({"tok2id": {str(b): 4 + b % 5 for b in range(256)} | {"33": 300}, "merges": []}, f)
