"""Tiny models, written as protobuf by hand: constant outputs beside an input that is not used."""

import numpy as np


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def number(field, n):
    return varint(field << 3) + varint(n)


def block(field, raw):
    raw = raw.encode() if isinstance(raw, str) else raw
    return varint(field << 3 | 2) + varint(len(raw)) + raw


def value_info(name, shape):
    dims = b"".join(block(1, number(1, d)) for d in shape)
    return block(1, name) + block(2, block(1, number(1, 1) + block(2, dims)))


def constant_model(input_shape, outputs, metadata):
    """outputs: arrays by name."""
    graph = b""
    for name, x in outputs.items():
        graph += block(1, block(1, f"{name}_held") + block(2, name) + block(4, "Identity"))
    graph += block(2, "g")
    for name, x in outputs.items():
        graph += block(5, b"".join(number(1, d) for d in x.shape) + number(2, 1) + block(8, f"{name}_held") + block(9, np.asarray(x, "<f4").tobytes()))
    graph += block(11, value_info("images", input_shape))
    graph += b"".join(block(12, value_info(n, x.shape)) for n, x in outputs.items())
    entries = b"".join(block(14, block(1, k) + block(2, v)) for k, v in metadata.items())
    return number(1, 8) + block(7, graph) + block(8, number(2, 13)) + entries
