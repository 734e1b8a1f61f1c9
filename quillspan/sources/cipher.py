"""Key rings, and the Salsa20 stream cipher over all blocks of a text at once."""

from __future__ import annotations

import json

import numpy as np

Keys = dict[str, bytes]

#: The cipher's constants for keys of 16 and of 32 bytes, and its rotations.
SIGMA = {16: b"expand 16-byte k", 32: b"expand 32-byte k"}
ROTATIONS = (7, 9, 13, 18)


def parsed_keys(text: str) -> Keys:
    """name -> key of a JSON object or of lines `name key`, both hexadecimal; what has another length is left out."""
    pairs = json.loads(text).items() if text.lstrip().startswith("{") else (p for p in map(str.split, text.splitlines()) if len(p) == 2)
    return {name.lower(): bytes.fromhex(key) for name, key in pairs if len(name) == 16 and len(key) == 32}


def _quarter(x: np.ndarray, a: int, b: int, c: int, d: int) -> None:
    """Each word of b, c, d, a takes in the sum of the two words before it, rotated."""
    ring = (a, b, c, d)
    for i, bits in enumerate(ROTATIONS):
        s = x[ring[i]] + x[ring[i - 1]]
        x[ring[(i + 1) % 4]] ^= (s << np.uint32(bits)) | (s >> np.uint32(32 - bits))


def key_stream(key: bytes, nonce: bytes, blocks: int) -> np.ndarray:
    """`blocks` times 64 bytes of the stream, a column of state words a block."""
    k = np.frombuffer(key * (32 // len(key)), "<u4")
    sigma, n = np.frombuffer(SIGMA[len(key)], "<u4"), np.frombuffer(nonce.ljust(8, b"\0"), "<u4")
    start = np.zeros((16, blocks), np.uint32)
    counter = np.arange(blocks, dtype=np.uint64)
    start[[0, 5, 10, 15]] = sigma[:, None]
    start[1:5], start[11:15] = k[:4, None], k[4:, None]
    start[6:8] = n[:, None]
    start[8], start[9] = counter & np.uint64(0xFFFFFFFF), counter >> np.uint64(32)
    x = start.copy()
    square = np.arange(16).reshape(4, 4)
    for _ in range(10):
        for lines in (square.T, square):
            for i in range(4):
                _quarter(x, *np.roll(lines[i], -i).tolist())
    return np.ascontiguousarray((x + start).T).astype("<u4").view(np.uint8).ravel()


def salsa20(key: bytes, nonce: bytes, data: bytes) -> bytes:
    """data under the stream of key (16 or 32 bytes) and nonce (at most 8); its own inverse."""
    stream = key_stream(key, nonce, -(-len(data) // 64))
    return (np.frombuffer(data, np.uint8) ^ stream[: len(data)]).tobytes()
