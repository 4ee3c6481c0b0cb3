"""Model files in the GGUF format: metadata, labels and tensors, read on the driver."""

from __future__ import annotations

import re
import struct
from pathlib import Path

import numpy as np

from spanloom.operators.forward import Config, dequantise_q8, missing_tensors, quantise_q8

_SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
STRING, ARRAY = 8, 9
F32, F16, Q8_0 = 0, 1, 8

#: Field of Config, key behind the architecture's name, type.
KEYS = (
    ("layers", "block_count", int), ("width", "embedding_length", int), ("heads", "attention.head_count", int), ("kv_heads", "attention.head_count_kv", int),
    ("head_dim", "attention.key_length", int), ("expert_width", "expert_feed_forward_length", int), ("experts", "expert_count", int), ("experts_used", "expert_used_count", int),
    ("radius", "attention.sliding_window", int), ("context", "context_length", int), ("context_original", "rope.scaling.original_context_length", int), ("classes", "embedding_length_out", int),
    ("eps", "attention.layer_norm_rms_epsilon", float), ("rope_base", "rope.freq_base", float), ("yarn_factor", "rope.scaling.factor", float),
    ("beta_fast", "rope.scaling.yarn_beta_fast", float), ("beta_slow", "rope.scaling.yarn_beta_slow", float),
)
TRUNCATE, LABELS = "rope.scaling.yarn_truncate", "classifier.output_labels"


class ModelFileError(ValueError):
    """The file isn't a model this package can run; the message says why."""


class ModelFile:
    """Metadata of a file; tensors are mapped when they are asked for."""

    def __init__(self, path: str, arch: str | None = None):
        self.path = str(path)
        try:
            self._raw = np.memmap(self.path, np.uint8, mode="r")
        except (OSError, ValueError) as e:
            raise ModelFileError(f"can't read {self.path}: {e}") from e
        try:
            self._parse()
        except (struct.error, IndexError, UnicodeDecodeError, KeyError) as e:
            raise ModelFileError(f"{self.path} is damaged: {e!r}") from e
        self.arch = self.value("general.architecture")
        if arch is not None and arch != self.arch:
            raise ModelFileError(f"architecture is {self.arch!r}, not {arch!r}")
        own = {f: kind(self.value(f"{self.arch}.{key}")) for f, key, kind in KEYS}
        self.config = Config(**own, truncate=bool(self.metadata.get(f"{self.arch}.{TRUNCATE}", False)))
        self.labels = self.value(f"{self.arch}.{LABELS}")
        if not isinstance(self.labels, list) or not all(isinstance(x, str) for x in self.labels):
            raise ModelFileError(f"{LABELS} is no list of strings")
        if len(self.labels) != self.config.classes:
            raise ModelFileError(f"{len(self.labels)} labels for {self.config.classes} classes")

    def _parse(self) -> None:
        if bytes(self._raw[:4]) != b"GGUF":
            raise ModelFileError(f"{self.path} isn't a GGUF file")
        self._at = 4
        version, tensors, pairs = self._scalar("<I"), self._scalar("<Q"), self._scalar("<Q")
        if version not in (2, 3):
            raise ModelFileError(f"version {version} isn't known")
        self.metadata = {}
        for _ in range(pairs):
            key = self._string()
            self.metadata[key] = self._value(self._scalar("<I"))
        self.tensors = {}
        for _ in range(tensors):
            name = self._string()
            shape = tuple(self._scalar("<Q") for _ in range(self._scalar("<I")))[::-1]
            self.tensors[name] = (shape, self._scalar("<I"), self._scalar("<Q"))
        step = int(self.metadata.get("general.alignment", 32))
        self._data = -(-self._at // step) * step

    def _scalar(self, form: str):
        n = struct.calcsize(form)
        (x,) = struct.unpack(form, bytes(self._raw[self._at : self._at + n]))
        self._at += n
        return x

    def _string(self) -> str:
        n = self._scalar("<Q")
        if self._at + n > len(self._raw):
            raise ModelFileError(f"{self.path} ends too early")
        x = bytes(self._raw[self._at : self._at + n]).decode("utf-8")
        self._at += n
        return x

    def _value(self, kind: int):
        if kind == STRING:
            return self._string()
        if kind == ARRAY:
            inner, n = self._scalar("<I"), self._scalar("<Q")
            return [self._value(inner) for _ in range(n)]
        return self._scalar(_SCALARS[kind])

    def value(self, key: str):
        if key not in self.metadata:
            raise ModelFileError(f"{key} is missing")
        return self.metadata[key]

    def tensor(self, name: str) -> np.ndarray | None:
        """None if there is none; f32 is mapped, other types are turned into it."""
        if name not in self.tensors:
            return None
        shape, kind, offset = self.tensors[name]
        n, at = int(np.prod(shape)), self._data + offset
        sizes = {F32: 4 * n, F16: 2 * n, Q8_0: n // 32 * 34}
        if kind not in sizes or at + sizes[kind] > len(self._raw):
            raise ModelFileError(f"tensor {name}: type {kind} isn't known, or it lies beyond the file's end")
        part = self._raw[at : at + sizes[kind]]
        if kind == F32:
            return part.view(np.float32).reshape(shape)
        if kind == F16:
            return part.view(np.float16).astype(np.float32).reshape(shape)
        blocks = np.asarray(part).reshape(-1, 34)
        return dequantise_q8(np.ascontiguousarray(blocks[:, :2]).view(np.float16).ravel(), np.ascontiguousarray(blocks[:, 2:]).view(np.int8)).reshape(shape)

    def weights(self) -> dict[str, np.ndarray]:
        """Every tensor that the forward pass needs; fails if one is missing."""
        if gone := missing_tensors(self.config, self.tensors):
            raise ModelFileError(f"missing tensors: {', '.join(gone[:3])}")
        return {k: self.tensor(k) for k in self.tensors}

    def info(self) -> dict:
        """What a summary shows."""
        return {"path": self.path, "arch": self.arch, "labels": len(self.labels), "tensors": len(self.tensors), **self.config.as_row()}


def write_gguf(path: str, metadata: dict, tensors: dict[str, np.ndarray], q8: frozenset[str] = frozenset()) -> None:
    """A small writer: int, float, bool, string and string-list metadata; tensors as f32, f16, or Q8_0 where named."""

    def text(s: str) -> bytes:
        b = s.encode()
        return struct.pack("<Q", len(b)) + b

    def value(x) -> bytes:
        if isinstance(x, bool):
            return struct.pack("<I?", 7, x)
        if isinstance(x, int):
            return struct.pack("<II", 4, x)
        if isinstance(x, float):
            return struct.pack("<If", 6, x)
        if isinstance(x, str):
            return struct.pack("<I", STRING) + text(x)
        return struct.pack("<IIQ", ARRAY, STRING, len(x)) + b"".join(map(text, x))

    head, body = [b"GGUF", struct.pack("<IQQ", 3, len(tensors), len(metadata))], b""
    head += [text(k) + value(v) for k, v in metadata.items()]
    for name, x in tensors.items():
        if name in q8:
            scale, q = quantise_q8(x)
            kind, raw = Q8_0, np.concatenate([scale.view(np.uint8).reshape(-1, 2), q.view(np.uint8)], axis=1).tobytes()
        else:
            kind, raw = (F16, x.tobytes()) if x.dtype == np.float16 else (F32, x.astype(np.float32).tobytes())
        head.append(text(name) + struct.pack(f"<I{x.ndim}QIQ", x.ndim, *x.shape[::-1], kind, len(body)))
        body += raw + b"\0" * (-len(raw) % 32)
    front = b"".join(head)
    Path(path).write_bytes(front + b"\0" * (-len(front) % 32) + body)


def requantised(source: str, target: str, names: str) -> list[str]:
    """Writes a model file again with the weights whose names match the pattern ``names`` as Q8_0; their names.

    A tensor whose rows aren't whole blocks of 32 stays as it is, and so do
    norms, biases and sinks, which are of one dimension.
    """
    f = ModelFile(source)
    tensors = {k: f.tensor(k) for k in f.tensors}
    chosen = [k for k, x in tensors.items() if re.search(names, k) and x.ndim > 1 and x.shape[-1] % 32 == 0]
    write_gguf(target, f.metadata, tensors, frozenset(chosen))
    return chosen


def metadata_of(config: Config, labels: list[str], arch: str) -> dict:
    """Metadata that ModelFile reads back as the config."""
    own = config.as_row()
    return {"general.architecture": arch, **{f"{arch}.{key}": kind(own[f]) for f, key, kind in KEYS}, f"{arch}.{TRUNCATE}": config.truncate, f"{arch}.{LABELS}": labels}
