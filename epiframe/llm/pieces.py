"""Operator 3: SentencePiece encoding and decoding as weighted transduction.

A model file is compiled once per worker into a normaliser (white-space rules),
a piece transducer (arcs labelled by pieces) and byte-fallback arcs for
characters without a piece. Each input is composed with them as a lattice over
its character positions, and the encoding is the lattice's shortest path in the
tropical semiring (min, +).

* Unigram models: arc weight = negative piece score.
* BPE models: arcs weigh 0 and are composed with the acceptor of neighbouring
  pieces that the merge rules leave apart (weight infinity otherwise). A
  segmentation is the BPE result exactly when every neighbouring pair is: until a
  first merge across a boundary both texts merge alike, so it would also happen
  in the pair alone. Hence one finite path per prefix, and it is the model's
  encoding. Pair verdicts are memoised.

A text is cut where no piece can cross (before a run of spaces after a
non-space, around characters in no multi-character piece); equal cuts share one
search per worker.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiframe.llm.common import prepare_python, table

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Fixed values of the public model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MAX_CACHED = 600_000  # cuts (and pairs) remembered per worker, then the memory starts anew


def _fields(data: bytes):
    """(field number, value) pairs of one protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at:at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at:at + n]
            at += n


class Transducer:
    """A compiled model; ``encode`` and ``decode`` whole texts."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.scores: list[float] = []
        kind, spec = UNIGRAM, {}
        for f, v in _fields(model):
            if f == 1:
                p = dict(_fields(v))
                self.pieces.append(p[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.types.append(p.get(3, NORMAL))
            elif f == 2:
                kind = dict(_fields(v)).get(3, UNIGRAM)
            elif f == 3:
                spec = dict(_fields(v))
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be compiled")
        if spec.get(2):
            raise ValueError("models with a character map are not supported; use an identity normaliser")
        if USER_DEFINED in self.types:
            raise ValueError("models with user-defined symbols are not supported")
        self.bpe = kind == BPE
        self.dummy_prefix = bool(spec.get(3, 1))
        self.squeeze = bool(spec.get(4, 1))
        self.escape = bool(spec.get(5, 1))
        self.arcs = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        # every proper prefix of a piece maps to -1, a piece to its id
        self.trie = {p[:i]: -1 for p in self.arcs for i in range(1, len(p))} | self.arcs
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.byte_ids = [-1] * 256
        for i, (p, t) in enumerate(zip(self.pieces, self.types)):
            if t == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.fallback = min(self.byte_ids) >= 0
        # cost of leaving the vocabulary: dearer than any path of pieces over one character
        self.unknown_cost = 10.0 - min([s for s, t in zip(self.scores, self.types) if t == NORMAL], default=0.0)
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.arcs)
        joined = {c for p in self.arcs if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r\x0b\x0c" if c not in joined)
        self.cuts = None if crossing or not self.escape else re.compile(
            (f"[{alone}]|" if alone else "") + f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+")
        self._pairs: dict[int, bool] = {}
        self._paths: dict[str, bytes] = {}
        # bytes that each id decodes to
        self.surface = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL
            else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode("utf-8")
            for p, t in zip(self.pieces, self.types)]

    # --- normaliser ------------------------------------------------------------
    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    # --- BPE neighbours ----------------------------------------------------------
    def merges(self, s: str) -> list[str]:
        """Merge neighbours, best score first and leftmost on ties (short strings)."""
        parts = list(s)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                k = self.arcs.get(parts[i] + parts[i + 1])
                if k is not None and self.scores[k] > best:
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Weight 0 (True) or infinity (False) of piece ``b`` right after piece ``a``."""
        key = a << 32 | b
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) >= MAX_CACHED:
                self._pairs.clear()
            s, t = self._symbol(a), self._symbol(b)
            got = self._pairs[key] = self.merges(s + t) == [s, t]
        return got

    def _symbol(self, k: int) -> str:
        """Piece of an id; ids past the vocabulary are characters without a piece."""
        n = len(self.pieces)
        return self.pieces[k] if k < n else chr(k - n)

    # --- composition and shortest path -------------------------------------------
    def shortest_path(self, s: str) -> list[int]:
        """Arc ids of the cheapest path over the positions of ``s``; characters
        without a piece have ids past the vocabulary."""
        return self._only_path(s) if self.bpe else self._cheapest_path(s)

    def _arcs_at(self, s: str, i: int, n: int) -> list[tuple[int, int]]:
        """(id, end) of the arcs leaving position ``i``, shortest first."""
        trie = self.trie
        k = trie.get(s[i], -2)
        out = [(k if k >= 0 else len(self.pieces) + ord(s[i]), i + 1)]
        j = i + 1
        while k != -2 and j < n:
            j += 1
            k = trie.get(s[i:j], -2)
            if k >= 0:
                out.append((k, j))
        return out

    def _only_path(self, s: str) -> list[int]:
        """Weights are 0 or infinity and one finite path reaches any position, so a
        depth-first walk, longest arc first, that never enters a position twice finds
        the shortest path."""
        n, pairs = len(s), self._pairs
        labels = [-1]
        open_arcs = [self._arcs_at(s, 0, n)]
        entered = set()
        while True:
            arcs, before = open_arcs[-1], labels[-1]
            j = -1
            while arcs:
                k, j = arcs.pop()
                if j in entered:
                    j = -1
                    continue
                ok = pairs.get(before << 32 | k if before >= 0 else ~k)
                if ok is None:
                    ok = self._whole(k) if before < 0 else self.apart(before, k)
                if ok:
                    break
                j = -1
            if j < 0:
                open_arcs.pop()
                labels.pop()
                continue
            labels.append(k)
            if j == n:
                return labels[1:]
            entered.add(j)
            open_arcs.append(self._arcs_at(s, j, n))

    def _cheapest_path(self, s: str) -> list[int]:
        n, scores, size = len(s), self.scores, len(self.pieces)
        cost = [math.inf] * (n + 1)
        label, start = [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            for k, j in self._arcs_at(s, i, n):
                w = cost[i] + (-scores[k] if k < size else self.unknown_cost)
                if w < cost[j]:
                    cost[j], label[j], start[j] = w, k, i
        out, j = [], n
        while j > 0:
            out.append(label[j])
            j = start[j]
        return out[::-1]

    def _whole(self, k: int) -> bool:
        """Whether merging a piece's own characters gives the piece."""
        got = self._pairs.get(~k)
        if got is None:
            got = self._pairs[~k] = len(self.merges(self._symbol(k))) == 1
        return got

    def _pack(self, s: str) -> bytes:
        ids: list[int] = []
        size = len(self.pieces)
        for k in self.shortest_path(s):
            if k < size:
                ids.append(k)
            elif self.fallback:
                ids.extend(self.byte_ids[b] for b in chr(k - size).encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}i", *ids)

    def _cached(self, s: str) -> bytes:
        got = self._paths.get(s)
        if got is None:
            got = self._pack(s)
            if len(s) <= 64:
                if len(self._paths) >= MAX_CACHED:
                    self._paths.clear()
                self._paths[s] = got
        return got

    def encode_packed(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers; NULL and empty texts give none."""
        s = self.normalise(text or "")
        if self.cuts is None:
            return self._pack(s) if s else b""
        cached = self._cached
        return b"".join([cached(c) for c in self.cuts.findall(s)])

    def encode(self, text: str | None) -> list[int]:
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}i", packed))

    def decode(self, ids) -> str:
        """Concatenate surfaces, drop the dummy prefix; invalid byte runs become U+FFFD."""
        surface = self.surface
        out = b"".join([surface[i] for i in ids])
        if self.dummy_prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


_COMPILED: dict[bytes, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """The worker's transducer of a model (compiled once per process)."""
    key = hashlib.sha1(model).digest()
    if key not in _COMPILED:
        _COMPILED[key] = Transducer(model)
    return _COMPILED[key]


def _model(spark: SparkSession, path: str):
    """A model file is a fixed vocabulary (about half a megabyte), read on the driver."""
    prepare_python(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_pieces(docs: DataFrame, model_path: str = DEFAULT_MODEL, id_col: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """(id, ids): piece ids of every whole text. NULL or empty text: empty array.
    Repeated rows give repeated results; other columns are ignored."""
    held = _model(docs.sparkSession, model_path)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    schema = T.StructType([T.StructField("_id", src.schema["_id"].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        fst = compiled(held.value)
        for b in batches:
            packed = [fst.encode_packed(t.as_py()) for t in b.column(1)]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            values = np.frombuffer(b"".join(packed), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["_id", "ids"])

    return src.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def decode_pieces(encoded: DataFrame, model_path: str = DEFAULT_MODEL, id_col: str = "doc_id",
                  ids: str = "ids") -> DataFrame:
    """(id, text) of encoded rows. NULL ids: empty text."""
    held = _model(encoded.sparkSession, model_path)
    src = encoded.select(F.col(id_col).alias("_id"), F.col(ids).alias("_v"))
    schema = T.StructType([T.StructField("_id", src.schema["_id"].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa
        fst = compiled(held.value)
        for b in batches:
            out = [fst.decode(v.as_py() or ()) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["_id", "text"])

    return src.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def piece_report(docs: DataFrame, model_path: str = DEFAULT_MODEL, id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Per document: id, number of pieces and of byte pieces, SHA-256 of the ids (32-bit
    little-endian), whether decoding gives the text back (NULL text counts as empty)."""
    held = _model(docs.sparkSession, model_path)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    schema = T.StructType([
        T.StructField("_id", src.schema["_id"].dataType), T.StructField("n_pieces", T.LongType()),
        T.StructField("n_byte_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        fst = compiled(held.value)
        is_byte = np.array([t == BYTE for t in fst.types])
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for t in b.column(1):
                t = t.as_py() or ""
                packed = fst.encode_packed(t)
                ids = np.frombuffer(packed, "<i4")
                cols[0].append(len(ids))
                cols[1].append(int(is_byte[ids].sum()))
                cols[2].append(hashlib.sha256(packed).hexdigest())
                cols[3].append(fst.decode(ids.tolist()) == t)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())], names=[f.name for f in schema.fields])

    return src.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_report(table(spark, sf_dir, "documents"))
