"""SentencePiece encoding and decoding (byte-pair models with byte fallback) in numpy, whole batches at once.

A text is cut where no piece of the vocabulary spans two neighbouring characters (in front of words,
around digits), which no merge can cross. The distinct words between the cuts are arrays of symbols,
end to end. In each round every word finds the pair of neighbours of the least rank and merges its
leftmost occurrence, all words at once; words without a pair are put by, the others compacted, until
none is left. Each word thus takes the very merges, in the very order, that the library takes.

Results for odd input: a null or empty text has no pieces (only the end id, if asked for). Every text
decodes to itself, but for U+2581, which the model takes for a space. A text without a place to cut,
however long, is one word; words of more than LONG symbols take their merges from a heap, in the same
order. Repeated rows give equal results. An empty table gives an empty result. Extra columns are kept;
columns named like a result are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.llm.blocks import row_ranges

SPACE = "▁"
#: Symbols of a word that takes part in the rounds, at most.
LONG = 256
#: Bytes of texts, as they are before, that are cut into words at once.
CHUNK_BYTES = 1 << 20
#: Characters that are no pieces are this and their code point.
_CHAR = 1 << 21
_NONE = np.iinfo(np.int32).max


class Model:
    """Lookup tables of a model: its size is the vocabulary's, whatever the texts."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(proto)
        norm, kinds = spec.normalizer_spec, pb.ModelProto.SentencePiece
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if spec.trainer_spec.model_type != pb.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback or not plain or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a byte-pair model with byte fallback and without normalization is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces aren't known here")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        kind = np.array([p.type for p in spec.pieces])
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.end = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL and p.piece == (spec.trainer_spec.eos_piece or "</s>"))
        self.control, self.byte = kind == kinds.CONTROL, kind == kinds.BYTE
        self.byte_id = np.zeros(256, np.int32)
        surfaces = []
        for i, p in enumerate(spec.pieces):
            if self.byte[i]:
                value = int(p.piece[1:-1], 16)
                self.byte_id[value] = i
                surfaces.append(bytes([value]))
            elif self.control[i]:
                surfaces.append(b"")
            else:
                surfaces.append((p.piece.replace(SPACE, " ") if p.type == kinds.NORMAL else spec.trainer_spec.unk_surface).encode())
        self.surfaces = pa.array(surfaces, pa.large_binary())
        self.opens = np.array([s[:1] == b" " and p.type == kinds.NORMAL for s, p in zip(surfaces, spec.pieces, strict=True)])
        self.symbol = np.arange(_CHAR, _CHAR + 0x110000, dtype=np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        scores = np.array([p.score for p in spec.pieces], np.float64)
        rank = np.unique(-scores, return_inverse=True)[1]
        of = lambda x: int(self.symbol[ord(x)]) if len(x) == 1 else normal.get(x, -1)
        pairs = sorted((of(z[:k]) << 22 | of(z[k:]), i) for z, i in normal.items() for k in range(1, len(z)) if of(z[:k]) >= 0 and of(z[k:]) >= 0)
        self.pair = np.array([k for k, _ in pairs], np.int64)
        self.merged = np.array([i for _, i in pairs], np.int32)
        self.pair_rank = rank[self.merged].astype(np.int32)
        beside = {(ord(a), ord(b)) for z in normal for a, b in zip(z, z[1:], strict=False)}
        self.beside = np.array(sorted(a << 21 | b for a, b in beside), np.int64)
        # Between bytes of ASCII characters a cut can be told without decoding. A space is there for U+2581.
        self.cuts = np.zeros(1 << 16, bool)
        as_char = lambda b: ord(SPACE) if b == 32 else b
        for a in range(128):
            for b in range(128):
                self.cuts[a << 8 | b] = (as_char(a), as_char(b)) not in beside

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; _NONE if there is no such piece."""
        key = left.astype(np.int64) << 22 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        found = self.pair[at] == key
        return np.where(found, self.pair_rank[at], np.int32(_NONE)), self.merged[at]


@lru_cache(maxsize=4)
def _model(proto: bytes) -> Model:
    return Model(proto)


def _heap_merges(sym: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of one word after all merges, and their places; least rank first, of equal ones the leftmost."""
    symbols, n = sym.tolist(), len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def push(left: np.ndarray | list, right: list) -> None:
        rank, merged = model.ranks(np.array([symbols[i] for i in left]), np.array([symbols[i] for i in right]))
        for k in np.flatnonzero(rank != _NONE):
            heapq.heappush(heap, (int(rank[k]), left[k], symbols[left[k]], symbols[right[k]], int(merged[k])))

    push(list(range(n - 1)), list(range(1, n)))
    while heap:
        _, i, a, b, piece = heapq.heappop(heap)
        j = after[i] if symbols[i] == a else n
        if j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j], after[i] = piece, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        near = [(x, y) for x, y in ((before[i], i), (i, after[i])) if x >= 0 and y < n]
        if near:
            push([x for x, _ in near], [y for _, y in near])
    left = np.array([i for i in range(n) if symbols[i] >= 0])
    return left, np.array([symbols[i] for i in left], np.int32)


def merge_rounds(sym: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    """The symbols of all words after their merges, each at its first character's place; -1 at other places.

    sym: symbols of all words, end to end; starts: where each word begins.
    """
    out = np.full(len(sym), -1, np.int32)
    lengths = np.diff(np.append(starts, len(sym)))
    for w in np.flatnonzero(lengths > LONG):
        at, left = _heap_merges(sym[starts[w] : starts[w] + lengths[w]], model)
        out[starts[w] + at] = left
    short = np.repeat(lengths <= LONG, lengths)
    place, word = np.flatnonzero(short), np.repeat(np.arange(len(starts)), lengths)[short]
    sym = sym[short]
    rank, merged = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner], merged[inner] = model.ranks(sym[inner], sym[inner + 1])
    while len(sym):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        count = np.diff(np.append(first, len(sym)))
        least = np.minimum.reduceat(rank, first)
        going = np.repeat(least != _NONE, count)
        out[place[~going]] = sym[~going]
        hit = np.flatnonzero(going & (rank == np.repeat(least, count)))
        hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])] if len(hit) else hit
        sym[hit] = merged[hit]
        keep = going
        keep[hit + 1] = False
        moved = np.cumsum(keep) - 1
        rank[hit] = _NONE
        sym, place, word, rank, merged = sym[keep], place[keep], word[keep], rank[keep], merged[keep]
        hit = moved[hit]
        for left in (hit[hit > 0] - 1, hit[hit < len(sym) - 1]):
            same = word[left] == word[left + 1]
            rank[left[~same]] = _NONE
            left = left[same]
            rank[left], merged[left] = model.ranks(sym[left], sym[left + 1])
    return out


def _pieces_of_words(words: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces of all words, end to end, and how many each word has."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    points[points == 32] = ord(SPACE)
    firsts = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets - offsets[0]]
    begins = np.zeros(len(points) + 1, bool)
    begins[firsts] = True
    beside = points[:-1] << 21 | points[1:]
    at = np.minimum(np.searchsorted(model.beside, beside), len(model.beside) - 1)
    parts = begins[:-1].copy()
    parts[1:] |= model.beside[at] != beside
    out = merge_rounds(model.symbol[points], np.flatnonzero(parts), model)
    place = np.flatnonzero(out >= 0)
    sym = out[place]
    word = np.searchsorted(firsts, place, "right") - 1
    # Characters that are no pieces become the pieces of their bytes.
    point = np.where(sym >= _CHAR, sym - _CHAR, 0)
    size = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
    ids, owner = np.repeat(sym, size), np.repeat(word, size)
    rest = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(ids))  # bytes of the character that follow
    lead = np.append(True, np.repeat(np.arange(len(sym)), size)[1:] != np.repeat(np.arange(len(sym)), size)[:-1]) if len(ids) else np.zeros(0, bool)
    of = np.repeat(point, size)
    many = np.repeat(size, size)
    value = np.where(lead, np.where(many == 1, 0, 0xF00 >> many) & 0xFF | of >> 6 * rest, 0x80 | of >> 6 * rest & 0x3F)
    ids = np.where(ids >= _CHAR, model.byte_id[value & 0xFF], ids)
    return ids.astype(np.int32), np.bincount(owner, minlength=len(words))


def _chunks(data: np.ndarray, rows: np.ndarray, model: Model) -> Iterator[tuple[int, np.ndarray]]:
    """Where each chunk begins, and the places of its cuts in the bytes (its own begin first, its end last)."""
    first = 0
    while first < len(data):
        step = CHUNK_BYTES
        while True:
            end = min(first + step, len(data))
            part = data[first:end]
            cuts = np.zeros(len(part) + 1, bool)
            cuts[1 : len(part)] = model.cuts[part[:-1].astype(np.uint16) << 8 | part[1:]]
            cuts[rows[np.searchsorted(rows, first, "left") : np.searchsorted(rows, end, "right")] - first] = True
            cuts[0] = True
            if end == len(data):
                cuts[-1] = True
            places = np.flatnonzero(cuts)
            if len(places) > 1:
                break
            step *= 2  # one word is longer than all this
        yield first, first + places
        first += int(places[-1])


def encode_array(texts: pa.Array, model: Model, end: bool = True) -> pa.ListArray:
    """The ids of each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pc.replace_substring(texts, SPACE, " ")
    if model.prefix:
        space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(space, texts, none))
    _, offsets, data = texts.buffers()
    rows = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[rows[0] : rows[-1]] if rows[-1] > rows[0] else np.zeros(0, np.uint8)
    rows = rows - rows[0]
    found, before = [], np.zeros(len(rows), np.int64)
    total = 0
    for first, places in _chunks(data, rows, model):
        part = data[first : places[-1]]
        words = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places - first), pa.py_buffer(part)])
        words = words.dictionary_encode()
        pieces, counts = _pieces_of_words(words.dictionary, model)
        which = words.indices.to_numpy()
        lengths, starts = counts[which], np.cumsum(counts) - counts
        ends = np.cumsum(lengths)
        found.append(pieces[np.repeat(starts[which] - ends + lengths, lengths) + np.arange(ends[-1])])
        own = np.arange(np.searchsorted(rows, first, "left"), np.searchsorted(rows, places[-1], "left"))
        before[own] = total + np.append(0, ends)[np.searchsorted(places, rows[own])]
        total += int(ends[-1])
    before[np.searchsorted(rows, len(data), "left") :] = total
    ids = np.concatenate(found) if found else np.zeros(0, np.int32)
    if end:
        ids = np.insert(ids, before[1:], model.end)
        before = before + np.arange(len(before))
    return pa.LargeListArray.from_arrays(pa.array(before), pa.array(ids.astype(np.int32)))


def _decoded_alone(ids: list[int], model: Model) -> str:
    """One row's text where its bytes are no whole characters: each bad byte gives U+FFFD."""
    out, run, opening = [], bytearray(), True
    for i in [*ids, -1]:
        if i >= 0 and model.byte[i]:
            run += model.surfaces[i].as_py()
            opening = False
            continue
        at = 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[at : at + size]).decode("utf-8"))
                except UnicodeDecodeError:
                    continue
                break
            else:
                out.append("�")
                size = 1
            at += size
        run.clear()
        if i >= 0 and not model.control[i]:
            surface = model.surfaces[i].as_py().decode()
            out.append(surface[1:] if opening and model.opens[i] and model.prefix else surface)
            opening = False
    return "".join(out)


def decode_array(ids: pa.Array, model: Model) -> pa.Array:
    """The text of each list of ids; null for null."""
    nulls = ids.is_null()
    ids = pc.fill_null(ids, []).cast(pa.large_list(pa.int32()))
    flat = ids.flatten().to_numpy()
    ends = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False), dtype=np.int64))
    taken = model.surfaces.take(pa.array(flat))
    _, offsets, data = taken.buffers()
    offsets = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(flat) else np.zeros(0, np.uint8)
    rows = (offsets - offsets[0])[ends]
    said = np.flatnonzero(~model.control[flat])
    at = np.searchsorted(said, ends[:-1])
    opening = np.append(said, len(flat))[at]  # the first piece of each row that isn't a control piece
    opening = opening[opening < ends[1:]]
    drop = (offsets - offsets[0])[opening[model.opens[flat[opening]]]] if model.prefix else np.zeros(0, np.int64)
    data = np.delete(data, drop)
    rows = rows - np.searchsorted(drop, rows)
    try:
        data.tobytes().decode("utf-8")
        odd = np.zeros(len(rows) - 1, bool)
        begins = rows[:-1][rows[:-1] < len(data)]
        odd[np.flatnonzero(rows[:-1] < len(data))[(data[begins] & 0xC0) == 0x80]] = True
        if odd.any():
            odd[:] = True
    except UnicodeDecodeError:
        odd = np.ones(len(rows) - 1, bool)
    control = np.flatnonzero(model.control[flat])
    row = np.searchsorted(ends, control, "right") - 1
    odd[row[control != ends[row + 1] - 1]] = True  # a control piece parts the bytes beside it
    texts = pa.Array.from_buffers(pa.large_string(), len(rows) - 1, [None, pa.py_buffer(rows), pa.py_buffer(data)])
    if odd.any():
        alone = [_decoded_alone(flat[ends[i] : ends[i + 1]].tolist(), model) if o else None for i, o in enumerate(odd)]
        safe = [None if o else bytes(data[rows[i] : rows[i + 1]]).decode() for i, o in enumerate(odd)]
        texts = pa.array([a if a is not None else s for a, s in zip(alone, safe, strict=True)], pa.large_string())
    return pc.if_else(nulls, pa.scalar(None, pa.large_string()), texts)


def _proto(path: str) -> bytes:
    return Path(path).read_bytes()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, end: bool = True) -> DataFrame:
    """docs with the ids of the text's pieces; with decoded, also the text that the ids stand for.

    path: the model's file, read by the driver; its tables (as large as the vocabulary) go to the tasks.
    """
    proto = docs.sparkSession.sparkContext.broadcast(_proto(path))
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    # The text goes beside the columns that stay, so that one of them may be replaced.
    source = docs.select(F.col(text).alias("__text"), F.struct(*kept).alias("__kept"))
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(proto.value)
        for batch in batches:
            for first, stop in row_ranges(batch.column("__text")):
                part = batch.slice(first, stop - first)
                found = encode_array(part.column("__text"), model, end)
                out = [part.column("__kept"), found.cast(pa.list_(pa.int32()))]
                if decoded:
                    out.append(decode_array(found, model).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["__kept", *[f.name for f in fields]])

    schema = T.StructType([T.StructField("__kept", source.schema["__kept"].dataType), *fields])
    return source.mapInArrow(run, schema).select(*[F.col("__kept")[c].alias(c) for c in kept], ids, *([decoded] if decoded else []))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the text that the ids stand for; ids outside the vocabulary are an error."""
    proto = df.sparkSession.sparkContext.broadcast(_proto(path))
    kept = [c for c in df.columns if c != text]
    source = df.select(F.col(ids).alias("__ids"), F.struct(*kept).alias("__kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(proto.value)
        for batch in batches:
            texts = decode_array(batch.column("__ids"), model).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("__kept"), texts], ["__kept", text])

    schema = T.StructType([T.StructField("__kept", source.schema["__kept"].dataType), T.StructField(text, T.StringType())])
    return source.mapInArrow(run, schema).select(*[F.col("__kept")[c].alias(c) for c in kept], text)
