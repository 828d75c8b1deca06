"""N-gram Jaccard join by parity sketches.

Each distinct shingle of a document flips bits of a sketch (XOR), so that the Hamming distance of two
sketches is at most the size of the sets' symmetric difference. Sets that link differ by few shingles:
|A xor B| <= t, where t follows from the sizes and the similarity. Per band of sizes the sketch is
dealt to blocks, more than t of them; t differences spoil t blocks at most, so linked sets have equal
blocks (pigeonhole) and meet in a join on (band, block, value). A set that has more blocks of a
given weight than differences from any partner sends only those: one of them is unspoiled, and so as
heavy in the other set. Blocks of a single, maybe common, shingle are so left out. Pairs that
meet pass a test of the Hamming distance of short sketches and are then verified exactly.

Blocks are carried as packed numpy arrays, one per slice of documents and target partition. Sets that
are equal are one class throughout. A bucket of many classes isn't expanded into pairs: its members are
linked with one of them, and then those buckets whose members are not in one component yet (found by
numbers alone, and each set of members once) get the members' sketches and are compared in tiles inside
the tasks, so that every pair is looked at but only what may link is a row. Pairs that pass are verified
on their whole texts, one pair of each class first, then those across components. Sets are compared as
64-bit hashes of shingles.

Results for odd input: a null or empty text, or one without words, has an empty set and links with
nothing. Fewer words than n are one shingle. Rows without doc_id take part in links, but name no
component; repeated rows are in one class. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.llm.blocks import ASCII_LOWER, distinct, hashes, mix, shingles, slices, words
from sedgeline.llm.common import compact, cut, partitions, row_key, with_possible, without
from sedgeline.llm.components import components

#: Bits of the short sketch by which pairs are tested before their sets are compared.
SKETCH_BITS = 2048
#: Bits of the folded sketch that every pair that meets carries.
FOLDED_BITS = 256
#: Buckets of up to so many classes are compared pair by pair at once, larger ones by hubs in rounds.
SMALL_BUCKET = 24
#: Members of a large bucket on one side of a tile in which sketches are compared.
CHUNK = 1024
#: Bytes of blocks that one task brings together, about.
PART_BYTES = 32 << 20


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of a text column: first and end row; row (from 0) and hash of each distinct shingle; set sizes."""
    for first, end, data, rows in slices(column):
        lower = ASCII_LOWER[data]
        starts, ends, counts = words(lower, rows)
        yield first, end, *distinct(*shingles(hashes(lower, starts, ends), counts, n), end - first)


def _fold(ufunc: np.ufunc, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """ufunc over each row's values, 0 for rows without any."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = ufunc.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def digests(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set: XOR and sum of differently mixed shingles."""
    seeded = values ^ np.uint64(0xD1B54A32D192ED03)
    return _fold(np.bitwise_xor, mix(values), sizes), _fold(np.add, mix(seeded), sizes)


class Bands:
    """Size bands, and what a band's join needs: the number of blocks, more than the differences, and the least weight.

    Linked sets are in one band or in neighbouring ones. Join b is for pairs whose larger set is in
    band b; sets of band b - 1 that a set of band b can link with take part.
    """

    def __init__(self, percent: int, largest: int):
        low = [1]
        while low[-1] <= largest:
            low.append(low[-1] * 100 // percent + 1)
        self.percent, self.low = percent, np.array(low, np.int64)
        self.high = np.append(self.low[1:] - 1, 0)
        most = 2 * self.high * (100 - percent) // (100 + percent)
        few = percent < 87
        spread = np.maximum(most + 1, np.floor(self.high / (3.5 if few else 7.0)).astype(np.int64))
        tight = np.where(most == 0, 1, 2 * (most + 1))
        self.blocks = np.where(self.high <= 64, tight, spread)
        self.weight = np.where(self.high <= 64, 1, 2 if few else 4)

    def differences(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """At most so many shingles are in one only of a set of this size and any set that it links with in the band's join."""
        largest = np.minimum(np.maximum(self.high[band], sizes), sizes * 100 // self.percent)
        return (sizes + largest) * (100 - self.percent) // (100 + self.percent)

    def joins(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own band, whether the set also takes part in the next one's join)."""
        own = np.searchsorted(self.low, sizes, "right") - 1
        return own, sizes * 100 >= self.low[np.minimum(own + 1, len(self.low) - 1)] * self.percent


def block_keys(row: np.ndarray, value: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Row and key (join, block, content) of every block that is sent."""
    own, upward = bands.joins(np.maximum(sizes, 1))
    rows_out, keys_out = [], []
    for band, takes_part in ((own, sizes > 0), (own + 1, (sizes > 0) & upward)):
        band = np.minimum(band, len(bands.low) - 1)
        blocks = np.where(takes_part, bands.blocks[band], 0)
        first = np.cumsum(blocks) - blocks
        total = int(blocks.sum())
        if not total:
            continue
        mine = takes_part[row]
        r, v = row[mine], value[mine]
        at = first[r] + (((v >> np.uint64(32)) * blocks[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        content, weight = np.zeros(total, np.uint64), np.bincount(at, minlength=total)
        np.bitwise_xor.at(content, at, mix(v + np.uint64(0x243F6A8885A308D3)))
        owner = np.repeat(np.arange(len(sizes)), blocks)
        heavy = weight >= bands.weight[band][owner]
        enough = np.bincount(owner[heavy], minlength=len(sizes)) > bands.differences(sizes, band)
        sent = np.flatnonzero(heavy | ~enough[owner])
        owner = owner[sent]
        place = (band[owner].astype(np.uint64) << np.uint64(32)) + (sent - first[owner]).astype(np.uint64)
        rows_out.append(owner)
        keys_out.append(mix(content[sent] ^ mix(place)))
    if not rows_out:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(rows_out), np.concatenate(keys_out)


def short_sketches(row: np.ndarray, value: np.ndarray, n_rows: int) -> list[bytes]:
    """SKETCH_BITS bits for each set: the parity of the shingles that fall on each bit. row is ascending."""
    bit = (mix(value ^ np.uint64(0x452821E638D01377)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    found = []
    for first in range(0, n_rows, 512):
        n = min(512, n_rows - first)
        i, j = np.searchsorted(row, [first, first + n])
        odd = (np.bincount((row[i:j] - first) * SKETCH_BITS + bit[i:j], minlength=n * SKETCH_BITS) & 1).astype(bool)
        found += [x.tobytes() for x in np.packbits(odd.reshape(n, SKETCH_BITS), axis=1)]
    return found


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, row, value, sizes in shingle_sets(batch.column("text"), n):
                d1, d2 = digests(value, sizes)
                sketches = np.concatenate([np.frombuffer(x, np.int64) for x in short_sketches(row, value, end - first)])
                stops = pa.array(np.arange(end - first + 1, dtype=np.int32) * (SKETCH_BITS // 64))
                arrays = [batch.column(c)[first:end] for c in ("doc_id", "text_hash")] + [pa.array(x.astype(np.int64)) for x in (sizes, d1.view(np.int64), d2.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(stops, pa.array(sketches))], ["doc_id", "text_hash", "n_shingles", "d1", "d2", "sketch"])

    return run


def _send(n: int, bands: Bands, parts: int):
    """Packed blocks: per slice and part, keys and the first half of the digest of the set each belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()  # classes that this task has sent: copies go once
        for batch in batches:
            for _first, _end, row, value, sizes in shingle_sets(batch.column("text"), n):
                d1, d2 = digests(value, sizes)
                fresh = np.zeros(len(sizes), bool)
                for i, name in enumerate(zip(d1.tolist(), d2.tolist(), strict=True)):
                    if sizes[i] and name not in sent:
                        sent.add(name)
                        fresh[i] = True
                mine = fresh[row]
                owner, key = block_keys(row[mine], value[mine], np.where(fresh, sizes, 0), bands)
                if not len(key):
                    continue
                part = (key % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part.astype(np.uint16) if parts <= 65536 else part, kind="stable")
                part, key, owner = part[order], key[order] >> np.uint64(16), owner[order]
                starts = np.flatnonzero(np.diff(part, prepend=-1))
                stops = np.append(starts[1:], len(part))
                packed = []
                for i, j in zip(starts, stops, strict=True):
                    # Six bytes of each key, a number for its set, and the sets' names.
                    sets, number = np.unique(owner[i:j], return_inverse=True)
                    six = key[i:j].view(np.uint8).reshape(-1, 8)[:, :6]
                    packed.append(np.array([j - i, len(sets)], np.int64).tobytes() + d1[sets].tobytes() + number.astype(np.uint32 if len(sets) > 65535 else np.uint16).tobytes() + six.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(packed, pa.binary())], ["part", "packed"])

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, n_sets = np.frombuffer(blob, np.int64, 2)
    names = np.frombuffer(blob, np.uint64, n_sets, 16)
    kind = np.dtype(np.uint32 if n_sets > 65535 else np.uint16)
    at = 16 + 8 * int(n_sets)
    number = np.frombuffer(blob, kind, n, at)
    key = np.zeros((int(n), 8), np.uint8)
    key[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at + kind.itemsize * int(n)).reshape(-1, 6)
    return key.view(np.uint64).ravel(), names[number]


def _meet(small: int):
    """Pairs of sets that share a block in this part. Of large buckets: each member with the hub, and the bucket itself (bucket not null)."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        found = [_unpack(b.as_buffer()) for b in table.column("packed")] if table.num_rows else []
        key, name = np.concatenate([k for k, _ in found]), np.concatenate([x for _, x in found])
        del found
        order = np.argsort(key, kind="stable")
        key, name = key[order], name[order]
        same = key[1:] == key[:-1]
        shared = np.zeros(len(key), bool)
        shared[1:] |= same
        shared[:-1] |= same
        key, name = key[shared], name[shared]
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        if len(key):
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            key, name = key[new], name[new]
        starts = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1))) if len(key) else np.empty(0, np.int64)
        length = np.diff(np.append(starts, len(key)))
        run_start, run_length = np.repeat(starts, length), np.repeat(length, length)
        left, right = [], []
        for k in range(1, min(small, int(length.max(initial=1)))):
            i = np.flatnonzero((key[k:] == key[:-k]) & (run_length[k:] <= small))
            left.append(name[i])
            right.append(name[i + k])
        large = np.flatnonzero((run_length > small) & (run_start < np.arange(len(key))))
        left.append(name[run_start[large]])
        right.append(name[large])
        pairs = np.stack([np.concatenate(left), np.concatenate(right)], axis=1)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        if len(pairs):
            pairs = pairs[np.append(True, np.any(pairs[1:] != pairs[:-1], axis=1))]
        members = np.flatnonzero(run_length > small)
        bucket = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(mix(key[members] ^ mix(np.full(len(members), part, np.uint64))).view(np.int64))])
        a = np.concatenate([pairs[:, 0], name[members]]).view(np.int64)
        b = np.concatenate([pairs[:, 1], name[members]]).view(np.int64)
        return pa.table({"bucket": bucket, "a": pa.array(a), "b": pa.array(b)})

    return run


def _apart_bits(words: int) -> Column:
    """Hamming distance of a_bits and b_bits, arrays of so many 64-bit words."""
    return sum((F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])) for i in range(words)), F.lit(0))


def _folded(sketch: str) -> Column:
    """FOLDED_BITS bits of the sketch by XOR of its parts: again parities, so that distances don't grow."""
    words, step = SKETCH_BITS // 64, FOLDED_BITS // 64
    return F.array(*[reduce(Column.bitwiseXOR, [F.col(sketch)[k] for k in range(i, words, step)]) for i in range(step)])


def _candidates(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b of d1), (u, v: ids, u the greater) whose sizes and whose sketches' Hamming distance allow a link.

    All pairs carry folded sketches only; whole ones go with those that pass the test on these.
    """
    small, large = F.least("a_n_shingles", "b_n_shingles"), F.greatest("a_n_shingles", "b_n_shingles")
    most = F.floor((F.col("a_n_shingles") + F.col("b_n_shingles")) * (100 - percent) / (100 + percent))
    for on, bits, width in (("d1", _folded("sketch"), FOLDED_BITS), ("id", F.col("sketch"), SKETCH_BITS)):
        described = classes.select(F.col(on).alias("on"), "id", "n_shingles", bits.alias("bits"))
        sides = [described.select(*[F.col(c).alias(f"{x}_{c}") for c in described.columns]) for x in "ab"]
        near = pairs.join(sides[0], F.col("a") == F.col("a_on")).join(sides[1], F.col("b") == F.col("b_on"))
        near = near.filter((small * 100 >= large * percent) & (_apart_bits(width // 64) <= most))
        pairs = near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _whole(texts: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text: one text of each class in ids (id). Only texts that may be wanted are shuffled."""
    wanted = cut(classes.join(ids, "id", "left_semi").select("id", F.col("doc.doc_id").alias("w_doc"), F.col("doc.text_hash").alias("w_hash")))
    possible = with_possible(texts, wanted.select(F.col("w_hash").alias("text_hash")), "text_hash", "possible").filter("possible")
    found = possible.join(wanted, possible["doc_id"].eqNullSafe(wanted["w_doc"]) & (possible["text_hash"] == wanted["w_hash"]))
    return found.select("id", "text").dropDuplicates(["id"])  # repeated rows of a document


def _verify(whole: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (u, v), the links, by the sets of their whole texts."""
    both = pairs.join(whole.select(F.col("id").alias("u"), F.col("text").alias("u_text")), "u")
    both = both.join(whole.select(F.col("id").alias("v"), F.col("text").alias("v_text")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u_sets, v_sets = (_sets(batch.column(c), n) for c in ("u_text", "v_text"))
            links = []
            for i, (x, y) in enumerate(zip(u_sets, v_sets, strict=True)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common * 100 >= (len(x) + len(y) - common) * percent:
                    links.append(i)
            yield batch.select(["u", "v"]).take(pa.array(links, pa.int64()))

    return both.select("u", "v", "u_text", "v_text").mapInArrow(run, "u long, v long")


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    for _first, _end, _row, value, sizes in shingle_sets(column, n):
        yield from np.split(value, np.cumsum(sizes)[:-1])


def similar(
    docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", small: int = SMALL_BUCKET, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Four frames: members (doc_id, text_hash, n_shingles, d1, d2), classes (id, n_shingles, d1, d2) of sets that met
    others, links (u, v: ids), groups (node, component: ids).

    links are enough of all links for the components: those within one that others make needless aren't looked at.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    texts = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("text_hash"), F.col(text).alias("text"))
    members = cut(texts.mapInArrow(_describe(n), "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sketch array<long>"))
    largest, every = members.agg(F.max("n_shingles"), F.sum("n_shingles")).first()
    bands = Bands(percent, int(largest or 1))
    parts = max(partitions(docs.sparkSession), int(every or 0) * 5 // PART_BYTES)
    packed = texts.select("text").mapInArrow(_send(n, bands, parts), "part long, packed binary")
    met = cut(packed.groupBy("part").applyInArrow(_meet(small), "bucket long, a long, b long"))
    seen = met.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("d1")).distinct()
    chosen = members.filter("n_shingles > 0").join(seen, "d1", "left_semi")
    classes = cut(chosen.groupBy("d1", "d2", "n_shingles", "sketch").agg(F.min(F.struct("doc_id", "text_hash")).alias("doc")))
    # The rows are written, each in its partition, and so keep these numbers.
    classes = classes.withColumn("id", F.monotonically_increasing_id())
    near, _ = compact(_candidates(classes, met.filter(F.col("bucket").isNull()).select("a", "b").distinct(), percent))
    whole = cut(_whole(texts, classes, near.select(F.explode(F.array("u", "v")).alias("id")).distinct()))
    # One pair for each class first: in a group of near copies that links nearly all, and the rest need no look.
    links, _ = compact(_verify(whole, near.groupBy("u").agg(F.min("v").alias("v")), n, percent))
    groups = components(links)
    links, groups = _extend(whole, _apart(near, groups), links, groups, n, percent)
    # In large buckets pairs that would join all that may link come first. Only where one of them is no link, all others are looked at.
    late, _ = compact(_within_buckets(met, classes, groups, percent, chunk, spanning=True))
    if not late.isEmpty():
        whole = cut(_whole(texts, classes, late.select(F.explode(F.array("u", "v")).alias("id")).distinct()))
        found, _ = compact(_verify(whole, late, n, percent))
        links, _ = compact(links.unionByName(found))
        groups = components(links)
        if found.count() < late.count():
            rest, _ = compact(_apart(_within_buckets(met, classes, groups, percent, chunk, spanning=False), groups))
            whole = cut(_whole(texts, classes, rest.select(F.explode(F.array("u", "v")).alias("id")).distinct()))
            links, groups = _extend(whole, rest.groupBy("u").agg(F.min("v").alias("v")), links, groups, n, percent)
            links, groups = _extend(whole, _apart(rest, groups), links, groups, n, percent)
    return members.drop("sketch"), classes.select("id", "n_shingles", "d1", "d2"), links, groups


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose classes are not in one component."""
    labels = [groups.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component")) for x in "uv"]
    labelled = pairs.join(labels[0], "u", "left").join(labels[1], "v", "left")
    together = F.coalesce(F.col("u_component") == F.col("v_component"), F.lit(False))
    return labelled.filter(~together).select("u", "v")


def _extend(whole: DataFrame, pairs: DataFrame, links: DataFrame, groups: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    pairs, _ = compact(pairs)
    if pairs.isEmpty():
        return links, groups
    links, _ = compact(links.unionByName(_verify(whole, pairs, n, percent)))
    return links, components(links)


def _within_buckets(met: DataFrame, classes: DataFrame, groups: DataFrame, percent: int, chunk: int, spanning: bool) -> DataFrame:
    """Pairs (u, v) of large buckets whose sketches allow a link and that are not in one component yet;
    spanning: of each tile only as many as join what all of them would join.

    Buckets are first told apart by numbers: those within one component need no look, and of those with
    the same members one is looked at. Only then the members get their sketches. A bucket is dealt to
    tiles of chunk members on either side, so that a task's memory is bounded; in a tile only what
    passes is a row.
    """
    rows = met.filter(F.col("bucket").isNotNull()).select("bucket", F.col("a").alias("d1"))
    numbered = rows.join(classes.select("d1", "id"), "d1").join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
    numbered, _ = compact(numbered.select("bucket", "id", F.coalesce("component", "id").alias("component")))
    names = F.xxhash64("id"), F.xxhash64(F.lit("other"), "id")
    summed = [F.sum(names[0].cast("decimal(20,0)")).alias("sum"), F.bit_xor(names[1]).alias("xor")]
    about = numbered.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("all"), *summed)
    mixed = about.filter("low < high").groupBy("all", "sum", "xor").agg(F.min("bucket").alias("bucket")).select("bucket", "all")
    chunks = F.ceil(F.col("all") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("id"), chunks).cast("int")
    chosen = numbered.join(mixed, "bucket").withColumn("chunks", chunks).withColumn("mine", mine)
    described = chosen.join(classes.select("id", "n_shingles", "sketch"), "id")
    dealt = described.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = dealt.select("bucket", "id", "component", "n_shingles", "sketch", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    return tiles.groupBy("bucket", "low", "high").applyInArrow(_compare(percent, spanning), "u long, v long").distinct()


def _forest(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) to keep so that they join as many groups as all do; group is changed to what they join."""
    low, high = np.minimum(group[a], group[b]), np.maximum(group[a], group[b])
    _, first = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True)
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while x in top:
            x = top[x]
        return x

    kept = []
    for i in np.sort(first).tolist():
        x, y = root(int(low[i])), root(int(high[i]))
        if x != y:
            top[max(x, y)] = min(x, y)
            kept.append(i)
    for old in top:
        group[group == old] = root(old)
    return np.array(kept, np.int64)


def _compare(percent: int, spanning: bool):
    def run(table: pa.Table) -> pa.Table:
        m = table.num_rows
        table = table.combine_chunks()
        size, component = table.column("n_shingles").to_numpy(), table.column("component").to_numpy()
        group = np.unique(component, return_inverse=True)[1]
        mine, high = table.column("mine").to_numpy(), table.column("high").to_numpy()[0]
        across = table.column("low").to_numpy()[0] != high
        sketch = table.column("sketch").chunk(0).flatten().to_numpy().view(np.uint64).reshape(m, -1)
        left, right = [], []
        for i in range(0, m, 128):
            j = min(i + 128, m)
            apart = np.zeros((j - i, m), np.int64)
            for k in range(sketch.shape[1]):
                apart += np.bitwise_count(sketch[i:j, k, None] ^ sketch[None, :, k])
            total = size[i:j, None] + size[None, :]
            close = (apart <= total * (100 - percent) // (100 + percent)) & (group[i:j, None] != group[None, :])
            close &= np.minimum(size[i:j, None], size[None, :]) * 100 >= np.maximum(size[i:j, None], size[None, :]) * percent
            if across:
                close &= mine[i:j, None] != mine[None, :]
            a, b = np.nonzero(close)
            a, fresh = a + i, a + i < b
            a, b = a[fresh], b[fresh]
            if spanning and len(a):
                kept = _forest(a, b, group)
                a, b = a[kept], b[kept]
            left.append(a)
            right.append(b)
        names = table.column("id").to_numpy()
        u, v = names[np.concatenate(left)], names[np.concatenate(right)]
        return pa.table({"u": pa.array(np.maximum(u, v)), "v": pa.array(np.minimum(u, v))})

    return run


def link_components(
    docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", small: int = SMALL_BUCKET, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, stands for each row of docs.

    component_id: the least doc_id that links reach. stands: the row is the one that stands for its
    component, that of the least doc_id (null last) and then text_hash; empty sets stand for themselves.
    """
    members, classes, _links, groups = similar(docs, n, percent, doc_id, text, small, chunk)
    name = ["d1", "d2", "n_shingles"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    of_class = members.filter("n_shingles > 0").groupBy(*name).agg(first.alias("first"))
    linked = groups.join(classes, groups["node"] == classes["id"]).select(*name, "component")
    of_class, _ = compact(of_class.join(linked, name, "left"))
    of_component = of_class.filter("component is not null").groupBy("component").agg(F.min("first").alias("best"))
    best = of_class.join(of_component, "component", "left").select(*name, F.coalesce("best", "first").alias("first"))
    joined = members.join(best, name, "left")
    stands = joined["doc_id"].eqNullSafe(F.col("first.doc_id")) & (joined["text_hash"] == F.col("first.text_hash"))
    return joined.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (F.col("first").isNull() | stands).alias("stands"),
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows for which another one of their component stands. Empty sets stay; of rows that repeat the one that stands, one stays."""
    found = cut(link_components(docs, n, percent, doc_id, text))
    gone = found.filter(~F.col("stands")).select("doc_id", "text_hash").distinct()
    repeated = found.filter("stands and n_shingles > 0").groupBy("doc_id", "text_hash").count().filter("count > 1")
    return without(docs, compact(gone)[0], doc_id, text, once=compact(repeated)[0])
